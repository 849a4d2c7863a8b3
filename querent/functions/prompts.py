"""Prompt columns and conversation histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts' wording, with {name} where columns go.
HYDE = """Write a short paragraph that directly answers the following question.
Do not include the question itself. If unsure, make a plausible attempt.

Question: {query}

Passage:

"""
NO_RAG = """Answer the question below. If you are unsure, say so.

Question:

{query}

Answer:

"""
JUDGE = """You are grading a short factual answer against a reference answer.

Question: {question}
Reference answer: {expected}
Candidate answer: {answer}

Does the candidate state the key fact(s) of the reference answer correctly? Ignore style, extra detail, and hedging. Reply with a single word: YES or NO."""
RAG = """Answer the question using only the context below.

Before answering:
1. Find the exact place in the context that addresses the question (for a table, the specific row and column).
2. If the question asks for the highest, lowest, or best value, compare all the relevant rows.
3. Read off the precise value(s) for every quantity the question asks for; do not round, approximate, substitute a neighbouring cell, or invent figures.

Give the answer in one line, quoting the exact names and numbers from the context. If the context does not contain the answer, begin with "From general knowledge:" and then answer.

Context:

{context}

Question:

{query}

Answer:

"""
CONDENSE = """Given the conversation so far and a follow-up question, rewrite the follow-up as a
standalone question that can be understood without the conversation. Resolve pronouns and
references using the history. If the follow-up is already standalone, return it unchanged.
Do not answer it.

Conversation:

{history}

Follow-up question: {query}

Standalone question:

"""
NO_RAG_CHAT = """Answer the question below. If you are unsure, say so.

Conversation so far:

{history}

Question:

{query}

Answer:

"""
RAG_CHAT = """Answer the question below. Use the context when it is relevant; it may contain
information you do not have. If the context does not contain the answer, answer from
your own knowledge instead and begin that part with "From general knowledge:".
If you are unsure, say so.

Conversation so far:

{history}

Context:

{context}

Question:

{query}

Answer:

"""
#: Messages of a conversation that a prompt shows.
HISTORY = 6


def filled(template: str, **columns: Column) -> Column:
    """``template`` with each {name} put as its column."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((k for n in columns if (k := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def history_text(turns: Column, last: int = HISTORY) -> Column:
    """The last turns (role, text) of an array as ``User: ...`` lines."""
    tail = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), F.lit(last))
    return F.array_join(F.transform(tail, lambda t: F.concat(F.initcap(t.role), F.lit(": "), t.text)), "\n")
