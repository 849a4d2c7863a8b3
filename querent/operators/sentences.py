"""Sentence ends learned from the texts themselves: abbreviations, collocations, sentence starters and letter case, by log likelihood.

A word is what stands between white space, without marks around it; its mark is a period, an ellipsis, another end (``!``, ``?`` or
several) or none. One pass counts words by the mark before them and their own mark and case; every statistic comes from that table:

- an abbreviation is a word whose period sticks to it, by the likelihood ratio of a period after it, longer words and those that
  also stand without a period counting less, inner periods more;
- a starter is a word that follows sentence ends more often than chance, a collocation a word that follows one with a period so;
- a word's case after ends and elsewhere tells whether it starts a sentence.

A period after other words ends a sentence. After an abbreviation, an ellipsis, a number or an initial it does if what follows must
start a sentence by its case (or is a starter in upper case), unless both are a collocation; after a number it does, and after an initial it
doesn't, where the case says nothing. The model is whole: it holds the words that pass the thresholds, and of the case what words follow a mark, or for given texts only what decides a place of theirs.

Nulls and edges: a null text has no sentences and counts nothing, as do texts of white space; a text without an end is one sentence.
Without texts every period ends a sentence. Long texts are searched once from front to back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions.batches import memory_returned, slices
from querent.functions.text import SPACE
from querent.session import stored

# Marks that end a word, and the thresholds of the method as published.
MARKS = ".!?…"
PERIOD_ODDS, ABBREVIATION, COLLOCATION, STARTER = 0.99, 0.3, 7.88, 30.0
NUMBER = "##"
#: A word's characters from the first to the last that is a letter, a digit or a mark.
OUTER = r"^[^\p{L}\p{N}.!?…]+|[^\p{L}\p{N}.!?…]+$"
TAIL = r"[.!?…]+$"
NUMERIC = r"^[0-9][0-9.,]*$"


def tokens(text: Column) -> Column:
    """(word, kind, case) of each word of a text; ``kind`` is its mark."""

    def token(w: Column) -> Column:
        bare = F.regexp_replace(w, OUTER, "")
        core, mark = F.regexp_replace(bare, TAIL, ""), F.regexp_extract(bare, f"({TAIL})", 1)
        kind = F.when(core == "", F.when(mark == "", "").otherwise("end")).when(mark == ".", "period").when(mark == "", "none").when(mark.rlike(r"^[.…]+$"), "ellipsis").otherwise("end")
        case = F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower").otherwise("other")
        return F.struct(F.when(core.rlike(NUMERIC), NUMBER).otherwise(F.lower(core)).alias("word"), kind.alias("kind"), case.alias("case"))

    return F.filter(F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), token), lambda t: t["kind"] != "")


#: Tokens whose reading a task keeps, and counts that it holds before it sends them on.
HELD = 200_000
COUNTS = pa.schema([*((n, pa.string()) for n in ("before", "ends", "word", "kind", "case")), ("n", pa.int64())])


def counts(docs: DataFrame) -> DataFrame:
    """(before, ends, word, kind, case, n): words by what stands before them: the word, if it has a period, and its mark (``start`` at the start of a text).

    A task reads each distinct token once, as ``words_of`` does, and sums up before the shuffle.
    """

    def out(found: Counter) -> pa.RecordBatch:
        columns = [*zip(*found, strict=True), found.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    def run(batches):
        read: dict[str, tuple[str, str, str] | None] = {}
        found: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                before, ends = "", "start"
                for token in (text or "").split():
                    if token not in read:
                        read[token] = next(words_of(token), None)
                    if own := read[token]:
                        if own[0]:
                            found[before, ends, *own] += 1
                        before, ends = own[0] if own[1] == "period" else "", own[1]
            if len(found) > HELD:
                yield out(found)
                found = Counter()
            if len(read) > HELD:
                read = {}
        if found:
            yield out(found)
        del read, found
        memory_returned()

    rows = docs.select("text").mapInArrow(run, "before string, ends string, word string, kind string, case string, n long")
    return rows.groupBy("before", "ends", "word", "kind", "case").agg(F.sum("n").alias("n"))


def times(x: Column, p: Column) -> Column:
    """x ln p, which is 0 where x is."""
    return F.when(x > 0, x * F.ln(p)).otherwise(F.lit(0.0))


def together(a: Column, b: Column, both: Column, n: Column) -> Column:
    """The log likelihood ratio of two events that meet ``both`` times."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    apart = times(both, p) + times(a - both, 1 - p) + times(b - both, p) + times(n - a - b + both, 1 - p)
    return -2 * (apart - times(both, p1) - times(a - both, 1 - p1) - times(b - both, p2) - times(n - a - b + both, 1 - p2))


def sums(rows: DataFrame, *columns: str) -> list[int]:
    """The sums of columns, as numbers."""
    return [x or 0 for x in rows.agg(*(F.sum(c) for c in columns)).first()]


def abbreviations(table: DataFrame) -> DataFrame:
    """(word, n, periods, score) of words with a period whose score says that it is theirs."""
    words = table.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "period", F.col("n")).otherwise(0)).alias("periods"))
    rows = words.where(f"periods > 0 AND word != '{NUMBER}'").where(F.col("word").rlike(r"\p{L}"))
    total, all_periods = sums(words, "n", "periods")
    with_it, without = F.col("periods"), F.col("n") - F.col("periods")
    odds = F.lit(all_periods / max(total, 1))
    ratio = -2 * (times(with_it, odds) + times(without, 1 - odds) - with_it * F.ln(F.lit(PERIOD_ODDS)) - without * F.ln(F.lit(1 - PERIOD_ODDS)))
    inner = F.length(F.regexp_replace("word", r"[^.]", ""))
    length = F.length("word") - inner
    score = ratio * F.exp(-length) * (inner + 1) * F.pow(length, -without)
    return rows.withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("word", "n", "periods", "score")


def is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{L}$")


def starters(table: DataFrame, short: DataFrame) -> DataFrame:
    """(word, n, starts, score) of words that follow sentence ends more often than chance."""
    ends = table.join(short.select(F.col("word").alias("before"), F.lit(True).alias("short")), "before", "left")
    real = (F.col("ends") == "end") | ((F.col("ends") == "period") & F.col("short").isNull() & (F.col("before") != NUMBER) & ~is_initial(F.col("before")))
    words = ends.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("starts"))
    total, all_starts = sums(words, "n", "starts")
    rows = words.where("starts > 0").where(F.col("word").rlike(r"^\p{L}+$")).where(F.lit(all_starts < total))
    score = together(F.lit(all_starts), F.col("n"), F.col("starts"), F.lit(total))
    often = F.lit(total / max(all_starts, 1)) > F.col("n") / F.col("starts")
    return rows.withColumn("score", score).where(often & (F.col("score") >= STARTER)).select("word", "n", "starts", "score")


def collocations(table: DataFrame, short: DataFrame, first: DataFrame) -> DataFrame:
    """(before, word, n, score) of words that follow an abbreviation, a number or an initial with its period more often than chance."""
    pairs = table.where("ends = 'period'").groupBy("before", "word").agg(F.sum("n").alias("n")).where("n > 1")
    pairs = pairs.join(short.select(F.col("word").alias("before"), F.lit(True).alias("short")), "before", "left").where(F.col("short").isNotNull() | (F.col("before") == NUMBER) | is_initial(F.col("before")))
    pairs = pairs.where(F.col("word").rlike(r"^\p{L}+$")).join(first.select("word"), "word", "left_anti")
    words = stored(table.groupBy("word").agg(F.sum("n").alias("n")), "words")
    (total,) = sums(words, "n")
    rows = pairs.join(words.toDF("before", "n_before"), "before").join(words.toDF("word", "n_word"), "word").where(F.col("n_before") < total)
    score = together(F.col("n_before"), F.col("n_word"), F.col("n"), F.lit(total))
    often = F.lit(total) / F.col("n_before") > F.col("n_word") / F.col("n")
    return rows.withColumn("score", score).where(often & (F.col("score") >= COLLOCATION)).select("before", "word", "n", "score")


def cases(table: DataFrame) -> DataFrame:
    """(word, n, upper_inside, upper_first, lower_inside, lower_first): where words that follow a period or an ellipsis stand in which case."""
    inside = F.col("ends") == "none"
    first = F.col("ends").isin("start", "end")
    count = lambda case, place: F.sum(F.when((F.col("case") == case) & place, F.col("n")).otherwise(0))
    asked = table.where("ends IN ('period', 'ellipsis')").select("word").distinct()
    found = table.groupBy("word").agg(F.sum("n").alias("n"), count("upper", inside).alias("upper_inside"), count("upper", first).alias("upper_first"), count("lower", ~first).alias("lower_inside"), count("lower", first).alias("lower_first"))
    return found.join(asked, "word", "left_semi")


#: White space is that of any script, as in ``SPACE``.
WORD = re.compile(r"\S+")


@dataclass
class Splitter:
    """Where sentences end by a model; ``split`` gives them without white space at their ends."""

    short: frozenset[str] = frozenset()
    first: frozenset[str] = frozenset()
    pairs: frozenset[tuple[str, str]] = frozenset()
    case: dict[str, tuple[bool, bool, bool, bool]] = field(default_factory=dict)

    def starts(self, word: str, case: str) -> bool | None:
        """Whether a word starts a sentence, by where it stands in which case; None if that says nothing."""
        upper_inside, upper_first, lower_inside, lower_first = self.case.get(word, (False,) * 4)
        if case == "upper" and (lower_inside or lower_first) and not upper_inside:
            return True
        if case == "lower" and (upper_inside or upper_first or not lower_first):
            return False
        return None

    def ends(self, word: str, kind: str, after: str, case: str, mark: bool) -> bool:
        """Whether a word with the mark ``kind`` ends a sentence before the word ``after``, which begins with a ``mark`` or has a case."""
        if kind == "end":
            return True
        initial = len(word) == 1 and word.isalpha()
        known = kind == "ellipsis" or word in self.short or word == NUMBER or initial
        if not known:
            return True
        if mark or (word, after) in self.pairs:
            return False
        starts = self.starts(after, case)
        if starts is not None:
            return starts
        if case == "upper" and after in self.first and not initial:
            return True
        return word == NUMBER

    def split(self, text: str) -> list[str]:
        out, begin, last, end = [], 0, None, 0
        for found in WORD.finditer(text):
            if last is not None and self.ends(*last, *read_start(found[0])):
                out.append(text[begin:end])
                begin = found.start()
            elif begin == end == 0:
                begin = found.start()
            last, end = read_end(found[0]), found.end()
        return [*out, text[begin:end]] if end else out

    __call__ = split


OUTER_RE, TAIL_RE, NUMERIC_RE = regex.compile(OUTER.replace("$", r"\Z")), regex.compile(r"[.!?…]+\Z"), regex.compile(r"[0-9][0-9.,]*")
UPPER, LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")


def read_word(token: str) -> tuple[str, str]:
    """The word of a token, without its mark, and the mark."""
    bare = OUTER_RE.sub("", token)
    mark = TAIL_RE.search(bare)
    return (bare[: mark.start()], mark[0]) if mark else (bare, "")


def read_end(token: str) -> tuple[str, str] | None:
    """The word and the kind of mark of a token that may end a sentence."""
    if not any(m in token for m in MARKS):
        return None
    core, mark = read_word(token)
    if not mark:
        return None
    kind = "end" if not core else "period" if mark == "." else "ellipsis" if not mark.strip(".…") else "end"
    return NUMBER if NUMERIC_RE.fullmatch(core) else core.lower(), kind


def read_start(token: str) -> tuple[str, str, bool]:
    """The word and the case of a token that may start a sentence, and whether it begins with a mark that goes on with one."""
    core = read_word(token)[0]
    case = "upper" if UPPER.match(core) else "lower" if LOWER.match(core) else "other"
    return NUMBER if NUMERIC_RE.fullmatch(core) else core.lower(), case, token[0] in ",;:.!?…"


def deciding(table: DataFrame, short: DataFrame) -> DataFrame:
    """The rows of ``cases`` that change what ``Splitter.starts`` says of a word where it is asked.

    It is asked of words that follow an ellipsis, or the period of an abbreviation, a number or an initial, and only in a case in which they stand there;
    of all other words a splitter says the same as of those that it doesn't know.
    """
    known = F.col("short").isNotNull() | (F.col("before") == NUMBER) | is_initial(F.col("before")) | (F.col("ends") == "ellipsis")
    after = table.where("ends IN ('period', 'ellipsis')").join(short.select(F.col("word").alias("before"), F.lit(True).alias("short")), "before", "left").where(known)
    asked = after.groupBy("word").agg(F.max(F.col("case") == "upper").alias("as_upper"), F.max(F.col("case") == "lower").alias("as_lower"))
    starts = "as_upper AND lower_inside + lower_first > 0 AND upper_inside = 0"
    open_ = "as_lower AND lower_first > 0 AND upper_inside + upper_first = 0"
    return cases(table).join(asked, "word").where(f"{starts} OR {open_}").drop("as_upper", "as_lower")


def trained(docs: DataFrame, most: int | None = None, decisive: bool = False) -> Splitter:
    """The model of all texts of ``docs``, whole, or the ``most`` frequent words of each kind; ``decisive`` leaves out cases that decide nothing in these texts."""
    cut = lambda rows, *by: rows.orderBy(*by).limit(most) if most is not None else rows
    table = stored(counts(docs), "sentence-counts")
    short = stored(cut(abbreviations(table), F.desc("periods"), "word"), "abbreviations")
    first = stored(cut(starters(table, short), F.desc("starts"), "word"), "starters")
    pairs = cut(collocations(table, short, first), F.desc("n"), "before", "word")
    words = lambda rows: frozenset(rows.select("word").toArrow().column(0).to_pylist())
    held = pairs.select("before", "word").toArrow()
    flags = cut(deciding(table, short) if decisive else cases(table), F.desc("n"), "word").select("word", *(F.col(c) > 0 for c in ("upper_inside", "upper_first", "lower_inside", "lower_first"))).toArrow()
    columns = [flags.column(k).to_pylist() for k in range(5)]
    return Splitter(words(short), words(first), frozenset(zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True)), dict(zip(columns[0], zip(*columns[1:], strict=True), strict=True)))


def words_of(text: str) -> Iterator[tuple[str, str, str]]:
    """The (word, kind, case) that ``tokens`` gives, of one text in Python."""
    for found in WORD.finditer(text):
        core, mark = read_word(found[0])
        if core or mark:
            yield read_start(found[0])[0], (read_end(found[0]) or ("", "none"))[1], read_start(found[0])[1]


def split_texts(docs: DataFrame, model: Splitter) -> DataFrame:
    """``docs`` with their texts as arrays of sentences, in a column ``sentences``; a null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema if f.name != "sentences"]
    schema = T.StructType([*others, T.StructField("sentences", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in slices(batches):
            found = [shared.value.split(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], schema=arrow)

    return docs.select(*(f.name for f in others)).mapInArrow(run, schema)
