"""Answers as lines of JSON events, their reader, and the events of answering through a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = "array<struct<rank:int,text:string,source:string,score:double>>"
META = {"chunks": CHUNKS, "config": "map<string,string>", "hyde_doc": "string", "standalone_query": "string"}
LINE = f"type string, text string, detail string, {', '.join(f'{n} {t}' for n, t in META.items())}"


def event(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def answer_lines(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, line) of answers (keys, answer[, error, chunks, config, hyde_doc, standalone_query]), tables or streams.

    One meta line, a token line for each word with the white space after it, and an error line where there is an error.
    A null or empty answer has no tokens.
    """
    known = lambda n, t: F.col(n).cast(t) if n in answers.columns else F.lit(None).cast(t)
    error = known("error", "string")
    pieces = F.filter(F.split(F.coalesce("answer", F.lit("")), r"(?<=\s)(?=\S)"), lambda p: p != "")
    lines = F.concat(
        F.array(event("meta", **{n: known(n, t) for n, t in META.items()})),
        F.transform(pieces, lambda p: event("token", text=p)),
        F.when(error.isNotNull(), F.array(event("error", detail=error))).otherwise(F.array().cast("array<string>")),
    )
    return answers.select(*keys, F.posexplode(lines).alias("seq", "line"))


def read_lines(lines: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, answer, error, chunks, config, hyde_doc, standalone_query) of the lines (keys, seq, line) of ``answer_lines``.

    Blank lines are skipped. What isn't JSON, tokens without a meta line, and an error line give an ``error``, with the
    tokens until then as the answer; ``strict`` raises instead.
    """
    rows = lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").withColumn("e", F.from_json("line", LINE))
    kind = F.col("e.type")
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == "token", F.struct("seq", "e.text")))), lambda t: t.text), "")
    meta = F.min_by(F.when(kind == "meta", F.col("e")), F.when(kind == "meta", F.col("seq")))
    detail = F.min_by(F.when(kind == "error", F.col("e.detail")), F.when(kind == "error", F.col("seq")))
    broken = F.count_if(kind.isNull()) > 0
    found = rows.groupBy(*keys).agg(tokens.alias("answer"), meta.alias("meta"), detail.alias("detail"), broken.alias("broken"))
    error = F.coalesce("detail", F.when(F.col("broken"), F.lit("a line is no event")), F.when(F.col("meta").isNull(), F.lit("no meta line")))
    if strict:
        found = found.withColumn("answer", F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(F.col("answer")))
    return found.select(*keys, "answer", error.alias("error"), *(F.col(f"meta.{n}").alias(n) for n in META))


def cache_events(found: DataFrame, no_rag: bool = False) -> DataFrame:
    """(qid, step, event) of ``answered_through_cache``, in order of (qid, step).

    An answer is ``cached`` or made by ``generate``; the index is built once before the first one made, unless none is used.
    """
    rows = found.select("qid", F.lit(1).alias("step"), F.when(F.col("cached"), F.lit("cached")).otherwise(F.lit("generate")).alias("event"))
    if no_rag:
        return rows
    first = found.where(~F.col("cached")).agg(F.min("qid").alias("qid")).where("qid IS NOT NULL")
    return rows.unionByName(first.select("qid", F.lit(0).alias("step"), F.lit("build").alias("event")))
