"""Queries over learned sentence ends, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import tables
from querent.functions.text import SPACE
from querent.operators import chunking, sentences
from querent.plans.text_queries import md5, rank_file
from querent.session import stored
from querent.tables import spread, table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.counts(documents(spark, sf))


def sentence_model(spark: SparkSession, sf: str) -> DataFrame:
    """Abbreviations, starters and collocations of the documents."""
    counts = stored(sentences.counts(documents(spark, sf)), "sentence-counts")
    short = stored(sentences.abbreviations(counts), "abbreviations")
    first = stored(sentences.starters(counts, short), "starters")
    pairs = sentences.collocations(counts, short, first)
    parts = [(short, "abbreviation", F.lit("")), (first, "starter", F.lit("")), (pairs, "collocation", F.col("before"))]
    rows = [p.select(F.lit(kind).alias("kind"), before.alias("before"), "word", F.round("score", 4).alias("score")) for p, kind, before in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def sentence_ends(spark: SparkSession, sf: str) -> DataFrame:
    """How many sentences each document has, and their texts with single spaces."""
    docs = documents(spark, sf)
    rows = sentences.split_texts(docs, sentences.trained(docs, decisive=True))
    whole = F.transform("sentences", lambda s: F.regexp_replace(s, f"{SPACE}+", " "))
    return rows.select("doc_id", F.size("sentences").cast("long").alias("n"), md5(F.array_join(whole, "\n")).alias("text_md5"))


def chunk_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by tokens whose sentences are the learned ones."""
    docs = documents(spark, sf)
    return chunking.token_chunks(docs, rank_file(), split=sentences.trained(docs, decisive=True)).select("doc_id", "pos", "n_tokens", md5(F.col("text")).alias("text_md5"))


def chunk_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of ``chunk_tokens`` by a table function in SQL."""
    tables.registered(spark, rank_file())
    rows = spark.sql(f"SELECT d.doc_id, c.pos, c.chunk, c.n_tokens FROM {{docs}} d, LATERAL {tables.CHUNK_TEXT}(d.text, 128, 50) c", docs=documents(spark, sf))
    return rows.select("doc_id", "pos", "n_tokens", md5(F.col("chunk")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (sentence_counts, sentence_model, sentence_ends, chunk_learned, chunk_lateral)}

WORDS = rf"""ws AS (SELECT doc_id, list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
bare AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM ws),
marked AS (SELECT *, regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}.!?…]+', ''), '[^\p{{L}}\p{{N}}.!?…]+\z', '') AS b FROM bare),
cores AS (SELECT doc_id, i, w, regexp_replace(b, '[.!?…]+\z', '') AS core, regexp_extract(b, '[.!?…]+\z') AS mark FROM marked),
toks AS (SELECT doc_id, i, w, CASE WHEN regexp_matches(core, '^[0-9][0-9.,]*\z') THEN '##' ELSE lower(core) END AS word,
  CASE WHEN core = '' AND mark = '' THEN '' WHEN core = '' THEN 'end' WHEN mark = '.' THEN 'period' WHEN mark = '' THEN 'none' WHEN regexp_matches(mark, '^[.…]+\z') THEN 'ellipsis' ELSE 'end' END AS kind,
  CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN 'upper' WHEN regexp_matches(core, '^\p{{Ll}}') THEN 'lower' ELSE 'other' END AS "case" FROM cores),
lagged AS (SELECT *, lag(kind) OVER own AS k, lag(word) OVER own AS p FROM toks WHERE kind <> '' WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
counts AS (SELECT CASE WHEN k = 'period' THEN p ELSE '' END AS before, coalesce(k, 'start') AS ends, word, kind, "case", count(*) AS n FROM lagged WHERE word <> '' GROUP BY ALL)"""


def x_ln(x: str, p: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * ln(({p})::DOUBLE) ELSE 0 END"


def ratio_sql(a: str, b: str, both: str, n: str) -> str:
    p, p1, p2 = f"{b}::DOUBLE / {n}", f"{both}::DOUBLE / {a}", f"({b} - {both})::DOUBLE / ({n} - {a})"
    rest = f"{n} - {a} - {b} + {both}"
    apart = " + ".join([x_ln(both, p), x_ln(f"{a} - {both}", f"1 - {p}"), x_ln(f"{b} - {both}", p), x_ln(rest, f"1 - {p}")])
    near = " - ".join([x_ln(both, p1), x_ln(f"{a} - {both}", f"1 - {p1}"), x_ln(f"{b} - {both}", p2), x_ln(rest, f"1 - {p2}")])
    return f"-2 * ({apart} - {near})"


MODEL = rf"""words AS (SELECT word, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (kind = 'period'), 0)::BIGINT AS periods FROM counts GROUP BY word),
tot AS (SELECT sum(n)::BIGINT AS total, sum(periods)::BIGINT AS dots FROM words),
rated AS (SELECT word, length(regexp_replace(word, '[^.]', '', 'g')) AS inner_dots, n, periods,
  -2 * ({x_ln("periods", "dots::DOUBLE / total")} + {x_ln("n - periods", "1 - dots::DOUBLE / total")} - periods * ln(0.99::DOUBLE) - (n - periods) * ln(0.01::DOUBLE)) AS ratio
  FROM words, tot WHERE periods > 0 AND word <> '##' AND regexp_matches(word, '\p{{L}}')),
short AS (SELECT * FROM (SELECT word, ratio * exp(-(length(word) - inner_dots)::DOUBLE) * (inner_dots + 1) * pow((length(word) - inner_dots)::DOUBLE, -(n - periods)::DOUBLE) AS score FROM rated) WHERE score >= 0.3::DOUBLE),
begun AS (SELECT c.word, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (ends = 'end' OR ends = 'period' AND s.word IS NULL AND before <> '##' AND NOT regexp_matches(before, '^\p{{L}}\z')), 0)::BIGINT AS starts
  FROM counts c LEFT JOIN short s ON c.before = s.word GROUP BY c.word),
all_begun AS (SELECT sum(n)::BIGINT AS total, sum(starts)::BIGINT AS begins FROM begun),
first AS (SELECT * FROM (SELECT word, {ratio_sql("begins", "n", "starts", "total")} AS score FROM begun, all_begun WHERE starts > 0 AND begins < total AND regexp_matches(word, '^\p{{L}}+\z') AND total::DOUBLE / begins > n::DOUBLE / starts) WHERE score >= 30),
met AS (SELECT before, c.word, sum(n)::BIGINT AS tied FROM counts c WHERE ends = 'period' AND regexp_matches(c.word, '^\p{{L}}+\z') AND (before IN (SELECT word FROM short) OR before = '##' OR regexp_matches(before, '^\p{{L}}\z')) AND c.word NOT IN (SELECT word FROM first) GROUP BY ALL HAVING sum(n) > 1),
pairs AS (SELECT * FROM (SELECT before, m.word, {ratio_sql("a.n", "b.n", "tied", "total")} AS score FROM met m JOIN words a ON before = a.word JOIN words b ON m.word = b.word, tot WHERE a.n < total AND total::DOUBLE / a.n > b.n::DOUBLE / tied) WHERE score >= 7.88::DOUBLE)"""

ORACLES = {
    "sentence_counts": f"WITH {WORDS} SELECT * FROM counts",
    "sentence_model": f"WITH {WORDS}, {MODEL} SELECT 'abbreviation' AS kind, '' AS before, word, round(score, 4) AS score FROM short UNION ALL SELECT 'starter', '', word, round(score, 4) FROM first UNION ALL SELECT 'collocation', before, word, round(score, 4) FROM pairs",
    "sentence_ends": rf"""WITH {WORDS}, {MODEL},
cased AS (SELECT word, bool_or("case" = 'upper' AND ends = 'none') AS ui, bool_or("case" = 'upper' AND ends IN ('start', 'end')) AS uf, bool_or("case" = 'lower' AND ends NOT IN ('start', 'end')) AS li, bool_or("case" = 'lower' AND ends IN ('start', 'end')) AS lf
  FROM counts WHERE word IN (SELECT word FROM counts WHERE ends IN ('period', 'ellipsis')) GROUP BY word),
near AS (SELECT *, lag(kind) OVER own AS k, lag(word) OVER own AS p FROM toks WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
told AS (SELECT n.*, n.k = 'ellipsis' OR n.p = '##' OR length(n.p) = 1 AND regexp_matches(n.p, '\p{{L}}') OR s.word IS NOT NULL AS known, regexp_matches(n.w, '^[,;:.!?…]') AS goes_on, q.word IS NOT NULL AS pair, f.word IS NOT NULL AS starter,
  CASE WHEN n."case" = 'upper' AND (li OR lf) AND NOT ui THEN true WHEN n."case" = 'lower' AND (coalesce(ui, false) OR coalesce(uf, false) OR NOT coalesce(lf, false)) THEN false END AS starts
  FROM near n LEFT JOIN short s ON s.word = n.p LEFT JOIN pairs q ON q.before = n.p AND q.word = n.word LEFT JOIN first f ON f.word = n.word LEFT JOIN cased c ON c.word = n.word),
cut AS (SELECT doc_id, i, w, CASE WHEN k IS NULL THEN true WHEN k IN ('', 'none') THEN false WHEN k = 'end' THEN true WHEN NOT known THEN true WHEN goes_on OR pair THEN false WHEN starts IS NOT NULL THEN starts WHEN "case" = 'upper' AND starter AND NOT (length(p) = 1 AND regexp_matches(p, '\p{{L}}')) THEN true ELSE p = '##' END AS begins FROM told),
numbered AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM cut),
sents AS (SELECT doc_id, s, string_agg(w, ' ' ORDER BY i) AS text FROM numbered GROUP BY ALL)
SELECT d.doc_id, count(s.s) AS n, md5(coalesce(string_agg(s.text, chr(10) ORDER BY s.s), '')) AS text_md5 FROM documents d LEFT JOIN sents s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
}
