"""Source divergence audit: how far each source's words lie from those of the other sources of its language, by in-mapper stripes.

Each task folds whole documents into stripes, one per language and term: the number of documents, and the occurrences by
source. A task spills its stripes into the exchange when they hold ``ENTRIES`` counts or ``BYTES`` bytes of words, so a frequent
term leaves a task a few times whatever its documents. Stripes of a term meet by key and are merged;
those of terms in at least ``least`` documents of a language are kept.

With count c of a term, N of all kept terms and V kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)), and p diverges from q by
f = floor((p - q)^2 / q). The sum of f over all kept terms is taken apart, so that no term is laid out for all pairs of sources:
f for two absent terms times V, corrections for the terms of one source (from the counts it has, by how many terms have
them), and for terms of both sources, which each merged stripe gives directly, summed in the task by pair. Terms are ranked from the
merged stripes too. Products are decimals in Spark and 64 bits in tasks, which hold p (10^9 at most) and never counts; all is exact.

Rows for pairs are part of the result (sources of a language squared); they are made in ``SALTS`` shares of a source's
partners, so that a language with most sources isn't one task.

Nulls and edges: null texts, languages and sources are empty strings, which are values like others. A source without kept terms
has pairs (of p and q without counts) and no terms; a language without kept terms has pairs of value 0. Equal values go by the
item's UTF-8 bytes. Repeated rows count as documents of their own. Long texts are cut into blocks of bytes between words.
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.arrow import memory_returned, slices
from querent.session import stored

#: Counts and bytes of words of the stripes that a task holds, bytes of text cut into words at once, pairs of sources worked out at once.
ENTRIES, BYTES, BLOCK, PAIRS = 400_000, 16 << 20, 1 << 20, 1 << 20
#: Sources of a stripe that stand in one row.
WIDEST = 1 << 16
SALTS = 16
#: Bytes that part words, as spaces, and A-Z as a-z; all others stay.
LOWER = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: The key of a stripe that counts the documents of each source, as no term is empty.
DOCUMENTS = b""
SCALE = 10**9


def terms(text: bytes, block: int = BLOCK) -> Counter[bytes]:
    """The words of a whole text and how often it has them."""
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        end = at + block
        while end < len(text) and LOWER[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(LOWER).split(b" "))
        at = end
    found.pop(b"", None)
    return found


class Stripes:
    """(documents, occurrences by source) of the terms of a task, by language."""

    def __init__(self):
        self.held: dict[str, dict[bytes, list]] = {}
        self.entries = self.bytes = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        held = self.held.setdefault(lang, {})
        found = terms(text)
        found[DOCUMENTS] = 0
        for term, n in found.items():
            stripe = held.get(term)
            if stripe is None:
                held[term] = [1, {source: n}]
                self.bytes += len(term)
                self.entries += 1
                continue
            stripe[0] += 1
            sources = stripe[1]
            if source in sources:
                sources[source] += n
            else:
                sources[source] = n
                self.entries += 1

    def full(self, entries: int) -> bool:
        return self.entries >= entries or self.bytes >= BYTES

    def spilled(self) -> Iterator[pa.RecordBatch]:
        """The stripes as batches of bounded size; one with many sources is cut, and its documents are said once."""
        for lang, held in self.held.items():
            rows, size = [], 0
            for term, (documents, sources) in held.items():
                if len(sources) <= WIDEST:
                    rows.append((term, documents, sources))
                else:
                    names = list(sources)
                    for at in range(0, len(names), WIDEST):
                        rows.append((term, documents if at == 0 else 0, {s: sources[s] for s in names[at : at + WIDEST]}))
                size += len(sources) + len(term) // 8
                if size >= WIDEST:
                    yield batch(lang, rows)
                    rows, size = [], 0
            if rows:
                yield batch(lang, rows)
        self.held, self.entries, self.bytes = {}, 0, 0


STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def batch(lang: str, rows: list[tuple[bytes, int, dict[str, int]]]) -> pa.RecordBatch:
    names, documents, sources = zip(*rows, strict=True)
    ends = pa.array(np.cumsum([0, *map(len, sources)]), pa.int32())
    spread = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(values)), kind))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(rows)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(documents, pa.int64()), spread(sources, pa.string()), spread((s.values() for s in sources), pa.int64())], schema=STRIPE)


def folded(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, term, documents, sources, counts): the stripes of every task; of a term there are as many as tasks and spills had it."""

    def run(batches):
        stripes = Stripes()
        for part in slices(batches):
            for row in zip(*part.to_pydict().values(), strict=True):
                stripes.fold(*row)
                if stripes.full(entries):
                    yield from stripes.spilled()
        yield from stripes.spilled()
        memory_returned()

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*read, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "lang string, term string, documents long, sources array<string>, counts array<long>")


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, term, own array<(source, n)>, total): one stripe per language and term in at least ``least`` documents, and one of each language's documents.

    The exchange by key serves both sums.
    """
    met = stripes.repartition("lang", "term").select("lang", "term", F.posexplode(F.arrays_zip("sources", "counts")).alias("k", "own"), "documents")
    counts = met.groupBy("lang", "term", F.col("own.sources").alias("source")).agg(F.sum("own.counts").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("documents")).otherwise(0)).alias("documents"))
    whole = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("own"), F.sum("n").alias("total"), F.sum("documents").alias("documents"))
    return whole.where((F.col("documents") >= least) | (F.col("term") == "")).drop("documents")


def share(count: str, total: str, kept: str) -> Column:
    """p of a count, of its total over the kept terms and their number; null without kept terms."""
    wide = lambda x: f"cast({x} AS decimal(20, 0))"
    return F.expr(f"1 + (cast({SCALE} AS decimal(10, 0)) * {wide(f'{count} + 1')}) div nullif({wide(f'{total} + {kept}')}, 0)")


def apart(p: Column, q: Column) -> Column:
    """f of p and q."""
    return F.call_function("div", (p - q) * (p - q), q)


def both_present(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms of both sources change against either alone, from (lang, term, source, p, none) by term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def f(p, q):
        return (p - q) ** 2 // q

    def summed(keys, values):
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(values, at)

    class Sums:
        def __init__(self):
            self.codes: dict[tuple[str, str], int] = {}
            self.keys, self.values = np.empty(0, np.int64), np.empty(0, np.int64)

        def add(self, codes, p, none, start, width):
            """Entries with the place and number of the entries of their term."""
            at = 0
            ends = np.cumsum(width)
            while at < len(codes):
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                n = width[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
                i, j = i[i != j], j[i != j]
                value = f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
                if len(i):
                    keys, values = summed((codes[i] << 32) | codes[j], value)
                    self.keys, self.values = summed(np.concatenate([self.keys, keys]), np.concatenate([self.values, values]))
                at = to

        def spilled(self):
            names = list(self.codes)
            for at in range(0, len(self.keys), 1 << 16):
                keys = self.keys[at : at + (1 << 16)]
                one, other = [names[k] for k in keys >> 32], [names[k] for k in keys & 0xFFFFFFFF]
                yield pa.RecordBatch.from_pydict({"lang": [x[0] for x in one], "source": [x[1] for x in one], "item": [x[1] for x in other], "value": self.values[at : at + (1 << 16)]}, schema=schema)
            self.__init__()

    def run(batches):
        sums, codes, p, none, starts, key = Sums(), [], [], [], [], None

        def worked():
            if codes:
                width = np.diff([*starts, len(codes)])
                sums.add(np.array(codes, np.int64), np.array(p, np.int64), np.array(none, np.int64), np.repeat(starts, width), np.repeat(width, width))
                for held in (codes, p, none, starts):
                    held.clear()
            if len(sums.keys) > PAIRS or len(sums.codes) > PAIRS:
                yield from sums.spilled()

        for part in slices(batches):
            for lang, term, source, own, absent in zip(*part.to_pydict().values(), strict=True):
                if key != (lang, term):
                    key = lang, term
                    if len(codes) >= 1 << 14:
                        yield from worked()
                    starts.append(len(codes))
                codes.append(sums.codes.setdefault((lang, source), len(sums.codes)))
                p.append(own)
                none.append(absent)
        yield from worked()
        yield from sums.spilled()
        memory_returned()

    placed = rows.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return placed.mapInArrow(run, "lang string, source string, item string, value long")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audited(docs: DataFrame, least: int = 3, most: int = 200, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of each source's language, and its ``most`` most telling terms."""
    stripes = stored(merged(folded(docs, entries), least), "stripes")
    terms_only = F.col("term") != ""
    langs = stripes.groupBy("lang").agg(F.count_if(terms_only).alias("kept"), F.sum("total").alias("lang_total"))
    counts = stripes.select("lang", "term", "total", F.size("own").alias("width"), F.inline("own"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("source_total")).join(langs, "lang")
    groups = stored(groups.withColumn("none", share("0", "source_total", "kept")), "sources")
    held = stored(counts.where(terms_only).join(groups, ["lang", "source"]).withColumn("p", share("n", "source_total", "kept")), "counts")

    q = share("total", "lang_total", "kept")
    telling = held.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by_term = ranked(telling, "term").where(F.col("rank") <= most)

    some = held.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("some"))
    sources = stored(groups.join(some, ["lang", "source"], "left").select("lang", "source", "kept", "none", F.coalesce("some", F.array().cast("array<struct<p:long,times:long>>")).alias("some")), "sources")
    its = sources.select(F.col("lang").alias("its_lang"), F.col("source").alias("its"), F.col("none").alias("its_none"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt"))
    salt = F.pmod(F.xxhash64("source"), F.lit(SALTS))
    pairs = sources.join(its, (F.col("lang") == F.col("its_lang")) & (salt == F.col("salt")) & (F.col("source") != F.col("its")))

    def alone(p: Callable[[Column], Column], q: Callable[[Column], Column], absent: Column) -> Column:
        """What the terms of a source add where the other hasn't them."""
        return F.coalesce(F.aggregate("some", F.lit(0).cast("long"), lambda total, x: total + x["times"] * (apart(p(x["p"]), q(x["p"])) - absent)), F.lit(0))

    none, its_none = F.col("none"), F.col("its_none")
    absent = apart(none, its_none)
    own = pairs.select("lang", "source", F.col("its").alias("item"), (F.coalesce(F.col("kept") * absent, F.lit(0)) + alone(lambda p: p, lambda p: its_none, absent)).alias("value"))
    other = pairs.select("lang", F.col("its").alias("source"), F.col("source").alias("item"), alone(lambda p: its_none, lambda p: p, apart(its_none, none)).alias("value"))
    together = both_present(held.where("width > 1"))
    by_source = ranked(own.unionByName(other).unionByName(together).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
    return by_source.unionByName(by_term)


#: DuckDB SQL for ``audited`` with its defaults, over table ``{documents}``; its terms are laid out for all sources.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM {documents}
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), sources AS (SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), totals AS (
  SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 1) // (t.total + l.v)::HUGEINT AS p,
         1 + 1000000000 * (k.n::HUGEINT + 1) // (l.total + l.v)::HUGEINT AS q
  FROM totals t JOIN kept k ON t.lang = k.lang JOIN langs l ON t.lang = l.lang
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
