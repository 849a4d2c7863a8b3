"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The mix is to hold ``share`` of all words. Sources in the order of their code points, null last, weigh ``weights`` in
turn. A source whose share by weight is above ``epochs`` times its size is clamped there, and what is left is shared
again by weight among the others, until none is above. A document is then repeated as often as its source's target
goes into the source's size: whole repetitions for all, and the fraction for documents in a seeded order until the
target is reached; the document at the end of it counts in part, so a source's words come to its target but for the
fraction of a word.

Documents are placed by the hash of the seed and their doc_id. Sizes are summed by ``SLOTS`` ranges of the hash and
source, and only the range in which the target ends is ordered, so no task gets a source whole. One row per source is
what tasks and the driver's loop of rounds see together; a round is one aggregate over those rows.

Nulls and edges: a null text has size 0, and so does an empty one. Sources of size 0 have target 0. A null doc_id is
hashed as an empty string. Repeated rows are documents of their own; equal ones are placed side by side. An empty table
gives no rows. Very long texts are only counted. Other columns, whatever their names, are kept by ``repeated`` and ignored by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

#: A word of the contract, as a regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Ranges of the hash, and hexadecimal digits of it that are used.
SLOTS, DIGITS = 4096, 15


def sized() -> Column:
    """The number of words of a document."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def placed(seed: int) -> Column:
    """A document's place in its source's order, from 0 to 2^60 - 1."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def slot() -> Column:
    return F.shiftright("place", 4 * DIGITS - 12).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) of one row per source with its size."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = stored(sources.withColumn("weight", turn), "sources")
    budget = share * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    cap = F.col("source_size") * F.lit(float(epochs))
    clamped, level = None, 0.0
    # A source is clamped if its cap over its weight is at most the level; the level rises with each round.
    while True:
        below = F.lit(False) if clamped is None else cap <= F.lit(clamped) * F.col("weight")
        held, free = rows.agg(F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("weight")))).first()
        if not free:
            break
        level = max((budget - float(held or 0)) / free, 0.0)
        if clamped == level:
            break
        clamped = level
    target = F.when(cap <= F.lit(level) * F.col("weight"), cap).otherwise(F.col("weight") * F.lit(budget - float(held or 0)) / F.lit(float(free or 1))) if free else cap
    return rows.select("source", "source_size", target.alias("target"))


def small(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """``table``, to be sent to every task if it has ``limit`` rows or fewer."""
    return F.broadcast(table) if table.count() <= limit else table


def planned(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target, whole, slot, left) of the documents' (source, size, place).

    Beyond ``whole`` repetitions, documents in slots before ``slot`` are taken once more, and ``left`` words of that slot.
    """
    slots = stored(sizes.groupBy("source", slot().alias("slot")).agg(F.sum("size").alias("slot_size")), "slots")
    sources = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    order = Window.partitionBy("end_source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = slots.withColumnRenamed("source", "end_source").withColumn("up_to", F.sum("slot_size").over(order))
    left = (F.col("extra") - F.col("up_to") + F.col("slot_size")).alias("left")
    ends = ran.join(small(sources), F.col("end_source").eqNullSafe(F.col("source"))).where("up_to > extra")
    ends = ends.groupBy("end_source").agg(F.min_by(F.struct("slot", left), "slot").alias("end"))
    found = sources.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
    return stored(found.select("source", "source_size", "target", "whole", F.coalesce("end.slot", F.lit(SLOTS)).alias("slot"), F.coalesce("end.left", F.lit(0)).alias("left")), "mix")


def taken(rows: DataFrame, sources: DataFrame, size: Column) -> DataFrame:
    """``rows`` with the columns mix_source_size, mix_target, mix_whole, mix_size (null where not needed) and mix_part.

    mix_part says how many words come on top of whole repetitions: all of the document if it is null.
    """
    names = sources.select(*(F.col(c).alias(f"mix_{c}") for c in sources.columns))
    rows = rows.join(small(names), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_own", slot())
    clear = rows.where("mix_own != mix_slot").withColumn("mix_size", F.lit(None).cast("long")).withColumn("mix_part", F.when(F.col("mix_own") > F.col("mix_slot"), F.lit(0)).cast("long"))
    order = Window.partitionBy("mix_source").orderBy("place", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ending = rows.where("mix_own = mix_slot").withColumn("mix_size", size)
    before = F.sum("mix_size").over(order) - F.col("mix_size")
    ending = ending.withColumn("mix_part", F.least(F.greatest(F.col("mix_left") - before, F.lit(0)), F.col("mix_size")).cast("long"))
    return clear.unionByName(ending)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, part, taken) of every document; ``part`` words come on top of ``whole`` repetitions."""
    sizes = stored(docs.select("doc_id", "source", sized().alias("size"), placed(seed).alias("place")), "sizes")
    rows = taken(sizes, planned(sizes, weights, share, epochs), F.col("size"))
    part = F.coalesce("mix_part", "size")
    return rows.select("doc_id", "source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_whole").alias("whole"), part.alias("part"), (F.col("size") * F.col("mix_whole") + part).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns and whole texts.

    The document at the end of a source's target is taken once more if half of it or more counts.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", placed(seed).alias("place"))
    sizes = stored(rows.select("source", sized().alias("size"), "place"), "sizes")
    rows = taken(rows, planned(sizes, weights, share, epochs), sized())
    again = F.col("mix_part").isNull() | ((F.col("mix_part") > 0) & (2 * F.col("mix_part") >= F.col("mix_size")))
    times = (F.col("mix_whole") + again.cast("long")).cast("int")
    return rows.withColumn("mix_times", times).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("row.*")


#: DuckDB SQL for ``mixed`` with its defaults, over table ``{documents}``.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM {documents}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes GROUP BY source
), budget AS (SELECT 1.5::DOUBLE * coalesce(sum(source_size), 0)::DOUBLE AS words FROM sources
), filled AS (  -- with the sources of smaller cap over weight clamped
  SELECT source, source_size, weight, 2 * source_size::DOUBLE AS cap,
         coalesce(sum(2 * source_size::DOUBLE) OVER before, 0) AS held,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k
  FROM sources WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT k, held, free FROM filled, budget WHERE cap > (words - held) / free * weight ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN f.k >= l.k THEN f.weight * (words - l.held) / l.free ELSE cap END AS target
  FROM filled f CROSS JOIN budget LEFT JOIN level l ON true
), whole AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM targets
), ran AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes s
)
SELECT r.doc_id, r.size, w.source_size, w.target,
       (w.whole * r.size + least(greatest(floor(w.target - w.whole * w.source_size)::BIGINT - r.before, 0), r.size))::BIGINT AS taken
FROM ran r JOIN whole w ON r.source IS NOT DISTINCT FROM w.source
"""
