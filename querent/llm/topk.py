"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Vectors are quantised to whole numbers, sorted by descending length, and cut into blocks. The blocks of the longest
vectors give each query a first k-th score; a block whose longest vector can't reach it isn't sent to the query
(Cauchy-Schwarz on whole lengths). Within a block vectors go by descending length again: the product in the leading
directions of an SVD rotation plus the product of the lengths of the rests bounds the score, and only pairs whose bound
reaches the running k-th score are multiplied out, in whole numbers. Where most pairs survive the first bound, the
block is multiplied out at once. Any orthonormal rotation gives the same result, so it is fitted on ``sample_rows``
vectors of the smallest hashes; all vectors are searched.

Queries and vectors meet in a grid of query blocks and vector blocks, each of bounded bytes: a vector is sent once for
each query block that can reach it, so blocks are as large as a task holds, but vectors give each core a block.

Nulls and edges: vectors that are null or hold null or non-finite components take no part, nor do rows of null ids.
Shorter vectors count as filled up with zeros. Rows with a query's own id aren't its candidates; of several query rows
with one id the smallest vector is asked. Repeated rows are candidates each. Fewer than k candidates give fewer rows.
Products must stay below 2^63. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

#: Slack of the bounds for the rounding of rotated sums, as a share of the product of lengths.
SLACK = 1e-9
#: Vectors and queries of a block that are compared at once.
STEP = 1024
#: Bytes of a block's vectors, and the rows up to which a block isn't cut further for the sake of idle cores.
BLOCK_BYTES, LEAST_ROWS = 32 << 20, 8192


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>, norm): floor(scale * x) of every usable vector, filled up to the longest one."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(~odd)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    size = max(rows.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    zeros = F.array_repeat(F.lit(0).cast("long"), size)
    rows = rows.withColumn("v", F.slice(F.concat("v", zeros), 1, size))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def matrix(table: pa.Table | pa.RecordBatch, size: int) -> np.ndarray:
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Best:
    """The k best of each query so far: scores descending, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, place = np.unique(query, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, ~scores, rows))
        rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        own = order[rank < self.k]
        self.scores[touched] = scores[own].reshape(-1, self.k)
        self.ids[touched] = ids[own].reshape(-1, self.k)


def searched(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int, heads: tuple[int, ...] = (8, 24)) -> Best:
    """The best k of ``vectors`` for each query among scores of ``floors`` or more."""
    best = Best(len(queries), k)
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    vectors, ids, length = vectors[order], ids[order], length[order]
    q_length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    q_turned = queries.astype(float) @ rotation
    rest = lambda x, h: np.sqrt(np.maximum((x[:, h:] ** 2).sum(axis=1), 0))
    heads = tuple(h for h in heads if h < vectors.shape[1])
    exact_float = vectors.size and queries.size and float(length[0]) * float(q_length.max()) < 2**52
    for at in range(0, len(vectors), STEP):
        part, part_ids, part_length = vectors[at : at + STEP], ids[at : at + STEP], length[at : at + STEP]
        need = np.maximum(best.scores[:, -1], floors).astype(float)
        active = np.flatnonzero(q_length * part_length[0] * (1 + SLACK) + 1e-6 >= need)
        if not len(active):
            break  # later vectors are no longer
        turned = part.astype(float) @ rotation
        slack = SLACK * np.outer(q_length[active], part_length) + 1e-6
        a = b = None
        for h in heads:
            if a is None:
                bound = q_turned[active, :h] @ turned[:, :h].T + np.outer(rest(q_turned[active], h), rest(turned, h)) + slack
                a, b = np.nonzero(bound >= need[active][:, None])
            else:
                sums = np.einsum("ij,ij->i", q_turned[active[a], :h], turned[b, :h])
                keep = sums + rest(q_turned, h)[active[a]] * rest(turned, h)[b] + slack[a, b] >= need[active[a]]
                a, b = a[keep], b[keep]
            if 8 * len(a) > len(active) * len(part):
                a = None
                break
        if a is None:
            whole = queries[active].astype(float) @ part.T.astype(float) if exact_float else queries[active] @ part.T
            a, b = np.nonzero(whole >= need[active][:, None])
            scores = whole[a, b].astype(np.int64)
        else:
            scores = np.einsum("ij,ij->i", queries[active[a]], part[b])
            keep = scores >= need[active[a]]
            a, b, scores = a[keep], b[keep], scores[keep]
        other = query_ids[active[a]] != part_ids[b]
        if other.any():
            best.add(active[a[other]], part_ids[b[other]], scores[other])
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int | None = None, query_rows: int | None = None, sample_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of every query row with all rows but its own.

    ``block_rows`` and ``query_rows`` are the rows of a block; by default as many as BLOCK_BYTES hold.
    """
    rows = stored(quantised(vectors, vec_id, embedding, scale), "vectors")
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = stored(asked.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "queries")
    total, n_queries = rows.count(), asked.count()
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).select("v").toArrow()
    size = len(sample.column("v")[0]) if sample.num_rows else 1
    rotation = np.linalg.svd(matrix(sample, size).astype(float), full_matrices=True)[2].T if sample.num_rows else np.eye(1)

    most = max(1, BLOCK_BYTES // (8 * size))
    block_rows = block_rows or min(most, max(LEAST_ROWS, -(-total // vectors.sparkSession.sparkContext.defaultParallelism)))
    query_rows = query_rows or most
    blocks, q_blocks = max(1, -(-total // block_rows)), max(1, -(-n_queries // query_rows))
    filed = stored(rows.repartitionByRange(blocks, F.desc("norm"), F.col("vec_id"), F.xxhash64("v")).withColumn("block", F.spark_partition_id()), "blocks")
    longest = {r.block: r.norm for r in filed.groupBy("block").agg(F.max("norm").alias("norm")).collect()}  # a number a block
    first = min(longest, default=0)
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))

    schema = "query_id long, vec_id long, score long"
    arrow = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])

    def met(with_floor: bool):
        def run(queries: pa.Table, found: pa.Table) -> pa.Table:
            query_ids = queries.column("query_id").to_numpy()
            floors = queries.column("floor").to_numpy() if with_floor else np.full(len(query_ids), np.iinfo(np.int64).min)
            if not len(query_ids) or not found.num_rows:
                return arrow.empty_table()
            asked, own, ids = matrix(queries, size), matrix(found, size), found.column("vec_id").to_numpy()
            parts = []
            for at in range(0, len(query_ids), STEP):
                part = slice(at, at + STEP)
                best = searched(asked[part], query_ids[part], floors[part], own, ids, rotation, k)
                ok = best.ids != np.iinfo(np.int64).max
                parts.append(pa.table([np.repeat(query_ids[part], k)[ok.ravel()], best.ids[ok], best.scores[ok]], schema=arrow))
            return pa.concat_tables(parts)

        return run

    every = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    start = filed.where(F.col("block") == first).withColumn("q_block", every)
    near = stored(asked.groupBy("q_block").cogroup(start.groupBy("q_block")).applyInArrow(met(False), schema), "first-block")
    floor = near.groupBy(F.col("query_id").alias("floor_id")).agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    asked = asked.join(floor, F.col("query_id") == F.col("floor_id"), "left").withColumn("floor", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(-(2**63)))).drop("floor_id", "n")

    later = np.array(sorted(b for b in longest if b != first), np.int64)
    lengths = np.array([longest[b] for b in later])

    def reached(batches):
        for batch in batches:
            norm, floors = batch.column("norm").to_numpy(), batch.column("floor").to_numpy()
            # lengths fall from block to block: the blocks that can reach the floor come first
            counts = [int(np.searchsorted(-(lengths * x * (1 + SLACK) + 1e-6), -float(f), side="right")) for x, f in zip(norm, floors, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "v", "floor", "q_block")), pa.array(counts, pa.int32())], ["query_id", "v", "floor", "q_block", "reach"])

    asked = stored(asked.mapInArrow(reached, "query_id long, v array<long>, floor long, q_block int, reach int"), "reaching")
    reach = np.zeros(q_blocks, np.int64)
    for r in asked.groupBy("q_block").agg(F.max("reach").alias("reach")).collect():  # a number a query block
        reach[r.q_block] = r.reach

    def sent(batches):
        for batch in batches:
            place = np.searchsorted(later, batch.column("block").to_numpy())
            wanted = [np.flatnonzero(reach > p) for p in place.tolist()]
            at = np.repeat(np.arange(batch.num_rows), [len(w) for w in wanted])
            if len(at):
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("vec_id", "v", "block")), pa.array(np.concatenate(wanted), pa.int32())], ["vec_id", "v", "block", "q_block"])

    right = filed.where(F.col("block") != first).select("vec_id", "v", "block").mapInArrow(sent, "vec_id long, v array<long>, block int, q_block int")

    def asking(batches):
        for batch in batches:
            counts = batch.column("reach").to_numpy()
            for at, n in enumerate(counts.tolist()):
                if n:
                    out = batch.take(pa.array(np.full(n, at)))
                    yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("query_id", "v", "floor", "q_block")), pa.array(later[:n], pa.int32())], ["query_id", "v", "floor", "q_block", "block"])

    left = asked.mapInArrow(asking, "query_id long, v array<long>, floor long, q_block int, block int")
    far = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(met(True), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for ``top_k`` with rows whose vec_id is divisible by 100 as queries, over table ``{vectors}`` of distinct ids and one vector size.
SQL = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM {vectors}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM own q JOIN own c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
