"""Vector search over graphs of nearest neighbours.

Building: vectors are dealt by the hash of their id into shards of about ``SHARD_ROWS`` rows; a task holds one shard, and joins each of its
vectors with its ``k`` nearest of the shard and up to ``k`` of those that have it as theirs. So no task grows with the table, a hub is no
large group, and building is linear in the rows.

Searching: each block of queries meets each shard in a task of its own. A query follows the best ``STEP`` of its first ``width`` that it hasn't
followed, until all of them are; its hits of all shards are ranked. All rounds of a search lie within tasks, so a search is one job, whatever
the width. The work grows with queries times shards, as with any index in shards. The width is fitted: sampled vectors are asked first, without
their own row, by a ladder of widths, of which the smallest that finds ``target`` of what an exact search finds is taken.

Nulls and edges: null vectors take no part. Zero vectors score 0 with all. Equal scores go by the smaller id. An empty table has an empty
graph and no hits; with fewer than ``k`` vectors all are found. Repeated ids aren't taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.operators.vector import exact_top_k, ranked, rows_of, unit
from querent.session import forgotten, stored

#: Vectors of a shard, of which so many are scored against the others at once.
SHARD_ROWS, AT_ONCE = 1 << 13, 1 << 10
#: Vectors that a query follows in a round, sampled queries, widths that are tried in a job, queries of a task, tasks aimed at.
STEP, SAMPLES, LADDER, TASK_QUERIES, TASKS = 8, 256, 4, 1 << 12, 48
GRAPH = "id long, v array<double>, near array<long>, shard long"
HITS = "qid long, width long, ids array<long>, scores array<double>, looked long"


def as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(matrix.reshape(-1)))


def neighbours(own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) as places, sorted by a: the ``k`` nearest of each row and their reverses, up to 2 ``k`` of a row."""
    most, parts = min(k, len(own) - 1), []
    for at in range(0, len(own) if most > 0 else 0, AT_ONCE):
        scores = own[at : at + AT_ONCE] @ own.T
        rows = np.arange(len(scores))
        scores[rows, rows + at] = -np.inf
        best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        parts.append((np.repeat(rows + at, most), best.ravel(), np.take_along_axis(scores, best, 1).ravel()))
    if not parts:
        return np.empty(0, int), np.empty(0, int)
    a, b, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    a, b, score = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
    once = np.unique(a * len(own) + b, return_index=True)[1]
    a, b, score = a[once], b[once], score[once]
    order = np.lexsort((ids[b], -score, a))
    a, b = a[order], b[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < 2 * k
    return a[kept], b[kept]


def knn_graph(vectors: DataFrame, k: int = 12, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, v, near, shard): vectors of (id, embedding) at length one, with up to 2 ``k`` neighbours each of their shard; a stored table."""
    usable = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where("embedding IS NOT NULL")
    shards = max(1, -(-usable.count() // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        own, ids = unit(rows_of(table.column("embedding"), table.num_rows)), table.column("id").to_numpy()
        a, b = neighbours(own, ids, k)
        near = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.arange(len(ids) + 1)), pa.int32()), pa.array(ids[b], pa.int64()))
        return pa.table([table.column("id"), as_lists(own), near, table.column("shard")], ["id", "v", "near", "shard"])

    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return stored(dealt.groupBy("shard").applyInArrow(run, GRAPH), "graph")


class Found(NamedTuple):
    """Hits of a graph search, the width that it came to, and the share of the rows that a query looked at."""

    hits: DataFrame
    width: int
    looked: float


class Shard:
    """A shard's vectors and neighbours in a task."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.ids, self.own = table.column("id").to_numpy(), rows_of(table.column("v"), table.num_rows)
        near = table.column("near").combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(near).to_numpy(zero_copy_only=False))])
        self.near = np.searchsorted(self.ids, near.flatten().to_numpy())
        # A search begins at rows that the hash of the id puts apart: the root of their number.
        self.entry = np.random.default_rng(len(self.ids)).permutation(len(self.ids))[: math.isqrt(len(self.ids))]

    def searched(self, q: np.ndarray, widths: list[int], without: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(width, places, scores, looked) of the best for each of growing ``widths``, without the row of one id."""
        scores, seen = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), bool)
        followed, alone = seen.copy(), np.searchsorted(self.ids, without) if without is not None else len(self.ids)
        out = alone < len(self.ids) and self.ids[alone] == without
        if out:
            seen[alone] = True
        new, pool = self.entry[~seen[self.entry]], np.empty(0, int)
        for width in widths:
            pool = np.flatnonzero(np.isfinite(scores)) if len(pool) else pool
            while True:
                if len(new):
                    seen[new] = True
                    scores[new] = np.round(self.own[new] @ q, 6) + 0.0
                    pool = np.concatenate([pool, new])
                pool = pool[np.lexsort((pool, -scores[pool]))][:width]
                then = pool[~followed[pool]][:STEP]
                if not len(then):
                    break
                followed[then] = True
                around = np.concatenate([self.near[self.starts[p] : self.starts[p + 1]] for p in then.tolist()])
                new = np.unique(around[~seen[around]])
            new = new[:0]
            yield width, pool, scores[pool], int(seen.sum()) - int(out)


def met(queries: DataFrame, graph: DataFrame, k: int, widths: list[int], apart: bool, asked: int, shards: int) -> DataFrame:
    """For each of ``queries`` (qid, q), each shard and width: the ids and scores of its best, and the rows looked at."""
    blocks = max(1, -(-asked // TASK_QUERIES), min(-(-TASKS // shards), -(-asked // 16)))

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and rows.num_rows:
            shard = Shard(rows)
            matrix = unit(rows_of(own.column("q"), own.num_rows))
            for qid, q in zip(own.column("qid").to_pylist(), matrix, strict=True):
                out += [(qid, width, shard.ids[at[:k]], scores[:k], looked) for width, at, scores, looked in shard.searched(q, widths, qid if apart else None)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["qid", "width", "ids", "scores", "looked"])

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("shard", numbers(shards))
    right = graph.withColumn("block", numbers(blocks))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, HITS)


def best_of(met_rows: DataFrame, k: int) -> DataFrame:
    """(qid, width, id, score, rank) over all shards."""
    rows = met_rows.select("qid", "width", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))))
    order = Window.partitionBy("qid", "width").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fitted_width(graph: DataFrame, k: int, target: float, shards: int, total: int) -> int:
    """The smallest width of a ladder whose recall@k over sampled vectors is ``target``, or the rows of the table."""
    sample = stored(graph.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLES).select(F.col("id").alias("qid"), F.col("v").alias("q")), "graph-samples")
    exact = exact_top_k(sample.withColumnRenamed("q", "qvec"), graph.select("id", F.col("v").alias("embedding")), k + 1).where("qid != id")
    truth = stored(ranked(exact.drop("rank"), k).select("qid", "id"), "graph-truth")
    wanted, width = truth.count(), 2 * k
    while wanted and width < total:
        widths = [width]
        while len(widths) < LADDER:
            widths.append(max(widths[-1] + 1, widths[-1] * 5 // 4))
        found = best_of(met(sample, graph, k, widths, True, SAMPLES, shards), k).join(truth, ["qid", "id"]).groupBy("width").count().collect()
        good = [r["width"] for r in found if r["count"] >= target * wanted]
        if good:
            width = min(good)
            break
        width = max(widths[-1] + 1, widths[-1] * 5 // 4)
    forgotten(sample, truth)
    return width


def graph_top_k(queries: DataFrame, graph: DataFrame, k: int, width: int = 0, target: float = 0.92, apart: bool = False) -> Found:
    """(qid, id, score, rank): near ``k`` best vectors of ``graph`` for each of ``queries`` (qid, qvec) by cosine.

    A ``width`` is taken as it is; without one it is fitted to a recall of ``target`` over sampled vectors. ``apart`` leaves a query's own row out.
    """
    total, last = graph.agg(F.count("*"), F.max("shard")).first()
    shards = (last or 0) + 1
    asked = queries.where(F.col("qvec").isNotNull()).select(F.col("qid").cast("long").alias("qid"), F.transform("qvec", lambda x: x.cast("double")).alias("q"))
    count = asked.count()
    width = width if width > 0 else fitted_width(graph, k, target, shards, total)
    rows = stored(met(asked, graph, k, [width], apart, count, shards), "graph-hits")
    looked = (rows.agg(F.sum("looked")).first()[0] or 0) / max(count, 1)
    return Found(best_of(rows, k).select("qid", "id", "score", "rank"), width, looked / max(total, 1))
