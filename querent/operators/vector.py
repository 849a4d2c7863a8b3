"""Vector search: exact, by cells, by hashing, and its recall."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.session import stored

#: Bytes of query vectors that are sent to every task together, scores that are worked out at once, and most cells of an index.
QUERY_BYTES, PAIRS, MOST_CELLS = 64 << 20, 1 << 21, 65_536
#: Hits that a task keeps for the queries of a block.
QUERY_HITS = 1 << 21
#: Vectors and queries of one cell or bucket that meet in one task, and vectors that a bucket is meant to hold.
CELL_VECTORS, CELL_QUERIES, BUCKET_VECTORS = 1 << 14, 1 << 12, 1 << 10
HITS = "qid long, id long, score double"


def ranked(hits: DataFrame, k: int, by: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with ``rank`` from 1; equal scores by ascending ``tie``."""
    order = Window.partitionBy("qid").orderBy(F.desc(by), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best of each query so far, by score and then by smaller id; what comes in is sorted once enough has come."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, max(200_000, 2 * k * queries)
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        #: The score that a query's next hit must reach.
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.new.append((query, ids, scores))
        self.held += len(query)
        if self.held > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best."""
        query, ids, scores = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -scores, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        own = order[rank < self.k]
        self.floor[query[order[rank == self.k - 1]]] = scores[order[rank == self.k - 1]]
        self.kept, self.new, self.held = (query[own], ids[own], scores[own]), [], 0
        return self.kept

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        query, ids, scores = self.settle()
        return pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(ids), pa.array(scores)], ["qid", "id", "score"])


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, sources: dict[int, set[str]] | None = None, cosine: bool = True, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the k nearest of ``vectors`` (id, embedding[, source]) for each of ``queries`` (qid, qvec).

    Queries go out in blocks of QUERY_BYTES, or of QUERY_HITS hits, one after the other, each of which takes one scan of the vectors; each task keeps k rows a query,
    those of several blocks are stored, and a window picks the best. So driver and executors hold one block at a time. ``sources`` restricts a query to rows of some sources, an empty set to none.
    Scores are rounded before ranking. A null query has no hits.
    """
    queries = queries.where(F.col("qvec").isNotNull())
    total, size = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    blocks = max(1, -(-total * (size or 1) * 8 // QUERY_BYTES), -(-total * k // QUERY_HITS))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else queries
        hits = scanned(own.select("qid", "qvec").orderBy("qid").toArrow(), vectors, k, sources, cosine, digits)
        hits = stored(hits, "block-hits") if blocks > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, k)


def rows_of(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """An array column as a matrix of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero row stays."""
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(lengths == 0, 1, lengths)


def scanned(asked: pa.Table, vectors: DataFrame, k: int, sources: dict[int, set[str]] | None, cosine: bool, digits: int) -> DataFrame:
    qids = asked.column("qid").to_numpy()
    matrix = rows_of(asked.column("qvec"), len(qids)) if len(qids) else np.empty((0, 0))
    matrix = unit(matrix) if cosine and len(qids) else matrix
    step = max(1, PAIRS // max(len(qids), 1))
    restricted = [(q, sources[int(i)]) for q, i in enumerate(qids.tolist()) if int(i) in sources] if sources is not None else []

    def run(batches):
        best = Best(len(qids), k)
        for batch in batches:
            usable = batch.filter(pa.compute.is_valid(batch.column("embedding")))
            for at in range(0, usable.num_rows if len(qids) else 0, step):
                part = usable.slice(at, step)
                own, ids = rows_of(part.column("embedding"), part.num_rows), part.column("id").to_numpy()
                scores = np.round(matrix @ (unit(own) if cosine else own).T, digits) + 0.0
                fits = scores >= best.floor[:, None]
                if restricted:
                    names = part.column("source").dictionary_encode()
                    codes = names.indices.fill_null(len(names.dictionary)).to_numpy()
                    for q, allowed in restricted:
                        fits[q] &= np.array([n in allowed for n in names.dictionary.to_pylist()] + [False])[codes]
                query, place = np.nonzero(fits)
                best.add(query, ids[place], scores[query, place])
        yield best.batch(qids)

    columns = ["id", "embedding", *(["source"] if sources is not None else [])]
    return vectors.select(*columns).mapInArrow(run, HITS)


def cell_count(total: int) -> int:
    """Cells of an index over ``total`` vectors: the root, within bounds."""
    return min(MOST_CELLS, max(1, math.isqrt(total)))


def first_centroids(vectors: DataFrame, cells: int) -> DataFrame:
    """(cell_id, centre): the vectors of the smallest ids, an untrained quantiser that any engine can name."""
    rows = vectors.orderBy("id").limit(cells)
    return rows.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("centre"))


def trained_centroids(vectors: DataFrame, cells: int, seed: int = 42, rounds: int = 10, sample_rows: int = 100_000) -> DataFrame:
    """(cell_id, centre): k-means centres, fitted on ``sample_rows`` vectors of the smallest hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(sample)
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell_id int, centre array<double>")


def assigned(vectors: DataFrame, centroids: DataFrame, digits: int = 6) -> DataFrame:
    """``vectors`` with the cell of the largest inner product, ties by smaller cell. There are MOST_CELLS centres at most."""
    rows = centroids.orderBy("cell_id").collect()
    cells = np.array([r.cell_id for r in rows], np.int32)
    matrix = np.array([r.centre for r in rows], float)
    names, step = vectors.columns, max(1, PAIRS // max(len(cells), 1))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = rows_of(batch.column("embedding"), batch.num_rows)
                best = np.round(own @ matrix.T, digits).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[best])], [*names, "cell_id"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell_id", T.IntegerType())])
    return vectors.where(F.col("embedding").isNotNull()).mapInArrow(run, schema)


def probed(queries: DataFrame, centroids: DataFrame, probes: int, digits: int = 6) -> DataFrame:
    """(qid, cell_id, cell_rank): the ``probes`` best cells of each query."""
    return exact_top_k(queries, centroids.select(F.col("cell_id").cast("long").alias("id"), F.col("centre").alias("embedding")), probes, cosine=False, digits=digits).select("qid", F.col("id").cast("int").alias("cell_id"), F.col("rank").alias("cell_rank"))


def met(asked: DataFrame, filed: DataFrame, k: int, digits: int) -> DataFrame:
    """(qid, id, score): for each query (qid, qvec, cell_id) the k nearest by cosine among the vectors (id, embedding, cell_id) of its cell.

    Cells with more than CELL_VECTORS vectors or CELL_QUERIES queries are dealt by hash into blocks, of which each pair meets in a task
    of its own. There are at most as many such cells as there are full blocks, so their list stays small.
    """
    blocks = lambda df, most, name: df.groupBy("cell_id").agg(F.ceil(F.count("*") / most).alias(name))
    crowded = blocks(filed, CELL_VECTORS, "v_blocks").join(blocks(asked, CELL_QUERIES, "q_blocks"), "cell_id")
    crowded = stored(crowded.where("v_blocks > 1 OR q_blocks > 1"), "crowded")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        count = lambda side: F.coalesce(f"{side}_blocks", F.lit(1))
        rows = df.join(crowded, "cell_id", "left").withColumn(f"{own}_block", F.pmod(F.xxhash64(by), count(own)))
        return rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), count(other) - 1))).drop("v_blocks", "q_blocks")

    def run(queries: pa.Table, own: pa.Table) -> pa.Table:
        qids = queries.column("qid").to_numpy()
        best = Best(len(qids), k)
        matrix = unit(rows_of(queries.column("qvec"), len(qids))) if len(qids) else None
        step = max(1, PAIRS // max(len(qids), 1))
        for at in range(0, own.num_rows if len(qids) else 0, step):
            part = own.slice(at, step)
            ids = part.column("id").to_numpy()
            scores = np.round(matrix @ unit(rows_of(part.column("embedding"), part.num_rows)).T, digits) + 0.0
            query, place = np.nonzero(scores >= best.floor[:, None])
            best.add(query, ids[place], scores[query, place])
        return pa.Table.from_batches([best.batch(qids)])

    keys = ["cell_id", "v_block", "q_block"]
    left, right = dealt(asked.select("qid", "qvec", "cell_id"), "qid", "q", "v"), dealt(filed.select("id", "embedding", "cell_id"), "id", "v", "q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, HITS)


def ivf_top_k(queries: DataFrame, filed: DataFrame, centroids: DataFrame, k: int, probes: int = 16, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank) among the vectors (id, embedding, cell_id) of each query's best cells; fewer than k if those hold fewer."""
    asked = stored(probed(queries, centroids, probes, digits).join(queries.select("qid", "qvec"), "qid"), "probes")
    return ranked(met(asked, filed, k, digits), k)


def sampled(vectors: DataFrame, rows: int) -> DataFrame:
    """(qid, qvec): the vectors with the smallest md5 of their id, as queries that a setting is fitted on."""
    return vectors.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(rows).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))


def least_reach(hits: DataFrame, at: str, least: float, none: int) -> int:
    """The smallest value of ``at`` up to which a share of ``least`` of the hits lies."""
    counts = hits.groupBy(at).count().orderBy(at).collect()
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= least * total:
            return r[at]
    return none


def fitted_probes(filed: DataFrame, centroids: DataFrame, k: int, least: float = 0.93, sample_rows: int = 256) -> int:
    """The fewest cells whose recall@k is ``least`` over ``sample_rows`` of the vectors (id, embedding, cell_id)."""
    queries = sampled(filed, sample_rows)
    hits = exact_top_k(queries, filed, k).select("qid", "id").join(filed.select("id", "cell_id"), "id")
    return least_reach(hits.join(probed(queries, centroids, centroids.count()), ["qid", "cell_id"]), "cell_rank", least, 1)


@dataclass(frozen=True)
class Hashing:
    """Random hyperplanes: ``tables`` of ``bits`` each, and the bits in which a bucket that is looked at may differ."""

    bits: int
    flips: int
    tables: int = 12
    seed: int = 42


def signed(df: DataFrame, vector: str, hashing: Hashing, flips: int = 0) -> DataFrame:
    """``df`` with ``buckets``: for each table the buckets that differ from the vector's in ``flips`` bits or fewer."""
    names, tables, bits, seed = df.columns, hashing.tables, hashing.bits, hashing.seed
    errors = np.array([sum(1 << b for b in c) for d in range(flips + 1) for c in combinations(range(bits), d)], np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = rows_of(batch.column(vector), batch.num_rows)
            planes = np.random.default_rng(seed).normal(size=(own.shape[1], tables * bits))
            signs = (own @ planes > 0).reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            near = ((signs[:, :, None] ^ errors) + (np.arange(tables, dtype=np.int64) << bits)[:, None]).reshape(len(own), -1)
            buckets = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets], [*names, "buckets"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))]))


def fitted_hashing(vectors: DataFrame, k: int, least: float = 0.93, sample_rows: int = 256) -> Hashing:
    """Bits by the number of vectors (id, embedding), and the fewest flips whose recall@k is ``least`` over ``sample_rows`` of them."""
    usable = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
    hashing = Hashing(max(6, math.ceil(math.log2(max(usable.count(), 1) / BUCKET_VECTORS))), 0)
    queries = sampled(usable, sample_rows)
    own = signed(queries, "qvec", hashing).select("qid", F.col("buckets").alias("asked"))
    hits = exact_top_k(queries, usable, k).select("qid", "id").join(own, "qid").join(usable, "id")
    apart = F.array_min(F.zip_with("asked", "buckets", lambda a, b: F.bit_count(a.bitwiseXOR(b))))
    return replace(hashing, flips=least_reach(signed(hits, "embedding", hashing).withColumn("apart", apart), "apart", least, 0))


def lsh_top_k(queries: DataFrame, vectors: DataFrame, k: int, hashing: Hashing | None = None, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank) among vectors in a bucket that differs from the query's by few bits in one of the tables; see ``fitted_hashing``."""
    usable = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
    hashing = hashing or fitted_hashing(usable, k)
    cells = lambda df: df.withColumn("cell_id", F.explode("buckets"))
    asked = stored(signed(queries.select("qid", "qvec"), "qvec", hashing, hashing.flips), "asked-buckets")
    filed = stored(signed(usable, "embedding", hashing), "buckets")
    hits = met(cells(asked), cells(filed), k, digits)
    return ranked(hits.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the exact hits that were found."""
    hits = exact.where(F.col("rank") <= k).select("qid", "id").join(found.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
