"""SimHash near-duplicates by a generalised pigeonhole index.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are grouped into partitions of
correlated bits, and each partition i gets a threshold T_i with sum(T_i + 1) = distance + 1: two fingerprints that link
differ by T_i or fewer bits in one partition at least. A dynamic program allocates the thresholds by estimated
candidate counts. Each fingerprint is filed under its own value of every partition, probes the values within T_i, and
whatever meets is verified on all bits. Within a bucket only a spanning forest of the links is kept, so that rows stay
linear in the fingerprints; buckets beyond ``cell_rows`` rows, owners and probes, are dealt as pairs of blocks. Components come from
alternating large-star and small-star rounds over tables in the shared folder.

Nulls and edges: a null text is empty, an empty text has fingerprint zero, and zero links like any other fingerprint.
Equal fingerprints always share a component. A null doc_id has its fingerprint's component; it never names one, and a
component of null ids only has a null name. Repeated rows give repeated rows, an empty table none; a very long text is
cut into blocks of bytes. Other columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``kept``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from querent.llm.arrow import by_columns, free_name
from querent.session import forgotten, stored

BITS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20


def blocks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in blocks that end between words."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end]
        at = end


def shingle_hashes(text: str | None, width: int, seed: int, size: int = BLOCK) -> Iterator[np.ndarray]:
    """The hashes of the word shingles of ``text``, lower-cased in A to Z, block by block; of fewer words than a shingle the one of all."""
    held: list[bytes] = []
    some = False
    for block in blocks((text or "").encode(), size):
        held += block.translate(LOWER).split()
        if len(held) >= width:
            some = True
            yield np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(held[i:] for i in range(width)), strict=False)), repeat(seed)), "<u8")
            held = held[len(held) - width + 1 :]
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), seed)], "<u8")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of the word shingles of ``text``, lower-cased in A to Z."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def work():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [signed(fingerprint(t, width, seed)) for t in rows["text"]]}

    return by_columns(docs.select("doc_id", "text"), schema, work)


@dataclass(frozen=True)
class Partition:
    mask: int
    threshold: int

    @property
    def bits(self) -> list[int]:
        return [b for b in range(BITS) if self.mask >> b & 1]

    def errors(self) -> list[int]:
        """The bit patterns of 1 to ``threshold`` errors."""
        return [sum(1 << b for b in c) for d in range(1, self.threshold + 1) for c in combinations(self.bits, d)]


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near equal size: each starts at a free bit and takes those that correlate most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0)
    deviation = np.sqrt((centred**2).mean(axis=0))
    link = np.abs(centred.T @ centred / max(len(sample), 1)) / np.maximum(np.outer(deviation, deviation), 1e-9)
    free, groups = list(range(BITS)), []
    for size in (BITS // parts + (k < BITS % parts) for k in range(parts)):
        group = [free.pop(0)]
        while len(group) < size:
            group.append(free.pop(max(range(len(free)), key=lambda k: link[free[k], group].sum())))
        groups.append(sorted(group))
    return groups


def allocated(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of the least cost with sum(T_i + 1) = distance + 1; ``costs[i][t + 1]`` is that of threshold t, -1 for none."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(len(own) - 2, distance - used) + 1):
                if (total := cost + own[t + 1]) < then.get(used + t + 1, (float("inf"),))[0]:
                    then[used + t + 1] = (total, [*chosen, t])
        best = then
    return best.get(distance + 1, (float("inf"), []))


def planned(sample: np.ndarray, total: int, distance: int, row_cost: float = 1.0, pair_cost: float = 0.005) -> list[Partition]:
    """The index for ``total`` fingerprints of which ``sample`` is a sample: the cheapest count of partitions and thresholds.

    ``row_cost`` and ``pair_cost`` weigh a filed row against a candidate pair.
    """
    if len(sample) < 2:
        sample = np.arange(1, 3, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.triu_indices(min(len(sample), 1024), 1)
    differ = sample[a] ^ sample[b]
    best: tuple[float, list[Partition]] = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups = grouped_bits(sample, parts)
        costs = []
        for group in groups:
            mask = np.uint64(sum(1 << x for x in group))
            apart = np.bitwise_count(differ & mask)
            own = [0.0]
            for t in range(min(distance, 2) + 1):
                # each sampled chance is smoothed by that of independent even bits
                even = sum(comb(len(group), d) for d in range(t + 1)) / 2 ** len(group)
                chance = ((apart <= t).sum() + even) / (len(apart) + 1)
                filed = 1 + sum(comb(len(group), d) for d in range(1, t + 1))
                own.append(row_cost * total * filed + pair_cost * chance * total**2)
            costs.append(own)
        cost, thresholds = allocated(costs, distance)
        if cost < best[0]:
            best = cost, [Partition(sum(1 << x for x in g), t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def filed(fps: DataFrame, index: list[Partition], cell_rows: int) -> DataFrame:
    """(part, sig, cell, probe, fp): every fingerprint under its own and its probed values of each partition.

    A value with more than ``cell_rows`` rows is dealt into blocks, and each pair of blocks is a cell. Its rows are counted
    by the owners of the value and of those that probe it.
    """
    entries = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(signed(p.mask)).alias("mask"), F.array(*(F.lit(signed(e)) for e in [0, *p.errors()])).alias("errors")) for k, p in enumerate(index)))
    rows = fps.select("fp", F.explode(entries).alias("e")).select("fp", F.col("e.part").alias("part"), F.col("e.mask").alias("mask"), F.explode("e.errors").alias("error"))
    rows = rows.select("part", F.expr("(fp ^ error) & mask").alias("sig"), (F.col("error") != 0).alias("probe"), "fp")
    owned = rows.where(~F.col("probe")).groupBy("part", "sig").agg(F.count("*").alias("n"))
    errors = F.element_at(F.transform(entries, lambda e: e.errors), F.col("part") + 1)
    reached = owned.select("part", "n", "sig", F.explode(errors).alias("error")).select("part", F.expr("sig ^ error").alias("sig"), "n")
    crowded = stored(reached.groupBy("part", "sig").agg(F.sum("n").alias("n")).where(F.col("n") > cell_rows), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    blocks = F.ceil(F.col("n") / (cell_rows / 2)).cast("int")
    rows = rows.join(crowded, ["part", "sig"], "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE transform(filter(sequence(0, blocks - 1), x -> x != block), x -> least(x, block) * blocks + greatest(x, block)) END")
    return rows.select("part", "sig", F.explode(pairs).alias("cell"), "probe", "fp")


def forest(fps: np.ndarray, probe: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of one bucket that have an owner at an end; no more than a row's edge each."""
    left, right = [], []
    free = np.arange(len(fps))
    while len(free):
        owners = np.flatnonzero(~probe[free])
        if not len(owners):
            break
        front = [int(free[owners[0]])]
        free = np.delete(free, owners[0])
        while front and len(free):
            at = front.pop()
            near = np.bitwise_count(fps[free] ^ fps[at]) <= distance
            if probe[at]:
                near &= ~probe[free]
            found = free[near]
            free = free[~near]
            left += [at] * len(found)
            right += found.tolist()
            front += found.tolist()
    return left, right


def bucket_links(part: np.ndarray, sig: np.ndarray, cell: np.ndarray, probe: np.ndarray, fps: np.ndarray, distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows that are sorted by part, sig and cell: small buckets all at once, larger ones one by one."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = (part[1:] != part[:-1]) | (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        a, b = forest(fps[at : at + size], probe[at : at + size], distance)
        left.append(np.array(a, np.int64) + at)
        right.append(np.array(b, np.int64) + at)
    ends = np.repeat(starts + sizes, sizes)
    active = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    for step in range(1, small):
        active = active[active + step < ends[active]]
        if not len(active):
            break
        other = active + step
        near = (np.bitwise_count(fps[active] ^ fps[other]) <= distance) & ~(probe[active] & probe[other]) & (fps[active] != fps[other])
        left.append(active[near])
        right.append(other[near])
    if not left:
        return np.empty(0, "u8"), np.empty(0, "u8")
    a, b = fps[np.concatenate(left)], fps[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def links(fps: DataFrame, distance: int = 4, sample_rows: int = 2048, cell_rows: int = 8192) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all that link at ``distance`` or fewer bits.

    The index is fitted on the ``sample_rows`` fingerprints of the smallest hashes; every fingerprint is indexed, and
    the result is exact for any sample.
    """
    total = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()], np.int64).view("u8")
    index = planned(sample, total, distance)
    rows = filed(fps, index, cell_rows).repartition("part", "sig", "cell").sortWithinPartitions("part", "sig", "cell", "probe")
    names = ["part", "sig", "cell", "probe", "fp"]

    def run(batches):
        held = None
        for batch in batches:
            own = [np.asarray(batch.column(c)) if c != "probe" else batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            n = len(held[0])
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])) if n else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:  # the last bucket may go on in the next batch
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from out(held)

    def out(x):
        a, b = bucket_links(x[0], x[1], x[2], x[3], x[4].view("u8"), distance)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), "u8")
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])

    return rows.select(*names).mapInArrow(run, "a long, b long").where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges (a, b) and the smallest node that it reaches.

    Large-star hangs the larger neighbours of a node under its smallest one, small-star does so with the smaller
    neighbours; a round that changes nothing ends it. Minima are tables of their own, so a join with a hub can be split.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    for _ in range(rounds):
        old = [edges]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        old.append(least)
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = stored(edges, "large-star-edges")
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        old += [edges, least]
        edges = stored(edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "small-star-edges")
        forgotten(*old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(own: DataFrame, distance: int, cell_rows: int) -> DataFrame:
    """(fp, first_id, root) of the distinct fingerprints of (doc_id, fp)."""
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    tree = components(links(distinct.select("fp"), distance, cell_rows=cell_rows)).withColumnRenamed("node", "fp")
    return stored(distinct.join(tree, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, cell_rows: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: fp as a signed long, component_id the smallest doc_id reachable."""
    own = stored(fingerprints(docs, width, seed), "fingerprints")
    tree = rooted(own, distance, cell_rows)
    named = stored(tree.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = stored(tree.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, cell_rows: int = 8192) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest doc_id, null last.

    Of several rows with that id and one fingerprint, the one with the smallest hash of its columns stays.
    """
    own = stored(fingerprints(docs, width, seed), "fingerprints")
    return kept_rows(docs, own, rooted(own, distance, cell_rows), lambda text: signed(fingerprint(text, width, seed)))


def kept_rows(docs: DataFrame, own: DataFrame, tree: DataFrame, name: Callable[[str | None], int | str]) -> DataFrame:
    """The rows that ``kept`` returns, for the components ``tree`` (fp, first_id, root) of ``own`` (doc_id, fp); ``name`` gives the fp of a text."""
    least = tree.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "fp")).alias("least"))
    of_id, of, fp, copy = (free_name(f"simhash_{n}", docs.columns) for n in ("id", "of", "fp", "copy"))
    least = stored(least.select(F.col("least.first_id").alias(of_id), F.col("least.fp").alias(of)), "kept")
    if own.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.join(least, F.col("doc_id") == F.col(of_id), "left_semi")
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, tree.schema["fp"].dataType)])

    def work():
        return lambda rows: rows | {fp: [name(t) for t in rows["text"]]}

    rows = by_columns(docs, schema, work)
    rows = rows.join(least, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(fp) == F.col(of)), "left_semi")
    order = Window.partitionBy("doc_id", fp).orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).select(*docs.columns)
