"""Near-duplicates by the Jaccard similarity of word shingles.

Texts of equal shingle sets are one; a set goes by two hashes of 64 bits. Of each set the minima under BANDS x ROWS hash functions are
taken, and sets that agree in all the minima of a band are a bucket: at a similarity of 0.8 one in 16,000 pairs meets in none.
Meeting only makes candidates, which are compared on their whole shingle sets, in two rounds. First each set meets the first set of each
of its buckets; what is similar is joined, which settles copies however many there are. Then buckets whose sets aren't all joined
are worked out, each set of members once however many bands gave it: joined sets aren't compared again. A bucket of more than
``cell_rows`` sets, or of more than ``cell_hashes`` shingles, is dealt as pairs of blocks. So a set is sent to the firsts of its buckets and to
the buckets that aren't joined, whatever a chain of similar sets may reach. SimHash can't stand in for the bands here: pairs of
0.8 differ in about ten of 64 bits, and an index for that distance would probe thousands of values a text.

``kept`` also joins what operator 10 links, texts whose fingerprints differ in four bits or fewer: sets of one component of fingerprints
are a star of links, which goes into the same components as the others.

Words are those of ``simhash``: lower-cased in A to Z and parted by ASCII white space. A text with fewer words than a
shingle is one shingle, one without words has none and is equal to others without. A long text is cut into blocks of bytes. Null texts,
null and repeated ids, repeated rows, empty tables (which give no rows) and clashing names are taken as in ``simhash.kept``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from querent.llm.arrow import by_columns, memory_returned, slices
from querent.llm.simhash import components, fingerprint, kept_rows, rooted, shingle_hashes, signed
from querent.session import stored

BANDS, ROWS = 32, 6
#: Shingles whose hashes are worked out at once.
BLOCK = 2048


def shingled(text: str | None, width: int, seed: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of ``text``."""
    found = [np.unique(h) for h in shingle_hashes(text, width, seed)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, "<u8")


def key_of(hashes: np.ndarray) -> str:
    """The name of a shingle set."""
    data = hashes.tobytes()
    return f"{xxh64_intdigest(data, 0):016x}{xxh64_intdigest(data, 1):016x}"


def functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(seed)
    draw = lambda: rnd.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
    return draw(), draw() | np.uint32(1)


def bands(hashes: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> list[int]:
    """The value of each band of a shingle set, none for the empty one."""
    if not len(hashes):
        return []
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), BLOCK):
        np.minimum(least, ((high[at : at + BLOCK] ^ flip) * factor).min(axis=1), out=least)
    data = least.tobytes()
    return [signed(xxh64_intdigest(data[4 * ROWS * k : 4 * ROWS * (k + 1)], k)) for k in range(BANDS)]


def alike(own: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    few, many = sorted((len(own), len(other)))
    if few < similarity * many - 1e-9:
        return False
    common = len(np.intersect1d(own, other, assume_unique=True))
    return common >= similarity * (few + many - common) - 1e-9


def linked(sets: list[np.ndarray], roots: list[str], similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``sets`` that are as similar as that, as many as join all that are; those of one root are joined already."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        return [(0, 1)] if roots[0] != roots[1] and alike(*sets, similarity) else []
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0, *sizes])
    mark = np.zeros(len(every), bool)
    codes = np.unique(roots, return_inverse=True)[1]
    out, free = [], np.arange(len(sets))
    while len(free):
        own = codes[free] == codes[free[0]]
        front, free = free[own].tolist(), free[~own]
        while front and len(free):
            at = front.pop()
            inside = place[cuts[at] : cuts[at + 1]]
            mark[inside] = True
            few, many = np.minimum(sizes[free], sizes[at]), np.maximum(sizes[free], sizes[at])
            able = np.flatnonzero(few >= similarity * many - 1e-9)
            common = np.array([np.count_nonzero(mark[place[cuts[i] : cuts[i + 1]]]) for i in free[able].tolist()], np.int64)
            mark[inside] = False
            near = free[able[common >= similarity * (sizes[at] + sizes[free[able]] - common) - 1e-9]]
            if len(near):
                _, one = np.unique(codes[near], return_index=True)
                out += [(at, int(i)) for i in near[one]]
                joined = np.isin(codes[free], codes[near])
                front += free[joined].tolist()
                free = free[~joined]
    return out


LINKS = pa.schema([("a", pa.string()), ("b", pa.string())])


def bucketed(own: DataFrame) -> DataFrame:
    """(band, value, fp, size, first, n): sets of (fp, size, bands) by their buckets, those of one set left out."""
    rows = own.select("fp", "size", F.posexplode("bands").alias("band", "value"))
    least = stored(rows.groupBy("band", "value").agg(F.min("fp").alias("first"), F.count("*").alias("n"), F.sum("size").alias("hashes")).where("n > 1"), "buckets")
    return rows.join(least, ["band", "value"])


def blocks_of(n: str, hashes: str, cell_rows: int, cell_hashes: int) -> Column:
    over = lambda c, most: F.when(F.col(c) > most, F.ceil(F.col(c) / (most / 2))).otherwise(1)
    return F.greatest(over(n, cell_rows), over(hashes, cell_hashes)).cast("int")


def first_links(met: DataFrame, sets: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """(a, b): sets that are similar to the first of a bucket of theirs. Those of a first are dealt by ``cell_rows``, each share with the first's own set."""
    pairs = stored(met.where("fp != first").select("first", "fp").distinct(), "first-pairs")
    shares = pairs.groupBy("first").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("shares"))
    rows = pairs.join(shares, "first").select("first", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int").alias("share"), "fp", F.lit(1).alias("late"))
    leads = shares.select("first", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("first").alias("fp"), F.lit(0).alias("late"))
    rows = rows.unionByName(leads).join(sets, "fp").select("first", "share", "late", "fp", "hashes")
    rows = rows.repartition("first", "share").sortWithinPartitions("first", "share", "late")

    def run(batches):
        lead = None
        for part in slices(batches):
            found = []
            for first, late, fp, data in zip(*(part.column(c).to_pylist() for c in ("first", "late", "fp", "hashes")), strict=True):
                own = np.frombuffer(data, "<u8")
                if not late:
                    lead = own
                elif alike(lead, own, similarity):
                    found.append((first, fp))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=LINKS)
        memory_returned()

    return rows.mapInArrow(run, "a string, b string")


def bucket_links(met: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, cell_rows: int, cell_hashes: int) -> DataFrame:
    """(a, b): links between sets of unlike roots (node, root) that meet in a bucket."""
    rows = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("band", "value", "fp", "size", F.coalesce("root", "fp").alias("root"))
    rows = stored(rows, "rooted")
    marks = lambda seed: F.sum(F.xxhash64("fp", F.lit(seed)).cast("decimal(38,0)"))
    mixed = rows.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min("root").alias("least"), F.max("root").alias("most"), marks(0).alias("mark"), marks(1).alias("other_mark"))
    mixed = mixed.where("least != most").groupBy("n", "hashes", "mark", "other_mark").agg(F.min(F.struct("band", "value")).alias("one"))
    mixed = stored(mixed.select("one.*", blocks_of("n", "hashes", cell_rows, cell_hashes).alias("blocks")), "mixed-buckets")
    dealt = rows.join(mixed, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = F.expr("CASE WHEN blocks = 1 THEN array(0L) ELSE transform(filter(sequence(0, blocks - 1), x -> x != block), x -> least(x, block) * bigint(blocks) + greatest(x, block)) END")
    names = ["band", "value", "cell"]
    placed = dealt.select("band", "value", F.explode(cells).alias("cell"), "fp", "root").join(sets, "fp")
    placed = placed.select(*names, "fp", "root", "hashes").repartition(*names).sortWithinPartitions(*names)

    def out(fps, roots, own):
        pairs = linked(own, roots, similarity)
        return pa.RecordBatch.from_arrays([pa.array([fps[p[k]] for p in pairs], pa.string()) for k in (0, 1)], schema=LINKS)

    def run(batches):
        key, fps, roots, own = None, [], [], []
        for part in slices(batches):
            for *here, fp, root, data in zip(*(part.column(c).to_pylist() for c in (*names, "fp", "root", "hashes")), strict=True):
                if key != here:
                    if len(own) > 1:
                        yield out(fps, roots, own)
                    key, fps, roots, own = here, [], [], []
                fps.append(fp)
                roots.append(root)
                own.append(np.frombuffer(data, "<u8"))
        if len(own) > 1:
            yield out(fps, roots, own)
        memory_returned()

    return placed.mapInArrow(run, "a string, b string")


def sets_of(docs: DataFrame, firsts: DataFrame, width: int, seed: int) -> DataFrame:
    """(fp, hashes): the whole shingle sets of ``firsts`` (fp, first_id), from the texts of ``docs``."""
    schema = T.StructType([T.StructField("fp", T.StringType()), T.StructField("hashes", T.BinaryType())])

    def work():
        def function(rows):
            found = [(key_of(s), s.tobytes()) for s in (shingled(t, width, seed) for t in rows["text"])]
            return {"fp": [f for f, _ in found], "hashes": [h for _, h in found]}

        return function

    ids = firsts.select("first_id").distinct()
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.first_id), "left_semi").select("text")
    return by_columns(texts, schema, work).join(firsts.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def mark_links(own: DataFrame, distance: int) -> DataFrame:
    """(a, b): a star of the shingle sets ``fp`` of each component of the SimHash fingerprints ``mark`` of (doc_id, fp, mark)."""
    tree = rooted(own.select("doc_id", F.col("mark").alias("fp")), distance, 8192).select(F.col("fp").alias("mark"), F.col("root").alias("of"))
    rows = stored(own.select("fp", "mark").distinct().join(tree, "mark").select("of", "fp").distinct(), "mark-roots")
    least = rows.groupBy("of").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("of", "a")
    return rows.join(least, "of").where("a != fp").select("a", F.col("fp").alias("b"))


def kept(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, cell_rows: int = 512, cell_hashes: int = 1 << 20, distance: int = 4) -> DataFrame:
    """One row of each group of ``docs``, chosen as by ``simhash.kept``: SimHash fingerprints of ``distance`` or fewer differing bits connect rows, and so do pairs of ``similarity`` or more."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.StringType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("mark", T.LongType())])

    def work():
        flip, factor = functions(seed)

        def function(rows):
            found = [(key_of(s), len(s), bands(s, flip, factor)) for s in (shingled(t, width, seed) for t in rows["text"])]  # one set at a time
            marks = [signed(fingerprint(t, seed=seed)) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "mark": marks} | {c: [f[k] for f in found] for k, c in enumerate(("fp", "size", "bands"))}

        return function

    own = stored(by_columns(docs.select("doc_id", "text"), schema, work), "shingled")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct-sets")
    met = stored(bucketed(distinct), "met")
    sets = stored(sets_of(docs.select("doc_id", "text"), distinct.join(met.select("fp").distinct(), "fp", "left_semi"), width, seed), "shingle-sets")
    links = stored(first_links(met, sets, similarity, cell_rows).unionByName(mark_links(own, distance)), "first-links")
    more = bucket_links(met, sets, components(links), similarity, cell_rows, cell_hashes)
    tree = components(links.unionByName(stored(more, "bucket-links"))).withColumnRenamed("node", "fp")
    tree = stored(distinct.select("fp", "first_id").join(tree, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    return kept_rows(docs, own.select("doc_id", "fp"), tree, lambda text: key_of(shingled(text, width, seed)))
