"""A table by key in versions: rows are put and deleted by key, and readers stay on the version that they opened.

A version is a manifest, a small file that lists segments in order; a segment is a folder of Parquet files that is never changed. A write
makes a new segment and then the manifest of the next number, which exists whole or not at all: what stops in between leaves
the old version and a folder that ``vacuum`` deletes. Two writers that meet try for the same number; the one that comes late reads the
new manifest and adds its segment to that, so writes count in the order of their numbers.

The first segment of a manifest is the base, with one row a key; the others are changes, with a mark for keys that are deleted. Reading takes
the last change of each key and the base's rows without one: changes are few beside the base, and Spark sends them to it where they are
small. ``compact`` writes what is read as a new base; changes that came meanwhile stay after it.

Nulls and edges: null is a key like others. Of several rows of one key in a write the one with the smallest hash of its columns counts. Deleting
an unknown key does nothing. Columns are those of the first write; a write with others is an error. A store without a write has no rows
and no columns to read, which is an error. Other tables in the folder aren't touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How often a writer tries for the next number.
TRIES = 20
GONE, PLACE = "querent_gone", "querent_place"


class NothingStored(ValueError):
    """A store without a version that could be read."""


@dataclass
class Version:
    """A manifest: its number, its segments in order, the schema of the rows, and what was done."""

    number: int
    segments: list[str]
    schema: str
    done: str


class KeyedStore:
    """A versioned table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """The numbers of all versions."""
        folder = self.place("versions")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The version of a number, or the last."""
        known = self.numbers()
        if number is None and known:
            number = known[-1]
        if number is None or number not in known:
            raise NothingStored(f"{self.path} has no version {'' if number is None else number}".strip())
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{number:08d}.json", wholetext=True).collect())  # one small file
        return Version(**json.loads(text))

    def committed(self, version: Version) -> bool:
        """Writes a manifest whole, unless its number is taken."""
        part, final = self.place(f"versions/.{uuid.uuid4().hex}"), self.place(f"versions/{version.number:08d}.json")
        out = self.files.create(part, True)
        out.write(bytearray(json.dumps(vars(version)).encode()))
        out.close()
        try:
            self.hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, final, self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))
            return True
        except Exception as e:  # Java's own, by its class
            if "FileAlreadyExists" not in f"{type(e).__name__} {e}":
                raise
            self.files.delete(part, False)
            return False

    def commit(self, change: Callable[[Version | None], Version]) -> Version:
        """The version that ``change`` makes of the last one, tried again where another writer was first."""
        for _ in range(TRIES):
            known = self.numbers()
            version = change(self.version(known[-1]) if known else None)
            if self.committed(version):
                return version
        raise RuntimeError(f"{self.path}: other writers were first {TRIES} times")

    def segment(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def same(self, schema: str, rows: DataFrame) -> None:
        """Raises unless ``rows`` have the columns of the store."""
        plain = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s.fields)
        if plain(T.StructType.fromJson(json.loads(schema))) != plain(rows.schema):
            raise ValueError(f"{self.path} has other columns")

    def put(self, rows: DataFrame) -> Version:
        """Rows in place of those of their keys."""
        order = Window.partitionBy(self.key).orderBy(F.xxhash64(*rows.columns))
        once = rows.withColumn(PLACE, F.row_number().over(order)).where(F.col(PLACE) == 1).drop(PLACE)
        known = self.numbers()
        schema = self.version(known[-1]).schema if known else rows.schema.json()
        self.same(schema, rows)
        name = self.segment(once.withColumn(GONE, F.lit(False)))

        def change(last: Version | None) -> Version:
            if last is not None:
                self.same(last.schema, rows)
            return Version(last.number + 1 if last else 1, [*(last.segments if last else []), name], last.schema if last else schema, "put")

        return self.commit(change)

    def add(self, rows: DataFrame) -> Version:
        """The rows whose keys aren't stored yet."""
        if not self.numbers():
            return self.put(rows)
        known = self.read().select(F.col(self.key).alias(PLACE))
        return self.put(rows.join(known, F.col(self.key).eqNullSafe(F.col(PLACE)), "left_anti"))

    def delete(self, keys: DataFrame) -> Version:
        """Takes out the rows of ``keys``."""
        last = self.version()
        schema = T.StructType.fromJson(json.loads(last.schema))
        rows = keys.select(F.col(self.key).cast(schema[self.key].dataType).alias(self.key)).distinct()
        name = self.segment(rows.select(*(F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.lit(True).alias(GONE)))
        return self.commit(lambda last: Version(last.number + 1, [*last.segments, name], last.schema, "delete"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the last; later writes don't change what this reads."""
        return self.rows_of(self.version(number))

    def rows_of(self, version: Version) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        columns = schema.fieldNames()
        table = lambda name: self.spark.read.schema(T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])).parquet(f"{self.path}/{name}")
        base = table(version.segments[0]).where(~F.col(GONE)).select(columns)
        changes = None
        for k, name in enumerate(version.segments[1:]):
            own = table(name).withColumn(PLACE, F.lit(k))
            changes = own if changes is None else changes.unionByName(own)
        if changes is None:
            return base
        order = Window.partitionBy(self.key).orderBy(F.desc(PLACE))
        last = changes.withColumn("querent_rank", F.row_number().over(order)).where("querent_rank = 1")
        kept = base.join(changes.select(F.col(self.key).alias(PLACE)).distinct(), F.col(self.key).eqNullSafe(F.col(PLACE)), "left_anti")
        return kept.unionByName(last.where(~F.col(GONE)).select(columns))

    def compact(self) -> Version:
        """One base in place of the segments that there are now, laid out by key."""
        now = self.version()
        name = self.segment(self.rows_of(now).withColumn(GONE, F.lit(False)).repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key))

        def change(last: Version) -> Version:
            if last.segments[: len(now.segments)] != now.segments:
                raise RuntimeError(f"{self.path} was compacted by another writer")
            return Version(last.number + 1, [name, *last.segments[len(now.segments) :]], last.schema, "compact")

        return self.commit(change)

    def history(self) -> list[tuple[int, str, int]]:
        """(number, what was done, segments) of the versions that are kept."""
        return [(v.number, v.done, len(v.segments)) for v in map(self.version, self.numbers())]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last ``keep``, and the segments that none of those has; no writer may be at work. Says how many segments went."""
        known = self.numbers()
        kept = {s for n in known[-keep:] for s in self.version(n).segments}
        for n in known[:-keep]:
            self.files.delete(self.place(f"versions/{n:08d}.json"), False)
        gone = [s.getPath() for s in self.files.listStatus(self.place("data")) if f"data/{s.getPath().getName()}" not in kept]
        for folder in gone:
            self.files.delete(folder, True)
        return len(gone)


