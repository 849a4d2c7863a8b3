"""As-of join: to each row the last row of another table with the same key at or before its time.

Both tables are put together and sorted by range over key and time, so rows of one key may run over many partitions and none is a task of its
own. A partition carries the last row of the other table along. Only rows of its first key may depend on what came before: they are
joined with the last row that an earlier partition had of that key, one row a partition.

Nulls and edges: null keys are equal, rows with a null time match nothing and are kept. Of several rows of one key and time on the other side the
one that sorts last counts. Equal rows on the left are kept. An empty other table gives nulls, an empty left one no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.session import stored


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with equal ``by`` and a time ``at`` no later; null where there is none."""
    if taken := set(columns) & set(left.columns):
        raise ValueError(f"columns of both tables: {sorted(taken)}")
    keys = [f"key{k}" for k in range(len(by))]
    own = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    row, found = F.struct(*left.columns), F.struct(*columns)
    kinds = left.select(row.alias("l")).schema["l"].dataType, right.select(found.alias("r")).schema["r"].dataType
    timed = left.where(F.col(at).isNotNull())
    both = right.where(F.col(at).isNotNull()).select(*own, F.col(at).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(kinds[0]).alias("l"), found.alias("r"))
    both = both.unionByName(timed.select(*own, F.col(at).alias("at"), F.lit(1).alias("side"), row.alias("l"), F.lit(None).cast(kinds[1]).alias("r")))
    order = [*keys, "at", "side"]
    placed = both.withColumn("mixed", F.xxhash64("l")).repartitionByRange(*order, "mixed").sortWithinPartitions(*order, "r")
    passed = stored(carried(placed.select(*keys, "side", "l", "r"), keys), "asof")
    tails = passed.where("tail").select(F.col("part").alias("of"), *(F.col(k).alias(f"tail_{k}") for k in keys), F.col("r").alias("before"))
    same = F.col("of") < F.col("part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"tail_{k}"))
    heads = passed.where("open").select("part", *keys).distinct()  # one row a partition
    before = stored(heads.join(tails, same).groupBy("part").agg(F.max_by("before", "of").alias("before")), "asof-heads")
    rows = passed.where("NOT tail AND NOT open").select("l", "r")
    rows = rows.unionByName(passed.where("open").join(before, "part", "left").select("l", F.col("before").alias("r")))
    untimed = left.where(F.col(at).isNull()).select(row.alias("l"), F.lit(None).cast(kinds[1]).alias("r"))
    return rows.unionByName(untimed).select("l.*", *(F.col(f"r.{c}").alias(c) for c in columns))


def carried(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., l, r, part, open, tail): left rows with the last right row of their partition; those of its first key without one are ``open``,
    and a ``tail`` row has the last right row of its last key."""
    schema = T.StructType([*(f for f in rows.schema if f.name != "side"), T.StructField("part", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("tail", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last_key, last = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * n
            first = own[0] if first is None else first
            side, place = batch.column("side").to_numpy(), np.arange(n)
            new = np.array([True, *(a != b for a, b in zip(own, own[1:], strict=False))])
            start = np.maximum.accumulate(np.where(new, place, 0))
            near = np.maximum.accumulate(np.where(side == 0, place, -1))
            near = np.where(near >= start, near, -1)
            goes_on = (start == 0) & (own[0] == last_key)
            carry = last if last is not None else pa.nulls(1, batch.schema.field("r").type)
            held = pa.concat_arrays([carry, batch.column("r")])
            index = np.where(near >= 0, near + 1, np.where(goes_on & (last is not None), 0, -1))
            found = held.take(pa.array(index, mask=index < 0))
            is_left = pa.array(side == 1)
            opened = pa.array((index < 0) & np.array([k == first for k in own]))
            columns = [*(batch.column(k) for k in keys), batch.column("l"), found, pa.array([part] * n, pa.int32()), opened, pa.array([False] * n)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(is_left)
            last_key = own[-1]
            last = held.slice(int(index[-1]), 1) if index[-1] >= 0 else None
            tail = batch.slice(n - 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*(tail.column(k) for k in keys), pa.nulls(1, arrow.field("l").type), last, pa.array([part], pa.int32()), pa.array([False]), pa.array([True])], schema=arrow)

    return rows.mapInArrow(run, schema)
