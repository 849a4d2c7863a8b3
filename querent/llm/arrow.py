"""Row functions over Arrow batches, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions.batches import memory_returned, slices


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name``, made longer until none of ``columns`` is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_columns(df: DataFrame, schema: T.StructType, work: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` with lists: ``work()`` is called once a task and gives a function from input columns to output columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for part in slices(batches):
            out = function(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        memory_returned()

    return df.mapInArrow(run, schema)
