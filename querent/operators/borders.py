"""Tables with drawn borders: lines meet in corners, corners span cells, and cells that share corners are a table.

Tables: words as in ``pages``, rules (doc_id, page, x0, x1, top, height) for level lines, bars (doc_id, page, x, top, bottom) for upright ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions.batches import memory_returned, slices
from querent.operators.layout import PAGE, centre, line_bucket
from querent.session import stored

REGION = [*PAGE, "region"]

#: Fixed value: points by which lines may miss each other and still meet.
NEAR = 3.0


def joined(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, at, start, end): lines less than NEAR apart are put at their mean, pieces that touch become one."""
    across = Window.partitionBy(*PAGE).orderBy("at")
    apart = lambda gap: (F.coalesce(gap, F.lit(1e9)) > NEAR).cast("int")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where("end > start").withColumn("gap", apart(F.col("at") - F.lag("at").over(across)))
    rows = rows.withColumn("run", F.sum("gap").over(upto(across)))
    along = Window.partitionBy(*PAGE, "run").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.avg("at").over(Window.partitionBy(*PAGE, "run"))).withColumn("gap", apart(F.col("start") - before))
    rows = rows.withColumn("piece", F.sum("gap").over(upto(along)))
    return rows.groupBy(*PAGE, F.struct("run", "piece").alias("line")).agg(F.max("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"))


def corners(rules: DataFrame, bars: DataFrame) -> DataFrame:
    """(doc_id, page, level, upright, x, y): where a level line meets an upright one; lines go by their number."""
    number = lambda line: line["run"] * 100_000 + line["piece"]
    level = joined(rules.select(*PAGE, F.col("top").alias("at"), F.col("x0").alias("start"), F.col("x1").alias("end")))
    level = level.select(*PAGE, number(F.col("line")).alias("level"), F.col("at").alias("y"), F.col("start").alias("left"), F.col("end").alias("right"))
    upright = joined(bars.select(*PAGE, F.col("x").alias("at"), F.col("top").alias("start"), F.col("bottom").alias("end")))
    upright = upright.select(*PAGE, number(F.col("line")).alias("upright"), F.col("at").alias("x"), "start", "end")
    meet = F.col("x").between(F.col("left") - NEAR, F.col("right") + NEAR) & F.col("y").between(F.col("start") - NEAR, F.col("end") + NEAR)
    return level.join(upright, PAGE).where(meet).select(*PAGE, "level", "upright", "x", "y")


def following(line: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corners in the order of their line, place and number; where each one stands there; and where the first one beyond it on its line does, or -1."""
    order = np.lexsort((number, at, line))
    line, at = line[order], at[order]
    fresh = np.concatenate([[True], (line[1:] != line[:-1]) | (at[1:] != at[:-1])])
    starts = np.append(np.flatnonzero(fresh), len(line))
    beyond = starts[np.cumsum(fresh)]
    same = np.append(line, -1)[beyond] == line
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return order, place, np.where(same, beyond, -1)[place]


def page_cells(page: np.ndarray, level: np.ndarray, upright: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Page, and (region, x0, x1, top, bottom), of the smallest cell below and right of each corner; a region goes by the place of its first cell."""
    (levels, level), (uprights, upright) = (np.unique(v, return_inverse=True) for v in (level, upright))
    row, column = page * len(levels) + level, page * len(uprights) + upright
    along, _, right = following(row, x, upright)
    down, _, below = following(column, y, level)
    known = row * len(uprights) + upright
    sorter = np.argsort(known)
    held = known[sorter]

    def corner(wanted: np.ndarray) -> np.ndarray:
        found = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        return np.where(held[found] == wanted, sorter[found], -1)

    own = np.flatnonzero((right >= 0) & (below >= 0))
    last = corner(row[down[below[own]]] * len(uprights) + upright[along[right[own]]])
    row_ends, column_ends = (np.append(np.flatnonzero(np.diff(line[order])) + 1, len(line)) for line, order in ((row, along), (column, down)))
    for k in np.flatnonzero(last < 0).tolist():  # no corner opposite the nearest ones: the first of those farther down, and then farther right
        beside = upright[along[right[own[k]] : row_ends[np.searchsorted(row_ends, right[own[k]], "right")]]]
        for under in down[below[own[k]] : column_ends[np.searchsorted(column_ends, below[own[k]], "right")]].tolist():
            found = corner(row[under] * len(uprights) + beside)
            if (hits := found[found >= 0]).size:
                last[k] = hits[0]
                break
    own, last = own[last >= 0], last[last >= 0]
    order = np.lexsort((x[own], y[own], page[own]))
    own, last = own[order], last[order]
    x0, x1, top, bottom, page = x[own], x[last], y[own], y[last], page[own]
    return page, np.column_stack([connected(page, x0, x1, top, bottom), x0, x1, top, bottom])


def connected(page: np.ndarray, x0: np.ndarray, x1: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The first of the cells that each one hangs together with by corners of the same place."""
    n = len(page)
    across, down = (np.unique(np.concatenate(v), return_inverse=True)[1].reshape(2, n) for v in ((x0, x1), (top, bottom)))
    spot = np.concatenate([(page * (2 * n) + across[a]) * (2 * n) + down[b] for a in (0, 1) for b in (0, 1)])
    spots, spot = np.unique(spot, return_inverse=True)
    order = np.argsort(spot, kind="stable")
    starts = np.searchsorted(spot[order], np.arange(len(spots)))
    region = np.arange(n)
    while n:
        least = np.minimum.reduceat(np.tile(region, 4)[order], starts)[spot].reshape(4, n).min(axis=0)
        least = np.minimum(least, least[least])
        if (least == region).all():
            break
        region = least
    return region


def numbered(cells) -> list[tuple]:
    """The cells (region, x0, x1, top, bottom) in regions of two or more, with the numbers of their row and column and the region's columns."""
    cells = np.asarray(cells, float).reshape(-1, 5)
    region = cells[:, 0].astype(int)
    count = np.bincount(region, minlength=1)

    def places(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each value's place among those of its region, and how many there are."""
        order = np.lexsort((value, region))
        fresh = np.concatenate([[True], np.diff(region[order]) > 0]) if len(order) else np.zeros(0, bool)
        other = fresh | np.concatenate([[True], np.diff(value[order]) > 0])[: len(order)]
        total = np.cumsum(other)
        out = np.empty(len(order), int)
        out[order] = total - 1 - np.repeat((total - 1)[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order))))
        most = np.zeros(len(count), int)
        np.maximum.at(most, region, out + 1)
        return out, most[region]

    rows, (columns, most) = places(cells[:, 3])[0], places(cells[:, 1])
    kept = count[region] > 1
    return list(zip(region[kept].tolist(), *cells[kept, 1:].T.tolist(), rows[kept].tolist(), columns[kept].tolist(), most[kept].tolist(), strict=True))


def cell_boxes(rules: DataFrame, bars: DataFrame) -> DataFrame:
    """(doc_id, page, region, x0, x1, top, bottom, row_no, col, columns): the cells of tables of two cells or more, by page."""

    def run(batches):
        for batch in slices(batches):
            corners = batch.column("corners").flatten()
            count = pa.compute.list_value_length(batch.column("corners")).to_numpy()
            level, upright, x, y = (corners.field(n).to_numpy() for n in ("level", "upright", "x", "y"))
            page, cells = page_cells(np.repeat(np.arange(batch.num_rows), count), level, upright, x, y)
            found = numbered(cells)
            region, *columns = [np.array(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, int)] * 8
            page_of = page[region]
            region = region - np.searchsorted(page, page_of)
            own = [batch.column(n).take(pa.array(page_of)) for n in PAGE]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip([*own, region, *columns], arrow, strict=True)], schema=arrow)
        memory_returned()

    found = corners(rules, bars).groupBy(*PAGE).agg(F.collect_list(F.struct("level", "upright", "x", "y")).alias("corners"))
    numbers = [T.StructField("region", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("x0", "x1", "top", "bottom")), *(T.StructField(n, T.IntegerType()) for n in ("row_no", "col", "columns"))]
    schema = T.StructType([*(found.schema[n] for n in PAGE), *numbers])
    arrow = to_arrow_schema(schema)
    return found.mapInArrow(run, schema)


def bordered_tables(words: DataFrame, rules: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids (doc_id, page, region, row_no, cells) of tables with borders, and their boxes; a cell that spans others leaves them empty."""
    cells = stored(cell_boxes(rules, bars), "cell-boxes")
    at = words.select(*PAGE, "text", F.col("x0").alias("wx"), centre("x0", "x1").alias("cx"), centre("top", "bottom").alias("cy"), line_bucket(F.col("top")).alias("line"))
    fits = (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("top")) & (F.col("cy") < F.col("bottom"))
    # Words and cells meet by page, and all that follows stays within the page.
    inside = cells.join(at.withColumnsRenamed({n: f"w_{n}" for n in PAGE}), (F.col("doc_id") == F.col("w_doc_id")) & (F.col("page") == F.col("w_page")) & fits, "left")
    words_in = F.collect_list(F.when(F.col("w_page").isNotNull(), F.struct("line", "wx", "text")))
    text = F.array_join(F.transform(F.array_sort(words_in), lambda w: w.text), " ")
    filled = inside.groupBy(*REGION, "row_no", "columns", "col").agg(text.alias("cell"))
    named = F.map_from_entries(F.collect_list(F.struct("col", "cell")))
    rows = filled.groupBy(*REGION, "row_no", "columns").agg(named.alias("m"))
    grid = rows.select(*REGION, "row_no", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("cells"))
    boxes = cells.groupBy(*REGION).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("top").alias("btop"), F.max("bottom").alias("bbottom"))
    return grid, boxes.drop("region")
