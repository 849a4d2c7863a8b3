"""Page layout as relations: words (doc_id, page, text, x0, x1, top, bottom, size) to lines, columns and cells.

Rounding is to even halves, as positions were bucketed by it. ``keys`` names the columns of a group of words: a page, or a part of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.text import is_clean_number, is_number

PAGE = ["doc_id", "page"]
#: Points of a line bucket and of a histogram bin.
LINE, BIN = 3, 2.0


def line_bucket(top: Column) -> Column:
    return (F.bround(top / LINE) * LINE).cast("int")


def centre(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


def outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre is in none of their page's ``boxes`` (doc_id, page, bx0, btop, bx1, bbottom), edges included."""
    condition = (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page") == F.col("b.page"))
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    condition &= x.between(F.col("b.bx0"), F.col("b.bx1")) & y.between(F.col("b.btop"), F.col("b.bbottom"))
    # Stored boxes are a few bytes each, as they are much alike, and would be sent whole to every executor for that.
    return words.alias("w").join(boxes.hint("merge").alias("b"), condition, "left_anti")


def sized(words: DataFrame, chars: DataFrame) -> DataFrame:
    """``words`` (with word_id) with ``size``: the median of the characters near their line and within their span."""
    keys = words.select("word_id", *PAGE, "x0", "x1", F.explode(F.transform(F.array(F.lit(-LINE), F.lit(0), F.lit(LINE)), lambda d: line_bucket(F.col("top")) + d)).alias("bucket"))
    own = chars.where("size > 0").select(*PAGE, line_bucket(F.col("top")).alias("bucket"), centre("x0", "x1").alias("x"), "size")
    found = keys.join(own, [*PAGE, "bucket"]).where((F.col("x") >= F.col("x0") - 0.5) & (F.col("x") <= F.col("x1") + 0.5))
    return words.drop("size").join(found.groupBy("word_id").agg(F.median("size").alias("size")), "word_id", "left")


def lines(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, line, text): words in lines by their bucket, small ones at the nearest baseline of normal words."""
    page = Window.partitionBy(*keys)  # one exchange serves the windows and the groups
    own = words.withColumn("mid", F.median("size").over(page))
    small = (F.coalesce("mid", F.lit(0.0)) > 0) & (F.coalesce(F.col("size"), F.col("mid")) < F.col("mid") * 0.85)
    own = own.withColumn("small", small)
    normal = F.when(~F.col("small"), F.col("top"))
    along = page.orderBy("top")
    above = F.last(normal, True).over(along.rangeBetween(Window.unboundedPreceding, 0))
    below = F.first(normal, True).over(along.rangeBetween(0, Window.unboundedFollowing))
    own = own.withColumn("above", above).withColumn("below", below)
    near = F.when(F.col("above").isNull() | (F.abs(F.col("below") - F.col("top")) < F.abs(F.col("above") - F.col("top"))), F.col("below")).otherwise(F.col("above"))
    snapped = F.when(F.col("small") & (F.abs(near - F.col("top")) <= F.col("mid") * 0.6), near).otherwise(F.col("top"))
    own = own.withColumn("line", line_bucket(snapped))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda w: w.text), " ")
    return own.groupBy(*keys, "line").agg(parts.alias("text"))


def gutter_bins(words: DataFrame, width: float | Column, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, bin, n): words by the bin of their centre between 30 and 70 % of the width, empty bins included.

    A width that differs by page is a column of ``keys``.
    """
    low, high = width * 0.30, width * 0.70
    bins = F.floor((high - low) / BIN).cast("int") + 1 if isinstance(width, Column) else int((high - low) / BIN) + 1
    own = words.withColumn("x", centre("x0", "x1")).where(F.col("x").between(low, high))
    counted = own.groupBy(*keys, F.least(F.floor((F.col("x") - low) / BIN), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = counted.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gutters(words: DataFrame, width: float | Column, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, split): the x of the gutter of pages with two columns.

    It is the middle of the longest run of nearly empty bins between full ones, 6 points wide or more, near the middle of the text.
    """
    low = width * 0.30
    page, own = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    rows = gutter_bins(words, width, keys).withColumn("empty", F.col("n") <= F.max("n").over(page) * 0.10)
    rows = rows.withColumn("run", F.sum((F.col("empty") != F.coalesce(F.lag("empty").over(own), ~F.col("empty"))).cast("int")).over(own))
    rows = rows.withColumn("last_bin", F.max("bin").over(page))
    runs = rows.where("empty").groupBy(*keys, "run", "last_bin").agg(F.min("bin").alias("start"), F.count("*").alias("length")).where((F.col("start") > 0) & (F.col("start") + F.col("length") <= F.col("last_bin")) & (F.col("length") * BIN >= 6))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("b"))
    best = best.select(*keys, (low + (2 * F.col("b.start") + F.col("b.length")) / 2 * BIN).alias("split"))
    spread = words.groupBy(*keys).agg(F.min(centre("x0", "x1")).alias("a"), F.max(centre("x0", "x1")).alias("z"))
    half = (F.col("z") - F.col("a")) / 2
    return best.join(spread, keys).where((half <= 0) | (F.abs(F.col("split") - (F.col("a") + half)) <= half * 0.25)).select(*keys, "split")


def footnote_tops(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, footnote_top) of pages (doc_id, page, width, height): the first flat rule in the lower 40 % longer than a tenth of the width, or the height."""
    own = rules.withColumnRenamed("height", "thickness").join(pages, PAGE)
    own = own.where((F.col("thickness") < 2) & (F.col("top") > F.col("height") * 0.60) & (F.col("x1") - F.col("x0") > F.col("width") * 0.10))
    return pages.join(own.groupBy(*PAGE).agg(F.min("top").alias("rule")), PAGE, "left").select(*PAGE, F.coalesce("rule", "height").alias("footnote_top"))


def column_bounds(words: DataFrame, gap: float = 24.0, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, n, x): bounds of columns that start more than ``gap`` points after the last start; none for one column."""
    own = Window.partitionBy(*keys).orderBy("x")
    starts = words.select(*keys, F.bround("x0").alias("x")).distinct()
    starts = starts.withColumn("before", F.lag("x").over(own)).where(F.col("before").isNull() | (F.col("x") - F.col("before") > gap))
    inner = starts.where(F.col("before").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("x") - 5)).alias("inner"))
    ends = words.groupBy(*keys).agg((F.min("x0") - 5).alias("first"), (F.max("x1") + 5).alias("last"))
    return inner.join(ends, keys).select(*keys, F.posexplode(F.concat(F.array("first"), "inner", F.array("last"))).alias("n", "x"))


def anchored(words: DataFrame, headers: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """``words`` with ``col``: 0 left of the first anchor by more than 15 points, else the nearest of the page's ``headers`` from 1, the first on ties."""
    anchors = headers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x0", centre("x0", "x1").alias("x")))).alias("anchors"))
    own = words.join(anchors, keys)
    x = centre("x0", "x1")
    nearest = F.array_position(F.transform("anchors", lambda a: F.abs(a.x - x)), F.array_min(F.transform("anchors", lambda a: F.abs(a.x - x))))
    return own.withColumn("col", F.when(x < F.col("anchors")[0]["x"] - 15, F.lit(0)).otherwise(nearest).cast("int")).drop("anchors")


def rebuilt(words: DataFrame, headers: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, line, col, cell): words binned under the headers; bare citations and stars go from data cells."""
    own = anchored(words, headers, keys).withColumn("line", line_bucket(F.col("top"))).where((F.col("col") == 0) | ~F.col("text").rlike(r"^\[[0-9]+\]\*?$"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w.text), " ")
    own = own.groupBy(*keys, "line", "col").agg(cell.alias("cell"))
    return own.withColumn("cell", F.when(F.col("col") == 0, F.col("cell")).otherwise(F.trim(F.replace("cell", F.lit("*"), F.lit("")))))


def alignment(words: DataFrame, headers: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, score): the share of cells under the headers that are one bare number.

    Words go to their cells as what they add to it: their parts between blanks, none, one or more, and whether they are one number.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.when(text.rlike(r"^\s*\z"), 0).when(text.rlike(r"^\s*\S+\s*\z"), 1).otherwise(2)
    slim = words.select(*keys, line_bucket(F.col("top")).alias("line"), "x0", "x1", parts.alias("parts"), is_clean_number(text).alias("clean"))
    cells = anchored(slim, headers, keys).where("col > 0").groupBy(*keys, "line", "col").agg((F.sum("parts") == 1).alias("one"), F.max("clean").alias("clean"))
    return cells.groupBy(*keys).agg(F.avg((F.col("one") & F.col("clean")).cast("int")).alias("score"))


def number_bands(words: DataFrame, least: int = 4, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, band, first, last, n): runs of ``least`` lines or more with two numbers each, one of them with three."""
    per = words.groupBy(*keys, line_bucket(F.col("top")).alias("line")).agg(F.count_if(is_number(F.col("text"))).alias("numbers"))
    own = Window.partitionBy(*keys).orderBy("line")
    full = F.col("numbers") >= 2
    per = per.withColumn("full", full).withColumn("band", F.sum((full & ~F.coalesce(F.lag(full).over(own), F.lit(False))).cast("int")).over(own)).where("full")
    bands = per.groupBy(*keys, "band").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"), F.max("numbers").alias("most"))
    return bands.where((F.col("n") >= least) & (F.col("most") >= 3)).drop("most")


def panel_splits(words: DataFrame, gap: float = 40.0, cluster: float = 18.0, keys: list[str] = PAGE) -> DataFrame:
    """(doc_id, page, split): where two tables stand side by side: the middle of the widest gap between columns of numbers, if above ``gap``.

    Columns are runs of number centres less than ``cluster`` points apart, of two numbers or more; four are needed.
    """
    own = Window.partitionBy(*keys).orderBy("x")
    xs = words.where(is_number(F.col("text"))).withColumn("x", centre("x0", "x1"))
    xs = xs.withColumn("new", (F.coalesce(F.col("x") - F.lag("x").over(own), F.lit(1e9)) >= cluster).cast("int"))
    xs = xs.withColumn("c", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    centres = xs.groupBy(*keys, "c").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where("n >= 2")
    centres = centres.withColumn("next", F.lead("x").over(own)).withColumn("of", F.count("*").over(Window.partitionBy(*keys))).where("of >= 4")
    best = centres.where(F.col("next").isNotNull()).groupBy(*keys).agg(F.max(F.struct((F.col("next") - F.col("x")).alias("width"), ((F.col("next") + F.col("x")) / 2).alias("split"))).alias("b"))
    return best.where(F.col("b.width") > gap).select(*keys, F.col("b.split").alias("split"))
