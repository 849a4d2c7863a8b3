"""Whole pages: tables with and without rules, and body text in reading order.

Tables: words (doc_id, page, word_id, text, x0, x1, top, bottom, size, upright), rules (doc_id, page, x0, x1, top, height),
pages (doc_id, page, width, height).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.text import cleaned, is_clean_number, is_number, repaired
from querent.operators import layout
from querent.operators.borders import bordered_tables
from querent.operators.grids import is_plausible, markdown, ordered
from querent.operators.layout import PAGE, centre, line_bucket
from querent.session import forgotten, stored

REGION = [*PAGE, "region"]
BAND = [*PAGE, "band", "panel"]

# Words that a row of column labels doesn't have.
STOPWORDS = "of the are in is to and a an for on with below each shown by as we our this that from".split()


def rule_regions(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, region, top, bottom, data_top, rules): runs of two wide flat rules or more, less than 200 points apart."""
    own = Window.partitionBy(*PAGE).orderBy("top")
    wide = rules.withColumnRenamed("height", "thickness").join(pages, PAGE).where(((F.col("x1") - F.col("x0")) / F.col("width") >= 0.55) & (F.col("thickness") < 2))
    wide = wide.withColumn("region", F.sum((F.coalesce(F.col("top") - F.lag("top").over(own), F.lit(1e9)) >= 200).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    tops = F.sort_array(F.collect_list("top"))
    return wide.groupBy(*REGION).agg(tops.alias("rules")).where(F.size("rules") >= 2).select(*REGION, (F.col("rules")[0] - 3).alias("top"), (F.element_at("rules", -1) + 3).alias("bottom"), F.col("rules")[1].alias("data_top"), "rules")


def ruled_tables(words: DataFrame, rules: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids (doc_id, page, region, row_no, cells) of tables with horizontal rules only, and their boxes.

    Columns come from the words below the second rule, rows from rules and from lines of words 5 points or more away from a rule or row.
    """
    regions = rule_regions(rules, pages)
    regions = stored(regions, "regions")
    spans = regions.select(*REGION, F.col("top").alias("r_top"), F.col("bottom").alias("r_bottom"), "data_top")
    inside = words.select(*PAGE, "text", "x0", "x1", "top", "bottom").join(spans, PAGE).where((F.col("top") > F.col("r_top")) & (F.col("top") < F.col("r_bottom")))
    inside = stored(inside, "region-words")  # what the words come from is worked out once
    below = inside.where(F.col("top") > F.col("data_top"))
    column_words = below.unionByName(inside.join(below.select(*REGION).distinct(), REGION, "left_anti"))
    columns = layout.column_bounds(column_words, keys=REGION).groupBy(*REGION).agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") >= 3)
    rows = below.groupBy(*REGION).agg(F.sort_array(F.collect_set(line_bucket(F.col("top")))).alias("row_tops"))
    bounds = regions.join(rows, REGION, "left").select(*REGION, "rules", F.coalesce("row_tops", F.array().cast("array<int>")).alias("row_tops"))
    apart = lambda held, y: F.forall(held, lambda h: F.abs(y - h) >= 5)
    merged = F.aggregate("row_tops", F.array_distinct("rules"), lambda held, y: F.when(apart(held, y), F.concat(held, F.array(y.cast("double") - 2))).otherwise(held))
    grid = stored(bounds.select(*REGION, F.sort_array(merged).alias("ys")).join(columns, REGION), "bounds")
    place = lambda bounds, v: F.size(F.filter(bounds, lambda b: b <= v)) - 1
    cells = inside.join(grid, REGION).withColumn("row", place(F.col("ys"), (F.col("top") + F.col("bottom")) / 2)).withColumn("col", place(F.col("xs"), centre("x0", "x1")))
    cells = cells.where((F.col("row") >= 0) & (F.col("row") < F.size("ys") - 1) & (F.col("col") >= 0) & (F.col("col") < F.size("xs") - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_bucket(F.col("top")).alias("l"), "x0", "text"))), lambda w: w.text), " ")
    cells = stored(cells.groupBy(*REGION, "row", "col", F.size("xs").alias("n")).agg(text.alias("cell")), "cells")
    lines = cells.groupBy(*REGION, "row", "n").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"))
    lines = lines.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))))
    lines = lines.withColumn("row_no", F.row_number().over(Window.partitionBy(*REGION).orderBy("row")) - 1)
    good = lines.groupBy(*REGION).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r.cells).alias("rows")).where(is_plausible(F.col("rows"))).select(*REGION)
    boxes = grid.join(good, REGION).select(*PAGE, F.col("xs")[0].alias("bx0"), F.element_at("xs", -1).alias("bx1"), F.col("ys")[0].alias("btop"), F.element_at("ys", -1).alias("bbottom"))
    return lines.join(good, REGION, "left_semi").select(*REGION, "row_no", "cells"), boxes


def unruled_tables(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids (doc_id, page, band, panel, row_no, cells) of aligned numbers without rules, and the consumed words (word_id).

    A band of numbers, cut in two where panels stand side by side, takes as header the short-worded line within 70 points above
    under which most cells are single numbers, half of them at least. Rows of fewer than two numbers go; four must stay.
    """
    own = words.select(*PAGE, "word_id", "text", "x0", "x1", "top", line_bucket(F.col("top")).alias("line"), centre("x0", "x1").alias("x"))
    own = stored(own, "page-words")  # what the words come from is worked out once
    bands = stored(layout.number_bands(own).select(*PAGE, "band", "first", "last"), "number-bands")
    banded = stored(own.join(bands, PAGE).where(F.col("line").between(F.col("first"), F.col("last"))), "banded")
    split = stored(layout.panel_splits(banded.select(*PAGE, "band", "text", "x0", "x1"), keys=[*PAGE, "band"]), "panel-splits")
    panel = F.when(F.col("split").isNull() | (F.col("x") < F.col("split")), F.lit(0)).otherwise(F.lit(1))
    in_band = banded.join(split, [*PAGE, "band"], "left").withColumn("panel", panel)
    tall = F.size(F.collect_set("line").over(Window.partitionBy(*BAND)))
    in_band = stored(in_band.withColumn("tall", tall).where("tall >= 4").drop("tall"), "bands")
    counts = own.groupBy(*PAGE, "line").agg(F.count("*").alias("words"), F.count_if(is_number(F.col("text"))).alias("numbers")).where("numbers < 2 AND words >= 2")
    near = counts.select(*PAGE, "line").join(bands, PAGE).where((F.col("line") > F.col("first") - 70) & (F.col("line") < F.col("first")))
    above = own.join(near, [*PAGE, "line"])
    above = stored(above.join(split, [*PAGE, "band"], "left").withColumn("panel", panel).withColumnRenamed("line", "head"), "above")
    short = above.groupBy(*BAND, "head").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"), F.max(F.lower("text").isin(*STOPWORDS)).alias("prose")).where("n >= 3 AND mean <= 6 AND NOT prose")
    above = stored(above.join(short.select(*BAND, "head"), [*BAND, "head"], "left_semi"), "heads")
    forgotten(own, bands, banded, split)
    key = [*BAND, "head"]
    tried = in_band.join(above.select(*key).distinct(), BAND)
    score = layout.alignment(tried, above, keys=key).groupBy(*BAND).agg(F.max_by(F.struct("head", "score"), F.struct("score", -F.col("head"))).alias("best"))
    chosen = score.where(F.col("best.score") >= 0.5).select(*BAND, F.col("best.head").alias("head"))
    chosen = stored(chosen, "headers")
    headers = above.join(chosen, key, "left_semi")
    body = in_band.join(chosen, BAND)
    cells = layout.rebuilt(body, headers, keys=BAND)
    rows = cells.groupBy(*BAND, "line").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"), F.count_if((F.col("col") > 0) & is_clean_number(F.col("cell"))).alias("clean")).where("clean >= 2")
    rows = stored(rows, "number-rows")
    enough = rows.groupBy(*BAND).count().where("count >= 4").select(*BAND)
    rows = rows.join(enough, BAND, "left_semi")
    labels = headers.join(enough, BAND, "left_semi").groupBy(*BAND).agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda h: h.text).alias("labels"))
    data = rows.join(labels, BAND).withColumn("cells", F.transform(F.sequence(F.lit(0), F.size("labels")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))))
    data = data.select(*BAND, F.row_number().over(Window.partitionBy(*BAND).orderBy("line")).alias("row_no"), "cells", "line")
    head = labels.select(*BAND, F.lit(0).alias("row_no"), F.concat(F.array(F.lit("")), "labels").alias("cells"))
    consumed = body.join(data.select(*BAND, "line"), [*BAND, "line"], "left_semi").select("word_id").unionByName(headers.join(enough, BAND, "left_semi").select("word_id")).distinct()
    return head.unionByName(data.drop("line")), consumed


def captions(words: DataFrame) -> DataFrame:
    """(doc_id, page, caption): the first ``Table n:`` of the page's lines, up to 60 characters on."""
    lines = layout.lines(words).where(F.col("text").rlike(r"Table\s+[0-9]+[:.]"))
    first = lines.groupBy(*PAGE).agg(F.min_by("text", "line").alias("text"))
    return first.select(*PAGE, F.trim(F.regexp_extract("text", r"(Table\s+[0-9]+[:.][^\n]{0,60})", 1)).alias("caption"))


def body_text(words: DataFrame, width: float | None) -> DataFrame:
    """(doc_id, page, body): lines left column first, large short ones as headings, on one line of clean text.

    Without one ``width`` of all pages, words have their page's.
    """
    split = layout.gutters(words, width) if width is not None else layout.gutters(words, F.col("width"), [*PAGE, "width"]).drop("width")
    side = words.join(split, PAGE, "left").withColumn("side", F.when(F.col("split").isNull() | (centre("x0", "x1") < F.col("split")), F.lit(0)).otherwise(F.lit(1)))
    lines = layout.lines(side, keys=[*PAGE, "side"])
    median = words.groupBy(*PAGE).agg(F.median("size").alias("mid"))
    near = words.select(*PAGE, "size", F.explode(F.transform(F.array(F.lit(-3), F.lit(0), F.lit(3)), lambda d: line_bucket(F.col("top")) + d)).alias("line"))
    sizes = near.groupBy(*PAGE, "line").agg(F.avg("size").alias("mean"))
    lines = lines.join(sizes, [*PAGE, "line"], "left").join(median, PAGE)
    large = (F.col("mean") >= F.col("mid") * 1.3) & (F.length("text") > 0) & (F.length("text") < 80)
    lines = lines.withColumn("text", F.when(large, F.concat(F.lit("## "), "text")).otherwise(F.col("text"))).withColumn("at", F.struct("side", "line"))
    return lines.groupBy(*PAGE).agg(cleaned(ordered(F.col("text"), "at", "\n")).alias("body"))


def drawn_tables(words: DataFrame, rules: DataFrame, pages: DataFrame, bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Grids and boxes of tables with borders, and on pages without one those of tables with level rules only.

    Sides of rectangles (``edge`` of rules, where they say so) are borders but no rules of their own.
    """
    alone = rules.where("NOT edge").drop("edge") if "edge" in rules.columns else rules
    if bars is None:
        return ruled_tables(words, alone, pages)
    grid, boxes = (stored(x, "bordered") for x in bordered_tables(words, rules, bars))
    rest = pages.join(boxes.select(*PAGE).distinct().hint("merge"), PAGE, "left_anti")  # as in ``layout.outside``
    ruled, ruled_boxes = ruled_tables(words, alone, rest)
    number = F.col("region").cast("long").alias("region")
    return tuple(a.unionByName(b) for a, b in ((grid.select(*PAGE, number, "row_no", "cells"), ruled.select(*PAGE, number, "row_no", "cells")), (boxes, ruled_boxes)))


def page_texts(words: DataFrame, rules: DataFrame, pages: DataFrame, width: float | None = None, bars: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, text): the page's tables as Markdown, then its body; rotated words, footnotes and table words left out of the body.

    ``bars`` (doc_id, page, x, top, bottom) are the upright lines of borders. ``width`` stands for the widths of ``pages`` where it is given.
    """
    upright = words.where("upright")
    ruled, boxes = drawn_tables(words, rules, pages, bars)
    ruled, boxes = stored(ruled, "ruled"), stored(boxes, "boxes")
    body = layout.outside(upright.join(layout.footnote_tops(pages, rules), PAGE).where("top < footnote_top"), boxes)
    body = stored(body, "body-words")
    unruled, consumed = unruled_tables(body)
    body = body.join(consumed, "word_id", "left_anti")
    body = body_text(stored(body if width is not None else body.drop("width").join(pages.select(*PAGE, "width"), PAGE), "body"), width)

    def rendered(grid: DataFrame, keys: list[str], kind: int) -> DataFrame:
        rows = grid.withColumn("grid_id", F.struct(*keys))
        return markdown(rows).select("grid_id.doc_id", "grid_id.page", F.struct(F.lit(kind).alias("kind"), F.to_json("grid_id").alias("n")).alias("at"), F.col("markdown").alias("part"))

    parts = rendered(ruled, REGION, 0).unionByName(rendered(unruled, BAND, 1))
    parts = parts.unionByName(body.where("body != ''").select(*PAGE, F.struct(F.lit(2).alias("kind"), F.lit("").alias("n")).alias("at"), F.col("body").alias("part")))
    return parts.groupBy(*PAGE).agg(repaired(ordered(F.col("part"), "at", "\n\n")).alias("text"))
