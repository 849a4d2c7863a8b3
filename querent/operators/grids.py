"""Tables in texts: Markdown, and one sentence per row and per column.

Grids are rows (grid_id, caption, row_no, cells), row 0 the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.text import expanded, fact_pair, is_clean_number, is_heading, is_number, stripped


def ordered(what: Column, by: str, separator: str) -> Column:
    """The strings of a group joined in the order of ``by``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), what.alias("v")))), lambda x: x.v), separator)


def plain_cell(cell: Column) -> Column:
    return stripped(F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" ")))


def markdown(grids: DataFrame) -> DataFrame:
    """(grid_id, markdown) with a ruler below the header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    own = line(F.transform("cells", plain_cell))
    ruler = line(F.transform("cells", lambda c: F.lit("---")))
    text = F.when(F.col("row_no") == 0, F.concat(own, F.lit("\n"), ruler)).otherwise(own)
    return grids.groupBy("grid_id").agg(ordered(text, "row_no", "\n").alias("markdown"))


def is_plausible(rows: Column) -> Column:
    """Whether an array of rows looks like a table: three rows and columns, and short cells on average."""
    cells = F.filter(F.flatten(rows), lambda c: c.isNotNull() & (c != ""))
    total = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c))
    return (F.size(rows) >= 3) & (F.size(rows[0]) >= 3) & (F.size(cells) > 0) & (F.try_divide(total, F.size(cells)) < 80)


def cells_of(grids: DataFrame) -> DataFrame:
    """(grid_id, caption, row_no, col, cell, header, name_col, label) of the data rows.

    The name column has most distinct cells that aren't numbers, the first on ties; a row's label is its first cell and its name.
    """
    clean = F.transform("cells", lambda c: stripped(F.coalesce(c, F.lit(""))))
    rows = grids.select("grid_id", F.struct("row_no", "caption", clean.alias("cells")).alias("r"))
    own = rows.groupBy("grid_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # a grid is part of one text
    own = own.select("grid_id", F.filter("rows", lambda r: r.row_no == 0)[0]["cells"].alias("headers"), F.filter("rows", lambda r: r.row_no > 0).alias("rows")).where("headers IS NOT NULL AND size(headers) > 0")
    names = F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda k: F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: F.coalesce(F.get(r.cells, k), F.lit(""))), lambda c: (c != "") & ~is_number(c)))))
    own = own.withColumn("names", names).withColumn("name_col", (F.array_position("names", F.array_max("names")) - 1).cast("int"))
    own = own.select("grid_id", "headers", "name_col", F.explode("rows").alias("r"))
    part = lambda at: F.coalesce(F.get("r.cells", at), F.lit(""))
    label = F.array_join(F.array_distinct(F.filter(F.array(part(F.lit(0)), part(F.col("name_col"))), lambda x: x != "")), " ")
    own = own.select("grid_id", "r.caption", "r.row_no", F.posexplode("r.cells").alias("col", "cell"), "headers", "name_col", label.alias("label"))
    return own.where(F.col("col") < F.size("headers")).withColumn("header", F.get("headers", F.col("col"))).drop("headers")


def with_caption(caption: Column, text: Column) -> Column:
    return F.concat(F.when(F.coalesce(caption, F.lit("")) == "", F.lit("")).otherwise(F.concat(caption, F.lit(" "))), text, F.lit("."))


def row_facts(grids: DataFrame) -> DataFrame:
    """(grid_id, row_no, fact): ``caption label: column value, ...``."""
    rows = cells_of(grids).where((F.col("col") > 0) & (F.col("col") != F.col("name_col")) & (F.col("cell") != "") & (F.col("header") != "") & (F.col("label") != ""))
    facts = rows.groupBy("grid_id", "row_no", "label", "caption").agg(ordered(fact_pair(F.col("header"), F.col("cell")), "col", ", ").alias("pairs"))
    return facts.select("grid_id", "row_no", with_caption(F.col("caption"), F.concat("label", F.lit(": "), "pairs")).alias("fact"))


def column_facts(grids: DataFrame) -> DataFrame:
    """(grid_id, col, fact): ``caption column: label value, ...`` of columns with two bare numbers or more."""
    rows = cells_of(grids).where((F.col("col") > 0) & (F.col("col") != F.col("name_col")) & (F.col("header") != "") & (F.col("label") != "") & is_clean_number(F.col("cell")))
    facts = rows.groupBy("grid_id", "col", "header", "caption").agg(F.count("*").alias("n"), ordered(F.concat("label", F.lit(" "), "cell"), "row_no", ", ").alias("pairs")).where("n >= 2")
    return facts.select("grid_id", "col", with_caption(F.col("caption"), F.concat(expanded(F.col("header")), F.lit(": "), "pairs")).alias("fact"))


def markdown_grids(lines: DataFrame) -> DataFrame:
    """Grids of the Markdown tables among ``lines`` (doc_id, line_no, line): grid_id is ``doc_id:n``, the caption the last heading.

    Rows of nothing but rulers go, and so do tables of fewer than three rows.
    """
    own = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("is_table", F.ltrim("line").startswith("|"))
    head = F.when(~F.col("is_table") & is_heading(F.col("line")), stripped(F.regexp_replace("line", r"^[# ]+", "")))
    rows = rows.withColumn("caption", F.coalesce(F.last(head, True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    new = (F.col("is_table") & ~F.coalesce(F.lag("is_table").over(own), F.lit(False))).cast("int")
    rows = rows.withColumn("n", F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("is_table")
    inner = F.regexp_replace(stripped(F.col("line")), r"^\|+|\|+$", "")
    rows = rows.withColumn("cells", F.transform(F.split(inner, r"\|"), stripped)).where(F.exists("cells", lambda c: ~c.rlike(r"^[-: ]*$")))
    block = Window.partitionBy("doc_id", "n")
    rows = rows.withColumn("row_no", F.row_number().over(block.orderBy("line_no")) - 1).withColumn("size", F.count("*").over(block)).where("size >= 3")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("grid_id"), "caption", "row_no", "cells")
