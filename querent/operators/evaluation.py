"""Ranking metrics, answer accuracy, latencies and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut-offs of the discounted gain, and depth of the recall.
CUTS, DEPTH = (1, 3, 5, 10), 100


def judged(run: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run (qid, id, score) and judgements (qid, id, rel) as hits (qid, id, score, rel) and grades (qid, rel, n)."""
    hits = run.join(qrels, ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return hits.join(qrels.select("qid").distinct(), "qid", "left_semi"), qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))


def ordered(hits: DataFrame) -> DataFrame:
    """Hits with ``place``: by falling score, ties by falling id as text, as the common scorer has it."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.col("id").cast("string")))
    return hits.withColumn("place", F.row_number().over(order))


def gain(rel: Column, place: Column) -> Column:
    return rel / F.log2(place + 1)


def ideal(grades: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """The best discounted gains of each query at each cut, from the counts of its grades."""
    top = max(cuts)
    rows = grades.where("rel > 0").select("qid", "rel", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(top)).cast("int"))).alias("copy"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "copy")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return rows.groupBy("qid").agg(*(F.sum(F.when(F.col("place") <= k, gain(F.col("rel"), F.col("place")))).alias(f"ideal_{k}") for k in cuts))


def ir_metrics(hits: DataFrame, grades: DataFrame, cuts: tuple[int, ...] = CUTS, depth: int = DEPTH) -> DataFrame:
    """(qid, ndcg_k..., recall, rr, ap) of every query that has judgements and hits."""
    own = ordered(hits)
    right = (F.col("rel") > 0).cast("int")
    seen = F.sum(right).over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("precision", F.when(F.col("rel") > 0, seen / F.col("place")))
    sums = own.groupBy("qid").agg(
        *(F.coalesce(F.sum(F.when(F.col("place") <= k, gain(F.col("rel"), F.col("place")))), F.lit(0.0)).alias(f"gain_{k}") for k in cuts),
        F.sum(F.when(F.col("place") <= depth, right)).alias("found"),
        F.min(F.when(F.col("rel") > 0, F.col("place"))).alias("first"),
        F.coalesce(F.sum("precision"), F.lit(0.0)).alias("precisions"),
    )
    wanted = grades.where("rel > 0").groupBy("qid").agg(F.sum("n").alias("wanted"))
    rows = sums.join(wanted, "qid", "left").join(ideal(grades, cuts), "qid", "left")
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return rows.select("qid", *(part(F.col(f"gain_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in cuts), part(F.col("found"), F.col("wanted")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), part(F.col("precisions"), F.col("wanted")).alias("ap"))


def macro(metrics: DataFrame) -> DataFrame:
    """The mean of every metric over the queries."""
    return metrics.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in metrics.columns if c != "qid"))


def accuracy(answers: DataFrame, *by: str, right: str = "right", judge: str = "judge") -> DataFrame:
    """Counts, accuracy by keywords and by judge, and disagreements, rolled up by the columns; 0 where there is nothing."""
    both = F.col(right) != F.col(judge)
    rows = answers.rollup(*by) if by else answers.groupBy()
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col(right).cast("int")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.col(judge).cast("int")), F.lit(0.0)).alias("judge_accuracy"), F.count_if(both).alias("disagreements"))


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median and 95th percentile with linear interpolation, mean and count."""
    return rows.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg(value).alias("mean"), F.count(value).alias("n"))


#: Size of a sketch: ranks are wrong by less than a hundredth with a chance of 99 in 100.
SKETCH = 400


def sketched(rows: DataFrame, by: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """(by..., sketch, n): a quantile sketch of a group's values, of bounded size, to be stored and merged; null values aren't counted."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count(value).alias("n"))


def sketches_merged(sketches: DataFrame, by: list[str], size: int = SKETCH) -> DataFrame:
    """(by..., sketch, n): the sketches of groups put together."""
    return sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"))


def sketch_percentiles(sketches: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """``sketches`` with a column p<share> for each share in place of the sketch."""
    named = {f"p{round(q * 100):02d}": F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in shares}
    return sketches.withColumns(named).drop("sketch")


def latest(runs: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The newest run of each configuration."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return runs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def unpivoted(runs: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric and run."""
    return runs.unpivot(ids, metrics, "metric", "value")
