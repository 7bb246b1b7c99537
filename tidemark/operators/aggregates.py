"""Aggregates with the semantics of the reference: three kinds of median, nearest-rank percentiles, consensus, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranking import places


def pct(x: Column | str, q: float) -> Column:
    """Percentile with linear interpolation."""
    return F.percentile(x, F.lit(q))


def share_within(x: Column, most: float) -> Column:
    """Percent of rows at most `most`."""
    return 100.0 * F.avg((x <= most).cast("double"))


def nearest_rank(rows: DataFrame, by: list[str], x: str, q: float, name: str) -> DataFrame:
    """Element at index int(q * n) of each group's sorted values, at most the last; by a window, so no group is gathered in an array."""
    order = W.partitionBy(*by).orderBy(x)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    at = F.least((n * q).cast("long"), n - 1)
    return rows.withColumn("_k", F.row_number().over(order) - 1).withColumn("_at", at).where("_k = _at").select(*by, F.col(x).alias(name))


def weighted_median(rows: DataFrame, by: list[str], x: str, weight: str, *ties: str, name: str = "median") -> DataFrame:
    """Lower weighted median: the first value, in order, at which half the weight is reached."""
    order = W.partitionBy(*by).orderBy(x, *ties).rowsBetween(W.unboundedPreceding, 0)
    half = F.sum(weight).over(W.partitionBy(*by)) / 2
    return rows.withColumn("_c", F.sum(weight).over(order)).withColumn("_half", half).where("_c >= _half").groupBy(*by).agg(F.min(x).alias(name))


def robust_centre(rows: DataFrame, by: list[str], x: str, name: str = "centre") -> DataFrame:
    """Median; with four values or more, of those within 1.5 interquartile ranges of the quartiles."""
    part = W.partitionBy(*by)
    q = lambda p: F.percentile(x, F.lit(p)).over(part)
    marked = rows.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_a", q(0.25)).withColumn("_b", q(0.75))
    reach = 1.5 * (F.col("_b") - F.col("_a"))
    kept = marked.where((F.col("_n") < 4) | F.col(x).between(F.col("_a") - reach, F.col("_b") + reach))
    return kept.groupBy(*by).agg(F.percentile(x, F.lit(0.5)).alias(name), F.count("*").alias("n_used"), F.max("_n").alias("n"))


def sweep(rows: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold, in one pass over the rows.

    A row counts for the largest threshold that it reaches; counts are then summed from the top.
    """
    level = F.lit(None).cast("int")
    for i, t in enumerate(sorted(thresholds)):
        level = F.when(F.col(score) >= t, i).otherwise(level)
    counts = rows.groupBy(F.coalesce(level, F.lit(-1)).alias("level")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((1 - F.col(positive)).cast("long")).alias("n"))
    at = rows.sparkSession.createDataFrame([(i, 0, 0, float(t)) for i, t in enumerate(sorted(thresholds))], "level int, p long, n long, threshold double")
    # one row per level: as many as there are thresholds, and one for what reaches none
    levels = counts.withColumn("threshold", F.lit(None).cast("double")).unionByName(at).groupBy("level").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("threshold").alias("threshold"))
    one = W.partitionBy(F.lit(0))
    above = one.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    got = levels.select("threshold", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(one).alias("all_p")).where("threshold is not null")
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return got.select("threshold", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def equal_bins(rows: DataFrame, by: list[str], order: list[str], x: str, bins: int) -> DataFrame:
    """Groups' rows in order, cut at floor(k * n / bins): least, most and root mean square of each bin."""
    k, n = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1, F.count(F.lit(1)).over(W.partitionBy(*by))
    # the bin b with floor(b n / bins) <= k < floor((b + 1) n / bins)
    put = rows.withColumn("_k", k).withColumn("_n", n).withColumn("bin", F.ceil((F.col("_k") + 1) * bins / F.col("_n")) - 1)
    return put.groupBy(*by, "bin").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"))


def weighted_jaccard(bags: DataFrame, owner: str, item: str, count: str, pairs: DataFrame) -> DataFrame:
    """Sum of minima over sum of maxima of the bags of stated pairs (a, b)."""
    a = pairs.join(bags.select(F.col(owner).alias("a"), F.col(item), F.col(count).alias("x")), "a")
    b = bags.select(F.col(owner).alias("b"), F.col(item), F.col(count).alias("y"))
    least = a.join(b, ["b", item]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("least"))
    size = bags.groupBy(owner).agg(F.sum(count).alias("size"))
    sizes = pairs.join(size.select(F.col(owner).alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col(owner).alias("b"), F.col("size").alias("sb")), "b")
    least_or_0 = F.coalesce("least", F.lit(0))
    return sizes.join(least, ["a", "b"], "left").select("a", "b", (least_or_0 / (F.col("sa") + F.col("sb") - least_or_0)).alias("jaccard"))


def circular_mean(x: Column, period: float) -> Column:
    """Mean phase of x on a circle, in [0, period)."""
    turn = 2 * 3.141592653589793 / period
    phase = F.atan2(F.avg(F.sin(x * turn)), F.avg(F.cos(x * turn))) / turn
    return F.when(phase < 0, phase + period).otherwise(phase)


def first_most_common(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Counts of a key with its place: count descending, then first seen."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return places(counted, [F.desc("n"), F.col("_first")]).drop("_first")
