"""Window operators over time-ordered rows of a group: smoothing, contrasts, runs, peaks, normalisation, sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.num import between, norm


def ordered(by: list[str], *order: str) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*order)


def positive_delta(x: Column | str, w: WindowSpec, k: int) -> Column:
    """Rise over the mean of the previous k rows; the first row's baseline is itself."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(x - F.coalesce(F.avg(x).over(w.rowsBetween(-k, -1)), x), F.lit(0.0))


def flux(x: Column | str, w: WindowSpec) -> Column:
    """Half-wave rectified first difference; 0 in the first row."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(x - F.coalesce(F.lag(x).over(w), x), F.lit(0.0))


def mean_around(x: Column | str, w: WindowSpec, radius: int, pad: bool = False) -> Column:
    """Centred mean; at the edges over what there is, or over the full width with zeros (pad)."""
    frame = w.rowsBetween(-radius, radius)
    return F.sum(x).over(frame) / (2 * radius + 1) if pad else F.avg(x).over(frame)


def before_after(x: Column | str, w: WindowSpec, k: int) -> tuple[Column, Column]:
    """Mean of the k rows before (without the row) and of the k rows from it on; 0 where there are none."""
    return F.coalesce(F.avg(x).over(w.rowsBetween(-k, -1)), F.lit(0.0)), F.coalesce(F.avg(x).over(w.rowsBetween(0, k - 1)), F.lit(0.0))


def slope(x: Column | str, i: Column | str, frame: WindowSpec) -> Column:
    """Least-squares slope of x over i in the frame; 0 for a single row."""
    return F.coalesce(F.regr_slope(F.col(x) if isinstance(x, str) else x, F.col(i) if isinstance(i, str) else i).over(frame), F.lit(0.0))


def percentile_normalised(x: str, part: WindowSpec, low: float, high: float) -> Column:
    """Position between two percentiles of the group, clipped to 0 and 1."""
    return norm(F.col(x), F.percentile(x, F.lit(low)).over(part), F.percentile(x, F.lit(high)).over(part))


def quantile_ends(x: Column | str, place: Column | str, n: Column | str, p: float) -> tuple[Column, Column, Column]:
    """What to aggregate for a group's interpolated quantile: the values at the places (from 0, of `n`) around it, and its share of the way between them."""
    x, place, at = (F.col(c) if isinstance(c, str) else c for c in (x, place, ((F.col(n) if isinstance(n, str) else n) - 1) * F.lit(float(p))))
    end = lambda k: F.max(F.when(place == k, x))
    return end(F.floor(at)), end(F.ceil(at)), at - F.floor(at)


def quantiles(rows: DataFrame, by: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """by, n, and the interpolated quantiles by name of the group's values (no nulls), by their places in a sorted window and rounded once.

    So they compare with the values themselves as they do in SQL engines that fuse the interpolation.
    """
    placed = rows.select(*by, x, (F.row_number().over(ordered(by, x)) - 1).alias("_k"), F.count(F.lit(1)).over(W.partitionBy(*by)).alias("_n"))
    ends = {name: quantile_ends(x, "_k", "_n", p) for name, p in ps.items()}
    found = placed.groupBy(*by, "_n").agg(*(c.alias(f"_{side}_{name}") for name, e in ends.items() for side, c in zip(("low", "high"), e, strict=False)))
    return found.select(*by, F.col("_n").alias("n"), *(between(F.col(f"_low_{name}"), F.col(f"_high_{name}"), share).alias(name) for name, (_, _, share) in ends.items()))


def listed_quantile(rows: DataFrame, xs: str, n: int, p: float, name: str) -> DataFrame:
    """The rows with the interpolated quantile of a list of n values, rounded once."""
    at = (n - 1) * float(p)
    held = rows.withColumn("_x", F.sort_array(xs)).withColumns({"_low": F.get("_x", F.lit(math.floor(at))), "_high": F.get("_x", F.lit(math.ceil(at)))})
    return held.withColumn(name, between(F.col("_low"), F.col("_high"), F.lit(at - math.floor(at)))).drop("_x", "_low", "_high")


def runs(rows: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of rows with the flag: group, first place, place after the last, length (places from 0)."""
    w = ordered(by, *order)
    placed = rows.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    kept = placed.where(F.col(flag)).withColumn("_g", F.col("_i") - F.row_number().over(W.partitionBy(*by).orderBy("_i")))
    return kept.groupBy(*by, "_g", "_n").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"), F.count("*").alias("length")).drop("_g").withColumnRenamed("_n", "n")


def peaks(rows: DataFrame, by: list[str], order: list[str], x: str, floor: Column) -> DataFrame:
    """Rows above the floor, greater than the row before and at least the next."""
    w = ordered(by, *order)
    marked = rows.withColumn("_a", F.lag(x).over(w)).withColumn("_b", F.lead(x).over(w)).withColumn("_f", floor)
    return marked.where((F.col(x) > F.col("_a")) & (F.col(x) >= F.col("_b")) & (F.col(x) >= F.col("_f"))).drop("_a", "_b", "_f")


def sessions(rows: DataFrame, by: list[str], t: str, key: str, gap: int) -> DataFrame:
    """Number of the session of each row: a new one begins after more than `gap` without rows."""
    w = ordered(by, t, key)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def top_margin(rows: DataFrame, by: list[str], x: str, key: str) -> DataFrame:
    """Best row of each group and its lead over the second (over 0 without one)."""
    w = W.partitionBy(*by).orderBy(F.desc(x), key)
    two = rows.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(x, 1, 0.0).over(w)).where("_k = 1")
    return two.select(*by, key, F.col(x), (F.col(x) - F.col("_next")).alias("margin"))
