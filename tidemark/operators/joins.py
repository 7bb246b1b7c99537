"""Joins by nearness, tolerance, interval and key cascade, all as equi-joins or windows, never as cross products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Rank within a group, from 1; the order must end in a unique column."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, t: str, key: str) -> DataFrame:
    """Each left row with the nearest right time of its group, either side; the earlier one on a tie.

    One union and one window per direction: a single shuffle by the group, no pairs. The result has left's columns, near_t and error (near_t - t).
    """
    both = left.withColumn("_right", F.lit(None).cast("long")).unionByName(right.select(by, t).distinct().withColumn("_right", F.col(t)), allowMissingColumns=True)
    # left rows see the right rows at their own time on both sides
    before = W.partitionBy(by).orderBy(t).rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(by).orderBy(t).rangeBetween(0, W.unboundedFollowing)
    seen = both.withColumn("_a", F.max("_right").over(before)).withColumn("_b", F.min("_right").over(after)).where(F.col(key).isNotNull() & F.col("_right").isNull())
    early = F.col("_b").isNull() | (F.col(t) - F.col("_a") <= F.col("_b") - F.col(t))
    near = F.when(F.col("_a").isNotNull() & early, F.col("_a")).otherwise(F.col("_b"))
    return seen.withColumn("near_t", near).withColumn("error", F.col("near_t") - F.col(t)).drop("_right", "_a", "_b")


def within(left: DataFrame, right: DataFrame, by: str, t: str, other: str, radius: int) -> DataFrame:
    """Pairs of a group at most `radius` apart: times are cut into bins of that width and a row meets its own and both neighbouring bins."""
    bins = left.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(t) / radius) + d for d in (-1, 0, 1)))))
    return bins.join(right.withColumn("_bin", F.floor(F.col(other) / radius)), [by, "_bin"]).where(F.abs(F.col(t) - F.col(other)) <= radius).drop("_bin")


def in_intervals(points: DataFrame, spans: DataFrame, by: str, t: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """Points of a group in [start, end) (or [start, end]): a span is put in every bin of `width` that it touches."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    put = spans.withColumn("_bin", F.explode(bins))
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    return points.withColumn("_bin", F.floor(F.col(t) / width)).join(put, [by, "_bin"]).where(inside).drop("_bin")


def cascade(rows: DataFrame, catalogue: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The first key, in order, under which the catalogue holds exactly one value; tier says which (null: none)."""
    out = rows
    for i, key in enumerate(keys):
        one = catalogue.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_v{i}"), F.countDistinct(value).alias("_n")).where("_n = 1").drop("_n")
        out = out.join(one, key, "left")
    tier = F.coalesce(*(F.when(F.col(f"_v{i}").isNotNull(), i + 1) for i in range(len(keys))))
    return out.withColumn("tier", tier.cast("long")).withColumn("found", F.coalesce(*(F.col(f"_v{i}") for i in range(len(keys))))).drop(*(f"_v{i}" for i in range(len(keys))))


def fan_out(rows: DataFrame, by: str, t: str, key: str, size: str, low: int, high: int, most: int) -> DataFrame:
    """Each row as an anchor with its strongest `most` later rows of the group, low to high after it."""
    later = rows.select(by, F.col(t).alias("t2"), F.col(key).alias("key2"), F.col(size).alias("size2"))
    pairs = within(rows, later, by, t, "t2", high).where((F.col("t2") - F.col(t)).between(low, high))
    return ranked(pairs, [key], F.desc("size2"), F.col("t2"), F.col("key2")).where(F.col("rank") <= most)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only and keys that repeat on the right: side, key, n."""
    l, r = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    both = l.join(r, key, "full")
    side = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("r") > 1, "repeated")
    return both.select(side.alias("side"), key, F.coalesce("r", "l").alias("n")).where("side is not null")


def marker_lookup(rows: DataFrame, markers: DataFrame, order: str, value: str, bpm: str, tolerance: float = 0.5) -> DataFrame:
    """rows with tier and found: the last marker of the row's path, else of its exact key, else of its slug; null without one.

    rows, markers: path, exact, slug (null or empty: none) and `bpm`; markers also `order` (the load order, unique) and `value`. Of a slug's markers each
    exact key has its last one. Those within `tolerance` of the row's bpm go before the others, and the last of them counts if all agree to three
    decimals, so a slug with several values finds nothing. Slugs are settled once for each bpm that rows have, not once for each row.
    """

    def last(key: str, *keys: str) -> DataFrame:
        return markers.where(F.col(key) != "").groupBy(key, *keys).agg(F.max_by(F.struct(value, bpm, order), order).alias("m"))

    bucket = last("slug", "exact").select("slug", F.col(f"m.{value}").alias("v"), F.col(f"m.{bpm}").alias("b"), F.col(f"m.{order}").alias("o"))
    asked = rows.where(F.col("slug") != "").select("slug", F.col(bpm).alias("asked")).distinct()
    near = F.coalesce(F.abs(F.col("b") - F.col("asked")) <= tolerance, F.lit(False))
    met = asked.join(bucket, "slug").groupBy("slug", "asked", near.alias("near")).agg(F.countDistinct(F.round("v", 3)).alias("values"), F.max_by("v", "o").alias("v"))
    settled = met.groupBy("slug", "asked").agg(F.max_by(F.struct("values", "v"), "near").alias("s")).where("s.values = 1").select("slug", "asked", F.col("s.v").alias("_v2"))
    out = rows
    for i, key in enumerate(("path", "exact")):
        out = out.join(last(key).select(key, F.col(f"m.{value}").alias(f"_v{i}")), key, "left")
    slugs = settled.withColumnRenamed("slug", "_slug")
    out = out.join(slugs, (F.col("slug") == F.col("_slug")) & F.col(bpm).eqNullSafe(F.col("asked")), "left").drop("_slug", "asked")
    tier = F.coalesce(*(F.when(F.col(f"_v{i}").isNotNull(), i + 1) for i in range(3)))
    return out.withColumn("tier", tier.cast("long")).withColumn("found", F.coalesce("_v0", "_v1", "_v2")).drop("_v0", "_v1", "_v2")
