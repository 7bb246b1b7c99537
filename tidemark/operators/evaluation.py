"""Full reports of estimated times against reference times, and the scores that weigh them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.num import clip01, finite
from tidemark.operators.joins import asof_nearest
from tidemark.operators.sequences import one_to_one

HITS, MATCHED, KEPT = (5, 10, 20, 70), (20, 70), (10, 20, 70)
#: An error in scores at which precision, or the tail, is worth a half.
HALF, TAIL_HALF = 12.0, 45.0


def evaluate_grids(reference: DataFrame, estimate: DataFrame, by: str, t: str, unit: float, *, hits: tuple[int, ...] = HITS, matched: tuple[int, ...] = MATCHED, kept: tuple[int, ...] = KEPT) -> DataFrame:
    """A report for each group that has a reference or an estimate: by, reference_count, estimated_count, matched_count, signed and absolute errors to the nearest
    estimate (median, mean, p90, p95, max), hit rates, precision, recall and F1 of one-to-one matches, false positives and misses at the widest of
    `matched`, and continuity: the longest run of references that are hit, as a share.

    reference, estimate: by, t; `unit` of t is 1 in the report and in the tolerances. Negative times don't count. Errors are infinite without an estimate, and 0 without a reference.
    """
    ref = reference.where(F.col(t) >= 0).select(by, t).withColumn("_key", F.monotonically_increasing_id())
    est = estimate.where(F.col(t) >= 0).select(by, t)
    counts = ref.groupBy(by).agg(F.count("*").alias("reference_count")).join(est.groupBy(by).agg(F.count("*").alias("estimated_count")), by, "full").na.fill(0, ["reference_count", "estimated_count"])
    errors = asof_nearest(ref, est, by, t, "_key").select(by, t, "_key", (F.col("error") / unit).alias("e")).withColumn("a", F.coalesce(F.abs("e"), F.lit(float("inf"))))
    order = W.partitionBy(by).orderBy(t, "_key")
    numbered = errors.withColumn("_i", F.row_number().over(order))
    runs = None
    for k in kept:
        own = numbered.where(F.col("a") <= k).withColumn("_g", F.col("_i") - F.row_number().over(W.partitionBy(by).orderBy("_i")))
        longest = own.groupBy(by, "_g").agg(F.count("*").alias("c")).groupBy(by).agg(F.max("c").alias(f"_run{k}"))
        runs = longest if runs is None else runs.join(longest, by, "full")
    seen = F.when(F.col("e").isNotNull(), F.col("a"))
    pct = lambda p: F.percentile(seen, F.lit(p))
    told = errors.groupBy(by).agg(
        F.percentile("e", F.lit(0.5)).alias("median_error"),
        F.avg("e").alias("mean_error"),
        pct(0.5).alias("median_abs_error"),
        F.avg(seen).alias("mean_abs_error"),
        pct(0.90).alias("p90_abs_error"),
        pct(0.95).alias("p95_abs_error"),
        F.max(seen).alias("max_abs_error"),
        *(F.avg((F.col("a") <= h).cast("double")).alias(f"hit_rate_{h}") for h in hits),
    )
    out = counts.join(told, by, "left").join(runs, by, "left")
    for m in matched:
        met = one_to_one(ref.select(by, t), est, by, t, m * unit).groupBy(by).agg(F.count("*").alias(f"_met{m}"))
        out = out.join(met, by, "left").na.fill(0, [f"_met{m}"])
    none = F.when(F.col("reference_count") > 0, float("inf")).otherwise(0.0)
    error = [F.coalesce(c, none).alias(c) for c in ("median_error", "mean_error", "median_abs_error", "mean_abs_error", "p90_abs_error", "p95_abs_error", "max_abs_error")]
    share = lambda m, of: F.col(f"_met{m}") / F.greatest(F.col(of), F.lit(1))
    f1 = lambda m: F.coalesce(F.try_divide(2 * share(m, "estimated_count") * share(m, "reference_count"), share(m, "estimated_count") + share(m, "reference_count")), F.lit(0.0))
    rates = [x for m in matched for x in (share(m, "estimated_count").alias(f"precision_{m}"), share(m, "reference_count").alias(f"recall_{m}"), f1(m).alias(f"f1_{m}"))]
    top = F.col(f"_met{max(matched)}")
    return out.select(
        by,
        "reference_count",
        "estimated_count",
        top.alias("matched_count"),
        *error,
        *(F.coalesce(f"hit_rate_{h}", F.lit(0.0)).alias(f"hit_rate_{h}") for h in hits),
        *rates,
        (F.col("estimated_count") - top).alias("false_positive_count"),
        (F.col("reference_count") - top).alias("missed_count"),
        *((F.coalesce(f"_run{k}", F.lit(0)) / F.greatest("reference_count", F.lit(1))).alias(f"continuity_{k}") for k in kept),
    )


def _worth(x: Column, half: float) -> Column:
    """1 at no error, a half at `half`, towards 0 beyond; 0 where the error isn't finite."""
    return F.when(finite(x).isNotNull(), 1 / (1 + F.greatest(x, F.lit(0.0)) / half)).otherwise(0.0)


def strict_score(hit: str = "hit_rate_10", f1: str = "f1_20", wide: str = "f1_70", continuity: str = "continuity_20", half: float = HALF) -> Column:
    """Score of a report that asks for precision first."""
    return clip01(0.24 * _worth(F.col("median_abs_error"), half) + 0.24 * F.col(hit) + 0.30 * F.col(f1) + 0.12 * F.col(continuity) + 0.10 * F.col(wide))


def report_score(hit: str = "hit_rate_20", f1: str = "f1_20", wide: str = "70", continuity: str = "continuity_20", half: float = HALF, tail: float = TAIL_HALF) -> Column:
    """Score of a report less a penalty for estimates without a reference and references without an estimate; null if an error isn't finite."""
    penalty = F.least(F.lit(0.22), 0.12 * F.col("false_positive_count") / F.greatest("estimated_count", F.lit(1)) + 0.14 * F.col("missed_count") / F.greatest("reference_count", F.lit(1)))
    good = 0.24 * _worth(F.col("median_abs_error"), half) + 0.18 * F.col(hit) + 0.20 * F.col(f1) + 0.12 * F.col(f"f1_{wide}") + 0.08 * F.col(f"precision_{wide}") + 0.08 * F.col(f"recall_{wide}") + 0.06 * F.col(continuity) + 0.04 * _worth(F.col("p95_abs_error"), tail)
    return F.when(finite(F.col("median_abs_error")).isNotNull() & finite(F.col("p95_abs_error")).isNotNull(), clip01(good - penalty))
