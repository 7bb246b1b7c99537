"""Curves sampled at many times: means over spans around points, estimates of beats scored against curves, series resampled on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.num import clip01
from tidemark.operators.joins import within
from tidemark.operators.windows import percentile_normalised, quantiles

#: Widest tolerance, in seconds, around a beat.
WIDEST = 0.085


def span_means(frames: DataFrame, points: DataFrame, by: str, t: str, xs: list[str], spans: dict[str, tuple[float | Column, float | Column]], block: float, closed: bool = False) -> DataFrame:
    """points with {span}_{x}: the mean of x over the frames of the group in [t + start, t + end) of each span (`closed`: end included); null where there are none.

    spans: offsets by name, numbers or columns of points; rows of points with the same group and time must have the same ones. A mean is a difference of
    running sums at the span's ends. The ends and the frames are one union; sums run within blocks of time, and the blocks' own sums, one row for each,
    are cumulated beside them, so neither points and frames are paired nor a group is summed in one task.
    """
    key = [by, t]
    offset = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    each = [F.struct(F.lit(f"{n}{i}").alias("_end"), (F.col(t) + offset(s[i])).alias("_at"), F.lit(2 if i and closed else 0).alias("_order")) for n, s in spans.items() for i in (0, 1)]
    ends = points.select(by, t, F.explode(F.array(*each)).alias("_e")).select(by, t, "_e.*").distinct()
    blocked = lambda rows: rows.withColumn("_block", F.floor(F.col("_at") / block))
    put = blocked(frames.select(by, F.col(t).alias("_at"), *xs, F.lit(1).alias("_order"))).unionByName(blocked(ends), allowMissingColumns=True)
    # frames of an end's own time come after it, or before a closed one
    w = W.partitionBy(by, "_block").orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, 0)
    sums = {f"_s{i}": F.sum(x) for i, x in enumerate(xs)} | {f"_n{i}": F.count(x) for i, x in enumerate(xs)}
    here = put.withColumns({c: f.over(w) for c, f in sums.items()}).where("_order <> 1").select(by, t, "_end", "_block", *sums)
    before = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = put.groupBy(by, "_block").agg(*(f.alias(c) for c, f in sums.items()))
    base = totals.select(by, "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in sums))
    at = here.join(base, [by, "_block"]).select(by, t, "_end", *((F.coalesce(F.col(c), F.lit(0)) + F.col(f"_b{c}")).alias(c) for c in sums))
    pick = lambda c, e: F.max(F.when(F.col("_end") == e, F.col(c)))
    wide = at.groupBy(*key).agg(*(pick(c, f"{n}{i}").alias(f"_{n}{i}{c}") for n in spans for i in (0, 1) for c in sums))
    mean = lambda n, i: F.try_divide(F.col(f"_{n}1_s{i}") - F.col(f"_{n}0_s{i}"), F.col(f"_{n}1_n{i}") - F.col(f"_{n}0_n{i}"))
    return points.join(wide.select(*key, *(mean(n, i).alias(f"{n}_{x}") for n in spans for i, x in enumerate(xs))), key)


def span_peaks(frames: DataFrame, points: DataFrame, by: str, t: str, peaks: dict[str, tuple[str, Column]], widest: float) -> DataFrame:
    """points with the largest x within a reach of each point, by name (x, reach): 0 where no frame is so near; no reach is over `widest`."""
    asked = points.select(by, t, *(r.alias(f"_r{i}") for i, (_, r) in enumerate(peaks.values()))).distinct()
    other = frames.select(by, F.col(t).alias("_at"), *{x for x, _ in peaks.values()})
    best = [F.max(F.when(F.abs(F.col("_at") - F.col(t)) <= F.col(f"_r{i}"), F.col(x))).alias(n) for i, (n, (x, _)) in enumerate(peaks.items())]
    found = within(asked, other, by, t, "_at", widest).groupBy(by, t).agg(*best)
    return points.join(found, [by, t], "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in peaks})


def median_of(sorted_array: Column) -> Column:
    """Median of a sorted array without nulls; null if it is empty."""
    n = F.size(sorted_array)
    return F.when(n > 0, (F.get(sorted_array, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_array, F.floor(n / 2).cast("int"))) / 2)


def _times(column: str, duration: str) -> Column:
    """Distinct times within the track, sorted, to nine decimals."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(column, lambda t: (t >= 0) & (t <= F.col(duration))), lambda t: F.round(t, 9))))


def normalised_curves(frames: DataFrame, by: str) -> DataFrame:
    """by, t, beat_curve, down_curve: onset, low_jump, rms and flux between their percentiles, mixed, and put between percentiles again."""
    part = W.partitionBy(by)
    n = {x: percentile_normalised(x, part, 0.08, 0.94) for x in ("onset", "low_jump", "rms", "flux")}
    mixed = frames.select(by, "t", *(c.alias(x) for x, c in n.items()), percentile_normalised("flux", part, 0.08, 0.995).alias("high"))
    mixed = mixed.select(by, "t", (0.40 * F.col("onset") + 0.25 * F.col("low_jump") + 0.20 * F.col("flux") + 0.15 * F.col("rms")).alias("b"), (0.20 * F.col("onset") + 0.12 * F.col("low_jump") + 0.48 * F.col("high") + 0.20 * F.col("rms")).alias("d"))
    return mixed.select(by, "t", percentile_normalised("b", part, 0.08, 0.94).alias("beat_curve"), percentile_normalised("d", part, 0.08, 0.99).alias("down_curve"))


def score_estimates(frames: DataFrame, estimates: DataFrame, by: str, provider: str = "provider") -> DataFrame:
    """Scores of estimated beats against a track's curves: by, provider, final, and the parts of it.

    frames: by, t, onset, low_jump, rms, flux; estimates: by, provider, beats and downbeats (arrays of seconds), confidence, duration. Beats, the middles
    between them, downbeats and other beats (all that aren't near a downbeat) are points of one list; each takes the largest value of its curve within its tolerance, by one join on bins as wide as the
    widest tolerance. So a tempo of half or double the right one loses by what it leaves between its beats, or by what it hits between true ones. Fewer than
    three beats, or a track without three frames: every part is 0.
    """
    curves = normalised_curves(frames, by)
    per_track = quantiles(curves, [by], "beat_curve", {"q": 0.68}).select(by, F.col("n").alias("_frames"), F.greatest(F.col("q"), F.lit(0.18)).alias("_floor"))
    e = estimates.select(by, provider, F.col("confidence"), F.col("duration"), _times("beats", "duration").alias("b"), _times("downbeats", "duration").alias("d"))
    gaps = F.when(F.size("b") > 1, F.transform(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), lambda x, i: x - F.get("b", i))).otherwise(F.array().cast("array<double>"))
    e = e.withColumn("gaps", gaps).withColumn("good", F.array_sort(F.filter("gaps", lambda g: (g > 0.08) & (g < 4.0))))
    e = e.withColumn("beat", F.coalesce(median_of(F.col("good")), F.lit(0.5))).withColumn("off", F.array_sort(F.transform("good", lambda g: F.abs(g - F.col("beat")))))
    radius = F.greatest(F.lit(0.030), F.least(F.lit(WIDEST), 0.16 * F.col("beat")))
    e = e.withColumn("radius", radius).withColumn("wide", F.greatest(radius, F.lit(0.045))).join(per_track, by, "left")
    apart = F.greatest(F.lit(0.035), 1.5 * F.col("wide"))
    middles = F.transform("gaps", lambda g, i: F.get("b", i) + 0.5 * g)
    kinds = {"beat": (F.col("b"), "radius"), "middle": (middles, "radius"), "down": (F.col("d"), "wide")}
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("at"), F.col(r).alias("reach")) for k, (x, r) in kinds.items()))
    points = e.withColumn("apart", apart).select(by, provider, "wide", "apart", F.inline(lists)).select(by, provider, "wide", "apart", "kind", "reach", F.explode("at").alias("at"))
    # other beats: those with no downbeat near, by the next ones on both sides
    each, down_at = W.partitionBy(by, provider), F.when(F.col("kind") == "down", F.col("at"))
    sides = [f(down_at).over(each.orderBy(o("at")).rangeBetween(W.unboundedPreceding, 0)) for f, o in ((F.max, F.asc), (F.min, F.desc))]
    points = points.withColumns({"_a": sides[0], "_b": sides[1]}).withColumn("_far", (F.col("kind") == "beat") & (F.least(F.col("at") - F.col("_a"), F.col("_b") - F.col("at")) > F.col("apart")))
    points = points.withColumn("n_other", F.count_if("_far").over(each))
    both = F.array(F.struct("kind", "reach"), F.when(F.col("_far"), F.struct(F.lit("other").alias("kind"), F.col("wide").alias("reach"))))
    points = points.select(by, provider, "at", "n_other", F.inline(F.array_compact(both)))
    near = within(points.distinct(), curves, by, "at", "t", WIDEST).where(F.abs(F.col("at") - F.col("t")) <= F.col("reach"))
    top = near.groupBy(by, provider, "kind", "at", "n_other").agg(F.max(F.when(F.col("kind").isin("beat", "middle"), F.col("beat_curve")).otherwise(F.col("down_curve"))).alias("v"))
    floors = e.select(by, provider, "_floor")
    sums = top.join(floors, [by, provider]).groupBy(by, provider).agg(*(F.sum(F.when(F.col("kind") == k, F.col("v"))).alias(f"_{k}") for k in (*kinds, "other")), F.max("n_other").alias("n_other"), F.count_if((F.col("kind") == "beat") & (F.col("v") >= F.col("_floor"))).alias("_hits"))
    # without a frame near any point every mean is 0, however many others there are
    x = e.join(sums, [by, provider], "left")
    mean = lambda k, n: F.when(n > 0, F.coalesce(F.col(f"_{k}"), F.lit(0.0)) / n).otherwise(0.0)
    n_b, n_d = F.size("b"), F.size("d")
    # a floor of 0.18 or more: beats without a frame near them are no hits
    beat, middle, down = mean("beat", n_b), mean("middle", n_b - 1), mean("down", n_d)
    others = F.when(F.col("n_other") > 0, mean("other", F.col("n_other"))).otherwise(F.greatest(down - 0.10, F.lit(0.0)))
    mad = median_of(F.col("off"))
    parts = {
        "beat_support": beat,
        "beat_hit_rate": F.coalesce(F.col("_hits") / n_b, F.lit(0.0)),
        "offbeat_contrast": clip01((beat - middle + 0.16) / 0.50),
        "tempo_stability": F.when((n_b >= 4) & (F.size("good") >= 3), clip01(1 - mad / F.greatest(0.08 * F.col("beat"), F.lit(1e-6)))).otherwise(0.0),
        "coverage": F.when((n_b >= 2) & (F.col("duration") > 0), clip01((F.get("b", n_b - 1) - F.get("b", F.lit(0))) / F.greatest(0.82 * F.col("duration"), F.lit(1e-6)))).otherwise(0.0),
        "downbeat_support": F.when((n_b < 8) | (n_d < 2), 0.42).otherwise(clip01((down - others + 0.20) / 0.55)),
        "provider_confidence": clip01(F.col("confidence").cast("double")),
    }
    shares = {"beat_support": 0.24, "beat_hit_rate": 0.21, "offbeat_contrast": 0.18, "tempo_stability": 0.13, "coverage": 0.09, "downbeat_support": 0.10, "provider_confidence": 0.05}
    usable = (n_b >= 3) & (F.coalesce("_frames", F.lit(0)) > 2)
    kept = x.select(by, provider, usable.alias("_ok"), *(c.alias(p) for p, c in parts.items()), n_b.cast("long").alias("n_beats"), n_d.cast("long").alias("n_downbeats"))
    final = clip01(sum((F.col(p) * s for p, s in shares.items()), F.lit(0.0)))
    zero = lambda c: F.when(F.col("_ok"), c).otherwise(0.0)
    return kept.select(by, provider, zero(final).alias("final"), *(zero(F.col(p)).alias(p) if p != "provider_confidence" else F.col(p) for p in parts), "n_beats", "n_downbeats")


def context_frames(frames: DataFrame, centres: DataFrame, by: str, t: str, xs: list[str], left: float, right: float, n: int, key: str) -> DataFrame:
    """by, key, frame, and every x on `n` evenly spaced times from `left` before to `right` after each centre; linear between frames, held at the ends.

    frames of uneven times and all grid times are one union; each grid time takes its last frame before and its first from it on by two running windows.
    Centres of a track without frames get 0; key: what names a centre in its track. Of frames with the same time the one with the smaller values counts.
    """
    step = (left + right) / (n - 1) if n > 1 else 0.0
    grid = centres.select(by, key, F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame", "_k"), F.col(t).alias("_c")).select(by, key, "frame", (F.col("_c") - left + F.col("_k") * step).alias("_at"))
    one = frames.groupBy(by, F.col(t).alias("_at")).agg(F.min(F.struct(*xs)).alias("_x"))
    put = one.withColumn("_f", F.struct("_at", "_x")).withColumn("_is", F.lit(1)).unionByName(grid.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    before = W.partitionBy(by).orderBy("_at", "_is").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(by).orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(W.unboundedPreceding, 0)
    seen = put.withColumn("_a", F.last("_f", True).over(before)).withColumn("_b", F.last("_f", True).over(after)).where("_is = 0")
    share = (F.col("_at") - F.col("_a._at")) / F.greatest(F.col("_b._at") - F.col("_a._at"), F.lit(1e-9))
    value = lambda x: F.coalesce(F.col(f"_a._x.{x}") + (F.col(f"_b._x.{x}") - F.col(f"_a._x.{x}")) * share, F.col(f"_a._x.{x}"), F.col(f"_b._x.{x}"), F.lit(0.0))
    return seen.select(by, key, "frame", *(value(x).alias(x) for x in xs))
