"""Generators of candidates: bars of a tempo's clock with evidence from every role, structural times inside a region, a fallback, and quotas.

Tracks are rows with a tempo; roles' curves are frames (track, role, t, and curves between 0 and 1). Every generator gives track, t, source and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.num import clip01, sigmoid
from tidemark.operators.curves import span_means, span_peaks
from tidemark.operators.joins import ranked
from tidemark.operators.windows import percentile_normalised

# The roles, and in the functions below the weights and spans of evidence.
ROLES = ("drums", "bass", "instrumental", "vocals")
#: Slowest tempo there is; tolerances and spans are bounded by its beat.
SLOWEST = 60.0


def phrase_strength(bar: Column) -> Column:
    """How strong a phrase begins at a bar, from 1: by the largest of these periods that divides the bars before it."""
    phase = bar - 1
    out = F.when(phase <= 0, 0.18)
    for period, strength in ((32, 1.00), (24, 0.96), (16, 0.94), (8, 0.86), (12, 0.80), (4, 0.66), (2, 0.48)):
        out = out.when(phase % period == 0, strength)
    return out.otherwise(0.18)


def role_scores(frames: DataFrame, points: DataFrame, track: str) -> DataFrame:
    """track, t, role, role_score: each role's evidence for a change at a point.

    frames: track, role, t, rms, low, onset, attack, flux; points: track, t, beat (seconds). Means over one, two and four bars before and after the point,
    and peaks around it, in one pass each over the curves of all roles.
    """
    roles = frames.where(F.col("role").isin(*ROLES)).withColumn("_g", F.concat_ws("/", F.col(track).cast("string"), "role"))
    at = points.select(track, "t", "beat").distinct().join(roles.select(track, "role", "_g").distinct(), track)
    bar = 4 * F.col("beat")
    spans = {"pre": (-2 * bar, F.lit(0.0)), "post": (F.lit(0.0), 4 * bar), "pre1": (-bar, F.lit(0.0)), "post1": (F.lit(0.0), bar)}
    means = span_means(roles, at, "_g", "t", ["rms", "low", "onset"], spans, 32 * 60 / SLOWEST, closed=True)
    reach = lambda least, beats: F.greatest(F.lit(least), beats * F.col("beat"))
    x = span_peaks(roles, means, "_g", "t", {"attack_peak": ("attack", reach(0.07, 0.20)), "flux_peak": ("flux", reach(0.08, 0.30))}, 0.30 * 60 / SLOWEST)
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pre1, post1 = F.coalesce("pre1_rms", v("pre_rms")), F.coalesce("post1_rms", v("post_rms"))
    jump = lambda a, b: clip01((b - a + 0.25) / 1.25)
    low, activity = jump(v("pre_low"), v("post_low")), clip01(0.45 * v("post_rms") + 0.35 * v("post_onset") + 0.20 * v("post_low"))
    dropout, reentry = clip01((pre1 - post1 + 0.12) / 0.70), clip01((post1 - pre1 + 0.12) / 0.70)
    attack, flux = clip01(F.col("attack_peak")), clip01(F.col("flux_peak"))
    score = (
        F.when(F.col("role") == "drums", F.greatest(attack, 0.65 * low, 0.60 * activity))
        .when(F.col("role") == "bass", F.greatest(low, 0.70 * activity))
        .when(F.col("role") == "instrumental", F.greatest(jump(v("pre_rms"), v("post_rms")), jump(pre1, post1), 0.80 * flux, 0.65 * activity))
        .otherwise(F.greatest(dropout, 0.75 * reentry, 0.45 * flux))
    )
    return x.select(track, "t", "role", score.alias("role_score"))


def clock_bars(frames: DataFrame, tracks: DataFrame, track: str, limit: int = 96) -> DataFrame:
    """track, t, source, score, bar, phrase_strength: bars of the tracks' clocks that phrases and the roles' evidence speak for.

    tracks: track, bpm, zero (the first bar's time), duration. The first `limit` bars within 72 % of the track count; tracks without a tempo or frames have none.
    """
    known = tracks.where(F.col("bpm") > 0).withColumn("beat", 60 / F.col("bpm")).withColumn("until", 0.72 * F.col("duration"))
    last = F.least(F.lit(limit), F.floor(F.col("until") / (4 * F.col("beat"))) + 1)
    bars = known.select(track, "beat", "until", "zero", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1)).cast("long"))).alias("bar"))
    bars = bars.withColumn("t", F.col("zero") + (F.col("bar") - 1) * 4 * F.col("beat")).where((F.col("t") >= F.greatest(F.lit(0.75), 2 * F.col("beat"))) & (F.col("t") <= F.col("until")))
    scores = role_scores(frames, bars, track).groupBy(track, "t").agg(F.max("role_score").alias("most"), F.avg("role_score").alias("mean"))
    scored = bars.join(scores, [track, "t"]).withColumn("phrase_strength", phrase_strength(F.col("bar")))
    score = clip01(0.55 * F.col("most") + 0.25 * F.col("mean") + 0.20 * F.col("phrase_strength"))
    out = scored.select(track, "t", F.when(F.col("phrase_strength") >= 0.48, "clock_phrase_bar").otherwise("clock_bar").alias("source"), score.alias("score"), "bar", "phrase_strength")
    return out.where((F.col("score") >= 0.22) | (F.col("phrase_strength") >= 0.86))


def _shape(frames: DataFrame, points: DataFrame, track: str, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """points with means of onset, low and novelty between their track's 10th and 90th percentiles over closed spans; 0 where there are no frames."""
    part = W.partitionBy(track)
    xs = ["onset", "low", "novelty"]
    normed = frames.select(track, "t", *(percentile_normalised(x, part, 0.10, 0.90).alias(x) for x in xs))
    means = span_means(normed, points, track, "t", xs, spans, 32.0, closed=True)
    return means.withColumns({f"{n}_{x}": F.coalesce(f"{n}_{x}", F.lit(0.0)) for n in spans for x in xs})


def structural_times(frames: DataFrame, regions: DataFrame, track: str, most: int = 256) -> DataFrame:
    """track, t, source, score: bars of a region by impact, buildup, sustain and novelty around them, the best `most` of a track.

    frames: track, t, onset, low, novelty; regions: track, low_t, high_t, bpm (null: 128), duration. Scores are put between a track's 10th and 90th percentiles.
    """
    beat = F.greatest(F.lit(0.28), F.least(F.lit(0.75), 60 / F.when(F.col("bpm") > 0, F.col("bpm")).otherwise(128.0)))
    bounded = regions.withColumn("step", F.greatest(F.lit(0.25), 4 * beat)).withColumn("a", F.greatest(F.lit(0.5), "low_t"))
    bounded = bounded.withColumn("b", F.least(F.greatest(F.col("a") + 1.0, F.col("high_t")), F.col("duration") - 0.5)).where("b > a")
    grid = bounded.select(track, "a", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a") + 1e-9) / F.col("step")))).alias("k")).select(track, (F.col("a") + F.col("k") * F.col("step")).alias("t"))
    enough = frames.groupBy(track).count().where("count >= 4").select(track)
    x = _shape(frames, grid.join(enough, track, "left_semi"), track, {"far": (-8.0, -1.0), "pre": (-2.0, 0.0), "post": (0.0, 2.0), "on": (2.0, 8.0), "near": (-0.8, 1.2)})
    rise = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0.0))
    raw = x.select(track, "t", (0.40 * rise("pre_low", "post_low") + 0.30 * rise("far_onset", "post_onset") + 0.22 * rise("pre_low", "on_low") + 0.08 * F.greatest("near_novelty", F.lit(0.0))).alias("raw"))
    part = W.partitionBy(track)
    low, high = (F.percentile("raw", F.lit(q)).over(part) for q in (0.10, 0.90))
    scored = raw.select(track, "t", F.lit("structure").alias("source"), clip01((F.col("raw") - low) / F.greatest(high - low, F.lit(1e-9))).alias("score"))
    return ranked(scored, [track], F.desc(F.round("score", 9)), F.desc("t")).where(F.col("rank") <= most).drop("rank")


def fallback_time(frames: DataFrame, candidates: DataFrame, regions: DataFrame, track: str) -> DataFrame:
    """track, t, source, score: for each track the candidate inside its region with the best ranks among the track's, and a confidence that drops if few of them are high.

    candidates: track, t, confidence; regions: track, low_t, high_t, duration. A track without candidates in its region gets its first one with confidence 0.
    """
    held = candidates.select(track, "t", "confidence").join(regions.select(track, "low_t", "high_t", "duration"), track)
    inside = held.where((F.col("t") >= F.greatest(F.lit(0.5), "low_t")) & (F.col("t") <= F.least("high_t", F.greatest(F.col("duration") - 1.0, F.lit(0.0)))))
    x = _shape(frames, inside, track, {"early": (-16.0, -8.0), "build": (-8.0, -2.0), "pre": (-2.0, 0.0), "post": (0.0, 2.0), "on": (2.0, 8.0), "near": (-1.0, 1.5)})
    rise = lambda a, b: F.round(F.greatest(F.col(b) - F.col(a), F.lit(0.0)), 9)
    x = x.select(track, "t", rise("pre_low", "post_low").alias("low"), rise("pre_onset", "post_onset").alias("onset"), rise("pre_low", "on_low").alias("sustain"), rise("early_onset", "build_onset").alias("buildup"), F.round("near_novelty", 9).alias("novelty"), "confidence")
    core, shares = ("low", "onset", "sustain", "buildup"), {"low": 0.30, "onset": 0.24, "sustain": 0.22, "buildup": 0.14, "novelty": 0.06, "confidence": 0.04}
    n = F.count(F.lit(1)).over(W.partitionBy(track))
    rank = lambda c: F.when(n == 1, 1.0).otherwise((F.row_number().over(W.partitionBy(track).orderBy(c, "t")) - 1) / (n - 1))
    r = x.select(track, "t", *(rank(c).alias(c) for c in shares))
    hits = sum(((F.col(c) >= 0.72).cast("int") for c in core), F.lit(0))
    r = r.withColumn("hits", hits).withColumn("core", sum((F.col(c) for c in core), F.lit(0.0)) / 4)
    r = r.withColumn("raw", sum((F.col(c) * s for c, s in shares.items()), F.lit(0.0)) - F.when(F.col("hits") < 2, 0.14).otherwise(0.0))
    best = ranked(r, [track], F.desc(F.round("raw", 9)), F.col("t")).where("rank = 1")
    sure = sigmoid(5.0 * (F.col("raw") - 0.58)) * F.when(F.col("hits") < 2, 0.40).when(F.col("core") < 0.65, 0.70).otherwise(1.0)
    chosen = best.select(track, "t", clip01(sure).alias("score"))
    first = candidates.groupBy(track).agg(F.min("t").alias("t0"))
    return first.join(chosen, track, "left").select(track, F.coalesce("t", "t0").alias("t"), F.lit("fallback").alias("source"), F.coalesce("score", F.lit(0.0)).alias("score"))


def with_quotas(candidates: DataFrame, track: str, quotas: dict[str, int]) -> DataFrame:
    """The best of each track's candidates by source, as many as the source's quota; sources without a quota stay whole."""
    quota = F.coalesce(*(F.when(F.col("source") == s, n) for s, n in quotas.items()), F.lit(2**31 - 1))
    return ranked(candidates, [track, "source"], F.desc(F.round("score", 9)), F.col("t")).where(F.col("rank") <= quota).drop("rank")


def or_else(candidates: DataFrame, others: DataFrame, track: str) -> DataFrame:
    """The candidates, and those of the others whose track has none."""
    none = others.join(candidates.select(track).distinct(), track, "left_anti")
    return candidates.unionByName(none, allowMissingColumns=True)
