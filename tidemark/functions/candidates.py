"""Measures of candidates that lie in one of several places, and the score that weighs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.num import clip01, finite

# Fixed values, as candidates in files have them: names of measures, and what they count for.
#: Structs of a candidate that may hold a measure, in the order in which they are asked.
NESTED = ("features", "feature_summary", "microalign", "metrics", "debug")
#: What a candidate's parts count for, and what its penalties cost.
SHARES = {"original": 0.18, "micro": 0.18, "drums": 0.13, "instrumental": 0.11, "bass": 0.10, "vocal": 0.08, "groove": 0.08, "agreement": 0.07, "boundary": 0.05, "source": 0.04, "cluster": 0.05}
COSTS = {"fake": 0.10, "offset": 0.06}
#: Parts that are the largest of their measures, each times a factor.
LARGEST = {
    "drums": {"drums_transient_score": 1.0, "transient_strength": 1.0, "attack_peak_strength": 0.85},
    "bass": {"bass_low_jump_score": 1.0, "low_end_jump": 1.0},
    "instrumental": {"inst_energy_jump_score": 1.0, "energy_contrast": 1.0, "spectral_flux_peak": 1.0},
    "vocal": {"vocal_transition_score": 1.0, "vocal_dropout_score": 0.85, "vocal_reentry_score": 0.65},
    "groove": {"immediate_groove_start_score": 1.0, "sustained_full_groove_score": 1.0, "buildup_drop_score": 1.0, "drop_impact_score": 1.0, "kick_reentry_score": 1.0, "post_drop_density": 1.0},
}
#: Qualities of a boundary with the flag that says that it was used, and the factor if it wasn't.
BOUNDARIES = {"visual_onset_knee": 0.55, "centerline_boundary": 0.50, "ableton_asd": 0.45}


def metric_of(rows: DataFrame, nested: tuple[str, ...] = NESTED) -> Callable[[str], Column]:
    """A function from a measure's name to its column: the first number of the row's own column and of the nested structs' fields; 0 without one."""
    fields = {s.name: set(s.dataType.names) for s in rows.schema if isinstance(s.dataType, StructType)}

    def metric(name: str) -> Column:
        places = [F.col(name)] if name in rows.columns and name not in fields else []
        places += [F.col(s)[name] for s in nested if name in fields.get(s, ())]
        return F.coalesce(*(finite(c.cast("double")) for c in places), F.lit(0.0))

    return metric


def score_components(rows: DataFrame, *, cluster_size: str | None = None, roles: str | None = None, nested: tuple[str, ...] = NESTED) -> DataFrame:
    """The rows with `components`, a struct of every part, penalty and `final`, the score from 0 to 1.

    cluster_size: column with the number of candidates that the row stands for (None: 1); roles: array of their roles, of which `saved` and `unknown` don't count.
    """
    metric = metric_of(rows, nested)
    part = {"original": clip01(metric("confidence_score") if "confidence_score" in rows.columns else metric("score")), "micro": clip01(metric("micro_confidence"))}
    part |= {name: F.greatest(*(f * clip01(metric(m)) for m, f in ms.items()), F.lit(0.0)) for name, ms in LARGEST.items()}
    n_roles = F.size(F.filter(F.array_distinct(roles), lambda r: ~r.isin("saved", "unknown"))) if roles else F.lit(0)
    n_roles = F.greatest(n_roles, F.lit(0))
    size = F.col(cluster_size) if cluster_size else F.lit(1)
    part["boundary"] = F.greatest(*(clip01(metric(f"{b}_quality")) * F.when(metric(f"{b}_used") > 0, 1.0).otherwise(f) for b, f in BOUNDARIES.items()))
    part["source"] = clip01(metric("multistem_source_score"))
    part["agreement"] = F.greatest(clip01(metric("multistem_agreement")), F.least(F.lit(1.0), n_roles / 3.0))
    part["cluster"] = clip01(0.18 * F.greatest(size - 1, F.lit(0)) + 0.18 * n_roles)
    cost = {"fake": clip01(metric("fake_hit_penalty")), "offset": clip01(F.abs(metric("snap_offset_ms")) / 220.0)}
    positive = sum((s * part[name] for name, s in SHARES.items()), F.lit(0.0))
    negative = sum((s * cost[name] for name, s in COSTS.items()), F.lit(0.0))
    whole = {**part, **{f"{k}_penalty": v for k, v in cost.items()}, "negative": negative, "final": clip01(positive - negative)}
    return rows.withColumn("components", F.struct(*(c.cast("double").alias(k) for k, c in whole.items())))
