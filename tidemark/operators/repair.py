"""Repair of steady grids of times: snapped to a lattice, one time a slot, gaps filled, cut and carried on to the duration, with downbeats by vote."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import ranked

#: Intervals that tell a tempo, in seconds; how sure the phase must be; gaps that are filled, and how near the next time a filled one may come, in periods.
SHORTEST, LONGEST, SURE, GAP, ROOM = 0.08, 4.0, 0.30, 1.55, 0.35


def tempos(beats: DataFrame, by: str, t: str) -> DataFrame:
    """by, period (median interval) and stability (0 to 1); 0 for fewer than four times or three usable intervals."""
    gap = F.col(t) - F.lag(t).over(W.partitionBy(by).orderBy(t))
    gaps = beats.select(by, t, gap.alias("g")).withColumn("g", F.when((F.col("g") > SHORTEST) & (F.col("g") < LONGEST), F.col("g")))
    centred = gaps.withColumn("p", F.percentile("g", F.lit(0.5)).over(W.partitionBy(by)))
    told = centred.groupBy(by).agg(F.count("*").alias("n"), F.count("g").alias("k"), F.max("p").alias("p"), F.percentile(F.abs(F.col("g") - F.col("p")), F.lit(0.5)).alias("mad"))
    usable = (F.col("n") >= 4) & (F.col("k") >= 3)
    stability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mad") / F.greatest(F.lit(1e-6), 0.08 * F.col("p"))))
    return told.select(by, F.when(usable, F.col("p")).otherwise(0.0).alias("period"), F.when(usable, stability).otherwise(0.0).alias("stability"))


def origins(beats: DataFrame, periods: DataFrame, by: str, t: str) -> DataFrame:
    """by, origin: where the lattice of the period begins, by the circular mean of phases; null where the phases point nowhere or there are fewer than three times.

    Sines and cosines are summed as decimals: sums of doubles depend on the order of rows, which differs from one evaluation to the next.
    """
    angle = 2 * math.pi * (F.col(t) - F.floor(F.col(t) / F.col("period")) * F.col("period")) / F.col("period")
    exact = lambda x: F.sum(x.cast("decimal(20,18)")).cast("double") / F.count("*")
    mean = beats.join(periods.where("period > 0"), by).groupBy(by, "period").agg(F.count("*").alias("n"), exact(F.cos(angle)).alias("c"), exact(F.sin(angle)).alias("s"), F.min(t).alias("first"))
    turn = F.atan2("s", "c") / (2 * math.pi)
    base = F.when(turn < 0, turn + 1).otherwise(turn) * F.col("period")
    origin = base + F.rint((F.col("first") - base) / F.col("period")) * F.col("period")
    return mean.select(by, F.when((F.col("n") >= 3) & (F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) >= SURE), F.greatest(origin, F.lit(0.0))).alias("origin"))


def repair_grids(beats: DataFrame, downbeats: DataFrame, tracks: DataFrame, by: str, t: str, *, least_stability: float = 0.72, snap: float = 0.28, per_bar: int = 4) -> tuple[DataFrame, DataFrame]:
    """(by, i, t, downbeat: the repaired times), and (by, status, period, stability, origin, snapped, removed, inserted, trimmed) of every track.

    beats, downbeats: by, t in seconds, from 0 on; tracks: by, duration (null: unknown). Tracks whose tempo isn't steady, or whose phases point nowhere, keep
    their times (status `unstable` or `no_phase`), without downbeats. Each step is one window or aggregate over a track's times: slots of the lattice keep their nearest time, the
    earlier on a tie, a gap knows its two ends only, and downbeats vote for the nearest of the times around them.
    """
    beats = beats.where(F.col(t) >= 0).select(by, t)
    told = tempos(beats, by, t)
    known = told.join(origins(beats, told, by, t), by, "left").join(tracks.select(by, "duration"), by, "left")
    status = F.when(F.col("stability") < least_stability, "unstable").when(F.col("period") <= 0, "unstable").when(F.col("origin").isNull(), "no_phase").otherwise("ok")
    known = known.withColumn("status", status).withColumn("edge", F.least(F.lit(0.010), F.greatest(F.lit(0.001), 0.02 * F.col("period"))))
    ok = known.where("status = 'ok'").select(by, "period", "origin", "duration", "edge")
    slot = F.rint((F.col(t) - F.col("origin")) / F.col("period")).cast("long")
    put = beats.join(ok, by).withColumn("slot", slot).withColumn("to", F.greatest(F.col("origin") + F.col("slot") * F.col("period"), F.lit(0.0)))
    put = put.withColumn("off", F.abs(F.col(t) - F.col("to"))).withColumn("near", F.col("off") <= F.greatest(F.lit(0.020), snap * F.col("period")))
    snapped = put.groupBy(by).agg(F.count_if(F.col("near") & (F.col("off") > 0.001)).alias("snapped"), F.count("*").alias("n"))
    slots = put.where("near").groupBy(by, "slot", "period", "duration", "edge").agg(F.min("to").alias("to"))
    kept = slots.groupBy(by).agg(F.count("*").alias("n_slots"))
    ahead = F.lead("to").over(W.partitionBy(by).orderBy("slot"))
    linked = slots.withColumn("next", ahead).withColumn("gap", F.col("next") - F.col("to"))
    missing = F.when(F.col("gap") > GAP * F.col("period"), F.rint(F.col("gap") / F.col("period")).cast("int") - 1).otherwise(0)
    inner = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda k: F.col("to") + k * F.col("period")), lambda x: (missing > 0) & (x < F.col("next") - ROOM * F.col("period")))
    filled = linked.select(by, "period", "duration", "edge", F.explode(F.concat(F.array(F.struct(F.col("to").alias("t"), F.lit(0).alias("new"))), F.transform(inner, lambda x: F.struct(x.alias("t"), F.lit(1).alias("new"))))).alias("b")).select(by, "period", "duration", "edge", "b.t", "b.new")
    cut = F.col("duration").isNull() | (F.col("t") <= F.col("duration") + F.col("edge"))
    trimmed = filled.groupBy(by).agg(F.count_if(~cut).alias("trimmed"))
    order = W.partitionBy(by).orderBy("t")
    inside = filled.where(cut).withColumn("more", F.when(F.lead("t").over(order).isNull(), F.floor((F.col("duration") + F.col("edge") - F.col("t")) / F.col("period")).cast("int")))
    steps = F.when(F.col("more") >= 1, F.sequence(F.lit(1), F.greatest("more", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    whole = inside.select(by, F.explode(F.concat(F.array(F.struct("t", F.lit(0).alias("tail"))), F.transform(steps, lambda k: F.struct((F.col("t") + k * F.col("period")).alias("t"), F.lit(1).alias("tail"))))).alias("b")).select(by, "b.t", "b.tail")
    new = filled.groupBy(by).agg(F.sum("new").alias("inner_new")).join(whole.groupBy(by).agg(F.sum("tail").alias("tail_new")), by, "left")
    # downbeats among the times, in one pass: times worked out twice might not be equal
    placed = ranked(whole.select(by, "t"), [by], F.col("t"), name="i").withColumn("i", F.col("i") - 1).withColumn("_at", F.col("t"))
    both = placed.unionByName(downbeats.select(by, F.col(t).alias("t")), allowMissingColumns=True)
    before, after = (w.rangeBetween(W.unboundedPreceding, 0) for w in (order, W.partitionBy(by).orderBy(F.desc("t"))))
    seen = both.withColumns({"_a": F.max("_at").over(before), "_ai": F.max("i").over(before), "_b": F.min("_at").over(after), "_bi": F.min("i").over(after)})
    early = F.col("_b").isNull() | (F.col("t") - F.col("_a") <= F.col("_b") - F.col("t"))
    voted = F.when(F.col("i").isNull(), F.when(F.col("_a").isNotNull() & early, F.col("_ai")).otherwise(F.col("_bi")) % per_bar)
    votes = F.array(*(F.count_if(voted == k).over(W.partitionBy(by)) for k in range(per_bar)))
    phased = seen.withColumn("votes", votes).where("i is not null").withColumn("phase", F.array_position("votes", F.array_max("votes")) - 1)
    marked = phased.withColumn("downbeat", (F.col("i") >= F.col("phase")) & ((F.col("i") - F.col("phase")) % per_bar == 0))
    same = ranked(beats.join(known.where("status <> 'ok'").select(by), by), [by], F.col(t), name="i").select(by, (F.col("i") - 1).alias("i"), F.col(t).alias("t"), F.lit(False).alias("downbeat"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = known.join(snapped, by, "left").join(kept, by, "left").join(trimmed, by, "left").join(new, by, "left")
    summary = sums.select(by, "status", "period", "stability", F.when(F.col("status") == "ok", F.col("origin")).alias("origin"), z("snapped").alias("snapped"), z(F.col("n") - F.coalesce("n_slots", F.lit(0))).alias("removed"), (z("inner_new") + z("tail_new")).alias("inserted"), z("trimmed").alias("trimmed"))
    return marked.select(by, "i", "t", "downbeat").unionByName(same), summary
