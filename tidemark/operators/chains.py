"""Sets of tracks: chains that grow by one track a round, each by rules on tempo, key, energy, artists and what it has already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import allowed_keys
from tidemark.sources.tables import staged

#: A track is chosen among so many best ones.
TOP = 5
UNKNOWN_DIFFERENCE = 9


def energy_allowed(now: Column, then: Column, strategy: str, step: int) -> Column:
    """Whether energy may go from one value to the next; an unknown one blocks nothing."""
    rule = {"ramp": (then - now).between(0, step), "wave": F.abs(then - now) <= step, "match": then == now}.get(strategy, F.lit(True))
    return F.coalesce(rule, F.lit(True))


def energy_penalty(now: Column, then: Column, strategy: str, step: int) -> Column:
    apart = F.abs(then - now)
    known = {"ramp": F.when(then >= now, 0).otherwise(3) + F.greatest(then - now - step, F.lit(0)), "match": F.when(apart == 0, 0).when(apart == 1, 1).otherwise(3)}.get(strategy, apart)
    return F.coalesce(known, F.lit(1))


def useful_tracks(tracks: DataFrame, length: int) -> DataFrame:
    """The tracks that any chain can need: of each tempo, key and energy the first ones by name.

    A chain has at most `length` tracks and keeps out no other artists than theirs. So of an artist's tracks only the first length + TOP can be among the TOP
    that are left, and of all these only the first length * (length + TOP) + TOP. What remains is bounded by the tempos, keys and energies there are.
    """
    own = W.partitionBy("bpm", "key", "energy", "artist").orderBy("name", "src")
    some = tracks.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= length + TOP)
    return some.withColumn("_k", F.row_number().over(W.partitionBy("bpm", "key", "energy").orderBy("name", "src"))).where(F.col("_k") <= length * (length + TOP) + TOP).drop("_k")


def build_sets(tracks: DataFrame, starts: DataFrame, length: int, *, bpm_step: int = 4, bpm_back: int = 2, slowest: int = 70, per_artist: int = 2, mode: str = "pro", strategy: str = "ramp", energy_step: int = 2) -> DataFrame:
    """start, place (from 1), src: each start's chain of at most `length` tracks.

    tracks: src (unique), name, artist, bpm (int), number and letter of the key, energy (int or null); starts: src. The next track has a tempo of up to
    `bpm_step` more, an allowed key, an allowed energy, no more than `per_artist` of its artist, and isn't in the chain; without one, slightly slower tracks
    count, then any energy. Of the TOP by tempo, energy, key and name, the one with the smallest hash of start, place and track is taken (the reference takes one at random).

    A round joins all chains' ends with the useful tracks by tempo and key; chains carry their tracks and artists in the row, and rounds are written, so no
    chain is walked anywhere and no plan grows.
    """
    keyed = tracks.withColumn("key", F.concat(F.col("number").cast("string"), "letter"))
    useful = staged(useful_tracks(keyed, length).select("src", "name", "artist", "bpm", "key", "number", "letter", "energy"), "sets-useful")
    ends = keyed.join(starts.select("src").distinct(), "src", "left_semi").select(F.col("src").alias("start"), "src", "artist", "bpm", "number", "letter", "energy", F.array("src").alias("used"), F.array("artist").alias("artists"))
    ends = staged(ends, "sets-1")
    out = ends.select("start", F.lit(1).alias("place"), "src")
    there = useful.select(*(F.col(c).alias(f"n_{c}") for c in useful.columns))
    for place in range(2, length + 1):
        low = F.greatest(F.lit(slowest), F.col("bpm") - bpm_back)
        tempos = F.array_union(F.sequence(F.col("bpm"), F.col("bpm") + bpm_step), F.when(low < F.col("bpm"), F.sequence(low, F.col("bpm") - 1)).otherwise(F.array().cast("array<int>")))
        asked = ends.withColumn("_keys", allowed_keys(F.col("number"), F.col("letter"), mode)).withColumn("n_bpm", F.explode(tempos)).select("*", F.posexplode("_keys").alias("_kp", "n_key"))
        met = asked.join(there, ["n_bpm", "n_key"]).where(~F.array_contains("used", F.col("n_src")))
        met = met.where(F.size(F.filter("artists", lambda a: a.eqNullSafe(F.col("n_artist")))) < per_artist)
        tier = F.when(F.col("n_bpm") < F.col("bpm"), 1).otherwise(0) + F.when(energy_allowed(F.col("energy"), F.col("n_energy"), strategy, energy_step), 0).otherwise(2)
        order = [tier, F.abs(F.col("n_bpm") - F.col("bpm")), energy_penalty(F.col("energy"), F.col("n_energy"), strategy, energy_step), F.col("_kp"), F.coalesce(F.abs(F.col("n_energy") - F.col("energy")), F.lit(UNKNOWN_DIFFERENCE)), F.col("n_name"), F.col("n_src")]
        chain = W.partitionBy("start")
        best = met.withColumn("_tier", tier).withColumn("_k", F.row_number().over(chain.orderBy(*order))).where(F.col("_k") <= TOP)
        # candidates of a worse tier count only where there is none of a better one
        best = best.withColumn("_best", F.min("_tier").over(chain)).where("_tier = _best")
        chance = F.sha1(F.concat_ws("|", F.col("start").cast("string"), F.lit(str(place)), F.col("n_src").cast("string")).cast("binary"))
        taken = best.withColumn("_c", F.row_number().over(chain.orderBy(chance, "n_src"))).where("_c = 1")
        ends = taken.select("start", *(F.col(f"n_{c}").alias(c) for c in ("src", "artist", "bpm", "number", "letter", "energy")), F.array_append("used", F.col("n_src")).alias("used"), F.array_append("artists", F.col("n_artist")).alias("artists"))
        ends = staged(ends, f"sets-{place}")
        out = out.unionByName(ends.select("start", F.lit(place).alias("place"), "src"))
    return out
