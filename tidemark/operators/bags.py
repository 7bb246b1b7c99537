"""Bags of items over segments of a track: window bags by differences, novelty between flanks, later windows alike to a query's.

Bags are rows (track, segment, item, n): n of an item in a segment. A window is `width` segments from a start; its bag changes only where a segment
with the item comes in or goes out, so it is kept as steps of a running sum, one per change, and every window's bag is made once, for all that compare
with it. Two windows' similarity is the sum of their items' smaller counts over that of the larger ones, and the larger ones' sum is both totals less
the smaller ones', so only items that both hold are joined.

The commonest pairs of neighbours are found by what bounds them: no pair is commoner than either of its words, nor than the bucket that a word's hash falls into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import staged

#: Buckets of words' hashes, and how many of the fullest are looked at first.
BUCKETS, OFTEN = 1 << 20, 1024


def commonest_pairs(lists: DataFrame, words: str, most: int, often: int = OFTEN, buckets: int = BUCKETS) -> DataFrame:
    """pair, n: the `most` commonest pairs of neighbouring words, joined by a blank, of all lists; ties by the pair. Pairs with a null or empty word don't count.

    Buckets of words are counted first, then the pairs of words from the `often` fullest ones. If another bucket is at least as full as the last of these pairs is common,
    pairs are counted once more, of words from all such buckets: so the answer is exact, and rare words, nearly all different pairs, are never grouped.
    """
    bucket = lambda word: F.pmod(F.xxhash64(word), F.lit(buckets))
    # outer: else the lists are made once more, for a filter on their size
    sizes = lists.select(F.explode_outer(words).alias("word")).where("word <> ''").groupBy(bucket("word").alias("bucket")).agg(F.count("*").alias("n"))
    fullest = sizes.orderBy(F.desc("n"), "bucket").limit(often + 1).collect()
    pairs = lists.select(F.inline(F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.size(words)).alias("b")))).toDF("a", "b").where("a <> '' AND b <> ''")

    def counted(kept: DataFrame) -> DataFrame:
        """Kept are at most `buckets` numbers, so they are broadcast."""
        met = pairs
        for word in ("a", "b"):
            met = met.join(F.broadcast(kept.select(F.col("bucket").alias(f"of_{word}"))), bucket(word) == F.col(f"of_{word}"), "left_semi")
        return met.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "a", "b").alias("pair"), "n").orderBy(F.desc("n"), "pair").limit(most)

    top = staged(counted(lists.sparkSession.createDataFrame([(r.bucket,) for r in fullest[:often]], "bucket long")), "pairs").orderBy(F.desc("n"), "pair")
    found = top.agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    least = found.least if found.rows == most else 0
    if len(fullest) <= often or fullest[often].n < least:
        return top
    return counted(sizes.where(F.col("n") >= least))


def window_bags(bags: DataFrame, by: str, seg: str, item: str, n: str, width: int, first: int = 0) -> DataFrame:
    """by, start, item, c: what the windows from start `first` on hold; c > 0."""
    changes = bags.select(by, F.col(item).alias("item"), F.inline(F.array(*(F.struct((F.col(seg) + shift).alias("start"), (F.col(n) * sign).alias("d")) for shift, sign in ((1 - width, 1), (1, -1))))))
    w = W.partitionBy(by, "item").orderBy("start")
    steps = changes.groupBy(by, "item", "start").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("c", F.sum("d").over(w)).withColumn("until", F.lead("start").over(w)).where("c > 0")
    return steps.where(F.col("until") > first).select(by, F.explode(F.sequence(F.greatest("start", F.lit(first).cast("long")), F.col("until") - 1)).alias("start"), "item", "c")


def totals(windows: DataFrame, by: str) -> DataFrame:
    return windows.groupBy(by, "start").agg(F.sum("c").alias("total"))


def flank_novelty(bags: DataFrame, lengths: DataFrame, by: str, seg: str, item: str, n: str, flank: int) -> DataFrame:
    """by, seg, novelty: 1 less the similarity of the `flank` segments before and those from the segment on; 0 where either is empty.

    lengths: by, segments (their number); rows come for all of them.
    """
    held = window_bags(bags, by, seg, item, n, flank, first=-flank)
    before, after = held.withColumn("start", F.col("start") + flank), held
    both = before.withColumnRenamed("c", "a").join(after.withColumnRenamed("c", "b"), [by, "start", "item"]).groupBy(by, "start").agg(F.sum(F.least("a", "b")).alias("low"))
    size = totals(held, by)
    every = lengths.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1)).alias("start"))
    out = every.join(size.withColumnRenamed("total", "ta").withColumn("start", F.col("start") + flank), [by, "start"], "left").join(size.withColumnRenamed("total", "tb"), [by, "start"], "left").join(both, [by, "start"], "left")
    low = F.coalesce("low", F.lit(0))
    novelty = F.when(F.col("ta").isNull() | F.col("tb").isNull(), 0.0).otherwise(1 - low / (F.col("ta") + F.col("tb") - low))
    return out.select(by, F.col("start").alias(seg), novelty.alias("novelty"))


def later_matches(bags: DataFrame, queries: DataFrame, lengths: DataFrame, by: str, seg: str, item: str, n: str, width: int, step: int = 1, most: int = 512) -> DataFrame:
    """by, start, similarity, later: each query window's best later window of its track (0 and null: none), the earliest if several are alike.

    queries: by, start; lengths: by, segments. Later windows begin `width` + k * `step` segments after the query's, k < `most`, and end within the track.
    A query meets the windows of two bins of their starts only, and no window of a track is joined without an item in common.
    """
    held = window_bags(bags, by, seg, item, n, width)
    asked = queries.select(by, "start").distinct()
    reach = most * step
    bin_of = lambda x: F.floor(x / reach)
    q = held.join(asked, [by, "start"], "left_semi").select(by, "item", F.col("start").alias("q"), F.col("c").alias("cq"))
    q = q.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of(F.col("q") + width), bin_of(F.col("q") + width + reach - step)))))
    later = held.join(lengths.select(by, "segments"), by).where(F.col("start") + width <= F.col("segments")).select(by, "item", "start", "c", bin_of(F.col("start")).alias("bin"))
    gap = F.col("start") - F.col("q") - width
    met = q.join(later, [by, "item", "bin"]).where((gap >= 0) & (gap < reach) & (gap % step == 0)).groupBy(by, "q", "start").agg(F.sum(F.least("cq", "c")).alias("low"))
    size = totals(held, by)
    sized = met.join(size, [by, "start"]).join(size.select(by, F.col("start").alias("q"), F.col("total").alias("tq")), [by, "q"])
    scored = sized.select(by, "q", "start", (F.col("low") / (F.col("total") + F.col("tq") - F.col("low"))).alias("similarity"))
    best = scored.groupBy(by, "q").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("later"))).alias("b")).select(by, F.col("q").alias("start"), (-F.col("b.s")).alias("similarity"), F.col("b.later").alias("later"))
    return asked.join(best, [by, "start"], "left").select(by, "start", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "later")
