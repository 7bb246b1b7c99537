"""Order-dependent operators: each row's fate depends on rows kept before it, so a stretch of a group is walked in one pass.

Groups are tracks. They are cut at gaps wider than the operator's reach (`stretches`), which changes no result, since nothing reaches
over such a gap; CHUNK stretches at a time go to one call. So a hot track with gaps is spread over tasks, and short stretches don't each cost a call.
A stretch without a wide gap is walked by one task, in time n log n: its rows must fit there, as the result depends on their order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stretches of a group that one call walks.
CHUNK = 512
#: Time blocks, in radii, within which rows are compared with the one before.
BLOCK = 1024


def stretches(rows: DataFrame, by: str, t: str, radius: float) -> DataFrame:
    """The rows with `_part`, a number that grows at each gap of more than `radius` in the group, and `_chunk`, CHUNK parts each.

    Gaps are found within blocks of time and, by the blocks' first and last times, between them, so no task needs a whole track.
    """
    put = rows.withColumn("_block", F.floor(F.col(t) / (radius * BLOCK)))
    inner = W.partitionBy(by, "_block").orderBy(t)
    put = put.withColumn("_cut", F.coalesce((F.col(t) - F.lag(t).over(inner) > radius).cast("long"), F.lit(0)))
    blocks = W.partitionBy(by).orderBy("_block")
    edges = put.groupBy(by, "_block").agg(F.min(t).alias("_first"), F.max(t).alias("_last"), F.sum("_cut").alias("_cuts"))
    edges = edges.withColumn("_jump", F.coalesce((F.col("_first") - F.lag("_last").over(blocks) > radius).cast("long"), F.lit(0)))
    start = F.sum("_jump").over(blocks) + F.coalesce(F.sum("_cuts").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    put = put.join(edges.select(F.col(by).alias("_by"), F.col("_block").alias("_of"), start.alias("_start")), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_of")))
    put = put.withColumn("_part", F.col("_start") + F.sum("_cut").over(inner.rangeBetween(W.unboundedPreceding, 0)))
    return put.withColumn("_chunk", F.floor(F.col("_part") / CHUNK)).drop("_block", "_cut", "_by", "_of", "_start")


def spans(g: pd.DataFrame, *order: str) -> tuple[pd.DataFrame, Iterator[tuple[int, int]]]:
    """The rows by part and order, and each part's first place and the place after its last."""
    g = g.sort_values(["_part", *order])
    edge = np.flatnonzero(np.diff(g["_part"].to_numpy(), prepend=-1, append=-1))
    return g, zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def walked(rows: DataFrame, by: str, t: str, radius: float, walk: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    return stretches(rows, by, t, radius).groupBy(by, "_chunk").applyInPandas(walk, schema)


def nms(rows: DataFrame, by: str, t: str, quality: str, key: str, gap: float) -> DataFrame:
    """Greedy suppression: rows by falling quality (ties: time, key) stay unless a kept one is less than `gap` away."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, t, key)
        x, falling, kept = g[t].to_numpy(), -g[quality].to_numpy(), np.zeros(len(g), bool)
        for a, b in parts:
            times: list = []
            for i in (a + np.argsort(falling[a:b], kind="stable")).tolist():
                at = bisect_left(times, x[i])
                if (at == 0 or x[i] - times[at - 1] >= gap) and (at == len(times) or times[at] - x[i] >= gap):
                    insort(times, x[i])
                    kept[i] = True
        return g[kept].drop(columns=["_part", "_chunk"])

    return walked(rows, by, t, gap, walk, rows.schema)


def thin(rows: DataFrame, by: str, t: str, key: str, gap: float) -> DataFrame:
    """From left to right, rows at least `gap` after the last kept one."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, t, key)
        x, kept = g[t].to_numpy(), []
        for a, b in parts:
            last = None
            for i in range(a, b):
                if last is None or x[i] - last >= gap:
                    kept.append(i)
                    last = x[i]
        return g.iloc[kept].drop(columns=["_part", "_chunk"])

    return walked(rows, by, t, gap, walk, rows.schema)


class Cluster:
    """Values in order with their weights, summed in blocks, for the running lower weighted median."""

    SIZE = 512

    def __init__(self):
        self.values, self.weights, self.sums, self.total = [[]], [[]], [0.0], 0.0

    def add(self, x: float, w: float) -> float:
        """Adds a value; the median then: the first value, in order, at which half the weight is reached."""
        k = max(0, bisect_right([v[0] for v in self.values if v], x) - 1)
        i = bisect_right(self.values[k], x)
        self.values[k].insert(i, x)
        self.weights[k].insert(i, w)
        self.sums[k] += w
        self.total += w
        if len(self.values[k]) > self.SIZE:
            half = self.SIZE // 2
            for lists in (self.values, self.weights):
                lists.insert(k + 1, lists[k][half:])
                del lists[k][half:]
            self.sums[k : k + 1] = [sum(self.weights[k]), sum(self.weights[k + 1])]
        c = 0.0
        for values, weights, part in zip(self.values, self.weights, self.sums, strict=True):
            if c + part >= self.total / 2:
                for v, weight in zip(values, weights, strict=True):
                    c += weight
                    if c >= self.total / 2:
                        return v
            else:
                c += part
        return self.values[-1][-1]


def online_clusters(rows: DataFrame, by: str, t: str, weight: str, key: str, radius: float) -> DataFrame:
    """In time order, each row joins the nearest cluster whose running weighted median lies within `radius` (ties: the one begun first), else begins one.

    Adds part, cluster (by first time, from 0 in the part) and centre (the median in the end). Medians stay between their
    rows, so gaps over the radius can be cut. As rows come in time order, only centres in reach of the row's time are looked at.
    """

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, t, key)
        x, w = g[t].to_numpy(float).tolist(), g[weight].to_numpy(float).tolist()
        put, centre = np.zeros(len(g), np.int64), np.zeros(len(g))
        for a, b in parts:
            clusters: list[Cluster] = []
            centres: list[float] = []
            order: list[tuple[float, int]] = []  # the centres, sorted
            for i in range(a, b):
                low = bisect_left(order, (x[i] - radius, -1))
                near = min(((abs(c - x[i]), k) for c, k in order[low : bisect_right(order, (x[i] + radius, len(clusters)))]), default=None)
                if near is None:
                    k = len(clusters)
                    clusters.append(Cluster())
                    centres.append(x[i])
                else:
                    k = near[1]
                    del order[bisect_left(order, (centres[k], k))]
                centres[k] = clusters[k].add(x[i], w[i])
                insort(order, (centres[k], k))
                put[i] = k
            centre[a:b] = np.array(centres)[put[a:b]]
        return g.assign(part=g["_part"], cluster=put, centre=centre).drop(columns=["_part", "_chunk"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part long, cluster long, centre double"
    return walked(rows, by, t, radius, walk, schema)


def one_to_one(reference: DataFrame, estimate: DataFrame, by: str, t: str, tolerance: float) -> DataFrame:
    """Greedy two-pointer matching of sorted times, each used once: by, reference_t, estimate_t, error; unmatched ones are not in it."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, "side", t)
        x, side, out = g[t].to_numpy(), g["side"].to_numpy(), []
        for a, b in parts:
            i = a
            j = middle = a + int((side[a:b] == 0).sum())
            while i < middle and j < b:
                d = x[j] - x[i]
                if abs(d) <= tolerance:
                    out.append((x[i], x[j], d))
                    i, j = i + 1, j + 1
                elif d < 0:
                    j += 1
                else:
                    i += 1
        k = pd.DataFrame(out, columns=["reference_t", "estimate_t", "error"])
        k.insert(0, by, g[by].iloc[0])
        return k

    both = reference.select(by, t, F.lit(0).alias("side")).unionByName(estimate.select(by, t, F.lit(1).alias("side")))
    kind, time = both.schema[by].dataType.simpleString(), both.schema[t].dataType.simpleString()
    return walked(both, by, t, tolerance, walk, f"{by} {kind}, reference_t {time}, estimate_t {time}, error {time}")


def merge_running(rows: DataFrame, by: str, t: str, key: str, gap: float) -> DataFrame:
    """From left to right, a row within `gap` of the merged value joins it, and the value moves half way to it: by, value, n."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, t, key)
        x, out = g[t].to_numpy(float), []
        for a, b in parts:
            first = len(out)
            for i in range(a, b):
                if len(out) > first and x[i] - out[-1][0] <= gap:
                    out[-1] = ((out[-1][0] + x[i]) / 2, out[-1][1] + 1)
                else:
                    out.append((x[i], 1))
        k = pd.DataFrame(out, columns=["value", "n"])
        k.insert(0, by, g[by].iloc[0])
        return k

    return walked(rows, by, t, gap, walk, f"{by} {rows.schema[by].dataType.simpleString()}, value double, n long")


def append_apart(kept: DataFrame, more: DataFrame, by: str, t: str, key: str, radius: float) -> DataFrame:
    """The kept rows, and those of `more`, in order of time and key, that lie over `radius` from all kept so far."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, parts = spans(g, "_later", t, key)
        x, later, chosen = g[t].to_numpy(), g["_later"].to_numpy(), np.zeros(len(g), bool)
        for a, b in parts:
            times: list = []
            for i in range(a, b):
                at = bisect_left(times, x[i])
                if not later[i] or (at == 0 or x[i] - times[at - 1] > radius) and (at == len(times) or times[at] - x[i] > radius):
                    insort(times, x[i])
                    chosen[i] = True
        return g[chosen].drop(columns=["_part", "_chunk", "_later"])

    both = kept.withColumn("_later", F.lit(0)).unionByName(more.withColumn("_later", F.lit(1)))
    return walked(both, by, t, radius, walk, kept.schema)


def diversified(rows: DataFrame, by: str, source: str, score: str, key: str, most: int, front: int, cap: int) -> DataFrame:
    """At most `most` rows of a group: the best `front`, then by score at most `cap` of a source, then what is left by score.

    All three steps are ranks, so no group is walked: a row's place in its source decides whether the cap lets it by.
    """
    order = [F.desc(score), F.col(key)]
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    # places in a source among the rows behind the front, after the front's own rows of that source
    ranked = ranked.withColumn("_s", F.row_number().over(W.partitionBy(by, source).orderBy(*order)))
    stage = F.when(F.col("_k") <= front, 0).when(F.col("_s") <= cap, 1).otherwise(2)
    placed = ranked.withColumn("_stage", stage).withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("_stage", *order)).cast("long"))
    return placed.where(F.col("place") <= most).drop("_k", "_s", "_stage")
