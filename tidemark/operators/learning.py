"""Preparation of training data, losses and calibration as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import stable_bucket


def split(rows: DataFrame, group: Column, parts: list[tuple[str, float]]) -> DataFrame:
    """The rows with `split`: groups go to parts by a stable hash; shares must sum to 1."""
    u = stable_bucket(group)
    name, top = F.lit(parts[-1][0]), 1.0
    for part, share in reversed(parts[:-1]):
        top = sum(s for p, s in parts[: [x for x, _ in parts].index(part) + 1])
        name = F.when(u < round(top, 9), part).otherwise(name)
    return rows.withColumn("split", name)


def pairwise_hinge(rows: DataFrame, by: str, score: str, positive: str, margin: float) -> DataFrame:
    """Per group with both kinds: hinge loss of the mean positive over the hardest negative."""
    good, bad = F.avg(F.when(F.col(positive) == 1, F.col(score))), F.max(F.when(F.col(positive) == 0, F.col(score)))
    return rows.groupBy(by).agg(good.alias("good"), bad.alias("bad")).where("good is not null and bad is not null").select(by, F.greatest(margin - F.col("good") + F.col("bad"), F.lit(0.0)).alias("hinge"))


def listwise_softmax(rows: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """Per group with a positive: minus the log of the positives' share of the softmax."""
    part = W.partitionBy(by)
    e = F.exp(F.col(score) - F.max(score).over(part))
    return rows.withColumn("_e", e).groupBy(by).agg(F.sum("_e").alias("z"), F.sum(F.when(F.col(positive) == 1, F.col("_e"))).alias("p")).where("p is not null").select(by, (F.log("z") - F.log("p")).alias("loss"))


def temperature_grid(rows: DataFrame, logit: str, positive: str, grid: list[float]) -> DataFrame:
    """Mean negative log-likelihood at each temperature, in one pass: temperature, nll."""
    p = lambda t: F.least(F.greatest(1 / (1 + F.exp(-F.col(logit) / t)), F.lit(1e-7)), F.lit(1 - 1e-7))
    nll = lambda t: F.avg(-F.when(F.col(positive) == 1, F.log(p(t))).otherwise(F.log(1 - p(t))))
    sums = rows.agg(*(nll(t).alias(f"t{i}") for i, t in enumerate(grid)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)))).alias("c")).select("c.*")


def signature_top(rows: DataFrame, key: str, vector: str, marks: list[list[float]], k: int) -> DataFrame:
    """Mean of the k largest dot products of each vector with a bounded matrix of signatures."""
    dot = lambda m: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in m)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x)
    top = F.slice(F.sort_array(F.array(*(dot(m) for m in marks)), asc=False), 1, k)
    return rows.select(key, F.aggregate(top, F.lit(0.0), lambda t, x: t + x, lambda t: t / F.size(top)).alias("score"))


def logistic_fit(rows: DataFrame, features: list[str], label: str, *, decay: float = 1.0, tolerance: float = 1e-8, rounds: int = 50) -> dict[str, tuple[float, float, float]]:
    """(mean, deviation, weight) of each feature and of `bias`, of the class-balanced logistic regression on standardised features with an L2 decay (not on the bias).

    Newton's method until the largest step is below the tolerance: a round is one aggregate over the table, of the slope and of the products that bend it, so what
    comes to the driver is as many numbers as there are pairs of features. Both classes weigh half the number of rows each. Rows with a null are left
    out; features that never change get weight 0; without both classes all weights are 0.
    """
    used = rows.select(*(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("_y")).na.drop()
    k = len(features)
    s = used.agg(F.count("*"), F.sum("_y"), *(f(f"_x{i}") for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    n, ones = s[0], s[1] or 0.0
    mean, deviation = [s[2 + 2 * i] or 0.0 for i in range(k)], [s[3 + 2 * i] or 0.0 for i in range(k)]
    w = np.zeros(k + 1)
    if 0 < ones < n:
        scale = [d if d > 1e-9 else float("inf") for d in deviation]
        z = [*((F.col(f"_x{i}") - mean[i]) / scale[i] for i in range(k)), F.lit(1.0)]
        ready = used.select(*(c.alias(f"z{i}") for i, c in enumerate(z)), "_y", F.when(F.col("_y") == 1, n / 2 / ones).otherwise(n / 2 / (n - ones)).alias("_w"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        ridge = np.diag([decay] * k + [0.0])
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-sum((F.col(f"z{i}") * float(w[i]) for i in range(k + 1)), F.lit(0.0))))
            one = ready.select("*", (F.col("_w") * (p - F.col("_y"))).alias("_g"), (F.col("_w") * p * (1 - p)).alias("_h"))
            got = one.agg(*(F.sum(F.col("_g") * F.col(f"z{i}")) for i in range(k + 1)), *(F.sum(F.col("_h") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs)).first()
            bend = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, got[k + 1 :], strict=True):
                bend[i, j] = bend[j, i] = v
            step = np.linalg.solve(bend + ridge + 1e-12 * np.eye(k + 1), np.array(got[: k + 1]) + ridge @ w)
            w -= step
            if abs(step).max() < tolerance:
                break
    return {c: (mean[i], deviation[i], float(w[i])) for i, c in enumerate(features)} | {"bias": (0.0, 0.0, float(w[k]))}
