"""A model that learns on from a log of corrections: sums that add up, kept in a table that each micro-batch replaces as a whole.

The model is a ridge regression on standardised features. All it needs of the corrections are their number, the sums of features and target and of
their products (exact decimals, so the order of rows doesn't matter), which are added batch by batch. The table also holds the number of the last batch in
it: a batch that is run again after a failure changes nothing, as its sums and its number came in by one replacement or not at all.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import read_whole, replace_whole

SUMS = "name string, total decimal(38,8), batch long"
#: Features and targets count with so many decimals; products then have twice as many.
EXACT = "decimal(14,4)"


def sums_of(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """name, total: n, the sums of features and target, and of the products of any two of them; rows with a null or infinite value are left out."""
    every = [*features, target]
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < 1e9) for c in every]
    used = rows.where(F.array_min(F.array(*ok))).select(*(F.col(c).cast(EXACT).alias(c) for c in every))
    products = {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(every) for b in every[i:]}
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,8)")
    one = used.agg(F.count("*").cast("decimal(38,8)").alias("n"), *(total(F.col(c)).alias(c) for c in every), *(total(x).alias(k) for k, x in products.items()))
    names = ["n", *every, *products]
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("total")) for k in names))))


def learn_on(batch: DataFrame, number: int, path: str, features: list[str], target: str) -> None:
    """Adds a batch's sums to the table at `path`, once however often it is called with the same number."""
    spark = batch.sparkSession
    had = read_whole(spark, path, SUMS)
    last = had.agg(F.max("batch")).first()[0]
    if last is not None and number <= last:
        return
    both = had.select("name", "total").unionByName(sums_of(batch, features, target)).groupBy("name").agg(F.sum("total").cast("decimal(38,8)").alias("total"))
    replace_whole(both.withColumn("batch", F.lit(number).cast("long")).coalesce(1), path)


def learned(spark: SparkSession, path: str) -> DataFrame:
    """name, total of all batches so far."""
    return read_whole(spark, path, SUMS).select("name", "total")


def weights(sums: DataFrame, features: list[str], target: str, ridge: float = 1.0) -> dict[str, tuple[float, float, float]]:
    """(mean, standard deviation, weight) of each feature, and of `target` (mean, deviation, 0), by sums; features that never change have weight 0."""
    total = {r.name: r.total for r in sums.collect()}  # one row for each pair of columns
    n = total.get("n", Decimal(0))
    if not n:
        return {c: (0.0, 0.0, 0.0) for c in (*features, target)}
    every = [*features, target]
    mean = {c: total[c] / n for c in every}
    product = lambda a, b: total[f"{a}*{b}"] if f"{a}*{b}" in total else total[f"{b}*{a}"]
    cov = np.array([[float(product(a, b) / n - mean[a] * mean[b]) for b in every] for a in every])
    deviation = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(deviation > 1e-6, deviation, 1.0)[:-1]
    k = len(features)
    z = cov[:k, :k] / np.outer(scale, scale) * float(n) + ridge * np.eye(k)
    w = np.linalg.solve(z, cov[:k, k] / scale * float(n))
    return {c: (float(mean[c]), float(deviation[i]), float(w[i]) if i < k else 0.0) for i, c in enumerate(every)}


def corrected(rows: DataFrame, model: dict[str, tuple[float, float, float]], features: list[str], target: str, most: float | None = None, name: str = "correction") -> DataFrame:
    """The rows with the predicted target, held within `most` either way."""
    out = F.lit(model[target][0])
    for c in features:
        mean, deviation, w = model[c]
        out = out + w * (F.col(c).cast("double") - mean) / (deviation if deviation > 1e-6 else 1.0)
    return rows.withColumn(name, out if most is None else F.greatest(F.lit(-most), F.least(F.lit(most), out)))
