"""Tree rankers of candidates by MLlib, their evaluation, and weighted metrics of scores.

A user's events are candidates, ranked by value; purchases are the truths. A candidate's error is its distance in hours to the nearest purchase of the
user, and it is right within TOLERANCE. Users go to training or evaluation by a stable hash, so no group is in both (X-32's seen stems); at most
MAX_TRAIN_ROWS training rows, picked by hash, are used, and trees are fewer than on one machine (TREES), as they are fitted over all executors.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import stable_bucket
from tidemark.operators import joins as J
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
TOLERANCE = 6.0
MAX_TRAIN_ROWS, TREES = 20_000, 40


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, event_id, rank, error (hours; null without a purchase), training, x: features of the candidate in its group."""
    ev = events(spark, sf).where("event_type <> 'purchase'")
    part = W.partitionBy("user_id")
    time = part.orderBy("t")
    ranked = J.ranked(ev, ["user_id"], F.desc("value"), F.col("event_id"))
    near = lambda h: F.count(F.lit(1)).over(time.rangeBetween(-h * HOUR, h * HOUR)).cast("double")
    gap = lambda x: F.least(F.coalesce(x / HOUR, F.lit(48.0)), F.lit(48.0))
    hour = F.expr("t div 3600000000 % 24")
    order = part.orderBy("t", "event_id")
    x = [
        1.0 / F.col("rank"),
        F.col("value") / F.max("value").over(part),
        near(6),
        near(24),
        gap(F.col("t") - F.lag("t").over(order)),
        gap(F.lead("t").over(order) - F.col("t")),
        F.sin(hour * 0.2617993878),
        F.cos(hour * 0.2617993878),
        *((F.col("event_type") == k).cast("double") for k in ("click", "view", "signup")),
    ]
    rows = ranked.withColumn("x", F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in x)))
    errors = J.asof_nearest(rows, events(spark, sf).where("event_type = 'purchase'"), "user_id", "t", "event_id")
    return errors.select("user_id", "event_id", "rank", "value", (F.abs("error") / HOUR).alias("error"), (stable_bucket(F.col("user_id").cast("string")) < 0.7).alias("training"), "x")


def taught(rows: DataFrame, *columns: Column) -> DataFrame:
    """At most MAX_TRAIN_ROWS training rows with a known error, by hash: only the hash range that holds about twice as many is sorted."""
    rows = rows.where("training and error is not null")
    h = F.shiftrightunsigned(F.xxhash64("event_id"), 1)
    if (n := rows.count()) > 2 * MAX_TRAIN_ROWS:
        rows = rows.where(h <= int(2**63 * (2 * MAX_TRAIN_ROWS / n)))
    return rows.orderBy(h, "event_id").limit(MAX_TRAIN_ROWS).select(*columns, array_to_vector("x").alias("features"))


def evaluated(scored: DataFrame) -> DataFrame:
    """By ranker: groups, hits of the best row by the model, by hand (rank 1), and of any row (oracle), and the model's median error."""
    rows = scored.where("not training and error is not null")
    part = W.partitionBy("user_id")
    first = F.row_number().over(part.orderBy(F.desc("score"), "rank"))
    marked = rows.withColumn("k", first).withColumn("best", F.min("error").over(part))
    hit = lambda c: F.round(100.0 * F.avg((c <= TOLERANCE).cast("double")), 4)
    chosen, by_hand = F.when(F.col("k") == 1, F.col("error")), F.when(F.col("rank") == 1, F.col("error"))
    one = marked.groupBy("user_id").agg(F.max(chosen).alias("model"), F.max(by_hand).alias("hand"), F.min("best").alias("oracle"))
    return one.agg(F.count("*").alias("n_groups"), hit(F.col("model")).alias("model_hit"), hit(F.col("hand")).alias("hand_hit"), hit(F.col("oracle")).alias("oracle_hit"), F.round(F.percentile("model", F.lit(0.5)), 4).alias("model_median"))


def chooser_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Random forest that tells right candidates from others, weighted by closeness; its choice against the rank's and the oracle's."""
    rows = candidates(spark, sf)
    weight = F.when(F.col("error") <= TOLERANCE, 2.0 - F.col("error") / TOLERANCE).otherwise(1.0).alias("weight")
    train = taught(rows, (F.col("error") <= TOLERANCE).cast("double").alias("label"), weight)
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return evaluated(rows.withColumn("score", -F.col("rank")))
    model = RandomForestClassifier(weightCol="weight", numTrees=TREES, maxDepth=6, seed=5).fit(train)
    scored = model.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return evaluated(scored)


def pair_ranker_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise ranker: a forest on the feature differences of a group's closest candidate and each other one (both signs); candidates are scored against their group's mean."""
    rows = candidates(spark, sf)
    part = W.partitionBy("user_id")
    closest = F.row_number().over(part.orderBy(F.col("error").asc_nulls_last(), "rank"))
    best = rows.where("error is not null").withColumn("k", closest).where("k = 1").select("user_id", F.col("x").alias("bx"), F.col("error").alias("be"), F.col("event_id").alias("best"))
    pairs = rows.join(best, "user_id").where("event_id <> best and error - be >= 1.0")
    signs = pairs.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    signs = signs.withColumn("x", F.zip_with("bx", "x", lambda a, b: (a - b) * F.col("sign")))
    train = taught(signs, ((F.col("sign") + 1) / 2).alias("label"), F.least(F.lit(2.0), 0.5 + (F.col("error") - F.col("be")) / 24.0).alias("weight"))
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return evaluated(rows.withColumn("score", -F.col("rank")))
    model = RandomForestClassifier(weightCol="weight", numTrees=TREES, maxDepth=6, seed=5).fit(train)
    mean = F.array(*(F.avg(F.col("x")[i]).over(part) for i in range(11)))
    against = rows.withColumn("d", F.zip_with("x", mean, lambda a, b: a - b)).withColumn("features", array_to_vector("d"))
    return evaluated(model.transform(against).withColumn("score", vector_to_array("probability")[1]))


def distance_ranker_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted regression trees that predict a candidate's error; the smallest predicted error is chosen."""
    rows = candidates(spark, sf)
    train = taught(rows, F.log1p("error").alias("label"))
    if not train.take(1):
        return evaluated(rows.withColumn("score", -F.col("rank")))
    model = GBTRegressor(maxIter=15, maxDepth=4, seed=5).fit(train)
    return evaluated(model.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("score", -F.col("prediction")))


def verifier_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A verifier of the first candidate of each group: a forest for being right and one for the error; what a grid of gates on both accepts, and how much of it is right."""
    rows = candidates(spark, sf)
    train = taught(rows, (F.col("error") <= TOLERANCE).cast("double").alias("label"), F.log1p("error").alias("distance"))
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        rows = rows.withColumns({"p": F.lit(0.0), "d": F.lit(0.0)})
    else:
        sure = RandomForestClassifier(numTrees=TREES, maxDepth=6, seed=5).fit(train)
        far = RandomForestRegressor(labelCol="distance", numTrees=TREES, maxDepth=6, seed=5).fit(train)
        rows = sure.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        rows = far.transform(rows).withColumn("d", F.expm1("prediction"))
    first = rows.where("rank = 1 and not training and error is not null")
    gates = [(p, d) for p in (0.3, 0.5, 0.7) for d in (6.0, 12.0, 24.0)]
    cells = [F.struct(F.lit(p).alias("least_p"), F.lit(d).alias("most_d"), F.count(F.when((F.col("p") >= p) & (F.col("d") <= d), 1)).alias("accepted"), F.count(F.when((F.col("p") >= p) & (F.col("d") <= d) & (F.col("error") <= TOLERANCE), 1)).alias("right")) for p, d in gates]
    return first.agg(F.array(*cells).alias("c"), F.count("*").alias("n")).select("n", F.explode("c").alias("c")).select("n", "c.*")


def weighted_pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted log-loss, area under the ROC curve and average precision of a score of documents; scores are counted at 1,000 levels, so what is summed in order is bounded."""
    d = table(spark, sf, "documents").select("doc_id", F.round(1 / (1 + F.exp(-(F.ln(F.col("n_chars") + 1.0) - 7.0))), 3).alias("p")).join(table(spark, sf, "labels"), "doc_id").where("quality is not null")
    d = d.select(F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999)).alias("p"), F.col("quality").cast("double").alias("y"), (1.0 + F.coalesce("toxic", F.lit(0))).alias("w"))
    levels = d.groupBy("p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    one = W.partitionBy(F.lit(0))
    down = one.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    s = levels.select("p", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(one).alias("n1"), F.sum("neg").over(one).alias("n0"))
    loss = F.sum(-(F.col("pos") * F.ln("p") + F.col("neg") * F.ln(1 - F.col("p")))) / F.max(F.col("n1") + F.col("n0"))
    auc = F.sum(F.col("pos") * (F.col("n0") - F.col("fp") + F.col("neg") / 2)) / F.max(F.col("n1") * F.col("n0"))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("n1")
    return s.agg(F.round(loss, 6).alias("log_loss"), F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("average_precision"))


QUERIES = {f.__name__: f for f in (chooser_evaluation, pair_ranker_evaluation, distance_ranker_evaluation, verifier_gate, weighted_pair_metrics)}
ORACLE = {
    "weighted_pair_metrics": """WITH d AS (SELECT least(greatest(round(1 / (1 + exp(-(ln(n_chars + 1.0::DOUBLE) - 7.0::DOUBLE))), 3), 0.001::DOUBLE), 0.999::DOUBLE) AS p, quality::DOUBLE AS y, 1.0::DOUBLE + coalesce(toxic, 0) AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
        l AS (SELECT p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM d GROUP BY 1), s AS (SELECT *, sum(pos) OVER k AS tp, sum(neg) OVER k AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0 FROM l WINDOW k AS (ORDER BY p DESC))
        SELECT round(sum(-(pos * ln(p) + neg * ln(1 - p))) / max(n1 + n0), 6) AS log_loss, round(sum(pos * (n0 - fp + neg / 2)) / max(n1 * n0), 6) AS auc, round(sum(pos * tp / (tp + fp)) / max(n1), 6) AS average_precision FROM s""",
}
