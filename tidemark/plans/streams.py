"""Queries that run as streams over all files there are, then return what was written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder
from tidemark.streaming import learning as L
from tidemark.streaming import progress as P
from tidemark.streaming import sessions as S


def ended(spark: SparkSession, sf: str, stream: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Rows that the stream has put out once it has read everything; what its watermark hasn't passed is not among them."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(S.EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    query = stream(source).writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").format("parquet").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def stream_gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = ended(spark, sf, S.gap_sessions, "user_id long, start timestamp, end timestamp, n long, total double")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 6).alias("total"))


def stream_sliding_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = ended(spark, sf, S.sliding_scores, "start timestamp, event_type string, n long, mean double")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    out = ended(spark, sf, lambda e: S.first_seen(e).select("event_id", "user_id", "value"), "event_id long, user_id long, value double")
    return out.select("event_id", "user_id", "value")


def stream_review_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks, views and signups are reviews, purchases retrain: the reviews at which a user's count since the last purchase reaches a multiple of 3."""
    key, value = P.STATE_STORE
    had = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        due = ended(spark, sf, lambda e: P.review_progress(e, 3, review="event_type in ('click', 'view', 'signup')", retrained="event_type = 'purchase'"), P.DUE)
    finally:
        spark.conf.set(key, had)
    return due.select(F.col("track").alias("user_id"), "event_id", "n", "n_retrained")


FEATURES, TARGET = ["hour", "share"], "delta"


def stream_self_learning(spark: SparkSession, sf: str) -> DataFrame:
    """A regression of value on the hour and on a share of the number, learned from the stream of events: mean, deviation and weight of each column."""
    base = f"{shared_folder(spark)}/learning-{uuid.uuid4().hex}"
    source = spark.readStream.schema(S.EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    rows = source.select(F.hour(F.col("ts")).alias("hour"), (F.col("event_id") % 17 / 16.0).alias("share"), F.col("value").alias("delta"))
    S.to_batches(rows, lambda batch, number: L.learn_on(batch, number, f"{base}/sums", FEATURES, TARGET), f"{base}/state").awaitTermination()
    model = L.weights(L.learned(spark, f"{base}/sums"), FEATURES, TARGET)
    return spark.createDataFrame([(c, round(m, 8), round(d, 6), round(w, 6)) for c, (m, d, w) in model.items()], "name string, mean double, deviation double, weight double")


QUERIES = {f.__name__: f for f in (stream_gap_sessions, stream_sliding_scores, stream_first_seen, stream_review_progress, stream_self_learning)}
MARK = "mark AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS m FROM events)"
ORACLE = {
    "stream_gap_sessions": f"""WITH {MARK}, x AS (SELECT user_id, epoch_us(ts) AS t, value, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x),
        g AS (SELECT user_id, min(t) AS start, max(t) + 43200000000 AS end, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s) SELECT g.* FROM g, mark WHERE g.end <= m""",
    "stream_sliding_scores": f"""WITH {MARK}, w AS (SELECT (epoch_us(ts) // 3600000000 - k) * 3600000000 AS start, event_type, value FROM events, (SELECT unnest(range(6)) AS k))
        SELECT start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM w, mark WHERE start + 21600000000 <= m GROUP BY 1, 2""",
    "stream_review_progress": f"""WITH {MARK}, e AS (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'), r AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n_retrained FROM e),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, n_retrained ORDER BY t, event_id) AS n FROM r WHERE event_type <> 'purchase') SELECT user_id, event_id, n, n_retrained::BIGINT AS n_retrained FROM k, mark WHERE n % 3 = 0 AND t // 1000 < m // 1000""",
    "stream_self_learning": """WITH r AS (SELECT hour(ts)::DOUBLE AS hour, round((event_id % 17)::DOUBLE / 16.0::DOUBLE, 4) AS share, round(value, 4) AS delta FROM events),
        m AS (SELECT count(*) AS n, avg(hour) AS ma, avg(share) AS mb, avg(delta) AS my, stddev_pop(hour) AS sa, stddev_pop(share) AS sb, stddev_pop(delta) AS sy, covar_pop(hour, share) AS ab, covar_pop(hour, delta) AS ay, covar_pop(share, delta) AS sy2 FROM r),
        z AS (SELECT *, n * ab / (sa * sb) AS q, n * ay / sa AS ca, n * sy2 / sb AS cb, n + 1 AS p FROM m)
        SELECT unnest(['hour', 'share', 'delta']) AS name, unnest([round(ma, 8), round(mb, 8), round(my, 8)]) AS mean, unnest([round(sa, 6), round(sb, 6), round(sy, 6)]) AS deviation, unnest([round((p * ca - q * cb) / (p * p - q * q), 6), round((p * cb - q * ca) / (p * p - q * q), 6), 0]) AS weight FROM z""",
    "stream_first_seen": "SELECT event_id, user_id, value FROM events",
}
