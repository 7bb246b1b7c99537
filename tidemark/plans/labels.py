"""Queries on labels, rankers' choices and markers: collapse, sanitising, lanes, rescues, metrics, context frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import num as N
from tidemark.operators import joins as J
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"
#: Roles of a lane, in the order of its columns.
ROLES = ("click", "view", "signup", "purchase", "error")


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def label_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a user's purchases, cut at gaps of more than a day: user_id, cluster, support, centre (median hour)."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf).where("event_type = 'purchase'").withColumn("cut", F.coalesce((F.col("t") - F.lag("t").over(w) > 24 * HOUR).cast("long"), F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "cluster").agg(F.count("*").alias("support"), F.round(F.median(F.col("t") / HOUR), 4).alias("centre"))


def primary_target(spark: SparkSession, sf: str) -> DataFrame:
    """One target per user: the earliest cluster with at least half the support of the largest; with the counts it rests on."""
    rows = label_clusters(spark, sf)
    most = F.max("support").over(W.partitionBy("user_id"))
    rows = rows.withColumn("enough", F.col("support") >= F.greatest(F.lit(1), F.round(most * 0.5).cast("long")))
    return rows.groupBy("user_id").agg(F.min(F.when(F.col("enough"), F.col("centre"))).alias("target"), F.sum("support").alias("n_used"), F.count("*").alias("n_clusters"))


def sanitise_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by what became of them: without a positive size, in the last part of their order, or kept."""
    li = table(spark, sf, "lineitem").withColumn("last", F.max("l_linenumber").over(W.partitionBy("l_orderkey")))
    reason = F.when(F.col("l_discount") <= 0, "not_positive").when((F.col("last") > 1) & (F.col("l_linenumber") >= F.col("last")), "tail").otherwise("kept")
    return li.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def bar_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a user as lanes: bounds in hours and one energy per role; 0 where a role is missing."""
    day = F.expr("t div 86400000000")
    rows = events(spark, sf).groupBy("user_id", day.alias("day")).pivot("event_type", list(ROLES)).agg(F.round(F.sum("value"), 4))
    return rows.select("user_id", "day", (F.col("day") * 24).alias("start_hour"), (F.col("day") * 24 + 24).alias("end_hour"), *(F.coalesce(r, F.lit(0.0)).alias(r) for r in ROLES))


def normalised_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Stored payloads as summary rows: the number under the first key that holds a positive one, else the event's value; status by what was found."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    rows = table(spark, sf, "events").select("event_id", k.alias("k"), "value")
    status = F.when(F.col("k") > 0, "payload").when(F.col("value") > 0, "value").otherwise("none")
    return rows.select("event_id", F.coalesce(N.first_positive(F.col("k"), F.col("value")), F.lit(0.0)).alias("pick"), status.alias("status"))


def rescue_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose strongest purchase is later than their strongest click: rescues and regressions by whether it is nearer the reference, their first sign-up."""
    ev = events(spark, sf)

    def best(role: str, name: str) -> DataFrame:
        return J.ranked(ev.where(F.col("event_type") == role), ["user_id"], F.desc("value"), F.col("event_id")).where("rank = 1").select("user_id", F.col("t").alias(name))

    rows = best("click", "a").join(best("purchase", "b"), "user_id").join(ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("ref")), "user_id").where(F.col("b") > F.col("a") + HOUR)
    gain = F.abs(F.col("a") - F.col("ref")) - F.abs(F.col("b") - F.col("ref"))
    kind = F.when(gain > HOUR, "rescue").when(gain < -HOUR, "regression").otherwise("unchanged")
    rows = rows.select("user_id", kind.alias("kind"), (F.abs(gain) / HOUR).alias("hours"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("hours"), "mean_hours"))


def body_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A line's metrics from nested fallbacks: darkness (largest of its shares), contrast with the line before, sustain, and their weighted score."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.clip01(F.col("l_quantity") / 50).alias("q"), N.clip01(F.col("l_extendedprice") / 100_000).alias("p"), N.clip01(F.col("l_discount") * 10).alias("d"))
    li = li.withColumn("before", F.lag("q").over(w))
    darkness, contrast = F.greatest("q", "p"), F.greatest(F.coalesce(F.col("q") - F.col("before"), F.lit(0.0)), F.lit(0.0))
    sustain = F.coalesce(1 - F.abs(F.col("q") - F.col("before")), N.clip01(0.8 * F.col("p") + 0.2 * F.col("d")))
    score = N.clip01(0.5 * darkness + 0.3 * contrast + 0.2 * sustain)
    return li.select("l_orderkey", "l_linenumber", *(F.round(x, 10).alias(c) for c, x in (("darkness", darkness), ("contrast", contrast), ("sustain", sustain), ("score", score))))


def ranker_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: the lines chosen by hand-made score, by model and by nearness to the truth, in one pass, and whether they are the same."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("truth")), F.col("l_orderkey") == F.col("o_orderkey"))
    line, model = F.col("l_linenumber"), F.col("l_quantity") * (1 - F.col("l_discount"))
    pick = lambda x, name: F.max_by(F.struct(line.alias("line"), F.col("l_extendedprice").alias("x")), F.struct(x, -line)).alias(name)
    rows = li.groupBy("l_orderkey").agg(pick(F.col("l_extendedprice"), "hand"), pick(F.round(model, 6), "model"), pick(-F.round(F.abs(F.col("l_extendedprice") - F.col("truth")), 4), "closest"))
    return rows.select("l_orderkey", *(F.col(f"{c}.line").alias(c) for c in ("hand", "model", "closest")), (F.col("hand.line") == F.col("closest.line")).alias("hand_closest"), (F.col("model.line") == F.col("closest.line")).alias("model_closest"))


def chooser_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How often either choice of ranker_comparison is the closest candidate."""
    rows = ranker_comparison(spark, sf)
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.agg(F.count("*").alias("n"), r6(share("hand_closest"), "hand"), r6(share("model_closest"), "model"))


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    """Label events with a label of the domain, numbered per user as they are appended; others are turned away (n_rejected)."""
    ok = F.col("event_type").isin("click", "purchase", "signup")
    return events(spark, sf).groupBy("user_id").agg(F.count_if(ok).alias("n_labels"), F.count_if(~ok).alias("n_rejected"), F.max(F.when(ok, F.col("t"))).alias("last_t"))


def retrain_due(spark: SparkSession, sf: str) -> DataFrame:
    """The events at which a user's count of reviews reaches a multiple of 5."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf).where("event_type <> 'error'").withColumn("n", F.row_number().over(w).cast("long"))
    return rows.where("n % 5 = 0").select("event_id", "user_id", "n")


def gate_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the gate's answer from their labels: held without one, else by the first reason; counts by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "hold_unreviewed").when(F.col("toxic") == 1, "hold_toxic").when(F.col("quality") == 0, "hold_quality").when(F.col("n_chars") < 200, "hold_short").otherwise("ready")
    return docs.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


def zero_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: the crossing of the value 100 that is nearest to the time of the largest rise; ties by closeness to 100, then time."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf).withColumn("x", F.round(F.col("value") - 100, 4)).withColumn("x0", F.lag("x").over(w)).where("x0 is not null")
    rise = J.ranked(rows, ["user_id"], F.desc(F.round(F.col("x") - F.col("x0"), 4)), F.col("t"), F.col("event_id")).where("rank = 1").select("user_id", F.col("t").alias("attack"))
    crossed = rows.where("x = 0 or x0 = 0 or signum(x) <> signum(x0)").join(rise, "user_id")
    return J.ranked(crossed, ["user_id"], F.abs(F.col("t") - F.col("attack")), F.round(F.abs("x") + F.abs("x0"), 4), F.col("t"), F.col("event_id")).where("rank = 1").select("user_id", "event_id", (F.col("t") - F.col("attack")).alias("shift"))


def peak_density(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and week: local peaks of 100 or more over the seven that are expected, at most 1."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    peak = (F.col("value") >= 100) & (F.col("value") > F.col("a")) & (F.col("value") >= F.col("b"))
    return rows.groupBy("user_id", F.expr("t div 604800000000").alias("week")).agg(r6(F.least(F.count_if(peak) / 7, F.lit(1.0)), "density"))


_FUNCTIONS = (label_clusters, primary_target, sanitise_reasons, bar_lanes, normalised_summary, rescue_analysis, body_metrics, ranker_comparison, chooser_summary, label_events, retrain_due, gate_sync, zero_crossings, peak_density)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CLUSTERS = f"""{EV}, g AS (SELECT *, coalesce((t - lag(t) OVER w > 86400000000)::INT, 0) AS cut FROM ev WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    c AS (SELECT user_id, t, sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g),
    k AS (SELECT user_id, cluster, count(*)::BIGINT AS support, round(median(t / 3600000000.0::DOUBLE), 4) AS centre FROM c GROUP BY 1, 2)"""
_PICKS = """p AS (SELECT l_orderkey, l_linenumber AS line, l_extendedprice AS x, round(l_quantity * (1 - l_discount), 6) AS m, round(abs(l_extendedprice - o_totalprice), 4) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x DESC, line) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, line) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY e, line) AS c FROM p),
    o AS (SELECT l_orderkey, max(line) FILTER (WHERE a = 1) AS hand, max(line) FILTER (WHERE b = 1) AS model, max(line) FILTER (WHERE c = 1) AS closest FROM r GROUP BY 1)"""
ORACLE = {
    "label_clusters": f"WITH {_CLUSTERS} SELECT * FROM k",
    "primary_target": f"""WITH {_CLUSTERS}, e AS (SELECT *, support >= greatest(1, round(max(support) OVER (PARTITION BY user_id) * 0.5::DOUBLE)::BIGINT) AS enough FROM k)
        SELECT user_id, min(centre) FILTER (WHERE enough) AS target, sum(support)::BIGINT AS n_used, count(*)::BIGINT AS n_clusters FROM e GROUP BY 1""",
    "sanitise_reasons": """WITH l AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
        SELECT CASE WHEN l_discount <= 0 THEN 'not_positive' WHEN last > 1 AND l_linenumber >= last THEN 'tail' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM l GROUP BY 1""",
    "bar_lanes": f"WITH {EV} SELECT user_id, t // 86400000000 AS day, (t // 86400000000) * 24 AS start_hour, (t // 86400000000) * 24 + 24 AS end_hour, {', '.join(f"coalesce(round(sum(value) FILTER (WHERE event_type = '{r}'), 4), 0) AS {r}" for r in ROLES)} FROM ev GROUP BY user_id, t // 86400000000",
    "normalised_summary": """WITH e AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events)
        SELECT event_id, CASE WHEN k > 0 THEN k WHEN value > 0 THEN value ELSE 0 END AS pick, CASE WHEN k > 0 THEN 'payload' WHEN value > 0 THEN 'value' ELSE 'none' END AS status FROM e""",
    "rescue_analysis": f"""WITH {EV}, b AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM ev), s AS (SELECT user_id, min(t) AS ref FROM ev WHERE event_type = 'signup' GROUP BY 1),
        j AS (SELECT x.user_id, abs(x.t - ref) - abs(y.t - ref) AS gain FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'purchase' AND x.k = 1 AND y.k = 1 JOIN s ON s.user_id = x.user_id WHERE y.t > x.t + 3600000000)
        SELECT CASE WHEN gain > 3600000000 THEN 'rescue' WHEN gain < -3600000000 THEN 'regression' ELSE 'unchanged' END AS kind, count(*)::BIGINT AS n, round(avg(abs(gain) / 3600000000.0::DOUBLE), 6) AS mean_hours FROM j GROUP BY 1""",
    "body_metrics": """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(l_quantity / 50, 1), 0)::DOUBLE AS q, greatest(least(l_extendedprice / 100000, 1), 0)::DOUBLE AS p, greatest(least(l_discount * 10, 1), 0)::DOUBLE AS d FROM lineitem),
        b AS (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q0 FROM a), c AS (SELECT l_orderkey, l_linenumber, greatest(q, p) AS darkness, greatest(coalesce(q - q0, 0), 0) AS contrast, coalesce(1 - abs(q - q0), least(0.8::DOUBLE * p + 0.2::DOUBLE * d, 1)) AS sustain FROM b)
        SELECT l_orderkey, l_linenumber, round(darkness, 10) AS darkness, round(contrast, 10) AS contrast, round(sustain, 10) AS sustain, round(least(0.5::DOUBLE * darkness + 0.3::DOUBLE * contrast + 0.2::DOUBLE * sustain, 1), 10) AS score FROM c""",
    "ranker_comparison": f"WITH {_PICKS} SELECT *, hand = closest AS hand_closest, model = closest AS model_closest FROM o",
    "chooser_summary": f"WITH {_PICKS} SELECT count(*)::BIGINT AS n, round(avg((hand = closest)::INT), 6) AS hand, round(avg((model = closest)::INT), 6) AS model FROM o",
    "label_events": f"""WITH {EV} SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'signup'))::BIGINT AS n_labels, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase', 'signup'))::BIGINT AS n_rejected,
        max(t) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')) AS last_t FROM ev GROUP BY 1""",
    "retrain_due": f"WITH {EV}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev WHERE event_type <> 'error') SELECT * FROM n WHERE n % 5 = 0",
    "gate_sync": """SELECT source, CASE WHEN quality IS NULL THEN 'hold_unreviewed' WHEN toxic = 1 THEN 'hold_toxic' WHEN quality = 0 THEN 'hold_quality' WHEN n_chars < 200 THEN 'hold_short' ELSE 'ready' END AS reason, count(*)::BIGINT AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "zero_crossings": f"""WITH {EV}, x AS (SELECT *, round(value - 100, 4) AS x FROM ev), y AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id) AS x0 FROM x) WHERE x0 IS NOT NULL),
        a AS (SELECT * FROM (SELECT user_id, t AS attack, row_number() OVER (PARTITION BY user_id ORDER BY round(x - x0, 4) DESC, t, event_id) AS k FROM y) WHERE k = 1),
        c AS (SELECT y.user_id, event_id, t - attack AS shift, row_number() OVER (PARTITION BY y.user_id ORDER BY abs(t - attack), round(abs(x) + abs(x0), 4), t, event_id) AS k FROM y JOIN a USING (user_id) WHERE x = 0 OR x0 = 0 OR sign(x) <> sign(x0)) SELECT user_id, event_id, shift FROM c WHERE k = 1""",
    "peak_density": f"""WITH {EV}, p AS (SELECT user_id, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT user_id, t // 604800000000 AS week, round(least(count(*) FILTER (WHERE value >= 100 AND value > a AND value >= b) / 7.0::DOUBLE, 1), 6) AS density FROM p GROUP BY 1, 2""",
}
