"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.num import rank_norm
from tidemark.operators import joins as J
from tidemark.operators import windows as V
from tidemark.sources.tables import events

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"
WIN = "WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"
USER = ["user_id"]


def w():
    return V.ordered(USER, "t", "event_id")


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def positive_delta(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", r6(V.positive_delta("value", w(), 4), "delta"))


def flux_like(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", r6(V.flux("value", w()), "flux"))


def moving_average_shrink(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", r6(V.mean_around("value", w(), 3), "mean"))


def moving_average_zero_pad(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", r6(V.mean_around("value", w(), 3, pad=True), "mean"))


def pre_post_means(spark: SparkSession, sf: str) -> DataFrame:
    pre, post = V.before_after("value", w(), 5)
    return events(spark, sf).select("event_id", r6(pre, "pre"), r6(post, "post"), r6(post - pre, "contrast"))


def days(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, day (from the first), total, one mean per role."""
    ev = events(spark, sf).withColumn("day", F.expr("t div 86400000000"))
    mean = [F.coalesce(F.avg(F.when(F.col("event_type") == r, F.col("value"))), F.lit(0.0)).alias(r) for r in ("click", "view", "purchase")]
    return ev.groupBy("user_id", "day").agg(F.sum("value").alias("total"), *mean)


def transition_score(spark: SparkSession, sf: str) -> DataFrame:
    """Days scored by the rise from the four before to the four from it, the slope over these, and the phase of the day."""
    d = V.ordered(USER, "day")
    pre, post = V.before_after("total", d, 4)
    score = 0.6 * (post - pre) + 0.3 * V.slope("total", "day", d.rowsBetween(-4, 3)) + 0.1 * F.when(F.col("day") % 8 == 0, 100.0).when(F.col("day") % 4 == 0, 50.0).otherwise(0.0)
    return days(spark, sf).select("user_id", "day", F.round(score + 1e-7, 4).alias("score"))


def novelty_l2(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the mean role vectors of the four days before and the four from the day on."""
    d = V.ordered(USER, "day")
    gaps = [(lambda a, b: (b - a) * (b - a))(*V.before_after(r, d, 4)) for r in ("click", "view", "purchase")]
    return days(spark, sf).select("user_id", "day", F.round(F.sqrt(sum(gaps[1:], gaps[0])), 4).alias("novelty"))


def group_context_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per event: score percentile in the group, gaps to the neighbours (a day at the ends), density within 6 and 24 hours."""
    ranks = W.partitionBy("user_id").orderBy("value", "event_id")
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    time = W.partitionBy("user_id").orderBy("t")
    near = lambda h: F.count(F.lit(1)).over(time.rangeBetween(-h * HOUR, h * HOUR))
    return events(spark, sf).select(
        "event_id",
        r6(F.when(n > 1, (F.row_number().over(ranks) - 1) / (n - 1)).otherwise(1.0), "percentile"),
        F.coalesce(F.col("t") - F.lag("t").over(w()), F.lit(24 * HOUR)).alias("gap_before"),
        F.coalesce(F.lead("t").over(w()) - F.col("t"), F.lit(24 * HOUR)).alias("gap_after"),
        near(6).alias("n_6h"),
        near(24).alias("n_24h"),
    )


def range_max(spark: SparkSession, sf: str) -> DataFrame:
    time = W.partitionBy("user_id").orderBy("t").rangeBetween(-12 * HOUR, 12 * HOUR)
    return events(spark, sf).select("event_id", F.max("value").over(time).alias("most"))


def score_margin(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_margin(events(spark, sf), USER, "value", "event_id").select("user_id", "event_id", r6(F.col("margin"), "margin"))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("flag", F.col("value") >= 50)


def bool_runs(spark: SparkSession, sf: str) -> DataFrame:
    return V.runs(flagged(spark, sf), USER, ["t", "event_id"], "flag").select("user_id", "start", "end")


def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of high values over the number of rows; 0 without one."""
    best = V.runs(flagged(spark, sf), USER, ["t", "event_id"], "flag").groupBy("user_id").agg(F.max("length").alias("longest"))
    n = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.join(best, "user_id", "left").select("user_id", r6(F.coalesce("longest", F.lit(0)) / F.col("n"), "share"))


def pct_normalise(spark: SparkSession, sf: str) -> DataFrame:
    part = W.partitionBy("user_id")
    return events(spark, sf).select("event_id", r6(V.percentile_normalised("value", part, 0.08, 0.94), "p8_94"), r6(V.percentile_normalised("value", part, 0.1, 0.9), "p10_90"))


def local_peaks(spark: SparkSession, sf: str) -> DataFrame:
    floor = F.percentile("value", F.lit(0.92)).over(W.partitionBy("user_id"))
    return V.peaks(events(spark, sf), USER, ["t", "event_id"], "value", floor).select("event_id", "user_id", "value")


def first_top_event(spark: SparkSession, sf: str) -> DataFrame:
    """First event of a user with at least 0.8 of the largest value."""
    top = events(spark, sf).withColumn("most", F.max("value").over(W.partitionBy("user_id"))).where(F.col("value") >= 0.8 * F.col("most"))
    first = F.min(F.struct("t", "event_id")).alias("f")
    return top.groupBy("user_id").agg(first).select("user_id", F.col("f.event_id").alias("event_id"), F.col("f.t").alias("t"))


def half_double_time(spark: SparkSession, sf: str) -> DataFrame:
    """Times at half tempo (every second), at double tempo (with midpoints) and at off phase (midpoints only): counts and sums."""
    ev = events(spark, sf).select("user_id", "event_id", "t", (F.row_number().over(w()) - 1).alias("i"), F.floor((F.col("t") + F.lead("t").over(w())) / 2).alias("mid"))
    return ev.groupBy("user_id").agg(F.count(F.when(F.col("i") % 2 == 0, 1)).alias("n_half"), F.max(F.when(F.col("i") % 2 == 0, F.col("t"))).alias("last_half"), (F.count("*") + F.count("mid")).alias("n_double"), F.min("mid").alias("first_off"))


def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sessions(events(spark, sf), USER, "t", "event_id", 12 * HOUR)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.countDistinct("event_type").alias("roles"), r6(F.stddev_pop("value"), "spread"))


def local_first_strong(spark: SparkSession, sf: str) -> DataFrame:
    """For each signup: first event from 6 hours before to 12 after whose value reaches the larger of the 72nd percentile and 0.56 of the largest there."""
    ev = events(spark, sf)
    around = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), (F.col("t") - 6 * HOUR).alias("start"), (F.col("t") + 12 * HOUR).alias("end"))
    near = J.in_intervals(ev.select("user_id", "t", "event_id", "value"), around, "user_id", "t", "start", "end", 24 * HOUR, closed=True)
    here = W.partitionBy("signup")
    least = F.greatest(F.percentile("value", F.lit(0.72)).over(here), 0.56 * F.max("value").over(here))
    strong = near.withColumn("least", least).where("value >= least - 1e-9")
    return strong.groupBy("signup").agg(F.min(F.struct("t", "event_id")).alias("f")).select(F.col("signup").alias("event_id"), F.col("f.event_id").alias("first_id"))


def lattice_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Events within 2 hours of a 6-hour slot: the nearest of each slot (ties: the earlier)."""
    slot = F.expr("(t + 3 * 3600000000) div (6 * 3600000000)")
    off = F.abs(F.col("t") - F.col("slot") * 6 * HOUR)
    near = events(spark, sf).withColumn("slot", slot).withColumn("off", off).where(F.col("off") <= 2 * HOUR)
    return near.groupBy("user_id", "slot").agg(F.min(F.struct("off", "t", "event_id")).alias("b")).select("user_id", "slot", F.col("b.event_id").alias("event_id"), F.col("b.off").alias("off"))


def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a fixed period that lie empty between a user's occupied ones."""
    slots = events(spark, sf).select("user_id", F.expr("t div (6 * 3600000000)").alias("slot")).distinct()
    nxt = slots.withColumn("next", F.lead("slot").over(W.partitionBy("user_id").orderBy("slot"))).where("next > slot + 1")
    return nxt.select("user_id", F.explode(F.sequence(F.col("slot") + 1, F.col("next") - 1)).alias("slot"))


def rank_norm_score(spark: SparkSession, sf: str) -> DataFrame:
    whole = W.partitionBy("user_id")
    a = rank_norm(whole.orderBy("value", "event_id"), whole, F.col("value"))
    b = rank_norm(whole.orderBy("t", "event_id"), whole, F.col("t"))
    return events(spark, sf).select("event_id", a.alias("a"), b.alias("b")).select("event_id", r6(0.7 * F.col("a") + 0.3 * F.col("b") + 1e-9, "score"), (F.col("a") >= 0.5).alias("valid"))


def autocorr_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation of daily totals (mean removed) at a lag of 6 to 8 days, the largest, over that at lag 0."""
    d = V.ordered(USER, "day")
    x = days(spark, sf).withColumn("x", F.col("total") - F.avg("total").over(W.partitionBy("user_id")))
    lags = x.select("user_id", "x", *(F.lag("x", k).over(d).alias(f"l{k}") for k in (6, 7, 8)))
    out = lags.groupBy("user_id").agg(F.sum(F.col("x") * F.col("x")).alias("z"), *(F.coalesce(F.sum(F.col("x") * F.col(f"l{k}")), F.lit(0.0)).alias(f"s{k}") for k in (6, 7, 8)))
    return out.select("user_id", F.round(F.when(F.col("z") > 0, F.greatest("s6", "s7", "s8") / F.col("z")).otherwise(0.0), 5).alias("autocorr"))


def phase_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hour of a six-hour period with the largest mean value; the first on a tie."""
    by = events(spark, sf).groupBy("user_id", F.expr("t div 3600000000 % 6").alias("phase")).agg(F.round(F.avg("value"), 6).alias("m"))
    return by.groupBy("user_id").agg(F.max(F.struct("m", (-F.col("phase")).alias("p"))).alias("b")).select("user_id", (-F.col("b.p")).alias("phase"), F.col("b.m").alias("mean"))


def slot_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a user's six-hour slots, from first to last event, with an event within an hour of the slot's start."""
    ev = events(spark, sf).withColumn("slot", F.expr("(t + 3 * 3600000000) div (6 * 3600000000)")).withColumn("off", F.abs(F.col("t") - F.col("slot") * 6 * HOUR))
    return ev.groupBy("user_id").agg(r6(F.countDistinct(F.when(F.col("off") <= HOUR, F.col("slot"))) / (F.max("slot") - F.min("slot") + 1), "occupancy"))


def boost_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose next five values have at least twice the median of the five before."""
    pre, post = F.percentile("value", F.lit(0.5)).over(w().rowsBetween(-5, -1)), F.percentile("value", F.lit(0.5)).over(w().rowsBetween(0, 4))
    return events(spark, sf).select("event_id", pre.alias("pre"), post.alias("post")).where("pre > 0 and post >= 2 * pre").select("event_id", r6(F.col("post") / F.col("pre"), "ratio"))


QUERIES = {f.__name__: f for f in (positive_delta, flux_like, moving_average_shrink, moving_average_zero_pad, pre_post_means, transition_score, novelty_l2, group_context_features, range_max, score_margin, bool_runs, longest_run, pct_normalise, local_peaks, first_top_event, half_double_time, gap_sessions, local_first_strong, lattice_snap, gap_fill, rank_norm_score, autocorr_lag, phase_search, slot_occupancy, boost_events)}
DAYS = EV + ", days AS (SELECT user_id, t // 86400000000 AS day, sum(value) AS total, " + ", ".join(f"coalesce(avg(CASE WHEN event_type = '{r}' THEN value END), 0) AS {r}" for r in ("click", "view", "purchase")) + " FROM ev GROUP BY 1, 2)"
PRE, POST = "ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING", "ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING"
D = "OVER (PARTITION BY user_id ORDER BY day "
ORACLE = {
    "positive_delta": f"WITH {EV} SELECT event_id, round(greatest(value - coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), value), 0), 6) AS delta FROM ev",
    "flux_like": f"WITH {EV} SELECT event_id, round(greatest(value - coalesce(lag(value) OVER w, value), 0), 6) AS flux FROM ev {WIN}",
    "moving_average_shrink": f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM ev",
    "moving_average_zero_pad": f"WITH {EV} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS mean FROM ev",
    "pre_post_means": f"""WITH {EV}, x AS (SELECT event_id, coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 0) AS b FROM ev)
        SELECT event_id, round(a, 6) AS pre, round(b, 6) AS post, round(b - a, 6) AS contrast FROM x""",
    "transition_score": f"""WITH {DAYS} SELECT user_id, day, round(0.6::DOUBLE * (avg(total) {D} {POST}) - coalesce(avg(total) {D} {PRE}), 0)) + 0.3::DOUBLE * coalesce(regr_slope(total, day) {D} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 0)
        + 0.1::DOUBLE * CASE WHEN day % 8 = 0 THEN 100 WHEN day % 4 = 0 THEN 50 ELSE 0 END + 1e-7::DOUBLE, 4) AS score FROM days""",
    "novelty_l2": f"""WITH {DAYS} SELECT user_id, day, round(sqrt({' + '.join(f'pow(avg({r}) {D} {POST}) - coalesce(avg({r}) {D} {PRE}), 0), 2)' for r in ('click', 'view', 'purchase'))}), 4) AS novelty FROM days""",
    "group_context_features": f"""WITH {EV} SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) > 1 THEN (row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY user_id) - 1) ELSE 1 END, 6)::DOUBLE AS percentile,
        coalesce(t - lag(t) OVER w, 86400000000) AS gap_before, coalesce(lead(t) OVER w - t, 86400000000) AS gap_after, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) AS n_6h,
        count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) AS n_24h FROM ev {WIN}""",
    "range_max": f"WITH {EV} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING) AS most FROM ev",
    "score_margin": f"WITH {EV}, r AS (SELECT *, row_number() OVER k AS n, coalesce(lead(value) OVER k, 0) AS nxt FROM ev WINDOW k AS (PARTITION BY user_id ORDER BY value DESC, event_id)) SELECT user_id, event_id, round(value - nxt, 6) AS margin FROM r WHERE n = 1",
    "bool_runs": f"""WITH {EV}, i AS (SELECT user_id, value, row_number() OVER w - 1 AS i FROM ev {WIN}), g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM i WHERE value >= 50) SELECT user_id, min(i) AS start, max(i) + 1 AS end FROM g GROUP BY user_id, g""",
    "longest_run": f"""WITH {EV}, i AS (SELECT user_id, value, row_number() OVER w - 1 AS i FROM ev {WIN}), g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM i WHERE value >= 50), l AS (SELECT user_id, g, count(*) AS c FROM g GROUP BY 1, 2),
        m AS (SELECT user_id, max(c) AS c FROM l GROUP BY 1), n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id, round(coalesce(c, 0)::DOUBLE / n, 6) AS share FROM n LEFT JOIN m USING (user_id)""",
    "pct_normalise": f"""WITH {EV}, q AS (SELECT user_id, quantile_cont(value, 0.08) AS a, quantile_cont(value, 0.94) AS b, quantile_cont(value, 0.1) AS c, quantile_cont(value, 0.9) AS d FROM ev GROUP BY 1)
        SELECT event_id, round(CASE WHEN b > a THEN least(greatest((value - a) / (b - a), 0), 1) ELSE 0 END, 6)::DOUBLE AS p8_94, round(CASE WHEN d > c THEN least(greatest((value - c) / (d - c), 0), 1) ELSE 0 END, 6)::DOUBLE AS p10_90 FROM ev JOIN q USING (user_id)""",
    "local_peaks": f"WITH {EV}, q AS (SELECT user_id, quantile_cont(value, 0.92) AS f FROM ev GROUP BY 1), x AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev {WIN}) SELECT event_id, user_id, value FROM x JOIN q USING (user_id) WHERE value > a AND value >= b AND value >= f",
    "first_top_event": f"WITH {EV}, x AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM x WHERE value >= 0.8::DOUBLE * m) SELECT user_id, event_id, t FROM r WHERE k = 1",
    "half_double_time": f"""WITH {EV}, x AS (SELECT user_id, t, row_number() OVER w - 1 AS i, (t + lead(t) OVER w) // 2 AS mid FROM ev {WIN})
        SELECT user_id, count(CASE WHEN i % 2 = 0 THEN 1 END)::BIGINT AS n_half, max(CASE WHEN i % 2 = 0 THEN t END) AS last_half, (count(*) + count(mid))::BIGINT AS n_double, min(mid) AS first_off FROM x GROUP BY 1""",
    "gap_sessions": f"""WITH {EV}, x AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200000000 THEN 1 ELSE 0 END AS c FROM ev {WIN}), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM x)
        SELECT user_id, session, count(*)::BIGINT AS n, min(t) AS start, max(t) AS end, count(DISTINCT event_type)::BIGINT AS roles, round(stddev_pop(value), 6) AS spread FROM s GROUP BY 1, 2""",
    "local_first_strong": f"""WITH {EV}, n AS (SELECT s.event_id, e.event_id AS other, e.t, e.value FROM ev s JOIN ev e ON s.user_id = e.user_id AND e.t BETWEEN s.t - 6 * 3600000000 AND s.t + 12 * 3600000000 WHERE s.event_type = 'signup'),
        h AS (SELECT event_id, greatest(quantile_cont(value, 0.72), 0.56::DOUBLE * max(value)) AS least FROM n GROUP BY 1), r AS (SELECT event_id, other, row_number() OVER (PARTITION BY event_id ORDER BY t, other) AS k FROM n JOIN h USING (event_id) WHERE value >= least - 1e-9::DOUBLE)
        SELECT event_id, other AS first_id FROM r WHERE k = 1""",
    "lattice_snap": f"""WITH {EV}, x AS (SELECT *, (t + 10800000000) // 21600000000 AS slot FROM ev), y AS (SELECT *, abs(t - slot * 21600000000) AS off FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY off, t, event_id) AS k FROM y WHERE off <= 7200000000)
        SELECT user_id, slot, event_id, off FROM r WHERE k = 1""",
    "gap_fill": f"WITH {EV}, s AS (SELECT DISTINCT user_id, t // 21600000000 AS slot FROM ev), n AS (SELECT user_id, slot, lead(slot) OVER (PARTITION BY user_id ORDER BY slot) AS nxt FROM s) SELECT user_id, unnest(range(slot + 1, nxt)) AS slot FROM n WHERE nxt > slot + 1",
    "rank_norm_score": f"""WITH {EV}, x AS (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) = max(value) OVER (PARTITION BY user_id) AS fv, min(t) OVER (PARTITION BY user_id) = max(t) OVER (PARTITION BY user_id) AS ft,
        row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rv, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS rt FROM ev), y AS (SELECT event_id, CASE WHEN n = 1 THEN 1 WHEN fv THEN 0.5 ELSE rv::DOUBLE / (n - 1) END AS a, CASE WHEN n = 1 THEN 1 WHEN ft THEN 0.5 ELSE rt::DOUBLE / (n - 1) END AS b FROM x)
        SELECT event_id, round(0.7::DOUBLE * a + 0.3::DOUBLE * b + 1e-9::DOUBLE, 6)::DOUBLE AS score, a >= 0.5 AS valid FROM y""",
    "autocorr_lag": f"""WITH {DAYS}, x AS (SELECT user_id, day, total - avg(total) OVER (PARTITION BY user_id) AS x FROM days), l AS (SELECT user_id, x, {', '.join(f'lag(x, {k}) OVER (PARTITION BY user_id ORDER BY day) AS l{k}' for k in (6, 7, 8))} FROM x)
        SELECT user_id, round(CASE WHEN sum(x * x) > 0 THEN greatest({', '.join(f'coalesce(sum(x * l{k}), 0)' for k in (6, 7, 8))}) / sum(x * x) ELSE 0 END, 5)::DOUBLE AS autocorr FROM l GROUP BY 1""",
    "phase_search": f"WITH {EV}, p AS (SELECT user_id, (t // 3600000000) % 6 AS phase, round(avg(value), 6) AS m FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, phase) AS k FROM p) SELECT user_id, phase, m AS mean FROM r WHERE k = 1",
    "slot_occupancy": f"""WITH {EV}, x AS (SELECT *, (t + 10800000000) // 21600000000 AS slot FROM ev) SELECT user_id, round(count(DISTINCT CASE WHEN abs(t - slot * 21600000000) <= 3600000000 THEN slot END)::DOUBLE / (max(slot) - min(slot) + 1), 6) AS occupancy FROM x GROUP BY 1""",
    "boost_events": f"""WITH {EV}, x AS (SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS post FROM ev)
        SELECT event_id, round(post / pre, 6) AS ratio FROM x WHERE pre > 0 AND post >= 2 * pre""",
}
