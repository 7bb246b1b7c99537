"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"
BAND_SQL = "CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END"
ERR_SQL = "round(abs(o_totalprice - 100000.0::DOUBLE), 2)"


def band():
    return F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 150000, "mid").otherwise("high")


def error():
    return F.round(F.abs(F.col("o_totalprice") - 100000.0), 2)


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def metrics_global(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(error().alias("e"), (F.col("o_orderstatus") == "F").alias("done"))
    return o.agg(F.count("*").alias("n"), r6(F.avg("e"), "mean"), r6(A.pct("e", 0.5), "median"), r6(A.pct("e", 0.95), "p95"), r6(F.avg(F.when(F.col("done"), (F.col("e") <= 50000).cast("double"))), "accuracy_done"))


def metrics_weighted_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means by scope, by (flag, scope) and over all (grouping sets); weight at least 1."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax", F.greatest(F.col("l_quantity"), F.lit(1.0)).alias("w"))
    g = li.groupingSets([["l_returnflag", "l_linestatus"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return g.agg(F.count("*").alias("n"), r6(mean("l_discount"), "discount"), r6(mean("l_tax"), "tax")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("scope"), "n", "discount", "tax")


def error_cdf_by_band(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(band().alias("band"), error().alias("e"))
    shares = [F.round(A.share_within(F.col("e"), t), 6).alias(f"within_{t}") for t in (1000, 10000, 50000)]
    out = o.groupBy("band").agg(F.count("*").alias("n"), r6(A.pct("e", 0.5), "median"), r6(F.avg("e"), "mean"), F.max("e").alias("most"), *shares)
    return out.join(A.nearest_rank(o, ["band"], "e", 0.95, "p95"), "band")


def provider_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Each role's mean score over the mean of these means, within 0.35 and 2.5."""
    by = events(spark, sf).groupBy("event_type").agg(F.avg("value").alias("m"))
    whole = F.avg("m").over(W.partitionBy(F.lit(0)))  # one row per role
    return by.select("event_type", r6(F.least(F.greatest(F.col("m") / whole, F.lit(0.35)), F.lit(2.5)), "weight"))


def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity")
    return A.weighted_median(li, ["l_suppkey"], "l_extendedprice", "l_quantity")


def robust_center_iqr(spark: SparkSession, sf: str) -> DataFrame:
    out = A.robust_centre(table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice"), ["l_partkey"], "l_extendedprice")
    return out.select("l_partkey", r6(F.col("centre"), "centre"), "n_used", "n")


def percentile_profile(spark: SparkSession, sf: str) -> DataFrame:
    qs = (1, 5, 8, 10, 25, 50, 72, 75, 90, 92, 94, 99)
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "sd"), *(r6(A.pct("value", q / 100), f"p{q}") for q in qs))


def linspace_bins(spark: SparkSession, sf: str) -> DataFrame:
    out = A.equal_bins(events(spark, sf), ["user_id"], ["t", "event_id"], "value", 12)
    return out.select("user_id", F.col("bin").cast("long").alias("bin"), "low", "high", r6(F.col("rms"), "rms"))


def weighted_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each user's bag of (hour of day, role) with the next user's."""
    bags = events(spark, sf).groupBy("user_id", F.concat_ws("/", F.expr("t div 3600000000 % 24"), "event_type").alias("item")).agg(F.count("*").alias("n"))
    pairs = bags.select(F.col("user_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return A.weighted_jaccard(bags, "user_id", "item", "n", pairs).select("a", "b", r6(F.col("jaccard"), "jaccard"))


def circular_mean(spark: SparkSession, sf: str) -> DataFrame:
    hours = events(spark, sf).withColumn("h", (F.col("t") % (24 * HOUR)) / HOUR)
    return hours.groupBy("user_id").agg(F.round(A.circular_mean(F.col("h"), 24.0), 4).alias("phase"))


def mad_stability(spark: SparkSession, sf: str) -> DataFrame:
    """1 / (1 + MAD / median) of the gaps between a user's events."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    gaps = events(spark, sf).withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap is not null").select("user_id", "gap")
    mid = gaps.withColumn("m", F.percentile("gap", F.lit(0.5)).over(W.partitionBy("user_id")))
    out = mid.groupBy("user_id").agg(F.max("m").alias("m"), F.percentile(F.abs(F.col("gap") - F.col("m")), F.lit(0.5)).alias("mad"))
    return out.select("user_id", F.col("m").alias("median_gap"), r6(1 / (1 + F.col("mad") / F.col("m")), "stability"))


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.least(F.col("n_chars") / 3000.0, F.lit(1.0)).alias("score"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("positive"), "toxic"), "doc_id")


SCORED = "s AS (SELECT doc_id, lang, least(n_chars::DOUBLE / 3000.0::DOUBLE, 1.0::DOUBLE) AS score, quality AS positive, toxic FROM documents JOIN labels USING (doc_id))"
GRID = [x / 10 for x in range(10)]


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = A.sweep(scored_docs(spark, sf), "score", "positive", GRID)
    return out.select("threshold", "tp", "fp", "fn", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


def gate_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows and their precision on a grid of two thresholds; the best cell first (ties: lower thresholds)."""
    s = scored_docs(spark, sf).withColumn("margin", F.abs(F.col("score") - 0.5))
    cells = [(a / 10, b / 10) for a in range(0, 10, 3) for b in range(0, 5)]
    sums = s.agg(*(F.sum(F.when((F.col("score") >= a) & (F.col("margin") >= b), x).otherwise(0)).alias(f"{n}{i}") for i, (a, b) in enumerate(cells) for n, x in (("n", F.lit(1)), ("p", F.col("positive")))))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("score"), F.lit(b).alias("margin"), F.col(f"n{i}").cast("long").alias("accepted"), F.col(f"p{i}").cast("long").alias("right")) for i, (a, b) in enumerate(cells)))).alias("c")).select("c.*")
    value = F.round(F.when(F.col("accepted") > 0, F.col("right") / F.col("accepted")).otherwise(0.0), 6)
    return rows.select("score", "margin", "accepted", value.alias("precision")).withColumn("place", F.row_number().over(W.orderBy(F.desc("precision"), F.desc("accepted"), "score", "margin")).cast("long"))


def tier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of a fixed list of tiers; absent ones have zero rows."""
    tiers = spark.createDataFrame([("accept",), ("review",), ("hold",), ("reject",)], "tier string")
    tier = F.when((F.col("positive") == 1) & (F.col("toxic") == 0) & (F.col("score") >= 0.5), "accept").when(F.col("positive") == 1, "review").otherwise("hold")
    got = scored_docs(spark, sf).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return tiers.join(got, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("m", F.lit(0.0)), "mean_score"))


def most_common_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_most_common(events(spark, sf), "event_type", "event_id").select("event_type", "n", "place")


def upper_median_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Per part: prices grouped by gaps over 500, the largest group (then the tightest, then the lowest), its upper median."""
    # one sort by part and price serves all windows: a group's last line knows where it began, and lines of one price need no order
    x, part = F.col("l_extendedprice"), W.partitionBy("l_partkey")
    w = part.orderBy("l_extendedprice")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    put = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice").withColumns({"c": F.coalesce((x - F.lag(x).over(w) > 500).cast("int"), F.lit(0)), "k": F.row_number().over(w)})
    first = lambda c: F.last(F.when((F.col("c") == 1) | (F.col("k") == 1), c), True).over(so_far)
    put = put.withColumns({"begin": first(F.col("k")), "low": F.coalesce(first(x), F.min(x).over(so_far)), "ends": F.lead("c", 1, 1).over(w) == 1})
    n = F.col("k") - F.col("begin") + 1
    group = F.when(F.col("ends"), F.struct((-n).alias("less"), F.round(x - F.col("low"), 4).alias("spread"), F.col("begin")))
    put = put.withColumn("best", F.min(group).over(part))
    return put.where("k = best.begin + (-best.less) div 2").select("l_partkey", (-F.col("best.less")).cast("long").alias("n"), x.alias("target"))


def split_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hosts in two halves of the pages and those in both."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"://([^/]*)", 1).alias("host"), (F.col("page_id") % 2).alias("half"))
    per = p.groupBy("host").agg(F.max((F.col("half") == 0).cast("int")).alias("a"), F.max((F.col("half") == 1).cast("int")).alias("b"))
    return per.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))


def pair_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the ROC curve by ranks (ties share), and log loss, by language; no pairs are made."""
    # rows of a language and score are counted before they are put in order: as many as there are scores (3,000 at most)
    s = scored_docs(spark, sf).groupBy("lang", "score").agg(F.count("*").alias("k"), F.sum(F.col("positive").cast("long")).alias("k1"))
    w = W.partitionBy("lang").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    r = s.withColumn("r", F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2.0)
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("k1") * F.log(p) + (F.col("k") - F.col("k1")) * F.log(1 - p))
    g = r.groupBy("lang").agg(F.sum(F.col("k1") * F.col("r")).alias("s"), F.sum("k1").alias("n1"), F.sum(F.col("k") - F.col("k1")).alias("n0"), (F.sum(loss) / F.sum("k")).alias("l"))
    return g.select("lang", r6(F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")), "auc"), r6(F.col("l"), "log_loss"))


def majority_phase(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest quarter of the day of each user's events (ties: the earlier)."""
    by = events(spark, sf).groupBy("user_id", F.expr("t div (6 * 3600000000) % 4").alias("phase")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("phase")).alias("p")))
    return by.groupBy("user_id").agg(best.alias("b")).select("user_id", (-F.col("b.p")).alias("phase"), F.col("b.n").alias("n"))


def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and day: count, distinct roles, weight sum, maximum and population deviation."""
    return events(spark, sf).groupBy("user_id", F.expr("t div (24 * 3600000000)").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("roles"), r6(F.sum("value"), "weight"), F.max("value").alias("most"), r6(F.stddev_pop("value"), "spread"))


QUERIES = {f.__name__: f for f in (metrics_global, metrics_weighted_scopes, error_cdf_by_band, provider_weights, weighted_median, robust_center_iqr, percentile_profile, linspace_bins, weighted_jaccard, circular_mean, mad_stability, threshold_sweep, gate_grid, tier_metrics, most_common_reasons, upper_median_dedupe, split_diagnostics, pair_auc, majority_phase, cluster_summary)}
_P = ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (1, 5, 8, 10, 25, 50, 72, 75, 90, 92, 94, 99))
ORACLE = {
    "metrics_global": f"""WITH o AS (SELECT {ERR_SQL} AS e, o_orderstatus = 'F' AS done FROM orders) SELECT count(*)::BIGINT AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95,
        round(avg(CASE WHEN done THEN (e <= 50000)::INT::DOUBLE END), 6) AS accuracy_done FROM o""",
    "metrics_weighted_scopes": """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS scope, count(*)::BIGINT AS n, round(sum(l_discount * greatest(l_quantity, 1.0)) / sum(greatest(l_quantity, 1.0)), 6)::DOUBLE AS discount,
        round(sum(l_tax * greatest(l_quantity, 1.0)) / sum(greatest(l_quantity, 1.0)), 6)::DOUBLE AS tax FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
    "error_cdf_by_band": f"""WITH o AS (SELECT {BAND_SQL} AS band, {ERR_SQL} AS e FROM orders), k AS (SELECT band, e, row_number() OVER (PARTITION BY band ORDER BY e) - 1 AS k, count(*) OVER (PARTITION BY band) AS n FROM o)
        SELECT band, count(*)::BIGINT AS n, round(quantile_cont(e, 0.5), 6) AS median, round(avg(e), 6) AS mean, max(e) AS most, round(100.0::DOUBLE * avg((e <= 1000)::INT), 6) AS within_1000, round(100.0::DOUBLE * avg((e <= 10000)::INT), 6) AS within_10000,
        round(100.0::DOUBLE * avg((e <= 50000)::INT), 6) AS within_50000, max(CASE WHEN k = least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) THEN e END) AS p95 FROM k GROUP BY band""",
    "provider_weights": "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round(least(greatest(m / (SELECT avg(m) FROM m), 0.35::DOUBLE), 2.5::DOUBLE), 6) AS weight FROM m",
    "weighted_median": "WITH c AS (SELECT l_suppkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS w FROM lineitem) SELECT l_suppkey, min(l_extendedprice) AS median FROM c WHERE c >= w / 2 GROUP BY 1",
    "robust_center_iqr": """WITH q AS (SELECT l_partkey, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
        SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS centre, count(*)::BIGINT AS n_used, max(n)::BIGINT AS n FROM lineitem JOIN q USING (l_partkey) WHERE n < 4 OR l_extendedprice BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a) GROUP BY 1""",
    "percentile_profile": f"SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, {_P} FROM events GROUP BY 1",
    "linspace_bins": f"""WITH {EV}, k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev), b AS (SELECT unnest(range(12)) AS bin)
        SELECT user_id, bin::BIGINT AS bin, min(value) AS low, max(value) AS high, round(sqrt(avg(value * value)), 6) AS rms FROM k JOIN b ON k >= (bin * n) // 12 AND k < ((bin + 1) * n) // 12 GROUP BY 1, 2""",
    "weighted_jaccard": f"""WITH {EV}, bag AS (SELECT user_id, (t // 3600000000) % 24 || '/' || event_type AS item, count(*) AS n FROM ev GROUP BY 1, 2), p AS (SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM bag a JOIN bag b ON b.user_id = a.user_id + 1),
        u AS (SELECT p.a, p.b, item FROM p JOIN bag ON user_id = p.a OR user_id = p.b GROUP BY ALL)
        SELECT u.a, u.b, round(sum(least(coalesce(x.n, 0), coalesce(y.n, 0)))::DOUBLE / sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))), 6) AS jaccard FROM u LEFT JOIN bag x ON x.user_id = u.a AND x.item = u.item LEFT JOIN bag y ON y.user_id = u.b AND y.item = u.item GROUP BY 1, 2""",
    "circular_mean": f"""WITH {EV}, h AS (SELECT user_id, (t % 86400000000)::DOUBLE / 3600000000 * (2 * 3.141592653589793::DOUBLE / 24) AS a FROM ev), m AS (SELECT user_id, atan2(avg(sin(a)), avg(cos(a))) / (2 * 3.141592653589793::DOUBLE / 24) AS p FROM h GROUP BY 1)
        SELECT user_id, round(CASE WHEN p < 0 THEN p + 24 ELSE p END, 4) AS phase FROM m""",
    "mad_stability": f"""WITH {EV}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev), m AS (SELECT user_id, quantile_cont(gap::DOUBLE, 0.5) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1)
        SELECT user_id, m AS median_gap, round(1 / (1 + quantile_cont(abs(gap - m), 0.5) / m), 6) AS stability FROM g JOIN m USING (user_id) WHERE gap IS NOT NULL GROUP BY 1, 2""",
    "threshold_sweep": f"""WITH {SCORED}, g AS (SELECT unnest(range(10))::DOUBLE / 10 AS threshold), c AS (SELECT threshold, coalesce(sum(positive), 0)::BIGINT AS tp, coalesce(sum(1 - positive), 0)::BIGINT AS fp, (SELECT sum(positive) FROM s)::BIGINT AS p FROM g LEFT JOIN s ON score >= threshold GROUP BY 1),
        x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END AS re FROM c)
        SELECT threshold, tp, fp, (p - tp)::BIGINT AS fn, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6)::DOUBLE AS f1 FROM x""",
    "gate_grid": f"""WITH {SCORED}, a AS (SELECT unnest([0, 3, 6, 9])::DOUBLE / 10 AS score), b AS (SELECT unnest(range(5))::DOUBLE / 10 AS margin),
        c AS (SELECT a.score, margin, count(s.doc_id)::BIGINT AS accepted, coalesce(sum(positive), 0) AS p FROM a CROSS JOIN b LEFT JOIN s ON s.score >= a.score AND abs(s.score - 0.5::DOUBLE) >= margin GROUP BY 1, 2),
        r AS (SELECT score, margin, accepted, round(CASE WHEN accepted > 0 THEN p::DOUBLE / accepted ELSE 0 END, 6)::DOUBLE AS precision FROM c)
        SELECT *, row_number() OVER (ORDER BY precision DESC, accepted DESC, score, margin) AS place FROM r""",
    "tier_metrics": f"""WITH {SCORED}, t AS (SELECT CASE WHEN positive = 1 AND toxic = 0 AND score >= 0.5 THEN 'accept' WHEN positive = 1 THEN 'review' ELSE 'hold' END AS tier, score FROM s)
        SELECT x.tier, count(score)::BIGINT AS n, round(coalesce(avg(score), 0), 6)::DOUBLE AS mean_score FROM (SELECT unnest(['accept', 'review', 'hold', 'reject']) AS tier) x LEFT JOIN t USING (tier) GROUP BY 1""",
    "most_common_reasons": "WITH c AS (SELECT event_type, count(*)::BIGINT AS n, min(event_id) AS f FROM events GROUP BY 1) SELECT event_type, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM c",
    "upper_median_dedupe": """WITH a AS (SELECT l_partkey, l_extendedprice AS x, l_orderkey, l_linenumber, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER w > 500 THEN 1 ELSE 0 END AS c FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber)),
        g AS (SELECT *, sum(c) OVER (PARTITION BY l_partkey ORDER BY x, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS g FROM a),
        k AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, g) AS n, max(x) OVER (PARTITION BY l_partkey, g) - min(x) OVER (PARTITION BY l_partkey, g) AS spread, row_number() OVER (PARTITION BY l_partkey, g ORDER BY x, l_orderkey, l_linenumber) - 1 AS k FROM g),
        b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, round(spread, 4), g) AS b FROM k WHERE k = n // 2) SELECT l_partkey, n::BIGINT AS n, x AS target FROM b WHERE b = 1""",
    "split_diagnostics": "WITH h AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, max((page_id % 2 = 0)::INT) AS a, max((page_id % 2 = 1)::INT) AS b FROM pages GROUP BY 1) SELECT sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both FROM h",
    "pair_auc": f"""WITH {SCORED}, l AS (SELECT lang, round(avg(-CASE WHEN positive = 1 THEN ln(least(greatest(score, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(score, 1e-6), 1 - 1e-6)) END), 6) AS log_loss FROM s GROUP BY 1),
        a AS (SELECT p.lang, round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM s p JOIN s n ON p.lang = n.lang AND p.positive = 1 AND n.positive = 0 GROUP BY 1) SELECT lang, auc, log_loss FROM l LEFT JOIN a USING (lang)""",
    "majority_phase": f"WITH {EV}, c AS (SELECT user_id, (t // 21600000000) % 4 AS phase, count(*)::BIGINT AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, phase) AS k FROM c) SELECT user_id, phase, n FROM r WHERE k = 1",
    "cluster_summary": f"WITH {EV} SELECT user_id, t // 86400000000 AS day, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS roles, round(sum(value), 6) AS weight, max(value) AS most, round(stddev_pop(value), 6) AS spread FROM ev GROUP BY 1, 2",
}
