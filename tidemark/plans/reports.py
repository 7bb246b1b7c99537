"""Queries of reports, gates, evaluations and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import num as N
from tidemark.operators import joins as J
from tidemark.operators import ranking as R
from tidemark.operators import sequences as S
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def of_type(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == kind)


def nearest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases (reference) with the nearest click (estimate): user_id, event_id, error in hours."""
    near = J.asof_nearest(of_type(spark, sf, "purchase").select("user_id", "t", "event_id"), of_type(spark, sf, "click"), "user_id", "t", "event_id")
    return near.where("error is not null").select("user_id", "event_id", "t", (F.col("error") / HOUR).alias("e"))


ERRORS = f"""{EV}, ref AS (SELECT * FROM ev WHERE event_type = 'purchase'), est AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'click'),
    errs AS (SELECT user_id, event_id, t, e FROM (SELECT ref.user_id, ref.event_id, ref.t, (est.t - ref.t)::DOUBLE / 3600000000 AS e, row_number() OVER (PARTITION BY ref.event_id ORDER BY abs(est.t - ref.t), est.t) AS k FROM ref JOIN est USING (user_id)) WHERE k = 1)"""


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: signed and absolute errors, hit rates at four tolerances, longest run of hits over the count."""
    e = nearest_errors(spark, sf).withColumn("a", F.abs("e"))
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    runs = e.withColumn("i", F.row_number().over(w)).where("a <= 6").withColumn("g", F.col("i") - F.row_number().over(w)).groupBy("user_id", "g").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.max("c").alias("run"))
    hit = lambda h: r6(F.avg((F.col("a") <= h).cast("double")), f"hit_{h}h")
    out = e.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.percentile("e", F.lit(0.5)), "median_error"), r6(F.avg("e"), "mean_error"), r6(F.percentile("a", F.lit(0.5)), "median_abs"), r6(F.percentile("a", F.lit(0.95)), "p95_abs"), r6(F.stddev_pop("e"), "sd"), *(hit(h) for h in (1, 3, 6, 24)))
    return out.join(runs, "user_id", "left").withColumn("continuity_6h", F.round(F.coalesce("run", F.lit(0)) / F.col("n"), 6)).drop("run")


def error_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Error classes with three bounds, and off-by-a-day errors: counts."""
    a = F.abs(F.col("e"))
    case = R.first_rule("exact", (a > 24, "wrong_section"), (a > 6, "far"), (a > 1, "near"))
    off = F.abs(a - 24) <= 1
    return nearest_errors(spark, sf).groupBy(case.alias("case")).agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("n_off_by_day"), F.count(F.when(F.col("e") < 0, 1)).alias("n_early"))


def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in two-hour bins of the signed error, ends gathered."""
    b = F.least(F.greatest(F.floor(F.col("e") / 2), F.lit(-12)), F.lit(11))
    return nearest_errors(spark, sf).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def best_and_worst(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty smallest and largest errors, with ties by id."""
    a = nearest_errors(spark, sf).select("event_id", F.abs("e").alias("a"))
    best, worst = a.orderBy("a", "event_id").limit(20), a.orderBy(F.desc("a"), "event_id").limit(20)
    return best.withColumn("side", F.lit("best")).union(worst.withColumn("side", F.lit("worst"))).select("side", "event_id", r6(F.col("a"), "error"))


def window_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Views inside any search window (from an hour before a purchase to three after), each once."""
    spans = of_type(spark, sf, "purchase").select("user_id", (F.col("t") - HOUR).alias("start"), (F.col("t") + 3 * HOUR).alias("end"))
    return J.in_intervals(of_type(spark, sf, "view"), spans, "user_id", "t", "start", "end", 4 * HOUR, closed=True).select("event_id", "user_id").distinct()


def override_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a correction (a line item of number 1 and discount over 0.05): valid corrections replace the total."""
    fix = table(spark, sf, "lineitem").where("l_linenumber = 1 and l_discount > 0.05").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("fixed"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(fix, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.when(N.finite(F.col("fixed")) > 0, F.col("fixed")), F.col("o_totalprice")).alias("marker"), F.when(F.col("fixed") > 0, "override").otherwise("report").alias("origin"))


def delta_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Change of the marker by an override, by class: unchanged, small, moved, other section."""
    o = override_join(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")
    d = F.abs(F.round(F.col("marker") - F.col("o_totalprice"), 2))
    case = R.first_rule("unchanged", (d > 50000, "other_section"), (d > 1000, "moved"), (d > 0, "small"))
    return o.groupBy("o_orderstatus", case.alias("delta_class")).agg(F.count("*").alias("n"), r6(F.avg(d), "mean_delta"))


def snap_to_grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Errors moved to the nearest view of the user if it is within an hour."""
    near = J.asof_nearest(of_type(spark, sf, "error").select("user_id", "t", "event_id"), of_type(spark, sf, "view"), "user_id", "t", "event_id")
    snapped = F.abs("error") <= HOUR
    return near.select("event_id", F.when(snapped, F.col("near_t")).otherwise(F.col("t")).alias("t"), F.coalesce(snapped, F.lit(False)).alias("snapped"))


def consensus_tempo(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand: weighted mean of tempos (sizes folded to 80-200), weights by price, and share of weight within 5 of it."""
    p = table(spark, sf, "part").select("p_brand", N.fold_tempo(F.col("p_size") * 7.0).alias("bpm"), F.col("p_retailprice").alias("w"))
    mean = p.groupBy("p_brand").agg((F.sum(F.col("bpm") * F.col("w")) / F.sum("w")).alias("tempo"))
    near = p.join(mean, "p_brand").groupBy("p_brand").agg(F.max("tempo").alias("tempo"), (F.sum(F.when(F.abs(F.col("bpm") - F.col("tempo")) <= 5, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))
    return near.select("p_brand", r6(F.col("tempo"), "tempo"), r6(F.col("share"), "share"))


def library_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, labelled, accepted, rejected, pass rate, languages."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return d.agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count(F.when(ok, 1)).alias("accepted"), F.count(F.when(~ok, 1)).alias("rejected"), r6(F.avg(ok.cast("double")), "pass_rate"), F.countDistinct("lang").alias("languages"))


def median_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-2, 2)
    return events(spark, sf).select("event_id", r6(F.percentile("value", F.lit(0.5)).over(w), "smooth"))


def model_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The five best rows by rank are ordered anew by another score; the others keep their order behind them."""
    ranked = J.ranked(events(spark, sf), ["user_id"], F.desc("value"), F.col("event_id"))
    other = F.when(F.col("rank") <= 5, F.pmod(F.col("event_id") * 37, F.lit(101)))
    return ranked.withColumn("m", other).select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("m"), "rank")).cast("long").alias("model_rank"))


def selected_margin_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: its best line by price, the lead over the second, and whether it is the line with the largest quantity too."""
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    q = W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("k"), F.lead("l_extendedprice", 1, 0.0).over(w).alias("nxt"), F.row_number().over(q).alias("o"))
    return li.where("k = 1").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.col("nxt"), 4).alias("margin"), (F.col("o") == 1).alias("oracle"))


def union_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """Three generators with weights, united; per user the ten best by weighted score, in order of time."""
    parts = [of_type(spark, sf, k).withColumn("c", F.round(F.col("value") * x, 4)) for k, x in (("click", 1.0), ("view", 0.5), ("signup", 2.0))]
    top = J.ranked(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["user_id"], F.desc("c"), F.col("event_id")).where("rank <= 10")
    return top.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")).cast("long").alias("place"))


def auto_accept_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that pass strict, normal or loose bounds on price and share of late lines; risk flags for those that don't."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.max("l_discount").alias("discount"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = R.reasons((F.coalesce("returned", F.lit(0.0)) > 0.5, "many_returns"), (F.coalesce("discount", F.lit(0.0)) > 0.08, "high_discount"), (F.col("o_totalprice") > 300000, "large"), (F.col("l_orderkey").isNull(), "no_lines"))
    rows = o.select("o_orderkey", flags.alias("f"))
    return rows.select("o_orderkey", R.first_rule("hold", (F.size("f") == 0, "strict"), (F.size("f") == 1, "normal"), (F.size("f") == 2, "loose")).alias("mode"), F.array_join("f", ";").alias("risk_flags"))


def region_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the first or last tenth of a user's span go unless very strong; users that would lose all keep all."""
    part = W.partitionBy("user_id")
    rows = events(spark, sf).withColumn("a", F.min("t").over(part)).withColumn("b", F.max("t").over(part))
    share = (F.col("t") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1))
    rows = rows.withColumn("ok", share.between(0.1, 0.9) | (F.col("value") >= 400))
    return rows.withColumn("any", F.max(F.col("ok").cast("int")).over(part)).where("ok or any = 0").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def url_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields by pattern, with a fallback to another place: number from the query else from the path, role from the host's first label."""
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]page=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit(""))).try_cast("int")
    label = F.regexp_extract("url", r"://([^./]+)\.", 1)
    return table(spark, sf, "pages").select("page_id", number.alias("number"), F.when(label.isin("www", "m", "blog"), label).otherwise("main").alias("role"), F.nullif(F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1), F.lit("")).alias("lang"))


def monotone_check(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose values never fall from one event to the next, and where the first fall is."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("fall", F.col("value") < F.lag("value").over(w))
    return rows.groupBy("user_id").agg(F.coalesce(~F.bool_or("fall"), F.lit(True)).alias("monotone"), F.min(F.when(F.col("fall"), F.col("i"))).cast("long").alias("first_fall"))


def bar_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Score of each event raised by a prior: strength of the six-hour slot's phase times the decay of its distance."""
    slot = F.expr("(t + 3 * 3600000000) div (6 * 3600000000)")
    near = F.exp(-F.abs(F.col("t") - F.col("slot") * 6 * HOUR) / (2.0 * HOUR))
    strength = F.when(F.col("slot") % 16 == 0, 1.0).when(F.col("slot") % 4 == 0, 0.6).otherwise(0.2)
    return events(spark, sf).withColumn("slot", slot).select("event_id", r6(strength * near, "prior"), F.round(F.col("value") * (1 + 0.25 * strength * near), 4).alias("adjusted"))


def cluster_alternates(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and day: the strongest event and up to six alternates, by value."""
    w = W.partitionBy("user_id", "day").orderBy(F.desc("value"), "event_id")
    rows = events(spark, sf).withColumn("day", F.expr("t div 86400000000")).withColumn("k", F.row_number().over(w)).where("k <= 7")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.struct("k", "event_id")))), lambda s: s["event_id"].cast("string"))
    return rows.groupBy("user_id", "day").agg(F.max(F.when(F.col("k") == 1, F.col("event_id"))).alias("event_id"), F.array_join(ids, ",").alias("alternates"))


def tier_top_up(spark: SparkSession, sf: str) -> DataFrame:
    """Per user at least three rows: purchases, then, where these are too few, signups and errors by value."""
    pr = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2)
    w = W.partitionBy("user_id").orderBy("pr", F.desc("value"), "event_id")
    rows = events(spark, sf).withColumn("pr", pr).where("pr is not null").withColumn("k", F.row_number().over(w))
    return rows.where("pr = 0 or k <= 3").select("user_id", "event_id", F.when(F.col("pr") == 0, "main").otherwise("top_up").alias("part"))


def regression_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 largest errors of at least two hours, as seeds, by error then id."""
    a = nearest_errors(spark, sf).select("event_id", F.abs("e").alias("a")).where("a >= 2")
    return a.orderBy(F.desc("a"), "event_id").limit(200).select("event_id", r6(F.col("a"), "error"))


def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a new rule is promoted over the old, by priority: no worse in the median and in the 95th percentile, better in one."""
    o = table(spark, sf, "orders").select("o_orderpriority", F.abs(F.col("o_totalprice") - 100000.0).alias("a"), F.abs(F.col("o_totalprice") * 0.9 - 100000.0).alias("b"))
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 4)
    m = o.groupBy("o_orderpriority").agg(q("a", 0.5).alias("old_median"), q("b", 0.5).alias("new_median"), q("a", 0.95).alias("old_p95"), q("b", 0.95).alias("new_p95"))
    return m.withColumn("promote", F.expr("new_median <= old_median and new_p95 <= old_p95 and (new_median < old_median or new_p95 < old_p95)"))


def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: the three longest documents of bad quality, as the hardest negatives, and by hash three others."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id")
    hard = J.ranked(d, ["source"], F.desc("n_chars"), F.col("doc_id"))
    rest = J.ranked(hard.where("rank > 3").drop("rank"), ["source"], F.sha1(F.col("doc_id").cast("string").cast("binary")))
    return hard.where("rank <= 3").select("source", "doc_id", F.lit("hard").alias("kind")).union(rest.where("rank <= 3").select("source", "doc_id", F.lit("random").alias("kind")))


def candidate_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Feature row of each event: one-hot role, rank shares, margins to the best and the next, hour phase."""
    part = W.partitionBy("user_id")
    by = part.orderBy(F.desc("value"), "event_id")
    hour = F.expr("t div 3600000000 % 24")
    return events(spark, sf).select(
        "event_id",
        *((F.col("event_type") == k).cast("long").alias(f"is_{k}") for k in ("click", "view", "purchase")),
        r6(1.0 / F.row_number().over(by), "rank_inverse"),
        r6(F.col("value") / F.max("value").over(part) + 1e-9, "share_of_best"),
        r6(F.col("value") - F.coalesce(F.lead("value").over(by), F.lit(0.0)), "margin_next"),
        F.round(F.sin(hour * 2 * 3.141592653589793 / 24), 5).alias("phase_sin"),
    )


def diversified_choice(spark: SparkSession, sf: str) -> DataFrame:
    return S.diversified(events(spark, sf), "user_id", "event_type", "value", "event_id", 12, 3, 3).select("user_id", "event_id", "place")


def merged_times(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_running(events(spark, sf).select("user_id", "t", "event_id"), "user_id", "t", "event_id", 2 * HOUR).select("user_id", r6(F.col("value"), "value"), "n")


def append_if_apart(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["user_id", "t", "event_id"]
    return S.append_apart(of_type(spark, sf, "purchase").select(cols), of_type(spark, sf, "signup").select(cols), "user_id", "t", "event_id", 12 * HOUR).select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (evaluation_report, error_flags, error_histogram, best_and_worst, window_semi_join, override_join, delta_classes, snap_to_grid_rows, consensus_tempo, library_summary, median_smoothing, model_rerank, selected_margin_oracle, union_top_n, auto_accept_gate, region_guard, url_fields, monotone_check, bar_prior, cluster_alternates, tier_top_up, regression_seeds, promotion_gate, hard_negatives, candidate_vector, diversified_choice, merged_times, append_if_apart)}
FOLD = "p_size * 7.0::DOUBLE * pow(2.0::DOUBLE, greatest(ceil(log2(80.0::DOUBLE / (p_size * 7.0::DOUBLE))), 0) - greatest(ceil(log2(p_size * 7.0::DOUBLE / 200.0::DOUBLE)), 0))"
OVER = """fix AS (SELECT l_orderkey, max(l_extendedprice) AS fixed FROM lineitem WHERE l_linenumber = 1 AND l_discount > 0.05 GROUP BY 1),
    over AS (SELECT o_orderkey, CASE WHEN fixed > 0 THEN fixed ELSE o_totalprice END AS marker, CASE WHEN fixed > 0 THEN 'override' ELSE 'report' END AS origin, o_totalprice, o_orderstatus FROM orders LEFT JOIN fix ON o_orderkey = l_orderkey)"""
ORACLE = {
    "evaluation_report": f"""WITH {ERRORS}, i AS (SELECT user_id, abs(e) AS a, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM errs), g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM i WHERE a <= 6),
        c AS (SELECT user_id, max(c) AS run FROM (SELECT user_id, g, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1)
        SELECT user_id, count(*)::BIGINT AS n, round(quantile_cont(e, 0.5), 6) AS median_error, round(avg(e), 6) AS mean_error, round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(quantile_cont(abs(e), 0.95), 6) AS p95_abs, round(stddev_pop(e), 6) AS sd,
        round(avg((abs(e) <= 1)::INT), 6) AS hit_1h, round(avg((abs(e) <= 3)::INT), 6) AS hit_3h, round(avg((abs(e) <= 6)::INT), 6) AS hit_6h, round(avg((abs(e) <= 24)::INT), 6) AS hit_24h, round(coalesce(max(run), 0)::DOUBLE / count(*), 6) AS continuity_6h
        FROM errs LEFT JOIN c USING (user_id) GROUP BY user_id""",
    "error_flags": f"""WITH {ERRORS} SELECT CASE WHEN abs(e) > 24 THEN 'wrong_section' WHEN abs(e) > 6 THEN 'far' WHEN abs(e) > 1 THEN 'near' ELSE 'exact' END AS case, count(*)::BIGINT AS n, count(CASE WHEN abs(abs(e) - 24) <= 1 THEN 1 END)::BIGINT AS n_off_by_day, count(CASE WHEN e < 0 THEN 1 END)::BIGINT AS n_early FROM errs GROUP BY 1""",
    "error_histogram": f"WITH {ERRORS} SELECT least(greatest(floor(e / 2), -12), 11)::BIGINT AS bin, count(*)::BIGINT AS n FROM errs GROUP BY 1",
    "best_and_worst": f"""WITH {ERRORS}, r AS (SELECT event_id, abs(e) AS a, row_number() OVER (ORDER BY abs(e), event_id) AS b, row_number() OVER (ORDER BY abs(e) DESC, event_id) AS w FROM errs)
        SELECT 'best' AS side, event_id, round(a, 6) AS error FROM r WHERE b <= 20 UNION ALL SELECT 'worst', event_id, round(a, 6) FROM r WHERE w <= 20""",
    "window_semi_join": f"WITH {EV} SELECT event_id, user_id FROM ev v WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND v.t BETWEEN p.t - 3600000000 AND p.t + 10800000000)",
    "override_join": f"WITH {OVER} SELECT o_orderkey, marker, origin FROM over",
    "delta_classes": f"""WITH {OVER}, d AS (SELECT o_orderstatus, abs(round(marker - o_totalprice, 2)) AS d FROM over) SELECT o_orderstatus, CASE WHEN d > 50000 THEN 'other_section' WHEN d > 1000 THEN 'moved' WHEN d > 0 THEN 'small' ELSE 'unchanged' END AS delta_class, count(*)::BIGINT AS n, round(avg(d), 6) AS mean_delta FROM d GROUP BY 1, 2""",
    "snap_to_grid_rows": f"""WITH {EV}, r AS (SELECT e.event_id, e.t, v.t AS vt, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(v.t - e.t), v.t) AS k FROM ev e LEFT JOIN (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'view') v USING (user_id) WHERE e.event_type = 'error')
        SELECT event_id, CASE WHEN abs(vt - t) <= 3600000000 THEN vt ELSE t END AS t, coalesce(abs(vt - t) <= 3600000000, false) AS snapped FROM r WHERE k = 1""",
    "consensus_tempo": f"""WITH p AS (SELECT p_brand, CASE WHEN p_size > 0 THEN {FOLD} END AS bpm, p_retailprice AS w FROM part), m AS (SELECT p_brand, sum(bpm * w) / sum(w) AS tempo FROM p GROUP BY 1)
        SELECT p_brand, round(max(tempo), 6) AS tempo, round(sum(CASE WHEN abs(bpm - tempo) <= 5 THEN w ELSE 0 END) / sum(w), 6) AS share FROM p JOIN m USING (p_brand) GROUP BY 1""",
    "library_summary": """WITH d AS (SELECT doc_id, lang, quality, quality = 1 AND toxic = 0 AS ok FROM documents LEFT JOIN labels USING (doc_id))
        SELECT count(*)::BIGINT AS n, count(quality)::BIGINT AS labelled, count(CASE WHEN ok THEN 1 END)::BIGINT AS accepted, count(CASE WHEN NOT ok THEN 1 END)::BIGINT AS rejected, round(avg(ok::INT), 6) AS pass_rate, count(DISTINCT lang)::BIGINT AS languages FROM d""",
    "median_smoothing": f"WITH {EV} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ev",
    "model_rerank": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev), m AS (SELECT *, CASE WHEN rank <= 5 THEN (event_id * 37) % 101 END AS m FROM r)
        SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY m DESC NULLS LAST, rank) AS model_rank FROM m""",
    "selected_margin_oracle": """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, row_number() OVER a AS k, coalesce(lead(l_extendedprice) OVER a, 0) AS nxt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem WINDOW a AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey))
        SELECT l_orderkey, l_linenumber, round(p - nxt, 4) AS margin, o = 1 AS oracle FROM r WHERE k = 1""",
    "union_top_n": f"""WITH {EV}, u AS (SELECT *, round(value * CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END, 4) AS c FROM ev WHERE event_type IN ('click', 'view', 'signup')), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_id) AS k FROM u)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place FROM r WHERE k <= 10""",
    "auto_accept_gate": """WITH l AS (SELECT l_orderkey, avg((l_returnflag = 'R')::INT) AS r, max(l_discount) AS d FROM lineitem GROUP BY 1),
        f AS (SELECT o_orderkey, list_filter([CASE WHEN coalesce(r, 0) > 0.5 THEN 'many_returns' END, CASE WHEN coalesce(d, 0) > 0.08 THEN 'high_discount' END, CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN l_orderkey IS NULL THEN 'no_lines' END], lambda x: x IS NOT NULL) AS f FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
        SELECT o_orderkey, CASE len(f) WHEN 0 THEN 'strict' WHEN 1 THEN 'normal' WHEN 2 THEN 'loose' ELSE 'hold' END AS mode, array_to_string(f, ';') AS risk_flags FROM f""",
    "region_guard": f"""WITH {EV}, s AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id))::DOUBLE / greatest(max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id), 1) AS share FROM ev), o AS (SELECT *, share BETWEEN 0.1 AND 0.9 OR value >= 400 AS ok FROM s),
        a AS (SELECT *, bool_or(ok) OVER (PARTITION BY user_id) AS anyone FROM o) SELECT user_id, count(*)::BIGINT AS n, min(event_id) AS first FROM a WHERE ok OR NOT anyone GROUP BY 1""",
    "url_fields": r"""SELECT page_id, try_cast(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), nullif(regexp_extract(url, '/(\d+)', 1), '')) AS INT) AS number,
        CASE WHEN regexp_extract(url, '://([^./]+)\.', 1) IN ('www', 'm', 'blog') THEN regexp_extract(url, '://([^./]+)\.', 1) ELSE 'main' END AS role, nullif(regexp_extract(url, '://[^/]+/([a-z]{2})/', 1), '') AS lang FROM pages""",
    "monotone_check": f"""WITH {EV}, r AS (SELECT user_id, row_number() OVER w AS i, value < lag(value) OVER w AS fall FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, coalesce(NOT bool_or(fall), true) AS monotone, min(CASE WHEN fall THEN i END) AS first_fall FROM r GROUP BY 1""",
    "bar_prior": f"""WITH {EV}, s AS (SELECT *, (t + 10800000000) // 21600000000 AS slot FROM ev), p AS (SELECT event_id, value, CASE WHEN slot % 16 = 0 THEN 1.0::DOUBLE WHEN slot % 4 = 0 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END * exp(-abs(t - slot * 21600000000) / 7200000000.0::DOUBLE) AS p FROM s)
        SELECT event_id, round(p, 6) AS prior, round(value * (1 + 0.25::DOUBLE * p), 4) AS adjusted FROM p""",
    "cluster_alternates": f"""WITH {EV}, r AS (SELECT *, t // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, t // 86400000000 ORDER BY value DESC, event_id) AS k FROM ev)
        SELECT user_id, day, max(CASE WHEN k = 1 THEN event_id END) AS event_id, coalesce(string_agg(CASE WHEN k > 1 THEN event_id::VARCHAR END, ',' ORDER BY k), '') AS alternates FROM r WHERE k <= 7 GROUP BY 1, 2""",
    "tier_top_up": f"""WITH {EV}, p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 END AS pr FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pr, value DESC, event_id) AS k FROM p WHERE pr IS NOT NULL)
        SELECT user_id, event_id, CASE WHEN pr = 0 THEN 'main' ELSE 'top_up' END AS part FROM r WHERE pr = 0 OR k <= 3""",
    "regression_seeds": f"WITH {ERRORS} SELECT event_id, round(abs(e), 6) AS error FROM errs WHERE abs(e) >= 2 ORDER BY abs(e) DESC, event_id LIMIT 200",
    "promotion_gate": """WITH o AS (SELECT o_orderpriority, abs(o_totalprice - 100000.0::DOUBLE) AS a, abs(o_totalprice * 0.9::DOUBLE - 100000.0::DOUBLE) AS b FROM orders),
        m AS (SELECT o_orderpriority, round(quantile_cont(a, 0.5), 4) AS old_median, round(quantile_cont(b, 0.5), 4) AS new_median, round(quantile_cont(a, 0.95), 4) AS old_p95, round(quantile_cont(b, 0.95), 4) AS new_p95 FROM o GROUP BY 1)
        SELECT *, new_median <= old_median AND new_p95 <= old_p95 AND (new_median < old_median OR new_p95 < old_p95) AS promote FROM m""",
    "hard_negatives": """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id::VARCHAR)) AS j FROM d WHERE k > 3)
        SELECT source, doc_id, 'hard' AS kind FROM d WHERE k <= 3 UNION ALL SELECT source, doc_id, 'random' FROM r WHERE j <= 3""",
    "candidate_vector": f"""WITH {EV} SELECT event_id, (event_type = 'click')::BIGINT AS is_click, (event_type = 'view')::BIGINT AS is_view, (event_type = 'purchase')::BIGINT AS is_purchase, round(1.0::DOUBLE / row_number() OVER b, 6) AS rank_inverse, round(value / max(value) OVER (PARTITION BY user_id) + 1e-9::DOUBLE, 6) AS share_of_best,
        round(value - coalesce(lead(value) OVER b, 0), 6) AS margin_next, round(sin(((t // 3600000000) % 24) * 2 * 3.141592653589793::DOUBLE / 24), 5) AS phase_sin FROM ev WINDOW b AS (PARTITION BY user_id ORDER BY value DESC, event_id)""",
    "merged_times": f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, t::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
        walk AS (SELECT user_id, i, t AS v, 1 AS n, 1 AS c FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, CASE WHEN r.t - v <= 7200000000 THEN (v + r.t) / 2 ELSE r.t END, CASE WHEN r.t - v <= 7200000000 THEN n + 1 ELSE 1 END, CASE WHEN r.t - v <= 7200000000 THEN c ELSE c + 1 END FROM walk JOIN r ON r.user_id = walk.user_id AND r.i = walk.i + 1),
        z AS (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY i DESC) AS k FROM walk) SELECT user_id, round(v, 6) AS value, n::BIGINT AS n FROM z WHERE k = 1""",
    "append_if_apart": f"""WITH RECURSIVE {EV}, free AS (SELECT s.* FROM ev s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = s.user_id AND abs(p.t - s.t) <= 43200000000)),
        walk AS (SELECT user_id, list({{'t': t, 'id': event_id}} ORDER BY t, event_id) AS l FROM free GROUP BY 1 UNION ALL SELECT user_id, list_filter(l, lambda x: abs(x.t - l[1].t) > 43200000000) FROM walk WHERE len(l) > 0)
        SELECT user_id, event_id FROM ev WHERE event_type = 'purchase' UNION ALL SELECT user_id, l[1].id FROM walk WHERE len(l) > 0""",
    "diversified_choice": f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS s FROM ev),
        p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k <= 3 THEN 0 WHEN s <= 3 THEN 1 ELSE 2 END, value DESC, event_id) AS place FROM k) SELECT * FROM p WHERE place <= 12""",
}
