"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import ranking as R
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return J.ranked(events(spark, sf), ["user_id"], F.desc("value"), F.col("event_id"))


def truths(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("truth_id"), F.col("t").alias("truth_t"))


def nearest_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Per truth: for each of the first K ranks, the smallest distance of a candidate."""
    near = J.within(truths(spark, sf), candidates(spark, sf).where("rank <= 10"), "user_id", "truth_t", "t", 24 * HOUR)
    return near.select("user_id", "truth_id", "rank", F.abs(F.col("t") - F.col("truth_t")).alias("gap"))


def oracle_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Share of truths with a candidate among the first K within a tolerance, for all K and tolerances."""
    hits = nearest_candidate(spark, sf)
    cells = [(k, h) for k in (1, 3, 5, 10) for h in (1, 6, 24)]
    flags = [F.max(((F.col("rank") <= k) & (F.col("gap") <= h * HOUR)).cast("int")).alias(f"c{k}_{h}") for k, h in cells]
    per = truths(spark, sf).select("truth_id").join(hits.groupBy("truth_id").agg(*flags), "truth_id", "left")
    sums = per.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"c{k}_{h}"), F.lit(0)).alias(f"c{k}_{h}") for k, h in cells))
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("hours"), F.col(f"c{k}_{h}").cast("long").alias("hits")) for k, h in cells)))
    return sums.select("n", rows.alias("c")).select("c.k", "c.hours", "c.hits", F.round(100.0 * F.col("c.hits") / F.col("n"), 6).alias("percent"))


def case_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Truths by case: no candidate near (generation miss), only lower ranks near (ranking miss), or correct."""
    hits = nearest_candidate(spark, sf).where(F.col("gap") <= 6 * HOUR).groupBy("truth_id").agg(F.min("rank").alias("best"))
    case = F.when(F.col("best").isNull(), "generation_miss").when(F.col("best") > 1, "ranking_miss").otherwise("correct")
    return truths(spark, sf).join(hits, "truth_id", "left").groupBy(case.alias("case_type")).agg(F.count("*").alias("n"))


def summary_enrich_left(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("toxic"))


def coverage_diff(spark: SparkSession, sf: str) -> DataFrame:
    return J.coverage(table(spark, sf, "documents").where("n_chars > 800"), table(spark, sf, "labels"), "doc_id").groupBy("side").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def active_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to review: unlabelled first, then low quality, then long; scored, with their place by score and id."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "source").join(table(spark, sf, "labels"), "doc_id", "left").where("quality is null or quality = 0 or toxic = 1")
    score = F.when(F.col("quality").isNull(), 1.0).otherwise(0.0) + F.when(F.col("toxic") == 1, 0.5).otherwise(0.0) + F.least(F.col("n_chars") / 10000.0, F.lit(1.0))
    reason = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").otherwise("low_quality")
    out = rows.select("doc_id", reason.alias("reason"), F.round(score, 6).alias("score"))
    return R.places(out, [F.desc("score"), F.col("doc_id")])


def three_tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found in the catalogue of pages by url, then by address without query, then by host, where that is unique."""
    url = F.col("url")
    keys = lambda d: d.withColumn("exact", url).withColumn("stem", F.regexp_extract(url, r"^[^?#]*", 0)).withColumn("slug", F.regexp_extract(url, r"://(?:www\.|m\.|blog\.)?([^/]*)", 1))
    pages = table(spark, sf, "pages").select("page_id", "url")
    found = J.cascade(keys(pages.where("page_id % 2 = 1")), keys(pages.where("page_id % 2 = 0")), ["exact", "stem", "slug"], "page_id")
    return found.select("page_id", "tier", "found")


def nearest_asof(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    left = ev.where("event_type = 'click'").select("user_id", "t", "event_id")
    return J.asof_nearest(left, ev.where("event_type = 'purchase'"), "user_id", "t", "event_id").select("event_id", "near_t", "error")


def tolerance_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    pairs = J.within(ev.where("event_type = 'signup'").select("user_id", "t", "event_id"), ev.where("event_type = 'error'").select("user_id", F.col("t").alias("t2"), F.col("event_id").alias("other_id")), "user_id", "t", "t2", 6 * HOUR)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n_near"), F.min(F.abs(F.col("t2") - F.col("t"))).alias("least_gap"))


def interval_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Events in six-hour bars that begin at each user's first event: per bar and role, count and mean."""
    ev = events(spark, sf)
    span = ev.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    bars = span.select("user_id", "t0", F.explode(F.sequence(F.lit(0), ((F.col("t1") - F.col("t0")) / (6 * HOUR)).cast("int"))).alias("bar"))
    bars = bars.select("user_id", F.col("bar").cast("long").alias("bar"), (F.col("t0") + F.col("bar") * 6 * HOUR).alias("start"), (F.col("t0") + (F.col("bar") + 1) * 6 * HOUR).alias("end"))
    hits = J.in_intervals(ev, bars, "user_id", "t", "start", "end", 24 * HOUR)
    return hits.groupBy("user_id", "bar", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def section_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events in overlapping sections (a day from each signup, both ends included); the last section wins."""
    ev = events(spark, sf)
    sections = ev.where("event_type = 'signup'").select("user_id", F.col("t").alias("start"), (F.col("t") + 24 * HOUR).alias("end"), F.col("event_id").alias("section"))
    hits = J.in_intervals(ev, sections, "user_id", "t", "start", "end", 24 * HOUR, closed=True)
    last = hits.groupBy("event_id").agg(F.max(F.struct("start", "section")).alias("s"))
    return last.select("event_id", F.col("s.section").alias("section"))


def pair_fanout(spark: SparkSession, sf: str) -> DataFrame:
    pairs = J.fan_out(events(spark, sf), "user_id", "t", "event_id", "value", HOUR, 24 * HOUR, 3)
    return pairs.select("event_id", F.col("key2").alias("other_id"), "rank")


def pairwise_diff(spark: SparkSession, sf: str) -> DataFrame:
    """All ordered pairs of a user's candidates: difference of score and time. A skewed user's side of the join is split by adaptive execution."""
    top = candidates(spark, sf)
    other = top.select("user_id", F.col("rank").alias("rank2"), F.col("value").alias("value2"), F.col("t").alias("t2"))
    return top.join(other, "user_id").where("rank <> rank2").select("user_id", "rank", "rank2", F.round(F.col("value") - F.col("value2"), 6).alias("d_value"), (F.col("t") - F.col("t2")).alias("d_t"))


def oracle_pairs_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Best candidate against all others of its group, at least an hour apart, as positive and negative pairs with weights."""
    top = candidates(spark, sf)
    best = top.where("rank = 1").select("user_id", F.col("value").alias("best_value"), F.col("t").alias("best_t"))
    rows = top.where("rank > 1").join(best, "user_id").where(F.abs(F.col("t") - F.col("best_t")) >= HOUR)
    d = F.col("best_value") - F.col("value")
    sign = rows.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return sign.select("user_id", "rank", F.col("sign").cast("long").alias("sign"), F.round(d * F.col("sign"), 6).alias("diff"), F.round(F.least(F.lit(2.0), 0.5 + d / 100.0), 6).alias("weight"))


def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two scoring rules of orders side by side: improved, worse, unchanged, by priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    a = o.select("o_orderkey", "o_orderpriority", F.abs(F.col("o_totalprice") - 100000.0).alias("a"))
    b = o.select("o_orderkey", F.abs(F.col("o_totalprice") * 0.9 - 100000.0).alias("b"))
    d = a.join(b, "o_orderkey").withColumn("d", F.round(F.col("a") - F.col("b"), 4))
    case = F.when(F.col("d") > 0, "improved").when(F.col("d") < 0, "worse").otherwise("unchanged")
    return d.groupBy("o_orderpriority", case.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean_gain"), F.round(F.max(F.abs("d")), 4).alias("most"))


def token_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's best match among brand-mates that share a token with its name: containment or Jaccard of the token sets; a match less than 0.05 ahead of the next is rejected.

    Parts with the same tokens are one set, and only sets that share a token meet (a join on brand and token, counted per pair), so a hot name costs no
    pairs of its parts. Of a set its first three keys are kept: enough for the best and the second of every part outside of itself.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda x: x != "")))
    p = table(spark, sf, "part").select("p_partkey", "p_brand", tokens.alias("tokens")).withColumn("set", F.array_join("tokens", " "))
    keys = J.ranked(p.where("set <> ''"), ["p_brand", "set"], F.col("p_partkey")).where("rank <= 3").select("p_brand", "set", "tokens", F.col("p_partkey").alias("other"))
    sets = keys.select("p_brand", "set", "tokens").distinct()
    each = sets.select("p_brand", "set", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    mate = each.select("p_brand", "token", F.col("set").alias("set2"), F.col("n").alias("n2"))
    shared = each.join(mate, ["p_brand", "token"]).groupBy("p_brand", "set", "set2", "n", "n2").agg(F.count("*").alias("same"))
    score = F.round(F.greatest(F.col("same") / F.least("n", "n2"), F.col("same") / (F.col("n") + F.col("n2") - F.col("same"))), 6)
    found = shared.select("p_brand", "set", "set2", score.alias("score")).join(keys.select("p_brand", F.col("set").alias("set2"), "other"), ["p_brand", "set2"])
    top = J.ranked(found, ["p_brand", "set"], F.desc("score"), F.col("other")).where("rank <= 3").groupBy("p_brand", "set").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))).alias("top"))
    near = p.join(top, ["p_brand", "set"], "left").select("p_partkey", F.filter("top", lambda x: x["other"] != F.col("p_partkey")).alias("c"))
    first, second = F.get("c", F.lit(0)), -F.get("c", F.lit(1))["s"]
    sure = second.isNull() | (-first["s"] - second >= 0.05)
    return near.select("p_partkey", (-first["s"]).alias("score"), second.alias("second"), F.when(sure, first["other"]).alias("match"))


def phase_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each user's first 64 clicks with a view within an hour."""
    ev = events(spark, sf)
    first = J.ranked(ev.where("event_type = 'click'"), ["user_id"], F.col("t"), F.col("event_id")).where("rank <= 64").select("user_id", "event_id", "t")
    near = J.asof_nearest(first, ev.where("event_type = 'view'"), "user_id", "t", "event_id")
    return near.groupBy("user_id").agg(F.round(F.avg(F.coalesce((F.abs("error") <= HOUR).cast("double"), F.lit(0.0))), 6).alias("overlap"))


def seen_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose host is in no training page (even ids)."""
    host = F.regexp_extract("url", r"://([^/]*)", 1).alias("host")
    pages = table(spark, sf, "pages").select("page_id", host)
    return pages.where("page_id % 2 = 1").join(pages.where("page_id % 2 = 0").select("host").distinct(), "host", "left_anti").select("page_id", "host")


CAND = EV + ", cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev), truth AS (SELECT user_id, event_id AS truth_id, t AS truth_t FROM ev WHERE event_type = 'purchase')"
NEAR = CAND + ", near AS (SELECT truth.user_id, truth_id, rank, abs(t - truth_t) AS gap FROM truth JOIN cand USING (user_id) WHERE rank <= 10)"
H = "3600000000"

QUERIES = {
    f.__name__: f
    for f in (oracle_at_k, case_type_counts, summary_enrich_left, coverage_diff, active_queue, three_tier_lookup, nearest_asof, tolerance_candidates, interval_bars, section_range_join, pair_fanout, pairwise_diff, oracle_pairs_weighted, ab_compare, token_match, phase_overlap, seen_exclusion)
}
ORACLE = {
    "oracle_at_k": f"""WITH {NEAR}, ks AS (SELECT unnest([1,3,5,10])::BIGINT AS k), hs AS (SELECT unnest([1,6,24])::BIGINT AS hours),
        hit AS (SELECT DISTINCT k, hours, truth_id FROM near, ks, hs WHERE rank <= k AND gap <= hours * {H})
        SELECT k, hours, count(truth_id)::BIGINT AS hits, round(100.0::DOUBLE * count(truth_id) / (SELECT count(*) FROM truth), 6)::DOUBLE AS percent FROM ks CROSS JOIN hs LEFT JOIN hit USING (k, hours) GROUP BY k, hours""",
    "case_type_counts": f"""WITH {NEAR}, best AS (SELECT truth_id, min(rank) AS best FROM near WHERE gap <= 6 * {H} GROUP BY truth_id)
        SELECT CASE WHEN best IS NULL THEN 'generation_miss' WHEN best > 1 THEN 'ranking_miss' ELSE 'correct' END AS case_type, count(*)::BIGINT AS n FROM truth LEFT JOIN best USING (truth_id) GROUP BY 1""",
    "summary_enrich_left": "SELECT doc_id, lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "coverage_diff": """WITH l AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 800), r AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1),
        s AS (SELECT 'missing' AS side, doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT 'extra', doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'repeated', doc_id FROM r WHERE n > 1 AND doc_id IN (SELECT doc_id FROM l))
        SELECT side, count(*)::BIGINT AS n, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY side""",
    "active_queue": """WITH q AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END AS reason,
        round((CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN toxic = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE + least(n_chars::DOUBLE / 10000.0::DOUBLE, 1.0::DOUBLE), 6) AS score
        FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0 OR toxic = 1) SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM q""",
    "three_tier_lookup": r"""WITH k AS (SELECT page_id, url AS exact, regexp_extract(url, '^[^?#]*') AS stem, regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/]*)', 1) AS slug FROM pages),
        c AS (SELECT * FROM k WHERE page_id % 2 = 0),
        a1 AS (SELECT exact, min(page_id) AS v FROM c GROUP BY 1 HAVING count(DISTINCT page_id) = 1), a2 AS (SELECT stem, min(page_id) AS v FROM c GROUP BY 1 HAVING count(DISTINCT page_id) = 1), a3 AS (SELECT slug, min(page_id) AS v FROM c GROUP BY 1 HAVING count(DISTINCT page_id) = 1)
        SELECT page_id, (CASE WHEN a1.v IS NOT NULL THEN 1 WHEN a2.v IS NOT NULL THEN 2 WHEN a3.v IS NOT NULL THEN 3 END)::BIGINT AS tier, coalesce(a1.v, a2.v, a3.v) AS found
        FROM k LEFT JOIN a1 USING (exact) LEFT JOIN a2 USING (stem) LEFT JOIN a3 USING (slug) WHERE page_id % 2 = 1""",
    "nearest_asof": f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT DISTINCT user_id, t AS pt FROM ev WHERE event_type = 'purchase'),
        r AS (SELECT c.event_id, pt, pt - c.t AS error, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(pt - c.t), pt) AS k FROM c LEFT JOIN p USING (user_id))
        SELECT event_id, pt AS near_t, error FROM r WHERE k = 1""",
    "tolerance_candidates": f"""WITH {EV} SELECT a.event_id, count(*)::BIGINT AS n_near, min(abs(b.t - a.t)) AS least_gap FROM ev a JOIN ev b USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'error' AND abs(b.t - a.t) <= 6 * {H} GROUP BY 1""",
    "interval_bars": f"""WITH {EV}, z AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM ev)
        SELECT user_id, ((t - t0) // (6 * {H}))::BIGINT AS bar, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM z GROUP BY ALL""",
    "section_range_join": f"""WITH {EV}, s AS (SELECT user_id, t AS start, event_id AS section FROM ev WHERE event_type = 'signup'),
        r AS (SELECT ev.event_id, section, row_number() OVER (PARTITION BY ev.event_id ORDER BY start DESC, section DESC) AS k FROM ev JOIN s ON ev.user_id = s.user_id AND t BETWEEN start AND start + 24 * {H})
        SELECT event_id, section FROM r WHERE k = 1""",
    "pair_fanout": f"""WITH {EV}, r AS (SELECT a.event_id, b.event_id AS other_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.value DESC, b.t, b.event_id) AS rank FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t - a.t BETWEEN {H} AND 24 * {H})
        SELECT event_id, other_id, rank FROM r WHERE rank <= 3""",
    "pairwise_diff": f"WITH {CAND} SELECT a.user_id, a.rank, b.rank AS rank2, round(a.value - b.value, 6) AS d_value, a.t - b.t AS d_t FROM cand a JOIN cand b ON a.user_id = b.user_id AND a.rank <> b.rank",
    "oracle_pairs_weighted": f"""WITH {CAND} SELECT a.user_id, a.rank, s.sign, round((b.value - a.value) * s.sign, 6) AS diff, round(least(2.0::DOUBLE, 0.5::DOUBLE + (b.value - a.value) / 100.0::DOUBLE), 6) AS weight
        FROM cand a JOIN cand b ON a.user_id = b.user_id AND b.rank = 1, (SELECT unnest([1, -1])::BIGINT AS sign) s WHERE a.rank >= 2 AND abs(a.t - b.t) >= {H}""",
    "ab_compare": """WITH d AS (SELECT o_orderpriority, round(abs(o_totalprice - 100000.0::DOUBLE) - abs(o_totalprice * 0.9::DOUBLE - 100000.0::DOUBLE), 4) AS d FROM orders)
        SELECT o_orderpriority, CASE WHEN d > 0 THEN 'improved' WHEN d < 0 THEN 'worse' ELSE 'unchanged' END AS outcome, count(*)::BIGINT AS n, round(avg(d), 4) AS mean_gain, round(max(abs(d)), 4) AS most FROM d GROUP BY 1, 2""",
    "token_match": """WITH p AS (SELECT p_partkey, p_brand, list_filter(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')), lambda x: x <> '') AS t FROM part),
        x AS (SELECT a.p_partkey, b.p_partkey AS other, len(list_intersect(a.t, b.t)) AS same, len(a.t) AS la, len(b.t) AS lb FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
        s AS (SELECT *, round(greatest(same::DOUBLE / least(la, lb), same::DOUBLE / (la + lb - same)), 6) AS score FROM x WHERE same > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS k FROM s),
        b AS (SELECT p_partkey, max(CASE WHEN k = 1 THEN score END) AS score, max(CASE WHEN k = 2 THEN score END) AS second, max(CASE WHEN k = 1 THEN other END) AS other FROM r WHERE k <= 2 GROUP BY 1)
        SELECT p_partkey, score, second, CASE WHEN second IS NULL OR score - second >= 0.05::DOUBLE THEN other END AS match FROM p LEFT JOIN b USING (p_partkey)""",
    "phase_overlap": f"""WITH {EV}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev WHERE event_type = 'click')
        SELECT user_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM ev v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND abs(v.t - c.t) <= {H}) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS overlap FROM c WHERE k <= 64 GROUP BY 1""",
    "seen_exclusion": "WITH k AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages) SELECT page_id, host FROM k WHERE page_id % 2 = 1 AND host NOT IN (SELECT host FROM k WHERE page_id % 2 = 0)",
}
