"""Further queries: lookups, hypotheses, bags, logistic regression, keys and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import num as N
from tidemark.functions import text as T
from tidemark.operators import bags as B
from tidemark.operators import joins as J
from tidemark.operators import ranking as R
from tidemark.operators import windows as V
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def multi_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found under any of their key variants among the pages with even ids: the smallest id found (null: none)."""
    u = F.regexp_replace("url", "^https?://", "")
    keys = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.array(u, F.regexp_extract(u, "^[^?#]*", 0), F.regexp_replace(F.regexp_extract(u, "^[^?#]*", 0), r"(\.html|/)$", "")))).alias("key"))
    index = keys.where("page_id % 2 = 0").groupBy("key").agg(F.min("page_id").alias("hit"))
    return keys.where("page_id % 2 = 1").join(index, "key", "left").groupBy("page_id").agg(F.min("hit").alias("found"))


def best_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    """Per part: the supplier's line with the best score, ties by confidence, then the supplier."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score"), "l_discount", "l_orderkey", "l_linenumber")
    return J.ranked(li, ["l_partkey"], F.desc("score"), F.desc("l_discount"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")).where("rank = 1").select("l_partkey", "l_suppkey", "score")


def earlier_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates earlier than the best of their user that reach 0.8 of its value within two days before it: the earliest."""
    best = J.ranked(events(spark, sf), ["user_id"], F.desc("value"), F.col("event_id")).where("rank = 1").select("user_id", F.col("t").alias("bt"), F.col("value").alias("bv"), F.col("event_id").alias("best"))
    rows = events(spark, sf).join(best, "user_id").where((F.col("t") < F.col("bt")) & (F.col("t") >= F.col("bt") - 48 * HOUR) & (F.col("value") >= 0.8 * F.col("bv")))
    return rows.groupBy("user_id", "best").agg(F.min(F.struct("t", "event_id")).alias("f")).select("user_id", "best", F.col("f.event_id").alias("earlier"))


def bar_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, over days: mean activity, coefficient of variation, share of days above 100."""
    d = events(spark, sf).groupBy("user_id", F.expr("t div 86400000000").alias("day")).agg(F.round(F.sum("value"), 4).alias("x"))
    return d.groupBy("user_id").agg(r6(F.avg("x"), "mean"), r6(F.try_divide(F.stddev_pop("x"), F.avg("x")), "variation"), r6(F.avg((F.col("x") > 100).cast("double")), "active"))


def bag_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Bags of (role, hour) of single days merged over four-day ranges: distinct items, total, largest count."""
    rows = events(spark, sf).groupBy("user_id", F.expr("t div (4 * 86400000000)").alias("range"), F.concat_ws("/", "event_type", F.expr("t div 3600000000 % 24")).alias("item")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id", "range").agg(F.count("*").alias("items"), F.sum("n").alias("total"), F.max("n").alias("most"))


def bag_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """1 - weighted Jaccard of each user's role bags of consecutive days with events."""
    day = F.expr("t div 86400000000")
    bags = events(spark, sf).select("user_id", day.alias("day"), "event_type").groupBy("user_id", "day").pivot("event_type", ["click", "view", "signup", "purchase", "error"]).count().na.fill(0)
    w = W.partitionBy("user_id").orderBy("day")
    roles = ["click", "view", "signup", "purchase", "error"]
    low = sum((F.least(F.col(r), F.lag(r).over(w)) for r in roles[1:]), F.least(F.col(roles[0]), F.lag(roles[0]).over(w)))
    high = sum((F.greatest(F.col(r), F.lag(r).over(w)) for r in roles[1:]), F.greatest(F.col(roles[0]), F.lag(roles[0]).over(w)))
    rows = bags.select("user_id", "day", F.lag("day").over(w).alias("before"), low.alias("low"), high.alias("high")).where("before is not null")
    return rows.select("user_id", "day", r6(1 - F.col("low") / F.col("high"), "novelty"))


def repeat_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Mean similarity of neighbouring days' bags of a user."""
    return bag_novelty(spark, sf).groupBy("user_id").agg(r6(F.avg(1 - F.col("novelty")), "stability"))


def energy_jump(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value is at least 100 above the user's previous one, with the jump."""
    w = V.ordered(["user_id"], "t", "event_id")
    rows = events(spark, sf).withColumn("jump", F.col("value") - F.lag("value").over(w))
    return rows.where("jump >= 100").select("event_id", F.round("jump", 4).alias("jump"))


def robust_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Value over the user's median, in interquartile ranges, clipped to 3 either way."""
    part = W.partitionBy("user_id")
    q = lambda p: F.percentile("value", F.lit(p)).over(part)
    rows = events(spark, sf).select("event_id", "value", q(0.5).alias("m"), (q(0.75) - q(0.25)).alias("iqr"))
    return rows.select("event_id", r6(F.greatest(F.least(F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("iqr")), F.lit(0.0)), F.lit(3.0)), F.lit(-3.0)), "z"))


def logistic_step(spark: SparkSession, sf: str) -> DataFrame:
    """Class-balanced logistic regression of quality on two standardised features: three full gradient steps, each an aggregate over the table."""
    d = table(spark, sf, "documents").select("doc_id", F.log(F.col("n_chars") + 1.0).alias("a"), (F.col("lang") == "en").cast("double").alias("b")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    s = d.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b"), F.sum(F.col("quality").cast("double")), F.sum(1.0 - F.col("quality"))).first()
    z = d.select(((F.col("a") - s[0]) / s[1]).alias("a"), ((F.col("b") - s[2]) / s[3]).alias("b"), F.col("quality").cast("double").alias("y"), F.when(F.col("quality") == 1, 0.5 / s[4]).otherwise(0.5 / s[5]).alias("w"))
    wa = wb = c = 0.0
    for _ in range(3):
        p = N.sigmoid(F.col("a") * wa + F.col("b") * wb + c)
        g = z.agg(*(F.sum(F.col("w") * (p - F.col("y")) * x) for x in (F.col("a"), F.col("b"), F.lit(1.0)))).first()
        wa, wb, c = wa - g[0] - 0.01 * wa, wb - g[1] - 0.01 * wb, c - g[2]
    out = spark.range(1).select(F.round(F.lit(wa), 6).alias("w_length"), F.round(F.lit(wb), 6).alias("w_english"), F.round(F.lit(c), 6).alias("bias"))
    return out


def boom_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of a role's profile: quantiles of its values, widened and held within bounds."""
    q = lambda p: F.percentile("value", F.lit(p))
    return events(spark, sf).groupBy("event_type").agg(r6(F.greatest(q(0.1) * 0.9, F.lit(1.0)), "floor"), r6(F.least(q(0.95) * 1.1, F.lit(480.0)), "ceiling"), r6(q(0.75) - q(0.25), "spread"))


def later_stronger(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest event of at least 150; a later one within a week overrides it if it is 1.5 times as strong (the earliest such)."""
    first = events(spark, sf).where("value >= 150").groupBy("user_id").agg(F.min(F.struct("t", "event_id", "value")).alias("f"))
    rows = events(spark, sf).join(first, "user_id").where((F.col("t") > F.col("f.t")) & (F.col("t") <= F.col("f.t") + 168 * HOUR) & (F.col("value") >= 1.5 * F.col("f.value")))
    later = rows.groupBy("user_id").agg(F.min(F.struct("t", "event_id")).alias("l"))
    return first.join(later, "user_id", "left").select("user_id", F.coalesce("l.event_id", "f.event_id").alias("event_id"), F.col("l").isNotNull().alias("overridden"))


def queue_order(spark: SparkSession, sf: str) -> DataFrame:
    """Review queue of orders: status first, then expected value (price by risk), then key, with their place and reason."""
    risk = F.when(F.col("o_orderpriority").startswith("1"), 1.0).when(F.col("o_orderpriority").startswith("2"), 0.8).otherwise(0.3)
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("s"), N.half_up(F.col("o_totalprice") * risk, 2).alias("v"))
    reason = F.concat(F.element_at(F.array(F.lit("open"), F.lit("partial"), F.lit("done")), F.col("s") + 1), F.lit(":"), F.when(F.col("v") >= 200000, "high").otherwise("normal")).alias("reason")
    return R.places(rows, [F.col("s"), F.desc("v"), F.col("o_orderkey")]).select("o_orderkey", "place", reason)


def artist_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in order of price with at most three of a brand, numbered."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    kept = J.ranked(p, ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey")).where("rank <= 3")
    return R.places(kept, [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "place")


def next_track(spark: SparkSession, sf: str) -> DataFrame:
    """For each part: the best next part of the same brand, size up to 4 larger, nearest in price (ties by a stable hash).

    By brand and size, a part sees the nearest price below, its own and the nearest above; parts of one price are represented by the two that come first by hash,
    so no pairs of brand-mates are made.
    """
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    mates = J.ranked(p.withColumn("h", F.sha1(F.col("p_partkey").cast("string").cast("binary"))), ["p_brand", "p_size", "cents"], F.col("h")).where("rank <= 2")
    mates = mates.select("p_brand", F.col("p_size").alias("size2"), F.col("cents").alias("cents2"), F.col("p_partkey").alias("next"), "h")
    asks = p.withColumn("size2", F.explode(F.sequence(F.col("p_size"), F.col("p_size") + 4)))
    both = asks.withColumn("has", F.lit(None).cast("long")).unionByName(mates.select("p_brand", "size2", F.col("cents2").alias("cents"), F.col("cents2").alias("has")).distinct(), allowMissingColumns=True)
    by = W.partitionBy("p_brand", "size2").orderBy("cents")
    seen = both.select("*", F.max("has").over(by.rangeBetween(W.unboundedPreceding, -1)).alias("below"), F.max("has").over(by.rangeBetween(0, 0)).alias("same"), F.min("has").over(by.rangeBetween(1, W.unboundedFollowing)).alias("above"))
    near = seen.where("p_partkey is not null").select("p_partkey", "p_brand", "size2", "cents", F.explode(F.array("below", "same", "above")).alias("cents2")).where("cents2 is not null")
    found = near.join(mates, ["p_brand", "size2", "cents2"]).where("next <> p_partkey").withColumn("d", F.abs(F.col("cents") - F.col("cents2")) / 100)
    return J.ranked(found, ["p_partkey"], F.col("d"), F.col("h")).where("rank = 1").select("p_partkey", "next", F.round("d", 2).alias("d"))


def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Six digits without zeros at the end, hash ids of three columns, buckets."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", T.number_text(F.col("l_discount")).alias("discount"), T.sha_prefix(key, 10).alias("row_id"), r6(T.stable_bucket(key), "bucket")).distinct()


def split_names(spark: SparkSession, sf: str) -> DataFrame:
    """Artist and title of `artist - title`, and the two swapped."""
    s = F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 3 > 0, F.lit(" - ")).otherwise(F.lit(" ")), F.regexp_replace("p_name", r"^\S+\s*", ""))
    artist, title = T.split_artist(s)
    return table(spark, sf, "part").select("p_partkey", artist.alias("artist"), title.alias("title"), F.when(artist != "", F.concat_ws(" - ", title, artist)).otherwise(s).alias("swapped"))


def interpolated_values(spark: SparkSession, sf: str) -> DataFrame:
    """Value of each user's curve at the middle of January, linear between the events around, clamped at the ends."""
    at = 1_705_320_000_000_000
    rows = events(spark, sf)
    a = rows.where(F.col("t") <= at).groupBy("user_id").agg(F.max(F.struct("t", "event_id", "value")).alias("a"))
    b = rows.where(F.col("t") > at).groupBy("user_id").agg(F.min(F.struct("t", "event_id", "value")).alias("b"))
    both = a.join(b, "user_id", "full")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    return both.select("user_id", r6(N.interpolate(F.lit(at), a["t"], a["value"], b["t"], b["value"]), "value"))


def nested_provider_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Weights by the longest prefix of a nested name (parts joined by colons) in a table of weights, else 1."""
    weights = F.create_map(*(F.lit(x) for kv in {"src0": 2.0, "src1:en": 1.5, "src1": 0.4}.items() for x in kv))
    name = F.concat_ws(":", "source", "lang")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(weights[name], weights[F.col("source")], F.lit(1.0)).alias("weight"))


def source_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: sources in the order of their first document, as one list, and how many."""
    first = table(spark, sf, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("f"))
    return first.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "source"))), lambda s: s["source"]), ",").alias("sources"), F.count("*").alias("n"))


def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts only in one half of the pages or in both (EXCEPT both ways and INTERSECT): counts."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"://([^/]*)", 1).alias("host"))
    a, b = p.where("page_id % 2 = 0").select("host"), p.where("page_id % 2 = 1").select("host")
    parts = [a.subtract(b), b.subtract(a), a.intersect(b)]
    rows = [x.agg(F.count("*").alias("n")).withColumn("part", F.lit(n)) for x, n in zip(parts, ("left", "right", "both"), strict=True)]
    return rows[0].union(rows[1]).union(rows[2]).select("part", "n")


def action_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Actions for each source by its metrics: label more, check toxicity, retrain, or none."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    m = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").isNotNull().cast("double")), 6).alias("cover"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))
    act = R.reasons((F.col("cover") < 0.4, "label"), (F.col("toxic") > 0.1, "check_toxicity"), (F.col("quality") < 0.85, "retrain"))
    return m.select("source", "n", F.array_join(F.when(F.size(act) > 0, act).otherwise(F.array(F.lit("none"))), ";").alias("actions"))


def detector_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tempo bands (half open) and tiers of parts: counts, mean price and share of the band, with a total row (rollup)."""
    bpm = N.fold_tempo(F.col("p_size") * 7.0)
    band = F.when(bpm < 100, "slow").when(bpm < 140, "mid").otherwise("fast")
    p = table(spark, sf, "part").select(band.alias("band"), "p_brand", "p_retailprice")
    return p.rollup("band").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice"), "mean_price")).select(F.coalesce("band", F.lit("all")).alias("band"), "n", "mean_price")


def top_bags(spark: SparkSession, sf: str) -> DataFrame:
    """The ten commonest pairs of neighbouring words of the documents' whole texts, ties by the pair. Texts are dealt out first, as a file may be one row group."""
    texts = table(spark, sf, "documents").select("text", F.monotonically_increasing_id().alias("deal")).repartition("deal")
    # empty words are at the ends only
    return B.commonest_pairs(texts.select(F.split(F.lower("text"), r"\P{L}+").alias("w")), "w", 10)


QUERIES = {f.__name__: f for f in (multi_key_lookup, best_hypothesis, earlier_filter, bar_stability, bag_merge, bag_novelty, repeat_stability, energy_jump, robust_normalise, logistic_step, boom_thresholds, later_stronger, queue_order, artist_caps, next_track, number_formats, split_names, interpolated_values, nested_provider_weight, source_sets, split_overlap, action_recommendations, detector_tiers, top_bags)}
FOLD = "p_size * 7.0::DOUBLE * pow(2.0::DOUBLE, greatest(ceil(log2(80.0::DOUBLE / (p_size * 7.0::DOUBLE))), 0) - greatest(ceil(log2(p_size * 7.0::DOUBLE / 200.0::DOUBLE)), 0))"
NOV = f"""{EV}, bag AS (SELECT user_id, t // 86400000000 AS day, {', '.join(f"count(*) FILTER (WHERE event_type = '{r}') AS {r}" for r in ('click', 'view', 'signup', 'purchase', 'error'))} FROM ev GROUP BY 1, 2),
    l AS (SELECT *, lag(day) OVER w AS before, {', '.join(f'lag({r}) OVER w AS l_{r}' for r in ('click', 'view', 'signup', 'purchase', 'error'))} FROM bag WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    nov AS (SELECT user_id, day, round(1 - ({' + '.join(f'least({r}, l_{r})' for r in ('click', 'view', 'signup', 'purchase', 'error'))})::DOUBLE / ({' + '.join(f'greatest({r}, l_{r})' for r in ('click', 'view', 'signup', 'purchase', 'error'))}), 6) AS novelty FROM l WHERE before IS NOT NULL)"""
_STEP = "g{i} AS (SELECT sum(w * (1 / (1 + exp(-(a * wa + b * wb + c))) - y) * a) AS ga, sum(w * (1 / (1 + exp(-(a * wa + b * wb + c))) - y) * b) AS gb, sum(w * (1 / (1 + exp(-(a * wa + b * wb + c))) - y)) AS gc, any_value(wa) AS wa, any_value(wb) AS wb, any_value(c) AS c FROM z, p{j}), p{i} AS (SELECT wa - ga - 0.01::DOUBLE * wa AS wa, wb - gb - 0.01::DOUBLE * wb AS wb, c - gc AS c FROM g{i})"
ORACLE = {
    "multi_key_lookup": r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages), v AS (SELECT page_id, u, regexp_extract(u, '^[^?#]*') AS s FROM u), k AS (SELECT DISTINCT page_id, unnest([u, s, regexp_replace(s, '(\.html|/)$', '')]) AS key FROM v),
        i AS (SELECT key, min(page_id) AS hit FROM k WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, min(hit) AS found FROM k LEFT JOIN i USING (key) WHERE page_id % 2 = 1 GROUP BY 1""",
    "best_hypothesis": "WITH r AS (SELECT l_partkey, l_suppkey, l_extendedprice AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount DESC, l_suppkey, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_partkey, l_suppkey, score FROM r WHERE k = 1",
    "earlier_filter": f"""WITH {EV}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM ev) WHERE k = 1),
        r AS (SELECT ev.user_id, b.event_id AS best, ev.event_id AS earlier, row_number() OVER (PARTITION BY ev.user_id ORDER BY ev.t, ev.event_id) AS k FROM ev JOIN b USING (user_id) WHERE ev.t < b.t AND ev.t >= b.t - 48 * 3600000000 AND ev.value >= 0.8::DOUBLE * b.value) SELECT user_id, best, earlier FROM r WHERE k = 1""",
    "bar_stability": f"WITH {EV}, d AS (SELECT user_id, t // 86400000000 AS day, round(sum(value), 4) AS x FROM ev GROUP BY 1, 2) SELECT user_id, round(avg(x), 6) AS mean, round(stddev_pop(x) / avg(x), 6) AS variation, round(avg((x > 100)::INT), 6) AS active FROM d GROUP BY 1",
    "bag_merge": f"WITH {EV}, b AS (SELECT user_id, t // 345600000000 AS range, event_type || '/' || (t // 3600000000) % 24 AS item, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, range, count(*)::BIGINT AS items, sum(n)::BIGINT AS total, max(n)::BIGINT AS most FROM b GROUP BY 1, 2",
    "bag_novelty": f"WITH {NOV} SELECT * FROM nov",
    "repeat_stability": f"WITH {NOV} SELECT user_id, round(avg(1 - novelty), 6) AS stability FROM nov GROUP BY 1",
    "energy_jump": f"WITH {EV}, j AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS j FROM ev) SELECT event_id, round(j, 4) AS jump FROM j WHERE j >= 100",
    "robust_normalise": f"""WITH {EV}, q AS (SELECT user_id, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ev GROUP BY 1)
        SELECT event_id, round(greatest(least(CASE WHEN iqr > 0 THEN (value - m) / iqr ELSE 0 END, 3), -3), 6)::DOUBLE AS z FROM ev JOIN q USING (user_id)""",
    "logistic_step": f"""WITH d AS (SELECT ln(n_chars + 1.0::DOUBLE) AS a, (lang = 'en')::INT::DOUBLE AS b, quality AS y FROM documents JOIN labels USING (doc_id)), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM d),
        z AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, y::DOUBLE AS y, CASE WHEN y = 1 THEN 0.5::DOUBLE / n1 ELSE 0.5::DOUBLE / n0 END AS w FROM d, s), p0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS c), {', '.join(_STEP.format(i=i, j=i - 1) for i in (1, 2, 3))}
        SELECT round(wa, 6) AS w_length, round(wb, 6) AS w_english, round(c, 6) AS bias FROM p3""",
    "boom_thresholds": "SELECT event_type, round(greatest(quantile_cont(value, 0.1) * 0.9::DOUBLE, 1), 6)::DOUBLE AS floor, round(least(quantile_cont(value, 0.95) * 1.1::DOUBLE, 480), 6)::DOUBLE AS ceiling, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS spread FROM events GROUP BY 1",
    "later_stronger": f"""WITH {EV}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev WHERE value >= 150) WHERE k = 1), l AS (SELECT ev.user_id, ev.event_id, row_number() OVER (PARTITION BY ev.user_id ORDER BY ev.t, ev.event_id) AS k FROM ev JOIN f USING (user_id) WHERE ev.t > f.t AND ev.t <= f.t + 604800000000 AND ev.value >= 1.5::DOUBLE * f.value)
        SELECT f.user_id, coalesce(l.event_id, f.event_id) AS event_id, l.event_id IS NOT NULL AS overridden FROM f LEFT JOIN l ON l.user_id = f.user_id AND l.k = 1""",
    "queue_order": """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS s, round(o_totalprice * CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE WHEN o_orderpriority LIKE '2%' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END, 2) AS v FROM orders),
        r AS (SELECT *, row_number() OVER (ORDER BY s, v DESC, o_orderkey) AS place FROM o) SELECT o_orderkey, place, ['open', 'partial', 'done'][s + 1] || ':' || CASE WHEN v >= 200000 THEN 'high' ELSE 'normal' END AS reason FROM r""",
    "artist_caps": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM k WHERE k <= 3",
    "next_track": """WITH b AS (SELECT a.p_partkey, b.p_partkey AS next, round(abs(a.p_retailprice - b.p_retailprice), 2) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND b.p_size BETWEEN a.p_size AND a.p_size + 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, sha1(next::VARCHAR)) AS k FROM b) SELECT p_partkey, next, d FROM r WHERE k = 1""",
    "number_formats": r"""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_discount, l_orderkey || '|' || l_partkey || '|' || l_suppkey AS k FROM lineitem)
        SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, regexp_replace(regexp_replace(printf('%.6f', l_discount), '0+$', ''), '\.$', '') AS discount, substr(sha1(k), 1, 10) AS row_id, round(('0x' || substr(sha1(k), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE, 6) AS bucket FROM l""",
    "split_names": r"""WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, regexp_replace(p_name, '^\S+\s*', '') AS b, p_partkey % 3 > 0 AS d FROM part)
        SELECT p_partkey, CASE WHEN d THEN trim(a) ELSE '' END AS artist, CASE WHEN d THEN trim(b) ELSE a || ' ' || b END AS title, CASE WHEN d AND trim(a) <> '' THEN trim(b) || ' - ' || trim(a) WHEN d THEN a || ' - ' || b ELSE a || ' ' || b END AS swapped FROM s""",
    "interpolated_values": f"""WITH {EV}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS k FROM ev WHERE t <= 1705320000000000) WHERE k = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev WHERE t > 1705320000000000) WHERE k = 1)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, round(CASE WHEN a.t IS NULL THEN b.value WHEN b.t IS NULL THEN a.value ELSE a.value + (b.value - a.value) * ((1705320000000000 - a.t)::DOUBLE / (b.t - a.t)) END, 6) AS value FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "nested_provider_weight": "SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'en' THEN 1.5 WHEN source = 'src0' THEN 2.0 WHEN source = 'src1' THEN 0.4 ELSE 1.0 END::DOUBLE AS weight FROM documents",
    "source_sets": "WITH f AS (SELECT lang, source, min(doc_id) AS f FROM documents GROUP BY 1, 2) SELECT lang, string_agg(source, ',' ORDER BY f) AS sources, count(*)::BIGINT AS n FROM f GROUP BY 1",
    "split_overlap": """WITH p AS (SELECT page_id % 2 AS h, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages), x AS (SELECT host, bool_or(h = 0) AS a, bool_or(h = 1) AS b FROM p GROUP BY 1)
        SELECT unnest(['left', 'right', 'both']) AS part, unnest([count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE b AND NOT a), count(*) FILTER (WHERE a AND b)])::BIGINT AS n FROM x""",
    "action_recommendations": """WITH m AS (SELECT source, count(*)::BIGINT AS n, round(avg((quality IS NOT NULL)::INT), 6) AS c, round(avg(toxic), 6) AS t, round(avg(quality), 6) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
        a AS (SELECT source, n, concat_ws(';', CASE WHEN c < 0.4 THEN 'label' END, CASE WHEN t > 0.1 THEN 'check_toxicity' END, CASE WHEN q < 0.85 THEN 'retrain' END) AS a FROM m) SELECT source, n, CASE WHEN a = '' THEN 'none' ELSE a END AS actions FROM a""",
    "detector_tiers": f"""WITH p AS (SELECT {FOLD} AS bpm, p_retailprice FROM part), b AS (SELECT CASE WHEN bpm < 100 THEN 'slow' WHEN bpm < 140 THEN 'mid' ELSE 'fast' END AS band, p_retailprice FROM p)
        SELECT coalesce(band, 'all') AS band, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean_price FROM b GROUP BY ROLLUP (band)""",
    "top_bags": r"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w WHERE len(w) > 1) SELECT pair, count(*)::BIGINT AS n FROM p GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""",
}
