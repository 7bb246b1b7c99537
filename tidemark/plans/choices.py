"""Queries of ranking, rules, text keys, learning and order-dependent operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import num as N
from tidemark.functions import text as T
from tidemark.operators import learning as L
from tidemark.operators import ranking as R
from tidemark.operators import sequences as S
from tidemark.operators.aggregates import first_most_common
from tidemark.sources.tables import events, table

HOUR = 3_600_000_000
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events)"


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


def tier_rules(spark: SparkSession, sf: str) -> DataFrame:
    low, long, toxic = F.col("quality") == 0, F.col("n_chars") > 5000, F.col("toxic") == 1
    tier = R.first_rule("accept", (toxic, "reject"), (low, "hold"), (F.col("quality").isNull(), "review"), (long, "review"))
    why = R.reasons((toxic, "toxic"), (low, "low_quality"), (F.col("quality").isNull(), "unlabelled"), (long, "long"), (F.col("n_chars") < 100, "short"))
    return labelled(spark, sf).select("doc_id", tier.alias("tier"), F.array_join(why, ";").alias("reasons"))


def reason_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Failure families of the tier's reasons, counted: count descending, then first seen."""
    fams = R.categories(F.col("reasons"), [("label", ("unlabelled",)), ("content", ("toxic", "low_quality")), ("size", ("long", "short"))])
    each = tier_rules(spark, sf).select("doc_id", F.explode(fams).alias("family"))
    return first_most_common(each, "family", "doc_id")


def near_best_earliest(spark: SparkSession, sf: str) -> DataFrame:
    return R.near_best_earliest(events(spark, sf), ["user_id"], "value", "t", "event_id", 0.9).select("user_id", "event_id", "value")


def coverage_trim(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage_trim(events(spark, sf), ["user_id"], "value", "t", "event_id", 20).select("user_id", "event_id", "part")


def catalogue_order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts ordered by size, brand number, brand letter, price (missing last), name, with their place."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("k"), "p_name", F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice")).alias("energy"))
    return R.places(p, [F.col("p_size"), F.col("k"), F.col("energy").asc_nulls_last(), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "place")


def key_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_size") % 12) + 1).alias("k"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("l"))
    return p.select("p_partkey", F.array_join(T.key_neighbours(F.col("k"), F.col("l")), ",").alias("keys"))


def relative_pass(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.relative_pass(events(spark, sf), ["user_id"], F.col("value") >= 400, "value", 0.8)
    return rows.where("passed").select("user_id", "event_id")


def source_priority_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and six-hour slot: the event with the largest priority of its role plus score."""
    pr = F.when(F.col("event_type") == "purchase", 300.0).when(F.col("event_type") == "signup", 200.0).otherwise(0.0)
    rows = events(spark, sf).withColumn("slot", F.expr("t div 21600000000")).withColumn("p", F.round(pr + F.col("value"), 4)).withColumn("m", -F.col("p"))
    return R.first_seen(rows, ["user_id", "slot"], ["m", "t", "event_id"]).select("user_id", "slot", "event_id", F.col("p").alias("priority"))


def energy_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Next part within a brand by size: kept if its price step is within 100 or unknown."""
    w = W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", (F.lead("p_retailprice").over(w) - F.col("p_retailprice")).alias("step"))
    return rows.where(F.col("step").isNull() | (F.abs("step") <= 100)).select("p_partkey", F.round("step", 4).alias("step"))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each user with their distance to the nearest purchase, the oracle's flag and a hit flag; users whose oracle is over a day off are left out."""
    from tidemark.operators.joins import asof_nearest

    ev = events(spark, sf)
    near = asof_nearest(ev.where("event_type <> 'purchase'").select("user_id", "t", "event_id", "value"), ev.where("event_type = 'purchase'"), "user_id", "t", "event_id").where("error is not null").withColumn("gap", F.abs("error"))
    part = W.partitionBy("user_id")
    marked = near.withColumn("least", F.min("gap").over(part)).withColumn("k", F.row_number().over(part.orderBy("gap", "event_id"))).where(F.col("least") <= 24 * HOUR)
    return marked.select("user_id", "event_id", "gap", (F.col("k") == 1).alias("oracle"), (F.col("gap") <= HOUR).alias("hit"))


def slug_keys(spark: SparkSession, sf: str) -> DataFrame:
    u = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select("page_id", T.slug(u).alias("slug"), T.compact(u).alias("compact"), T.stem(F.regexp_extract("url", "^[^?#]*", 0)).alias("stem"), T.sha_prefix(F.col("url")).alias("id"))


def title_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.col("p_name"), F.lit(" (Extended Mix) [2024]  feat. X"))
    return table(spark, sf, "part").select("p_partkey", T.title_norm(s).alias("norm"), T.strip_brackets(s).alias("bare"), F.array_join(T.tokens(s), " ").alias("tokens"), T.char_sum_bucket(F.col("p_name"), 10).cast("long").alias("bucket"))


def stable_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return L.split(docs, F.col("doc_id").cast("string"), [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).select("doc_id", "split")


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that occur in more than one split, by rows."""
    docs = L.split(table(spark, sf, "documents"), F.col("doc_id").cast("string"), [("train", 0.8), ("test", 0.2)])
    return docs.groupBy("source").agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test")).withColumn("leaks", (F.col("n_train") > 0) & (F.col("n_test") > 0))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).where("quality is not null").withColumn("score", F.least(F.col("n_chars") / 3000.0, F.lit(1.0)))


def pairwise_hinge(spark: SparkSession, sf: str) -> DataFrame:
    out = L.pairwise_hinge(scored(spark, sf), "source", "score", "quality", 0.2)
    return out.select("source", r6(F.col("hinge"), "hinge"))


def listwise_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return L.listwise_softmax(scored(spark, sf), "source", "score", "quality").select("source", r6(F.col("loss"), "loss"))


def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("logit", 4 * F.col("score") - 1)
    out = L.temperature_grid(rows, "logit", "quality", [0.5, 1.0, 1.5, 2.0, 3.0])
    return out.select("temperature", r6(F.col("nll"), "nll"))


MARKS = [[((i * 7 + j * 3) % 11 - 5) / 40 for j in range(64)] for i in range(6)]


def signature_topk(spark: SparkSession, sf: str) -> DataFrame:
    return L.signature_top(table(spark, sf, "embeddings"), "vec_id", "embedding", MARKS, 3).select("vec_id", F.round("score", 4).alias("score"))


def bpm_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Position of a time on a beat grid: nearest beat and bar-one (floor(x + 0.5)), distance, on-one flag, phrase strength of the bar."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (60.0 / (80 + F.col("l_quantity"))).alias("beat"), (F.col("l_extendedprice") / 100.0).alias("t"))
    near = F.floor(F.col("t") / F.col("beat") + 0.5)
    one = F.floor(F.col("t") / (F.col("beat") * 4) + 0.5)
    bar = F.col("one")
    strength = R.first_rule("none", (bar % 32 == 0, "32"), (bar % 16 == 0, "16"), (bar % 8 == 0, "8"), (bar % 4 == 0, "4"), (bar % 2 == 0, "2"))
    rows = li.withColumn("near", near).withColumn("one", one).withColumn("off", F.round(F.abs(F.col("t") - F.col("near") * F.col("beat")), 4))
    return rows.select("l_orderkey", "l_linenumber", "near", F.col("one").alias("bar"), "off", (F.col("near") == F.col("one") * 4).alias("on_one"), strength.alias("phrase"))


def fold_tempo(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(N.fold_tempo(F.col("p_size") * 7.0), 4).alias("bpm"))


def parse_props(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of JSON, with a default where it is missing or no number, clipped and normalised."""
    k = N.safe_float(F.get_json_object("props", "$.k"), 0.0)
    return table(spark, sf, "events").select("event_id", k.alias("k"), r6(N.clip01(k / 50.0), "share"), N.first_positive(k - 10, F.col("value")).alias("effective"))


def parse_clock(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    text = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat(n, F.lit(":30"))).when(n % 4 == 2, F.concat(F.lit("1:"), n, F.lit(":05.5"))).otherwise(F.concat(F.lit("-"), n))
    return table(spark, sf, "part").select("p_partkey", T.parse_clock(text).alias("seconds"))


def rounded_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """One line item of each part and rounded price, the first seen."""
    li = table(spark, sf, "lineitem").select("l_partkey", F.round("l_extendedprice", -3).alias("price"), "l_orderkey", "l_linenumber")
    return R.first_seen(li, ["l_partkey", "price"], ["l_orderkey", "l_linenumber"])


def role_union(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of each user in the order of their first event, as one list."""
    first = events(spark, sf).groupBy("user_id", "event_type").agg(F.min(F.struct("t", "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]), ",").alias("roles"))


def calibration_points(spark: SparkSession, sf: str) -> DataFrame:
    points = F.when(F.col("quality") == 1, 2).otherwise(0) + F.when(F.col("toxic") == 0, 1).otherwise(0) + F.when(F.col("n_chars").between(200, 5000), 1).otherwise(0)
    return labelled(spark, sf).select("doc_id", R.first_rule("LOW", (points >= 4, "HIGH"), (points >= 2, "MEDIUM")).alias("confidence"))


def review_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the deficits that are present, and a value of review that adds a bonus for each category."""
    parts = F.array(F.when(F.col("quality").isNotNull(), 1.0 - F.col("quality")), F.col("toxic").cast("double"), F.when(F.col("n_chars") < 1000, 1 - F.col("n_chars") / 1000.0))
    have = F.filter(parts, lambda x: x.isNotNull())
    near = F.aggregate(have, F.lit(0.0), lambda t, x: t + N.clip01(x), lambda t: F.when(F.size(have) > 0, t / F.size(have)).otherwise(0.0))
    bonus = F.when(F.col("quality").isNull(), 0.25).otherwise(0.0) + F.when(F.col("source") == "src0", 0.1).otherwise(0.0)
    return labelled(spark, sf).select("doc_id", r6(near, "deficit"), r6(near + bonus, "value"))


def tick(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id", "event_id", "t", "value")


def nms_suppress(spark: SparkSession, sf: str) -> DataFrame:
    return S.nms(tick(spark, sf), "user_id", "t", "value", "event_id", 6 * HOUR).select("user_id", "event_id")


def min_gap_thin(spark: SparkSession, sf: str) -> DataFrame:
    return S.thin(tick(spark, sf), "user_id", "t", "event_id", 6 * HOUR).select("user_id", "event_id")


def online_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return S.online_clusters(tick(spark, sf), "user_id", "t", "value", "event_id", 6 * HOUR).select("user_id", "event_id", "part", "cluster", "centre")


def one_to_one_match(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return S.one_to_one(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), "user_id", "t", 6 * HOUR)


QUERIES = {f.__name__: f for f in (tier_rules, reason_categories, near_best_earliest, coverage_trim, catalogue_order, key_neighbours, relative_pass, source_priority_dedupe, energy_transition, training_rows, slug_keys, title_norm, stable_split, leakage_check, pairwise_hinge, listwise_softmax, temperature_grid, signature_topk, bpm_clock, fold_tempo, parse_props, parse_clock, rounded_distinct, role_union, calibration_points, review_score, nms_suppress, min_gap_thin, online_cluster, one_to_one_match)}
LAB = "lab AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
TIERS = f"""{LAB}, tiers AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'hold' WHEN quality IS NULL THEN 'review' WHEN n_chars > 5000 THEN 'review' ELSE 'accept' END AS tier,
        concat_ws(';', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN n_chars < 100 THEN 'short' END) AS reasons FROM lab)"""
SC = f"{LAB}, sc AS (SELECT *, least(n_chars::DOUBLE / 3000.0::DOUBLE, 1.0::DOUBLE) AS score FROM lab WHERE quality IS NOT NULL)"
BUCKET = "(('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE)"
_MARKS = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in m) + "]" for m in MARKS) + "]"
ORACLE = {
    "tier_rules": f"WITH {TIERS} SELECT * FROM tiers",
    "reason_categories": f"""WITH {TIERS}, f AS (SELECT doc_id, 'label' AS family FROM tiers WHERE reasons LIKE '%unlabelled%' UNION ALL SELECT doc_id, 'content' FROM tiers WHERE reasons LIKE '%toxic%' OR reasons LIKE '%low_quality%' UNION ALL SELECT doc_id, 'size' FROM tiers WHERE reasons LIKE '%long%' OR reasons LIKE '%short%')
        SELECT family, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM f GROUP BY 1""",
    "near_best_earliest": f"WITH {EV}, x AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM x WHERE value >= m * 0.9::DOUBLE) SELECT user_id, event_id, value FROM r WHERE k = 1",
    "coverage_trim": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE k > 13)
        SELECT user_id, event_id, 'top' AS part FROM r WHERE k <= 13 UNION ALL SELECT user_id, event_id, 'spread' FROM o WHERE n <= 7 OR floor(i * 7.0::DOUBLE / n) <> floor((i - 1) * 7.0::DOUBLE / n)""",
    "catalogue_order": r"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, regexp_extract(p_brand, '(\d+)', 1)::INT, CASE WHEN p_size % 7 > 0 THEN p_retailprice END ASC NULLS LAST, p_name, p_partkey) AS place FROM part) SELECT * FROM p""",
    "key_neighbours": """WITH p AS (SELECT p_partkey, p_size % 12 + 1 AS k, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS l FROM part)
        SELECT p_partkey, k || l || ',' || (k % 12 + 1) || l || ',' || ((k + 10) % 12 + 1) || l || ',' || k || CASE WHEN l = 'A' THEN 'B' ELSE 'A' END AS keys FROM p""",
    "relative_pass": f"WITH {EV}, x AS (SELECT *, max((value >= 400)::INT) OVER (PARTITION BY user_id) AS s, max(value) OVER (PARTITION BY user_id) AS m FROM ev) SELECT user_id, event_id FROM x WHERE CASE WHEN s = 1 THEN value >= 400 ELSE value >= 0.8::DOUBLE * m END",
    "source_priority_dedupe": f"""WITH {EV}, x AS (SELECT *, t // 21600000000 AS slot, round(CASE event_type WHEN 'purchase' THEN 300 WHEN 'signup' THEN 200 ELSE 0 END + value, 4) AS priority FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY priority DESC, t, event_id) AS k FROM x)
        SELECT user_id, slot, event_id, priority FROM r WHERE k = 1""",
    "energy_transition": "WITH x AS (SELECT p_partkey, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - p_retailprice AS step FROM part) SELECT p_partkey, round(step, 4) AS step FROM x WHERE step IS NULL OR abs(step) <= 100",
    "training_rows": f"""WITH {EV}, g AS (SELECT c.user_id, c.event_id, min(abs(p.t - c.t)) AS gap FROM ev c JOIN ev p ON c.user_id = p.user_id AND p.event_type = 'purchase' WHERE c.event_type <> 'purchase' GROUP BY 1, 2),
        x AS (SELECT *, min(gap) OVER (PARTITION BY user_id) AS least, row_number() OVER (PARTITION BY user_id ORDER BY gap, event_id) AS k FROM g) SELECT user_id, event_id, gap, k = 1 AS oracle, gap <= 3600000000 AS hit FROM x WHERE least <= 86400000000""",
    "slug_keys": r"""WITH p AS (SELECT page_id, url, lower(regexp_replace(url, '^https?://', '')) AS u, regexp_extract(url, '^[^?#]*') AS s FROM pages)
        SELECT page_id, trim(regexp_replace(u, '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(u, '[^a-z0-9]+', '', 'g') AS compact, regexp_replace(regexp_extract(s, '[^/]*$'), '\.[^.]*$', '') AS stem, substr(sha1(url), 1, 12) AS id FROM p""",
    "title_norm": r"""WITH p AS (SELECT p_partkey, p_name, p_name || ' (Extended Mix) [2024]  feat. X' AS s FROM part)
        SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(s), '\s+(feat\.?|ft\.?|remix|edit)\b.*$', ''), '\s+', ' ', 'g')) AS norm, trim(regexp_replace(regexp_replace(s, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS bare,
        array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS tokens, (list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])))::BIGINT % 10)::BIGINT AS bucket FROM p""",
    "stable_split": f"SELECT doc_id, CASE WHEN {BUCKET} < 0.8 THEN 'train' WHEN {BUCKET} < 0.9 THEN 'valid' ELSE 'test' END AS split FROM documents",
    "leakage_check": f"""WITH s AS (SELECT source, {BUCKET} < 0.8 AS train FROM documents), c AS (SELECT source, count(CASE WHEN train THEN 1 END)::BIGINT AS n_train, count(CASE WHEN NOT train THEN 1 END)::BIGINT AS n_test FROM s GROUP BY 1) SELECT *, n_train > 0 AND n_test > 0 AS leaks FROM c""",
    "pairwise_hinge": f"""WITH {SC}, g AS (SELECT source, avg(CASE WHEN quality = 1 THEN score END) AS a, max(CASE WHEN quality = 0 THEN score END) AS b FROM sc GROUP BY 1) SELECT source, round(greatest(0.2::DOUBLE - a + b, 0), 6)::DOUBLE AS hinge FROM g WHERE a IS NOT NULL AND b IS NOT NULL""",
    "listwise_softmax": f"""WITH {SC}, e AS (SELECT source, quality, exp(score - max(score) OVER (PARTITION BY source)) AS e FROM sc), g AS (SELECT source, sum(e) AS z, sum(CASE WHEN quality = 1 THEN e END) AS p FROM e GROUP BY 1) SELECT source, round(ln(z) - ln(p), 6) AS loss FROM g WHERE p IS NOT NULL""",
    "temperature_grid": f"""WITH {SC}, t AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS temperature), p AS (SELECT temperature, quality, least(greatest(1 / (1 + exp(-(4 * score - 1) / temperature)), 1e-7), 1 - 1e-7) AS p FROM sc, t)
        SELECT temperature, round(avg(-CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS nll FROM p GROUP BY 1""",
    "signature_topk": f"""WITH m AS (SELECT {_MARKS} AS m), d AS (SELECT vec_id, list_sort(list_transform(m, lambda x: list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * x[i]))), 'DESC') AS d FROM embeddings, m) SELECT vec_id, round((d[1] + d[2] + d[3]) / 3, 4) AS score FROM d""",
    "bpm_clock": """WITH x AS (SELECT l_orderkey, l_linenumber, 60.0::DOUBLE / (80 + l_quantity) AS beat, l_extendedprice / 100.0::DOUBLE AS t FROM lineitem), y AS (SELECT *, floor(t / beat + 0.5::DOUBLE)::BIGINT AS near, floor(t / (beat * 4) + 0.5::DOUBLE)::BIGINT AS bar FROM x)
        SELECT l_orderkey, l_linenumber, near, bar, round(abs(t - near * beat), 4) AS off, near = bar * 4 AS on_one, CASE WHEN bar % 32 = 0 THEN '32' WHEN bar % 16 = 0 THEN '16' WHEN bar % 8 = 0 THEN '8' WHEN bar % 4 = 0 THEN '4' WHEN bar % 2 = 0 THEN '2' ELSE 'none' END AS phrase FROM y""",
    "fold_tempo": "SELECT p_partkey, round(CASE WHEN p_size > 0 THEN p_size * 7.0::DOUBLE * pow(2.0::DOUBLE, greatest(ceil(log2(80.0::DOUBLE / (p_size * 7.0::DOUBLE))), 0) - greatest(ceil(log2(p_size * 7.0::DOUBLE / 200.0::DOUBLE)), 0)) END, 4) AS bpm FROM part",
    "parse_props": """WITH x AS (SELECT event_id, value, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events) SELECT event_id, k::DOUBLE AS k, round(least(greatest(k / 50.0::DOUBLE, 0), 1), 6)::DOUBLE AS share, CASE WHEN k - 10 > 0 THEN k - 10 WHEN value > 0 THEN value END::DOUBLE AS effective FROM x""",
    "parse_clock": "SELECT p_partkey, (CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60 + 30 WHEN 2 THEN 3600 + p_size * 60 + 5.5 END)::DOUBLE AS seconds FROM part",
    "rounded_distinct": "WITH r AS (SELECT l_partkey, round(l_extendedprice, -3) AS price, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, round(l_extendedprice, -3) ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_partkey, price, l_orderkey, l_linenumber FROM r WHERE k = 1",
    "role_union": f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS k FROM ev) SELECT user_id, string_agg(event_type, ',' ORDER BY t, event_id) AS roles FROM r WHERE k = 1 GROUP BY 1",
    "calibration_points": f"""WITH {LAB}, p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 2 ELSE 0 END + CASE WHEN toxic = 0 THEN 1 ELSE 0 END + CASE WHEN n_chars BETWEEN 200 AND 5000 THEN 1 ELSE 0 END AS p FROM lab) SELECT doc_id, CASE WHEN p >= 4 THEN 'HIGH' WHEN p >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p""",
    "review_score": f"""WITH {LAB}, p AS (SELECT *, list_filter([1.0::DOUBLE - quality, toxic::DOUBLE, CASE WHEN n_chars < 1000 THEN 1 - n_chars / 1000.0::DOUBLE END], lambda x: x IS NOT NULL) AS h FROM lab), d AS (SELECT *, CASE WHEN len(h) > 0 THEN list_sum(list_transform(h, lambda x: least(greatest(x, 0), 1))) / len(h) ELSE 0 END AS d FROM p)
        SELECT doc_id, round(d, 6)::DOUBLE AS deficit, round(d + CASE WHEN quality IS NULL THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN source = 'src0' THEN 0.1 ELSE 0 END::DOUBLE, 6)::DOUBLE AS value FROM d""",
    "nms_suppress": f"""WITH RECURSIVE {EV}, walk AS (SELECT user_id, list({{'t': t, 'id': event_id}} ORDER BY value DESC, t, event_id) AS l FROM ev GROUP BY 1
        UNION ALL SELECT user_id, list_filter(l, lambda x: abs(x.t - l[1].t) >= 21600000000) FROM walk WHERE len(l) > 0) SELECT user_id, l[1].id AS event_id FROM walk WHERE len(l) > 0""",
    "one_to_one_match": f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, list(t ORDER BY t) FILTER (WHERE event_type = 'purchase') AS a, list(t ORDER BY t) FILTER (WHERE event_type = 'click') AS b FROM ev GROUP BY 1),
        walk AS (SELECT user_id, a, b, 1 AS i, 1 AS j FROM r UNION ALL SELECT user_id, a, b, CASE WHEN b[j] - a[i] >= -21600000000 THEN i + 1 ELSE i END, CASE WHEN b[j] - a[i] <= 21600000000 THEN j + 1 ELSE j END FROM walk WHERE i <= len(a) AND j <= len(b))
        SELECT user_id, a[i] AS reference_t, b[j] AS estimate_t, b[j] - a[i] AS error FROM walk WHERE i <= len(a) AND j <= len(b) AND abs(b[j] - a[i]) <= 21600000000""",
    "min_gap_thin": f"""WITH RECURSIVE {EV}, walk AS (SELECT user_id, min(t) AS t FROM ev GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(e.t) FROM ev e WHERE e.user_id = w.user_id AND e.t >= w.t + 21600000000) FROM walk w WHERE w.t IS NOT NULL),
        r AS (SELECT ev.user_id, event_id, row_number() OVER (PARTITION BY ev.user_id, ev.t ORDER BY event_id) AS k FROM ev JOIN walk ON walk.user_id = ev.user_id AND walk.t = ev.t) SELECT user_id, event_id FROM r WHERE k = 1""",
}
