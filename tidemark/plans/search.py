"""Queries that search: gates on six axes, gates by margin, later matches of windows, novelty between flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.candidates import score_components
from tidemark.operators import bags as B
from tidemark.operators import evaluation as E
from tidemark.operators import learning as L
from tidemark.operators.gates import Axis, Goal, gate_search
from tidemark.sources.tables import events, table

#: Thresholds of the gates, strictest first.
GATE = [
    Axis("probability", tuple(round(0.995 - 0.005 * i, 3) for i in range(40))),
    Axis("predicted", (5.0, 8.0, 10.0, 15.0, 20.0, 25.0, 35.0, 50.0), at_least=False),
    Axis("confidence", (0.98, 0.96, 0.93, 0.90, 0.86, 0.80, 0.0)),
    Axis("snap", (15.0, 25.0, 45.0, 70.0, 90.0, 140.0, 220.0), at_least=False),
    Axis("fake", (0.10, 0.20, 0.35, 0.60, 1.0), at_least=False),
    Axis("margin", (0.30, 0.20, 0.10, 0.05, 0.0)),
]
GOALS = [Goal("safe", 900.0), Goal("balanced", 900.0, most_false=10.0), Goal("aggressive", 1500.0, most_false=20.0)]
PICK = [Axis("probability", tuple(round(0.99 - 0.01 * i, 3) for i in range(50))), Axis("margin", tuple(round(0.40 - 0.01 * i, 3) for i in range(41)))]
PICKS = [Goal("conservative", 0.0, most_false=100.0, most_error=900.0, never=1500.0, by_mean=True), Goal("normal", 0.0, most_false=100.0, least=3, most_error=1400.0, never=1500.0, by_mean=True), Goal("none", 0.0, most_error=-1.0)]


def chosen_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's line with the highest probability (ties: smaller predicted error, then line), with its measures and its lead over the next."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.round(1 - 2 * F.col("l_discount") + F.col("l_partkey") % 7 * 0.001, 3).alias("probability"), F.col("l_quantity").alias("predicted"),
        F.round(1 - 2.5 * F.col("l_tax"), 3).alias("confidence"), (F.col("l_suppkey") * 7 % 230).cast("double").alias("snap"), (F.col("l_partkey") * 3 % 101 / 100.0).alias("fake"))
    w = W.partitionBy("l_orderkey").orderBy(F.desc("probability"), "predicted", "l_linenumber", "l_partkey", "l_shipdate", "snap")
    one = line.withColumn("k", F.row_number().over(w)).withColumn("margin", F.round(F.col("probability") - F.lead("probability", 1, 0.0).over(w), 3)).where("k = 1")
    dated = one.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return dated.withColumn("error", F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("double"))


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "false_rate", "mean_error")})


def gate_search_six(spark: SparkSession, sf: str) -> DataFrame:
    """The gates on six axes (392,000 of them) that accept most orders within each goal."""
    return rounded(gate_search(chosen_lines(spark, sf), GATE, GOALS, "error"))


def gate_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The gates of probability and margin that accept most orders, with no error above a bound; ties by the mean error."""
    return rounded(gate_search(chosen_lines(spark, sf), PICK, PICKS, "error"))


#: Segments of half a day; a bar is two of them, a query window four bars.
SEGMENT, BAR, WINDOW = 43_200_000_000, 2, 8


def segment_bags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as bags of (role, band of value) in segments of each user from the first event of all on; the users' lengths; the queries: segments with a signup."""
    rows = events(spark, sf)
    origin = rows.agg(F.min("t")).first()[0]
    rows = rows.withColumn("seg", F.floor((F.col("t") - origin) / SEGMENT)) if origin is not None else rows.withColumn("seg", F.lit(0).cast("long"))
    bags = rows.groupBy("user_id", "seg", F.concat_ws("/", "event_type", F.floor(F.col("value") / 50).cast("string")).alias("item")).agg(F.count("*").alias("n"))
    lengths = rows.groupBy("user_id").agg((F.max("seg") + 1).alias("segments"))
    return bags, lengths, rows.where("event_type = 'signup'").select("user_id", F.col("seg").alias("start")).distinct()


def later_match(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and segment with a signup: the later window of eight segments whose bag is most alike to the one that begins there."""
    bags, lengths, queries = segment_bags(spark, sf)
    return B.later_matches(bags, queries, lengths, "user_id", "seg", "item", "n", WINDOW).withColumn("similarity", F.round("similarity", 6))


def flank_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Novelty of each segment: how little the bags of the four segments before it and of the four from it on have in common."""
    bags, lengths, _ = segment_bags(spark, sf)
    return B.flank_novelty(bags, lengths, "user_id", "seg", "item", "n", 2 * BAR).withColumn("novelty", F.round("novelty", 6))


HOUR = 3_600_000_000


def grid_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's views as estimates of the user's clicks, in hours: the full report and both scores."""
    ev = events(spark, sf).select("user_id", "t", "event_type")
    hours = {"hits": (1, 3, 6, 24), "matched": (3, 12), "kept": (3, 6, 24)}
    out = E.evaluate_grids(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), "user_id", "t", float(HOUR), **hours)
    out = out.withColumns({"strict": E.strict_score("hit_rate_3", "f1_3", "f1_12", "continuity_6"), "score": E.report_score("hit_rate_6", "f1_3", "12", "continuity_6")})
    return out.select("user_id", *(F.round(c, 6).alias(c) if k == "double" else c for c, k in out.dtypes if c != "user_id"))


def logistic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Class-balanced logistic regression of a document's quality on its length, symbols and language, to convergence."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    x = docs.select(F.log(F.length("text") + 1.0).alias("length"), (F.regexp_count("text", F.lit("[|#*$%&!]")) / (F.length("text") + 1.0)).alias("symbols"), (F.col("lang") == "en").cast("double").alias("english"), "quality")
    model = L.logistic_fit(x, ["length", "symbols", "english"], "quality")
    return spark.createDataFrame([(c, *(round(v, 6) for v in m)) for c, m in model.items()], "name string, mean double, deviation double, weight double")


def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as candidates with measures of their own and in two structs: the parts of their scores; a line stands for its order's lines, whose flags are roles."""
    li = table(spark, sf, "lineitem")
    share = lambda k, m: (F.col("l_partkey") * k % m / float(m - 1))
    features = F.struct((F.col("l_tax") * 12.5).alias("micro_confidence"), share(3, 11).alias("transient_strength"), share(5, 13).alias("low_end_jump"), share(7, 17).alias("vocal_dropout_score"), F.when(F.col("l_linenumber") % 2 == 0, share(11, 19)).alias("drop_impact_score"), share(2, 7).alias("fake_hit_penalty"))
    micro = F.struct(F.lit(0.9).alias("micro_confidence"), share(13, 23).alias("ableton_asd_quality"), (F.col("l_partkey") % 2).alias("ableton_asd_used"), (F.col("l_suppkey") % 500 - 250.0).alias("snap_offset_ms"))
    of = li.groupBy("l_orderkey").agg(F.count("*").alias("size"), F.collect_set(F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag"))).alias("roles"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("confidence_score"), F.when(F.col("l_quantity") > 25, F.col("l_quantity") / 40).alias("energy_contrast"), features.alias("features"), micro.alias("microalign")).join(of, "l_orderkey")
    out = score_components(rows, cluster_size="size", roles="roles")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(F.col("components")[c], 6).alias(c) for c in ("drums", "groove", "boundary", "agreement", "cluster", "negative", "final")))


QUERIES = {f.__name__: f for f in (component_scores, gate_search_six, gate_pick, later_match, flank_novelty, grid_evaluation, logistic_fit)}

CHOSEN = """line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, round(1 - 2 * l_discount + l_partkey % 7 * 0.001::DOUBLE, 3) AS probability, l_quantity AS predicted, round(1 - 2.5::DOUBLE * l_tax, 3) AS confidence,
    (l_suppkey * 7 % 230)::DOUBLE AS snap, (l_partkey * 3 % 101)::DOUBLE / 100.0::DOUBLE AS fake FROM lineitem),
  placed AS (SELECT *, row_number() OVER w AS k, round(probability - lead(probability, 1, 0.0::DOUBLE) OVER w, 3) AS margin FROM line WINDOW w AS (PARTITION BY l_orderkey ORDER BY probability DESC, predicted, l_linenumber, l_partkey, l_shipdate, snap)),
  chosen AS (SELECT placed.*, abs(date_diff('day', o_orderdate, l_shipdate))::DOUBLE AS error FROM placed JOIN orders ON o_orderkey = l_orderkey WHERE k = 1)"""


def _gate_sql(axes: list[Axis], goals: list[Goal]) -> str:
    """The whole grid, cumulated by a window along each axis in turn."""
    names = [f"l{k}" for k in range(len(axes))]
    limits = sorted({g.limit for g in goals} | {g.never for g in goals if g.never is not None})
    level = ", ".join(f"list_sum(list_transform({list(a.steps)}, lambda s: ({a.column} {'<' if a.at_least else '>'} s)::INT)) AS {n}" for a, n in zip(axes, names, strict=True))
    over = [f"over{i}" for i in range(len(limits))]
    steps = f"""WITH {CHOSEN}, lev AS (SELECT {level}, error FROM chosen),
  cells AS (SELECT {', '.join(names)}, count(*) AS n, {', '.join(f"count(*) FILTER (error > {x}) AS {o}" for x, o in zip(limits, over, strict=True))}, max(error) AS most, sum(error) AS total FROM lev WHERE {' AND '.join(f'{n} < {len(a.steps)}' for a, n in zip(axes, names, strict=True))} GROUP BY ALL),
  s AS (SELECT {', '.join(names)}, coalesce(n, 0) AS n, {', '.join(f'coalesce({o}, 0) AS {o}' for o in over)}, coalesce(most, -1) AS most, coalesce(total, 0) AS total FROM (SELECT * FROM {', '.join(f'(SELECT unnest(range({len(a.steps)})) AS {n})' for a, n in zip(axes, names, strict=True))}) LEFT JOIN cells USING ({', '.join(names)}))"""
    last = "s"
    for n in names:
        others = ", ".join(m for m in names if m != n)
        steps += f""",
  s_{n} AS (SELECT {', '.join(names)}, {', '.join(f'sum({c}) OVER w AS {c}' for c in ['n', *over, 'total'])}, max(most) OVER w AS most FROM {last} WINDOW w AS (PARTITION BY {others} ORDER BY {n} ROWS UNBOUNDED PRECEDING))"""
        last = f"s_{n}"
    parts = []
    for g in goals:
        false = f"over{limits.index(g.limit)}"
        good = f"n >= {g.least} AND 100.0::DOUBLE * {false} / n <= {g.most_false}" + (f" AND most <= {g.most_error}" if g.most_error is not None else "") + (f" AND over{limits.index(g.never)} = 0" if g.never is not None else "")
        tie = "total / n" if g.by_mean else "CASE WHEN most = 0 THEN 1e300 ELSE most END"
        parts.append(f"(SELECT '{g.name}' AS goal, n, {false} AS wrong, most, total / n AS mean, {', '.join(names)} FROM {last} WHERE {good} ORDER BY n DESC, {tie}, {', '.join(names)} LIMIT 1)")
    return (
        steps
        + f""",
  best AS ({' UNION ALL '.join(parts)})
  SELECT g.goal, coalesce(n, 0)::BIGINT AS accepted, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM chosen), 6) AS coverage, coalesce(wrong, 0)::BIGINT AS n_false, round(100.0::DOUBLE * wrong / n, 6) AS false_rate, most AS max_error, round(mean, 6) AS mean_error,
    {', '.join(f"({[float(x) for x in a.steps]}::DOUBLE[])[coalesce({n}, 0) + 1] AS {a.column}" for a, n in zip(axes, names, strict=True))}
  FROM (SELECT unnest({[g.name for g in goals]}) AS goal) g LEFT JOIN best USING (goal)"""
    )


_SEGS = f"""r AS (SELECT user_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {SEGMENT} AS seg, event_type, event_type || '/' || floor(value / 50)::BIGINT AS item FROM events),
  b AS (SELECT user_id, seg, item, count(*) AS n FROM r GROUP BY ALL), len AS (SELECT user_id, max(seg) + 1 AS segments FROM r GROUP BY 1)"""
ORACLE = {
    "gate_search_six": _gate_sql(GATE, GOALS),
    "gate_pick": _gate_sql(PICK, PICKS),
    "later_match": f"""WITH {_SEGS}, q AS (SELECT DISTINCT user_id, seg AS start FROM r WHERE event_type = 'signup'),
  pair AS (SELECT q.user_id, q.start, unnest(range(q.start + {WINDOW}, least(segments - {WINDOW} + 1, q.start + {WINDOW} + 512))) AS later FROM q JOIN len USING (user_id)),
  w AS (SELECT DISTINCT user_id, start FROM q UNION SELECT DISTINCT user_id, later FROM pair), wb AS (SELECT w.user_id, w.start, item, sum(n) AS c FROM w JOIN b ON b.user_id = w.user_id AND seg >= w.start AND seg < w.start + {WINDOW} GROUP BY ALL),
  wt AS (SELECT user_id, start, sum(c) AS t FROM wb GROUP BY ALL),
  low AS (SELECT p.user_id, p.start, p.later, sum(least(x.c, y.c)) AS low FROM pair p JOIN wb x ON x.user_id = p.user_id AND x.start = p.start JOIN wb y ON y.user_id = p.user_id AND y.start = p.later AND y.item = x.item GROUP BY ALL),
  s AS (SELECT l.user_id, l.start, l.later, low::DOUBLE / (a.t + c.t - low)::DOUBLE AS similarity FROM low l JOIN wt a ON a.user_id = l.user_id AND a.start = l.start JOIN wt c ON c.user_id = l.user_id AND c.start = l.later),
  best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY similarity DESC, later) = 1)
  SELECT user_id, start, round(coalesce(similarity, 0), 6)::DOUBLE AS similarity, later FROM q LEFT JOIN best USING (user_id, start)""",
    "grid_evaluation": f"""WITH RECURSIVE g AS (SELECT user_id, coalesce(list(epoch_us(ts) ORDER BY ts) FILTER (event_type = 'click'), []) AS a, coalesce(list(epoch_us(ts) ORDER BY ts) FILTER (event_type = 'view'), []) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
  tl AS (SELECT unnest([3, 12]) AS m), walk AS (SELECT user_id, m, a, b, 1 AS i, 1 AS j, 0 AS met FROM g, tl UNION ALL SELECT user_id, m, a, b, CASE WHEN b[j] - a[i] >= -m * {HOUR} THEN i + 1 ELSE i END, CASE WHEN b[j] - a[i] <= m * {HOUR} THEN j + 1 ELSE j END, met + (abs(b[j] - a[i]) <= m * {HOUR})::INT FROM walk WHERE i <= len(a) AND j <= len(b)),
  mt AS (SELECT user_id, max(met) FILTER (m = 3) AS m3, max(met) FILTER (m = 12) AS m12 FROM walk GROUP BY 1),
  r AS (SELECT user_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i, b FROM g),
  e AS (SELECT user_id, i, (list_min(list_transform(b, lambda x: (abs(x - t), x)))[2] - t)::DOUBLE / {HOUR} AS e FROM r), x AS (SELECT *, coalesce(abs(e), 'inf'::DOUBLE) AS a FROM e),
  kp AS (SELECT user_id, k, max(c) AS run FROM (SELECT user_id, k, i - o AS gg, count(*) AS c FROM (SELECT user_id, k, i, row_number() OVER (PARTITION BY user_id, k ORDER BY i) AS o FROM x, (SELECT unnest([3, 6, 24]) AS k) WHERE a <= k) GROUP BY ALL) GROUP BY ALL),
  kr AS (SELECT user_id, max(run) FILTER (k = 3) AS r3, max(run) FILTER (k = 6) AS r6, max(run) FILTER (k = 24) AS r24 FROM kp GROUP BY 1),
  st AS (SELECT user_id, quantile_cont(e, 0.5::DOUBLE) AS q, avg(e) AS mean, quantile_cont(abs(e), 0.5::DOUBLE) AS q5, avg(abs(e)) AS ma, quantile_cont(abs(e), 0.9::DOUBLE) AS q9, quantile_cont(abs(e), 0.95::DOUBLE) AS q95, max(abs(e)) AS mx, {', '.join(f'avg((a <= {h})::INT::DOUBLE) AS h{h}' for h in (1, 3, 6, 24))} FROM x GROUP BY 1),
  f AS (SELECT user_id, len(a) AS n, len(b) AS k, coalesce(m3, 0) AS m3, coalesce(m12, 0) AS m12, CASE WHEN len(a) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS none, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in ('h1', 'h3', 'h6', 'h24', 'r3', 'r6', 'r24'))}, q, mean, q5, ma, q9, q95, mx FROM g LEFT JOIN mt USING (user_id) LEFT JOIN kr USING (user_id) LEFT JOIN st USING (user_id)),
  p AS (SELECT *, {', '.join(f'm{m}::DOUBLE / greatest(k, 1) AS p{m}, m{m}::DOUBLE / greatest(n, 1) AS c{m}' for m in (3, 12))} FROM f), o AS (SELECT *, {', '.join(f'CASE WHEN p{m} + c{m} > 0 THEN 2 * p{m} * c{m} / (p{m} + c{m}) ELSE 0 END AS f{m}' for m in (3, 12))}, {', '.join(f'r{k} / greatest(n, 1) AS k{k}' for k in (3, 6, 24))}, coalesce(q5, none) AS md, coalesce(q95, none) AS tail FROM p),
  w AS (SELECT *, CASE WHEN isinf(md) THEN 0 ELSE 1 / (1 + md / 12) END AS wm, CASE WHEN isinf(tail) THEN 0 ELSE 1 / (1 + tail / 45) END AS wt FROM o)
  SELECT user_id, n AS reference_count, k AS estimated_count, m12::BIGINT AS matched_count, {', '.join(f'round(coalesce({c}, none), 6) AS {a}' for c, a in (('q', 'median_error'), ('mean', 'mean_error'), ('q5', 'median_abs_error'), ('ma', 'mean_abs_error'), ('q9', 'p90_abs_error'), ('q95', 'p95_abs_error'), ('mx', 'max_abs_error')))},
    {', '.join(f'round(h{h}, 6) AS hit_rate_{h}' for h in (1, 3, 6, 24))}, {', '.join(f'round({c}{m}, 6) AS {a}_{m}' for m in (3, 12) for c, a in (('p', 'precision'), ('c', 'recall'), ('f', 'f1')))}, (k - m12)::BIGINT AS false_positive_count, (n - m12)::BIGINT AS missed_count, {', '.join(f'round(k{x}, 6) AS continuity_{x}' for x in (3, 6, 24))},
    round(least(greatest(0.24::DOUBLE * wm + 0.24::DOUBLE * h3 + 0.3::DOUBLE * f3 + 0.12::DOUBLE * k6 + 0.1::DOUBLE * f12, 0), 1), 6) AS strict,
    CASE WHEN NOT isinf(md) AND NOT isinf(tail) THEN round(least(greatest(0.24::DOUBLE * wm + 0.18::DOUBLE * h6 + 0.2::DOUBLE * f3 + 0.12::DOUBLE * f12 + 0.08::DOUBLE * p12 + 0.08::DOUBLE * c12 + 0.06::DOUBLE * k6 + 0.04::DOUBLE * wt - least(0.22::DOUBLE, 0.12::DOUBLE * (k - m12) / greatest(k, 1) + 0.14::DOUBLE * (n - m12) / greatest(n, 1)), 0), 1), 6) END AS score FROM w""",
    "component_scores": """WITH o AS (SELECT l_orderkey, count(*) AS size, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS roles FROM lineitem GROUP BY 1),
  x AS (SELECT l_orderkey, l_linenumber, l_partkey, size, roles, least(l_discount * 10, 1) AS original, least(l_tax * 12.5::DOUBLE, 1) AS micro, (l_partkey * 3 % 11)::DOUBLE / 10.0::DOUBLE AS drums, least(CASE WHEN l_quantity > 25 THEN l_quantity / 40.0::DOUBLE ELSE 0 END, 1) AS inst, (l_partkey * 5 % 13)::DOUBLE / 12.0::DOUBLE AS bass,
    0.85::DOUBLE * ((l_partkey * 7 % 17)::DOUBLE / 16.0::DOUBLE) AS vocal, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey * 11 % 19)::DOUBLE / 18.0::DOUBLE ELSE 0 END AS groove, (l_partkey * 13 % 23)::DOUBLE / 22.0::DOUBLE * CASE WHEN l_partkey % 2 > 0 THEN 1 ELSE 0.45 END::DOUBLE AS boundary,
    (l_partkey * 2 % 7)::DOUBLE / 6.0::DOUBLE AS fake, least(abs(l_suppkey % 500 - 250.0::DOUBLE) / 220.0::DOUBLE, 1) AS off FROM lineitem JOIN o USING (l_orderkey)),
  y AS (SELECT *, least(1, roles / 3.0::DOUBLE) AS agreement, least(0.18::DOUBLE * (size - 1) + 0.18::DOUBLE * roles, 1) AS cluster, 0.1::DOUBLE * fake + 0.06::DOUBLE * off AS negative FROM x)
  SELECT l_orderkey, l_linenumber, l_partkey, round(drums, 6) AS drums, round(groove, 6) AS groove, round(boundary, 6) AS boundary, round(agreement, 6)::DOUBLE AS agreement, round(cluster, 6)::DOUBLE AS cluster, round(negative, 6) AS negative,
    round(least(greatest(0.18::DOUBLE * original + 0.18::DOUBLE * micro + 0.13::DOUBLE * drums + 0.11::DOUBLE * inst + 0.1::DOUBLE * bass + 0.08::DOUBLE * vocal + 0.08::DOUBLE * groove + 0.07::DOUBLE * agreement + 0.05::DOUBLE * boundary + 0.05::DOUBLE * cluster - negative, 0), 1), 6) AS final FROM y""",
    "flank_novelty": f"""WITH {_SEGS}, e AS (SELECT user_id, unnest(range(segments)) AS seg FROM len),
  f AS (SELECT e.user_id, e.seg, item, coalesce(sum(n) FILTER (b.seg < e.seg), 0) AS a, coalesce(sum(n) FILTER (b.seg >= e.seg), 0) AS c FROM e JOIN b ON b.user_id = e.user_id AND b.seg >= e.seg - {2 * BAR} AND b.seg < e.seg + {2 * BAR} GROUP BY ALL),
  g AS (SELECT user_id, seg, CASE WHEN sum(a) = 0 OR sum(c) = 0 THEN 0 ELSE 1 - sum(least(a, c))::DOUBLE / sum(greatest(a, c)) END AS novelty FROM f GROUP BY ALL)
  SELECT user_id, seg, round(coalesce(novelty, 0), 6)::DOUBLE AS novelty FROM e LEFT JOIN g USING (user_id, seg)""",
}
