"""Queries of masks: bodies of energy in users' events, and what stands around their purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import masks as M
from tidemark.sources.tables import events

#: Bins of half a day count as so many seconds.
WIDTH, SPAN = 43_200_000_000, 0.05


def bins(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, i, rms: half days from the first event of all to each user's last, with the summed value over 600; days without events are silent."""
    ev = events(spark, sf)
    first = ev.agg(F.min("t")).first()[0] or 0
    sums = ev.groupBy("user_id", F.floor((F.col("t") - first) / WIDTH).alias("i")).agg((F.round(F.sum("value"), 4) / 600).alias("x"))
    # each sum with the silent bins before it
    gaps = sums.where("i is not null").withColumn("from", F.coalesce(F.lag("i").over(W.partitionBy("user_id").orderBy("i")) + 1, F.lit(0).cast("long")))
    every = gaps.select("user_id", F.col("i").alias("to"), "x", F.explode(F.sequence("from", "i")).alias("i"))
    here = F.when(F.col("i") == F.col("to"), F.col("x"))
    return every.select("user_id", "i", F.coalesce(here, F.lit(0.0)).alias("rms"))


def body_masks(spark: SparkSession, sf: str) -> DataFrame:
    out = M.body_masks(bins(spark, sf), "user_id", SPAN)
    return out.select("user_id", "i", F.round("density", 6).alias("density"), "body", "relevant", "placeable")


def mask_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as markers on their user's masks."""
    ev = events(spark, sf)
    first = ev.agg(F.min("t")).first()[0] or 0
    markers = ev.where("event_type = 'purchase'").select("user_id", "event_id", ((F.col("t") - first) / float(WIDTH) * SPAN).alias("t"))
    out = M.mask_proofs(M.body_masks(bins(spark, sf), "user_id", SPAN), markers, "user_id", "event_id", "t", SPAN)
    return out.select("event_id", "bin", "placeable_count", "nearest_off", *(F.round(c, 6).alias(c) for c in ("marker_rms_max", "marker_density_max", "post_density_250", "post_density_500", "post_body_250", "post_relevant_500")), "body_present", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (body_masks, mask_proofs)}

_N = M.Bins(SPAN)
_POST, _FUTURE, _PRE, _EDGE, _LEAD = _N.of(M.POST_SEC), max(_N.of(M.POST_SEC), _N.of(M.FUTURE_SEC)), _N.of(M.PRE_SEC), _N.of(M.EDGE_SEC), _N.of(M.LEAD_SEC)


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def _share(x: str) -> str:
    return _clip(f"({x} - floor) / greatest(ceiling - floor, 0.001::DOUBLE)")


_ROOM = M.CEILING - M.KNEE
_BENT = f"CASE WHEN rms <= {M.KNEE}::DOUBLE THEN rms ELSE {M.KNEE}::DOUBLE + {_ROOM}::DOUBLE * tanh((rms - {M.KNEE}::DOUBLE) / {_ROOM}::DOUBLE) END"
_Q = ", ".join(f"quantile_cont(b, {p}::DOUBLE) OVER w AS q{n}" for n, p in ((34, 0.34), (55, 0.55), (70, 0.70), (84, 0.84), (90, 0.90), (94, 0.94), (96, 0.965)))
_MASKS = f"""WITH s AS (SELECT user_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {WIDTH} AS i, round(sum(value), 4) / 600 AS x FROM events GROUP BY ALL),
  e AS (SELECT user_id, unnest(range(max(i) + 1)) AS i FROM s GROUP BY user_id), r0 AS (SELECT e.user_id, e.i, coalesce(x, 0)::DOUBLE AS rms FROM e LEFT JOIN s USING (user_id, i)),
  r1 AS (SELECT *, {_clip(f'pow(({_BENT}) / {M.CEILING}::DOUBLE, {M.CURVE}::DOUBLE)')} AS energy FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r0) WHERE n >= 2),
  r2 AS (SELECT *, avg(energy) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {_N.radius} PRECEDING AND {_N.radius} FOLLOWING) AS b FROM r1),
  r3 AS (SELECT *, {_Q}, max(b) OVER w AS peak, max(rms) OVER w AS top, quantile_cont(rms, 0.95::DOUBLE) OVER w AS r95, quantile_cont(rms, 0.99::DOUBLE) OVER w AS r99 FROM r2 WINDOW w AS (PARTITION BY user_id)),
  r4 AS (SELECT *, greatest({M.NOISE}::DOUBLE, q55 + greatest(q90 - q55, 0) * {M.BLEND}::DOUBLE, q70 * 0.98::DOUBLE, q84 * 0.82::DOUBLE, q94 * 0.52::DOUBLE) AS f0, top >= 0.16 OR r95 >= 0.095 OR r99 >= 0.135 AS loud, top >= 0.012 AND r95 >= greatest(0.006::DOUBLE, top * 0.18::DOUBLE) AS rel FROM r3),
  r5 AS (SELECT *, (loud OR rel) AND peak > {M.NOISE} AND f0 >= peak * 0.985::DOUBLE AS strict FROM r4),
  r6 AS (SELECT *, CASE WHEN strict THEN least(f0, greatest({M.NOISE}::DOUBLE, least(q70 * 1.04::DOUBLE, peak * 0.84::DOUBLE), least(q84 * 0.96::DOUBLE, peak * 0.88::DOUBLE), least(q90 * 0.91::DOUBLE, peak * 0.9::DOUBLE), peak * 0.78::DOUBLE)) ELSE f0 END AS floor FROM r5),
  r7 AS (SELECT *, greatest(floor + 0.045::DOUBLE, q96, q94, q90, CASE WHEN strict THEN peak ELSE 0 END) AS ceiling, NOT loud AND top < 0.12 AND r99 < 0.1 AND peak < 0.4 AND greatest(0, q90 - q55, q94 - q70) < 0.025 AS flat FROM r6),
  r8 AS (SELECT *, {_share('b')} AS density, {_share('energy')} AS raw FROM r7),
  r9 AS (SELECT *, density >= {M.BODY} OR (b >= q90 AND b >= floor * 0.96::DOUBLE) OR (b >= q84 AND b >= floor) AS body, energy >= floor AND (raw >= {min(0.280, M.BODY * 0.78)}::DOUBLE OR energy >= q90) AS hard0 FROM r8),
  h AS (SELECT *, hard0 OR coalesce(min(CASE WHEN hard0 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - max(CASE WHEN hard0 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 <= {_N.of(M.BRIDGE_SEC)}, false) AS hard FROM r9),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, hard ORDER BY i) AS g FROM h),
  k AS (SELECT *, CASE WHEN hard THEN min(i) OVER (PARTITION BY user_id, hard, g) END AS run_start, CASE WHEN hard THEN count(*) OVER (PARTITION BY user_id, hard, g) END AS run_length FROM g),
  p AS (SELECT user_id, i, b FROM k UNION ALL SELECT user_id, n + unnest(range({_FUTURE - 1})), l FROM (SELECT user_id, max(n) AS n, arg_max(b, i) AS l FROM k GROUP BY 1) UNION ALL SELECT user_id, -unnest(range(1, {_PRE + 1})), q FROM (SELECT user_id, any_value(q34) AS q FROM k GROUP BY 1)),
  w AS (SELECT user_id, i, quantile_cont(b, 0.72::DOUBLE) OVER a AS post_b, max(b) OVER a AS post_p, quantile_cont(b, 0.72::DOUBLE) OVER f AS fut_b, max(b) OVER f AS fut_p, quantile_cont(b, 0.58::DOUBLE) OVER z AS pre_b FROM p
    WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_POST - 1} FOLLOWING), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_FUTURE - 1} FOLLOWING), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN {_PRE} PRECEDING AND 1 PRECEDING)),
  j AS (SELECT k.*, post_b, post_p, fut_b, fut_p, pre_b FROM k JOIN w USING (user_id, i)),
  nx AS (SELECT *, min(CASE WHEN run_start = i AND run_length >= {_N.of(M.RUN_SEC, 2)} THEN (i, fut_b, fut_p) END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM j),
  y AS (SELECT *, nxt[1] AS ni, nxt[2] AS nb, nxt[3] AS np FROM nx),
  pl AS (SELECT *, NOT flat AND (coalesce(i <= run_start + {_EDGE} AND post_p >= floor AND (post_b >= floor * 0.92::DOUBLE OR post_p >= q90) AND ({_share('post_b')} >= {M.POST} OR post_b >= q84) AND ({_share('post_p')} >= {M.PEAK} OR post_p >= q90) AND (greatest(post_b - pre_b, 0) >= {M.CONTRAST} OR (post_b >= q90 AND {_share('post_b')} >= {M.POST + 0.08}::DOUBLE)), false)
    OR coalesce(ni - i <= {_LEAD} AND energy >= greatest(floor * 0.72::DOUBLE, q84 * 0.82::DOUBLE) AND raw >= {min(M.IMPACT, M.BODY * 0.86)}::DOUBLE AND np >= floor AND ({_share('nb')} >= {M.POST} OR nb >= q84 OR np >= q90) AND (greatest(nb - pre_b, 0) >= {M.CONTRAST * 0.70}::DOUBLE OR np >= q90), false)) AS placeable FROM y),
  m AS (SELECT user_id, i, rms, density, body, placeable OR (bool_or(placeable) OVER (PARTITION BY user_id) AND body AND density >= {M.RELEVANT}) AS relevant, placeable FROM pl)"""
_NEAR, _QUARTER, _HALF = 2, 5, 10
ORACLE = {
    "body_masks": f"{_MASKS} SELECT user_id, i, round(density, 6) AS density, body, relevant, placeable FROM m",
    "mask_proofs": f"""{_MASKS}, sz AS (SELECT user_id, max(i) + 1 AS n, count(*) FILTER (placeable) AS placeable_count FROM m GROUP BY 1),
  mk AS (SELECT user_id, event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / {WIDTH}.0::DOUBLE * {SPAN}::DOUBLE AS t FROM events WHERE event_type = 'purchase'),
  pt AS (SELECT mk.*, n, placeable_count, greatest(0, least(n - 1, floor(t / {SPAN}::DOUBLE)::BIGINT)) AS bin FROM mk LEFT JOIN sz USING (user_id)),
  su AS (SELECT pt.user_id, event_id, bool_or(placeable AND abs(i - bin) <= 2) AS allowed, bool_or(body AND abs(i - bin) <= {_NEAR}) AS mb, bool_or(relevant AND abs(i - bin) <= {_NEAR}) AS mr, max(rms) FILTER (abs(i - bin) <= {_NEAR}) AS xr, max(density) FILTER (abs(i - bin) <= {_NEAR}) AS xd,
    avg(density) FILTER (i >= bin AND i < bin + {_QUARTER}) AS d250, avg(density) FILTER (i >= bin AND i < bin + {_HALF}) AS d500, avg(body::INT) FILTER (i >= bin AND i < bin + {_QUARTER}) AS b250, avg(body::INT) FILTER (i >= bin AND i < bin + {_HALF}) AS b500, avg(relevant::INT) FILTER (i >= bin AND i < bin + {_HALF}) AS r500,
    max(density) FILTER (i >= bin AND i < bin + {_HALF}) AS m500, arg_min(i, (abs(i - bin), i)) FILTER (placeable) AS nearest FROM pt JOIN m USING (user_id) GROUP BY ALL)
  SELECT event_id, bin, coalesce(placeable_count, 0)::BIGINT AS placeable_count, nearest - bin AS nearest_off, round(coalesce(xr, 0), 6) AS marker_rms_max, round(coalesce(xd, 0), 6) AS marker_density_max, round(coalesce(d250, 0), 6) AS post_density_250, round(coalesce(d500, 0), 6) AS post_density_500, round(coalesce(b250, 0), 6)::DOUBLE AS post_body_250, round(coalesce(r500, 0), 6)::DOUBLE AS post_relevant_500,
    coalesce(mb OR b250 >= 0.18 OR b500 >= 0.14 OR (mr AND d500 >= 0.08 AND m500 >= 0.3), false) AS body_present,
    array_to_string(list_filter([CASE WHEN n IS NULL THEN 'no_mask' END, CASE WHEN t > n * {SPAN}::DOUBLE THEN 'outside' END, CASE WHEN n IS NOT NULL AND NOT coalesce(mr, false) THEN 'not_on_relevant' END, CASE WHEN n IS NOT NULL AND NOT coalesce(allowed, false) THEN 'not_on_front_edge' END, CASE WHEN placeable_count = 0 THEN 'no_front_edge' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM pt LEFT JOIN su USING (user_id, event_id)""",
}
