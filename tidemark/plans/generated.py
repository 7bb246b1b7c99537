"""Queries on curves: estimates of beats scored against them, context frames, candidates from a clock, from structure and as a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.num import half_up
from tidemark.operators import curves as C
from tidemark.operators import generators as G
from tidemark.operators.repair import repair_grids
from tidemark.sources.tables import events

#: Microseconds of the events' time that are one second of a track: in `SLOW` a day is about half a second, in `FAST` a quarter of that.
SLOW, FAST = 180_000_000_000, 720_000_000_000
#: The scales of value and the roles of event types.
ROLE = {"click": "drums", "purchase": "bass", "view": "instrumental", "signup": "vocals"}


def frames(spark: SparkSession, sf: str, scale: int) -> DataFrame:
    """Events as frames of their user's track: seconds since the first event of all, role, and curves by value and number."""
    ev = events(spark, sf)
    first = ev.agg(F.min("t")).first()[0] or 0
    role = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in ROLE.items()))
    unit = lambda k, m: (F.col("event_id") * k % m / float(m)).alias
    return ev.select("user_id", ((F.col("t") - first) / float(scale)).alias("t"), role.alias("role"), (F.col("value") / 500).alias("rms"), unit(1, 17)("low"), unit(7, 13)("onset"), unit(3, 11)("attack"), unit(5, 19)("flux"), unit(11, 23)("low_jump"), unit(2, 29)("novelty"))


def tracks(rows: DataFrame) -> DataFrame:
    """user_id, duration, bpm (some have none) and zero."""
    known = F.when(F.col("user_id") % 7 > 0, (80 + F.col("user_id") * 13 % 90).cast("double"))
    return rows.groupBy("user_id").agg(F.max("t").alias("duration")).withColumns({"bpm": known, "zero": (F.col("user_id") % 3 / 4.0)})


def estimate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's beats at a tempo of their own, at half and at double that tempo, scored against the user's curves."""
    rows = frames(spark, sf, FAST)
    t = tracks(rows).select("user_id", "duration", (0.4 + F.col("user_id") % 5 / 20.0).alias("beat"))
    grid = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.col("duration") / (F.col("beat") * k)).cast("int")), lambda i: 0.1 + i * F.col("beat") * k)
    every = lambda a: F.filter(a, lambda x, i: i % 4 == 0)
    parts = [t.select("user_id", F.lit(n).alias("provider"), grid(k).alias("beats"), every(grid(k)).alias("downbeats"), F.lit(c).alias("confidence"), "duration") for n, k, c in (("base", 1.0, 0.7), ("half", 2.0, 0.9), ("double", 0.5, 0.9), ("none", 100.0, 0.5))]
    every_one = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    out = C.score_estimates(rows, every_one, "user_id")
    return out.select("user_id", "provider", *(F.round(c, 6).alias(c) for c in ("final", "beat_support", "beat_hit_rate", "offbeat_contrast", "tempo_stability", "coverage", "downbeat_support")), "n_beats", "n_downbeats")


def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Nine frames from two seconds before to two after each purchase: value and onset, linear between the user's events."""
    rows = frames(spark, sf, SLOW)
    centres = events(spark, sf).where("event_type = 'purchase'").select("user_id", "event_id", "t")
    first = events(spark, sf).agg(F.min("t")).first()[0] or 0
    out = C.context_frames(rows, centres.select("user_id", "event_id", ((F.col("t") - first) / float(SLOW)).alias("t")), "user_id", "t", ["rms", "onset"], 2.0, 2.0, 9, "event_id")
    return out.select("event_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"), F.round("onset", 6).alias("onset"))


def clock_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf, SLOW)
    out = G.clock_bars(rows, tracks(rows), "user_id")
    return out.select("user_id", "bar", half_up(F.col("t"), 6).alias("t"), "source", F.round("score", 6).alias("score"))


def structural_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf, SLOW)
    out = G.structural_times(rows, tracks(rows).withColumns({"low_t": F.lit(2.0), "high_t": 0.6 * F.col("duration")}), "user_id", most=6)
    return out.select("user_id", half_up(F.col("t"), 6).alias("t"), F.round("score", 6).alias("score"))


def fallback_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Signups are candidates with their value as confidence; those of some users lie outside their region."""
    rows = frames(spark, sf, SLOW)
    regions = tracks(rows).select("user_id", "duration", F.lit(4.0).alias("low_t"), F.when(F.col("user_id") % 10 == 0, 4.001).otherwise(0.8 * F.col("duration")).alias("high_t"))
    out = G.fallback_time(rows, rows.where("role = 'vocals'").select("user_id", "t", F.col("rms").alias("confidence")), regions, "user_id")
    return out.select("user_id", half_up(F.col("t"), 6).alias("t"), F.round("score", 6).alias("score"))


def generated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the clock and of the region's structure within quotas; users without any get the fallback."""
    rows = frames(spark, sf, SLOW)
    clock = G.clock_bars(rows, tracks(rows), "user_id").select("user_id", "t", "source", "score")
    region = tracks(rows).where("user_id % 14 <> 0").withColumns({"low_t": F.lit(2.0), "high_t": 0.6 * F.col("duration")})
    mixed = G.with_quotas(clock.unionByName(G.structural_times(rows, region, "user_id", most=6)), "user_id", {"clock_bar": 2, "clock_phrase_bar": 3, "structure": 4})
    regions = tracks(rows).select("user_id", "duration", F.lit(4.0).alias("low_t"), (0.8 * F.col("duration")).alias("high_t"))
    fallback = G.fallback_time(rows, rows.where("role = 'vocals'").select("user_id", "t", F.col("rms").alias("confidence")), regions, "user_id")
    return G.or_else(mixed, fallback, "user_id").select("user_id", half_up(F.col("t"), 6).alias("t"), "source", F.round("score", 6).alias("score"))


DAY = 86_400_000_000


def grid_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first event of a day as a beat every half second, off by the time of day; repaired up to the day of all last events. Days that begin with a purchase vote for downbeats."""
    ev = events(spark, sf)
    first, last = ev.agg(F.min("t"), F.max("t")).first()
    day = F.floor((F.col("t") - (first or 0)) / DAY)
    days = ev.groupBy("user_id", day.alias("day")).agg(F.min(F.struct("t", "event_id", "event_type")).alias("e"))
    beats = days.select("user_id", (F.col("day") * 0.5 + (F.col("e.t") - (first or 0) - F.col("day") * DAY) / float(DAY) * 0.05).alias("t"), F.col("e.event_type").alias("kind"))
    end = ((last or 0) - (first or 0)) // DAY * 0.5 + 1.2
    rows, _ = repair_grids(beats, beats.where("kind = 'purchase'"), beats.groupBy("user_id").agg(F.lit(end).alias("duration")), "user_id", "t")
    return rows.select("user_id", "i", half_up(F.col("t"), 6).alias("t"), "downbeat")


QUERIES = {f.__name__: f for f in (grid_repair, estimate_scores, context_windows, clock_candidates, structural_candidates, fallback_candidates, generated_candidates)}


def _frames_sql(scale: int) -> str:
    role = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE.items())
    unit = lambda k, m, n: f"(event_id * {k} % {m})::DOUBLE / {m}.0::DOUBLE AS {n}"
    return f"""WITH f AS (SELECT user_id, event_id, event_type, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / {scale}.0::DOUBLE AS t, CASE event_type {role} END AS role, value / 500.0::DOUBLE AS rms,
    {unit(1, 17, 'low')}, {unit(7, 13, 'onset')}, {unit(3, 11, 'attack')}, {unit(5, 19, 'flux')}, {unit(11, 23, 'low_jump')}, {unit(2, 29, 'novelty')} FROM events),
  tr AS (SELECT user_id, max(t) AS duration, CASE WHEN user_id % 7 > 0 THEN (80 + user_id * 13 % 90)::DOUBLE END AS bpm, (user_id % 3)::DOUBLE / 4.0::DOUBLE AS zero FROM f GROUP BY user_id)"""


def _clip(x: str) -> str:
    return f"least(greatest(coalesce({x}, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


def _norm(x: str, low: float, high: float) -> str:
    """x between two percentiles of its user."""
    q = lambda p: f"quantile_cont({x}, {p}::DOUBLE) OVER (PARTITION BY user_id)"
    return f"CASE WHEN {q(high)} > {q(low)} THEN {_clip(f'({x} - {q(low)}) / ({q(high)} - {q(low)})')} ELSE 0 END"


def _mean(x: str, a: str, b: str) -> str:
    return f"avg({x}) FILTER (f.t >= p.t + ({a}) AND f.t <= p.t + ({b}))"


_CLOCK = f"""k AS (SELECT *, 60.0::DOUBLE / bpm AS beat, 0.72::DOUBLE * duration AS until FROM tr WHERE bpm > 0),
  b AS (SELECT *, unnest(range(1, greatest(least(96, floor(until / (4 * beat))::BIGINT + 1), 1) + 1)) AS bar FROM k),
  p AS (SELECT user_id, bar, beat, zero + (bar - 1) * 4 * beat AS t FROM b WHERE zero + (bar - 1) * 4 * beat >= greatest(0.75::DOUBLE, 2 * beat) AND zero + (bar - 1) * 4 * beat <= until),
  m AS (SELECT p.user_id, p.bar, p.t, role, {_mean('rms', '-8 * beat', '0')} AS pre, {_mean('rms', '0', '16 * beat')} AS post, {_mean('rms', '-4 * beat', '0')} AS pre1, {_mean('rms', '0', '4 * beat')} AS post1,
    {_mean('low', '-8 * beat', '0')} AS lpre, {_mean('low', '0', '16 * beat')} AS lpost, {_mean('onset', '0', '16 * beat')} AS dens,
    coalesce(max(attack) FILTER (abs(f.t - p.t) <= greatest(0.07::DOUBLE, 0.2::DOUBLE * beat)), 0) AS att, coalesce(max(flux) FILTER (abs(f.t - p.t) <= greatest(0.08::DOUBLE, 0.3::DOUBLE * beat)), 0) AS flx FROM p JOIN f USING (user_id) WHERE role IS NOT NULL GROUP BY ALL),
  v AS (SELECT user_id, bar, t, role, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post, coalesce(pre1, pre, 0) AS pre1, coalesce(post1, post, 0) AS post1, coalesce(lpre, 0) AS lpre, coalesce(lpost, 0) AS lpost, coalesce(dens, 0) AS dens, att, flx FROM m),
  r AS (SELECT user_id, bar, t, role, {_clip('(post - pre + 0.25::DOUBLE) / 1.25::DOUBLE')} AS jump, {_clip('(post1 - pre1 + 0.25::DOUBLE) / 1.25::DOUBLE')} AS jump1, {_clip('(lpost - lpre + 0.25::DOUBLE) / 1.25::DOUBLE')} AS low, {_clip('0.45::DOUBLE * post + 0.35::DOUBLE * dens + 0.2::DOUBLE * lpost')} AS act,
    {_clip('(pre1 - post1 + 0.12::DOUBLE) / 0.7::DOUBLE')} AS drp, {_clip('(post1 - pre1 + 0.12::DOUBLE) / 0.7::DOUBLE')} AS re, att, flx FROM v),
  s AS (SELECT user_id, bar, t, CASE role WHEN 'drums' THEN greatest(att, 0.65::DOUBLE * low, 0.6::DOUBLE * act) WHEN 'bass' THEN greatest(low, 0.7::DOUBLE * act) WHEN 'instrumental' THEN greatest(jump, jump1, 0.8::DOUBLE * flx, 0.65::DOUBLE * act) ELSE greatest(drp, 0.75::DOUBLE * re, 0.45::DOUBLE * flx) END AS s FROM r),
  g AS (SELECT user_id, bar, t, max(s) AS most, avg(s) AS mean, CASE WHEN bar = 1 THEN 0.18 WHEN (bar - 1) % 32 = 0 THEN 1 WHEN (bar - 1) % 24 = 0 THEN 0.96 WHEN (bar - 1) % 16 = 0 THEN 0.94 WHEN (bar - 1) % 8 = 0 THEN 0.86 WHEN (bar - 1) % 12 = 0 THEN 0.8 WHEN (bar - 1) % 4 = 0 THEN 0.66 WHEN (bar - 1) % 2 = 0 THEN 0.48 ELSE 0.18 END::DOUBLE AS phrase FROM s GROUP BY ALL),
  clock AS (SELECT user_id, bar, t, CASE WHEN phrase >= 0.48::DOUBLE THEN 'clock_phrase_bar' ELSE 'clock_bar' END AS source, {_clip('0.55::DOUBLE * most + 0.25::DOUBLE * mean + 0.2::DOUBLE * phrase')} AS score, phrase FROM g),
  clocked AS (SELECT * FROM clock WHERE score >= 0.22::DOUBLE OR phrase >= 0.86::DOUBLE)"""
_RISE = "greatest({1} - {0}, 0.0::DOUBLE)"


def _structure(region: str) -> str:
    mean = lambda x, a, b: f"coalesce({_mean(x, f'{a}::DOUBLE', f'{b}::DOUBLE')}, 0)".replace("f.t", "nf.t").replace("p.t", "gr.t")
    return f"""nf AS (SELECT user_id, t, {_norm('onset', 0.1, 0.9)} AS onset, {_norm('low', 0.1, 0.9)} AS low, {_norm('novelty', 0.1, 0.9)} AS novelty FROM f),
  reg AS (SELECT user_id, greatest(0.25::DOUBLE, 4 * greatest(0.28::DOUBLE, least(0.75::DOUBLE, 60 / coalesce(bpm, 128)))) AS step, 2.0::DOUBLE AS a, least(greatest(3.0::DOUBLE, 0.6::DOUBLE * duration), duration - 0.5::DOUBLE) AS b FROM tr WHERE {region}),
  gr AS (SELECT user_id, a + unnest(range(floor((b - a + 1e-9::DOUBLE) / step)::BIGINT + 1)) * step AS t FROM reg WHERE b > a),
  sm AS (SELECT gr.user_id, gr.t, {mean('onset', -8.0, -1.0)} AS far, {mean('onset', 0.0, 2.0)} AS post, {mean('low', -2.0, 0.0)} AS lpre, {mean('low', 0.0, 2.0)} AS lpost, {mean('low', 2.0, 8.0)} AS lon, {mean('novelty', -0.8, 1.2)} AS nov FROM gr JOIN nf USING (user_id) GROUP BY ALL),
  sr AS (SELECT user_id, t, 0.4::DOUBLE * {_RISE.format('lpre', 'lpost')} + 0.3::DOUBLE * {_RISE.format('far', 'post')} + 0.22::DOUBLE * {_RISE.format('lpre', 'lon')} + 0.08::DOUBLE * greatest(nov, 0) AS raw FROM sm),
  sq AS (SELECT user_id, t, raw, quantile_cont(raw, 0.1::DOUBLE) OVER (PARTITION BY user_id) AS a, quantile_cont(raw, 0.9::DOUBLE) OVER (PARTITION BY user_id) AS b FROM sr),
  ss AS (SELECT user_id, t, {_clip('(raw - a) / greatest(b - a, 1e-9::DOUBLE)')} AS score FROM sq),
  structure AS (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, t DESC) <= 6)"""


def _fallback(high: str, normed: bool) -> str:
    mean = lambda x, a, b: f"coalesce({_mean(x, f'{a}::DOUBLE', f'{b}::DOUBLE')}, 0)".replace("f.t", "nf.t").replace("p.t", "c.t")
    rise = lambda a, b: f"round({_RISE.format(a, b)}, 9)"
    rank = lambda c: f"CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 1 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY {c}, t) - 1)::DOUBLE / (count(*) OVER (PARTITION BY user_id) - 1) END AS {c}"
    frames_of = "" if normed else f"nf AS (SELECT user_id, t, {_norm('onset', 0.1, 0.9)} AS onset, {_norm('low', 0.1, 0.9)} AS low, {_norm('novelty', 0.1, 0.9)} AS novelty FROM f), "
    return f"""{frames_of}c AS (SELECT f.user_id, f.t, rms AS confidence FROM f JOIN tr USING (user_id) WHERE role = 'vocals' AND f.t >= 4 AND f.t <= least({high}, duration - 1)),
  fm AS (SELECT c.user_id, c.t, confidence, {mean('onset', -16.0, -8.0)} AS early, {mean('onset', -8.0, -2.0)} AS build, {mean('onset', -2.0, 0.0)} AS opre, {mean('onset', 0.0, 2.0)} AS opost, {mean('low', -2.0, 0.0)} AS lpre, {mean('low', 0.0, 2.0)} AS lpost, {mean('low', 2.0, 8.0)} AS lon, {mean('novelty', -1.0, 1.5)} AS nov FROM c JOIN nf USING (user_id) GROUP BY ALL),
  fr AS (SELECT user_id, t, {rise('lpre', 'lpost')} AS low, {rise('opre', 'opost')} AS onset, {rise('lpre', 'lon')} AS sustain, {rise('early', 'build')} AS buildup, round(nov, 9) AS novelty, confidence FROM fm),
  fk AS (SELECT user_id, t, {', '.join(rank(x) for x in ('low', 'onset', 'sustain', 'buildup', 'novelty', 'confidence'))} FROM fr),
  fh AS (SELECT *, (low >= 0.72)::INT + (onset >= 0.72)::INT + (sustain >= 0.72)::INT + (buildup >= 0.72)::INT AS hits, (low + onset + sustain + buildup) / 4 AS core FROM fk),
  fw AS (SELECT *, 0.3::DOUBLE * low + 0.24::DOUBLE * onset + 0.22::DOUBLE * sustain + 0.14::DOUBLE * buildup + 0.06::DOUBLE * novelty + 0.04::DOUBLE * confidence - CASE WHEN hits < 2 THEN 0.14 ELSE 0 END::DOUBLE AS raw FROM fh),
  fb AS (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(raw, 9) DESC, t) = 1),
  first AS (SELECT user_id, min(t) AS t0 FROM f WHERE role = 'vocals' GROUP BY 1),
  fallback AS (SELECT user_id, coalesce(t, t0) AS t, coalesce(1 / (1 + exp(-5 * (raw - 0.58::DOUBLE))) * CASE WHEN hits < 2 THEN 0.4 WHEN core < 0.65 THEN 0.7 ELSE 1 END::DOUBLE, 0) AS score FROM first LEFT JOIN fb USING (user_id))"""


def _estimates_sql() -> str:
    grid = lambda k: f"list_transform(range(floor(duration / (beat * {k}::DOUBLE))::BIGINT + 1), lambda i: round(0.1::DOUBLE + i * beat * {k}::DOUBLE, 9))"
    union = " UNION ALL ".join(f"SELECT user_id, '{n}' AS provider, {grid(k)} AS g, {c}::DOUBLE AS confidence, duration FROM tb" for n, k, c in (("base", 1.0, 0.7), ("half", 2.0, 0.9), ("double", 0.5, 0.9), ("none", 100.0, 0.5)))
    mean = lambda k, n: f"CASE WHEN {n} > 0 THEN coalesce({k}, 0) / ({n}) ELSE 0 END"
    return f"""{_frames_sql(FAST)},
  n1 AS (SELECT user_id, t, {_norm('onset', 0.08, 0.94)} AS o, {_norm('low_jump', 0.08, 0.94)} AS l, {_norm('rms', 0.08, 0.94)} AS r, {_norm('flux', 0.08, 0.94)} AS x, {_norm('flux', 0.08, 0.995)} AS h FROM f),
  n2 AS (SELECT user_id, t, 0.4::DOUBLE * o + 0.25::DOUBLE * l + 0.2::DOUBLE * x + 0.15::DOUBLE * r AS b, 0.2::DOUBLE * o + 0.12::DOUBLE * l + 0.48::DOUBLE * h + 0.2::DOUBLE * r AS d FROM n1),
  cv AS (SELECT user_id, t, {_norm('b', 0.08, 0.94)} AS bc, {_norm('d', 0.08, 0.99)} AS dc FROM n2),
  fl AS (SELECT user_id, greatest(quantile_cont(bc, 0.68::DOUBLE), 0.18::DOUBLE) AS floor, count(*) AS frames FROM cv GROUP BY 1),
  tb AS (SELECT user_id, duration, 0.4::DOUBLE + (user_id % 5)::DOUBLE / 20 AS beat FROM tr), e0 AS ({union}),
  e AS (SELECT user_id, provider, confidence, duration, list_filter(g, lambda x: x <= duration) AS b, list_filter(list_filter(g, lambda x, i: (i - 1) % 4 = 0), lambda x: x <= duration) AS d FROM e0),
  gp AS (SELECT *, list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i]) AS gaps FROM e),
  gd AS (SELECT *, list_filter(gaps, lambda g: g > 0.08 AND g < 4) AS good FROM gp), bt AS (SELECT *, coalesce(list_median(good), 0.5)::DOUBLE AS beat FROM gd),
  rd AS (SELECT *, greatest(0.03::DOUBLE, least(0.085::DOUBLE, 0.16::DOUBLE * beat)) AS radius, list_median(list_transform(good, lambda g: abs(g - beat))) AS mad FROM bt), wd AS (SELECT *, greatest(radius, 0.045::DOUBLE) AS wide FROM rd),
  ot AS (SELECT *, list_filter(b[1:256], lambda x: list_min(list_transform(d, lambda y: abs(y - x))) > greatest(0.035::DOUBLE, 1.5::DOUBLE * wide)) AS other, list_transform(range(1, len(b)), lambda i: b[i] + 0.5::DOUBLE * (b[i + 1] - b[i])) AS mid FROM wd),
  pt AS (SELECT user_id, provider, 'b' AS kind, unnest(b) AS at_t, radius AS reach FROM ot UNION ALL SELECT user_id, provider, 'm', unnest(mid), radius FROM ot UNION ALL SELECT user_id, provider, 'd', unnest(d), wide FROM ot UNION ALL SELECT user_id, provider, 'o', unnest(other), wide FROM ot),
  tp AS (SELECT pt.user_id, provider, kind, at_t, max(CASE WHEN kind IN ('b', 'm') THEN bc ELSE dc END) AS v FROM pt JOIN cv ON cv.user_id = pt.user_id AND abs(at_t - cv.t) <= reach GROUP BY ALL),
  sm AS (SELECT user_id, provider, sum(v) FILTER (kind = 'b') AS sb, sum(v) FILTER (kind = 'm') AS smid, sum(v) FILTER (kind = 'd') AS sd, sum(v) FILTER (kind = 'o') AS so, count(*) FILTER (kind = 'b' AND v >= floor) AS hits FROM tp JOIN fl USING (user_id) GROUP BY ALL),
  q AS (SELECT ot.*, frames, len(b) AS nb, len(d) AS nd, coalesce(hits, 0)::DOUBLE AS hits, {mean('sb', 'len(b)')} AS beat_s, {mean('smid', 'len(b) - 1')} AS mid_s, {mean('sd', 'len(d)')} AS down_s, so FROM ot LEFT JOIN sm USING (user_id, provider) LEFT JOIN fl USING (user_id)),
  z AS (SELECT user_id, provider, nb >= 3 AND coalesce(frames, 0) > 2 AS ok, nb, nd, beat_s, hits / nb AS rate, {_clip('(beat_s - mid_s + 0.16::DOUBLE) / 0.5::DOUBLE')} AS contrast, CASE WHEN nb >= 4 AND len(good) >= 3 THEN {_clip('1 - mad / greatest(0.08::DOUBLE * beat, 1e-6::DOUBLE)')} ELSE 0 END AS stability,
    CASE WHEN nb >= 2 AND duration > 0 THEN {_clip('(b[nb] - b[1]) / greatest(0.82::DOUBLE * duration, 1e-6::DOUBLE)')} ELSE 0 END AS cover, CASE WHEN nb < 8 OR nd < 2 THEN 0.42 ELSE {_clip(f"(down_s - CASE WHEN len(other) > 0 THEN {mean('so', 'len(other)')} ELSE greatest(down_s - 0.1::DOUBLE, 0) END + 0.2::DOUBLE) / 0.55::DOUBLE")} END::DOUBLE AS down, confidence FROM q)
  SELECT user_id, provider, round(CASE WHEN ok THEN {_clip('0.24::DOUBLE * beat_s + 0.21::DOUBLE * rate + 0.18::DOUBLE * contrast + 0.13::DOUBLE * stability + 0.09::DOUBLE * cover + 0.1::DOUBLE * down + 0.05::DOUBLE * confidence')} ELSE 0 END, 6)::DOUBLE AS final,
    {', '.join(f'round(CASE WHEN ok THEN {c} ELSE 0 END, 6)::DOUBLE AS {n}' for c, n in (('beat_s', 'beat_support'), ('rate', 'beat_hit_rate'), ('contrast', 'offbeat_contrast'), ('stability', 'tempo_stability'), ('cover', 'coverage'), ('down', 'downbeat_support')))}, nb AS n_beats, nd AS n_downbeats FROM z"""


_TURN = "atan2(s, c) / (2 * pi())"
ORACLE = {
    "grid_repair": f"""WITH x AS (SELECT min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events), e AS (SELECT user_id, (epoch_us(ts) - x.f) // {DAY} AS day, min((epoch_us(ts), event_id, event_type)) AS e, any_value(x.f) AS f0, any_value((x.l - x.f) // {DAY}) * 0.5::DOUBLE + 1.2::DOUBLE AS duration FROM events, x GROUP BY ALL),
  b AS (SELECT user_id, day * 0.5::DOUBLE + (e[1] - f0 - day * {DAY})::DOUBLE / {DAY}.0::DOUBLE * 0.05::DOUBLE AS t, e[3] AS kind, duration FROM e),
  g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g0 FROM b), gg AS (SELECT *, CASE WHEN g0 > 0.08 AND g0 < 4 THEN g0 END AS g FROM g), pp AS (SELECT *, quantile_cont(g, 0.5::DOUBLE) OVER (PARTITION BY user_id) AS p FROM gg),
  tp AS (SELECT user_id, max(duration) AS duration, count(*) AS n, count(g) AS k, max(p) AS p, quantile_cont(abs(g - p), 0.5::DOUBLE) AS mad FROM pp GROUP BY 1),
  st AS (SELECT *, CASE WHEN n >= 4 AND k >= 3 THEN greatest(0, least(1, 1 - mad / greatest(1e-6, 0.08::DOUBLE * p))) ELSE 0 END AS stability FROM tp),
  cm AS (SELECT b.user_id, p, any_value(st.duration) AS duration, count(*) AS n, avg(cos(2 * pi() * (t - floor(t / p) * p) / p)) AS c, avg(sin(2 * pi() * (t - floor(t / p) * p) / p)) AS s, min(t) AS f FROM b JOIN st USING (user_id) WHERE stability >= 0.72 GROUP BY ALL),
  o0 AS (SELECT *, (CASE WHEN {_TURN} < 0 THEN {_TURN} + 1 ELSE {_TURN} END) * p AS base FROM cm WHERE n >= 3 AND sqrt(c * c + s * s) >= 0.3), o AS (SELECT user_id, p, duration, least(0.01::DOUBLE, greatest(0.001::DOUBLE, 0.02::DOUBLE * p)) AS edge, greatest(base + round_even((f - base) / p, 0) * p, 0) AS origin FROM o0),
  sl AS (SELECT o.*, round_even((t - origin) / p, 0)::BIGINT AS slot, t FROM b JOIN o USING (user_id)), sn AS (SELECT DISTINCT user_id, p, duration, edge, slot, greatest(origin + slot * p, 0) AS t2 FROM sl WHERE abs(t - greatest(origin + slot * p, 0)) <= greatest(0.02::DOUBLE, 0.28::DOUBLE * p)),
  ln AS (SELECT *, lead(t2) OVER (PARTITION BY user_id ORDER BY slot) AS nx FROM sn), mi AS (SELECT *, CASE WHEN nx - t2 > 1.55::DOUBLE * p THEN round_even((nx - t2) / p, 0)::BIGINT - 1 ELSE 0 END AS m FROM ln),
  fi AS (SELECT user_id, p, duration, edge, unnest(list_concat([t2], list_filter(list_transform(range(1, m + 1), lambda k: t2 + k * p), lambda x: x < nx - 0.35::DOUBLE * p))) AS t FROM mi), ins AS (SELECT * FROM fi WHERE t <= duration + edge),
  la AS (SELECT user_id, p, max(t) AS l, floor((any_value(duration) + any_value(edge) - max(t)) / p)::BIGINT AS m FROM ins GROUP BY user_id, p), al AS (SELECT user_id, t FROM ins UNION ALL SELECT user_id, l + unnest(range(1, m + 1)) * p FROM la),
  pl AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM al), v AS (SELECT b.user_id, b.t, arg_min(i, (abs(pl.t - b.t), pl.t)) AS i FROM b JOIN pl USING (user_id) WHERE kind = 'purchase' GROUP BY ALL),
  vc AS (SELECT user_id, i % 4 AS phase, count(*) AS n FROM v GROUP BY ALL), ph AS (SELECT user_id, phase FROM vc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, phase) = 1)
  SELECT user_id, i, round(t, 6) AS t, i >= coalesce(phase, 0) AND (i - coalesce(phase, 0)) % 4 = 0 AS downbeat FROM pl LEFT JOIN ph USING (user_id)
  UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1, round(t, 6), false FROM b WHERE user_id NOT IN (SELECT user_id FROM o)""",
    "estimate_scores": _estimates_sql(),
    "context_windows": f"""{_frames_sql(SLOW)}, c AS (SELECT user_id, event_id, t AS c FROM f WHERE event_type = 'purchase'), g AS (SELECT user_id, event_id, k AS frame, c - 2.0::DOUBLE + k * 0.5::DOUBLE AS t FROM c, (SELECT unnest(range(9)) AS k)),
  one AS (SELECT user_id, t, min((rms, onset)) AS x FROM f GROUP BY ALL), a AS (SELECT g.user_id, g.event_id, g.frame, g.t, max((one.t, one.x)) FILTER (one.t < g.t) AS a, min((one.t, one.x)) FILTER (one.t >= g.t) AS b FROM g JOIN one USING (user_id) GROUP BY ALL),
  s AS (SELECT event_id, frame, a, b, (t - a[1]) / greatest(b[1] - a[1], 1e-9::DOUBLE) AS w FROM a)
  SELECT event_id, frame, round(coalesce(a[2][1] + (b[2][1] - a[2][1]) * w, a[2][1], b[2][1]), 6) AS rms, round(coalesce(a[2][2] + (b[2][2] - a[2][2]) * w, a[2][2], b[2][2]), 6) AS onset FROM s""",
    "clock_candidates": f"{_frames_sql(SLOW)}, {_CLOCK} SELECT user_id, bar, round(t, 6) AS t, source, round(score, 6) AS score FROM clocked",
    "structural_candidates": f"{_frames_sql(SLOW)}, {_structure('true')} SELECT user_id, round(t, 6) AS t, round(score, 6) AS score FROM structure",
    "fallback_candidates": f"{_frames_sql(SLOW)}, {_fallback('CASE WHEN user_id % 10 = 0 THEN 4.001 ELSE 0.8 * duration END::DOUBLE', False)} SELECT user_id, round(t, 6) AS t, round(score, 6)::DOUBLE AS score FROM fallback",
    "generated_candidates": f"""{_frames_sql(SLOW)}, {_CLOCK}, {_structure('user_id % 14 <> 0')}, {_fallback('0.8::DOUBLE * duration', True)},
  every AS (SELECT user_id, t, source, score FROM clocked UNION ALL SELECT user_id, t, 'structure', score FROM structure),
  mixed AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY user_id, source ORDER BY round(score, 9) DESC, t) <= CASE source WHEN 'clock_bar' THEN 2 WHEN 'clock_phrase_bar' THEN 3 ELSE 4 END)
  SELECT user_id, round(t, 6) AS t, source, round(score, 6)::DOUBLE AS score FROM (SELECT * FROM mixed UNION ALL SELECT user_id, t, 'fallback', score FROM fallback WHERE user_id NOT IN (SELECT user_id FROM mixed))""",
}
