"""Queries that build: caches and marker databases written and read again, generated candidates, sets of tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators.chains import build_sets
from tidemark.sources import caches as C
from tidemark.sources.tables import events, shared_folder, table

HOUR = 3_600_000_000


def cached_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a candidate cache (times in hours, confidences by value), written as npz files; then read by filters on names: what the caches hold."""
    rows = events(spark, sf).withColumn("c", F.struct("t", "event_id", (F.col("t") / HOUR).cast("float").alias("hours"), (F.col("value") / 500).cast("float").alias("share")))
    by = rows.groupBy(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"), "user_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    times = F.col("c.hours")
    tempo = F.when(F.col("user_id") % 4 > 0, (60 + F.col("user_id") % 80).cast("float"))
    path = f"{shared_folder(spark)}/caches-{uuid.uuid4().hex}"
    C.save(by.select("id", times.alias("times"), F.col("c.share").alias("confidence"), F.lit(None).cast("array<float>").alias("downbeats"), tempo.alias("tempo_bpm"), F.lit(8).alias("version"), F.lit(None).cast("string").alias("error")), path, "npz_cache")
    got = C.candidate_cache(spark, path, mode="strict").where(F.col("id").startswith("user-1"))
    mean = F.aggregate("confidence", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("confidence")
    return got.select("id", F.size("times").cast("long").alias("n"), F.col("times")[0].cast("double").alias("first"), F.col("downbeats")[F.size("downbeats") - 1].cast("double").alias("last"), F.round(mean, 6).alias("mean"), F.col("tempo_bpm").cast("double").alias("tempo"), F.col("version").cast("long").alias("version"))


def keyed(pages: DataFrame, column: str) -> DataFrame:
    return pages.withColumns({"path": F.col(column), "exact": F.regexp_extract(column, r"/([^/?#]*)([?#].*)?$", 1), "slug": F.regexp_extract(column, "://([^/]+)", 1)})


def marker_db_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A marker database of pages with even ids, written as JSON maps and read without markers before one second; what pages with odd ids find in it."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    bpm, drop = (60 + F.col("page_id") % 5).cast("double"), F.round(F.col("page_id") % 40 / 10.0, 3)
    even = pages.where("page_id % 2 = 0 and url is not null").groupBy("url").agg(F.max("page_id").alias("page_id"))
    path = f"{shared_folder(spark)}/markers-{uuid.uuid4().hex}"
    C.save(even.select(F.lit("").alias("file"), F.lit("exact").alias("section"), F.col("url").alias("key"), drop.alias("drop_sec"), bpm.alias("bpm"), F.col("page_id").alias("observations"), F.lit(None).cast("string").alias("sample_path")), path, "marker_map")
    markers = keyed(C.marker_database(spark, path, mode="strict"), "track")
    rows = keyed(pages.where("page_id % 2 = 1").withColumn("bpm", bpm), "url")
    return J.marker_lookup(rows, markers, "observations", "drop_sec", "bpm").select("page_id", "tier", "found")


SET_LENGTH = 5


def track_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as tracks: for the part with the smallest key of each brand and type, the set that begins with it."""
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(k.alias("src"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), (80 + F.col("p_size")).cast("int").alias("bpm"), (k % 12 + 1).cast("int").alias("number"), F.when(F.floor(k / 12) % 2 == 0, "A").otherwise("B").alias("letter"),
        F.when(k % 5 > 0, (k * 7 % 9 + 1).cast("int")).alias("energy"), "p_type")
    starts = parts.groupBy("artist", "p_type").agg(F.min("src").alias("src"))
    return build_sets(parts, starts, SET_LENGTH).select("start", F.col("place").cast("long").alias("place"), "src")


QUERIES = {f.__name__: f for f in (cached_candidates, marker_db_lookup, track_sets)}

_KEYS = r"{0} AS path, regexp_extract({0}, '/([^/?#]*)([?#].*)?$', 1) AS exact, regexp_extract({0}, '://([^/]+)', 1) AS slug"
#: Keys next to a key, in order: steps along the wheel, and whether the letter changes.
_STEPS = [(0, 0), (0, 1), (1, 0), (-1, 0), (2, 0), (-2, 0), (1, 1), (-1, 1), (7, 0), (-7, 0)]
_near = ", ".join(f"(((number - 1 + 12 + {d}) % 12) + 1, {"CASE letter WHEN 'A' THEN 'B' ELSE 'A' END" if x else 'letter'}, {i})" for i, (d, x) in enumerate(_STEPS))
ORACLE = {
    "track_sets": f"""WITH RECURSIVE tr AS (SELECT p_partkey AS src, p_name AS name, p_brand AS artist, p_type, 80 + p_size AS bpm, p_partkey % 12 + 1 AS number, CASE WHEN p_partkey // 12 % 2 = 0 THEN 'A' ELSE 'B' END AS letter, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 7 % 9 + 1 END AS energy FROM part),
  st AS (SELECT min(src) AS src FROM tr GROUP BY artist, p_type),
  chain AS (SELECT src AS start, 1 AS place, src, artist, bpm, number, letter, energy, [src] AS used, [artist] AS artists FROM tr WHERE src IN (SELECT src FROM st)
    UNION ALL SELECT start, place, src, artist, bpm, number, letter, energy, used, artists FROM (
      SELECT start, place + 1 AS place, nsrc AS src, nartist AS artist, nbpm AS bpm, nnumber AS number, nletter AS letter, nenergy AS energy, list_append(used, nsrc) AS used, list_append(artists, nartist) AS artists,
        row_number() OVER (PARTITION BY start ORDER BY sha1(start || '|' || (place + 1) || '|' || nsrc), nsrc) AS c FROM (
        SELECT *, min(tier) OVER (PARTITION BY start) AS best FROM (
          SELECT *, row_number() OVER (PARTITION BY start ORDER BY tier, jump, penalty, kp, difference, nname, nsrc) AS k FROM (
            SELECT c.start, c.place, c.used, c.artists, t.src AS nsrc, t.name AS nname, t.artist AS nartist, t.bpm AS nbpm, t.number AS nnumber, t.letter AS nletter, t.energy AS nenergy, kp,
              (t.bpm < c.bpm)::INT + CASE WHEN coalesce(t.energy - c.energy BETWEEN 0 AND 2, true) THEN 0 ELSE 2 END AS tier, abs(t.bpm - c.bpm) AS jump,
              coalesce(CASE WHEN t.energy >= c.energy THEN 0 WHEN t.energy < c.energy THEN 3 END + greatest(t.energy - c.energy - 2, 0), 1) AS penalty, coalesce(abs(t.energy - c.energy), 9) AS difference
            FROM (SELECT *, unnest([{_near}]) AS ky FROM chain WHERE place < {SET_LENGTH}) c0, LATERAL (SELECT c0.*, c0.ky[1] AS kn, c0.ky[2] AS kl, c0.ky[3] AS kp) c JOIN tr t ON t.number = c.kn AND t.letter = c.kl AND t.bpm <= c.bpm + 4 AND t.bpm >= least(c.bpm, greatest(70, c.bpm - 2))
            WHERE NOT list_contains(c.used, t.src) AND len(list_filter(c.artists, lambda a: a = t.artist)) < 2)) WHERE k <= 5) WHERE tier = best) WHERE c = 1)
  SELECT start, place::BIGINT AS place, src FROM chain""",
    "cached_candidates": f"""WITH e AS (SELECT 'user-' || user_id AS id, user_id, (epoch_us(ts)::DOUBLE / {HOUR})::REAL::DOUBLE AS hours, (value / 500)::REAL::DOUBLE AS share, ts, event_id FROM events)
  SELECT id, count(*)::BIGINT AS n, arg_min(hours, (ts, event_id)) AS first, arg_max(hours, (ts, event_id)) AS last, round(avg(share), 6) AS mean, CASE WHEN user_id % 4 > 0 THEN 60 + user_id % 80 ELSE 0 END::DOUBLE AS tempo, 8::BIGINT AS version FROM e WHERE id LIKE 'user-1%' GROUP BY id, user_id""",
    "marker_db_lookup": f"""WITH p AS (SELECT page_id, url, {_KEYS.format('url')}, (60 + page_id % 5)::DOUBLE AS bpm, round(page_id % 40 / 10.0::DOUBLE, 3) AS v FROM pages),
  m AS (SELECT * FROM p WHERE page_id IN (SELECT max(page_id) FROM pages WHERE page_id % 2 = 0 GROUP BY url) AND v >= 1), q AS (SELECT * FROM p WHERE page_id % 2 = 1),
  a AS (SELECT path, arg_max(v, page_id) AS v FROM m WHERE path <> '' GROUP BY 1), b AS (SELECT exact, arg_max(v, page_id) AS v FROM m WHERE exact <> '' GROUP BY 1),
  u AS (SELECT slug, arg_max(v, page_id) AS v, arg_max(bpm, page_id) AS bpm, max(page_id) AS o FROM m WHERE slug <> '' GROUP BY slug, exact),
  d AS (SELECT DISTINCT slug, bpm FROM q), n AS (SELECT d.slug, d.bpm, coalesce(abs(u.bpm - d.bpm) <= 0.5, false) AS near, count(DISTINCT round(v, 3)) AS k, arg_max(v, o) AS v FROM d JOIN u USING (slug) GROUP BY ALL),
  c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY slug, bpm ORDER BY near DESC) = 1)
  SELECT page_id, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN k = 1 THEN 3 END::BIGINT AS tier, coalesce(a.v, b.v, CASE WHEN k = 1 THEN c.v END) AS found
  FROM q LEFT JOIN a USING (path) LEFT JOIN b USING (exact) LEFT JOIN c ON c.slug = q.slug AND c.bpm = q.bpm""",
}
