"""Order-dependent operators and edge cases against plain versions."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import signal as G
from tidemark.functions import text as T
from tidemark.operators import joins as J
from tidemark.operators import ranking as R
from tidemark.operators import sequences as S


def frame(spark, rows, schema="g string, t long, q double, id long"):
    return spark.createDataFrame(rows, schema)


ROWS = [("a", 0, 1.0, 1), ("a", 4, 5.0, 2), ("a", 9, 3.0, 3), ("a", 40, 1.0, 4), ("a", 44, 1.0, 5), ("b", 3, 2.0, 6)]


def test_nms_keeps_the_best_within_the_gap(spark):
    got = S.nms(frame(spark, ROWS), "g", "t", "q", "id", 6).select("id").collect()
    assert sorted(r.id for r in got) == [2, 4, 6]


def test_nms_on_random_rows_as_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("g", int(t), float(q), i) for i, (t, q) in enumerate(zip(rng.integers(0, 2000, 300), rng.integers(0, 50, 300), strict=True))]
    kept = []
    for _, t, _, i in sorted(rows, key=lambda r: (-r[2], r[1], r[3])):
        if all(abs(t - u) >= 9 for u, _ in kept):
            kept.append((t, i))
    got = S.nms(frame(spark, rows), "g", "t", "q", "id", 9).select("id").collect()
    assert sorted(r.id for r in got) == sorted(i for _, i in kept)


def test_thin(spark):
    assert sorted(r.id for r in S.thin(frame(spark, ROWS), "g", "t", "id", 5).collect()) == [1, 3, 4, 6]


def test_one_to_one_uses_each_time_once(spark):
    a = frame(spark, [("g", 100, 0.0, 1), ("g", 200, 0.0, 2)])
    b = frame(spark, [("g", 103, 0.0, 3), ("g", 104, 0.0, 4)])
    got = S.one_to_one(a, b, "g", "t", 10).collect()
    assert [(r.reference_t, r.estimate_t, r.error) for r in got] == [(100, 103, 3)]


def test_online_clusters(spark):
    rows = [("g", t, w, i) for i, (t, w) in enumerate([(1000, 0.8), (1020, 0.9), (1035, 0.35), (2000, 1.0)])]
    got = {r.id: (r.part, r.cluster, r.centre) for r in S.online_clusters(frame(spark, rows), "g", "t", "q", "id", 45).collect()}
    assert got[0] == got[1] == got[2] != got[3] and got[0][2] == 1020.0


def test_asof_takes_the_earlier_on_a_tie_and_null_without(spark):
    left = frame(spark, [("g", 10, 0.0, 1), ("h", 5, 0.0, 2)])
    right = frame(spark, [("g", 8, 0.0, 8), ("g", 12, 0.0, 9)])
    got = {r.id: (r.near_t, r.error) for r in J.asof_nearest(left, right, "g", "t", "id").collect()}
    assert got == {1: (8, -2), 2: (None, None)}


def test_within_and_intervals_as_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [("g", int(t), 0.0, i) for i, t in enumerate(rng.integers(-500, 500, 80))]
    b = [("g", int(t), 0.0, i) for i, t in enumerate(rng.integers(-500, 500, 80))]
    right = frame(spark, b).select("g", F.col("t").alias("u"), F.col("id").alias("jd"))
    got = J.within(frame(spark, a), right, "g", "t", "u", 13).select("id", "jd").collect()
    assert sorted((r.id, r.jd) for r in got) == sorted((i, j) for _, t, _, i in a for _, u, _, j in b if abs(t - u) <= 13)
    spans = right.select("g", "jd", F.col("u").alias("s"), (F.col("u") + 37).alias("e"))
    got = J.in_intervals(frame(spark, a), spans, "g", "t", "s", "e", 20).select("id", "jd").collect()
    assert sorted((r.id, r.jd) for r in got) == sorted((i, j) for _, t, _, i in a for _, u, _, j in b if u <= t < u + 37)


def test_text_keys(spark):
    df = spark.createDataFrame([("Artist - Song (Remix) [x]",), ("1:02:03.5",), ("-4",), ("",), (None,)], "s string")
    r = df.select("s", T.strip_brackets(F.col("s")).alias("b"), T.parse_clock(F.col("s")).alias("c"), T.split_artist(F.col("s"))[0].alias("a"), T.slug(F.col("s")).alias("g")).collect()
    assert (r[0].b, r[0].a, r[0].g) == ("Artist - Song", "Artist", "artist-song-remix-x")
    assert r[1].c == 3723.5 and r[2].c is None and r[3].c is None and r[4].c is None


def test_empty_groups(spark):
    none = frame(spark, [])
    assert S.nms(none, "g", "t", "q", "id", 5).count() == 0
    assert S.one_to_one(none, none, "g", "t", 5).count() == 0
    assert J.asof_nearest(none, none, "g", "t", "id").count() == 0


def test_signal_kernels():
    x = np.zeros(4096)
    assert G.near_empty(x) and G.near_empty(np.zeros(0))
    x[2000:2100] = np.sin(np.arange(100)) * 0.9
    assert not G.near_empty(x) and 1990 <= G.refine_attack(x, 2010, 64) <= 2012
    assert list(G.pick_peaks(np.array([0, 3, 0, 2, 0, 5, 0.0]), 1, 3)) == [1, 5]
    t = G.tiles(np.arange(10.0), 3)
    assert t[:, 0].tolist() == [0, 3, 6] and t[:, 1].tolist() == [2, 5, 9]
    assert len(G.spectral_flux(G.magnitudes(x))) == 7 and G.fingerprints(G.magnitudes(x))


def test_frame_table(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a", "b"], "x": [[0.0] * 2048, [1.0] * 100]}))
    got = G.frame_table(df, "k", "x").collect()
    assert [(r.k, r.frame, r.rms) for r in got] == [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 0.0)]


def plain_clusters(rows, radius):
    """Online clustering as its definition says, by lists."""
    out, clusters = {}, []
    for t, w, key in rows:
        near = min(((abs(c["centre"] - t), k) for k, c in enumerate(clusters)), default=(None, None))
        if near[0] is None or near[0] > radius:
            clusters.append({"members": [], "centre": t})
            k = len(clusters) - 1
        else:
            k = near[1]
        c = clusters[k]
        c["members"] = sorted([*c["members"], (t, w)])
        half, total = sum(x[1] for x in c["members"]) / 2, 0
        for v, weight in c["members"]:
            total += weight
            if total >= half:
                c["centre"] = v
                break
        out[key] = k
    return {key: (clusters[k]["centre"], tuple(sorted(x for x, y in out.items() if y == k))) for key, k in out.items()}


def test_online_clusters_as_plain_version(spark):
    rng = random.Random(14)
    rows, key = [], 0
    for user in range(12):
        for _ in range(rng.choice([0, 1, 5, 60, 400])):
            rows.append((user, rng.randrange(0, rng.choice([300, 3000])), rng.choice([1, 1, 2, 5]), key))
            key += 1
    df = spark.createDataFrame(rows, "user_id long, t long, w long, key long")
    got = S.online_clusters(df, "user_id", "t", "w", "key", 20).collect()
    members = {}
    for r in got:
        members.setdefault((r.user_id, r.part, r.cluster), []).append(r.key)
    want = {}
    for user in {r[0] for r in rows}:
        want |= plain_clusters(sorted((t, w, k) for u, t, w, k in rows if u == user), 20)
    assert len(got) == len(rows)
    for r in got:
        assert want[r.key] == (r.centre, tuple(sorted(members[r.user_id, r.part, r.cluster])))


def test_stretches_as_plain_version(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = random.Random(15)
    rows = [(u, t) for u in range(5) for t in sorted(rng.randrange(-2000, 2000) for _ in range(rng.choice([1, 30, 200])))]
    got = S.stretches(spark.createDataFrame(rows, "u long, t long"), "u", "t", 10).collect()
    assert len(got) == len(rows)
    for u in range(5):
        part, last, want = 0, None, {}
        for t in sorted({t for v, t in rows if v == u}):
            part += last is not None and t - last > 10
            want[t], last = part, t
        assert {(r.t, r._part) for r in got if r.u == u} == set(want.items())


def test_places_as_a_sort(spark):
    rng = random.Random(16)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, v double")
    got = {r.id: r.place for r in R.places(df, [F.col("a"), F.desc(F.floor(F.col("v") * 4)), F.desc("v"), F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2], r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
