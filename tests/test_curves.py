"""Sampling of curves, estimates, context frames and generators against plain versions; caches and marker databases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import curves as C
from tidemark.operators import generators as G
from tidemark.operators import joins as J
from tidemark.sources import caches as S

KIND = "track string, provider string, beats array<double>, downbeats array<double>, confidence double, duration double"


@pytest.mark.parametrize("closed", [False, True])
def test_span_means_are_plain_means_whatever_the_blocks(spark, closed):
    rng = random.Random(closed)
    frames = [(u, rng.choice([rng.uniform(0, 20), float(rng.randint(0, 20))]), rng.random(), rng.choice([None, rng.random()])) for u in "ab" for _ in range(80)]
    points = [(u, float(rng.randint(-2, 22)), 2.0 if u == "a" else 3.0) for u in "abc" for _ in range(15)]
    df, at = spark.createDataFrame(frames, "u string, t double, x double, y double"), spark.createDataFrame(points, "u string, t double, w double").distinct()
    spans = {"pre": (-F.col("w"), F.lit(0.0)), "post": (0.0, 5.0)}
    for block in (0.7, 4.0, 100.0):
        for r in C.span_means(df, at, "u", "t", ["x", "y"], spans, block, closed).collect():
            for name, (a, b) in {"pre": (r.t - r.w, r.t), "post": (r.t, r.t + 5)}.items():
                for i, c in ((2, "x"), (3, "y")):
                    v = [f[i] for f in frames if f[0] == r.u and a <= f[1] and (f[1] <= b if closed else f[1] < b) and f[i] is not None]
                    got = r[f"{name}_{c}"]
                    assert (got is None and not v) or abs(got - sum(v) / len(v)) < 1e-9


def pulses(times, events, width=0.018):
    return sum(np.exp(-0.5 * ((times - e) / width) ** 2) for e in events)


def scored(spark, onset, low, rms, flux, times, estimates):
    frames = spark.createDataFrame([("t", *map(float, r)) for r in zip(times, onset, low, rms, flux, strict=True)], "track string, t double, onset double, low_jump double, rms double, flux double")
    rows = spark.createDataFrame([("t", n, list(map(float, b)), list(map(float, d)), c, 8.0) for n, b, d, c in estimates], KIND)
    return {r.provider: r for r in C.score_estimates(frames, rows, "track").collect()}


def test_the_full_tempo_beats_half_and_double(spark):
    times = np.linspace(0, 8, 1601)
    beats = [1 + 0.5 * i for i in range(12)]
    onset = pulses(times, beats)
    double = sorted([*beats, *(t + 0.25 for t in beats[:-1])])
    got = scored(spark, onset, pulses(times, beats[::2], 0.022), 0.25 + 0.45 * onset, onset, times, [("base", beats, beats[::4], 0.7), ("half", beats[::2], beats[::8], 0.9), ("double", double, double[::4], 0.9), ("few", beats[:2], [], 0.4)])
    assert got["base"].final > got["half"].final and got["base"].final > got["double"].final
    assert (got["few"].final, got["few"].beat_support, got["few"].provider_confidence, got["few"].n_beats) == (0.0, 0.0, 0.4, 2)
    assert got["base"].tempo_stability > 0.999 and got["base"].beat_hit_rate == 1.0


def test_the_right_phase_of_downbeats_scores_higher(spark):
    times = np.linspace(0, 8, 1601)
    beats = [1 + 0.5 * i for i in range(12)]
    onset = pulses(times, beats)
    flux = pulses(times, beats[1::4], 0.030) + 0.35 * onset
    got = scored(spark, onset, pulses(times, beats, 0.025), 0.20 + 0.20 * onset, flux, times, [("right", beats, beats[1::4], 0.7), ("wrong", beats, beats[0::4], 0.7)])
    assert got["right"].downbeat_support > got["wrong"].downbeat_support and got["right"].final > got["wrong"].final


def test_all_beats_away_from_downbeats_count(spark):
    # 400 beats; those that aren't downbeats are strong from the 261st on only
    times = np.linspace(0, 101, 5051)
    beats = [0.5 + 0.25 * i for i in range(400)]
    flux = 0.5 * pulses(times, beats[::4], 0.03) + pulses(times, [b for i, b in enumerate(beats) if i >= 260 and i % 4], 0.03)
    zero = np.zeros(len(times))
    frames = spark.createDataFrame([("t", *map(float, r)) for r in zip(times, zero, zero, zero, flux, strict=True)], "track string, t double, onset double, low_jump double, rms double, flux double")
    rows = spark.createDataFrame([("t", "p", beats, beats[::4], 0.5, 101.0), ("t", "no downbeats", beats, [], 0.5, 101.0)], KIND)
    got = {r.provider: r for r in C.score_estimates(frames, rows, "track").collect()}
    curve = [(r.t, r.down_curve) for r in C.normalised_curves(frames, "track").collect()]
    mean = lambda at: sum(max((v for t, v in curve if abs(t - x) <= 0.045), default=0.0) for x in at) / len(at)
    down, others = mean(beats[::4]), mean([b for i, b in enumerate(beats) if i % 4])
    assert 0 < down - others + 0.20 < 0.55 and abs(got["p"].downbeat_support - (down - others + 0.20) / 0.55) < 1e-9
    assert got["no downbeats"].downbeat_support == 0.42


def test_estimates_of_tracks_without_frames_are_zero(spark):
    frames = spark.createDataFrame([], "track string, t double, onset double, low_jump double, rms double, flux double")
    rows = spark.createDataFrame([("t", "p", [1.0, 1.5, 2.0, 2.5], [1.0], 0.5, 8.0)], KIND)
    (r,) = C.score_estimates(frames, rows, "track").collect()
    assert r.final == 0.0 and r.n_beats == 4


def test_context_frames_equal_interpolation(spark):
    rng = random.Random(2)
    frames = [("a", rng.choice([rng.uniform(0, 9), float(rng.randint(0, 9))]), rng.random()) for _ in range(25)] + [("b", 3.0, 0.5)]
    frames = list({f[:2]: f for f in frames}.values())
    centres = [(u, i, c) for u in "abc" for i, c in enumerate([0.0, 2.0, 4.5, 9.0, 30.0])]
    got = C.context_frames(spark.createDataFrame(frames, "u string, t double, x double"), spark.createDataFrame(centres, "u string, i int, t double"), "u", "t", ["x"], 2.0, 1.0, 7, "i").collect()
    assert len(got) == 7 * len(centres)
    for r in got:
        c = next(c for u, i, c in centres if (u, i) == (r.u, r.i))
        own = sorted(f[1:] for f in frames if f[0] == r.u)
        want = np.interp(c - 2 + r.frame * 0.5, [t for t, _ in own], [x for _, x in own]) if own else 0.0
        assert abs(r.x - want) < 1e-9
    one = C.context_frames(spark.createDataFrame(frames, "u string, t double, x double"), spark.createDataFrame(centres[:1], "u string, i int, t double"), "u", "t", ["x"], 2.0, 1.0, 1, "i")
    assert one.count() == 1


def test_clock_bars_follow_phrases_and_evidence(spark):
    assert [r.s for r in spark.range(1, 34).select(G.phrase_strength(F.col("id")).alias("s")).collect()][::8] == [0.18, 0.86, 0.94, 0.96, 1.0]
    flat = [("t", role, i / 20, 0.5, 0.5, 0.0, 0.0, 0.0) for role in ("drums", "other") for i in range(1200)]
    loud = [("u", "drums", i / 20, *([1.0] * 5 if 32.0 <= i / 20 else [0.0] * 5)) for i in range(1200)]
    frames = spark.createDataFrame(flat + loud, "track string, role string, t double, rms double, low double, onset double, attack double, flux double")
    tracks = spark.createDataFrame([("t", 120.0, 0.0, 60.0), ("u", 120.0, 0.0, 60.0), ("no", None, 0.0, 60.0), ("none", 120.0, 0.0, 60.0)], "track string, bpm double, zero double, duration double")
    got = {(r.track, r.bar): r for r in G.clock_bars(frames, tracks, "track").collect()}
    assert {k[0] for k in got} == {"t", "u"} and all(1 < r.t <= 43.2 for r in got.values())
    assert got["u", 17].score == max(r.score for k, r in got.items() if k[0] == "u") and got["u", 17].source == "clock_phrase_bar"
    assert len([k for k in got if k[0] == "t" and k[1] > 4]) <= 92 and G.clock_bars(frames, tracks, "track", limit=3).count() <= 4


def test_fallback_only_where_there_is_nothing(spark):
    some = spark.createDataFrame([("a", 1.0, "x", 0.5), ("a", 2.0, "x", 0.7), ("a", 3.0, "y", 0.1), ("b", 1.0, "x", 0.2)], "track string, t double, source string, score double")
    kept = G.with_quotas(some, "track", {"x": 1})
    assert sorted((r.track, r.t) for r in kept.collect()) == [("a", 2.0), ("a", 3.0), ("b", 1.0)]
    other = spark.createDataFrame([("a", 9.0, "f", 0.0), ("c", 9.0, "f", 0.0)], "track string, t double, source string, score double")
    assert sorted((r.track, r.source) for r in G.or_else(kept, other, "track").collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "f")]
    frames = spark.createDataFrame([("a", i / 4, float(i >= 80), float(i >= 80), float(i == 80)) for i in range(160)], "track string, t double, onset double, low double, novelty double")
    candidates = spark.createDataFrame([("a", t, 0.5) for t in (5.0, 12.0, 20.0, 30.0)] + [("z", 7.0, 0.9), ("z", 3.0, 0.9)], "track string, t double, confidence double")
    regions = spark.createDataFrame([("a", 4.0, 35.0, 40.0), ("z", 10.0, 20.0, 40.0)], "track string, low_t double, high_t double, duration double")
    found = {r.track: r for r in G.fallback_time(frames, candidates, regions, "track").collect()}
    assert found["a"].t == 20.0 and found["a"].score > 0.5 and (found["z"].t, found["z"].score) == (3.0, 0.0)


def test_caches_come_back_and_broken_ones_are_told(spark, tmp_path):
    rows = [("a/b c", [1.0, 2.0], [0.5, 0.25], None, 120.0, 8, None), ("c", [], [], [1.0], None, None, None), ("d", [3.0], [1.0], [2.0], 1.0, 2, None)]
    path = str(tmp_path / "caches")
    S.save(spark.createDataFrame(rows, S.CANDIDATES), path, "npz_cache")
    got = {r.id: r for r in S.candidate_cache(spark, path, mode="strict").collect()}
    assert set(got) == {"a/b c", "c", "d"} and got["a/b c"].downbeats == [1.0, 2.0] and got["c"].tempo_bpm == 0.0 and got["c"].times == []
    (tmp_path / "caches" / "bad.npz").write_bytes(b"PK\x03\x04broken")
    np.savez(tmp_path / "caches" / "pickled.npz", times=np.array([{}], object), tempo_bpm=np.array([9.0], np.float32))
    got = {r.id: r for r in S.candidate_cache(spark, path).collect()}
    assert got["bad"].error and got["bad"].times is None and got["pickled"].times is None and got["pickled"].tempo_bpm == 9.0
    with pytest.raises(Exception, match="bad.npz"):
        S.candidate_cache(spark, path, mode="strict").collect()
    # filters on names choose files: the broken one isn't opened
    assert [r.id for r in S.candidate_cache(spark, path, mode="strict").where("id = 'd'").collect()] == ["d"]
    assert sorted(r.id for r in S.candidate_cache(spark, path, mode="strict").where("id in ('c', 'd', 'x')").collect()) == ["c", "d"]
    assert [r.id for r in S.candidate_cache(spark, path + "/a*", mode="strict").collect()] == ["a/b c"]
    assert S.candidate_cache(spark, str(tmp_path / "nothing")).count() == 0
    S.save(spark.createDataFrame(rows[:1], S.CANDIDATES), path, "npz_cache", mode="overwrite")
    assert sorted(os.listdir(path)) == ["a%2Fb%20c.npz"]


def test_feature_caches_keep_matrices(spark, tmp_path):
    path = str(tmp_path)
    schema = "id string, mel_db array<array<float>>, rms array<float>, meta_sr int, meta_name string"
    S.save(spark.createDataFrame([("x", [[1.0, 2.0], [3.0, 4.0]], [0.5], 22050, "n")], schema), path, "npz_cache")
    (r,) = S.feature_cache(spark, path, schema).collect()
    assert r.mel_db == [[1.0, 2.0], [3.0, 4.0]] and r.meta_sr == 22050 and r.meta_name == "n"
    (r,) = S.feature_cache(spark, path, "id string, rms array<float>, missing array<float>").collect()
    assert r.rms == [0.5] and r.missing is None


def test_marker_maps(spark, tmp_path):
    (tmp_path / "db.json").write_text('{"exact": {"k": {"drop_sec": 5, "bpm": "120", "obs": 3}, "early": {"drop_sec": 0.5}, "bad": 7, "text": {"drop_sec": "x"}, "p": {"drop_sec": 2.0, "sample_path": "/s/p.wav", "obs_used": 4}}, "slug": {"k": {"drop_sec": 9}}, "n": 1}')
    (tmp_path / "broken.json").write_text("{")
    got = sorted((r.track, r.drop_sec, r.bpm, r.observations) for r in S.marker_database(spark, str(tmp_path)).collect())
    assert got == [("/s/p.wav", 2.0, None, 4), ("k", 5.0, 120.0, 3)]
    with pytest.raises(Exception, match="broken.json"):
        S.marker_database(spark, str(tmp_path), mode="strict").collect()
    S.register(spark)
    every = spark.read.format("marker_map").load(str(tmp_path))
    assert every.count() == 5 and every.where("section = 'slug' and drop_sec > 9").count() == 0 and every.where("drop_sec is null").count() == 1
    S.save(every.drop("file").selectExpr("'' as file", "*"), str(tmp_path / "out"), "marker_map")
    assert spark.read.format("marker_map").load(str(tmp_path / "out")).count() == 5


def test_marker_lookup_is_that_of_a_plain_index(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice([*x, None, ""])
    markers = [(pick("p1", "p2"), pick("e1", "e2", "e3"), pick("s1", "s2"), rng.choice([None, 120.0, 120.4, 128.0]), rng.choice([1.0, 1.0004, 2.0]), i) for i in range(14)]
    rows = [(pick("p1", "p9"), pick("e1", "e9"), pick("s1", "s2", "s9"), rng.choice([None, 120.2, 128.0, 90.0]), i) for i in range(60)]

    def plain(path, exact, slug, bpm):
        for tier, key in ((0, path), (1, exact)):
            if key and (m := [m for m in markers if m[tier] == key]):
                return tier + 1, m[-1][4]
        bucket = list({m[1]: m for m in markers if slug and m[2] == slug}.values())
        near = [m for m in bucket if bpm is not None and m[3] is not None and abs(m[3] - bpm) <= 0.5]
        bucket = sorted(near or bucket, key=lambda m: m[5])
        return (3, bucket[-1][4]) if bucket and len({round(m[4], 3) for m in bucket}) == 1 else (None, None)

    kind = "path string, exact string, slug string, bpm double"
    got = J.marker_lookup(spark.createDataFrame(rows, kind + ", i int"), spark.createDataFrame(markers, kind + ", pick double, o int"), "o", "pick", "bpm")
    out = {r.i: (r.tier, r.found) for r in got.collect()}
    assert len(out) == len(rows) and {r[4]: plain(*r[:4]) for r in rows} == out and {t for t, _ in out.values()} == {1, 2, 3, None}
    assert math.isclose(sum(v or 0 for _, v in out.values()), sum(plain(*r[:4])[1] or 0 for r in rows))
