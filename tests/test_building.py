"""Sets of tracks against a plain walk, tables replaced as a whole, learning once per batch."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import allowed_keys
from tidemark.operators.chains import build_sets
from tidemark.sources import sinks
from tidemark.streaming import learning as L

TRACK = "src long, name string, artist string, bpm int, number int, letter string, energy int"


def plain_set(tracks, start, length, strategy, per_artist):
    steps = [(0, 0), (0, 1), (1, 0), (-1, 0), (2, 0), (-2, 0), (1, 1), (-1, 1), (7, 0), (-7, 0)]
    chain = [next(t for t in tracks if t[0] == start)]
    while len(chain) < length:
        now = chain[-1]
        keys = [((now[4] - 1 + d) % 12 + 1, {"A": "B", "B": "A"}[now[5]] if x else now[5]) for d, x in steps]

        def ok(t, relax, now=now):
            if relax or strategy == "ignore" or now[6] is None or t[6] is None:
                return True
            d = t[6] - now[6]
            return 0 <= d <= 2 if strategy == "ramp" else abs(d) <= 2 if strategy == "wave" else d == 0

        def rank(t, now=now, keys=keys):
            apart = 9 if now[6] is None or t[6] is None else abs(t[6] - now[6])
            if now[6] is None or t[6] is None:
                penalty = 1
            elif strategy == "ramp":
                penalty = (0 if t[6] >= now[6] else 3) + max(0, t[6] - now[6] - 2)
            elif strategy == "match":
                penalty = 0 if apart == 0 else 1 if apart == 1 else 3
            else:
                penalty = apart
            return abs(t[3] - now[3]), penalty, keys.index((t[4], t[5])), apart, t[1], t[0]

        left = [t for t in tracks if t not in chain and (t[4], t[5]) in keys and sum(c[2] == t[2] for c in chain) < per_artist]
        for relax in (False, True):
            found = [t for t in left if now[3] <= t[3] <= now[3] + 4 and ok(t, relax)] or [t for t in left if max(70, now[3] - 2) <= t[3] < now[3] and ok(t, relax)]
            if found:
                break
        else:
            break
        top = sorted(found, key=rank)[:5]
        chain.append(min(top, key=lambda t, k=len(chain) + 1: hashlib.sha1(f"{start}|{k}|{t[0]}".encode()).hexdigest()))
    return [t[0] for t in chain]


@pytest.mark.parametrize("strategy,per_artist", [("ramp", 2), ("wave", 1), ("match", 3), ("ignore", 2)])
def test_sets_are_those_of_a_plain_walk(spark, strategy, per_artist):
    rng = random.Random(per_artist)
    tracks = [(i, rng.choice("abcdef") * rng.randint(1, 2), f"artist{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.choice([70, 71, 120, 121, 121, 122, 140]), rng.randint(1, 12), rng.choice("AB"), rng.choice([None, 3, 4, 5, 9])) for i in range(400)]
    df = spark.createDataFrame(tracks, TRACK)
    rows = build_sets(df, df.where("src < 100").select("src"), 5, strategy=strategy, per_artist=per_artist).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.start, []).append(r.src)
    assert got == {s: plain_set(tracks, s, 5, strategy, per_artist) for s in range(100)}
    assert any(len(c) == 5 for c in got.values())


def test_keys_by_mode(spark):
    one = spark.createDataFrame([(1, "A"), (12, "B")], "n int, l string")
    got = [[r.safe, r.pro, r.open] for r in one.select(*(allowed_keys(F.col("n"), F.col("l"), m).alias(m) for m in ("safe", "pro", "open"))).collect()]
    assert got[0][0] == ["1A", "1B", "2A", "12A"] and got[0][1][4:] == ["3A", "11A", "2B", "12B", "8A", "6A"] and got[1][2][-1] == "6B"


def test_a_table_is_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.read_whole(spark, path, "id long").count() == 0
    first = sinks.replace_whole(spark.range(5).toDF("id"), path)
    before = sinks.read_whole(spark, path, "id long")

    def fail(batches):
        for k, batch in enumerate(batches):
            yield batch
            if k >= 0:
                raise RuntimeError("in the middle")

    with pytest.raises(Exception, match="in the middle"):
        sinks.replace_whole(spark.range(1000).repartition(4).toDF("id").mapInArrow(fail, "id long"), path)
    assert sinks.current_version(spark, path) == first and sinks.read_whole(spark, path, "id long").count() == 5
    sinks.replace_whole(spark.range(7).toDF("id"), path)
    assert sinks.read_whole(spark, path, "id long").count() == 7 and before.count() == 5  # who began before reads on
    for n in range(8, 12):
        sinks.replace_whole(spark.range(n).toDF("id"), path)
    assert sinks.read_whole(spark, path, "id long").count() == 11 and len([d for d in os.listdir(path) if d.startswith("v-")]) <= 2


ROWS = [(i % 7, (i * 31 % 17) / 8.0, 3.0 * (i % 7) - 2.0 * ((i * 31 % 17) / 8.0) + (i % 3) / 10.0) for i in range(300)] + [(None, 1.0, 1.0), (1, float("nan"), 2.0)]


def test_batches_and_the_whole_give_the_same_weights(spark, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, a int, b double, y double")
    whole = L.weights(L.sums_of(df, ["a", "b"], "y"), ["a", "b"], "y")
    path = str(tmp_path / "sums")
    for number, (low, high) in enumerate(((0, 10), (10, 200), (200, 400))):
        part = df.where(f"i >= {low} and i < {high}")
        L.learn_on(part, number, path, ["a", "b"], "y")
        L.learn_on(part, number, path, ["a", "b"], "y")  # again after a failure: no change
    L.learn_on(df, 1, path, ["a", "b"], "y")  # an old batch
    assert L.weights(L.learned(spark, path), ["a", "b"], "y") == whole
    import numpy as np

    x = np.array([r[:2] for r in ROWS[:300]], float)
    y = np.array([r[2] for r in ROWS[:300]])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert abs(whole["a"][2] - w[0]) < 1e-6 and abs(whole["b"][2] - w[1]) < 1e-6
    out = L.corrected(df.where("i < 300"), whole, ["a", "b"], "y", most=4.0).collect()
    assert all(abs(r.correction) <= 4.0 and abs(r.correction - max(-4, min(4, r.y))) < 0.5 for r in out)


def test_nothing_learned_corrects_nothing(spark, tmp_path):
    model = L.weights(L.learned(spark, str(tmp_path)), ["a"], "y")
    assert model == {"a": (0.0, 0.0, 0.0), "y": (0.0, 0.0, 0.0)}
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, y double")
    model = L.weights(L.sums_of(flat, ["a"], "y"), ["a"], "y")
    assert model["a"] == (1.0, 0.0, 0.0) and L.corrected(flat, model, ["a"], "y").first().correction == 2.0
