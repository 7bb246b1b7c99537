"""Repair of grids: given cases, and random ones against a plain version."""

import cmath
import math
import random
import statistics

import numpy as np

from tidemark.operators.repair import repair_grids

CASES = {  # beats, downbeats, duration
    "fills": ([0.0, 0.5, 1.5, 2.0], [0.0], 2.0),
    "ends": ([0.0, 0.5, 1.0, 1.5, 2.0], [0.0], 1.76),
    "double": ([0.0, 0.5, 0.88, 1.0, 1.5, 2.0], [0.0], 2.0),
    "wild": ([0.0, 0.5, 1.6, 2.05, 3.3], [0.0], None),
    "few": ([1.0, 2.0], [], 9.0),
}


def plain(beats, downs, duration):
    beats = sorted(b for b in beats if b >= 0)
    gaps = [b - a for a, b in zip(beats, beats[1:], strict=False) if 0.08 < b - a < 4]
    if len(beats) < 4 or len(gaps) < 3:
        return "unstable", beats, []
    p = statistics.median(gaps)
    if max(0, min(1, 1 - statistics.median(abs(g - p) for g in gaps) / max(1e-6, 0.08 * p))) < 0.72:
        return "unstable", beats, []
    mean = sum(cmath.exp(2j * math.pi * (b % p) / p) for b in beats) / len(beats)
    if abs(mean) < 0.3:
        return "no_phase", beats, []
    base = (cmath.phase(mean) / (2 * math.pi) % 1) * p
    origin = max(0.0, base + round((beats[0] - base) / p) * p)
    slots = {}
    for b in beats:
        k = round((b - origin) / p)
        to = max(0.0, origin + k * p)
        if abs(b - to) <= max(0.02, 0.28 * p):
            slots[k] = to
    on, out = [slots[k] for k in sorted(slots)], []
    for a, b in zip(on, [*on[1:], None], strict=True):
        out.append(a)
        if b is not None and b - a > 1.55 * p:
            out += [a + k * p for k in range(1, round((b - a) / p)) if a + k * p < b - 0.35 * p]
    if duration is not None:
        edge = min(0.01, max(0.001, 0.02 * p))
        out = [b for b in out if b <= duration + edge]
        while out and out[-1] + p <= duration + edge:
            out.append(out[-1] + p)
    votes = {}
    for d in downs:
        k = min(range(len(out)), key=lambda i: abs(out[i] - d)) % 4
        votes[k] = votes.get(k, 0) + 1
    phase = min(votes, key=lambda k: (-votes[k], k), default=0)
    return "ok", out, out[phase::4]


def run(spark, cases):
    kind = "u string, t double"
    rows, told = repair_grids(spark.createDataFrame([(u, t) for u, c in cases.items() for t in c[0]], kind), spark.createDataFrame([(u, t) for u, c in cases.items() for t in c[1]], kind), spark.createDataFrame([(u, c[2]) for u, c in cases.items()], "u string, duration double"), "u", "t")
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.u, r.i)):
        out.setdefault(r.u, []).append(r)
    return out, {r.u: r for r in told.collect()}


def test_given_cases(spark):
    out, told = run(spark, CASES)
    times = lambda u: [round(r.t, 9) for r in out[u]]
    assert times("fills") == [0.0, 0.5, 1.0, 1.5, 2.0] and [r.t for r in out["fills"] if r.downbeat] == [0.0, 2.0] and told["fills"].inserted == 1 and told["fills"].period == 0.5
    assert times("ends") == [0.0, 0.5, 1.0, 1.5] and told["ends"].trimmed == 1
    assert times("double") == [0.0, 0.5, 1.0, 1.5, 2.0] and told["double"].removed >= 1 and abs(told["double"].origin) < 0.02
    assert times("wild") == CASES["wild"][0] and told["wild"].status == "unstable" and times("few") == [1.0, 2.0] and not any(r.downbeat for r in out["few"])


def test_random_grids_as_a_plain_version(spark):
    rng = random.Random(8)
    cases = {}
    for k in range(60):
        p, jitter = rng.uniform(0.3, 0.9), rng.choice([0.0, 0.01, 0.05, 0.3])
        grid = [max(0.0, 0.2 + i * p + rng.uniform(-1, 1) * jitter * p) for i in range(rng.randint(2, 30)) if rng.random() < 0.8]
        extra = [rng.uniform(0, 12) for _ in range(rng.choice([0, 0, 2]))]
        cases[f"c{k}"] = (sorted(set(grid + extra)) or [1.0], [0.2 + i * 4 * p for i in range(rng.choice([0, 3]))], rng.choice([None, 5.0, 14.0]))
    out, told = run(spark, cases)
    seen = set()
    for u, c in cases.items():
        status, times, downs = plain(*c)
        seen.add(status)
        assert told[u].status == status
        assert [round(r.t, 6) for r in out.get(u, [])] == [round(t, 6) for t in times], (u, c)
        assert [round(r.t, 6) for r in out.get(u, []) if r.downbeat] == [round(t, 6) for t in downs]
    assert {"ok", "unstable"} <= seen


def test_downbeats_don_t_depend_on_the_order_of_rows(spark):
    # rows come in another order at each evaluation, as blocks of a shuffle do on a cluster
    rng = random.Random(21)
    cases = {f"c{k}": (sorted(0.03 + i * 0.12 + rng.uniform(-0.002, 0.002) for i in range(40)), [0.03 + 0.12 * (1 + k % 3)], 5.0) for k in range(80)}
    kind = "u string, t double"
    beats = spark.createDataFrame([(u, t) for u, c in cases.items() for t in c[0]], kind).coalesce(1).mapInPandas(lambda parts: (p.sample(frac=1, random_state=np.random.default_rng()) for p in parts), kind)
    downs = spark.createDataFrame([(u, t) for u, c in cases.items() for t in c[1]], kind)
    tracks = spark.createDataFrame([(u, c[2]) for u, c in cases.items()], "u string, duration double")
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows, _ = repair_grids(beats, downs, tracks, "u", "t")
        out = {}
        for r in rows.collect():
            out.setdefault(r.u, []).append(r)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    for u, c in cases.items():
        assert [round(r.t, 6) for r in sorted(out[u], key=lambda r: r.i) if r.downbeat] == [round(t, 6) for t in plain(*c)[2]]
