"""Gate search, later matches and novelty against plain versions; the review machine over restarts."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bags as B
from tidemark.operators.gates import Axis, Goal, gate_search
from tidemark.plans import extras
from tidemark.streaming import progress as P

AXES = [Axis("p", (0.9, 0.7, 0.4, 0.0)), Axis("e", (5.0, 20.0, 50.0), at_least=False), Axis("c", (0.8, 0.2)), Axis("s", (10.0, 30.0), at_least=False), Axis("f", (0.3, 1.0), at_least=False), Axis("m", (0.5, 0.1, 0.0))]


def plain_gate(rows, goal):
    """All gates one after another; only a strictly better one replaces the best."""
    best = None
    for steps in itertools.product(*(a.steps for a in AXES)):
        ok = [r for r in rows if all(r[i] is not None and r[i] == r[i] and ((r[i] >= s) if a.at_least else (r[i] <= s)) for i, (a, s) in enumerate(zip(AXES, steps, strict=True)))]
        errors = [r[6] for r in ok]
        false = sum(x > goal.limit for x in errors)
        if len(ok) < goal.least or 100 * false / max(len(ok), 1) > goal.most_false or (goal.most_error is not None and max(errors) > goal.most_error) or (goal.never is not None and any(x > goal.never for x in errors)):
            continue
        tie = round(sum(errors) / len(ok), 9) if goal.by_mean else (max(errors) or float("inf"))
        if best is None or len(ok) > best[0] or (len(ok) == best[0] and tie < best[1]):
            best = (len(ok), tie, false, max(errors), steps)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_the_best_gate_is_that_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    value = lambda *x: rng.choice([*x, *x, *x, None, float("nan")])
    rows = [(value(0.95, 0.8, 0.5, 0.1), value(3.0, 10.0, 40.0, 80.0), value(0.9, 0.5), value(5.0, 20.0, 99.0), value(0.1, 0.6), value(0.7, 0.3, 0.0), rng.choice([0.0, 10.0, 24.5, 30.0, 260.0])) for _ in range([0, 1, 60, 300][seed])]
    goals = [Goal("zero", 25.0), Goal("some", 25.0, most_false=30.0), Goal("mean", 25.0, most_false=60.0, never=250.0, by_mean=True, least=2), Goal("tight", 25.0, most_false=100.0, most_error=24.5), Goal("no", 0.0, most_error=-1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{a.column} double" for a in AXES) + ", error double")
    found = {r.goal: r for r in gate_search(df, AXES, goals, "error").collect()}
    assert set(found) == {g.name for g in goals}
    for g in goals:
        want, r = plain_gate(rows, g), found[g.name]
        steps = tuple(r[a.column] for a in AXES)
        if want is None:
            assert (r.accepted, r.n_false, r.max_error) == (0, 0, None) and steps == tuple(a.steps[0] for a in AXES)
        else:
            assert (r.accepted, r.n_false, r.max_error, steps) == (want[0], want[2], want[3], want[4])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


@pytest.mark.parametrize("width,step,most", [(1, 1, 512), (3, 1, 512), (4, 2, 3), (2, 3, 1)])
def test_later_windows_are_those_of_a_plain_search(spark, width, step, most):
    rng = random.Random(width)
    tracks = {u: [Counter(rng.choices("abcd", k=rng.choice([0, 0, 1, 3]))) for _ in range(rng.choice([1, 4, 30]))] for u in range(8)}
    bags = spark.createDataFrame([(u, i, k, n) for u, segs in tracks.items() for i, c in enumerate(segs) for k, n in c.items()], "u long, seg long, item string, n long")
    lengths = spark.createDataFrame([(u, len(s)) for u, s in tracks.items()], "u long, segments long")
    queries = spark.createDataFrame([(u, i) for u, s in tracks.items() for i in range(len(s))] * 2, "u long, start long")
    got = sorted(tuple(r) for r in B.later_matches(bags, queries, lengths, "u", "seg", "item", "n", width, step, most).select("u", "start", F.round("similarity", 9), "later").collect())
    want = []
    for u, s in tracks.items():
        window = lambda i, s=s: sum(s[i : i + width], Counter())
        for i in range(len(s)):
            found = [(-jaccard(window(i), window(j)), j) for j in range(i + width, len(s) - width + 1, step)[:most]]
            best = min(found, default=(0, None))
            want.append((u, i, round(-best[0], 9), best[1] if best[0] else None))
    assert got == sorted(want)


@pytest.mark.parametrize("flank", [1, 3])
def test_novelty_is_that_of_merged_flanks(spark, flank):
    rng = random.Random(flank)
    tracks = {u: [Counter(rng.choices("abc", k=rng.choice([0, 1, 2]))) for _ in range(12)] for u in range(5)}
    bags = spark.createDataFrame([(u, i, k, n) for u, segs in tracks.items() for i, c in enumerate(segs) for k, n in c.items()], "u long, seg long, item string, n long")
    lengths = spark.createDataFrame([(u, 12) for u in tracks], "u long, segments long")
    got = sorted(tuple(r) for r in B.flank_novelty(bags, lengths, "u", "seg", "item", "n", flank).select("u", "seg", F.round("novelty", 9)).collect())
    want = []
    for u, s in tracks.items():
        for i in range(12):
            a, b = sum(s[max(0, i - flank) : i], Counter()), sum(s[i : i + flank], Counter())
            want.append((u, i, round(1 - jaccard(a, b), 9) if a and b else 0.0))
    assert got == sorted(want)


@pytest.mark.parametrize("often,buckets,size", [(1, 64, 20), (3, 64, 20), (1, 1, 20), (1024, 1 << 20, 20), (2, 1 << 20, 400), (1, 4, 0)])
def test_commonest_pairs_are_those_of_a_plain_count(spark, often, buckets, size):
    rng = random.Random(size + often)
    words = ["a", "b", "c", "d", *(f"w{i}" for i in range(30))]
    lists = [rng.choices(words, [40, 20, 9, 9, *[1] * 30], k=rng.randint(0, 12)) for _ in range(size)] + [[], None, ["", "a", "b", ""], ["x"], ["a", None, "a"]]
    want = Counter(p for ws in lists for p in itertools.pairwise(ws or []) if all(p))
    got = B.commonest_pairs(spark.createDataFrame([(ws,) for ws in lists], "w array<string>"), "w", 7, often, buckets)
    assert [tuple(r) for r in got.collect()] == sorted(((" ".join(p), n) for p, n in want.items()), key=lambda r: (-r[1], r[0]))[:7]
    assert B.commonest_pairs(spark.createDataFrame([], "w array<string>"), "w", 7, often, buckets).count() == 0


def test_rare_pairs_are_not_shuffled(spark, tmp_path):
    """The commonest pairs of 120,000 words in one row group, nearly all pairs of which are different: few rows are handed on."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04}")
    rng = random.Random(3)
    texts = [" ".join([f"{c}{c} yes" for c in "klmnopqrstu" for _ in range(rng.randint(0, 1))] + [name(rng.randrange(6000)) for _ in range(300)]) for _ in range(400)]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.sparkContext.setJobGroup("bags", "")
    got = extras.top_bags(spark, str(tmp_path)).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = Counter(" ".join(p) for t in texts for p in itertools.pairwise(t.split()))
    assert [tuple(r) for r in got] == sorted(want.items(), key=lambda r: (-r[1], r[0]))[:10]
    track, store, rows = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    for stage in {s for j in track.getJobIdsForGroup("bags") for s in track.getJobInfo(j).stageIds if track.getStageInfo(s)}:
        rows += store.lastStageAttempt(stage).shuffleWriteRecords()
    assert 0 < rows < len(want) / 2


def test_a_windows_bag_is_made_once(spark):
    bags = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "a", 1), (1, 5, "b", 1)], "u long, seg long, item string, n long")
    rows = sorted(tuple(r) for r in B.window_bags(bags, "u", "seg", "item", "n", 3).collect())
    assert rows == [(1, 0, "a", 3), (1, 1, "a", 1), (1, 3, "b", 1), (1, 4, "b", 1), (1, 5, "b", 1)]
    plan = B.later_matches(bags, bags.select("u", F.col("seg").alias("start")), bags.groupBy("u").agg(F.lit(9).cast("long").alias("segments")), "u", "seg", "item", "n", 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")


def plain_progress(rows, every, until):
    out, n, back = [], Counter(), Counter()
    for e, s, u, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if u is None or s >= until or kind == "error":
            continue
        if kind == "train":
            n[u], back[u] = 0, back[u] + 1
        else:
            n[u] += 1
            if n[u] % every == 0:
                out.append((u, e, s * 1_000_000, n[u], back[u]))
    return sorted(out)


def test_review_progress_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 100 * i + rng.randint(-3000, 3000), rng.choice([1, 2, 3, None]), rng.choice(["review", "review", "review", "train", "error"])) for i in range(60, 900)]
    key, value = P.STATE_STORE
    had = spark.conf.get(key)
    spark.conf.set(key, value)
    try:

        def run():
            stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            due = P.review_progress(stream, 3, "2 hours", review="event_type = 'review'", retrained="event_type = 'train'")
            due.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
            return sorted(tuple(r) for r in spark.read.schema(P.DUE).parquet(f"{tmp_path}/out").collect())

        events_of(spark, rows[:300]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        first = run()
        events_of(spark, rows[300:]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        # far too late: the watermark has passed it, so it is not counted
        events_of(spark, [(5000, 0, 1, "review")]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        last = run()
    finally:
        spark.conf.set(key, had)
    until = lambda part: max(r[1] for r in part if r[2] is not None and r[3] != "error") - 7200
    assert first == plain_progress(rows[:300], 3, max(r[1] for r in rows[:300]) - 7200) or first == plain_progress(rows[:300], 3, until(rows[:300]))
    assert set(first) < set(last) and len(last) > 50
    assert last == plain_progress(rows, 3, max(r[1] for r in rows) - 7200) or last == plain_progress(rows, 3, until(rows))


def test_review_progress_equals_the_batch_query(spark, tmp_path):
    from tidemark.plans import labels, streams

    key, value = P.STATE_STORE
    had = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        sf = "/root/testdata/sf0.001"
        got = streams.ended(spark, sf, lambda e: P.review_progress(e, 5), P.DUE).select("event_id", F.col("track").alias("user_id"), "n", "t")
        mark = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 86_400_000_000
        times = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
        want = labels.retrain_due(spark, sf).join(times, "event_id").where(F.floor(F.col("t") / 1000) < mark // 1000)
        assert sorted(tuple(r) for r in got.drop("t").collect()) == sorted(tuple(r) for r in want.select("event_id", "user_id", "n").collect())
    finally:
        spark.conf.set(key, had)


def reports(spark, grids):
    from tidemark.operators import evaluation as E

    kind = "u string, t double"
    ref = spark.createDataFrame([(u, t) for u, (a, _) in grids.items() for t in a], kind)
    est = spark.createDataFrame([(u, t) for u, (_, b) in grids.items() for t in b], kind)
    out = E.evaluate_grids(ref, est, "u", "t", 0.001).withColumns({"strict": E.strict_score(), "score": E.report_score()})
    return {r.u: r for r in out.collect()}


def test_reports_of_grids(spark):
    got = reports(spark, {"near": ([1.0, 1.5, 2.0, 2.5], [1.003, 1.492, 2.018, 2.560]), "twice": ([1.0, 2.0], [1.003, 1.004]), "none": ([1.0], []), "extra": ([], [1.0]), "same": ([1.0, 2.0, 3.0], [3.0, 1.0, 2.0, -1.0])})
    r = got["near"]
    assert (r.reference_count, r.estimated_count, round(r.median_error, 3), round(r.mean_error, 3), round(r.median_abs_error, 3)) == (4, 4, 10.5, 18.25, 13.0)
    assert (r.hit_rate_5, r.hit_rate_10, r.hit_rate_20, r.hit_rate_70, r.precision_70, r.recall_70, r.f1_70, r.continuity_20) == (0.25, 0.5, 0.75, 1.0, 1.0, 1.0, 1.0, 0.75)
    r = got["twice"]
    assert (r.matched_count, r.precision_20, r.recall_20, r.false_positive_count, r.missed_count) == (1, 0.5, 0.5, 1, 1)
    r = got["none"]
    assert (r.estimated_count, r.median_error, r.max_abs_error, r.hit_rate_70, r.f1_20, r.missed_count, r.score) == (0, float("inf"), float("inf"), 0.0, 0.0, 1, None) and r.strict == 0.0
    r = got["extra"]
    assert (r.reference_count, r.estimated_count, r.median_error, r.precision_70, r.false_positive_count) == (0, 1, 0.0, 0.0, 1)
    r = got["same"]
    assert r.estimated_count == 3 and abs(r.strict - 1.0) < 1e-9 and abs(r.score - 1.0) < 1e-9
    assert got["near"].score < 1.0 and got["twice"].score < got["near"].score


def test_logistic_regression_converges(spark):
    import numpy as np

    from tidemark.operators import learning as L

    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(5, 2, 400), rng.normal(0, 0.1, 400), np.ones(400)]
    y = (x[:, 0] - 5 + 10 * x[:, 1] + rng.normal(size=400) > 1.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, c double, y int")
    got = L.logistic_fit(df, ["a", "b", "c"], "y")
    z = np.c_[(x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0), np.ones(400)]
    w = np.array([got["a"][2], got["b"][2], got["bias"][2]])
    weight = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    slope = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) + np.array([1.0, 1.0, 0.0]) * w
    assert abs(slope).max() < 1e-6 and got["c"][2] == 0.0 and w[0] > 1
    one = L.logistic_fit(df.where("y = 1"), ["a"], "y")
    assert one["a"][2] == 0.0 and L.logistic_fit(df.limit(0), ["a"], "y")["bias"] == (0.0, 0.0, 0.0)


def test_measures_come_from_the_first_place_that_has_a_number(spark):
    from tidemark.functions.candidates import metric_of, score_components

    rows = spark.createDataFrame(
        [(0.5, (None, 0.2), (0.9, 0.9), 1), (None, (0.7, None), (float("nan"), 0.4), 3), (float("inf"), None, None, None)],
        "confidence_score double, features struct<micro_confidence: double, transient_strength: double>, microalign struct<micro_confidence: double, transient_strength: double>, size int",
    )
    metric = metric_of(rows)
    got = [tuple(r) for r in rows.select(metric("confidence_score"), metric("micro_confidence"), metric("transient_strength"), metric("missing")).collect()]
    assert got == [(0.5, 0.9, 0.2, 0.0), (0.0, 0.7, 0.4, 0.0), (0.0, 0.0, 0.0, 0.0)]
    c = [r.components for r in score_components(rows.na.fill(1, ["size"]), cluster_size="size").collect()]
    assert abs(c[0].final - (0.18 * 0.5 + 0.18 * 0.9 + 0.13 * 0.2)) < 1e-12 and abs(c[1].final - (0.18 * 0.7 + 0.13 * 0.4 + 0.05 * 0.36)) < 1e-12 and c[2].final == 0.0
    roles = score_components(rows.withColumn("roles", F.array(F.lit("drums"), F.lit("saved"), F.lit("drums"), F.lit("bass"))), roles="roles").first().components
    assert abs(roles.agreement - 2 / 3) < 1e-12 and abs(roles.cluster - 0.36) < 1e-12
