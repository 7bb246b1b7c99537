"""Importance resampling, spelling variants and the quality classifier against plain versions, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import importance as I
from tidemark.llm import nb_svm as N
from tidemark.llm import registry
from tidemark.llm import spelling as S

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "x" * 200_000, "one", "two words", "é" * 30, "a\x00b c", "\U0001f600 ok \U0001f600", "Words " * 30_000]
SMALL = str.maketrans(I.CAPITALS, I.SMALL)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def wide(df):
    for c in ("id", "n", "k", "key", "rest", "word", "run", "h", "buckets", "n_words", "weight", "score", "rank", "_words", "_at", "_label", "_of", "gram", "bits", "longer"):
        df = df.withColumn(c, df.doc_id)
    return df


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in rows for f in plain_features(x)[1]), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    big, small = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        w, f = plain_features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        rank.setdefault(r[0], []).append(k)
    return sorted((str(r[0]), *r[1:4]) for r in out), rank


def test_importance_equals_a_plain_draw(spark):
    rng = random.Random(3)
    vocab = ["Alpha", "beta", "ÄRGER", "x1", "naïve", "日本", "of", "the", "22"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", "-", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(7, "again " * 40), (7, "again " * 40), (None, "none " * 40), (None, None)]
    target = ["alpha beta of the naïve", None, "", "Alpha 22"] * 3
    got = I.resample(wide(docs(spark, rows)), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")).collect()
    want, rank = plain_draw(rows, target)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == want
    drawn = {}
    for r in got:
        if r["rank"] is not None:
            drawn.setdefault(r.doc_id, []).append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == rank and len(rank) >= 10


def test_importance_of_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(1, "word " * 30)])
    assert I.resample(none, none).count() == 0 and I.resample(none, some).count() == 0
    row = I.resample(some, none).first()
    assert row.n_features == 87 and row["rank"] is None


def test_importance_draws_towards_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["sea", "ship", "wave"] if i % 10 == 0 else ["tax", "law", "court"]) for _ in range(40))) for i in range(1000)]
    got = I.resample(docs(spark, rows), docs(spark, [(0, "the ship on the sea wave")])).where("rank is not null").collect()
    assert len(got) == 50 and all(r.doc_id % 10 == 0 for r in got)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_groups(n):
    out, near, words = {}, {}, sorted(n)
    for w in words:
        near[w] = [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)]
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best is not None and n[best] >= 10 * n[w] else None
    root = {}
    for w in words:
        at = w
        while out[at]:
            at = out[at]
        root[w] = at
    return sorted((w, out[w], root[w], n[w], len(near[w]), n[out[w]] if out[w] else None) for w in words)


def spelled(rows):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


@pytest.mark.parametrize("most", [1, 2, 7, 64])
def test_no_near_pair_is_lost_however_keys_are_cut(spark, most):
    rng = random.Random(most)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.choice([1, 2, 3, 30, 400, 5000]) for _ in range(400)}
    n |= {"prefix" + "".join(rng.choice("xyz") for _ in range(4)): rng.choice([1, 20, 300]) for _ in range(60)} | {"q" * 3000: 9, "q" * 3001: 100, "q" * 1500 + "z" + "q" * 1499: 1}
    n |= {"aa": 1, "ab": 10, "abb": 100, "a": 1000}  # chains; words so short that a part is empty
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert spelled(S.group_variants(words, most=most).collect()) == plain_groups(n)


def test_variants_of_texts_equal_a_plain_version(spark):
    rng = random.Random(5)
    vocab = ["separate", "SEPARATE", "seperate", "definitely", "définitely", "tomorrow", "short", "élève×÷øÿ", "Überraschung", "überraschung"]
    rows = [(i, rng.choice([" ", "-", "1", "_", "日"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(7, "tomorrow tomorow tomorow")] * 3 + [(None, "definitely definitly definitly"), (None, None)]
    got = S.group_variants(S.counted(S.runs_with_errors(wide(docs(spark, rows)))))
    want = plain_groups(plain_words(rows))
    assert spelled(got.collect()) == want and any(w[1] for w in want)
    assert S.group_variants(S.counted(S.runs_with_errors(docs(spark, [])))).count() == 0


def test_a_hot_segment_makes_few_pairs(spark):
    rng = random.Random(9)
    words = {"interna" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4000)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    parts = S.cut_further(S.keyed(df))
    pairs = sum(p.groupBy("key").count().selectExpr("sum(count * count) as c").first().c or 0 for p in parts)
    assert len(parts) > 1 and pairs < len(words) ** 2 / 20


def test_grams_are_those_of_a_plain_version():
    texts = ["Abc def### x9", "ÄÖ | b", "", "a  a a", "日本 語!"]
    row, gram = N.grams(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        units = re.findall(r"[^\W_]+|[^\w\s]+", text)
        want = sum(max(len(units) - k + 1, 0) for k in (1, 2)) + sum(max(len(units) - k + 1, 0) for k in (1, 2, 3))
        assert (row == i).sum() == want
    shape = N.shapes(pa.array(["Abc", "def", "ÄÖ", "x9", "Q", "###", "日本", "12"])).to_pylist()
    assert shape == ["Aa", "a", "A", "a9", "A", "###", "a", "9"]
    one, _ = N.grams(pa.array(["a b"], pa.large_string()))
    # grams don't reach from one text into the next
    both = N.grams(pa.array(["a b", "a b"], pa.large_string()))
    assert len(one) * 2 == len(both[0]) and (both[1][both[0] == 0].tolist()) == both[1][both[0] == 1].tolist()


def test_dual_descent_reaches_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.6)
    y = np.where(x @ [1, -2, 0.5, 0, 1] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    rows = [np.flatnonzero(v) for v in x]
    w = N.dual_descent(rows, [v[r] for v, r in zip(x, rows, strict=True)], y, cost, 5)
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()
    best = loss(w)
    # a plain subgradient descent comes no lower
    v, least = np.zeros(6), np.inf
    for k in range(1, 20_000):
        on = y * (x @ v[:-1] + v[-1]) < 1
        g = v - np.append((cost * y * on) @ x, (cost * y * on).sum())
        v = v - g / k
        least = min(least, loss(v))
    assert best <= least * 1.01 + 1e-6


def test_quality_is_learned_and_edges_are_scored(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(9)).capitalize() for _ in range(5))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "###", "!!"]) + rng.choice(["", "!!", "|"]) for _ in range(50))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, "twice"), (5, "twice"), (None, "no id")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, 1, 0), (None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    got = N.score_documents(wide(docs(spark, rows)), labels, into="score").select("doc_id", "text", "score").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text != "twice"]
    assert len(held) > 50 and all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held)
    assert len({r.score for r in got if r.text in (None, "", " \n\t ")}) == 1
    one = labels.where("quality = 1")
    assert {r.s for r in N.score_documents(docs(spark, rows), one, into="s").select("s").collect()} == {1.0}
    assert {r.s for r in N.score_documents(docs(spark, rows), labels.limit(0), into="s").select("s").collect()} == {0.0}
    assert N.score_documents(docs(spark, []), labels, into="s").count() == 0


def test_scores_equal_a_plain_version(spark):
    rows = [(i, ("good words here %d" if i % 2 else "BAD ### words %d !!") % i) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    model = N.fit(df, labels)
    ratio = dict(zip(model.hashes.tolist(), model.ratios.tolist(), strict=True))
    weight = dict(zip(model.hashes.tolist(), model.weights[:-1].tolist(), strict=True))
    for r in df.withColumn("s", N.quality("text", model)).collect():
        held = {g for g in N.grams(pa.array([r.text], pa.large_string()))[1].tolist() if g in ratio}
        length = math.sqrt(sum(ratio[g] ** 2 for g in held))
        margin = sum(ratio[g] * weight[g] for g in held) / max(length, 1e-9) + model.weights[-1]
        assert abs(r.s - 1 / (1 + math.exp(-(model.sigmoid[0] * margin + model.sigmoid[1])))) < 1e-9


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in got.collect()))) == sorted(map(str, rel.fetchall()))
