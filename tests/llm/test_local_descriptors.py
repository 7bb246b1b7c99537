"""Edited, turned and rescaled copies are found, and no hit is lost."""

import numpy as np
import pytest

from tidemark.llm import local_descriptors as D

KIND = "media_id long, image binary, height int, width int"
RNG = np.random.default_rng(3)
PICTURES = [np.kron(RNG.random((12, 12)) * 255, np.ones((8, 8))) for _ in range(8)]


def frame(spark, pictures):
    return spark.createDataFrame([(i, bytearray(np.clip(p, 0, 255).astype(np.uint8).tobytes()), *p.shape) for i, p in pictures], KIND)


def turned(p, degrees, scale):
    h, w = (int(n * scale) for n in p.shape)
    y, x = np.mgrid[:h, :w]
    y, x = (y - (h - 1) / 2) / scale, (x - (w - 1) / 2) / scale
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = (np.clip(v + (n - 1) / 2, 0, n - 1.001) for v, n in ((c * y - s * x, p.shape[0]), (s * y + c * x, p.shape[1])))
    i, j = y.astype(int), x.astype(int)
    a, b = y - i, x - j
    return (p[i, j] * (1 - b) + p[i, j + 1] * b) * (1 - a) + (p[i + 1, j] * (1 - b) + p[i + 1, j + 1] * b) * a


EDITS = {
    "noise": lambda p: p + np.random.default_rng(1).normal(0, 5, p.shape),
    "grey levels": lambda p: p // 16 * 16,
    "half a pixel": lambda p: (p + np.roll(p, 1, 1)) / 2,
    "quarter turn": np.rot90,
    "turned by 30 degrees": lambda p: turned(p, 30, 1),
    "1.4 times as large": lambda p: turned(p, 0, 1.4),
}
#: Turned squares lose their straight edges and need a wider radius than the default. Of these eight pictures half are found: descriptors so far apart
#: often meet in no table. (All pairs of descriptors, compared in blocks, found seven; see the README.)
BITS, LEAST = {"turned by 30 degrees": 40}, {"turned by 30 degrees": 4}


@pytest.mark.parametrize("edit", sorted(EDITS))
def test_edited_copies_are_found(spark, edit):
    got = D.find_copies(frame(spark, list(enumerate(PICTURES))), frame(spark, [(i, EDITS[edit](p)) for i, p in enumerate(PICTURES)]), bits=BITS.get(edit, D.NEAR_BITS)).collect()
    found = {(r.query_id, r.media_id) for r in got}
    assert found <= {(i, i) for i in range(len(PICTURES))} and len(found) >= LEAST.get(edit, len(PICTURES))


def test_tables_meet_as_brute_force(spark):
    """Matches are the pairs of corners that share a word of a table and are near enough, each once."""
    bits = RNG.integers(0, 2, (60, D.BITS)).astype(bool)
    other = bits.copy()
    for k, row in enumerate(other):
        row[RNG.permutation(D.BITS)[: k // 2]] ^= True
    other[50:] = other[:10]
    side = lambda x: [(no, [(float(k), 0.0, 1.0, 0.0, *map(int, w)) for k, w in enumerate(np.packbits(x[no * 10 : no * 10 + 10], axis=1).view("<i8"))]) for no in range(6)]
    q, g = (spark.createDataFrame(side(x), f"no long, corners array<struct<{D.CORNER}>>") for x in (bits, other))
    got = [(r.q_no * 10 + r.qk, r.g_no * 10 + r.gk) for r in D.matches(g, q).collect()]
    picked = np.unpackbits(np.array(D.masks(), "<i8").view(np.uint8).reshape(D.TABLES, -1), axis=1).astype(bool)
    apart = (bits[:, None] != other[None]).sum(2)
    meet = np.array([[any((a[m] == b[m]).all() for m in picked) for b in other] for a in bits])
    assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero((apart <= D.NEAR_BITS) & meet)), strict=True))
    assert (picked.sum(1) == D.WORD_BITS).all() and len(got) > 50


def test_shuffled_tables_give_the_same(spark, monkeypatch):
    images, queries = frame(spark, list(enumerate(PICTURES))), frame(spark, [(i, p * 0.9) for i, p in enumerate(PICTURES)])
    want = sorted(map(tuple, D.find_copies(images, queries).collect()))
    monkeypatch.setattr(D, "BROADCAST_POSTINGS", 0)
    assert sorted(map(tuple, D.find_copies(images, queries).collect())) == want and len(want) >= len(PICTURES)


def test_an_id_with_two_images(spark):
    images = frame(spark, [(1, PICTURES[0]), (1, PICTURES[1]), (2, PICTURES[2])])
    pairs = {(r.query_id, r.media_id) for r in D.find_copies(images, frame(spark, [(7, PICTURES[0]), (8, PICTURES[1])])).collect()}
    assert pairs == {(7, 1), (8, 1)}


def test_no_hit_is_lost_where_queries_share_an_image(spark):
    images = frame(spark, [(i, PICTURES[i % 3]) for i in range(6)])
    queries = frame(spark, [(i, PICTURES[i % 2] * light) for i, light in ((10, 1), (11, 1), (12, 1), (20, 0.8))])
    pairs = {(r.query_id, r.media_id) for r in D.find_copies(images, queries).collect()}
    assert pairs == {(q, m) for q in (10, 11, 12, 20) for m in range(6) if m % 3 == q % 2}
    rows = D.grouped_copies(images, queries).collect()
    of = {kind: {(r[f"{'query' if kind == 'query' else 'media'}_id"], r["first"]) for r in rows if r.kind == kind} for kind in ("query", "image")}
    hits = {(r.query_id, r.media_id) for r in rows if r.kind == "hit"}
    assert {(q, m) for q, a in of["query"] for m, b in of["image"] if (a, b) in hits} == pairs and len(hits) == 3
    assert D.grouped_copies(images.limit(0), queries).count() == 0


def test_drawn_vectors_with_nulls_and_columns_of_clashing_names(spark):
    rows = [(1, [float("nan")] * 64), (2, [None] * 64), (3, None), (4, [0.5] * 64), (5, [float(i % 7) for i in range(64)])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("no", "first", "corners", "q", "g", "word", "image_id"):
        vectors = vectors.withColumn(c, vectors.vec_id)
    drawn = D.rendered(vectors.where("vec_id <> 1"))
    assert {r.media_id for r in drawn.where("image is null").collect()} == {2, 3}
    assert {(r.query_id, r.media_id) for r in D.find_copies(drawn, drawn).collect()} <= {(4, 4), (5, 5)}


def test_pairs_of_corners_are_those_that_meet_in_a_table(spark):
    """Each pair once, against all pairs; the distance is tested before the tables."""
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2, (6, D.BITS)).astype(np.uint8)
    sides = {}
    for side in "gq":
        bits = seeds[rng.integers(0, 6, 60)] ^ (rng.random((60, D.BITS)) < 0.04)
        sides[side] = np.packbits(bits.astype(np.uint8), axis=1).view("<i8")
    corner = lambda ws: (0.0, 0.0, 1.0, 0.0, *map(int, ws))
    frame = lambda ws: spark.createDataFrame([(no, [corner(w) for w in ws[no * 10 : no * 10 + 10]]) for no in range(6)], f"no long, corners array<struct<{D.CORNER}>>")
    masks = np.array(D.masks())
    want = []
    for i, q in enumerate(sides["q"]):
        for j, g in enumerate(sides["g"]):
            x = q ^ g
            if int(np.bitwise_count(x.view(np.uint64)).sum()) <= D.NEAR_BITS and ((x & masks) == 0).all(1).any():
                want.append((i // 10, i % 10, j // 10, j % 10))
    found = D.matches(frame(sides["g"]), frame(sides["q"]))
    assert len(want) > 100 and sorted(tuple(r) for r in found.select("q_no", "qk", "g_no", "gk").collect()) == sorted(want)
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert 0 < join.index("bit_count") < join.index("exists(") and "CASE" not in join


def smooth(spark, n, seed):
    """Images whose corners often match by chance, as embeddings are drawn."""
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.random(64).tolist()) for i in range(n)], "vec_id long, embedding array<double>")


def rows_of_joins(spark, since):
    """The most rows that one join of the queries from number `since` on has made."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        e = store.executionsList().apply(k)
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_matches_by_chance_do_not_leave_a_join(spark):
    """rows that joins make follow the images and hits, not the pairs of corners; hits are those of all matches."""
    vectors = smooth(spark, 300, 5)
    images, queries = D.rendered(vectors).localCheckpoint(), D.rendered(vectors, (8, 68, 4, 66), 0.8).localCheckpoint()
    sides = [D.places(x, f"test-{k}", "media_id")[1] for k, x in enumerate((images, queries))]
    corners = [{r.no: (r["first"], r.corners) for r in x.collect()} for x in sides]
    meet = {}
    for r in D.matches(*sides).collect():
        meet.setdefault((r.q_no, r.g_no), []).append((r.qk, r.gk))
    want = []
    for (q, g), m in meet.items():
        (query, qc), (image, gc) = corners[1][q], corners[0][g]
        qk, gk = np.array(sorted(m)).T
        need = max(D.VOTES, int(np.ceil(D.SHARE * min(len(qc), len(gc)))))
        if len(m) >= need and (a := D.agree(qk, gk, *(np.array([c[:4] for c in x], float)[k] for x, k in ((qc, qk), (gc, gk))), need)):
            want.append((query, image, *a[:2]))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = sorted((r.query_id, r.media_id, r.votes, r.scale) for r in D.search(images, queries)[0].collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and len(got) > 200
    assert all(abs(a[3] - b[3]) <= 0.0051 for a, b in zip(got, sorted(want), strict=True))
    made = sum(map(len, meet.values()))
    assert made > 10_000 and rows_of_joins(spark, since) <= 2 * len(images.collect()) + len(got)


def test_small_blocks_give_the_same(spark, monkeypatch):
    """Many blocks, and few corners held or compared at once."""
    vectors = smooth(spark, 60, 6)
    images, queries = D.rendered(vectors), D.rendered(vectors.where("vec_id % 2 = 0"), (8, 68, 4, 66), 0.8)
    want = sorted(map(tuple, D.find_copies(images, queries).collect()))
    monkeypatch.setattr(D, "IMAGES_BLOCK", 50)
    monkeypatch.setattr(D, "QUERIES_BLOCK", 30)
    for most in (D.BROADCAST_POSTINGS, 0):
        monkeypatch.setattr(D, "BROADCAST_POSTINGS", most)
        assert sorted(map(tuple, D.find_copies(images, queries).collect())) == want and len(want) >= 30
    whole = D.blocks(D.places(images, "test-g", "media_id")[1], 1, 1, "images").crossJoin(D.blocks(D.places(queries, "test-q", "media_id")[1], 1, 1, "queries")).toArrow().to_batches()
    rows = lambda: sorted(tuple(r.values()) for b in D.agreements(iter(whole), D.VOTES, D.NEAR_BITS) for r in b.to_pylist())
    once = rows()
    monkeypatch.setattr(D, "HELD", 1)
    monkeypatch.setattr(D, "COMPARED", 1)
    assert rows() == once and len(once) == len(want)


def test_words_are_the_bits_of_a_table():
    bits = RNG.integers(0, 2, (40, D.BITS)).astype(np.uint8)
    other = bits ^ (RNG.random(bits.shape) < 0.02)
    a, b = (np.packbits(x, axis=1).view("<u8") for x in (bits, other))
    same = (((a ^ b)[None] & np.array(D.masks(), "<i8").view("<u8")[:, None]) == 0).all(2)
    assert ((D.words(a) == D.words(b)) == same).all() and 0 < same.sum() < same.size
