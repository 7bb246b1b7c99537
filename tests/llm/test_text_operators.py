"""Coding, packing, quality rules, joins and scores against plain versions and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import byte_bpe as B
from tidemark.llm import jaccard_rtree as J
from tidemark.llm import language_id as L
from tidemark.llm import packing as P
from tidemark.llm import quality_rules as Q
from tidemark.llm import toxicity as X
from tidemark.llm.components import components

public = pytest.importorskip("public_tokenizers")
BPE, MULTI = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "  a  b ", "\n\n", "x" * 5000, "a\x00b", "é" * 3, "word " * 3000, "日本語 テキスト", "A\u00a0b", "\U0001f600 ok"]


def docs(spark, texts, lang=None, source=None):
    rows = [(i, t, lang[i] if lang else "en", source[i] if source else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def wide(df):
    """Columns whose names might clash with the operators' own."""
    for c in ("of", "n", "k1", "first", "row", "base", "spans", "part", "queue", "score", "f", "bpe", "toxicity", "quality_rules", "language", "id", "set", "place"):
        df = df.withColumn(c, df.doc_id)
    return df


def random_texts(seed=1, n=400):
    rng = random.Random(seed)
    bits = ["a", "th", "ing", " ", "  ", "\n", "\t", "'s", "é", "ß", "日", "\U0001f600", "1", "23", "!!", ".", "\u00a0", "\x85", "A", "\r\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_coding_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=B.read_ranks(MULTI), special_tokens={})
    texts = ODD + random_texts() + ["a" * n for n in range(1, 40)] + ["a few words, and more. " * 100_000, "<|endoftext|> x"]
    df = B.encode_documents(wide(docs(spark, texts)), MULTI, public.PATTERN)
    df = df.withColumn("back", B.decode("bpe.ids", MULTI, public.PATTERN))
    for r in df.collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.bpe.ids, "<u4").tolist() == want and r.bpe.n_tokens == len(want)
        assert bytes(r.back) == (texts[r.doc_id] or "").encode()


@pytest.mark.parametrize("path,pattern", [(BPE, None), (MULTI, public.PATTERN)])
def test_runs_of_any_white_space_are_coded_as_by_the_library(path, pattern):
    import tiktoken
    from tokenizers import Tokenizer

    if pattern:
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(path), special_tokens={})
        want = enc.encode_ordinary
    else:
        tok = Tokenizer.from_file(path)
        want = lambda t: tok.encode(t, add_special_tokens=False).ids
        assert want("word \u00a0 \u00a0 word") == [4775, 11504, 1573]
    rng, blanks = random.Random(11), [c for c in map(chr, range(0x3001)) if c.isspace()]
    bits = [*blanks, " ", " ", " ", "\u00a0", "\u00a0", "\n", "a", "word", ".", "1", "é", "<|endoftext|>", "<"]
    texts = ["".join(rng.choice(bits if rng.random() < 0.5 else [" ", "\u00a0", "\n", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    ids, at = B.Encoder(path, pattern).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == want(text), text


def test_offsets_cover_the_text(spark):
    texts = ["héllo wörld", "日本語 \U0001f600!", "", None]
    for r in docs(spark, texts).withColumn("t", B.encode_with_offsets("text", MULTI, public.PATTERN)).collect():
        text, end = texts[r.doc_id] or "", 0
        for x in r.t:
            assert 0 <= x.start < x.end <= len(text) and x.start <= end
            end = x.end
        assert end == len(text)


def test_part_of_a_character_decodes(spark):
    enc = B.Encoder(MULTI, public.PATTERN)
    ids, _ = enc.encode(pa.array(["\U0001f600"], pa.large_string()))
    df = spark.createDataFrame([(bytearray(ids[:1].tobytes()),)], "ids binary").select(B.decode_text(B.decode("ids", MULTI, public.PATTERN)).alias("t"))
    assert "\ufffd" in df.first().t or len(ids) == 1


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    source = [rng.choice(["hot", "hot", "hot", "b", "c", None]) for _ in texts]
    tok = Tokenizer.from_file(BPE)
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    for targets in (None, {"hot": 0.2, "b": 0.7}):
        rows = P.pack(wide(docs(spark, texts, source=source)), BPE, targets=targets, window_sequences=4, most_queues=3).toPandas()
        for i, g in rows.sort_values("start").groupby("doc_id"):
            assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(want[i]) == g.doc_tokens.iloc[0]
            assert all(zlib.crc32(want[i][a : a + n]) == c for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
        assert set(rows.doc_id) == set(want)
        sizes = rows.groupby("sequence_id").length.sum()
        assert set(sizes.index) == set(range(len(sizes))) and all(n & (n - 1) == 0 and n <= 1024 for n in sizes)
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert P.pack(docs(spark, texts).limit(0), BPE).count() == 0


def test_packing_codes_added_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    rng, tok = random.Random(4), Tokenizer.from_file(BPE)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "word", ".", ",", "é", "x\ny"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = P.pack(docs(spark, texts), BPE).toPandas()
    assert any("<|endoftext|>" in t for t in texts)
    for i, g in rows.sort_values("start").groupby("doc_id"):
        want = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert g.length.sum() == len(want) and all(zlib.crc32(want[a : a + n]) == c for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))


def test_phases_give_what_queues_hold():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 3, 70, 5000]) for _ in range(rng.randint(1, 6))]
        rates = [rng.choice([0, 1, 2, 9]) for _ in sizes]
        plan = P.phases(sizes, rates)
        assert sum(p.tokens for p in plan) == sum(sizes)
        layout, seen = P.Layout(plan, 64), set()
        for q, n in enumerate(sizes):
            for place, k in layout.runs(q, 0, n):
                seen |= set(range(place, place + k))
        assert seen == set(range(sum(sizes)))


def plain_rules(t):
    w, lines, seen, dup = WORDS.findall(t or ""), (t or "").split("\n"), set(), 0
    for x in lines:
        dup += bool(WORDS.search(x)) and x in seen
        seen.add(x)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cov)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(8)
    good = ["\n".join(" ".join(rng.choice("alder birch cedar dogwood elm fir ginkgo holly ivy juniper larch maple".split()) + str(rng.randint(0, 99)) for _ in range(8)).capitalize() + "." for _ in range(9)) for i in range(24)]
    bad = ["\n".join("BUY%d!! | NOW!! | $$$%d &&& ###" % (k, i) for k in range(20)) for i in range(24)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + ODD + ["a b c\na b c\n\n \na b c"]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(48)] + [(0, 1, 0), (999, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in Q.judge_documents(wide(docs(spark, texts)), labels).collect()}
    for i, t in enumerate(texts):
        q = rows[i].quality_rules
        n, chars, symbols, dup, rep = plain_rules(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert q.base_failed == (n < 50 or 100 * rep > 50 * n)
        if i < 48:
            assert q.kept == (i % 2 == 0 and not q.base_failed) and (i % 2 or not q.base_failed)
    none = Q.judge_documents(docs(spark, good), labels.limit(0)).collect()
    assert all(r.quality_rules.kept == (not r.quality_rules.base_failed) for r in none)
    assert Q.judge_documents(docs(spark, []), labels).count() == 0


def test_viterbi_and_gradient_as_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    model = Q.Crf(rng.normal(size=(len(Q.BUCKETS), Q.WIDTH, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [4, 0, 1, 6]
    codes = rng.integers(0, 2, (sum(sizes), len(Q.BUCKETS)))
    at = np.concatenate([[0], np.cumsum(sizes)])
    states, (post, _, _) = Q.viterbi(model, codes, at), Q.expected(model, codes, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a < b:
            emit = model.scores(codes[a:b])
            paths = list(product((0, 1), repeat=b - a))
            value = np.array([model.first[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(model.step[p[i - 1], p[i]] for i in range(1, len(p))) for p in paths])
            assert tuple(states[a:b]) == paths[int(value.argmax())]
            weight = np.exp(value - np.logaddexp.reduce(value))
            assert np.allclose(post[a:b, 1], [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) for i in range(b - a)])


def plain_components(texts, percent=85, n=4):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rows", [10_000, 5])
def test_jaccard_join_as_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(J, "PLACE_ROWS", rows)
    monkeypatch.setattr(J, "TREE_GRAMS", 10_000_000 if rows > 5 else 300)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    texts = list(ODD) + ["one two", "One TWO", "one two three"]
    for size in (4, 5, 7, 12, 30, 90, 300):
        for _ in range(3):
            base = [rng.choice(vocab) for _ in range(size)]
            for k in range(7):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 30])):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
                texts.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 1])]) if k % 2 else " ".join(copy).upper())
    want = plain_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_components(wide(docs(spark, texts))).collect()}
    assert got == dict(enumerate(want))


def test_jaccard_join_of_a_hot_group(spark, monkeypatch):
    """Many near copies in several blocks, and a chain that drifts away from them, whose links cross blocks."""
    monkeypatch.setattr(J, "PLACE_ROWS", 10)
    monkeypatch.setattr(J, "TREE_GRAMS", 1500)
    repeated, plain_rest = [], J.Blocks.rest

    def rest(self, rows, edges):
        out = plain_rest(self, rows, edges)
        repeated.append(None if out is None else out.selectExpr("count(*)", "sum(size(pieces))").first())
        return out

    monkeypatch.setattr(J.Blocks, "rest", rest)
    rng = random.Random(4)
    base = [f"v{i}" for i in range(100)]
    texts = []
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{k}"
        texts.append(" ".join(copy))
    drift = list(base)
    for k in range(40):
        drift[(2 * k) % 100] = f"y{k}"
        texts.append(" ".join(drift))
    rng.shuffle(texts)
    want = plain_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    assert len(repeated) == 2 and any(repeated)  # both levels had groups of several blocks, and rows outside the largest part


def test_jaccard_join_of_nothing(spark):
    assert J.link_components(docs(spark, [])).count() == 0
    assert {(r.n_shingles, r.component_id) for r in J.link_components(docs(spark, [None, ""])).collect()} == {(0, 0), (0, 1)}


def test_jaccard_join_of_repeated_and_null_ids(spark):
    """An id's rows have the components of their own texts."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    other = [f"u{rng.randrange(400)}" for _ in range(60)]
    near = [*base[:-1], "end"]
    rows = [(5, base), (5, other), (7, near), (9, [*other[:-1], "end"]), (None, [*base[:-2], "x", "y"]), (None, ["alone"] * 6), (11, near)]
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, k1 int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.link_components(df).collect())
    assert sum(got.values()) == len(rows) and {x[2] for x in got if x[0] in (5, 7, 9, 11)} == {5}
    assert {x[2] for x in got if x[0] is None} == {5, None}


def test_tree_search_as_brute_force():
    """What the tree leaves is what the bound leaves, and inner nodes spare comparisons."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 12, (40, J.GROUPS))
    points = np.maximum(centres[rng.integers(0, 40, 5000)] + rng.integers(-1, 2, (5000, J.GROUPS)), 0)
    sizes = points.sum(1)
    tree = J.RTree(points, sizes, 85)
    assert len(tree.levels) > 1
    tree.take(np.arange(0, 5000, 3))
    for at in range(0, 5000, 97):
        bound = np.minimum(tree.points, tree.points[at]).sum(1) >= J.need(sizes[tree.order[at]], tree.sizes, 85)
        ok = bound & tree.open & (100 * tree.sizes >= 85 * tree.sizes[at]) & (85 * tree.sizes <= 100 * tree.sizes[at])
        got = set(tree.near(at).tolist())
        assert set(np.flatnonzero(ok).tolist()) <= got <= set(np.flatnonzero(bound & tree.open).tolist())
    assert tree.compared[1] < 0.5 * 52 * 5000


def test_places_meet_for_every_linked_pair():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6, 7, 9, 13, 20, 45, 120, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            keep = int(np.ceil(0.85 * len(a)))
            b = np.sort(rng.permutation(a)[: rng.integers(keep, len(a) + 1)])
            room = int(len(b) / 0.85 - len(a))
            if room > 0:
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, rng.integers(0, room + 1)).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= 85 * (len(a) + len(b) - same):
                sig, at = J.places(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(sig[: at[1]].tolist()) & set(sig[at[1] :].tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_language_profiles(spark):
    en, de = "the house and the garden of the king", "der garten und das haus des königs ist schön"
    texts = [en, de] * 40 + ODD + ["123 !!", "the garden of the house", "das haus des gartens"]
    lang = ["en", "de"] * 40 + [None] * (len(ODD) + 3)
    rows = {r.doc_id: r.language for r in L.identify(wide(docs(spark, texts, lang=lang))).collect()}
    assert [rows[i].lang for i in range(80)] == lang[:80]
    assert [rows[len(texts) - k].lang for k in (3, 2, 1)] == ["und", "en", "de"]
    assert rows[80].lang == rows[81].lang == "und" and rows[80].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.language.lang for r in L.identify(docs(spark, [en], lang=[None])).collect()} == {"und"}
    assert L.identify(docs(spark, [])).count() == 0


def test_bundle_is_the_sum_of_bound_trigrams():
    x, has = L.bundles(pa.array(["abc", "", "1"], pa.large_string()))
    first, second, third = (v.astype(int) for v in L.letter_vectors())
    want = sum(first[a] * second[b] * third[c] for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 0)))
    assert x[0].tolist() == want.tolist() and has.tolist() == [True, False, False] and not x[1].any()


def test_toxicity_learns_and_tolerates_insertions(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("ten", "mar", "sol", "bri", "gar") for b in ("den", "ket", "ute", "ing", "ble", "ion")]
    texts, toxic = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            w[rng.randrange(20)] = rng.choice(["wretchkin", "mudbrain"]).upper()
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    probe = [" ".join(plain[:9]) + f" {x}" for x in ("mudbrain", "muddbrain", "m-u-d-b-r-a-i-n", "m u d b r a i n", "wretchkin!", "garden")]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, 0), (10_000, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.toxicity for r in X.score_documents(wide(docs(spark, texts + probe + ODD)), labels).collect()}
    assert [int(rows[i] >= 0.5) for i in range(400)] == toxic
    assert [rows[400 + k] >= 0.5 for k in range(6)] == [True] * 5 + [False]
    assert all(0 <= s <= 1 for s in rows.values()) and rows[406] == rows[407] < 0.5
    assert {r.toxicity for r in X.score_documents(docs(spark, texts[:3]), labels.limit(0)).collect()} == {0.0}
    assert X.score_documents(docs(spark, []), labels).count() == 0


def test_kernel_as_plain_version():
    words = ["trash", "idiot", "aaaa", "réeux"]
    other = ["trash", "trraash", "idiiot", "aaaaa", "rééux", "zz", "banana"]
    marks = X.Landmarks(words)

    def vector(w):
        code, _ = X.letters(pa.array([w], pa.large_string()))
        out = Counter()
        for a, b, weight in X.STEPS:
            for i in range(len(code) - b):
                out[int(code[i]), int(code[i + a]), int(code[i + b])] += weight
        return out

    def cosine(p, q):
        dot, size = sum(p[k] * q[k] for k in p), lambda v: sum(x * x for x in v.values()) ** 0.5
        return dot / (size(p) * size(q)) if dot else 0.0

    got = {(w, m): v for w, m, v in zip(*marks.alike(pa.array(other, pa.large_string())), strict=True)}
    for i, w in enumerate(other):
        for j, m in enumerate(words):
            want = cosine(vector(w), vector(m))
            assert abs(got.get((i, j), 0.0) - (want if want >= X.FLOOR else 0.0)) < 1e-9


def test_digests_are_of_the_ids(spark):
    text = "hello wörld"
    r = B.encode_documents(docs(spark, [text]), MULTI, public.PATTERN).first()
    assert hashlib.sha256(bytes(r.bpe.ids)).hexdigest() == hashlib.sha256(np.frombuffer(r.bpe.ids, "<u4").astype("<u4").tobytes()).hexdigest()


def test_lines_change_state_within_a_document(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "."
    bad = lambda: " | ".join(word() for _ in range(rng.randint(2, 9))) + rng.choice([" !!", " $$$", " ###"])
    rows = ["\n".join([good() for _ in range(rng.randint(5, 12))] if i % 2 == 0 else [good()] + [bad() for _ in range(rng.randint(5, 12))]) for i in range(160)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs(spark, rows), labels)
    for a, b, c in ((6, 9, 6), (3, 5, 4), (1, 8, 1)):
        text = "\n".join([bad() for _ in range(a)] + [good() for _ in range(b)] + [bad() for _ in range(c)])
        _, codes, _, at = Q.measure(pa.array([text], pa.large_string()))
        assert Q.viterbi(model, codes, at).tolist() == [1] * a + [0] * b + [1] * c


def test_viterbi_of_a_very_long_text_is_that_of_a_walk():
    rng = np.random.default_rng(4)
    model = Q.Crf(rng.normal(size=(len(Q.BUCKETS), Q.WIDTH, 2)) * 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    at = np.array([0, 0, 3, 200_003, 200_004, 200_004])
    codes = rng.integers(0, 2, (at[-1], len(Q.BUCKETS)))
    emit, want = model.scores(codes), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        best, back = None, []
        for e in emit[a:b]:
            if best is None:
                best = model.first + e
            else:
                into = best[:, None] + model.step
                back.append(into.argmax(0))
                best = into.max(0) + e
        if best is not None:
            walk = [int(best.argmax())]
            for f in reversed(back):
                walk.append(int(f[walk[-1]]))
            want += walk[::-1]
    assert Q.viterbi(model, codes, at).tolist() == want


def test_coding_an_empty_table_gives_no_rows(spark):
    none = docs(spark, [])
    assert B.encode_documents(none, MULTI, public.PATTERN).count() == 0
    assert none.withColumn("t", B.encode_with_offsets("text", MULTI, public.PATTERN)).count() == 0


def test_language_of_a_text_of_megabytes(spark):
    rng = random.Random(5)
    words = {"en": ["the", "and", "thing", "with", "shore"], "de": ["und", "nicht", "schon", "über", "zwei"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    langs = ["en", "de"] * 60
    texts = [text(x, 40) for x in langs] + [text("de", 600_000), text("en", 600_000)]
    df = docs(spark, texts, lang=[*langs, None, None])
    got = {r.doc_id: r.language for r in L.identify(df).where("doc_id >= 120").select("doc_id", "language").collect()}
    assert (got[120].lang, got[121].lang) == ("de", "en") and all(0 <= x.score <= 1 for x in got.values())
