"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

Two words are alike by their common letter triples, which may have gaps: a triple over s letters weighs DECAY ** (s - 3), up to
SPAN letters, and the kernel is the cosine of the summed weights; so inserted or changed characters lower it gently. Other characters than letters are
left out, and single letters in a row (three or more) also count as one word. Landmarks are the words that tell toxic from other labelled documents best; a document's
kernel with a landmark is the largest of its words' (below FLOOR: none). Nyström maps these by the inverse root of the landmarks' own
kernel, a linear squared-hinge machine separates them, and a sigmoid fitted on its margins gives the score.

Bounds: at most MAX_TRAIN_ROWS labelled documents, picked by hash, and LANDMARKS landmarks; all words of all documents are scored.

Defined results: null, empty and wordless texts have no words and so get the score of a text without insults; without labels of both kinds
every score is 0; repeated documents get the same score; other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import MAX_TRAIN_ROWS, bounded_sample, fold, plain, read, released, slices, spread, words_of

LANDMARKS = 128
DECAY, SPAN, FLOOR = 0.6, 7, 0.5
#: Distinct words and bytes of text that are worked on at once.
CHUNK, TEXT_BYTES = 8192, 4 << 20
#: A word becomes a landmark only if so many toxic training documents have it.
LEAST_DOCS = 3
#: … and if the likelihood ratio statistic of its link with the label is so large.
LEAST_GAIN = 15.0
#: (second, third letter's distance from the first, weight)
STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A class from 1 to 63 for every character of the words, and the words' offsets: a-z have their own, others share."""
    data = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    code = np.where((data >= 97) & (data <= 122), data - 96, np.where(data < 128, 27 + data % 5, 32 + data % 32)).astype(np.int32)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return code, np.concatenate([[0], np.cumsum(sizes)])


def triples(code: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, triple, weight) of all triples, one spacing after another."""
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(sizes)), sizes)
    left = offsets[1:][word] - np.arange(len(code))
    for a, b, weight in STEPS:
        at = np.flatnonzero(left > b)
        yield word[at], (code[at] << 12) | (code[at + a] << 6) | code[at + b], weight


def text_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each place's word, the distinct words (lower case, letters only), and the texts' offsets; spelled-out words stand at the end."""
    index, vocab, at = words_of(texts)
    bare = pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}]+", "").dictionary_encode()
    index, vocab = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)[index], bare.dictionary
    single = pc.utf8_length(vocab).to_numpy(zero_copy_only=False)[index] == 1 if len(index) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    change = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    runs = [(a, b) for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True) if b - a >= 3]
    if not runs:
        return index, vocab, at
    words, more, where = vocab.to_pylist(), [], []
    for a, b in runs:
        for doc in np.unique(owner[a:b]):
            part = index[a:b][owner[a:b] == doc]
            if len(part) >= 3:
                more.append("".join(words[i] for i in part))
                where.append(doc)
    index = np.concatenate([index, len(words) + np.arange(len(more))])
    owner = np.concatenate([owner, np.array(where, np.int64)])
    order = np.argsort(owner, kind="stable")
    return index[order], pa.array(words + more, vocab.type), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


@dataclass
class Landmarks:
    """Words; the row of each triple (0: none), and the rows' words with their shares of those words' unit vectors."""

    words: list[str]

    def __post_init__(self):
        code, offsets = letters(pa.array(self.words, pa.large_string()))
        found = [(w, t, np.full(len(w), x)) for w, t, x in triples(code, offsets)]
        word, triple, weight = (np.concatenate([f[i] for f in found]) for i in range(3))
        distinct, row = np.unique(triple, return_inverse=True)
        self.row = np.zeros(1 << 18, np.int32)
        self.row[distinct] = np.arange(1, len(distinct) + 1)
        share = np.zeros((len(distinct) + 1, len(self.words)))
        np.add.at(share, (row + 1, word), weight)
        share /= np.maximum(np.sqrt((share**2).sum(0)), 1e-9)
        self.gram = share.T @ share
        of, self.mark = np.nonzero(share)
        self.part = share[of, self.mark]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(share)))])

    def alike(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel) of all pairs of a word and a landmark whose kernel is FLOOR or more, by word."""
        parts = [(at, self._alike(vocab.slice(at, CHUNK))) for at in range(0, len(vocab), CHUNK)] or [(0, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))]
        return np.concatenate([x[0] + at for at, x in parts]), np.concatenate([x[1] for _, x in parts]), np.concatenate([x[2] for _, x in parts])

    def _alike(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, offsets = letters(vocab)
        n, m = len(vocab), len(self.words)
        sizes, known = np.diff(offsets), np.zeros(n)
        total = sum(np.maximum(sizes - b, 0) * w**2 for _, b, w in STEPS)
        for word, triple, weight in triples(code, offsets):
            known += np.bincount(word[self.row[triple] > 0], minlength=n) * weight**2
        # the part of a word's vector on landmarks' triples bounds its kernels
        near = np.flatnonzero(known >= (0.9 * FLOOR) ** 2 * np.maximum(total, 1e-9))
        code, offsets = code[spread(offsets[near], sizes[near])], np.concatenate([[0], np.cumsum(sizes[near])])
        found = [(w, t, np.full(len(w), x)) for w, t, x in triples(code, offsets)]
        word, triple, weight = (np.concatenate([f[i] for f in found]) for i in range(3))
        # a triple that comes twice in a word counts with its summed weight
        distinct, where = np.unique((word.astype(np.int64) << 18) | triple, return_inverse=True)
        norm = np.sqrt(np.bincount(distinct >> 18, np.bincount(where, weight) ** 2, len(near)))
        row = self.row[triple]
        hit = row > 0
        row, size = row[hit], np.diff(self.at)[row[hit]]
        place = spread(self.at[row], size)
        kernel = np.bincount(np.repeat(word[hit] * m, size) + self.mark[place], np.repeat(weight[hit], size) * self.part[place], len(near) * m)
        pair = np.flatnonzero(kernel)
        value = kernel[pair] / np.maximum(norm[pair // m], 1e-9)
        keep = value >= FLOOR
        return near[pair[keep] // m], pair[keep] % m, value[keep]

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Kernels of the texts with the landmarks: the largest of their words'."""
        index, vocab, at = text_words(texts)
        m = len(self.words)
        out = np.zeros(len(texts) * m, np.float32)
        word, mark, value = self.alike(vocab)
        count = np.bincount(word, minlength=len(vocab))
        start = np.cumsum(count) - count
        use = np.flatnonzero(count[index])
        owner = np.repeat(np.arange(len(texts)), np.diff(at))[use]
        size = count[index[use]]
        place = spread(start[index[use]], size)
        np.maximum.at(out, np.repeat(owner * m, size) + mark[place], value[place].astype(np.float32))
        return out.reshape(-1, m)


@dataclass
class Model:
    """Landmarks, Nyström map, weights and sigmoid; without landmarks every score is 0."""

    words: list[str]
    map: np.ndarray | None = None
    weights: np.ndarray | None = None
    sigmoid: tuple[float, float] = (0.0, 0.0)

    def scorer(self):
        marks = Landmarks(self.words) if self.words else None

        def score(texts: pa.Array) -> np.ndarray:
            if marks is None:
                return np.zeros(len(texts))
            margin = marks.of_texts(texts) @ self.map @ self.weights[:-1] + self.weights[-1]
            return 1 / (1 + np.exp(-np.clip(self.sigmoid[0] * margin + self.sigmoid[1], -40, 40)))

        return score


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weights and bias (last) that minimise the weighted squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), decay * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + ridge, a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def sigmoid_of(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, with his smoothed targets."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - target))
        p -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model:
    """The machine trained on labelled documents whose fold is not 0 (crc32 of the id as text, modulo 5)."""
    known = labels.where("toxic in (0, 1)").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(bounded_sample(known, "doc_id", most).withColumnRenamed("doc_id", "of"))
    train = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic")

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            out: list[list[str]] = []
            for part in slices(plain(batch), TEXT_BYTES):
                index, vocab, at = text_words(part)
                names = vocab.to_pylist()
                out += [[names[i] for i in np.unique(index[a:b]) if len(names[i]) >= 4] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.array(out, pa.list_(pa.string()))

    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model([])
    n1, n0 = sizes[1], sizes[0]
    seen = train.select("toxic", F.explode(words("text")).alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n / ((F.col("a") + F.col("b")) / (n1 + n0)))).otherwise(0.0)
    gain = 2 * (part(F.col("a"), n1) + part(F.col("b"), n0))
    best = seen.where((F.col("a") >= LEAST_DOCS) & (F.col("a") * n0 > F.col("b") * n1) & (gain >= LEAST_GAIN)).orderBy(F.desc(gain), "word").limit(landmarks).collect()
    if not best:
        return Model([])
    names = [r.word for r in best]

    @F.arrow_udf("binary")
    def kernels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Landmarks(names)
        for batch in released(batches):
            yield pa.array([x.tobytes() for part in slices(plain(batch), TEXT_BYTES) for x in marks.of_texts(part)], pa.binary())

    rows = train.select("doc_id", "toxic", kernels("text").alias("k")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.k))
    x, toxic = np.stack([np.frombuffer(r.k, np.float32) for r in rows]).astype(float), np.array([r.toxic for r in rows], float)
    value, vector = np.linalg.eigh(Landmarks(names).gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    w = squared_hinge(x @ root, 2 * toxic - 1, np.where(toxic == 1, 0.5 / n1, 0.5 / n0) * (n1 + n0))
    return Model(names, root, w, sigmoid_of(x @ root @ w[:-1] + w[-1], toxic))


def toxicity(text: Column | str, model: Model) -> Column:
    """Column of scores of whole texts."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in released(batches):
            yield pa.array(np.concatenate([np.zeros(0), *(of(part) for part in slices(plain(batch), TEXT_BYTES))]))

    return score.asNondeterministic()(text)


def score_documents(docs: DataFrame, labels: DataFrame, *, into: str = "toxicity") -> DataFrame:
    """The rows with `into`, the score by a machine trained on their labelled ones."""
    return docs.withColumn(into, toxicity("text", fit(docs, labels)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
