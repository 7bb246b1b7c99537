"""Quality classifier: a linear hinge-loss machine over n-gram indicators that are scaled by the classes' log-count ratios (Naive Bayes support vectors).

Units are runs of letters and digits, and runs of other characters; n-grams are runs of 1 and 2 units, and of 1 to 3 of the units' shapes (`Aa`, `A`,
`a`, `9`, or the marks themselves), so that words never seen before count by their form. An n-gram is hashed to one of HASHES numbers. Spark counts in how many
training documents of each class it is; the FEATURES n-grams that tell the classes best (likelihood ratio) are kept, each with the log of the
ratio of its smoothed shares. A document's vector has this ratio for each kept n-gram that it holds, however often, and is scaled to length 1; a constant gives the bias.
Dual coordinate descent fits the weights, with both classes' losses weighing alike. A sigmoid turns margins into shares of label 1; it is fitted
on margins of training documents under machines that were fitted without them (FOLDS parts).

Bounds: at most MAX_TRAIN_ROWS labelled documents, picked by hash; the driver gets one bit for each of these and each feature. All documents are scored whole.

Defined results: null and empty texts have no n-grams, and the score of the bias alone; without labels of both kinds the score is the share of label
1 (none: 0); repeated documents get the same score; other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import MAX_TRAIN_ROWS, bounded_sample, fold, mix, plain, read, released, slices, words_of
from tidemark.llm.toxicity import sigmoid_of

HASHES, FEATURES, LEAST_DOCS = 1 << 20, 4096, 3
WORD_GRAMS, SHAPE_GRAMS = 2, 3
#: The loss' weight, and when descent ends: the largest breach of the conditions, or rounds over all documents.
COST, TOLERANCE, ROUNDS, FOLDS = 1.0, 0.02, 100, 3
SEED = 12
#: Texts whose indicators are multiplied at once.
BLOCK = 256
#: Score from which the query predicts label 1.
CUT = 0.3


def shapes(units: pa.Array) -> pa.Array:
    """Each unit's shape."""
    for found, shape in ((r"\pN+", "9"), (r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")):
        units = pc.replace_substring_regex(units, found, shape)
    return units


def hashed(units: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(units.to_pylist(), object), categorize=False) if len(units) else np.zeros(0, np.uint64)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every place of an n-gram; a text may have the same one more than once."""
    index, vocab, at = words_of(pc.replace_substring_regex(texts, r"[^\pL\pN\s]+", r" \0 "))
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    names = shapes(vocab).dictionary_encode()
    own, of_shape = hashed(vocab)[index], hashed(names.dictionary)[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)][index]
    rows, out = [], []
    for no, (unit, longest) in enumerate(((own, WORD_GRAMS), (of_shape, SHAPE_GRAMS))):
        run = np.zeros(len(unit), np.uint64)
        for k in range(min(longest, len(unit))):
            run = mix(run[: len(unit) - k] * np.uint64(31) + unit[k:] + np.uint64(7 * no + k + 1))
            whole = owner[: len(unit) - k] == owner[k:]
            rows.append(owner[: len(unit) - k][whole])
            out.append((run[whole] % np.uint64(HASHES)).astype(np.int32))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int32), *out])


@dataclass
class Model:
    """The kept n-grams' hashes and ratios, the weights (last: bias) and the sigmoid; without n-grams every score is `share`."""

    share: float
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    sigmoid: tuple[float, float] | None = None

    def indicators(self):
        """A function from texts to their flags, one row a text and one column a kept n-gram, in blocks of rows."""
        place = np.full(HASHES, -1, np.int32)
        place[self.hashes] = np.arange(len(self.hashes))

        def flags(texts: pa.Array) -> Iterator[np.ndarray]:
            for at in range(0, len(texts), BLOCK):
                block = texts.slice(at, BLOCK)
                row, gram = grams(block)
                column = place[gram]
                out = np.zeros((len(block), len(self.hashes)), bool)
                out[row[column >= 0], column[column >= 0]] = True
                yield out

        return flags

    def margins(self, flags: np.ndarray) -> np.ndarray:
        length = np.sqrt(flags @ self.ratios**2)
        return flags @ (self.ratios * self.weights[:-1]) / np.maximum(length, 1e-9) + self.weights[-1]

    def scorer(self):
        flags = self.indicators()

        def score(texts: pa.Array) -> np.ndarray:
            if self.sigmoid is None:
                return np.full(len(texts), self.share)
            margin = np.concatenate([self.margins(x) for x in flags(texts)])
            return 1 / (1 + np.exp(-np.clip(self.sigmoid[0] * margin + self.sigmoid[1], -40, 40)))

        return score


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Weights and bias (last) that minimise |w|² / 2 + the summed hinge losses, each times its cost.

    rows, values: the places and values of each vector's nonzero entries, among n; y: 1 or -1. One dual variable between 0 and its cost belongs to each
    document, and is set to its best value with the others held, in a new random order each round.
    """
    w, alpha = np.zeros(n + 1), np.zeros(len(y))
    squared = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1
            old = alpha[i]
            if (old <= 0 and slope >= 0) or (old >= cost[i] and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            alpha[i] = min(max(old - slope / squared[i], 0.0), cost[i])
            step = (alpha[i] - old) * y[i]
            w[at] += step * v
            w[-1] += step
        if worst < TOLERANCE:
            break
    return w


def fit_rows(flags: np.ndarray, label: np.ndarray, ratios: np.ndarray, cost: float = COST) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights by dual coordinate descent, and the sigmoid of margins by machines that didn't see the document."""
    rows = [np.flatnonzero(x) for x in flags]
    values = [ratios[r] / max(float(np.sqrt(ratios[r] @ ratios[r])), 1e-9) for r in rows]
    y = 2.0 * label - 1

    def machine(chosen: np.ndarray) -> np.ndarray:
        share = label[chosen].mean()
        each = cost * np.where(label[chosen] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        return dual_descent([rows[i] for i in chosen], [values[i] for i in chosen], y[chosen], each, flags.shape[1])

    margin = np.zeros(len(y))
    part = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    for k in range(FOLDS):
        w = machine(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            margin[i] = w[rows[i]] @ values[i] + w[-1]
    return machine(np.arange(len(y))), sigmoid_of(margin, label)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN_ROWS, features: int = FEATURES) -> Model:
    """The machine trained on labelled documents whose fold is not 0 (crc32 of the id as text, modulo 5)."""
    known = labels.where(f"`{label}` in (0, 1)").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = F.broadcast(bounded_sample(known, "doc_id", most).withColumnRenamed("doc_id", "_of"))
    train = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_of")).select("doc_id", "text", "_label")
    sizes = {r._label: r["count"] for r in train.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return Model(float(*sizes) if sizes else 0.0)

    @F.arrow_udf("array<int>")
    def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            out = []
            for part in slices(plain(batch)):
                row, gram = grams(part)
                pairs = np.unique(row * HASHES + gram)
                ends = np.searchsorted(pairs, np.arange(len(part) + 1) * HASHES)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs % HASHES).astype(np.int32))))
            yield pa.chunked_array(out, pa.list_(pa.int32())).combine_chunks()

    n1, n0 = sizes[1], sizes[0]
    seen = train.select("_label", F.explode(distinct("text")).alias("gram")).groupBy("gram").agg(F.sum("_label").cast("double").alias("a"), F.sum(1 - F.col("_label")).cast("double").alias("b"))
    both = seen.where(F.col("a") + F.col("b") >= LEAST_DOCS)
    part = lambda k, n, m: F.when(k > 0, k * F.log(k / n / m)).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    gain = part(F.col("a"), n1, share) + part(F.col("b"), n0, share) + part(n1 - F.col("a"), n1, 1 - share) + part(n0 - F.col("b"), n0, 1 - share)
    best = both.orderBy(F.desc(F.round(gain, 9)), "gram").limit(features).collect()
    if not best:
        return Model(n1 / (n1 + n0))
    best.sort(key=lambda r: r.gram)
    p, q = (1 + np.array([r[c] for r in best]) for c in "ab")
    model = Model(n1 / (n1 + n0), np.array([r.gram for r in best]), np.log((p / p.sum()) / (q / q.sum())))

    @F.arrow_udf("binary")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flags = model.indicators()
        for batch in released(batches):
            yield pa.array([x.tobytes() for part in slices(plain(batch)) for block in flags(part) for x in np.packbits(block, axis=1)], pa.binary())

    rows = train.select("doc_id", "_label", bits("text").alias("bits")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.bits))
    packed = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1)
    flags = np.unpackbits(packed, axis=1, count=len(best)).view(bool)
    model.weights, model.sigmoid = fit_rows(flags, np.array([r._label for r in rows], float), model.ratios)
    return model


def quality(text: Column | str, model: Model) -> Column:
    """Column of scores of whole texts."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in released(batches):
            yield pa.array(np.concatenate([np.zeros(0), *(of(part) for part in slices(plain(batch)))]))

    return score.asNondeterministic()(text)


def score_documents(docs: DataFrame, labels: DataFrame, *, label: str = "quality", into: str = "quality_score") -> DataFrame:
    """The rows with `into`, the score by a machine trained on their labelled ones."""
    return docs.withColumn(into, quality("text", fit(docs, labels, label)))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), into="score")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier}
ORACLE: dict[str, str] = {}
