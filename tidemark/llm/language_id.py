"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first rotated twice and the second
once, so that order counts (binding); a text is the sum of its trigrams' vectors (bundling), and a language the sum of its training texts' unit
vectors. The prediction is the language whose vector has the largest cosine; ties go to the name that sorts first. The score is the
share of that language in the softmax of SHARPNESS times the cosines. Letters are lower-cased and words are bounded by blanks.

Learned from at most MAX_TRAIN_ROWS documents, picked by hash, whose fold is not 0. The vectors of trigrams are
computed from the letters' when they are met, so there is no table of trigrams; texts are taken in slices.

Defined results: null or a text without letters: `und` and score 0; without training texts every text is `und`; a text of any length is read
whole; repeated documents get the same result; other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import MAX_TRAIN_ROWS, bounded_sample, fold, plain, read, released, slices

DIMENSIONS = 1024
SHARPNESS = 30.0
#: Classes of characters: 0 is a blank (all but letters), 1-26 are a-z, the others share what is left.
CLASSES = 64
SEED = 20_240_601
#: Texts whose counts are multiplied at once.
BLOCK = 64


@lru_cache(maxsize=1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes' vectors rotated twice, once and not at all."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each character below U+3000: letters by their code, others blank."""
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return table


def classes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, texts one after another with a blank before each, and each place's text."""
    low = pc.utf8_lower(texts)
    data = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    table = class_table()
    code = np.where(data < len(table), table[np.minimum(data, len(table) - 1)], (27 + data % 37) * np.uint32(1)).astype(np.uint8)
    if (far := np.flatnonzero(data >= len(table))).size:
        letter = np.array([chr(c).isalpha() for c in data[far].tolist()])
        code[far[~letter]] = 0
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return np.insert(code, np.concatenate([ends - sizes, ends[-1:]]), 0), np.repeat(np.arange(len(texts) + 1), np.append(sizes + 1, 1))


def ranked(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and each value's rank in them."""
    seen = np.zeros(below, bool)
    seen[values] = True
    rank = np.cumsum(seen, dtype=np.int32)
    return np.flatnonzero(seen), rank[values] - 1


def bundles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' vectors, and which texts have letters."""
    code, owner = classes(texts)
    n = len(texts)
    first, second, third = letter_vectors()
    # a trigram that has no letter in its middle stands between words and says nothing
    at = np.flatnonzero(code[1:-1])
    key = (code[at].astype(np.int64) << 12) | (code[at + 1].astype(np.int64) << 6) | code[at + 2]
    distinct, where = ranked(key, CLASSES**3)
    of = owner[at + 1]
    out = np.zeros((n, DIMENSIONS), np.float32)
    bound = (first[distinct >> 12] * second[distinct >> 6 & 63] * third[distinct & 63]).astype(np.float32)
    edge = np.searchsorted(of, np.arange(0, n + BLOCK, BLOCK))
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        rows = min(BLOCK, n - BLOCK * i)
        if rows > 0 and b > a:
            used, local = ranked(where[a:b], len(distinct))
            counts = np.bincount((of[a:b] - BLOCK * i) * len(used) + local, minlength=rows * len(used)).reshape(rows, -1)
            out[BLOCK * i : BLOCK * i + rows] = counts.astype(np.float32) @ bound[used]
    return out, np.bincount(of, minlength=n) > 0


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, has = bundles(texts)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
        cosine = x @ self.vectors.T
        best = cosine.argmax(1)
        score = 1 / np.exp(SHARPNESS * (cosine - cosine.max(1)[:, None])).sum(1)
        return [self.names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).astype(float)


def fit(docs: DataFrame, most: int = MAX_TRAIN_ROWS) -> Profiles:
    """A vector of each value of lang, from documents whose fold is not 0."""
    docs = docs.select("doc_id", "text", "lang")
    ids = docs.where(F.col("lang").isNotNull()).where(fold("doc_id") != 0).select("doc_id")
    chosen = F.broadcast(bounded_sample(ids, "doc_id", most).withColumnRenamed("doc_id", "of"))
    train = docs.where(F.col("lang").isNotNull()).join(chosen, F.col("doc_id") == F.col("of")).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in released(batches):
            at = 0
            for part in slices(plain(batch.column(1))):
                x, _ = bundles(part)
                x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
                for lang, v in zip(batch.column(0).slice(at, len(part)).to_pylist(), x, strict=True):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
                at += len(part)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    places = train.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = places.groupBy("lang", "i").agg(F.round(F.sum("x"), 6).alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sorted(summed.collect(), key=lambda r: r.lang)
    vectors = np.array([[p.x for p in r.v] for r in rows], np.float32).reshape(len(rows), DIMENSIONS)
    return Profiles([r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None])


def language(text: Column | str, profiles: Profiles) -> Column:
    """Column of struct(lang, score) of whole texts."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            names, scores = [], [np.zeros(0)]
            for part in slices(plain(batch), 2 << 20):
                n, s = profiles.predict(part)
                names += n
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    return predicted.asNondeterministic()(text)


def identify(docs: DataFrame, *, into: str = "language") -> DataFrame:
    """The rows with `into`, by profiles learned from them."""
    return docs.withColumn(into, language("text", fit(docs)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return named.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
