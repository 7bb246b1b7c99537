"""Quality rules: a linear-chain conditional random field marks every line as content or boilerplate.

Each line with a word gets a bucket for each of a few surface features. The labels say which documents are good, not which lines, so lines are
hidden states that are learned in rounds: at first a document's lines have its label; then they are decoded by the field, and keep the
decoded states where the document as a whole still comes out as labelled. In every round the field's likelihood is maximised on sequences
made of runs of lines of several documents of both labels, so that it sees changes between content and boilerplate. It learns from at most `MAX_TRAIN_DOCS` documents, picked by hash, and of each from at most
`TRAIN_LINES` lines in a row, from a place that the id's hash picks; Viterbi decoding marks the lines of all documents, whole. A document stays if the words of content
lines are at least `MIN_SHARE` of its words and no base rule fails (fewer than 50 words, or more than half of them in repeated
3-word windows).

Defined results: null, empty or wordless texts have zero counts and fail the base rules; without labels of both kinds all lines are content;
repeated documents get the same result; other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_sample, mix, plain, read, released, slices, words_of

MAX_TRAIN_DOCS, TRAIN_LINES = 3000, 64
MIN_SHARE = 0.5
#: Rounds in which lines are decoded and learned anew; lines of a run and runs of a training sequence at most.
DECODED, PIECE, JOINED, SEED = 1, 12, 6, 6
#: Upper bounds of the features' buckets; a share above the last falls in one more.
BUCKETS = {
    "words": (1, 3, 7, 15, 40),
    "symbols": (0.0, 0.02, 0.08, 0.2),
    "capitals": (0.05, 0.2, 0.6),
    "digits": (0.0, 0.05, 0.2),
    "exclaims": (0.0, 0.05),
    "repeats": (0.0, 0.1, 0.4),
    "copies": (0.0, 0.3, 0.7),
    "word_length": (2.5, 4.0, 6.0, 9.0),
    "stop": (0.5,),
    "again": (0.5,),
}
WIDTH = 1 + max(map(len, BUCKETS.values()))


@dataclass
class Crf:
    """Weights: of a feature's bucket by state, of a state after another, of the first state. State 1: boilerplate."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    @staticmethod
    def blank() -> Crf:
        return Crf(np.zeros((len(BUCKETS), WIDTH, 2)), np.zeros((2, 2)), np.array([1e-3, 0.0]))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.emit[f, codes[:, f]] for f in range(len(BUCKETS))) if len(codes) else np.zeros((0, 2))


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text; the buckets of its lines with a word, those lines' words and the texts' offsets into the lines."""
    n = len(texts)
    lists = pc.split_pattern(texts, "\n")
    owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    lines = pc.list_flatten(lists)
    word, vocab, at = words_of(lines)
    n_words = np.diff(at)
    line_of = np.repeat(np.arange(len(lines)), n_words)
    doc_of = owner[line_of]
    by_line = lambda x: np.bincount(line_of, x, len(lines))
    of_vocab = lambda pattern: pc.count_substring_regex(vocab, pattern).to_numpy(zero_copy_only=False).astype(np.float64)
    chars = by_line(pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.float64)[word])
    symbols = by_line(of_vocab(r"[#*$%&|<>]")[word])

    def windows() -> np.ndarray:
        covered = np.zeros(len(word), bool)
        if len(word) >= 3:
            w = word.astype(np.uint64)
            key = mix(mix(mix(w[:-2]) + w[1:-1]) + w[2:]) ^ mix(doc_of[:-2].astype(np.uint64) + np.uint64(1 << 40))
            at = np.flatnonzero(doc_of[:-2] == doc_of[2:])
            order = at[np.argsort(key[at])]
            same = key[order][1:] == key[order][:-1]
            hit = np.zeros(len(order), bool)
            hit[1:] |= same
            hit[:-1] |= same
            for k in range(3):
                covered[order[hit] + k] = True
        return covered

    covered = windows()
    has = n_words > 0
    ids = lines.dictionary_encode()
    key = owner * (len(ids.dictionary) + 1) + ids.indices.to_numpy(zero_copy_only=False)
    again = np.ones(len(lines), bool)
    again[np.unique(key, return_index=True)[1]] = False
    again &= has
    by_doc = lambda x: np.bincount(owner, x, n).astype(np.int64)
    counts = {
        "n_words": by_doc(n_words),
        "word_chars": by_doc(chars),
        "n_symbols": by_doc(symbols),
        "n_dup_lines": by_doc(again),
        "n_repeat_words": np.bincount(doc_of, covered, n).astype(np.int64),
    }
    repeat = np.zeros(len(word))
    repeat[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    some, long = np.maximum(n_words, 1), np.maximum(chars, 1)
    values = {
        "words": n_words,
        "symbols": symbols / long,
        "capitals": by_line(of_vocab(r"\p{Lu}")[word]) / long,
        "digits": by_line(of_vocab("[0-9]")[word]) / long,
        "exclaims": by_line(of_vocab("!")[word]) / long,
        "repeats": by_line(repeat) / some,
        "copies": by_line(covered) / some,
        "word_length": chars / some,
        "stop": pc.match_substring_regex(lines, r"[.!?…:;]\s*$").to_numpy(zero_copy_only=False),
        "again": again,
    }
    codes = np.stack([np.searchsorted(np.array(BUCKETS[k], float), v[has].astype(float), "left") for k, v in values.items()], 1).astype(np.int8)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[has], minlength=n))])
    return counts, codes, n_words[has], offsets


def steps(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each t, the sequences (longest first) that have a line t, and its place."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    ends = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    for t, n in enumerate(ends):
        yield t, order[:n], offsets[order[:n]] + t


def scanned(parts: np.ndarray, join) -> np.ndarray:
    """All joins of the first 1, 2, … parts, by doubling: in log n steps over whole arrays, however long the longest text is."""
    out, k = parts.copy(), 1
    while k < len(out):
        out[k:] = join(out[:-k].copy(), out[k:])
        k *= 2
    return out


def viterbi(model: Crf, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The likeliest states of all sequences' lines; content on a tie.

    A line is a 2 x 2 matrix of what its state adds after each state before it; at a sequence's start the state before doesn't matter. The best sums up to
    each line are running products of these in which + takes the place of times and max that of +; the way back is a running composition of maps.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int8)
    emit, has = model.scores(codes), np.diff(offsets) > 0
    first, last = offsets[:-1][has], offsets[1:][has] - 1
    into = model.step[None] + emit[:, None, :]
    into[first] = (model.first + emit[first])[:, None, :]
    # after each line only the difference of the two states matters, so sums are taken from the larger one
    level = lambda m: m - m.max((1, 2))[:, None, None]
    best = scanned(into, lambda x, y: level(np.maximum(x[:, :, :1] + y[:, :1], x[:, :, 1:] + y[:, 1:]))).max(1)
    back = np.zeros((n, 2), np.int8)
    back[1:] = (best[:-1, :, None] + model.step).argmax(1)
    # ahead[i]: the state of line i by the state of line i + 1
    ahead = np.zeros((n, 2), np.int8)
    ahead[:-1] = back[1:]
    ahead[last] = best[last].argmax(1)[:, None]
    walked = scanned(ahead[::-1], lambda x, y: np.take_along_axis(y, x.astype(np.int64), 1))
    return walked[::-1, 0].copy()


def expected(model: Crf, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each line's states, summed posteriors of steps, and of first states (forward and backward passes)."""
    emit, n = model.scores(codes), len(offsets) - 1
    ahead, behind = np.zeros((len(codes), 2)), np.zeros((len(codes), 2))
    walk, log = list(steps(offsets)), np.logaddexp.reduce
    for t, _, at in walk:
        ahead[at] = emit[at] + (model.first if t == 0 else log(ahead[at - 1][:, :, None] + model.step, 1))
    pair = np.zeros((2, 2))
    total = np.zeros(n)
    last = offsets[1:] - 1
    has = np.diff(offsets) > 0
    total[has] = log(ahead[last[has]], 1)
    for t, seq, at in reversed(walk):
        if t:
            behind[at - 1] = log(model.step + (emit[at] + behind[at])[:, None, :], 2)
            pair += np.exp(ahead[at - 1][:, :, None] + model.step + (emit[at] + behind[at])[:, None, :] - total[seq][:, None, None]).sum(0)
    post = np.exp(ahead + behind - np.repeat(total, np.diff(offsets))[:, None])
    return post, pair, post[offsets[:-1][has]].sum(0)


def fit_sequences(codes: np.ndarray, offsets: np.ndarray, states: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with L2 decay, by Adam over all sequences."""
    model, one = Crf.blank(), np.eye(2)[states]
    n, has = max(len(codes), 1), np.diff(offsets) > 0
    inner = np.ones(len(codes), bool)
    inner[offsets[:-1][has]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (states[np.flatnonzero(inner) - 1], states[inner]), 1)

    def gathered(p: np.ndarray) -> np.ndarray:
        out = np.zeros_like(model.emit)
        for f in range(len(BUCKETS)):
            for s in range(2):
                out[f, :, s] = np.bincount(codes[:, f], p[:, s], WIDTH)
        return out

    params = [model.emit, model.step, model.first]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    target = [gathered(one), seen, one[offsets[:-1][has]].sum(0)]
    for k in range(1, rounds + 1):
        post, pair, first = expected(model, codes, offsets)
        for p, m, want, got in zip(params, moments, target, [gathered(post), pair, first], strict=True):
            g = (got - want) / n + decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
    return model


def joined(codes: list[np.ndarray], states: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines and states, cut into runs of 1 to PIECE lines; 1 to JOINED runs in a random order make one sequence. And the sequences' offsets."""
    pieces = []
    for k, c in enumerate(codes):
        ends = np.cumsum(rng.integers(1, PIECE + 1, len(c)))
        pieces += [(k, a, b) for a, b in zip([0, *ends], np.minimum(ends, len(c)), strict=False) if a < b]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    ends = np.cumsum(rng.integers(1, JOINED + 1, len(pieces)))
    ends = np.append(ends[ends < len(pieces)], len(pieces))
    sizes = np.cumsum([b - a for _, a, b in pieces])
    return np.concatenate([codes[k][a:b] for k, a, b in pieces]), np.concatenate([states[k][a:b] for k, a, b in pieces]), np.concatenate([[0], sizes[ends - 1]])


def fit_documents(codes: list[np.ndarray], words: list[np.ndarray], quality: list[int], decoded: int = DECODED) -> Crf:
    """The field learned from documents' lines, their words and the documents' labels; the lines' states are hidden."""
    rng = np.random.default_rng(SEED)
    states = [np.full(len(c), 1 - q, np.int8) for c, q in zip(codes, quality, strict=True)]
    model = fit_sequences(*_in_order(joined(codes, states, rng)), rounds=150)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    for k in range(decoded):
        found = np.split(viterbi(model, np.concatenate(codes), offsets), offsets[1:-1])
        good = [(w * (s == 0)).sum() >= MIN_SHARE * w.sum() for w, s in zip(words, found, strict=True)]
        states = [s if g == bool(q) else np.full(len(s), 1 - q, np.int8) for s, g, q in zip(found, good, quality, strict=True)]
        model = fit_sequences(*_in_order(joined(codes, states, rng)), rounds=300 if k == decoded - 1 else 150)
    return model


def _in_order(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, states, offsets = parts
    return codes, offsets, states


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS, lines: int = TRAIN_LINES) -> Crf:
    """The field trained on at most `most` labelled documents and `lines` lines in a row of each."""
    # no document comes in twice if a label is repeated
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(bounded_sample(known, "doc_id", most).withColumnRenamed("doc_id", "of"))

    @F.arrow_udf("struct<codes:binary,words:binary>")
    def lines_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts in released(batches):
            codes_out, words_out, start = [], [], iter(starts.to_numpy(zero_copy_only=False))
            for part in slices(plain(texts)):
                _, codes, words, offsets = measure(part)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    a += int(next(start) * max(b - a - lines + 1, 1))
                    codes_out.append(codes[a : min(b, a + lines)].tobytes())
                    words_out.append(words[a : min(b, a + lines)].astype(np.int64).tobytes())
            yield pa.StructArray.from_arrays([pa.array(codes_out, pa.binary()), pa.array(words_out, pa.binary())], ["codes", "words"])

    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of")).select("doc_id", "quality", lines_of("text", share).alias("x")).select("doc_id", "quality", "x.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.codes))
    rows = [r for r in rows if r.codes]
    if len({r.quality for r in rows}) < 2:
        return Crf.blank()
    codes = [np.frombuffer(r.codes, np.int8).reshape(-1, len(BUCKETS)) for r in rows]
    return fit_documents(codes, [np.frombuffer(r.words, np.int64) for r in rows], [r.quality for r in rows])


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(text: Column | str, model: Crf, min_share: float = MIN_SHARE) -> Column:
    """Column of struct(counts…, content_share, base_failed, kept) of whole texts."""

    @F.arrow_udf(f"struct<{','.join(f'{k}:bigint' for k in FIELDS)},content_share:double,base_failed:boolean,kept:boolean>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            out = []
            for part in slices(plain(batch)) if len(batch) else []:
                counts, codes, words, offsets = measure(part)
                states = viterbi(model, codes, offsets)
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                content = np.bincount(owner, words * (states == 0), len(part))
                n = counts["n_words"]
                share = content / np.maximum(n, 1)
                failed = (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)
                cols = [*(counts[k] for k in FIELDS), share, failed, ~failed & (share >= min_share)]
                out.append(pa.StructArray.from_arrays([pa.array(c) for c in cols], [*FIELDS, "content_share", "base_failed", "kept"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([*((k, pa.int64()) for k in FIELDS), ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]))

    return judged.asNondeterministic()(text)


def judge_documents(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, *, into: str = "quality_rules") -> DataFrame:
    """The rows with `into`, by a field trained on their labelled ones."""
    return docs.withColumn(into, judge("text", fit(docs, labels), min_share))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judge_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return docs.select("doc_id", *(f"quality_rules.{k}" for k in (*FIELDS, "base_failed", "kept", "content_share")))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
