"""Mixture-controlled packing: every window of sequences holds the target token proportions of the sources.

Tokens of a source form a queue, in the order of the written partitions. Deficit round-robin gives queue s in every window its
quantum, `window * rate[s] / sum(rates)` tokens; what rounding leaves is its deficit and is carried to the next window. Texts may
be cut, so the deficits have a closed form, `A_s(T) = floor(T * rate[s] / sum(rates))` after T tokens (the queue with
the largest rate takes the rest), and every partition places its own documents without seeing the others: it needs only
how many tokens of each source the partitions before it hold. Where targets are given, queues run dry one after another; the
rest go on at their rates (a phase each).

Sequences are full but for the last tokens of all, which are cut into sequences of powers of two, so nothing is padded.

Every source has a queue, and a window grows with the squared number of queues; the table of queues is on the driver. Where `most_queues` is
given, the sources with targets and then those with most tokens have one each, and all further ones share one; targets that get none are refused.
The table of partition starts is broadcast below 32 MB and joined by a shuffle beyond.

Defined results: a null text counts as empty and has its end token alone; a null source is a source of its own; repeated
documents are all packed; an empty table has no pieces; other columns are ignored. The order within a source follows the partitions of the
input, so it is the same for the same files.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import materialise, plain, read, released, slices
from tidemark.llm.byte_bpe import REMEMBERED, encoder

SEQUENCE = 1024
#: Text that a worker encodes at once: fewer parts of words come again in another slice.
TEXT_BYTES = 8 << 20
#: Sequences of a window: the span over which proportions hold.
WINDOW_SEQUENCES = 64
#: Bytes of the table of partition starts up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass
class Phase:
    """Queues that all have tokens: `start` of the phase and `tokens` in it, what each queue gave before, and the rates."""

    start: int
    tokens: int
    base: list[int]
    rates: list[int]

    def __post_init__(self):
        self.total, self.top = sum(self.rates), max(range(len(self.rates)), key=self.rates.__getitem__)

    def given(self, t: int) -> list[int]:
        """Tokens that each queue gave in the first t of the phase."""
        out = [t * r // self.total for r in self.rates]
        out[self.top] += t - sum(out)
        return out


def phases(sizes: list[int], rates: list[int]) -> list[Phase]:
    """Phases until all queues are dry. A rate of 0: the queue waits until the others are dry."""
    out, base, start = [], [0] * len(sizes), 0
    while any(left := [n - b for n, b in zip(sizes, base, strict=True)]):
        now = [r if n else 0 for r, n in zip(rates, left, strict=True)]
        if not any(now):
            now = left
        phase, low, high = Phase(start, 0, base, now), 0, sum(left)
        while low < high:  # the most tokens for which no queue gives more than it has
            mid = (low + high + 1) // 2
            low, high = (mid, high) if all(g <= n for g, n in zip(phase.given(mid), left, strict=True)) else (low, mid - 1)
        if low == 0:  # less than a token each: the fullest goes alone
            k = max(range(len(left)), key=left.__getitem__)
            phase = Phase(start, 0, base, [int(i == k) for i in range(len(left))])
            low = left[k]
        phase.tokens = low
        out.append(phase)
        base = [b + g for b, g in zip(base, phase.given(low), strict=True)]
        start += low
    return out


class Layout:
    """Places runs of a queue's tokens in the packed stream."""

    def __init__(self, plan: list[Phase], window: int):
        self.plan, self.window, self.seen = plan, window, {}
        self.bases = [[p.base[s] for p in plan] for s in range(len(plan[0].base))] if plan else []

    def at(self, k: int, w: int) -> tuple[list[int], list[int]]:
        """What the queues gave before window w of phase k and before its end."""
        if (k, w) not in self.seen:
            if len(self.seen) > 4096:
                self.seen.clear()
            p = self.plan[k]
            self.seen[k, w] = p.given(min(w * self.window, p.tokens)), p.given(min((w + 1) * self.window, p.tokens))
        return self.seen[k, w]

    def runs(self, queue: int, x: int, n: int) -> Iterator[tuple[int, int]]:
        """(place, length) of the tokens x … x + n - 1 of the queue."""
        while n:
            k = bisect_right(self.bases[queue], x) - 1  # later phases in which the queue gives nothing have the same base
            while k and not self.plan[k].rates[queue]:
                k -= 1
            p = self.plan[k]
            y = x - p.base[queue]
            w = y * p.total // (p.rates[queue] * self.window)
            before, after = self.at(k, w)
            while y >= after[queue]:
                w += 1
                before, after = self.at(k, w)
            while y < before[queue]:
                w -= 1
                before, after = self.at(k, w)
            here = p.start + w * self.window + sum(b - a for a, b in zip(before[:queue], after[:queue], strict=True)) + y - before[queue]
            take = min(n, after[queue] - y)
            yield here, take
            x, n = x + take, n - take


def cuts(place: int, n: int, total: int, sequence: int) -> Iterator[tuple[int, int, int]]:
    """(sequence id, offset, length) of the tokens place … place + n - 1 of a stream of `total`."""
    whole = total // sequence
    while n:
        s = place // sequence
        if s < whole:
            at, size = s * sequence, sequence
        else:  # the tail: powers of two, the largest first
            at, s, rest = whole * sequence, whole, total - whole * sequence
            while True:
                size = 1 << (rest.bit_length() - 1)
                if place < at + size:
                    break
                at, s, rest = at + size, s + 1, rest - size
        take = min(n, at + size - place)
        yield s, place - at, take
        place, n = place + take, n - take


def tokens_of(docs: DataFrame, path: str, text: str, source: str, key: str, end_id: int, remembered: int = REMEMBERED, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, source, part, before (tokens of that source earlier in the partition), n, ids (16 or 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, count = encoder(path, None, remembered), TaskContext.get().partitionId(), defaultdict(int)
        kind = np.dtype("<u2" if len(enc.lengths) <= 1 << 16 else "<u4")
        for batch in released(batches):
            at = 0
            for texts in slices(plain(batch.column(2)), text_bytes):
                ids, offsets = enc.encode(texts)
                rows = batch.slice(at, len(texts))
                at += len(texts)
                data = np.insert(ids, offsets[1:], end_id).astype(kind)
                offsets = offsets + np.arange(len(offsets))
                sizes, before = np.diff(offsets), []
                for s, n in zip(rows.column(1).to_pylist(), sizes.tolist(), strict=True):
                    before.append(count[s])
                    count[s] += n
                packed = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * len(texts), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes), pa.array(packed, pa.binary())], names=["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


def pack(
    docs: DataFrame,
    path: str,
    *,
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    most_queues: int | None = None,
    end_id: int = 0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    remembered: int = REMEMBERED,
    text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    targets: proportions by source; None: those of the corpus. Sources not named get what they hold of the corpus.
    remembered, text_bytes: parts of words that a worker keeps, and text that it encodes at once; less memory for more time.
    """
    window, targets = sequence * window_sequences, targets or {}
    if most_queues and most_queues**2 > window:
        raise ValueError("windows must hold most_queues squared tokens at least, so that every queue's share only grows")
    coded = materialise(tokens_of(docs, path, text, source, key, end_id, remembered, text_bytes), "packing")
    parts = materialise(coded.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "packing-parts")
    sums = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    named = F.col("source").isin(list(targets)) & F.col("source").isNotNull() if targets else F.lit(False)
    top = sums.orderBy(F.desc(F.coalesce(named, F.lit(False))), F.desc("tokens"), "source")
    top = (top.limit(most_queues - 1) if most_queues else top).collect()
    if left := set(targets) - {r.source for r in top}:
        if left := [r.source for r in sums.where(F.col("source").isin(list(left))).collect()]:
            raise ValueError(f"most_queues leaves no queue to the targets of {left}")
    # every queue's share only grows if a window holds the squared number of queues
    window = max(window, -(-((len(top) + 1) ** 2) // sequence) * sequence)
    rest = (parts.agg(F.sum("tokens")).first()[0] or 0) - sum(r.tokens for r in top)
    sizes = [r.tokens for r in top] + ([rest] if rest else [])
    rates = sizes
    if targets:
        unit = sum(sizes)
        rates = [round(targets[r.source] * unit) if r.source in targets else r.tokens for r in top] + ([rest] if rest else [])
    plan, total = phases(sizes, rates), sum(sizes)
    queues = docs.sparkSession.createDataFrame([(r.source, i) for i, r in enumerate(top)], "named string, q int")
    queued = parts.join(queues, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("queue", F.coalesce("q", F.lit(len(top))))
    order = W.partitionBy("queue").orderBy("part", "source").rowsBetween(W.unboundedPreceding, -1)
    starts = queued.select("part", F.col("source").alias("of"), "queue", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("first"))
    n_starts = parts.agg(F.count("*"), F.sum(F.length("source"))).first()
    if n_starts[0] * 64 + (n_starts[1] or 0) <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    placed = coded.withColumnRenamed("part", "p").join(starts, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(plan, window)
        for batch in released(batches):
            out: list[tuple] = []
            for doc, src, q, x, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                data = ids.as_buffer()
                wide = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                at = 0
                for place, length in layout.runs(q, x, n):
                    for s, offset, size in cuts(place, length, total, sequence):
                        out.append((doc, at, size, zlib.crc32(wide[at : at + size]), n, s, offset, src))
                        at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, [pa.int64()] * 7 + [pa.string()], strict=True)], names=PIECES)

    rows = placed.select("doc_id", "source", "queue", (F.col("first") + F.col("before")).alias("x"), "n", "ids")
    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'source' else 'long'}" for c in PIECES))


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
