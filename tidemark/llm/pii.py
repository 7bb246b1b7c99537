"""Personal data: generators propose overlapping spans, boosted trees over format and context choose among them.

Base spans (e-mail, IP, card and phone patterns with their checks) always stay. Wider generators propose further spans: spelled-out or
spaced e-mail addresses, digit groups with any separators, overlapping where a run of digits may be of several kinds.

The trees learn what the base rules can't see. Base spans of the corpus are written anew in their own surroundings, in ways that no base
rule takes (`rewritten`: `user (at) host dot com`, `10-2-3-4`, `4111.1111...`, a phone number without its plus): these are positive. Negative
are the same spans broken (a wrong check digit, a part over 255, too few or too many digits), dates, sums, versions and ranges in
the same surroundings, and what the generators propose elsewhere in the corpus outside of base spans: nearly all of it is no personal data.
Proposals that first trees take for personal data all the same may be variants that nobody labelled; they are left out, and the trees trained
again. All base spans and all proposals of the corpus teach: equal ones are written anew once, and equal vectors of features are one row that weighs as much as it occurs.
A quarter of them, by the surroundings, is held back; a kind's threshold is the lowest score, from 0.5 on, with at least PRECISION on these, and `Fitted.report` has the precision and recall there. Chosen spans that touch a base span or an earlier chosen one are dropped; of
several kinds for one span the best scored one stays.

Defined results: null and empty texts have no spans; a text of any length is read whole (all patterns take linear time) and proposals are handed on in
blocks; rows with the same id, or a null one, are results of their own; where the corpus has no base spans to learn from, nothing is
added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import materialise, plain, read, released, slices

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns.
AT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:[ \t]?(?:@|\(at\)|\[at\])[ \t]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ \t]?\(dot\)[ \t]?|[ \t]?\[dot\][ \t]?|[ \t]dot[ \t])[A-Za-z0-9-]{1,63})+|[ \t]at[ \t][A-Za-z0-9-]{1,63}(?:[ \t]dot[ \t][A-Za-z0-9-]{1,63})+)",
    re.I | re.A,
)
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().,/_-]{0,3}[0-9])++(?![A-Za-z])")
#: What every text with a span of any pattern holds: an at sign, a digit, or an at spelled out.
MAY = r"(?i)[@0-9]|\(at\)|\[at\]|[ \t]at[ \t][a-z0-9-]+[ \t]dot[ \t]"
CUES = {"email": re.compile(r"mail|contact|write|@", re.I), "ip": re.compile(r"\bip\b|host|addr|server", re.I), "card": re.compile(r"card|visa|pay|credit", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax", re.I)}
# Some common ends of host names.
ENDS = frozenset("com org net edu gov int info biz io co uk de fr es it nl eu ch at us ca au jp".split())
FEATURES = 24
#: Candidates handed on at once.
BLOCK = 4096
#: Different vectors that one task has at most when trees are trained, and bins of a feature: more than its values, so that trees may cut between any two.
VECTORS, BINS = 50_000, 256
#: Letters before and after a span that `describe` looks at.
BEFORE, AFTER = 24, 2


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules: leftmost, not overlapping within a kind, without those that fail their check."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def wide_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the wider patterns; kinds overlap."""
    for m in AT.finditer(text):
        yield "email", *m.span()
    for m in NUMBER.finditer(text):
        v = m.group()
        n = sum("0" <= c <= "9" for c in v)
        groups = re.findall("[0-9]+", v)
        if len(groups) == 4 and max(map(len, groups)) <= 3:
            yield "ip", *m.span()
        if 12 <= n <= 20:
            yield "card", *m.span()
        if 7 <= n <= 15:
            yield "phone", *m.span()


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """Features of a candidate's plain form and of what stands around it."""
    v, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    groups = re.findall("[0-9]+", v)
    digits = "".join(groups)
    mail = re.sub(r"\s+", "", re.sub(r"\s*(\(at\)|\[at\]|\sat\s)\s*", "@", re.sub(r"\s*(\(dot\)|\[dot\]|\sdot\s)\s*", ".", v, flags=re.I), flags=re.I))
    local, _, domain = mail.partition("@") if kind == "email" else ("", "", "")
    last = domain.rpartition(".")[2].lower()
    between = set(re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", v))
    return [
        *(float(kind == k) for k in KINDS),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float("+" in v or v[:2] == "00"),
        float("(" in v),
        float(kind != "email" and 14 <= len(digits) <= 19 and luhn(digits)),
        float(kind != "email" and octets(groups)),
        float(len(between)),
        float(len(local)),
        float(domain.count(".")),
        float(last in ENDS),
        float(sum(c.isdigit() for c in local)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in ('"', "'", "=", "/", "#") and before != ""),
        *(float(bool(c.search(before))) for c in CUES.values()),
    ]


def untouched(base: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span from start to end touches none of the base spans."""
    ordered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in ordered], [-1, *accumulate((b for _, b in ordered), max)]
    return lambda start, end: reach[bisect_left(starts, end)] <= start


def held_back(seen: str) -> bool:
    """Whether what teaches with these surroundings is in the quarter that is held back."""
    return zlib.crc32(seen.encode()) % 4 == 0


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A head row for each row of docs (row, doc_id; kind null) and a row for each of its base spans and further candidates.

    row numbers the rows of docs; start and end are code points; around: a base span with what `describe` sees of its surroundings, and at: its place there;
    back: of a candidate that touches no base span, whether it is held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, kept = TaskContext.get().partitionId() << 33, Kept()
        for batch in released(batches):
            kept.of, done = batch.column(0).type, 0
            for texts in slices(plain(batch.column(1))):
                may = pc.match_substring_regex(texts, MAY).to_pylist()
                for i, read_it in enumerate(may):
                    doc = batch.column(0)[done + i].as_py()
                    yield from kept.add(row, doc)
                    text = texts[i].as_py() if read_it else ""
                    base = base_spans(text)
                    for kind, a, b in base:
                        left = max(0, a - BEFORE)
                        yield from kept.add(row, doc, KINDS.index(kind), a, b, True, text[left : b + AFTER], a - left)
                    known, free = set(base), untouched(base)
                    for kind, a, b in wide_spans(text):
                        if (kind, a, b) not in known:
                            back = held_back(f"{KINDS.index(kind)}{text[max(0, a - BEFORE) : b + AFTER]}") if free(a, b) else None
                            yield from kept.add(row, doc, KINDS.index(kind), a, b, False, back=back, features=describe(kind, text, a, b))
                    row += 1
                done += len(texts)
        yield from kept.rest()

    of = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"row long, doc_id {of}, kind int, start int, end int, base boolean, around string, at int, back boolean, features array<float>")


class Kept:
    """Rows of `candidates` on their way out, BLOCK at a time."""

    NAMES = ["row", "doc_id", "kind", "start", "end", "base", "around", "at", "back", "features"]

    def __init__(self):
        self.of, self.rows, self.features = pa.int64(), [], []

    def add(self, row: int, doc, kind=None, start=None, end=None, base=None, around=None, at=None, back=None, features=()) -> Iterator[pa.RecordBatch]:
        self.rows.append((row, doc, kind, start, end, base, around, at, back))
        self.features.append(features)
        if len(self.rows) >= BLOCK:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            types = [pa.int64(), self.of, *[pa.int32()] * 3, pa.bool_(), pa.string(), pa.int32(), pa.bool_()]
            sizes = np.concatenate([[0], np.cumsum([len(f) for f in self.features])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.array([x for f in self.features for x in f], np.float32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)), lists], names=self.NAMES)
            self.rows, self.features = [], []


def rewritten(kind: str, value: str, pick: random.Random) -> Iterator[tuple[str, bool]]:
    """The value of a base span in forms that no base rule takes, and whether it is still what it was: variants, broken ones, other numbers."""
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        for at, dot in pick.sample([(" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"), (" [at] ", ".")], 2):
            yield local + at + dot.join(labels), True
        yield f"{local} at {labels[0]} dot {pick.choice(['them', 'five', 'lines', 'point', 'here', 'we'])}", False
        yield f"{local} @ {pick.randint(1, 99)}.{pick.randint(10, 99)}", False
        return
    groups = re.findall("[0-9]+", value)
    digits = "".join(groups)
    if kind == "ip":
        for mark in pick.sample(["-", "_", " . ", "(.)", ", ", " - "], 2):
            yield mark.join(groups), True
        broken = list(groups)
        broken[pick.randrange(4)] = str(pick.randint(256, 999))
        yield pick.choice(["-", "_", " . ", "."]).join(broken), False
    if kind == "card":
        parts = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        for mark in pick.sample([".", "/", "_", " - ", ", ", "  "], 2):
            yield mark.join(parts), True
        i = pick.randrange(len(digits))
        broken = digits[:i] + str((int(digits[i]) + pick.randint(1, 9)) % 10) + digits[i + 1 :]
        yield pick.choice([".", "/", "_", " - ", " ", ""]).join(broken[i : i + 4] for i in range(0, len(broken), 4)), False
    if kind == "phone":
        land, rest = (digits[:-10], digits[-10:]) if len(digits) > 10 else ("", digits)
        a, b, c = rest[:3], rest[3:6], rest[6:]
        for form in pick.sample([f"{land} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"00{land or 1} {a} {b} {c}", f"{land}.{a}.{b}.{c}".strip("."), f"({a}) {b} {c}", f"{a}-{b}-{c}"], 2):
            yield form.strip(), True
        yield digits + "".join(str(pick.randint(0, 9)) for _ in range(16 - len(digits))), False
    n = pick.randint
    yield pick.choice([f"{n(1, 28):02}/{n(1, 12):02}/{n(1900, 2099)}", f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2099)}"]), False
    yield pick.choice([f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(1000, 99999)}.{n(100, 9999)}", f"{n(1900, 1999)}-{n(2000, 2099)}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 20)}.{n(256, 9999)}", str(n(10**6, 10**12))]), False


def lessons(spans: pd.DataFrame) -> pd.DataFrame:
    """Labelled candidates (kind, label, back, features, n) made of base spans in their surroundings, which occur n times."""
    out = []
    for k, around, at, size, n in spans.itertuples(index=False):
        kind, seed, back = KINDS[k], zlib.crc32(f"{k}{around}".encode()), held_back(f"{k}{around}")
        for value, good in rewritten(kind, around[at : at + size], random.Random(seed)):
            text = around[:at] + value + around[at + size :]
            for other, a, b in wide_spans(text):
                if a < at + len(value) and at < b:
                    label = int(good and other == kind and (a, b) == (at, at + len(value)))
                    out.append((KINDS.index(other), label, back, describe(other, text, a, b), n))
    return pd.DataFrame(out, columns=["kind", "label", "back", "features", "n"])


@dataclass
class Fitted:
    """What adds `score` to candidates, the kinds' thresholds, and on candidates held back: kind, precision, recall, positives."""

    scored: Callable[[DataFrame], DataFrame]
    thresholds: dict[int, float]
    report: list[tuple[str, float, float, int]]


def fit(found: DataFrame) -> Fitted | None:
    """The trees and thresholds, learned from all `candidates`; None: no base spans to learn from."""
    spark = found.sparkSession
    base = found.where("base").groupBy("kind", "around", "at", (F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("n"))
    base = base.repartition(max(1, spark.sparkContext.defaultParallelism), "kind", "around", "at", "size")
    made = base.mapInPandas(lambda parts: map(lessons, parts), "kind int, label int, back boolean, features array<float>, n long")
    seen = found.where("back is not null").select("kind", F.lit(None).cast("int").alias("label"), "back", "features", F.lit(1).cast("long").alias("n"))
    table = materialise(made.union(seen).groupBy("kind", "label", "back", "features").agg(F.sum("n").alias("n")), "pii-lessons")
    # always the same table, whatever the partitions of the texts
    table = materialise(table.repartition(1 + table.count() // VECTORS, "features").sortWithinPartitions("kind", "label", "back", "features"), "pii-train")
    label = F.coalesce("label", F.lit(0)).alias("label")

    def trained(rows: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
        rows = rows.where("not back").select(label, array_to_vector("features").alias("vector"), F.col("n").cast("double").alias("weight"))
        if rows.agg(F.countDistinct("label")).first()[0] < 2:
            return None
        trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxBins=BINS, maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(rows)
        return lambda rows: trees.transform(rows.withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])

    if not (first := trained(table)):
        return None
    # proposals of the corpus that look like variants all the same may be such, so they teach nothing
    table = materialise(first(table).where("label is not null or score < 0.5").select(table.columns), "pii-train")
    scored = trained(table)
    held = scored(table.where("back")).select("kind", label, F.floor(F.col("score") * 100).alias("bin"), "n").groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    thresholds, report = {}, []
    for k, name in enumerate(KINDS):
        good = n = 0
        mine = sorted((r for r in held if r.kind == k), key=lambda r: -r.bin)
        all_good, thresholds[k], best = sum(r.good for r in mine), 2.0, (1.0, 0.0)
        for r, below in zip(mine, [*(x.bin for x in mine[1:]), 0], strict=False):
            good, n = good + r.good, n + r.n
            if good >= PRECISION * n and r.bin >= 50:
                # between what is taken and what comes next
                thresholds[k], best = max(50, (r.bin + below + 1) / 2) / 100, (good / n, good / max(all_good, 1))
        report.append((name, *best, all_good))
    return Fitted(scored, thresholds, report)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of struct(start, kind, end), by start and kind; one row per row of docs."""
    rows = materialise(candidates(docs, key, text), "pii-candidates")
    kept = rows.where("kind is null or base").withColumn("score", F.lit(1.0))
    if fitted := fit(rows):
        least = F.element_at(F.create_map(*(F.lit(x) for kv in fitted.thresholds.items() for x in kv)), F.col("kind"))
        kept = kept.unionByName(fitted.scored(rows.where("not base")).where(F.col("score") >= least).select(kept.columns))
    ranked = F.struct("start", (-F.col("score")).alias("worth"), "kind", "end")
    spans = lambda base, *more: F.sort_array(F.collect_list(F.when(F.col("base") == base, F.struct("start", *more, "kind", "end"))))
    by_row = kept.groupBy("row", "doc_id").agg(spans(True).alias("base"), spans(False, (-F.col("score")).alias("worth")).alias("more"))
    return by_row.select("doc_id", "base", settled("base", "more").alias("spans"))


def chosen(base: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The base spans and, from left to right, those of `more` that touch none of them nor the last chosen one; columns start, kind, end; both by start."""
    reach = np.maximum.accumulate(np.append(-1, base[:, 2]))
    free = more[reach[np.searchsorted(base[:, 0], more[:, 2])] <= more[:, 0]]
    keep, last = [], -1
    for i, (start, end) in enumerate(zip(free[:, 0].tolist(), free[:, 2].tolist(), strict=True)):
        if start >= last:
            keep.append(i)
            last = end
    out = np.concatenate([base, free[keep]])
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def settled(base: Column | str, more: Column | str) -> Column:
    """Column of the spans that stay, by start and kind."""

    @F.arrow_udf("array<struct<start:int,kind:int,end:int>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = lambda lists: np.stack([lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "kind", "end")], 1)
        for base, more in released(batches):
            sizes, n_more = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (base, more))
            b, m = table(base), table(more)
            b_at, m_at = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, n_more))
            parts, done = [], 0
            for i in np.flatnonzero(n_more).tolist():
                parts += [b[b_at[done] : b_at[i]], chosen(b[b_at[i] : b_at[i + 1]], m[m_at[i] : m_at[i + 1]])]
                sizes[i], done = len(parts[-1]), i + 1
            out = np.concatenate([*parts, b[b_at[done] :]]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["start", "kind", "end"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    return of.asNondeterministic()(base, more)


def written(spans: Column | str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column | str, spans: Column | str) -> Column:
    """The text with every span, given as `written`, replaced by its kind in angle brackets; overlapping spans become one."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text is not None and s:
                parts, done = [], 0
                for item in s.split(","):
                    kind, a, b = item.split(":")
                    if int(b) > done:
                        if int(a) >= done:
                            parts.append(f"{text[done : int(a)]}<{kind.upper()}>")
                        done = int(b)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return redacted(text, spans)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
