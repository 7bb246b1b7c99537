"""N-gram Jaccard join: count vectors in R-trees, bounded by summed coordinate minima, surviving pairs verified.

A document is the set of its distinct word n-grams (64-bit hashes). Equal sets are one node.

1. Addresses. The hash space is cut into groups; two sets of similar size that link differ in at most d n-grams, so of more than
   d groups some hold the very same n-grams in both. With K = d + 1 + slack groups K - d agree at least, and so (prefix
   filter) one of the d + 1 fullest groups of either set does. A set is put under the hashes of those groups' contents. This is the
   tree's directory: a plain R-tree over the counts prunes next to nothing above its leaves, as counts of many groups hardly
   differ in any one coordinate. Places with the same members are one place.
2. R-trees. At each place the count vectors are tiled into an R-tree (sorted by size, then by their first coordinates): leaves of LEAF points under
   nodes of FAN children, which keep their coordinates' maxima and their smallest and largest size. A search goes down from the root where the summed
   minima of the coordinates, a bound of the overlap from above, and the sizes allow a link; points that were met are taken out of all nodes above
   them, so a breadth-first search gives a spanning forest of the pairs that the bound leaves, never all pairs.
3. Verification. Sets in one tree of that forest are compared exactly, again breadth first: what remains is a
   spanning forest of the true links. Its components are those of all links.

Places and trees of more than a fixed number of rows are cut into blocks, so memory is bounded. First each block is searched by itself, with two rows
that go to all blocks of the group; so a group of near copies becomes one part at once. Then the rows outside the group's largest part meet all
blocks. Rows that are joined already needn't be compared, so no link between parts is lost, and a hot group isn't repeated for each of its blocks.
No pair of a group is emitted beyond a forest's edges.

Defined results: null, empty or wordless texts have no set, link with nothing and are their own component; with fewer words than n, the
whole sequence is the only n-gram; repeated documents share a component; ids are integers, and a repeated id stands for each of its texts: its rows have the
components of their own texts; a null id links like any other, and a component of null ids alone is null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import binaries, materialise, mix, plain, read, released, slices, words_of
from tidemark.llm.components import components

N_WORDS = 4
PERCENT = 85
#: Coordinates of a count vector.
GROUPS = 64
#: Of the two halves of a set's 128-bit hash.
SALTS = (11, 23)
#: Sizes of a class grow by this factor from its smallest to its largest.
CLASS_RATIO = 1.5
#: Points of a leaf, and children of an inner node.
LEAF, FAN = 32, 16
#: Rows at a place, and n-grams in a tree, up to which one task takes them; beyond, blocks.
PLACE_ROWS, TREE_GRAMS = 10_000, 3_000_000
#: Rows of the table of compared documents (some 80 bytes each) up to which it is broadcast.
BROADCAST_IDS = 500_000


def grams(texts: pa.Array, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and the texts' offsets."""
    word, vocab, at = words_of(texts, lower=True)
    h = pd.util.hash_array(vocab.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)[word] if len(word) else np.zeros(0, np.uint64)
    count = np.diff(at)
    first, width = np.where(count >= n, count - n + 1, count > 0), np.minimum(count, n)
    starts = np.repeat(at[:-1], first) + np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
    left = np.repeat(width, first)
    key = mix(h[starts]) if len(starts) else np.zeros(0, np.uint64)
    for k in range(1, n):
        more = left > k
        key[more] = mix(key[more] + h[starts[more] + k])
    offsets = np.concatenate([[0], np.cumsum(first)])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        key[a:b].sort()
    owner = np.repeat(np.arange(len(count)), first)
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(count)))])


def size_classes(most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each class, the most n-grams in which its pairs differ (by the smaller set), and its groups."""
    low, differ = [1], []
    while low[-1] <= most:
        high = int(low[-1] * CLASS_RATIO)
        differ.append(high * (100 - percent) // percent)
        low.append(high + 1)
    d = np.array(differ)
    return np.array(low[:-1]), d, d + 1 + np.ceil(0.15 * d).astype(int) * (d > 0)


def places(key: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the groups under which each set is put, and the sets' offsets."""
    n = np.diff(offsets)
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low, differ, groups = size_classes(int(n.max()), percent)
    own = np.searchsorted(low, n, "right") - 1
    smaller = np.searchsorted(low, np.maximum(-(-n * percent // 100), 1), "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    content, owner = mix(key), np.repeat(np.arange(len(n)), n)
    for back in range(int((own - smaller).max()) + 1):
        use = (n > 0) & (own - back >= smaller)
        c = np.where(use, own - back, 0)
        rows = use[owner]
        k, who = groups[c], owner[rows]
        g = ((key[rows] >> np.uint64(32)) * k[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot_at = np.cumsum(np.where(use, k, 0)) - np.where(use, k, 0)
        slot = slot_at[who] + g
        total = int(np.where(use, k, 0).sum())
        size = np.bincount(slot, minlength=total)
        summed = np.zeros(total, np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        if len(edge):
            summed[slot[edge]] = np.add.reduceat(content[rows], edge)
        of = np.repeat(np.arange(len(n)), np.where(use, k, 0))
        number = np.arange(total) - slot_at[of]
        sig = mix(mix(summed + mix(number.astype(np.uint64))) + c[of].astype(np.uint64))
        order = np.lexsort((sig, -size, of))
        kept = order[(np.arange(total) - slot_at[of]) <= differ[c][of]]
        out.append((of[kept], sig[kept]))
    of, sig = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.argsort(of, kind="stable")
    return sig[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))])


def counts(key: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Count vectors: how many n-grams of each set fall in each of the groups."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(owner * GROUPS + (key >> np.uint64(58)).astype(np.int64), minlength=(len(offsets) - 1) * GROUPS).reshape(-1, GROUPS)


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap with which sets of a and b n-grams link."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Count vectors in leaves of LEAF points under inner nodes of FAN children; every node keeps its coordinates' maxima, its sizes' range and what is open."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        lead = np.argsort(-points.var(0), kind="stable")[:2]
        tile = max(1, int(math.sqrt(len(points) / LEAF)) * LEAF)
        by_size = np.argsort(sizes, kind="stable")
        rank = np.empty(len(points), np.int64)
        rank[by_size] = np.arange(len(points)) // tile
        self.order = np.lexsort((points[:, lead[1]], points[:, lead[0]], rank))
        self.points, self.sizes, self.percent = points[self.order].astype(np.int32), sizes[self.order], percent
        self.open = np.ones(len(points), bool)
        #: From the leaves up: points under a node, maxima, smallest and largest sizes, open points.
        self.levels = []
        width, high, least, most, left = 1, self.points, self.sizes, self.sizes, self.open.astype(np.int64)
        while not self.levels or len(high) > FAN:
            step = FAN if self.levels else LEAF
            edge = np.arange(0, len(high), step)
            width *= step
            high, least, most, left = (f.reduceat(x, edge) for f, x in ((np.maximum, high), (np.minimum, least), (np.maximum, most), (np.add, left)))
            self.levels.append((width, high, least, most, left))
        #: Nodes and points compared so far.
        self.compared = [0, 0]

    def take(self, at: np.ndarray) -> None:
        self.open[at] = False
        for width, *_, left in self.levels:
            np.subtract.at(left, at // width, 1)

    def near(self, at: int) -> np.ndarray:
        """Open points that the bound doesn't tell from the point."""
        p, n = self.points[at], self.sizes[at]
        nodes = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            _, high, least, most, left = self.levels[k]
            nodes = nodes[(left[nodes] > 0) & (self.percent * least[nodes] <= 100 * n) & (100 * most[nodes] >= self.percent * n)]
            self.compared[0] += len(nodes)
            nodes = nodes[np.minimum(high[nodes], p).sum(1) >= need(n, least[nodes], self.percent)]
            step, below = (FAN, len(self.levels[k - 1][1])) if k else (LEAF, len(self.points))
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        rows = nodes[self.open[nodes]]
        self.compared[1] += len(rows)
        return rows[np.minimum(self.points[rows], p).sum(1) >= need(n, self.sizes[rows], self.percent)]


def forest(points: np.ndarray, sizes: np.ndarray, percent: int, linked=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within the bound (and linked, if asked). What fits in a leaf needs no tree."""
    if len(points) <= LEAF:
        near = np.minimum(points[:, None], points[None]).sum(2) >= need(sizes[:, None], sizes[None], percent)
        open_, edges = np.ones(len(points), bool), []
        for seed in range(len(points)):
            stack, open_[seed] = ([seed] if open_[seed] else []), False
            while stack:
                at = stack.pop()
                found = np.flatnonzero(near[at] & open_)
                if linked and len(found):
                    found = found[linked(at, found)]
                open_[found] = False
                stack += found.tolist()
                edges += [(at, x) for x in found.tolist()]
        return edges
    tree, edges = RTree(points, sizes, percent), []
    for seed in range(len(points)):
        if not tree.open[seed]:
            continue
        tree.take(np.array([seed]))
        stack = [seed]
        while stack:
            at = stack.pop()
            if len(found := tree.near(at)):
                if linked:
                    found = found[linked(int(tree.order[at]), tree.order[found])]
                tree.take(found)
                stack += found.tolist()
                edges += [(int(tree.order[at]), x) for x in tree.order[found].tolist()]
    return edges


def named(key: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set."""
    s = np.zeros(len(key) + 1, np.uint64)  # sums wrap around
    np.cumsum(mix(key + np.uint64(salt)), out=s[1:])
    return mix(s[at[1:]] - s[at[:-1]] + np.diff(at).astype(np.uint64)).astype(np.int64)


def features(text: Column | str, n: int = N_WORDS, percent: int = PERCENT) -> Column:
    """Column of struct(n, k1, k2: the set's 128-bit hash, vector, places)."""

    @F.arrow_udf("struct<n:bigint,k1:bigint,k2:bigint,vector:binary,places:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        put: set[int] = set()  # sets that this task has put in their places: copies needn't be put there again
        for batch in released(batches):
            out = []
            for part in slices(plain(batch)):
                key, at = grams(part, n)
                size = np.diff(at)
                owner = np.repeat(np.arange(len(part)), size)
                sums = [named(key, at, salt) for salt in SALTS]
                if len(put) > 500_000:
                    put.clear()
                new = np.zeros(len(part), bool)
                for i, k in enumerate(sums[0].tolist()):
                    if size[i] and k not in put:
                        put.add(k)
                        new[i] = True
                sig, sig_at = places(key[new[owner]], np.concatenate([[0], np.cumsum(np.where(new, size, 0))]), percent)
                vector = counts(key, at).astype("<u4")
                cols = [pa.array(size), pa.array(sums[0]), pa.array(sums[1]), binaries(vector.ravel(), np.arange(len(part) + 1) * GROUPS).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(sig_at.astype(np.int32)), pa.array(sig.astype(np.int64)))]
                out.append(pa.StructArray.from_arrays(cols, ["n", "k1", "k2", "vector", "places"]))
            kind = pa.struct([("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("vector", pa.binary()), ("places", pa.list_(pa.int64()))])
            yield pa.chunked_array(out, kind).combine_chunks() if out else pa.array([], kind)

    return of.asNondeterministic()(text)


def sets_of(text: Column | str, n: int = N_WORDS) -> Column:
    """Column of struct(k1: the first half of the set's hash, grams: the sorted 64-bit hashes of the text's n-grams)."""

    @F.arrow_udf("struct<k1:bigint,grams:binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            sets, names = [], [np.zeros(0, np.int64)]
            for part in slices(plain(batch)):
                key, at = grams(part, n)
                sets.append(binaries(key, at))
                names.append(named(key, at, SALTS[0]))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(names)), pa.chunked_array(sets, pa.large_binary()).combine_chunks().cast(pa.binary())], ["k1", "grams"])

    return of.asNondeterministic()(text)


@dataclass
class Blocks:
    """Groups of more than `most` weight: into how many blocks each is cut, and its two outermost rows, which go to all of its blocks."""

    group: str
    weight: str
    most: int
    large: DataFrame
    n_large: int

    @staticmethod
    def of(rows: DataFrame, group: str, weight: str, most: int) -> Blocks:
        sums = rows.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("long").alias("n_blocks"), F.min("k1").alias("low"), F.max("k1").alias("high"))
        large = materialise(sums.where("n_blocks > 1"), "jaccard-large")
        return Blocks(group, weight, most, hinted(large, n := large.count()), n)

    def first(self, rows: DataFrame) -> DataFrame:
        """The rows with `pieces`: the block of each. A group up to `most` is one block."""
        if not self.n_large:
            return rows.withColumn("pieces", F.array(F.lit(0).cast("long")))
        outer = F.when((F.col("k1") == F.col("low")) | (F.col("k1") == F.col("high")), F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
        own = F.array(F.pmod(F.xxhash64("k1"), F.coalesce("n_blocks", F.lit(1).cast("long"))))
        return rows.join(self.large, self.group, "left").withColumn("pieces", F.coalesce(outer, own)).drop("n_blocks", "low", "high")

    def rest(self, rows: DataFrame, edges: DataFrame) -> DataFrame | None:
        """Rows of the large groups with the `pieces` in which each row outside its group's largest part, as the edges join them, meets every other row.

        Rows of the largest part are joined already and needn't meet, so they are repeated only as often as there are blocks of others.
        """
        if not self.n_large:
            return None
        parts = components(edges).withColumnRenamed("node", "k1")
        mine = rows.join(self.large.select(self.group), self.group).join(parts, "k1", "left").withColumn("part", F.coalesce("component", "k1")).drop("component")
        sums = mine.groupBy(self.group, "part").agg(F.sum(self.weight).alias("w"))
        top = sums.groupBy(self.group).agg(F.max_by("part", F.struct("w", "part")).alias("largest"), F.max("w").alias("inner"), (F.sum("w") - F.max("w")).alias("outer"))
        top = materialise(top.where("outer > 0").select(self.group, "largest", *(F.ceil(F.col(c) / self.most).cast("long").alias(c) for c in ("inner", "outer"))), "jaccard-rest")
        if not (n := top.count()):
            return None
        h, n_blocks, is_outer = F.xxhash64("k1"), F.col("inner") + F.col("outer"), F.col("part") != F.col("largest")
        block = F.when(is_outer, F.pmod(h, "outer")).otherwise(F.col("outer") + F.pmod(h, "inner"))
        others = F.sequence(F.lit(0).cast("long"), F.when(is_outer, n_blocks).otherwise(F.col("outer")) - 1)
        pieces = F.transform(others, lambda j: F.least(block, j) * n_blocks + F.greatest(block, j))
        return mine.join(hinted(top, n), self.group).withColumn("pieces", pieces).drop("part", "largest", "inner", "outer")


def hinted(rows: DataFrame, n: int) -> DataFrame:
    """The rows, with a broadcast hint if they are few."""
    return F.broadcast(rows) if n <= BROADCAST_IDS else rows


def dealt(rows: DataFrame, group: str):
    """The rows by group and piece, in as many tasks as shuffles have: these groups cost time rather than bytes, so tasks aren't joined by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("piece", F.explode("pieces")).repartition(n, group, "piece").groupBy(group, "piece")


def edges_of(k: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"u": k[at[:, 0]], "v": k[at[:, 1]]})


def bound_edges(rows: pa.Table, percent: int) -> pa.Table:
    k, first = np.unique(rows["k1"].to_numpy(), return_index=True)
    points = np.frombuffer(b"".join(rows["vector"].to_pylist()), "<u4").reshape(-1, GROUPS)[first].astype(np.int32)
    return edges_of(k, forest(points, rows["n"].to_numpy()[first], percent))


def true_edges(rows: pa.Table, percent: int) -> pa.Table:
    k, first = np.unique(rows["k1"].to_numpy(), return_index=True)
    n = rows["n"].to_numpy()[first]
    sets = [np.frombuffer(rows["grams"][i].as_py(), "<u8") for i in first.tolist()]
    points = counts(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))

    def linked(a: int, others: np.ndarray) -> np.ndarray:
        mine, out = sets[a], np.zeros(len(others), bool)
        for i, b in enumerate(others.tolist()):
            theirs = sets[b]
            where = np.searchsorted(mine, theirs)
            where[where == len(mine)] = 0
            same = int((mine[where] == theirs).sum())
            out[i] = 100 * same >= percent * (len(mine) + len(theirs) - same)
        return out

    return edges_of(k, forest(points, n, percent, linked))


def both(rows: DataFrame, group: str, weight: str, most: int, edges: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Edges found within the blocks of all groups and, if groups have several, those of what is left outside their largest parts."""
    cut = Blocks.of(rows, group, weight, most)
    found = edges(cut.first(rows))
    if not cut.n_large:
        return found
    found = materialise(found, name)
    rest = cut.rest(rows, found)
    return found if rest is None else found.union(edges(rest))


def link_components(docs: DataFrame, *, n: int = N_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    of = materialise(source.select("doc_id", features("text", n, percent).alias("f")).select("doc_id", "f.*"), "jaccard-features")
    some = of.where("n > 0")
    nodes = materialise(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first")), "jaccard-nodes")

    put = some.select(F.explode("places").alias("place"), "k1")
    # a place's members by four aggregates: partly aggregated before the shuffle, so that no task gathers a place
    sums = [f(F.xxhash64("k1", F.lit(s)) % 4_000_000_007 if s else F.col("k1")).alias(c) for c, f, s in (("low", F.min, 0), ("high", F.max, 0), ("s1", F.sum, 1), ("s2", F.sum, 2))]
    shared = put.groupBy("place").agg(*sums).where("low <> high").select(F.col("place").alias("at"), F.xxhash64("low", "high", "s1", "s2").alias("members"))
    members = put.join(shared, F.col("place") == F.col("at")).select(F.col("members").alias("place"), "k1").distinct()
    mine = nodes.select(F.col("first").alias("id"), F.col("k1").alias("set"))
    vectors = some.join(mine, (F.col("k1") == F.col("set")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("k1", "n", "vector")
    rows = materialise(members.join(vectors, "k1"), "jaccard-places")

    def near(put: DataFrame) -> DataFrame:
        return dealt(put, "place").applyInArrow(lambda x: bound_edges(x, percent), "u long, v long")

    wanted = both(rows.withColumn("one", F.lit(1)), "place", "one", PLACE_ROWS, near, "jaccard-near")
    trees = materialise(components(wanted), "jaccard-trees")
    members = trees.join(nodes.select(F.col("k1").alias("node"), "first", "n"), "node")
    members = materialise(members.select(F.col("first").alias("doc_id"), F.col("node").alias("k1"), "n", F.col("component").alias("tree")), "jaccard-wanted")

    def verified(put: DataFrame) -> DataFrame:
        put = materialise(put, "jaccard-pieces")
        # an id may stand for other texts too, so a text's own hash must be the wanted one
        wanted = hinted(put.select(F.col("doc_id").alias("id"), "k1", "n", "tree", "pieces"), put.count())
        sets = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("k1", "n", "tree", "pieces", sets_of("text", n).alias("s"))
        sets = sets.where(F.col("s.k1") == F.col("k1")).select("k1", "n", "tree", "pieces", "s.grams")
        return dealt(sets, "tree").applyInArrow(lambda x: true_edges(x, percent), "u long, v long")

    true = both(members, "tree", "n", TREE_GRAMS, verified, "jaccard-true")
    parts = materialise(components(true), "jaccard-components")
    of_node = nodes.join(parts, nodes.k1 == parts.node, "left").select("k1", "k2", "first", F.coalesce("component", "k1").alias("part"))
    least = of_node.groupBy("part").agg(F.min("first").alias("component_id"))
    names = of_node.join(least, "part").select(F.col("k1").alias("a"), F.col("k2").alias("b"), "component_id")
    linked = some.join(names, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(of.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM docs
),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT reach.doc_id, any_value(n_shingles) AS n_shingles, min(other) AS component_id
FROM reach JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
ORACLE = {"op9_ngram_jaccard": SQL}
