"""Media columns: local image descriptors find cropped or edited copies.

An image is a row of grey bytes with its height and width. Corners are the local maxima of a Harris response at SCALES (the
strongest of each scale describe an image, more for larger ones); the intensity centroid around a corner gives its angle, and BITS
binary comparisons of smoothed points, turned by that angle, its descriptor. The compared points lie all over the patch but near each other, so
that the bits say more than the patch's slope, and images are told apart.

Hamming tables: each of TABLES tables picks WORD_BITS of a descriptor's bits, and the descriptor stands there under their values. Queries' and images'
descriptors that meet in a table (a pair counts in its first table only) are compared as a whole, by exclusive or and
bit counts, and match if at most NEAR_BITS bits apart. Two descriptors d bits apart meet with a chance of 1 - (1 - (1 - d / BITS) ** WORD_BITS) ** TABLES: 0.99 at
12 bits, 0.92 at 20, 0.77 at 25; an image's search needs a few of its corners only. A query finds an image if at least VOTES of their corners, and SHARE of the corners of the image with fewer, agree on one turn, scale and shift.

Rows with the same bytes are one image, and one query; their rows all come back by membership. Most corners that match do so by chance, alone in their two images, and their number grows with queries times images.
So tables are not joined by word: images are dealt to blocks of whole images, each block meets each block of queries, and a task builds the tables of its two blocks. All matches of two images are there, and only the hits leave it.
What it holds is bounded by the blocks and COMPARED; comparing still grows with queries times images. The queries' blocks are broadcast while their tables have at most BROADCAST_POSTINGS rows, counted beforehand; beyond, Spark
pairs the partitions of both sides. No word, image or query is left out.

Defined results: null, empty or too small images, images whose bytes don't fill height x width, and images without corners have no
descriptors and are found by nothing; repeated rows are all found; an id with several images has the hits of each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import materialise, read, released, spread

CORNERS, BITS, WORDS = 24, 256, 4
RADIUS, SCALES = 8, (1.4, 2, 2.8, 4)
#: Pixels between the compared points at most.
APART = 6
#: Tables, and the bits of a descriptor, picked by SEED, that are its word in each.
TABLES, WORD_BITS = 16, 24
#: Bits by which descriptors of the same corner may differ.
NEAR_BITS = 25
#: Corners that must agree, as a number and as a share of the corners of the image with fewer, and within how many pixels.
VOTES, SHARE, CELL = 4, 0.1, 2
#: How far the matches that fit one proposal may be off it: in angle, log of the scale, and place (as a part of the distance).
TURN, STRETCH, SLACK = 0.12, 0.2, 0.12
SEED = 99
ANGLES = 64
#: An image has one corner a scale more than CORNERS for each so many pixels beyond CORNERS times as many.
PIXELS = 216
#: Proposals times matches of two images that are worked on at once.
PROPOSALS = 1 << 20
#: Rows of the queries' tables (some 80 bytes each) up to which they are broadcast.
BROADCAST_POSTINGS = 500_000
#: Corners in a block of images, and in one of queries, about.
IMAGES_BLOCK, QUERIES_BLOCK = 8192, 16384
#: Pairs of corners that meet in a table which are compared at once, and corners of a block's images whose matches are held at once.
COMPARED, HELD = 1 << 19, 256


def pattern() -> np.ndarray:
    """Pairs of points within the patch, at most APART pixels from each other, turned by each angle: (angle, bit, end, y and x)."""
    rng = np.random.default_rng(SEED)
    angle, reach = rng.uniform(0, 2 * np.pi, (16 * BITS, 2)), 0.93 * RADIUS * np.sqrt(rng.uniform(0, 1, (16 * BITS, 2)))
    points = np.stack([reach * np.sin(angle), reach * np.cos(angle)], -1)
    points = points[np.linalg.norm(points[:, 0] - points[:, 1], axis=1) < APART][:BITS]
    turn = 2 * np.pi * np.arange(ANGLES) / ANGLES
    spin = np.stack([np.stack([np.cos(turn), np.sin(turn)], -1), np.stack([-np.sin(turn), np.cos(turn)], -1)], -2)
    return np.rint(np.einsum("aij,bej->abei", spin, points)).astype(int)


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r + 1 pixels; the outermost ones are zero."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    k = 2 * r + 1
    out = np.zeros(x.shape)
    if min(x.shape) >= k:
        out[r : x.shape[0] - r, r : x.shape[1] - r] = s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]
    return out


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the strongest corners whose patch lies within the image."""
    gy, gx = np.gradient(x)
    a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = np.zeros(x.shape, bool)
    inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
    peak = inner & (r > 1e-6 * max(float(r.max(initial=0)), 1.0))
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                peak &= r >= np.roll(r, (dy, dx), (0, 1))
    y, x_ = np.nonzero(peak)
    best = np.argsort(-r[y, x_], kind="stable")[: max(CORNERS, x.size // PIXELS)]
    return y[best], x_[best]


def shrunk(image: np.ndarray, scale: float) -> np.ndarray:
    """The image in pixels `scale` times as wide: means of whole squares, or else between the nearest four points of a smoothed one."""
    if scale == int(scale):
        k = int(scale)
        h, w = image.shape[0] // k * k, image.shape[1] // k * k
        return image[:h, :w].reshape(h // k, k, w // k, k).mean((1, 3))
    y, x = ((np.arange(int(n / scale)) + 0.5) * scale - 0.5 for n in image.shape)
    if not len(y) or not len(x) or min(image.shape) < 3:
        return np.zeros((0, 0))
    padded = np.pad(image, 1, "edge")
    rows = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
    soft = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4
    i, j = (np.clip(c.astype(int), 0, n - 2) for c, n in zip((y, x), image.shape, strict=True))
    fy, fx = (y - i)[:, None], (x - j)[None]
    low, high = soft[i], soft[i + 1]
    return (low[:, j] * (1 - fx) + low[:, j + 1] * fx) * (1 - fy) + (high[:, j] * (1 - fx) + high[:, j + 1] * fx) * fy


def describe(image: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column, scale, angle) and descriptor words of an image's corners, in pixels of the image itself."""
    out, (v, u) = [(np.zeros((0, 4), "<f4"), np.zeros((0, WORDS), "<u8"))], np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = v * v + u * u <= RADIUS * RADIUS
    for scale in SCALES:
        x = shrunk(image, scale)
        if min(x.shape) < 2 * RADIUS + 4:
            continue
        smooth = box(x, 2)
        ys, xs = corners(x)
        if not len(ys):
            continue
        patch = x[ys[:, None, None] + v, xs[:, None, None] + u] * disc
        angle = np.arctan2((patch * v).sum((1, 2)), (patch * u).sum((1, 2)))
        at = tests[np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES]
        first, second = (smooth[ys[:, None] + at[:, :, e, 0], xs[:, None] + at[:, :, e, 1]] for e in (0, 1))
        bits = np.packbits(first < second, axis=1).view("<u8")
        middle = (scale - 1) / 2
        out.append((np.stack([ys * scale + middle, xs * scale + middle, np.full(len(ys), scale), angle], 1).astype("<f4"), bits))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


CORNER = "y:float,x:float,scale:float,angle:float,w0:bigint,w1:bigint,w2:bigint,w3:bigint"


def descriptors(image: Column | str, height: Column | str, width: Column | str) -> Column:
    """Column of array<struct(y, x, scale, angle, w0 ... w3)>: the corners and their descriptors."""
    names = [c.split(":")[0] for c in CORNER.split(",")]

    @F.arrow_udf(f"array<struct<{CORNER}>>")
    def described(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tests = pattern()
        for images, heights, widths in released(batches):
            sizes, places, words = [0], [np.zeros((0, 4), "<f4")], [np.zeros((0, WORDS), "<u8")]
            for data, h, w in zip(images, heights, widths, strict=True):
                data, h, w = data.as_py(), h.as_py(), w.as_py()
                if data and h and w and len(data) == h * w:
                    at, bits = describe(np.frombuffer(data, np.uint8).reshape(h, w).astype(float), tests)
                    places.append(at)
                    words.append(bits)
                    sizes.append(sizes[-1] + len(bits))
                else:
                    sizes.append(sizes[-1])
            at, bits = np.concatenate(places), np.concatenate(words).view("<i8")
            columns = [pa.array(np.ascontiguousarray(at[:, k])) for k in range(4)] + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return described.asNondeterministic()(image, height, width)


def distinct(ok: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row of flags, how many values of `of` have a set flag."""
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    return np.logical_or.reduceat(ok[:, order], starts, axis=1).sum(1)


def agree(qi: np.ndarray, gi: np.ndarray, q: np.ndarray, g: np.ndarray, votes: int) -> tuple[int, float, float, float, float, float, float] | None:
    """(votes, scale, angle, y, x, dy, dx) of the turn, scale and shift on which most matched corners of two images agree; None: fewer than votes.

    qi, gi: the matches' corners; q, g: their rows, columns, scales and angles. Every match proposes what its own corners say; those that roughly
    agree fit it by least squares, and those within CELL of the fit count. The last fit weighs matches by the sharpness of their corners (a corner's
    place is as sure as a pixel of its scale); (y, x) is the matches' centre in the query, where the fit is surest, and (dy, dx) how far it moves.
    """
    p, r = q[:, 1] + 1j * q[:, 0], g[:, 1] + 1j * g[:, 0]
    ratio, turn = g[:, 2] / q[:, 2], g[:, 3] - q[:, 3]
    own = ratio * np.exp(1j * turn)
    best = None
    for at in range(0, len(qi), max(1, PROPOSALS // len(qi))):
        i = slice(at, at + max(1, PROPOSALS // len(qi)))
        apart = p[None] - p[i, None]
        alike = own[None] / own[i, None]
        ok = (abs(np.angle(alike)) <= TURN) & (abs(np.log(abs(alike))) <= STRETCH)
        ok &= abs(r[i, None] + own[i, None] * apart - r[None]) <= CELL + SLACK * abs(own[i, None] * apart)
        for _ in range(2):
            ok = ok[np.minimum(distinct(ok, qi), distinct(ok, gi)) >= votes]
            if not len(ok):
                break
            n, sp, sr = ok.sum(1), ok @ p, ok @ r
            spread = ok @ (abs(p) ** 2) - abs(sp) ** 2 / n
            a = (ok @ (p.conj() * r) - sp.conj() * sr / n) / np.where(spread > 1e-3, spread, np.inf)
            b = (sr - a * sp) / n
            like = own[None] / np.where(a == 0, 1e-9, a)[:, None]
            ok = (abs(a[:, None] * p + b[:, None] - r) <= CELL * np.maximum(1, abs(a))[:, None]) & (abs(np.angle(like)) <= TURN) & (abs(np.log(abs(like))) <= STRETCH)
        if len(ok):
            n = np.minimum(distinct(ok, qi), distinct(ok, gi))
            k = int(n.argmax())
            if n[k] >= votes and (best is None or n[k] > best[0]):
                best = int(n[k]), ok[k]
    if best is None:
        return None
    n, ok = best
    p, r, weight = p[ok], r[ok], 1 / q[ok, 2] ** 2
    weight /= weight.sum()
    middle, there = weight @ p, weight @ r
    a = (weight @ ((p - middle).conj() * (r - there))) / (weight @ abs(p - middle) ** 2)
    shift = there - middle
    return n, float(abs(a)), float(np.degrees(np.angle(a))), float(middle.imag), float(middle.real), float(shift.imag), float(shift.real)


def places(images: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, no) of every row with an image, and (no, first, corners) of each image with corners; no: its number, first: its smallest id."""
    rows = images.select(F.col(key).alias("id"), F.sha2("image", 256).alias("bytes"), "image", "height", "width").where("image is not null")
    rows = materialise(rows.select("id", "bytes", "height", "width", descriptors("image", "height", "width").alias("corners")), name)
    one = rows.groupBy("bytes", "height", "width").agg(F.min("id").alias("first"), F.any_value("corners").alias("corners")).withColumn("no", F.monotonically_increasing_id())
    one = materialise(one, f"{name}-first")
    same = F.col("r.height").eqNullSafe(F.col("f.height")) & F.col("r.width").eqNullSafe(F.col("f.width"))
    members = rows.alias("r").join(one.alias("f"), (F.col("r.bytes") == F.col("f.bytes")) & same).select("r.id", "f.no")
    return members, one.where(F.size("corners") > 0).select("no", "first", "corners")


def masks() -> list[list[int]]:
    """The bits of each table, as WORDS signed 64-bit masks."""
    rng, out = np.random.default_rng(SEED + 1), []
    for _ in range(TABLES):
        bits = np.zeros(BITS, np.uint8)
        bits[rng.permutation(BITS)[:WORD_BITS]] = 1
        out.append(np.packbits(bits).view("<i8").tolist())
    return out


def postings(images: DataFrame, side: str) -> DataFrame:
    """The images' corners in all tables: table, word, the image's number, the corner's place in it, and the descriptor; names begin with the side."""
    each = images.select(F.col("no").alias(f"{side}_no"), F.posexplode("corners").alias(f"{side}k", "c"))
    word = lambda t, m: F.xxhash64(F.lit(t), *(F.col("c")[f"w{k}"].bitwiseAND(F.lit(m[k])) for k in range(WORDS)))
    words = [word(t, m) for t, m in enumerate(masks())]
    fields = [F.col("c")[f"w{k}"].alias(f"{side}{k}") for k in range(WORDS)]
    return each.select(f"{side}_no", f"{side}k", *fields, F.posexplode(F.array(*words)).alias(f"{side}t", "word"))


def matches(gallery: DataFrame, asked: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """Pairs of corners that meet in a table and are at most `bits` bits apart, each once: those that a search counts within blocks, as rows of a join.

    Their number grows with queries times images; this is for measuring and tests.
    """
    q = postings(asked, "q")
    q = F.broadcast(q) if q.count() <= BROADCAST_POSTINGS else q
    met = postings(gallery, "g").join(q, "word")
    apart = [F.col(f"q{k}").bitwiseXOR(F.col(f"g{k}")) for k in range(WORDS)]
    far = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    tables = F.array(*(F.array(*map(F.lit, m)) for m in masks()))
    alike = lambda m: reduce(Column.bitwiseOR, (x.bitwiseAND(m[k]) for k, x in enumerate(apart))) == 0
    # the distance first, as most pairs fail it, and the tables by a loop: written out, they are more code than the JVM compiles
    here = alike(F.element_at(tables, F.col("gt") + 1)) & (F.col("gt") == F.col("qt"))
    return met.where((far <= bits) & here & ~F.exists(F.slice(tables, 1, F.col("gt")), alike))


def words(bits: np.ndarray) -> np.ndarray:
    """The words of descriptors in all tables: (table, descriptor)."""
    picked = np.unpackbits(np.array(masks(), "<i8").view(np.uint8).reshape(TABLES, -1), axis=1)
    worth = np.where(picked, 2.0 ** picked.cumsum(1) / 2, 0).astype(np.float32)
    return worth @ np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32).T


def near(q: np.ndarray, g: np.ndarray, asked: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in q and in g of the descriptors that meet in a table and are at most `bits` bits apart, each pair once. asked: q's words; tables: those of each, sorted, and their places."""
    mine, out = words(g), [np.zeros((2, 0), np.int32)]
    for t, (theirs, at) in enumerate(tables):
        first = np.searchsorted(theirs, mine[t])
        n = np.searchsorted(theirs, mine[t], "right") - first
        ends = n.cumsum()
        i = 0
        while i < len(g):
            stop = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + COMPARED, "right")))
            gi, qi = np.repeat(np.arange(i, stop, dtype=np.int32), n[i:stop]), at[spread(first[i:stop], n[i:stop])]
            ok = np.flatnonzero(np.bitwise_count(q[qi] ^ g[gi]).sum(1, dtype=np.int16) <= bits)
            qi, gi = qi[ok], gi[ok]
            for k in range(t):
                new = asked[k, qi] != mine[k, gi]
                qi, gi = qi[new], gi[new]
            out.append(np.stack([qi, gi]))
            i = stop
    return tuple(np.concatenate(out, 1))


def unpacked(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a block's images, where their corners begin (and the end), and the corners' places and descriptors."""
    corners = block.field("corners")
    columns = [corners.flatten().field(c.split(":")[0]).to_numpy(zero_copy_only=False) for c in CORNER.split(",")]
    starts = np.concatenate([[0], corners.value_lengths().to_numpy(zero_copy_only=False).cumsum()])
    return block.field("no").to_numpy(zero_copy_only=False), starts, np.stack(columns[:4], 1).astype(float), np.stack(columns[4:], 1).view("<u8")


HIT = "q long, g long, votes long, scale double, angle double, y double, x double, dy double, dx double"


def agreements(batches: Iterator[pa.RecordBatch], votes: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The hits of each row's two blocks, as in HIT."""
    kind = pa.schema([(c.split()[0], pa.int64() if "long" in c else pa.float64()) for c in HIT.split(", ")])
    for batch in released(batches):
        for images, queries in zip(batch.column("images"), batch.column("queries"), strict=True):
            (qno, qs, qat, q), (gno, gs, gat, g) = unpacked(queries.values), unpacked(images.values)
            asked = words(q)
            tables = [(w[o], o) for w in asked for o in [np.argsort(w, kind="stable").astype(np.int32)]]
            i, out = 0, []
            while i < len(gno):
                stop = max(i + 1, int(np.searchsorted(gs, gs[i] + HELD, "right")) - 1)
                qi, gi = near(q, g[gs[i] : gs[stop]], asked, tables, bits)
                gi += gs[i]
                two = (np.searchsorted(qs, qi, "right") - 1) * len(gno) + np.searchsorted(gs, gi, "right") - 1
                pairs, of, n = np.unique(two, return_inverse=True, return_counts=True)
                a, b = pairs // len(gno), pairs % len(gno)
                need = np.maximum(votes, np.ceil(SHARE * np.minimum(np.diff(qs)[a], np.diff(gs)[b]))).astype(int)
                m = np.flatnonzero((n >= need)[of])
                m = m[np.lexsort((gi[m], qi[m], of[m]))]
                at = 0
                for k in np.flatnonzero(n >= need):
                    these = m[at : (at := at + n[k])]
                    if found := agree(qi[these] - qs[a[k]], gi[these] - gs[b[k]], qat[qi[these]], gat[gi[these]], int(need[k])):
                        out.append((int(qno[a[k]]), int(gno[b[k]]), *found))
                i = stop
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(kind), kind, strict=True)], schema=kind)


def blocks(images: DataFrame, corners: int, most: int, name: str) -> DataFrame:
    """Rows of some `most` of all the corners: arrays of whole images with their numbers."""
    of = F.pmod(F.xxhash64("no"), F.lit(max(1, -(-corners // most))))
    return images.groupBy(of.alias("block")).agg(F.collect_list(F.struct("no", "corners")).alias(name)).select(name)


def search(images: DataFrame, queries: DataFrame, *, key: str = "media_id", votes: int = VOTES, bits: int = NEAR_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hits between different images, (q, g, query_id, media_id, votes, scale, angle, y, x, dy, dx), and (id, no) of all images and of all queries.

    images, queries: (key, image binary, height, width). bits: how far descriptors that match may be apart; hard-edged pictures that are turned
    need more than others, at the price of more matches. The query's point (y, x), the centre of the matches, is at (y + dy, x + dx) in the image; what
    lies around it there is scaled and turned. Rows with the same bytes are one image and one query; q and g are their numbers, query_id and media_id their smallest ids.
    """
    members, gallery = places(images, "media-members", key)
    asking, asked = places(queries, "media-queries", key)
    of_g, of_q = (x.agg(F.sum(F.size("corners"))).first()[0] or 0 for x in (gallery, asked))
    those = blocks(asked, of_q, QUERIES_BLOCK, "queries")
    those = F.broadcast(those) if of_q * TABLES <= BROADCAST_POSTINGS else those
    met = blocks(gallery, of_g, IMAGES_BLOCK, "images").crossJoin(those).mapInArrow(lambda batches: agreements(batches, votes, bits), HIT)
    first = lambda x, n, c: x.select(F.col("no").alias(n), F.col("first").alias(c))
    found = met.join(first(asked, "q", "query_id"), "q").join(first(gallery, "g", "media_id"), "g")
    rounded = [F.round("scale", 2).alias("scale"), F.round("angle").alias("angle"), *(F.round(c, 1).alias(c) for c in ("y", "x", "dy", "dx"))]
    return materialise(found.select("q", "g", "query_id", "media_id", "votes", *rounded), "media-hits"), members, asking


HITS = ["query_id", "media_id", "votes", "scale", "angle", "y", "x", "dy", "dx"]


def find_copies(images: DataFrame, queries: DataFrame, *, key: str = "media_id", votes: int = VOTES, bits: int = NEAR_BITS) -> DataFrame:
    """query_id, media_id, votes, scale, angle, y, x, dy, dx: the images in which a query's corners are found again, and where; one row per pair."""
    hits, members, asking = search(images, queries, key=key, votes=votes, bits=bits)
    one = hits.drop("query_id", "media_id")
    every = one.join(asking.select(F.col("id").alias("query_id"), F.col("no").alias("q")), "q")
    return every.join(members.select(F.col("id").alias("media_id"), F.col("no").alias("g")), "g").select(HITS)


def grouped_copies(images: DataFrame, queries: DataFrame, *, key: str = "media_id", votes: int = VOTES, bits: int = NEAR_BITS) -> DataFrame:
    """All of find_copies without its product of exact copies: rows of kind `hit` between first ids, and of kinds `query` and `image` that name a row's first id.

    find_copies has (query_id, media_id) if and only if a hit joins their firsts.
    """
    hits, members, asking = search(images, queries, key=key, votes=votes, bits=bits)
    kinds = {c: hits.schema[c].dataType for c in HITS}
    out = hits.select(F.lit("hit").alias("kind"), *HITS, F.lit(None).cast(kinds["query_id"]).alias("first"))
    for kind, number, column, rows in (("query", "q", "query_id", asking), ("image", "g", "media_id", members)):
        named = rows.join(hits.select(F.col(number).alias("no"), F.col(column).alias("first")).distinct(), "no")
        out = out.union(named.select(F.lit(kind), *((F.col("id") if c == column else F.lit(None)).cast(kinds[c]) for c in HITS), "first"))
    return out


def strongest(found: DataFrame) -> DataFrame:
    """One row per found image: media_id, its query with most votes (ties: the smallest id), how it lies, and how many queries find it."""
    best = F.max(F.struct("votes", (-F.col("query_id")).alias("q"), "scale", "dy", "dx")).alias("b")
    return found.groupBy("media_id").agg(best, F.count("*").alias("n_queries")).select("media_id", (-F.col("b.q")).alias("query_id"), "b.votes", "b.scale", "b.dy", "b.dx", "n_queries")


def rendered(vectors: DataFrame, crop: tuple[int, int, int, int] | None = None, light: float = 1.0) -> DataFrame:
    """media_id, image, height, width: each embedding drawn as an 8 x 8 pattern, smoothly enlarged to 72 x 72, cropped and lightened if asked.

    The given tables hold no images; this is their only media column.
    """

    @F.arrow_udf("binary")
    def draw(batch: pa.Array) -> pa.Array:
        out = []
        at = np.linspace(0, 7, 72)
        low = np.minimum(at.astype(int), 6)
        part = at - low
        for v in batch.to_pylist():
            if v is None or len(v) != 64 or any(x is None for x in v):
                out.append(None)
                continue
            g = np.array(v).reshape(8, 8)
            g = (g - g.min()) / max(float(np.ptp(g)), 1e-9) * 255
            g = g[low] * (1 - part)[:, None] + g[low + 1] * part[:, None]
            g = g[:, low] * (1 - part) + g[:, low + 1] * part
            if crop:
                g = g[crop[0] : crop[1], crop[2] : crop[3]]
            out.append(np.clip(g * light, 0, 255).astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    h, w = (crop[1] - crop[0], crop[3] - crop[2]) if crop else (72, 72)
    return vectors.select(F.col("vec_id").alias("media_id"), draw("embedding").alias("image"), F.lit(h).alias("height"), F.lit(w).alias("width"))


def op5_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is cropped and darkened, and searched for among all rows; all hits, as in grouped_copies."""
    vectors = read(spark, sf_dir, "embeddings")
    return grouped_copies(rendered(vectors), rendered(vectors.where("vec_id % 50 = 0"), (8, 68, 4, 66), 0.8))


QUERIES = {"op5_local_descriptors": op5_local_descriptors}
ORACLE: dict[str, str] = {}
