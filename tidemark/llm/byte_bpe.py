"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte is one printable character to the library (the byte-to-character table); ids go out as little-endian unsigned
32-bit integers in a binary column, and decoding reverses the table, so that every id gives back its bytes, also those
of a character that is split over several ids.

Defined results: a null or empty text has no ids; ids outside the vocabulary raise an error; a text of any length is
encoded whole; rows that are alike get the same result; a JSON vocabulary's added tokens are recognised in texts, as by its library, a rank file has none;
other columns are kept, but one with the result's own name is replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import binaries, plain, read, released, slices, spread

#: Distinct parts that a worker remembers; beyond it starts again.
REMEMBERED = 500_000
#: Stands between parts.
MARK = "\0"
#: White space to the patterns; a blank between two of these, or between one and the text's end or an added token, may join both.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
RUN = rf"{SPACE} (?:{SPACE}|<|$)"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that join to a token, by the rank of what they make: a rank file allows any of them."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        pairs = [(a, b) for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        # those made of early tokens come up first
        out += sorted(pairs, key=lambda p: max(ranks[p[0]], ranks[p[1]]))
    return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str | None = None) -> tuple[object, np.ndarray, np.ndarray]:
    """The tokenizer of a vocabulary file, and the bytes of all its ids: one run of bytes, and offsets into it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_characters()
    if path.endswith(".json"):
        tok = Tokenizer.from_file(path)  # added tokens in a text, like an end mark, are one id each, as the library has it
        back = {c: b for b, c in enumerate(char)}
        tokens = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        table = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]
    else:
        ranks = read_ranks(path)
        shown = {t: "".join(char[b] for b in t) for t in ranks}
        tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges_of(ranks)]))
        split = [pre_tokenizers.Split(Regex(pattern), "isolated")] if pattern else []
        tok.pre_tokenizer = pre_tokenizers.Sequence([*split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=not split)])
        table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            table[r] = t
    offsets = np.zeros(len(table) + 1, np.int64)
    np.cumsum([len(t) for t in table], out=offsets[1:])
    return tok, np.frombuffer(b"".join(table), np.uint8), offsets


class Encoder:
    """Encodes texts by the distinct parts of their words.

    A blank begins a match unless it stands within or at the end of a run of white space, so texts with such runs (two blanks, or other
    white space, a blank, and white space again, the end or an added token) go to the library whole. Elsewhere words are cut before blanks. The pattern
    never joins a letter to a point or comma, nor a single line break to its neighbours; so each distinct part is encoded once for all its places.
    """

    def __init__(self, path: str, pattern: str | None = None, remembered: int = REMEMBERED):
        self.tok, self.bytes, self.offsets = load(path, pattern)
        self.remembered = remembered
        self.lengths = np.diff(self.offsets)
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        found = list(map(known.get, parts))
        # many parts go as one text, where none can join with the next
        new = [p for p, x in zip(parts, found, strict=True) if x is None]
        joined = [p for p in new if p[:1] == " " and not p[-1].isspace()]
        for i in range(0, len(joined), 16_000):
            groups = [joined[j : j + 1000] for j in range(i, min(i + 16_000, len(joined)), 1000)]
            for group, e in zip(groups, self.tok.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                sizes = np.fromiter((len(p.encode()) for p in group), np.int64, len(group))
                cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * 4
                data = ids.tobytes()
                known.update(zip(group, map(data.__getitem__, map(slice, np.append(0, cuts[:-1]).tolist(), cuts.tolist())), strict=True))
        if len(joined) < len(new):
            alone = [p for p in new if p not in known]
            for i in range(0, len(alone), 4096):
                coded = self.tok.encode_batch_fast(alone[i : i + 4096], add_special_tokens=False)
                known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(alone[i : i + 4096], coded, strict=True))
        return [known[p] if x is None else x for p, x in zip(parts, found, strict=True)] if new else found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' offsets into them."""
        whole = np.flatnonzero(pc.or_(pc.match_substring(texts, "  "), pc.match_substring_regex(texts, RUN)).to_numpy(zero_copy_only=False))
        if len(whole):
            mask = np.ones(len(texts), bool)
            mask[whole] = False
            lists = pc.split_pattern(pc.if_else(pa.array(mask), texts, pa.scalar("", texts.type)), " ")
        else:
            lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        first = np.zeros(int(ends[-1]), bool)
        first[ends - counts] = True
        blank, none = (pa.scalar(x, texts.type) for x in (" ", ""))
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(first), none, blank), pc.list_flatten(lists), none).dictionary_encode()
        vocab = pieces.dictionary
        # parts of the distinct pieces, between marks
        plainly = pc.invert(pc.match_substring(vocab, MARK))
        marked = pc.replace_substring_regex(vocab, r"(\p{L})([.,])", rf"\1{MARK}\2")
        broken = pc.match_substring_regex(vocab, r"^ ?[\p{L}\p{N}\p{P}\p{S}]+(\n[\p{L}\p{N}\p{P}\p{S}]+)+$")
        marked = pc.if_else(broken, pc.replace_substring(marked, "\n", f"{MARK}\n{MARK}"), marked)
        split = pc.split_pattern(pc.if_else(plainly, marked, vocab), MARK)
        if not pc.all(plainly).as_py():
            split = pa.array([[p] if MARK in p else x for p, x in zip(vocab.to_pylist(), split.to_pylist(), strict=True)], split.type)
        n_parts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = pc.list_flatten(split).dictionary_encode()
        names = parts.dictionary.to_pylist()
        table = self._ids(names)
        for text in texts.take(pa.array(whole)).to_pylist() if len(whole) else []:
            table.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        index = pieces.indices.to_numpy(zero_copy_only=False)
        lengths = n_parts[index]
        at = parts.indices.to_numpy(zero_copy_only=False)[spread((np.cumsum(n_parts) - n_parts)[index], lengths)]
        ends = np.cumsum(lengths)[ends - 1]
        if len(whole):  # a text that is left out has one empty part
            at = at.copy()
            at[ends[whole] - 1] = len(names) + np.arange(len(whole))
        lengths = sizes[at]
        ids = np.frombuffer(b"".join(table), "<u4")[spread((np.cumsum(sizes) - sizes)[at], lengths)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:] = np.cumsum(lengths)[ends - 1]
        return ids, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and the texts' offsets into them."""
        lengths = self.lengths[ids]
        data = self.bytes[spread(self.offsets[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return data, ends[offsets]

    def places(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in its text, in code points; ids that share a character all cover it."""
        data, _ = self.decode(ids, offsets)
        lengths = self.lengths[ids]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        end = np.cumsum(lengths)
        # a byte at p is in character lead[p + 1] - 1
        first, last = lead[np.minimum(end - lengths + 1, len(data))] - 1, lead[end]
        base = np.repeat(lead[np.concatenate([[0], end])[offsets[:-1]]], np.diff(offsets))
        return first - base, last - base


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, pattern, remembered)


def encode(text: Column | str, path: str, pattern: str | None = None) -> Column:
    """Column of struct(n_tokens long, ids binary): the ids of the whole text."""

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        for batch in released(batches):
            counts, out = [np.empty(0, np.int64)], []
            for part in slices(plain(batch)):
                ids, offsets = enc.encode(part)
                counts.append(np.diff(offsets))
                out.append(binaries(ids, offsets))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.chunked_array(out, pa.large_binary()).combine_chunks().cast(pa.binary())], ["n_tokens", "ids"])

    return ids_of.asNondeterministic()(text)


def encode_with_offsets(text: Column | str, path: str, pattern: str | None = None) -> Column:
    """Column of array<struct(id, start, end)>: each id with the code points of the text that it covers."""

    @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
    def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        for batch in released(batches):
            out = []
            for part in slices(plain(batch)):
                ids, offsets = enc.encode(part)
                start, end = enc.places(ids, offsets)
                values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (ids, start, end)], ["id", "start", "end"])
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values))
            kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.chunked_array(out, kind).combine_chunks()

    return tokens_of.asNondeterministic()(text)


def decode(ids: Column | str, path: str, pattern: str | None = None) -> Column:
    """Binary column: the bytes of the ids (a binary of little-endian unsigned 32-bit integers); null: none.

    `.cast("string")` is right for whole texts; a piece that ends inside a character decodes to valid text with
    `decode_text`.
    """

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        for batch in released(batches):
            out = []
            for part in slices(pc.fill_null(batch.cast(pa.large_binary()), b"")):
                sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.frombuffer(b"".join(part.to_pylist()), "<u4")
                out.append(binaries(*enc.decode(flat, offsets)))
            yield pa.chunked_array(out, pa.large_binary()).combine_chunks().cast(pa.binary())

    return bytes_of.asNondeterministic()(ids)


def decode_text(data: Column | str) -> Column:
    """Text of decoded bytes; half a character at either end becomes U+FFFD."""

    @F.arrow_udf("string")
    def text_of(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

    return text_of(data)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, *, into: str = "bpe") -> DataFrame:
    """The rows with `into` = struct(n_tokens, ids)."""
    return docs.withColumn(into, encode("text", path, pattern))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public.PATTERN)
    return coded.select(
        "doc_id",
        F.col("bpe.n_tokens").alias("n_tokens"),
        F.sha2(F.col("bpe.ids"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("bpe.ids"), path, public.PATTERN), 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE: dict[str, str] = {}
