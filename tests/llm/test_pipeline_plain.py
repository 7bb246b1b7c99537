"""The pipeline against a plain version: everything but the trained verdicts is worked out again without its operators."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_other_operators import plain_spans
from test_text_operators import plain_components, plain_rules

import corpus_pipeline as C
from tidemark.llm import quality_rules, toxicity
from tidemark.llm._common import read, scratch_space, unused

DATA = "/root/testdata/sf0.001"
public = pytest.importorskip("public_tokenizers")


def redacted(text):
    """Base spans, merged where they overlap, by their kind."""
    out, done = [], 0
    for kind, a, b in sorted(plain_spans(text), key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0]))):
        if b > done:
            if a >= done:
                out.append(text[done:a] + f"<{kind.upper()}>")
            done = b
    return "".join(out) + text[done:]


def test_pipeline_as_plain_version(spark):
    from tokenizers import Tokenizer

    with scratch_space(spark):
        docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert len(texts) == docs.count()
        kept = {r.doc_id for r in quality_rules.judge_documents(docs, labels).where("quality_rules.kept").collect()}
        for i in kept:
            n, _, _, _, rep = plain_rules(texts[i])
            assert n >= 50 and 100 * rep <= 50 * n
        stage = docs.where(F.col("doc_id").isin(list(kept)))
        clean = sorted(r.doc_id for r in toxicity.score_documents(stage, labels).where("toxicity < 0.5").collect())
        parts = plain_components([texts[i] for i in clean])
        first = sorted({clean[c] for _, c in parts})
        want = {i: redacted(texts[i]) for i in first}

        stage = docs
        for name, f in C.STAGES[:-1]:
            stage = C.materialise(f(spark, stage, DATA), f"test-{name}")
            assert stage.columns == docs.columns
        got = {r.doc_id: r.text for r in stage.collect()}
        assert got == want and len(first) < len(clean) < len(kept) < len(texts)

        tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in want.items()}
        pieces = C.run(spark, DATA).toPandas()
        assert set(pieces.doc_id) == set(want)
        for i, g in pieces.sort_values("start").groupby("doc_id"):
            assert g.length.sum() == len(ids[i]) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
            assert all(zlib.crc32(ids[i][a : a + n]) == c for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))


def test_stages_on_nulls_long_texts_ties_and_clashing_names(spark):
    """Null columns, an empty and a very long text, rows that are there twice, columns by the operators' names."""
    with scratch_space(spark):
        own = read(spark, DATA, "documents")
        word = "the ferry left the quay early and {0} people waited by the gate for number {0} to come along the river. "
        rows = [(900_001, None, None, None, None), (None, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, "".join(word.format(i) for i in range(20_000)), "en", None, 7), (900_004, word.format(3), None, "s", 1), (900_004, word.format(3), None, "s", 1)]
        docs = own.union(spark.createDataFrame(rows, own.schema))
        for c in ("toxicity", "quality_rules", "_quality", "_toxicity", "_row", "_of", "_spans", "component_id", "spans", "kept"):
            docs = docs.withColumn(c, F.lit("mine"))
        assert unused(docs, "_quality") == "__quality"
        docs = C.materialise(docs, "test-odd")
        for name, f in C.STAGES[:-1]:
            out = C.materialise(f(spark, docs, DATA), f"test-{name}")
            assert out.columns == docs.columns and out.where("toxicity <> 'mine' or quality_rules <> 'mine' or _row <> 'mine' or _spans <> 'mine' or component_id <> 'mine'").count() == 0
            assert 0 < out.count() <= docs.count()
            # the base rules reject a text of repeated windows, whatever its length; the other stages keep it
            assert out.where("doc_id = 900003").count() == int(name != "quality_rules")
            none = C.materialise(f(spark, docs.limit(0), DATA), f"test-{name}-none")
            assert none.count() == 0 and none.columns == docs.columns
        assert C.packed(spark, docs, DATA).where("start = 0").count() == docs.count()
