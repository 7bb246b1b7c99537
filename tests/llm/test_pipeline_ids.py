"""Stages of the pipeline on rows whose ids are null or repeated."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemark.llm._common import materialise, read

DATA = "/root/testdata/sf0.001"
PRIVATE = "write to user{0}@mail{0}.example.com about the harbour, the mill and the long road number {0} beyond the old town"
PLAIN = "the ferry number {0} left the quay early and {0} people waited by the gate for the next one to come"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, and among them: null ids, one id for several texts, rows that are there twice."""
    own = read(spark, DATA, "documents")
    rows = [(None, PRIVATE.format(i * 7919), "en", "web") for i in range(3)] + [(5000, PRIVATE.format(70001), "en", "web"), (5000, PLAIN.format(80001), "en", "web")] + 2 * [(6000, PRIVATE.format(90001), "en", "web")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).select(own.columns)
    nulled = own.where("doc_id % 10 = 3").withColumn("doc_id", F.lit(None).cast("long"))
    return materialise(own.union(extra).union(nulled).union(own.where("doc_id % 10 = 4")), "test-ids")


def texts(rows):
    return Counter(r.text for r in rows.select("text").collect())


@pytest.mark.parametrize("stage", [C.quality, C.clean])
def test_rows_are_judged_by_their_texts(spark, docs, stage):
    had, left = texts(docs), texts(stage(spark, docs, DATA))
    assert left and all(had[t] == n for t, n in left.items())


def test_one_row_of_each_group_is_left(spark, docs):
    left = materialise(C.distinct(spark, docs, DATA), "test-left")
    got = texts(left)
    words = Counter(" ".join(r.text.lower().split()) for r in left.where("text <> ''").select("text").collect())
    assert max(words.values()) == 1
    for i in range(3):
        assert got[PRIVATE.format(i * 7919)] + sum(got[PRIVATE.format(j * 7919)] for j in range(i)) >= 1
    assert got[PRIVATE.format(90001)] <= 1 and got[PLAIN.format(80001)] == 1
    own = {r.doc_id for r in C.distinct(spark, read(spark, DATA, "documents"), DATA).collect()}
    assert own == {r.doc_id for r in left.where("doc_id < 5000").collect()} and left.where("doc_id < 5000").count() == len(own)


def test_each_row_loses_its_own_personal_data_alone(spark, docs):
    out = materialise(C.private(spark, docs, DATA), "test-private")
    got = texts(out)
    assert out.count() == docs.count() and not [t for t in got if t and "@mail" in t]
    assert got[PLAIN.format(80001)] == 1
    assert sum(n for t, n in got.items() if t and t.startswith("write to <EMAIL> about the harbour")) == 6


def test_every_row_is_packed_once(spark, docs):
    pieces = C.packed(spark, docs, DATA)
    assert pieces.where("start = 0").count() == docs.count()
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
