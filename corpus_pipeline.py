"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns rows; all but the last return the columns
of documents. Labels of documents that an earlier stage dropped are not used.

Defined results: every row is judged, redacted and packed by its own text, whether its id is null or repeated. Repeated rows are near copies of each
other, so of them one is left; a row without an id has no labels, and counts as a near copy like any other. Columns besides those of documents are
kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_rtree, packing, pii, quality_rules, toxicity
from tidemark.llm._common import bounded_batches, materialise, read, unused

#: Bytes up to which a table of ids or spans is broadcast, by its counted rows and summed text; beyond, Spark joins by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Workers of all stages live side by side with what the JVM took for earlier ones, so they get less at once than in the single queries.
BATCH_ROWS, TEXT_BYTES, REMEMBERED = 1000, 2 << 20, 100_000


def small(rows: DataFrame, name: str, text: str | None = None) -> DataFrame:
    """The rows, written once, with a broadcast hint if they are small: 64 bytes each, and their text."""
    rows = materialise(rows, name)
    n, size = rows.agg(F.count("*"), F.sum(F.length(text)) if text else F.lit(0)).first()
    return F.broadcast(rows) if 64 * n + (size or 0) <= BROADCAST_BYTES else rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    name = unused(docs, "_quality")
    return quality_rules.judge_documents(docs, read(spark, sf_dir, "labels"), into=name).where(F.col(name)["kept"]).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5."""
    name = unused(docs, "_toxicity")
    return toxicity.score_documents(docs, read(spark, sf_dir, "labels"), into=name).where(F.col(name) < 0.5).select(docs.columns)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written once with a number of their own, and its name: ids may be null or repeated."""
    row = unused(docs, "_row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id (null: after all others), the first of those."""
    rows, row = numbered(docs, "distinct-rows")
    of = unused(docs, "_of")
    linked = materialise(jaccard_rtree.link_components(rows, key=row).select(F.col("doc_id").alias(of), "component_id"), "distinct-linked")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", of))
    ids = rows.select(F.col(row).alias("n"), F.col("doc_id").alias("id"))
    kept = linked.join(ids, F.col(of) == F.col("n")).groupBy("component_id").agg(first[of].alias(of)).select(of)
    copies = small(linked.select(of).join(kept, of, "left_anti"), "copies")
    return rows.join(copies, F.col(row) == F.col(of), "left_anti").select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the kind in place of each span of personal data; n_chars follows the text."""
    rows, row = numbered(docs, "private-rows")
    of, spans = unused(docs, "_of"), unused(docs, "_spans")
    found = pii.find(rows, key=row).select(F.col("doc_id").alias(of), pii.written("spans").alias(spans)).where(F.col(spans) != "")
    rows = rows.join(small(found, "spans", spans), F.col(row) == F.col(of), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(pii.redact("text", spans))
    changed = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return rows.withColumn("text", text).withColumn("n_chars", changed.cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens in the sources' proportions."""
    import public_tokenizers as public

    return packing.pack(docs, public.path("byte_bpe_50k.json"), remembered=REMEMBERED, text_bytes=TEXT_BYTES)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, with small batches for Python workers."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", lean(quality)),
    ("toxicity", lean(clean)),
    ("ngram_jaccard", lean(distinct)),
    ("pii", lean(private)),
    ("packing", lean(packed)),
]

#: The trained stages have no SQL form; a test holds the rest of the pipeline against a plain version (tests/llm/test_pipeline_plain.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
