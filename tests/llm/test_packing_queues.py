"""Every source has its own queue, and no target is ignored."""

import public_tokenizers as public
import pytest

from tidemark.llm import packing as P

BPE = public.path("byte_bpe_50k.json")


def test_a_target_of_one_of_many_sources_holds(spark):
    rows = [(i, "alpha beta gamma delta " * 40, f"s{i % 80}") for i in range(320)] + [(1000 + i, "small words " * 30, "small") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.pack(docs, BPE, targets={"small": 0.3}).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    assert (got[got.source == "small"].sequence_id < 10).all() and got.sequence_id.max() > 30
    with pytest.raises(ValueError):
        P.pack(docs, BPE, targets={"small": 0.3, "s1": 0.1}, most_queues=2, window_sequences=1)
