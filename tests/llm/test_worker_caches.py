"""What a pass leaves in its Python worker."""

from __future__ import annotations

import pyarrow as pa
import pytest

from quirelight.llm import common, tokens


def test_a_pass_of_another_stage_empties_the_tokenizers_cache(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    monkeypatch.setitem(tokens._loaded, "a file", {"run": b"ids"})
    same = tokens.tokenising(lambda batches: batches)
    assert list(same(iter([batch]))) == [batch] and "a file" in tokens._loaded
    assert list(common.lean(lambda batches: batches)(iter([batch]))) == [batch]
    assert tokens._loaded == {}
    monkeypatch.undo()
    tokens._loaded.clear()


def test_packing_keeps_its_cache_from_task_to_task(spark):
    packing = pytest.importorskip("quirelight.llm.packing")
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(k, "one two three " * 50) for k in range(8)], "doc_id long, text string").repartition(4)
    out = packing.pack(docs, tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(out) == 8 and all(r[1] == r[2] for r in out)


def test_a_worker_knows_its_caches_by_name_after_pickling(monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setitem(tokens._loaded, "a file", {})
    list(cloudpickle.loads(cloudpickle.dumps(tokens.tokenising(lambda batches: batches)))(iter([])))
    assert "a file" in tokens._loaded
    list(cloudpickle.loads(cloudpickle.dumps(common.lean(lambda batches: batches)))(iter([])))
    assert tokens._loaded == {}
