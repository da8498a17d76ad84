"""Character F1 against copies that lack characters, counted without the copies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import metrics
from quirelight.sources import bridge

EVERY = [0, 7, 13, 2, 1]


def test_f1_without_copies_equals_f1_of_copies(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["abracadabra" * 9, "x", "", None, "日本語𝒳𝒳é" * 5, "zz"])] + [(-5, "minus" * 30), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for k, e in enumerate(EVERY):
        copy = F.coalesce(bridge.degraded(F.col("text"), F.col("doc_id"), e), F.lit(""))
        want = docs.filter("text <> ''").select(tx.char_f1(F.col("text"), copy).alias("f")).collect()
        for texts in (256, 2):
            monkeypatch.setattr(metrics, "TEXTS", texts)
            got = metrics.kept_f1(docs, EVERY).filter(f"place = {k}").collect()
            assert [r["f"] for r in got] == pytest.approx([r["f"] for r in want])


def test_a_key_whose_multiple_leaves_64_bits(spark):
    key = (1 << 62) + 3
    docs = spark.createDataFrame([(key, "abcabcabc")], "doc_id long, text string")
    kept = sum((key * 31 + i) % 7 != 0 for i in range(9))
    assert [r["f"] for r in metrics.kept_f1(docs, [7]).collect()] == pytest.approx([2 * kept / (9 + kept)])
