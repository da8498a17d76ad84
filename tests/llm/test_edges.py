"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quirelight.llm import bpe, context_tree, exact_dedup, html_text, jaccard_join, packing, pii, quality, toxicity, vector_join

TOKENIZERS = os.environ.get("QUIRELIGHT_TOKENIZERS", "/opt/tokenizers")
LONG = "lorem ipsum dolor " * 20000 + "x" * 50000
ROWS = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (6, "a b c d e f g"), (None, "no id"), (7, "mail me@x.example.org now"), (8, "é ß 中 \U0001f600")]
#: Names that operators use inside.
CLASH = ["row", "base", "terms", "rest", "block", "key", "set", "class", "n", "label", "sha", "owner", "interval", "score", "held_out", "kind", "component", "normal", "toxic", "quality"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in CLASH])


def labels(spark, rows=((1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def no_labels(spark):
    return labels(spark).limit(0)


OPERATORS = {
    "bpe": lambda s, d: bpe.encode_decode(d, f"{TOKENIZERS}/byte_bpe_50k.json"),
    "pii": lambda s, d: pii.pii(d),
    "sanitise": lambda s, d: pii.sanitise(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "toxicity unlabelled": lambda s, d: toxicity.toxicity(d, no_labels(s)),
    "clean": lambda s, d: toxicity.clean(d, no_labels(s)),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "jaccard_join": lambda s, d: jaccard_join.near_duplicates(d),
    "context_tree": lambda s, d: context_tree.language_model(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, documents(spark)).collect()
    assert len(got) == len(ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark).limit(0)).collect() == []


def test_sanitise_carries_clashing_columns(spark):
    got = {r["doc_id"]: r for r in pii.sanitise(documents(spark)).collect()}
    assert all(r[c] == f"own {c}" for r in got.values() for c in CLASH)
    assert got[7]["text"] == "mail [EMAIL] now" and got[7]["n_chars"] == 16 and got[2]["text"] == ""


def test_packing_edges(spark):
    got = packing.pack(documents(spark), f"{TOKENIZERS}/word_bpe_49k.json", capacity=64).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total[2] == total[3] == total[4] == 1 and total[1] == 8
    assert packing.pack(documents(spark).limit(0), f"{TOKENIZERS}/word_bpe_49k.json").collect() == []


def test_exact_dedup_edges(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(documents(spark)).collect()}
    assert got[6]["keep_id"] == 1 and got[6]["kept"] is False and got[1]["group_size"] == 2
    assert got[2]["keep_id"] == got[3]["keep_id"] == 2 and got[4]["keep_id"] == 4 and got[5]["group_size"] == 2 and got[5]["kept"] is True


def test_jaccard_keeps_large_classes_of_null_ids(spark):
    rows = [(None, "same words without any id")] * 3 + [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "alone")]
    got = [tuple(r) for r in jaccard_join.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 1, None)] * 4 + [(1, 3, 1), (2, 3, 1)], key=repr)


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (4, "u", "<p" * 50), (5, "u", "<div>" * 3000 + "deep words here" + "</div>" * 3000), (5, "u", "<article><p>" + "word " * 50000), (6, "u", '<a href="unclosed'), (7, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2, 6, 7)} == {1: "", 2: "", 6: "", 7: ""}
    assert html_text.extract(df.limit(0)).collect() == []


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.1]), (11, [1.0, 0.1]), (12, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("interval", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_vectors(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)], (10, 1, 10, True), (11, 3, 1, False), (11, 3, 1, False), (12, 1, 10, False)]
    assert vector_join.near_vectors(df.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in vector_join.near_vectors(df.filter("vec_id IN (3, 4)")).orderBy("vec_id").collect()] == [(0, 3, True), (0, 4, True)]


def test_vectors_of_every_length_link(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(3)] + [(10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.1]), (12, [0.0, 1.0, 0.0]), (13, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 13: (0, 13, True)}
