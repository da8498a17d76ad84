"""The deduplicating stages on repeated and null ids."""

from __future__ import annotations

import corpus_pipeline

LONG = " ".join(f"word{i}" for i in range(60))


def left(stage, spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    return sorted((tuple(r) for r in stage(spark, docs, "").collect()), key=repr)


def test_one_row_of_each_group_stays(spark):
    clean = [(5, "a text of its own", "x"), (8, "second clean text", "x"), (None, "unique without id", "x")]
    copies = [(1, "first of them", "x"), (5, "first  of them", "x"), (None, "first of them", "x")]
    nulls, twice = [(None, "copied without id", "x")] * 3, [(7, "the same row", "x")] * 2
    expected = sorted([*clean, copies[0], nulls[0], twice[0]], key=repr)
    assert left(corpus_pipeline.drop_copies, spark, clean + copies + nulls + twice) == expected
    near = [(2, LONG, "x"), (5, f"{LONG} end", "x"), (None, f"{LONG} fin", "x"), (2, f"{LONG} last", "x")]
    got = left(corpus_pipeline.drop_near_copies, spark, clean + near)
    assert len(got) == 4 and all(r in got for r in clean) and [r[0] for r in got if r[1].startswith(LONG)] == [2]
