"""What a round of the near-duplicate join computes once."""

from __future__ import annotations

import numpy as np

from quirelight.llm import jaccard_join


def test_members_of_pairs_are_found_once_in_a_round(spark, monkeypatch):
    calls = {"members_of": 0, "compared": 0}

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        monkeypatch.setattr(jaccard_join, name, run)

    for name in calls:
        counted(name, getattr(jaccard_join, name))
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*words[: k % 3], f"x{k}", *words[k % 3 + 1 :]])) for k in range(9)] + [(20, "alone here"), (21, None)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(9)} | {20: 20, 21: 21}
    assert calls["members_of"] == calls["compared"] > 0


def test_slots_of_a_set_are_the_different_ones():
    s = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) >> np.uint64(30) << np.uint64(30))
    assert jaccard_join.distinct_slots(s).tolist() == np.unique(jaccard_join._slots(s)).tolist()
    assert len(jaccard_join.distinct_slots(s[:0])) == 0
