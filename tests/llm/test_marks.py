"""Marks of sets, by which the near-duplicate join tells sets apart before it compares them."""

from __future__ import annotations

import numpy as np
import pytest

from quirelight.llm import jaccard_join
from test_methods import brute_groups, joined, large_group


def test_marks_reject_no_link_and_most_others():
    r = np.random.default_rng(5)
    allowed = {True: [0, 0], False: [0, 0]}
    for _ in range(3000):
        x = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 400)), dtype=np.uint64))
        cut, more = (int(r.integers(0, 1 + len(x) // 2)) for _ in range(2))
        y = np.unique(np.concatenate([r.permutation(x)[cut:], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
        if not len(y):
            continue
        n = int(r.integers(max(1, len(x) // 2), 2 * len(x) + 1))
        turned = int(np.bitwise_count((jaccard_join.marks_of(x, n) ^ jaccard_join.marks_of(y, n)).view(np.uint64)).sum())
        both = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * both
        assert turned <= apart and (apart - turned) % 2 == 0
        link = 100 * both >= 80 * (len(x) + len(y) - both)
        seen = allowed[link]
        seen[180 * turned <= 20 * (len(x) + len(y))] += 1
    assert allowed[True][0] == 0 and allowed[True][1] > 100
    assert allowed[False][0] > 5 * allowed[False][1]


def test_marks_stay_within_their_words():
    s = np.arange(1, 5, dtype=np.uint64)
    assert [len(jaccard_join.marks_of(s, n)) for n in (1, 32, 33, 64, 65, 129, 2048, 1 << 20)] == [1, 1, 2, 2, 4, 8, 64, 64]
    assert jaccard_join.marks_of(s[:0], 1).tolist() == [0]


@pytest.mark.parametrize(("few", "block"), [(4, 8), (4, 64), (4, 1024), (1024, 1024)])
def test_lists_paired_in_blocks_and_by_centres_equal_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = large_group(500, seed=block + few)
    assert joined(spark, docs) == brute_groups(docs)


def test_a_group_of_copies_is_compared_in_few_pairs(spark, monkeypatch):
    made = []
    compared = jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "compared", lambda pairs, *more: (made.append(pairs.count()), compared(pairs, *more))[1])
    docs = large_group(1200)
    joined(spark, docs)
    print(made, len(docs))
    assert sum(made) < 5 * len(docs)
