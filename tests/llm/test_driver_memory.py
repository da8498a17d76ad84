"""What the operators leave with the driver."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark import SparkContext, cloudpickle

from quirelight.llm import common, exact_dedup, jaccard_join, toxicity

WORDS = [f"w{k}" for k in range(60)]
ROWS = [(k, " ".join([*WORDS[: k % 3], f"x{k}", *WORDS[k % 3 + 1 :]])) for k in range(9)] + [(20, "alone here"), (21, None), (22, "alone here")]


@pytest.mark.parametrize("find", [jaccard_join.near_duplicates, exact_dedup.exact_dedup])
def test_broadcasts_are_small_and_gone_when_what_reads_them_is_written(spark, monkeypatch, find):
    made, settled = [], []
    broadcast = SparkContext.broadcast

    def kept(self, value):
        made.append(broadcast(self, value))
        made[-1].size = os.path.getsize(made[-1]._path)
        return made[-1]

    monkeypatch.setattr(SparkContext, "broadcast", kept)
    module = jaccard_join if find is jaccard_join.near_duplicates else exact_dedup
    monkeypatch.setattr(module, "settle", lambda s: (settled.append(1), common.settle(s)))
    assert find(spark.createDataFrame(ROWS, "doc_id long, text string")).count() == len(ROWS)
    assert made and settled and max(b.size for b in made) < 100_000
    assert not any(os.path.exists(b._path) for b in made)


def test_a_shipped_array_is_the_same_in_a_task_and_is_not_sent_unpacked(spark):
    array = np.arange(1 << 20, dtype=np.uint16)
    shipped = common.Shipped(spark, array)
    assert (shipped.value == array).all() and len(cloudpickle.dumps(shipped.__getstate__()["_array"])) < 100
    got = spark.sparkContext.parallelize([5, 70_000], 2).map(lambda k: int(shipped.value[k])).collect()
    assert got == [5, 70_000 - 65_536]
    shipped.free()


def test_slots_come_back_from_their_gaps():
    for n in (0, 1, 5, 3000):
        slots = np.unique(np.random.default_rng(n).integers(0, 1 << 20, n))
        held = toxicity.packed_slots(slots)
        assert toxicity.unpacked_slots(held) == slots.astype("<u4").tobytes()
    assert len(held) < 2 * len(slots) + 100
