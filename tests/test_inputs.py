"""Inputs by name, where a table is a folder of part files."""

from __future__ import annotations

import os

from quirelight.plans.queries import QUERIES
from quirelight.sources import files


def test_a_table_of_several_parts_is_one_input(spark, tmp_path):
    for name in ("customer.parquet", "benchmark.parquet", "orders.parquet", "_hidden.parquet", "a.txt"):
        (tmp_path / name).write_bytes(b"x")
    os.mkdir(tmp_path / "conversations.parquet")
    for k in range(3):
        (tmp_path / "conversations.parquet" / f"part-{k}.parquet").write_bytes(b"x")
    got = [(r["place"], r["name"]) for r in QUERIES["first_inputs"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(1, "benchmark.parquet"), (2, "conversations.parquet"), (3, "customer.parquet")]
    assert files.first_entries(spark, [f"file://{tmp_path}"], "*.pdf", 3).count() == 0
