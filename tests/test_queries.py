"""Registered queries against their SQL on the smallest tables, and the streaming forms."""

from __future__ import annotations

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelight.plans.queries import ORACLE_SQL, QUERIES
from quirelight.streaming import stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(plain(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame[sorted(frame)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.write_once(stream.scored(stream.document_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(stream.scored(table)).count() == 0 and got.count() == table.count()


def test_windows_close_after_the_watermark(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    stream.write_once(stream.windowed_counts(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed, full = spark.read.parquet(str(tmp_path / "out")), stream.windowed_counts(events)
    assert 0 < closed.count() <= full.count()
    key = ["start", "event_type", "n"]
    assert closed.select(key).exceptAll(full.select(*key)).filter(F.lit(True)).count() == 0
