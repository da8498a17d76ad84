"""Pages with synthetic geometry over the documents table: a pure function of doc_id and text.

Lines of at most LINE characters, PAGE lines a page. Pages of even documents have a title and two columns whose blocks
alternate, as a detector emits them; odd documents have one column with gaps and indents. No row leaves its document,
so there is no shuffle; very long documents become many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE, PAGE = 60, 40


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the cluster has cores, dealt to all of them; others as they are.

    A file of few row groups is read by as few tasks, however small its splits are. A larger table is never shuffled here.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def lines_of(text: Column) -> Column:
    """The text's lines, cut to LINE characters."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / LINE) - 1, F.lit(0)).cast("int")), lambda k: F.substring(t, k * LINE + 1, F.lit(LINE)))
    return F.flatten(F.transform(F.split(text, "\n"), cut))


def _block(doc_id: Column, line: Column, r: Column) -> Column:
    even, pair = doc_id % 2 == 0, F.floor((r - 1) / 2).cast("int")
    title, left = even & (r == 0), even & (r % 2 == 1)
    gap = F.floor(r / 5).cast("int")
    indent = F.when((r % 5 == 0) & (r > 0), 90).otherwise(0)
    x0 = F.when(title, 60).when(left, 60).when(even, 320).otherwise(60 + indent)
    wide = F.least(F.lit(480), 8 * F.length(line))
    x1 = F.when(title, 540).when(left, 280).when(even, 540).otherwise(F.greatest(60 + indent + 8, 60 + wide))
    y0 = F.when(title, 40).when(even, 100 + 45 * pair).otherwise(100 + 45 * r + 75 * gap)
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), (y0 + 40).cast("int").alias("y1"), line.alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (from 1), blocks."""
    rows = documents(spark, sf_dir).select("doc_id", lines_of(F.col("text")).alias("lines"))
    count = F.ceil(F.size("lines") / PAGE).cast("int")
    cut = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.slice("lines", p * PAGE + 1, PAGE))).alias("p", "lines"))
    return cut.select("doc_id", (F.col("p") + 1).alias("page"), F.transform("lines", lambda t, r: _block(F.col("doc_id"), t, r)).alias("blocks"))


#: The same blocks as DuckDB rows: doc_id, page, ord (from 0), x0, y0, x1, y1, text.
BLOCKS_SQL = f"""
cut AS (
  SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t:
    list_transform(range(0, greatest(1, (length(t) + {LINE - 1}) // {LINE})), lambda k: substring(t, CAST(k * {LINE} + 1 AS INTEGER), {LINE})))) AS lines
  FROM documents),
spread AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS i FROM cut),
placed AS (SELECT doc_id, i // {PAGE} + 1 AS page, i % {PAGE} AS ord, text, doc_id % 2 = 0 AS even FROM spread),
blocks AS (
  SELECT doc_id, page, ord, text,
    CASE WHEN even AND ord = 0 THEN 60 WHEN even AND ord % 2 = 1 THEN 60 WHEN even THEN 320
         WHEN ord % 5 = 0 AND ord > 0 THEN 150 ELSE 60 END AS x0,
    CASE WHEN even AND ord = 0 THEN 40 WHEN even THEN 100 + 45 * ((ord - 1) // 2) ELSE 100 + 45 * ord + 75 * (ord // 5) END AS y0,
    CASE WHEN even AND ord = 0 THEN 540 WHEN even AND ord % 2 = 1 THEN 280 WHEN even THEN 540
         ELSE greatest(CASE WHEN ord % 5 = 0 AND ord > 0 THEN 158 ELSE 68 END, 60 + least(480, 8 * length(text))) END AS x1,
    CASE WHEN even AND ord = 0 THEN 40 WHEN even THEN 100 + 45 * ((ord - 1) // 2) ELSE 100 + 45 * ord + 75 * (ord // 5) END + 40 AS y1
  FROM placed)
"""


def degraded(text: Column, key: Column, every: int) -> Column:
    """The text without each character whose place and key give 0 modulo `every`; every = 0 keeps all."""
    if not every:
        return text
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.filter(chars, lambda c, i: (key * 31 + i) % every != 0), "")


def degraded_sql(text: str, key: str, every: int) -> str:
    return f"array_to_string(list_filter(string_split({text}, ''), lambda c, i: ({key} * 31 + i - 1) % {every} <> 0), '')" if every else text
