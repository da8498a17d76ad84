"""Sources: files by extension, block JSON, caches, extracted word boxes, info text, listings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import is_supported

#: A recognised line as it is exchanged (D7); words are optional.
BLOCK = "struct<box:array<array<double>>,text:string,score:double,words:array<struct<text:string,box:array<array<double>>>>>"


def binary_files(spark: SparkSession, paths: list[str], glob: str = "*.pdf") -> DataFrame:
    """Files of folders in the order of their paths (S1, S2, O7); contents are read only where they are selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).orderBy("path")


def first_files(spark: SparkSession, paths: list[str], glob: str, n: int) -> DataFrame:
    """The first n files in the order of their paths (S3)."""
    return binary_files(spark, paths, glob).limit(n)


def first_entries(spark: SparkSession, folders: list[str], glob: str, n: int) -> DataFrame:
    """path: the first n entries of folders in the order of their paths; a folder that the pattern names is one entry, whatever
    lies in it (S1, S3). Only names are read, by Spark's own file systems; hidden ones, with . or _ first, are left out as in its scans."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(conf)
        match = jvm.org.apache.hadoop.fs.GlobFilter(glob)
        found += [e.getPath().toString() for e in system.listStatus(path, match) if e.getPath().getName()[0] not in "._"]
    return spark.createDataFrame(pa.table({"path": pa.array(sorted(found)[:n], pa.string())}))


def first_supported(paths: DataFrame, keys: list[str], path: str, position: str) -> DataFrame:
    """The first supported path of each key."""
    return paths.filter(is_supported(F.col(path))).groupBy(*keys).agg(F.min_by(path, position).alias(path))


def parse_blocks(json: Column) -> Column:
    """An array of blocks from JSON; a block that is not as agreed is an error (D7, P22's inverse)."""
    return F.from_json(json, f"array<{BLOCK}>", {"mode": "FAILFAST"})


def block_json(blocks: Column) -> Column:
    """Blocks as JSON."""
    return F.to_json(blocks)


def parse_pages(json: Column) -> Column:
    """Pages of blocks from a pages file."""
    return F.from_json(json, f"array<array<{BLOCK}>>", {"mode": "FAILFAST"})


def cache_pages(text: Column) -> Column:
    """Pages of a cache: JSON arrays parted by NUL, blank parts left out."""
    parts = F.filter(F.split(text, "\x00"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")
    return F.transform(parts, lambda c: F.from_json(c, f"array<{BLOCK}>"))


def page_texts(text: Column) -> Column:
    """Texts of pages, parted by form feeds."""
    return F.split(text, "\f")


def bbox_words(xhtml: Column) -> Column:
    """Words with their boxes, from extracted XHTML: a word tag's attributes by name, in any order."""

    def word(tag: Column) -> Column:
        side = lambda name: F.regexp_extract(tag, rf'\s{name}\s*=\s*"([^"]*)"', 1).try_cast("double")
        return F.struct(side("xMin").alias("x0"), side("yMin").alias("y0"), side("xMax").alias("x1"), side("yMax").alias("y1"), F.split_part(tag, F.lit(">"), F.lit(2)).alias("text"))

    return F.transform(F.regexp_extract_all(xhtml, F.lit(r"<word(\s[^>]*>[^<]*)</word>"), F.lit(1)), word)


def info_field(text: Column, key: str) -> Column:
    """The value of a "Key: value" line."""
    return F.trim(F.nullif(F.regexp_extract(text, rf"(?m)^{key}:(.*)$", 1), F.lit("")))


def listed_images(text: Column) -> Column:
    """Lines of an image listing after its two header lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.greatest(F.size(lines) - 2, F.lit(0))
