"""Joins by position: rows carry the position they had, and meet on it; nothing relies on the order of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_position(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of both sides with the same keys and position; what one side has more of is left out."""
    return left.join(right, [*keys, position])


def padded(left: DataFrame, right: DataFrame, keys: list[str], position: str, defaults: dict[str, Column]) -> DataFrame:
    """Every row of the left side, with defaults where the right side has no such position."""
    joined = left.join(right, [*keys, position], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})


def page_counts(words: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, page, n: words of each page, those without a page under 0."""
    return words.groupBy(*keys, F.coalesce(F.col(page), F.lit(0)).alias(page)).agg(F.count("*").alias("n"))


def covered(words: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, pages: the number of different pages that words name."""
    return page_counts(words, keys, page).groupBy(*keys).agg(F.count("*").alias("pages"))


def with_cache(documents: DataFrame, caches: DataFrame, keys: list[str]) -> DataFrame:
    """Every document with its cache's columns, and cached: whether there is one."""
    return documents.join(caches.withColumn("cached", F.lit(True)), keys, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def first_pages(pages: DataFrame, page: str, most: int | None) -> DataFrame:
    """Pages up to a number, all without one."""
    return pages if not most else pages.filter(F.col(page) <= most)
