"""Layout of pages held as rows: a page has an array of blocks, so every operator here stays within a row.

A block is a struct with x0, y0, x1, y1 in pixels from the top left, and text. Nothing is shuffled: Spark
deals pages to tasks as the scan gives them, and a page's blocks never meet another page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import let

# Where a gutter may lie, and what a page must have to own one.
BAND_FROM, BAND_TO, STEPS = 0.30, 0.70, 39
LEAST_BLOCKS, LEAST_SIDE, MOST_CROSSING, WIDE = 8, 0.25, 0.05, 0.6


def quad_bounds(box: Column) -> Column:
    """x0, y0, x1, y1 of an array of points (P20)."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_vertical(x0: Column, y0: Column, x1: Column, y1: Column, text: Column) -> Column:
    """A line set sideways: more than twice as high as wide, and more than one character (P10)."""
    return ((y1 - y0) > (x1 - x0) * 2.0) & (F.length(text) > 1)


def to_points(value: Column, dpi: Column) -> Column:
    """Pixels to points."""
    return value * 72.0 / dpi


def to_pages(blocks: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Pages from block rows: one shuffle on the page's keys, blocks in their order."""
    rest = [c for c in blocks.columns if c not in keys and c != order]
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("blocks"))
    return rows.withColumn("blocks", F.transform("blocks", lambda b: F.struct(*[b[c].alias(c) for c in (*rest, order)])))


def page_span(blocks: Column) -> tuple[Column, Column]:
    low = F.array_min(F.transform(blocks, lambda b: b["x0"])).cast("double")
    return low, F.array_max(F.transform(blocks, lambda b: b["x1"])).cast("double") - low


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def find_gutter(blocks: Column) -> Column:
    """x of the column gutter, null for a page of one column.

    Of 39 places in the middle band the one that fewest narrow blocks cross wins, then the most central, then the first.
    """
    low, width = page_span(blocks)
    page = F.struct(blocks.alias("blocks"), low.alias("low"), width.alias("width"))

    def place(p: Column, step: Column) -> Column:
        frac = F.lit(BAND_FROM) + F.lit(BAND_TO - BAND_FROM) * step / F.lit(STEPS)
        at = F.struct((p["low"] + p["width"] * frac).alias("x"), F.abs(frac - 0.5).alias("off"), (p["width"] * WIDE).alias("wide"))

        def counted(a: Column) -> Column:
            x = a["x"]
            crossing = count_where(p["blocks"], lambda b: ((b["x1"] - b["x0"]) < a["wide"]) & (b["x0"] < x) & (x < b["x1"]))
            left, right = count_where(p["blocks"], lambda b: b["x1"] <= x), count_where(p["blocks"], lambda b: b["x0"] >= x)
            return F.struct(crossing.alias("crossing"), a["off"].alias("off"), step.alias("step"), x.alias("x"), left.alias("left"), right.alias("right"))

        return let(at, counted)

    def best(p: Column) -> Column:
        n = F.size(p["blocks"])
        fits = lambda c: (c["crossing"] <= n * MOST_CROSSING) & (c["left"] >= n * LEAST_SIDE) & (c["right"] >= n * LEAST_SIDE)
        least = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda step: place(p, step)))
        found = let(least, lambda c: F.when(fits(c), c["x"]))
        return F.when((n >= LEAST_BLOCKS) & (p["width"] > 0), found)

    return let(page, best)


def reading_order(blocks: Column, gutter: Column) -> Column:
    """Blocks across the gutter, then the left and the right column, each by y0 and x0; without a gutter as given (O2)."""
    zone = lambda b, g: F.when((b["x0"] < g) & (g < b["x1"]), 0).when(b["x1"] <= g, 1).otherwise(2)

    def ordered(p: Column) -> Column:
        key = lambda b, i: F.struct(zone(b, p["g"]).alias("zone"), b["y0"].alias("y"), b["x0"].alias("x"), i.alias("i"), b.alias("b"))
        sorted_ = F.transform(F.array_sort(F.transform(p["blocks"], key)), lambda k: k["b"])
        return F.when(p["g"].isNull(), p["blocks"]).otherwise(sorted_)

    return let(F.struct(blocks.alias("blocks"), gutter.alias("g")), ordered)


def page_text(blocks: Column) -> Column:
    """Texts of a page's blocks, a line each."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def joined_pages(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """A document's text with a separator before each page but the first."""
    part = F.when(F.col(page) > 1, F.concat(F.lit("\n\n--- Page "), F.col(page).cast("string"), F.lit(" ---\n\n"), F.col(text))).otherwise(F.col(text))
    rows = pages.select(*keys, F.struct(F.col(page).alias("page"), part.alias("part")).alias("p"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("text"))


def nearest_right(placed: Column) -> Column:
    """For each word the gap to the nearest word on its right that shares its height, in that word's heights.

    Words are structs of x0, y0, x1, y1. The result has a struct of index and gap for each word with such a neighbour;
    of neighbours at one x the first placed counts.
    """
    return let(placed, _nearest)


def _nearest(words: Column) -> Column:
    def near(w: Column) -> Column:
        right = F.filter(words, lambda o: (o["x0"] > w["x1"]) & (w["y0"] < o["y1"] - 0.01) & (w["y1"] > o["y0"] + 0.01))
        keyed = F.transform(right, lambda o, j: F.struct(o["x0"].alias("x"), j.alias("j"), (o["y1"] - o["y0"]).alias("h")))
        return F.array_min(keyed)

    found = F.transform(words, lambda w, i: F.struct(i.alias("index"), w["x1"].alias("x1"), near(w).alias("n")))
    kept = F.filter(found, lambda f: f["n"].isNotNull() & (f["n"]["h"] > 0.5))
    return F.transform(kept, lambda f: F.struct(f["index"].alias("index"), ((f["n"]["x"] - f["x1"]) / f["n"]["h"]).alias("gap")))
