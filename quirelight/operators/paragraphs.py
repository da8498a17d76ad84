"""Paragraphs from the lines of a page, and from text that has lines alone. Row-local, like layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.text import join_two, let, low_percentile, strip, upper_median

# Fixed values, in line heights.
GAP, INDENT, SHORT, BACK = 0.8, 1.2, 2.0, 0.6
_EMPTY = "CAST(array() AS array<struct<text:string,first_line_indent:boolean>>)"


def line_stats(lines: Column) -> Column:
    """Line height, left margin and right edge over all lines of a page, blank ones included."""
    real = lambda v: v.cast("float")
    height = upper_median(F.transform(lines, lambda b: F.greatest(real(b["y1"]) - real(b["y0"]), F.lit(1.0).cast("float"))))
    left = low_percentile(F.transform(lines, lambda b: real(b["x0"])), 0.1)
    right = F.array_max(F.transform(lines, lambda b: real(b["x1"])))
    return F.struct(height.alias("height"), left.alias("left"), right.alias("right"))


def paragraphs(lines: Column, stats: Column) -> Column:
    """Array of (text, first_line_indent): a line opens a paragraph after a gap, by an indent, or at the margin after a
    short line (T2, W1, W2, F6)."""
    return let(F.struct(lines.alias("lines"), stats.alias("stats")), lambda p: _paragraphs(p["lines"], p["stats"]))


def _paragraphs(lines: Column, stats: Column) -> Column:
    real = lambda v: v.cast("float")
    times = lambda k: F.lit(k).cast("float") * stats["height"]
    shown = F.filter(F.transform(lines, lambda b: F.struct(strip(b["text"]).alias("text"), real(b["x0"]).alias("x0"), real(b["y0"]).alias("y0"), real(b["x1"]).alias("x1"), real(b["y1"]).alias("y1"))), lambda b: b["text"] != "")
    none = F.lit(None).cast("float")
    start = F.struct(F.lit("").alias("acc"), F.lit(False).alias("indent"), none.alias("right"), none.alias("bottom"), F.expr(_EMPTY).alias("out"))

    def paragraph(s: Column) -> Column:
        return F.array(F.struct(s["acc"].alias("text"), s["indent"].alias("first_line_indent")))

    def step(s: Column, b: Column) -> Column:
        indented = b["x0"] - stats["left"] > times(INDENT)
        returns = (stats["right"] - s["right"] > times(SHORT)) & (b["x0"] - stats["left"] <= times(BACK))
        breaks = s["bottom"].isNotNull() & ((b["y0"] - s["bottom"] > times(GAP)) | indented | returns)
        opens = breaks | s["bottom"].isNull()
        return F.struct(
            F.when(breaks, b["text"]).otherwise(join_two(s["acc"], b["text"])).alias("acc"),
            F.when(opens, indented).otherwise(s["indent"]).alias("indent"),
            b["x1"].alias("right"),
            b["y1"].alias("bottom"),
            F.when(breaks, F.concat(s["out"], paragraph(s))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(shown, start, step, lambda s: F.when(s["acc"] == "", s["out"]).otherwise(F.concat(s["out"], paragraph(s))))


def native_paragraphs(text: Column) -> Column:
    """Array of texts: blank lines part paragraphs, other lines are joined."""
    lines = F.transform(F.split(text, r"\r?\n"), strip)
    start = F.struct(F.lit("").alias("acc"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(s: Column, line: Column) -> Column:
        ends = (line == "") & (s["acc"] != "")
        acc = F.when(line == "", F.lit("")).otherwise(join_two(s["acc"], line))
        return F.struct(acc.alias("acc"), F.when(ends, F.concat(s["out"], F.array(s["acc"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["acc"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["acc"]))))
