"""Recogniser output: greedy decoding, words of characters, character boxes, batching, direction. Row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import is_cjk, let

# Fixed values of the recogniser.
HEIGHT, LEAST_RATIO, BATCH, COLUMN_GAP, ROTATE_FROM = 48, 320 / 48, 6, 4, 0.9


def last_argmax(scores: Column) -> Column:
    """Index of the largest score; of equal ones the last."""
    n = F.size(scores)
    return (n - F.array_position(F.reverse(scores), F.array_max(scores))).cast("int")


def greedy_decode(steps: Column, alphabet: Column) -> Column:
    """Text, score and selected steps of an array of score arrays.

    Class 0 is blank; a class that the step before had is dropped, and one that the alphabet lacks is skipped.
    """
    classes = F.transform(steps, lambda s, t: F.struct(last_argmax(s).alias("c"), F.array_max(s).alias("p"), t.alias("t")))
    return let(classes, lambda c: let(_fresh(c, alphabet), lambda f: _decoded(f, alphabet)))


def _fresh(classes: Column, alphabet: Column) -> Column:
    """Steps with a class that is no blank, no repeat and in the alphabet."""
    before = F.concat(F.array(F.lit(-1)), F.transform(classes, lambda x: x["c"]))
    pairs = F.zip_with(classes, F.slice(before, F.lit(1), F.size(classes)), lambda x, b: F.struct(x["c"].alias("c"), x["p"].alias("p"), x["t"].alias("t"), b.alias("b")))
    return F.filter(pairs, lambda x: (x["c"] != 0) & (x["c"] != x["b"]) & (x["c"] < F.size(alphabet)))


def _decoded(fresh: Column, alphabet: Column) -> Column:
    score = F.when(F.size(fresh) > 0, F.aggregate(fresh, F.lit(0.0), lambda a, x: a + x["p"]) / F.size(fresh)).otherwise(F.lit(0.0))
    text = F.array_join(F.transform(fresh, lambda x: F.element_at(alphabet, x["c"] + 1)), "")
    return F.struct(text.alias("text"), score.alias("score"), F.transform(fresh, lambda x: x["t"]).alias("selection"))


def word_groups(chars: Column, selection: Column) -> Column:
    """Groups of recognised characters: one ends where the script class changes or columns are over 4 apart."""
    state = lambda c: F.when(is_cjk(c, False), F.lit("cn")).otherwise(F.lit("en&num"))
    gap = lambda i: F.when(i > 0, F.get(selection, i) - F.get(selection, i - 1)).otherwise(F.lit(0))
    items = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.get(selection, i).alias("col"), state(c).alias("state"), gap(i).alias("gap")))
    start = F.expr("CAST(array() AS array<struct<text:string,cols:array<int>,state:string>>)")

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        new = last.isNull() | (last["state"] != x["state"]) | (x["gap"] > COLUMN_GAP)
        one = F.struct(x["c"].alias("text"), F.array(x["col"]).alias("cols"), x["state"].alias("state"))
        longer = F.struct(F.concat(last["text"], x["c"]).alias("text"), F.concat(last["cols"], F.array(x["col"])).alias("cols"), last["state"].alias("state"))
        return F.when(new, F.concat(out, F.array(one))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(items, start, step)


def group_cell_width(cols: Column, cell: Column) -> Column:
    """Average width of a group's characters; null for fewer than two columns."""
    return F.when(F.size(cols) >= 2, (F.element_at(cols, -1) - F.get(cols, F.lit(0))) * cell / (F.size(cols) - 1))


def character_cells(groups: Column, width: Column, columns: Column, n_chars: Column) -> Column:
    """Boxes of characters along a crop (G20, A13, O6, W7): CJK first, others after, sorted by x, overlaps shared."""
    cell = width / columns

    page = F.struct(groups.alias("groups"), width.alias("width"), cell.alias("cell"), n_chars.alias("n"))
    return let(page, lambda p: _cells(p["groups"], p["width"], p["cell"], p["n"]))


def _cells(groups: Column, width: Column, cell: Column, n_chars: Column) -> Column:
    def of(state: str) -> Column:
        own = F.filter(groups, lambda g: g["state"] == state)
        widths = F.filter(F.transform(own, lambda g: group_cell_width(g["cols"], cell)), lambda w: w.isNotNull())
        mean = F.when(F.size(widths) > 0, F.aggregate(widths, F.lit(0.0), lambda a, w: a + w) / F.size(widths)).otherwise(width / F.greatest(n_chars, F.lit(1)))
        pairs = F.flatten(F.transform(own, lambda g: F.transform(g["cols"], lambda c, i: F.struct(c.alias("col"), F.substring(g["text"], i + 1, F.lit(1)).alias("text")))))
        centre = lambda p: (p["col"] + 0.5) * cell
        box = lambda p, m: F.struct(F.floor(F.greatest(centre(p) - m / 2, F.lit(0.0))).cast("double").alias("x0"), F.floor(F.least(centre(p) + m / 2, width)).cast("double").alias("x1"), p["text"].alias("text"))
        return let(mean, lambda m: F.transform(pairs, lambda p: box(p, m)))

    both = F.concat(of("cn"), of("en&num"))
    keyed = F.transform(both, lambda b, i: F.struct(b["x0"].alias("x0"), i.alias("i"), b["x1"].alias("x1"), b["text"].alias("text")))
    return share_overlaps(F.transform(F.array_sort(keyed), lambda b: F.struct(b["x0"].alias("x0"), b["x1"].alias("x1"), b["text"].alias("text"))))


def share_overlaps(boxes: Column) -> Column:
    """Neighbours that overlap give up half each, from left to right; a moved edge counts for the next pair."""
    start = F.expr("CAST(array() AS array<struct<x0:double,x1:double,text:string>>)")

    def step(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        over = F.greatest(last["x1"] - b["x0"], F.lit(0.0))
        cut = F.struct(last["x0"].alias("x0"), (last["x1"] - over / 2).alias("x1"), last["text"].alias("text"))
        moved = F.struct((b["x0"] + (over - over / 2)).alias("x0"), b["x1"].alias("x1"), b["text"].alias("text"))
        return F.when(last.isNull(), F.array(b)).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(cut, moved)))

    return F.filter(F.aggregate(boxes, start, step), lambda b: (b["text"] != "") & (b["x1"] > b["x0"]))


def space_words(chars: Column, boxes: Column) -> Column:
    """Words of characters between spaces with the bounds of their boxes (W6); null where the lengths differ.

    A box is a struct of x0, y0, x1, y1.
    """
    pairs = F.arrays_zip(chars.alias("c"), boxes.alias("b"))
    start = F.struct(F.lit(True).alias("new"), F.expr("CAST(array() AS array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>)").alias("out"))
    real = lambda p, k: p["b"][k].cast("double")

    def step(s: Column, p: Column) -> Column:
        last = F.try_element_at(s["out"], F.lit(-1))
        one = F.struct(p["c"].alias("text"), *[real(p, k).alias(k) for k in ("x0", "y0", "x1", "y1")])
        wider = F.struct(F.concat(last["text"], p["c"]).alias("text"), F.least(last["x0"], real(p, "x0")).alias("x0"), F.least(last["y0"], real(p, "y0")).alias("y0"), F.greatest(last["x1"], real(p, "x1")).alias("x1"), F.greatest(last["y1"], real(p, "y1")).alias("y1"))
        kept = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        out = F.when(s["new"], F.concat(s["out"], F.array(one))).otherwise(F.concat(kept, F.array(wider)))
        return F.struct((p["c"] == " ").alias("new"), F.when(p["c"] == " ", s["out"]).otherwise(out).alias("out"))

    return F.when(F.size(chars) == F.size(boxes), F.aggregate(pairs, start, step, lambda s: s["out"]))


def batches(crops: DataFrame, keys: list[str], width: str, height: str, order: str) -> DataFrame:
    """Recognition batches within a page: by aspect ratio, six at a time, as wide as the widest."""
    ratio = F.col(width).cast("float") / F.col(height).cast("float")
    page = Window.partitionBy(*keys).orderBy("ratio", order)
    out = crops.withColumn("ratio", F.when(F.col(height) == 0, F.lit(float("nan")).cast("float")).otherwise(ratio)).withColumn("batch", F.floor((F.row_number().over(page) - 1) / BATCH).cast("int"))
    widest = F.max(F.when(~F.isnan("ratio"), F.col("ratio"))).over(Window.partitionBy(*keys, "batch"))
    return out.withColumn("batch_ratio", F.greatest(F.lit(LEAST_RATIO).cast("float"), F.coalesce(widest, F.lit(0.0).cast("float"))))


def turned(upright: Column, rotated: Column) -> Column:
    """Whether a crop stands on its head: softmax of two scores over 0.9."""
    return F.exp(rotated) / (F.exp(upright) + F.exp(rotated)) > ROTATE_FROM
