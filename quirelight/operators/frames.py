"""Sizes and frames of page images, detection filters, and the way back to image coordinates. Plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import let

# Fixed values of the pipeline and the detector.
MOST_SIDE, LEAST_SIDE, WIDE_RATIO, LEAST_HEIGHT, TEXT_SCORE = 2000, 30, 8, 30, 0.5
DETECT_SIDE, BOX_SCORE, CANDIDATES, MIN_SIZE, UNCLIP, MOST_PIXELS = 736, 0.5, 1000, 3, 1.6, 40_000_000
NATIVE_CHARS, SCAN_COVER = 10, 0.7


def to_32(v: Column) -> Column:
    """A multiple of 32, halves to even (G1)."""
    return (F.bround(v / 32) * 32).cast("int")


def normal_size(w: Column, h: Column) -> Column:
    """Side normalisation: a longest side over 2000 shrinks, then a shortest under 30 grows, both cut to whole pixels.

    Returns width, height and the ratios of the old sides to the new (G2).
    """
    w, h = w.cast("double"), h.cast("double")

    def scaled(size: Column, when: Column, ratio: Column) -> tuple[Column, Column]:
        part = lambda k: F.when(when, F.floor(size[k] * ratio).cast("double")).otherwise(size[k])
        return part("w"), part("h")

    start = F.struct(w.alias("w"), h.alias("h"))
    sides = scaled(start, F.greatest(w, h) > MOST_SIDE, MOST_SIDE / F.greatest(w, h))
    small = F.struct(sides[0].alias("w"), sides[1].alias("h"))
    nw, nh = scaled(small, F.least(*sides) < LEAST_SIDE, LEAST_SIDE / F.least(*sides))
    return F.struct(nw.cast("int").alias("width"), nh.cast("int").alias("height"), (w / nw).alias("ratio_w"), (h / nh).alias("ratio_h"))


def letterbox(w: Column, h: Column) -> Column:
    """Padding above and below a strip that is over 8 times as wide as high, or at most 30 high (G3). It lies along y."""
    strip = (w / h > WIDE_RATIO) | (h <= LEAST_HEIGHT)
    new_h = F.greatest(F.floor(w / WIDE_RATIO).cast("int"), F.lit(LEAST_HEIGHT)) * 2
    pad = F.when(strip, F.floor(F.abs(new_h - h) / 2).cast("int")).otherwise(0)
    return F.struct((h + 2 * pad).cast("int").alias("height"), pad.alias("pad_top"))


def detector_size(w: Column, h: Column) -> Column:
    """Input size of the detector: the shortest side grows to 736, truncated, then to multiples of 32."""
    real = lambda v: v.cast("float")
    shortest = F.least(w, h)
    scale = F.when(shortest < DETECT_SIDE, (real(F.lit(DETECT_SIDE)) / real(shortest)).cast("float")).otherwise(real(F.lit(1.0)))
    side = lambda v: to_32(F.floor((real(v) * scale).cast("float")))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def to_image(v: Column, pad: Column, ratio: Column, side: Column) -> Column:
    """A frame coordinate back in the image, rounded and kept inside."""
    return F.least(F.greatest(F.round((v - pad) * ratio), F.lit(0.0)), side.cast("double")).cast("int")


def quad_measures(p: Column) -> Column:
    """Area, perimeter, orientation and unclip distance of an array of (x, y) points."""
    return let(p, _measures)


def _measures(p: Column) -> Column:
    n = F.size(p)
    nxt = lambda i: F.get(p, (i + 1) % n)
    cross = F.aggregate(F.transform(p, lambda a, i: a["x"] * nxt(i)["y"] - nxt(i)["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    around = F.aggregate(F.transform(p, lambda a, i: F.hypot(nxt(i)["x"] - a["x"], nxt(i)["y"] - a["y"])), F.lit(0.0), lambda s, v: s + v)
    area = F.abs(cross) / 2
    return F.struct(area.alias("area"), around.alias("perimeter"), F.signum(cross).alias("sign"), F.when(around > 0, area * UNCLIP / around).otherwise(0.0).alias("distance"))


def corner_order(p: Column) -> Column:
    """Four points sorted by x, then each pair by y: top left, top right, bottom right, bottom left."""
    return let(F.array_sort(p), _corners)


def _corners(s: Column) -> Column:
    left = F.when(s[1]["y"] > s[0]["y"], F.array(s[0], s[1])).otherwise(F.array(s[1], s[0]))
    right = F.when(s[3]["y"] > s[2]["y"], F.array(s[2], s[3])).otherwise(F.array(s[3], s[2]))
    return F.array(left[0], right[0], right[1], left[1])


def kept_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Detections that stay: the first 1000 in scan order, then by size and score.

    Columns short_side, score, path_points, expanded_side, seed_y, seed_x.
    """
    scan = Window.partitionBy(*keys).orderBy("seed_y", "seed_x")
    first = boxes.withColumn("candidate", F.row_number().over(scan)).filter(F.col("candidate") <= CANDIDATES)
    return first.filter((F.col("short_side") >= MIN_SIZE) & (F.col("score") >= BOX_SCORE) & (F.col("path_points") >= 4) & (F.col("expanded_side") >= MIN_SIZE + 2))


def confident(score: Column) -> Column:
    """Recognised lines that stay."""
    return score >= TEXT_SCORE


def route(n_chars: Column) -> Column:
    """native for pages with text, ocr for others."""
    return F.when(F.coalesce(n_chars, F.lit(0)) >= NATIVE_CHARS, "native").otherwise("ocr")


def raster_side(points: Column, dpi: Column) -> Column:
    """Pixels of a page side at a resolution, between 32 and 65000."""
    return F.least(F.greatest(F.round(points * dpi / 72), F.lit(32.0)), F.lit(65000.0)).cast("int")


def too_large(w: Column, h: Column) -> Column:
    """Images over 40 million pixels, by their header alone."""
    return w.cast("bigint") * h > MOST_PIXELS


def twips(points: Column) -> Column:
    """Points to twentieths of a point."""
    return F.round(points * 20).cast("int")


def media_side(low: Column, high: Column, default: float) -> Column:
    """A page side from its media box, or the default."""
    return F.coalesce(F.when(F.abs(high - low) > 0, F.abs(high - low)), F.lit(default))


_MATRIX = "array<double>"


def scan_cover(ops: Column) -> Column:
    """Area that images cover, from an array of (op, m, image) graphics operators.

    q saves the matrix, Q restores it (the unit matrix where nothing was saved), cm multiplies, Do of an image adds |det|.
    """
    unit = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)])
    start = F.struct(unit.alias("m"), F.expr(f"CAST(array() AS array<{_MATRIX}>)").alias("stack"), F.lit(0.0).alias("area"))

    def times(a: Column, b: Column) -> Column:
        cell = lambda i, j: a[2 * i] * b[j] + a[2 * i + 1] * b[2 + j]
        return F.array(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), cell(2, 0) + b[4], cell(2, 1) + b[5])

    def step(s: Column, o: Column) -> Column:
        m = F.when(o["op"] == "cm", times(o["m"], s["m"])).when(o["op"] == "Q", F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), unit)).otherwise(s["m"])
        stack = F.when(o["op"] == "q", F.concat(s["stack"], F.array(s["m"]))).when(o["op"] == "Q", F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        det = F.abs(s["m"][0] * s["m"][3] - s["m"][1] * s["m"][2])
        return F.struct(m.alias("m"), stack.alias("stack"), (s["area"] + F.when((o["op"] == "Do") & o["image"], det).otherwise(0.0)).alias("area"))

    return F.aggregate(ops, start, step, lambda s: s["area"])


def is_scan(ops: Column, width: Column, height: Column) -> Column:
    """A page that images cover to 70 % or more."""
    return (width > 1) & (height > 1) & (scan_cover(ops) / (width * height) >= SCAN_COVER)


def strips_text(replace: Column, blocks: Column, scan: Column) -> Column:
    """Whether a page's own text operators are removed."""
    return replace & (F.size(blocks) > 0) & scan


def shows_text(op: Column) -> Column:
    """Text-showing operators."""
    return op.isin("Tj", "TJ", "'", '"')
