"""Rows of raw images: resized, cropped, degraded, compared. An image is bytes of height x width x channels.

Images never meet other rows, so each operator is one mapInArrow pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelight.operators import geometry
from quirelight.operators.geometry import row_pass

IMAGE = ["pixels", "width", "height", "channels"]


def image_of(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def resized(images: DataFrame, keys: list[str], width: str, height: str) -> DataFrame:
    """keys, pixels, mean: images at another size, and the mean of the values a network gets."""

    def make(pixels, w, h, c, to_w, to_h):
        out = geometry.resize(image_of(pixels, w, h, c), to_w, to_h)
        return out.tobytes(), float(geometry.to_tensor(out).astype(np.float64).mean())

    return row_pass(images, keys, [*IMAGE, width, height], "pixels binary, mean double", [pa.binary(), pa.float64()], make)


def cropped(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pixels, width, height: the content of `quad`, four points, upright."""

    def make(pixels, w, h, c, quad):
        out = geometry.crop(image_of(pixels, w, h, c), np.array(quad, float))
        return out.tobytes(), out.shape[1], out.shape[0]

    return row_pass(images, keys, [*IMAGE, "quad"], "pixels binary, width int, height int", [pa.binary(), pa.int32(), pa.int32()], make)


def word_quads(crops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words: boxes in the image of words along a crop, from cells, quad, width, height, turned."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("quad", pa.list_(pa.list_(pa.int32())))]))

    def make(cells, quad, w, h, turned):
        found = geometry.word_quads(cells or [], np.array(quad, float), w, h, bool(turned))
        return ([{"text": t, "quad": q.tolist()} for t, q in found],)

    return row_pass(crops, keys, ["cells", "quad", "width", "height", "turned"], "words array<struct<text:string,quad:array<array<int>>>>", [kind], make)


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, difference: mean absolute difference of `a` and `b` (pixels, width, height, channels); -1 where sizes differ."""

    def make(a, b):
        x, y = (image_of(*(i[f] for f in IMAGE)) for i in (a, b))
        return (geometry.mean_difference(x, y),)

    return row_pass(pairs, keys, ["a", "b"], "difference double", [pa.float64()], make)


def degraded(images: DataFrame, keys: list[str], kind: str, seed: str) -> DataFrame:
    """keys, pixels: copies degraded by the kind that a column names; noise by the seed of its row (M8)."""
    make = lambda pixels, w, h, c, k, s: (geometry.degrade(image_of(pixels, w, h, c), k, s).tobytes(),)
    return row_pass(images, keys, [*IMAGE, kind, seed], "pixels binary", [pa.binary()], make)
