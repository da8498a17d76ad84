"""The recognition pipeline around three networks, as one pass over rows of images.

The networks' weights are no part of this package: `Models` loads them from files that the caller ships, and says plainly
which file is missing. Sessions are made once for a Python worker. Rows never meet, so there is no shuffle; images are rows
of raw RGB bytes, and a small Arrow batch bounds memory.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelight.operators import geometry as g
from quirelight.operators.decode import BATCH, HEIGHT, LEAST_RATIO, ROTATE_FROM
from quirelight.operators.frames import DETECT_SIDE, LEAST_HEIGHT, LEAST_SIDE, MOST_SIDE, TEXT_SCORE, WIDE_RATIO

#: Input of the direction classifier; a fixed value.
TURN_HEIGHT, TURN_WIDTH = 48, 192
NAMES = ("detect", "turn", "recognise")
LINES = "array<struct<box:array<array<int>>,text:string,score:double>>"
_sessions: dict[str, Models] = {}


class Models:
    """Three networks as functions from an input tensor to an output array, and the recogniser's alphabet."""

    def __init__(self, folder: str) -> None:
        import onnxruntime

        missing = [f"{folder}/{n}.onnx" for n in NAMES if not os.path.isfile(f"{folder}/{n}.onnx")]
        if missing:
            raise FileNotFoundError(f"model files are not here: {', '.join(missing)}")
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        made = {n: onnxruntime.InferenceSession(f"{folder}/{n}.onnx", options, providers=["CPUExecutionProvider"]) for n in NAMES}
        run = lambda s: lambda x: s.run(None, {s.get_inputs()[0].name: x.astype(np.float32)})[0]
        self.detect, self.turn, self.recognise = (run(made[n]) for n in NAMES)
        listed = made["recognise"].get_modelmeta().custom_metadata_map["character"].splitlines()
        self.alphabet = ["", *listed, " "]


def models(folder: str) -> Models:
    """The worker's models, loaded when first asked for (M1)."""
    if folder not in _sessions:
        _sessions[folder] = Models(folder)
    return _sessions[folder]


def png_pixels(raw: bytes) -> np.ndarray | None:
    """Pixels of a PNG with 8 bits a channel and no interlacing; null for any other file."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y, line in enumerate(lines):
        how, row = int(line[0]), line[1:].copy()
        if how == 1:
            row = np.cumsum(row.reshape(w, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            row = row + above
        elif how in (3, 4):
            for i in range(len(row)):
                a = int(row[i - channels]) if i >= channels else 0
                b, c = int(above[i]), int(above[i - channels]) if i >= channels else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                row[i] = (int(row[i]) + guess) & 255
        out[y] = above = row
    px = out.reshape(h, w, channels)
    if head[3] == 3:
        return palette[px[:, :, 0]]
    return px[:, :, :3] if channels >= 3 else np.repeat(px[:, :, :1], 3, axis=2)


def detect(run: Callable, img: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Text boxes of an image (M2)."""
    h, w = img.shape[:2]
    scale = np.float32(DETECT_SIDE) / np.float32(min(w, h)) if min(w, h) < DETECT_SIDE else np.float32(1)
    side = lambda v: max(32, int(round(int(np.float32(v) * scale) / 32)) * 32)
    prob = np.asarray(run(g.to_tensor(g.resize(img, side(w), side(h)))[None]))
    return g.boxes_from_map(prob.reshape(prob.shape[-2:]), w, h)


def upright(run: Callable, crop: np.ndarray) -> np.ndarray:
    """A crop turned by half where the classifier says that it stands on its head (M3)."""
    width = min(TURN_WIDTH, max(1, int(np.ceil(TURN_HEIGHT * crop.shape[1] / crop.shape[0]))))
    x = np.zeros((1, 3, TURN_HEIGHT, TURN_WIDTH), np.float32)
    x[0, :, :, :width] = g.to_tensor(g.resize(crop, width, TURN_HEIGHT))
    e = np.exp(np.asarray(run(x)).reshape(-1)[:2])
    return crop[::-1, ::-1] if e[1] / e.sum() > ROTATE_FROM else crop


def recognise(run: Callable, alphabet: list[str], crops: list[np.ndarray]) -> list[tuple[str, float]]:
    """Text and score of crops, six at a time by aspect ratio, padded to the widest: the padding is part of the model (M4)."""
    out: list[tuple[str, float]] = [("", 0.0)] * len(crops)
    order = sorted(range(len(crops)), key=lambda i: crops[i].shape[1] / max(crops[i].shape[0], 1))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        ratio = max([LEAST_RATIO, *(crops[i].shape[1] / max(crops[i].shape[0], 1) for i in part)])
        width = int(HEIGHT * ratio)
        x = np.zeros((len(part), 3, HEIGHT, width), np.float32)
        for k, i in enumerate(part):
            w = min(width, max(1, int(np.ceil(HEIGHT * crops[i].shape[1] / crops[i].shape[0]))))
            x[k, :, :, :w] = g.to_tensor(g.resize(crops[i], w, HEIGHT))
        for i, scores in zip(part, np.asarray(run(x)), strict=True):
            best = scores.shape[1] - 1 - scores[:, ::-1].argmax(axis=1)  # of equal scores the last
            keep = (best != 0) & (best != np.concatenate([[-1], best[:-1]])) & (best < len(alphabet))
            out[i] = "".join(alphabet[c] for c in best[keep]), float(scores.max(axis=1)[keep].mean()) if keep.any() else 0.0
    return out


def read_page(m, img: np.ndarray) -> list[dict]:
    """Lines of an image: frame, boxes in row order, crops, directions, text, and boxes back in the image (M5)."""
    raw_h, raw_w = img.shape[:2]
    w, h = float(raw_w), float(raw_h)
    for needed, ratio in ((lambda: max(w, h) > MOST_SIDE, lambda: MOST_SIDE / max(w, h)), (lambda: min(w, h) < LEAST_SIDE, lambda: LEAST_SIDE / min(w, h))):
        if needed():
            k = ratio()
            w, h = float(int(w * k)), float(int(h * k))
    frame = g.resize(img, int(w), int(h))
    pad = 0
    if h <= LEAST_HEIGHT or w / h > WIDE_RATIO:
        pad = abs(max(int(w / WIDE_RATIO), LEAST_HEIGHT) * 2 - int(h)) // 2
        frame = np.pad(frame, ((pad, pad), (0, 0), (0, 0)))
    found = detect(m.detect, frame)
    found = [found[i][0] for i in g.row_order([tuple(b[0].tolist()) for b, _ in found])]
    crops = [upright(m.turn, g.crop(frame, b)) for b in found]
    out = []
    for box, (text, score) in zip(found, recognise(m.recognise, m.alphabet, crops), strict=True):
        if score >= TEXT_SCORE:
            back = np.floor((box - [0, pad]) * [raw_w / w, raw_h / h] + 0.5)
            out.append({"box": np.clip(back, 0, [raw_w, raw_h]).astype(int).tolist(), "text": text, "score": score})
    return out


def read_images(images: DataFrame, keys: list[str], folder: str, content: str = "content") -> DataFrame:
    """keys, lines: the recognised lines of PNG images; null for other files (M5, M6)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keys).schema) + f", lines {LINES}"
    kind = pa.list_(pa.struct([("box", pa.list_(pa.list_(pa.int32()))), ("text", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models(folder)
        for batch in batches:
            pages = [png_pixels(x or b"") for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([None if p is None else read_page(m, p) for p in pages], kind)], [*keys, "lines"])

    return images.select(*keys, content).mapInArrow(run, schema)
