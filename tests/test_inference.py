"""The pipeline around the networks, with plain functions in their place."""

from __future__ import annotations

import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from quirelight.operators import inference as inf


def png(px, kinds):
    h, w, c = px.shape
    rows, above = [], np.zeros(w * c, int)
    for y in range(h):
        row = px[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(c, int), row[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        a, b, d = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kinds[y % len(kinds)]]
        rows.append(bytes([kinds[y % len(kinds)]]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    px = np.random.default_rng(0).integers(0, 256, (10, 7, channels)).astype(np.uint8)
    assert (inf.png_pixels(png(px, [0, 1, 2, 3, 4])) == px[:, :, :3]).all()
    assert inf.png_pixels(b"\xff\xd8") is None


def test_missing_models_are_named(tmp_path):
    with pytest.raises(FileNotFoundError, match="detect.onnx"):
        inf.Models(str(tmp_path))


def test_batches_keep_the_order_of_crops():
    seen = []

    def run(x):
        seen.append(x.shape)
        out = np.zeros((len(x), 3, 4), np.float32)
        out[:, 0, 1] = out[:, 1, 1] = 0.9
        out[:, 2, 2] = 0.8
        return out

    crops = [np.full((10, w, 3), 200, np.uint8) for w in (100, 20, 60, 30, 10, 90, 80)]
    got = inf.recognise(run, ["", "a", "b", " "], crops)
    assert [s[0] for s in seen] == [6, 1] and seen[0][3] == 48 * 9 and seen[1][3] == 48 * 10
    assert all(t == "ab" and s == pytest.approx(0.85) for t, s in got)


def test_a_page_is_read():
    img = np.zeros((736, 736, 3), np.uint8)
    img[100:140, 100:400] = 255

    def detect(x):
        return (x[:, :1] > 0).astype(np.float32)

    m = SimpleNamespace(detect=detect, turn=lambda x: np.array([[3.0, 0.0]]), recognise=lambda x: np.array([[[0.1, 0.9], [0.8, 0.2]]] * len(x)), alphabet=["", "x"])
    (line,) = inf.read_page(m, img)
    assert line["text"] == "x" and line["score"] == pytest.approx(0.9)
    (x0, y0), _, (x1, y1), _ = line["box"]
    assert x0 < 100 and y0 < 100 and x1 > 395 and y1 > 135
