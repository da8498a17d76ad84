"""Harmonic packing of token streams into sequences of a fixed capacity.

Harmonic packing puts a length into class k when k such lengths fill a bin, and closes a bin of class k
after exactly k pieces; workers need not talk to each other. Documents may be cut here, so each document is
cut at the binary digits of its length: whole sequences first, then pieces of capacity/2, capacity/4, ... 1
tokens. A class then holds pieces of exactly capacity/k tokens and its full bins have no padding. The bin
that a worker leaves open in a class holds m < k pieces; it is closed as sequences of the binary digits of m,
whose lengths are powers of two and need no padding either.

Defined results: a null text counts as empty and gives its closing id alone; repeated rows are packed once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import prepare, text_of
from quirelight.llm.tokens import tokenising, word_token_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then its length's binary digits, largest first."""
    out, at = [], 0
    while tokens - at >= capacity:
        out.append((at, capacity))
        at += capacity
    size = capacity >> 1
    while size:
        if (tokens - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


class Bins:
    """The open bins of one worker. A full bin goes out at once; drain() closes what is left without padding."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple], length: int) -> Iterator[tuple]:
        for i, p in enumerate(pieces):
            yield (*p, self.next_id, i * length)
        self.next_id += 1

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) * length == self.capacity:
            self.open[length] = []
            yield from self._close(bin_, length)

    def drain(self) -> Iterator[tuple]:
        for length, bin_ in sorted(self.open.items()):
            while bin_:
                n = 1 << (len(bin_).bit_length() - 1)
                yield from self._close(bin_[:n], length)
                bin_ = bin_[n:]
        self.open = {}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of each document; capacity is a power of two. No shuffle: every partition packs its own."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_token_ids(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                raw += end
                n = len(raw) // 4
                for start, length in cuts(n, capacity):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.extend(bins.add((doc_id, start, length, crc, n), length))
            yield _batch(rows)
        yield _batch(list(bins.drain()))

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(tokenising(run), SCHEMA)
