"""What several operators of this subpackage share.

Durable intermediate tables, broadcast bitmaps of a fixed size, slices of Arrow text columns, and
word hashing in numpy. None of it collects anything whose size grows with the input.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most; with it the memory of a Python worker stays bounded on long texts.
BATCH_ROWS = 1000
#: Bytes of text that numpy code works on at once.
SLICE_BYTES = 1 << 20
#: Folder that holds the package; executors import it from there or from a shipped archive.
ROOT = Path(__file__).resolve().parents[2]


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and ship the package to executors if their path does not hold it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or getattr(context, "_quirelight_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "quirelight_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "quirelight").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._quirelight_shipped = True


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only local mode may go without the setting: a temporary folder serves there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirelight_")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Intermediate tables of this process lie in one folder below the shared one.
_RUN = uuid.uuid4().hex


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; for when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/quirelight/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/quirelight/{_RUN}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """The driver gives back what its last passes left. Finished plans, results and broadcasts are garbage, but its heap grows to
    its limit before it is collected, and what the JVM (its compiler, mostly) and Python have freed stays with their allocator."""
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    give_back()
    # malloc_trim in the JVM; py4j finds the server's method by its interface alone. A JVM without the command keeps the memory
    try:
        ask = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        ask.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


class Shipped:
    """A broadcast array of fixed size. Its one broadcast copy is compressed; a task unpacks it when it first asks for its value."""

    def __init__(self, spark: SparkSession, array: np.ndarray) -> None:
        self._kind, self._bytes = array.dtype.str, array.nbytes
        self._held = spark.sparkContext.broadcast(pa.compress(array.tobytes(), codec="zstd", asbytes=True))
        self._array: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_array": None}

    @property
    def value(self) -> np.ndarray:
        if self._array is None:
            self._array = np.frombuffer(pa.decompress(self._held.value, self._bytes, codec="zstd"), self._kind)
        return self._array

    def free(self) -> None:
        """For when all that reads it has been written: no copy stays with the driver or an executor."""
        self._held.destroy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def total_bytes(df: DataFrame, text: Column) -> int:
    """Bytes of text in a table; sizes the number of blocks, never what is read."""
    return int(df.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A cache of a Python worker that outlives a pass: tasks of the same stage go on with it, a lean pass of another empties it."""
    return _caches.setdefault(name, {})


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same pass, whose worker gives freed memory back to the system at its end: Spark keeps workers for later stages.

    At its start it drops the caches that other passes left in the worker, all but the one of this name.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        yield from run(batches)
        give_back()

    return passed


def drop_caches(keeps: str) -> None:
    left = [c for name, c in _caches.items() if c and name != keeps]
    for c in left:
        c.clear()
    if left:
        gc.collect()
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- Arrow text columns -------------------------------------------------------------------------


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (rows + 1) of a string column without nulls; no copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each, one row at least."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


# --- Word hashes --------------------------------------------------------------------------------


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on uint64 values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between words where punctuation does not count: all of ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15 | 1
_BYTE = splitmix(np.arange(256, dtype=np.uint64))[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each run without white space; texts are data[starts[i]:ends[i]], adjoining."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts < ends)]
    first[cut] = inside[cut]
    cut = ends[(starts < ends)] - 1
    last[cut] = inside[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, and the offsets (rows + 1) of each row's words.

    A word's hash is a polynomial over random 64-bit byte codes, from prefix sums of the slice.
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    bounds = offsets - base
    begin, end = word_spans(data, bounds[:-1], bounds[1:], space)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = splitmix((sums[end] - sums[begin]) * down[begin])
    return hashes, np.searchsorted(begin, bounds)


def ordered(keys: np.ndarray) -> np.ndarray:
    """The different keys in order. A plain sort takes a quarter of the time of np.unique's hash table on such keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each element, from offsets (rows + 1)."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


# --- Bitmaps sized from a count --------------------------------------------------------------------

_SEGMENTS = 64


def bitmap_bits(count: int) -> int:
    """Bits of a membership bitmap for so many keys: some 16 a key, from 2 MB to 256 MB, whatever the input. Beyond
    10^8 keys it fills up, which lets more rows through to the exact step and changes no result."""
    return 1 << min(31, max(24, (16 * count).bit_length()))


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return splitmix(keys.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)


def _bitmap_or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd"), np.uint8)
            acc[s] = (acc[s] | v) if s in acc else v.copy()
    keep = sorted(acc)
    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), packed([pa.compress(acc[s].tobytes(), codec="zstd", asbytes=True) for s in keep])], ["segment", "bits"])


def key_bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """Packed bits: which hash slots the single bigint column's values take; count is a bound on the different keys."""
    bits = bitmap_bits(count)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(taken, (slot >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8))
        pieces = taken.reshape(_SEGMENTS, -1)
        keep = [i for i in range(_SEGMENTS) if pieces[i].any()]
        held = [pieces[i].tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), packed([len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in held])], ["segment", "bits"])

    out = np.zeros((_SEGMENTS, bits // 8 // _SEGMENTS), np.uint8)
    for r in keys.mapInArrow(lean(parts), "segment int, bits binary").repartition(_SEGMENTS, "segment").mapInArrow(lean(_bitmap_or), "segment int, bits binary").collect():
        out[r["segment"]] = np.frombuffer(pa.decompress(r["bits"], out.shape[1], codec="zstd"), np.uint8)
    return out.reshape(-1)


def in_bitmap(packed_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slot(keys, 8 * len(packed_bits))
    return (packed_bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1


# --- Connected components -----------------------------------------------------------------------

#: Nodes with this share of all edge ends go by broadcast: 64 nodes at most.
_HOT_NODE = 1 / 64


def _with_least(edges: DataFrame, ends: int) -> DataFrame:
    """(a, b, m): edges with the smallest neighbour of a, or a itself; no node's edges meet in one task."""
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    hot = F.col("degree") >= max(2, int(ends * _HOT_NODE))
    # at most 1 / _HOT_NODE nodes
    first = edges.join(F.broadcast(low.filter(hot).drop("degree")), "a", "left")
    rest = first.filter("m IS NULL").select("a", "b").join(low.filter(~hot).drop("degree"), "a")
    return first.filter("m IS NOT NULL").unionByName(rest)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b), as alternating
    large-star and small-star steps, written to the shared folder each. The rounds grow with the logarithm of a component's
    size; where they do not settle, an error is raised.
    """
    edges = durable(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for step in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node move to the smallest in its neighbourhood
        large = _with_least(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the smallest of them
        down = durable(large.filter("a <> b").distinct(), f"down{step}")
        small = _with_least(down, down.count()).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = durable(small.filter("a <> b").distinct(), f"edges{step}")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
