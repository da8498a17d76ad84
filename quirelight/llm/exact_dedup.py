"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every document's normalised text is hashed (SHA-256); the hashes are written to the shared folder, in blocks.
2. A block sorts FINGERPRINT_BITS-bit fingerprints and sends each owner (the top bits) its share, as Golomb-Rice
   coded gaps: the unary quotients and the fixed-width remainders as two bit strings.
3. An owner decodes what it gets, and answers each block with a bitmap: which of its fingerprints occur twice or more.
4. Only suspects' texts are shuffled: a grouping by the whole normalised text compares them byte by byte, with partial
   aggregation first, so a task sends a text that it holds a thousand times once.
5. Classes go back to the suspects by hash. Classes with a HOT_SHARE of all rows number at most 1 / HOT_SHARE; they are
   broadcast, the others are joined with a shuffle, so no task gets a large class.

Defined results: a null text counts as empty; empty texts are equal; ties do not arise, as the smallest doc_id stays; rows
that repeat a doc_id and text are counted each and share their fate; a null doc_id is kept only if its class has no
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import Shipped, durable, in_bitmap, key_bitmap, lean, packed, prepare, settle, text_of

FINGERPRINT_BITS = 48
#: A class with this share of all suspects goes by broadcast: 64 classes at most.
HOT_SHARE = 1 / 64
NORMAL = r"[\x20\x09-\x0D]+"


def golomb_encode(values: np.ndarray, width: int) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and remainders of the gaps between sorted values below 2**width."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1, int(values[-1]) // len(values)) if len(values) else 1
    k = min(width, max(0, mean.bit_length() - 1))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _fingerprints(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), ">u8").astype(np.uint64)
    return raw >> np.uint64(64 - FINGERPRINT_BITS)


def suspects(hashes: DataFrame, owners: int) -> DataFrame:
    """(doc_id, sha, suspect) from (block, doc_id, sha): whether another row has the fingerprint."""
    owner_bits = max(1, (owners - 1).bit_length())
    low = FINGERPRINT_BITS - owner_bits

    def send(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        prints = np.sort(_fingerprints(group["sha"]))
        owner, first = np.unique(prints >> np.uint64(low), return_index=True)
        rows = []
        for o, part in zip(owner.tolist(), np.split(prints, first[1:]), strict=True):
            k, unary, rest = golomb_encode(part & np.uint64((1 << low) - 1), low)
            rows.append((block, o, len(part), k, unary, rest))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "owner", "n", "k", "unary", "rest"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [golomb_decode(*x) for x in zip(*(group[c].to_pylist() for c in ("n", "k", "unary", "rest")), strict=True)]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[counts > 1]
        bits = [np.packbits(np.isin(p, twice)).tobytes() for p in parts]
        return pa.Table.from_arrays([group["block"], group["owner"], group["n"], packed(bits)], ["block", "owner", "n", "bits"])

    def mark(group: pa.Table, answers: pa.Table) -> pa.Table:
        prints = _fingerprints(group["sha"])
        order = np.argsort(prints, kind="stable")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, n, b in sorted(zip(answers["owner"].to_pylist(), answers["n"].to_pylist(), answers["bits"].to_pylist(), strict=True))]
        out = np.empty(len(prints), bool)
        out[order] = np.concatenate(flags) == 1
        return pa.Table.from_arrays([group["doc_id"], group["sha"], pa.array(out)], ["doc_id", "sha", "suspect"])

    sent = hashes.groupBy("block").applyInArrow(send, "block int, owner int, n int, k int, unary binary, rest binary")
    answers = sent.groupBy("owner").applyInArrow(answer, "block int, owner int, n int, bits binary")
    return hashes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "doc_id long, sha binary, suspect boolean")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    normal = F.regexp_replace("text", NORMAL, " ")
    hashes = durable(texts.select(F.spark_partition_id().alias("block"), "doc_id", F.unhex(F.sha2(normal, 256)).alias("sha")), "hashes")
    blocks = int(hashes.agg(F.max("block")).first()[0] or 0) + 1
    marked = durable(suspects(hashes, max(64, blocks)), "marked")
    found = marked.filter("suspect")
    total = found.count()
    # some 16 bits a suspect say which doc_ids may be suspects; other rows that pass are groups of one
    shipped = Shipped(spark, key_bitmap(found.select(F.xxhash64("doc_id").alias("key")), total))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(shipped.value, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["doc_id", "text"]).filter(pa.array(keep))

    possible = texts.select(F.xxhash64("doc_id").alias("key"), "doc_id", "text").mapInArrow(lean(only), "doc_id long, text string")
    classes = possible.groupBy(normal.alias("normal")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = durable(classes.filter("group_size > 1").select(F.unhex(F.sha2("normal", 256)).alias("sha"), "keep_id", "group_size"), "classes")
    shipped.free()
    settle(spark)
    hot = F.col("group_size") >= max(2, int(total * HOT_SHARE))
    # at most 1 / HOT_SHARE classes
    first = found.join(F.broadcast(classes.filter(hot)), "sha", "left")
    done = first.filter("group_size IS NOT NULL")
    rest = first.filter("group_size IS NULL").select("sha", "doc_id").join(classes.filter(~hot), "sha", "left")
    rows = done.select("doc_id", "sha", "keep_id", "group_size").unionByName(rest.select("doc_id", "sha", "keep_id", "group_size"))
    alone = marked.filter("NOT suspect").select("doc_id", "sha", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    out = rows.unionByName(alone)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
