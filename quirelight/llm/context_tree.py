"""Language-model scores by context-tree weighting over bytes.

A text is the bytes of its lower-cased words with one space between them, and an end byte. Each byte is decomposed into
eight binary decisions; each decision node has a context tree over the preceding bytes, to DEPTH bytes back. A tree
node holds a Krichevsky-Trofimov estimate of its counts, and the weighted probability of a node is half its own
estimate and half the product of its children's. The prediction of a decision mixes the estimates of all depths with the
weights that the training texts leave: at depth d the share of d's own estimate is 1/2 KT(d) / Pw(d), the rest goes deeper.
A context that training has not seen ends the path: its parent's estimate takes the rest.

The trees are not broadcast. Counts of (context, byte) grams go to owners by their three nearest context bytes, each task
sending a gram once; what lies deeper than three bytes stays with its owner, and only depths 0 to 2, at most 65536 x 255
nodes whatever the input, are solved on the driver and broadcast. To score, texts are dealt to blocks of about
BLOCK_BYTES; a block asks each owner for its distinct grams once and gets their log-probabilities back. Word counts of
the unigram base go the same way, as 64-bit word hashes.

Defined results: a null or blank text is the end alone; repeated rows give repeated rows; with no training text the base's
counts are zero and every decision has probability 1/2; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import LOWER, buffers_of, durable, fold, ordered, packed, prepare, slices, splitmix, text_of, total_bytes, word_hashes, word_spans

#: Context bytes; the gram of a context and its byte takes DEPTH + 1 of a key's eight bytes.
DEPTH = 5
#: Depths that the driver solves: 256**TOP contexts of 255 nodes at most.
TOP = 2
BLOCK_BYTES = 16 << 20
OWNER_BYTES = 8 << 20
#: Distinct keys that a task holds before it sends them.
FLUSH = 3_000_000
END = 0xFF
END_HASH = np.uint64(0x1F83D9ABFB41BD6B)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LN2 = float(np.log(2))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series eight steps up."""
    y = x + 8
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    far = x > 1e6  # the product would only lose digits
    z = np.where(far, x, y)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(far, out, out - np.log(np.where(far, 1.0, steps)))


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - np.log(np.pi)


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte streams of all rows one after another, and their offsets (rows + 1)."""
    base = int(offsets[0])
    data, bounds = data[base : int(offsets[-1])], offsets - base
    begin, end = word_spans(data, bounds[:-1], bounds[1:])
    at = np.searchsorted(begin, bounds)
    none = np.flatnonzero(np.diff(at) == 0)
    if len(none):
        # a row without words still has its end
        begin, end = np.insert(begin, at[none], bounds[none]), np.insert(end, at[none], bounds[none])
        at = at + np.concatenate([[0], np.cumsum(np.diff(at) == 0)])
    length = end - begin + 1
    stop = np.cumsum(length)
    source = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - length - begin, length)
    out = LOWER[data[np.minimum(source, max(len(data) - 1, 0))]] if len(data) else np.zeros(len(source), np.uint8)
    out[stop - 1] = 0x20
    out[stop[at[1:] - 1] - 1] = END
    return out, np.concatenate([[0], stop[at[1:] - 1]])


def grams(stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each byte: the nearest context byte first, the byte itself last."""
    key = stream.astype(np.uint64)
    starts, lengths = offsets[:-1], np.diff(offsets)
    for d in range(1, DEPTH + 1):
        before = np.empty_like(stream)
        before[d:] = stream[:-d] if d < len(stream) else stream[:0]
        before[:d] = END
        for j in range(min(d, DEPTH)):
            before[(starts + j)[lengths > j]] = END
        key |= before.astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    return key


def gram_owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners by the three nearest context bytes."""
    return (splitmix(keys >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(owners)).astype(np.int32)


def word_owner(keys: np.ndarray, owners: int) -> np.ndarray:
    return (keys % np.uint64(owners)).astype(np.int32)


OWNER = {0: word_owner, 1: gram_owner}


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows with each row's end token after its words, and offsets (rows + 1)."""
    words, at = word_hashes(data, offsets)
    return np.insert(words, at[1:], END_HASH), at + np.arange(len(at))


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def messages(kind: int, keys: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, positions of its keys), keys staying in order."""
    owner = OWNER[kind](keys, owners)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(owners + 1))
    for o in range(owners):
        if cuts[o] < cuts[o + 1]:
            yield o, order[cuts[o] : cuts[o + 1]]


# --- Training -----------------------------------------------------------------------------------


def lexicon(texts: DataFrame, owners: int) -> DataFrame:
    """(kind, owner, keys, counts): counts of words (kind 0) and grams (kind 1), a row for each owner."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in held.items():
                k, c = merge(keys, counts)
                rows = [(o, k[i].tobytes(), c[i].tobytes()) for o, i in messages(kind, k, owners)]
                if rows:
                    o, ks, cs = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(o, pa.int32()), packed(ks), packed(cs)], ["kind", "owner", "keys", "counts"])
                keys.clear()
                counts.clear()

        for batch in batches:
            data, offsets = buffers_of(batch.column(0))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                for kind, values in ((0, tokens_of(data, part)[0]), (1, grams(*streams(data, part)))):
                    k, c = np.unique(values, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    size += len(k)
                if size > FLUSH:
                    for kind in held:
                        k, c = merge(*held[kind])
                        held[kind] = ([k], [c])
                    size = sum(len(k[0]) for k, _ in held.values())
                    if size > FLUSH // 2:
                        yield from send()
                        size = 0
        yield from send()

    def gather(group: pa.Table) -> pa.Table:
        k, c = merge([np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in group["counts"].to_pylist()])
        return pa.Table.from_arrays([group["kind"][:1], group["owner"][:1], packed([k.tobytes()]), packed([c.tobytes()]), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["kind", "owner", "keys", "counts", "n_keys", "n_all"])

    sent = texts.mapInArrow(count, "kind int, owner int, keys binary, counts binary")
    return durable(sent.groupBy("kind", "owner").applyInArrow(gather, "kind int, owner int, keys binary, counts binary, n_keys long, n_all long"), "lexicon")


class Level:
    """The decision nodes of one depth: sorted ids (context, 1 and the decided bits), counts and evidence."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: context and byte, sorted, distinct."""
        ids, zeros, ones = [], [], []
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        for bit in range(8):
            node = (context << np.uint64(8)) | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            if len(first):
                is_one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
                ids.append(node[first])
                ones.append(np.add.reduceat(counts * is_one, first))
                zeros.append(np.add.reduceat(counts * (1 - is_one), first))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        ids, zeros, ones = join(ids, np.uint64), join(zeros, np.int64), join(ones, np.int64)
        order = np.argsort(ids)
        self.ids, zeros, ones = ids[order], zeros[order], ones[order]
        self.kt = kt_log(zeros, ones)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)
        self.weighted, self.own = self.kt, np.ones(len(self.ids))

    def over(self, child_parents: np.ndarray, child_weighted: np.ndarray) -> None:
        """Weight this level over its children: ids of their parents, and their weighted evidence."""
        below = np.bincount(np.searchsorted(self.ids, child_parents), weights=child_weighted, minlength=len(self.ids))
        self.weighted = np.logaddexp(self.kt, below) - LN2
        self.own = np.exp(np.minimum(self.kt - LN2 - self.weighted, 0))

    def parents(self) -> np.ndarray:
        """Ids of the nodes one depth up: the farthest context byte is dropped."""
        return (self.ids >> np.uint64(16) << np.uint64(8)) | (self.ids & np.uint64(255))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Positions of ids, -1 where there is none."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


def at_depth(keys: np.ndarray, counts: np.ndarray, depth: int, full: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a smaller depth: the nearest bytes of the context, and the byte."""
    short = (keys >> np.uint64(8 * (full - depth + 1)) << np.uint64(8)) | (keys & np.uint64(255))
    return merge([short], [counts])


def deep_levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """Levels TOP + 1 to DEPTH of an owner's grams, weighted from the bottom up."""
    levels = {d: Level(*at_depth(keys, counts, d)) for d in range(TOP + 1, DEPTH + 1)}
    for d in range(DEPTH - 1, TOP, -1):
        levels[d].over(levels[d + 1].parents(), levels[d + 1].weighted)
    return levels


def top_levels(found: DataFrame) -> dict[int, Level]:
    """Levels 0 to TOP, from sums that the owners make; at most 256**TOP x 255 nodes reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(raw, np.uint64), np.frombuffer(c, np.int64)
                level = deep_levels(keys, counts)[TOP + 1]
                parents, where = np.unique(level.parents(), return_inverse=True)
                below = np.bincount(where, weights=level.weighted, minlength=len(parents))
                k, n = at_depth(keys, counts, TOP)
                rows = []
                for b in range(256):
                    i, j = np.searchsorted(parents, [b << 16, (b + 1) << 16])
                    p, q = np.searchsorted(k, [b << 16, (b + 1) << 16])
                    if i < j:
                        rows.append((b, parents[i:j].tobytes(), below[i:j].tobytes(), k[p:q].tobytes(), n[p:q].tobytes()))
                first, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *map(packed, rest)], ["near", "nodes", "below", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what all owners have on a nearest byte, a byte at a time."""
        acc: dict[int, list] = {}
        for batch in batches:
            for b, *parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                nodes, below, keys, counts = (np.frombuffer(x, t) for x, t in zip(parts, (np.uint64, np.float64, np.uint64, np.int64), strict=True))
                old = acc.get(b)
                if old:
                    nodes, below = merge([old[0], nodes], [old[1], below])
                    keys, counts = merge([old[2], keys], [old[3], counts])
                acc[b] = [nodes, below, keys, counts]
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), *[packed([v[i].tobytes() for v in acc.values()]) for i in range(4)]], ["near", "nodes", "below", "keys", "counts"])

    schema = "near int, nodes binary, below binary, keys binary, counts binary"
    rows = found.filter("kind = 1").select("keys", "counts").mapInArrow(sums, schema).repartition(256, "near").mapInArrow(add, schema).collect()
    pick = lambda c, t: [np.frombuffer(r[c], t) for r in rows]
    nodes, below = merge(pick("nodes", np.uint64), pick("below", np.float64))
    keys, counts = merge(pick("keys", np.uint64), pick("counts", np.int64))
    levels = {d: Level(*at_depth(keys, counts, d, TOP)) for d in range(TOP + 1)}
    levels[TOP].over(nodes, below)
    for d in range(TOP - 1, -1, -1):
        levels[d].over(levels[d + 1].parents(), levels[d + 1].weighted)
    for level in levels.values():
        level.kt = level.weighted = None
    return levels


def gram_log10(keys: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context: eight decisions, each mixed over all depths."""
    total = np.zeros(len(keys))
    byte = keys & np.uint64(255)
    for bit in range(8):
        node = np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
        chance, left, last = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        seen = np.ones(len(keys), bool)
        for d in range(DEPTH + 1):
            level = levels[d]
            at = level.find((keys >> np.uint64(8 * (DEPTH - d + 1)) << np.uint64(8)) | node)
            # below the deepest seen context the rest goes to the last estimate
            seen &= at >= 0
            if not len(level.ids):
                break
            own, estimate = level.own[at], level.one[at]
            chance += np.where(seen, left * own * estimate, 0)
            left = np.where(seen, left * (1 - own), left)
            last = np.where(seen, estimate, last)
        chance += left * last
        total += np.log10(np.clip(np.where(one, chance, 1 - chance), 1e-15, 1.0))
    return total


# --- Scoring ------------------------------------------------------------------------------------


def score(docs: DataFrame, trained: Column) -> DataFrame:
    """Base and model scores of every row; `trained` says which rows the model learns from."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~trained).alias("held_out"), text_of().alias("text"))
    size = total_bytes(texts, F.col("text"))
    owners, blocks = int(max(64, size // OWNER_BYTES)), int(max(12, size // BLOCK_BYTES))
    found = lexicon(texts.filter(~F.col("held_out")).select("text"), owners)
    stats = found.filter("kind = 0").agg(F.sum("n_all").alias("n"), F.sum("n_keys").alias("v")).first()
    n, v = int(stats["n"] or 0), int(stats["v"] or 0)
    top = spark.sparkContext.broadcast(top_levels(found))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def distinct(text: pa.ChunkedArray) -> dict[int, np.ndarray]:
        """The block's distinct words and grams, in order."""
        data, offsets = buffers_of(text)
        keys: dict[int, list] = {0: [], 1: []}
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            keys[0].append(ordered(tokens_of(data, part)[0]))
            keys[1].append(ordered(grams(*streams(data, part))))
        return {kind: ordered(np.concatenate(x)) for kind, x in keys.items()}

    def located(text: pa.ChunkedArray) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each slice and kind: its distinct keys in order, each element's position in them, and the rows' offsets."""
        data, offsets = buffers_of(text)
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            words, words_at = tokens_of(data, part)
            stream, stream_at = streams(data, part)
            out = {}
            for kind, values, at in ((0, words, words_at), (1, grams(stream, stream_at), stream_at)):
                keys, where = np.unique(values, return_inverse=True)
                out[kind] = keys, where.astype(np.int32), at
            yield out

    def ask(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        rows = [(block, kind, o, keys[i].tobytes()) for kind, keys in distinct(group["text"]).items() for o, i in messages(kind, keys, owners)]
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:3]], packed(columns[3])], ["block", "kind", "owner", "keys"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "owner": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        kind = asked["kind"][0].as_py()
        keys, counts = (np.frombuffer(known[c][0].as_buffer(), t) if known.num_rows else np.zeros(0, t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
        wanted = [np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()]
        every = ordered(np.concatenate(wanted))
        if kind == 0:
            at = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
            values = np.where(keys[at] == every, counts[at], 0) if len(keys) else np.zeros(len(every), np.int64)
        else:
            values = gram_log10(every, top.value | deep_levels(keys, counts)).astype(np.float32)
        out = [values[np.searchsorted(every, w)].tobytes() for w in wanted]
        return pa.Table.from_arrays([asked["block"], asked["kind"], asked["owner"], packed(out)], ["block", "kind", "owner", "values"])

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(located(group["text"]))
        keys = {kind: ordered(np.concatenate([p[kind][0] for p in parts])) for kind in (0, 1)}
        values = {0: np.zeros(len(keys[0]), np.int64), 1: np.zeros(len(keys[1]), np.float32)}
        owner = {kind: OWNER[kind](k, owners) for kind, k in keys.items()}
        for kind, o, raw in zip(answers["kind"].to_pylist(), answers["owner"].to_pylist(), answers["values"].to_pylist(), strict=True):
            values[kind][owner[kind] == o] = np.frombuffer(raw, values[kind].dtype)
        tokens, known, base, model = [], [], [], []
        for p in parts:
            found, where, at = p[0]
            count = values[0][np.searchsorted(keys[0], found)]
            tokens.append(np.diff(at))
            known.append(np.add.reduceat((count > 0).astype(np.int64)[where], at[:-1]))
            base.append(np.add.reduceat(np.log10(count + 0.5)[where], at[:-1]))
            found, where, at = p[1]
            model.append(np.add.reduceat(values[1][np.searchsorted(keys[1], found)].astype(np.float64)[where], at[:-1]))
        tokens, known, base, model = (np.concatenate(x) for x in (tokens, known, base, model))
        base = base - tokens * np.log10(n + 0.5 * (v + 1))
        return pa.Table.from_arrays([group["doc_id"], group["held_out"], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), n), pa.int64()), pa.array(base), pa.array(model)], [x.split()[0] for x in SCHEMA.split(", ")])

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, kind int, owner int, keys binary")
    replies = asked.groupBy("kind", "owner").cogroup(found.select("kind", "owner", "keys", "counts").groupBy("kind", "owner")).applyInArrow(answer, "block int, kind int, owner int, values binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, SCHEMA)


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of every document, learned from those outside the held-out fold."""
    return score(docs, fold("doc_id", 5) != 1)
