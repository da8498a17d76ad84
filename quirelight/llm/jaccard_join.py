"""Near duplicates: an n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its hashed five-word shingles. Shingles get one global order: by estimated document
frequency, rarest first, ties by hash. If two sets have a Jaccard similarity of t or more, the prefixes of
|x| - ceil(t|x|) + m shingles share at least m of them, for any m; of the smaller set the first |x| - ceil(2t|x| / (1 + t)) + m
are enough. Each document takes the m of MATCHES with
the least estimated cost: a longer prefix costs more postings, and asks for more shared shingles before a pair is verified.
Once a pair's sizes are known, it needs the smaller m of the two and what its overlap needs more than either prefix supposed.

1. One pass hashes every document: its set's size and id (equal sets share an id), and a count sketch of a fixed size.
2. A second pass sends prefix postings to owners of shingle ranges, each task sending equal sets once. A shingle that the
   sketch knows in HOT_LIST sets or more has no owner: its postings are dealt by salted rows. A set that meets others in fewer
   lists than any partner of its size would ask for has none. With m shared lists sure, a set may leave (m - 1) / 3 of its lists,
   those of the centres that it meets least: passages of a text that another has.
3. No list is paired with itself. A list has one centre, the set with the highest rank (the most frequent
   shingles); every other set meets the centre alone, so a posting gives one pair at most. Pairs that share too few
   shingles of their prefixes with a centre are not verified, unless their list holds a third set.
4. What a list's other sets have with each other is found by their differences from the centre. With F(x) the
   symmetric difference of x and the centre, F(x) and F(y) differ by as much as x and y. Sets near the centre are linked
   through it. If x is not near the centre and is near y, F(x) and F(y) must share elements: at least
   q = (|F(x)| + |F(y)| - (|x| + |y|)(1 - t) / (1 + t)) / 2. So prefixes of the differences, in an order of their own, give new and
   far shorter lists, in which one of a pair has the element in its short prefix and one is far from the centre. Lists with FEW short
   or far sets pair those with the others, where the elements' places in both differences leave room for q, and where the sets' marks
   can be those of a link: an element more or less turns one bit of a set's marks, so two sets differ in as many elements as in bits at
   least. Other lists of up to BLOCK sets are compared so in one block each. The rest get centres in turn, until none is left (step 3 again). Lists and pairs inside a component of the links found so far are left
   out; they cannot change it. In a group of copies, all that the group shares drops out of
   the differences; what is left in a prefix are a copy's own changes. Jaccard distances obey the triangle inequality, so
   linked sets are within 1 - t of each other in their distance from the centre: those over 3(1 - t) meet by prefixes of the
   sets themselves, those up to 2(1 - t) by differences, and those between by both. The rank of a pair's centres falls from round to round,
   so the rounds end, and no pair is lost on the way.
5. Verification compares whole sets of 64-bit hashes; only sets that are in a pair are written, and each round
   shuffles those of its own pairs alone.

Defined results: a null or blank text has no shingle, links with nothing and is its own component; fewer words than
five make one shingle; repeated rows share their class; very long texts are hashed whole, in slices; an empty table gives
no rows; other columns are ignored. Sets are taken as equal when two independent 64-bit hashes of them are (the pass is repeated with
another seed where the first alone agrees), and shingles when one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.llm.common import Shipped, buffers_of, components, durable, in_bitmap, key_bitmap, lean, packed, prepare, settle, slices, splitmix, text_of, total_bytes, word_hashes
from quirelight.llm.common import ordered as distinct

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Numbers of shared prefix shingles that a document may ask for; one that must share fewer with any partner asks for those.
MATCHES = np.array([32, 36, 40, 48, 56, 64, 80, 96])
#: Slots of the count sketch: 16 MB whatever the input. Its errors change costs, never results.
SKETCH_BITS = 24
_SEGMENTS = 64
#: Counts in the sketch go up to this; a document frequency over it is only known to be high.
_HIGH = 65535
#: Cost of a candidate pair in postings, and of the share of chance candidates that each further match leaves.
PAIR_COST = 4.0
#: Bytes of text that are hashed at once: their arrays stay in a core's cache.
HASHED_BYTES = 1 << 18
#: Postings that a task holds before it sends them.
FLUSH = 400_000
#: Bytes of text for each owner of postings.
OWNER_BYTES = 16 << 20
#: Estimated sets of a shingle from which its list has no owner but is dealt in SALTS parts; an owner holds 1.5 MB of a shorter one.
HOT_LIST = 1 << 16
SALTS = 16
#: Shared elements that differences from a centre ask for, and that sets far from a common centre do.
DIFFERENCE_MATCHES, DISTANT_MATCHES = 4, 16
#: Short or far sets of a list that are paired with each set of it.
FEW = 64
#: Sets of other lists that are compared in one block; longer lists get a centre.
BLOCK = 1024
#: Words of 64 bits that a set's marks have at most: sets beyond 2,000 shingles or so are told apart by them less and less.
MARK_WORDS = 64
#: Pairs with one centre that a copy of the centre's set serves.
CENTRE_ROWS = 4096
#: A class of equal sets with this share of all rows goes by broadcast: 64 classes at most.
HOT_SHARE = 1 / 64
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A posting: a shingle, its set's id and size, how common the set is, and bits: 0 short, 1 to 3 the index of m.
POSTING = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<u4"), ("common", "<u2"), ("bits", "u1")])


def required(n):
    """Shingles that a set of n must share with any set it links with: ceil(n * PERCENT / 100)."""
    return (n * PERCENT + 99) // 100


def required_of_shorter(n):
    """The same for a partner that is no smaller: ceil(n * 2 PERCENT / (100 + PERCENT))."""
    return -(-n * 2 * PERCENT // (100 + PERCENT))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    for a, b in slices(offsets, HASHED_BYTES):
        words, at = word_hashes(data, offsets[a : b + 1])
        m = len(words) - WORDS + 1
        if m > 0:
            mixed = words[:m].copy()
            for k in range(1, WORDS):
                mixed = mixed * _STEP + words[k : m + k]
            mixed = splitmix(mixed)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= WORDS:
                yield distinct(mixed[i : j - WORDS + 1])
            elif j > i:
                whole = np.uint64(j - i)
                for w in words[i:j]:
                    whole = splitmix(np.array([whole], np.uint64) * _STEP + w)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray, seed: int = 0) -> int:
    """A 64-bit id of a set, as a signed integer; different seeds give independent ids."""
    salt = splitmix(np.array([0x5BD1E995 + seed], np.uint64))
    mixed = splitmix(np.array([splitmix(shingles ^ salt).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(mixed.view(np.int64)[0])


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def distinct_slots(shingles: np.ndarray) -> np.ndarray:
    """The different slots of a sorted set: they are in order too."""
    slots = _slots(shingles)
    return slots[np.concatenate([[True], slots[1:] != slots[:-1]])] if len(slots) else slots


def survey(texts: DataFrame, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, set, proof) of every document, and the document frequencies' sketch."""
    names = ["doc_id", "n", "set", "proof", "segment", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, n, set, proof, -1, null), then one (null, null, null, null, segment, counts) for each part of the sketch."""
        sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            data, offsets = buffers_of(batch.column(1))
            n, ids, proofs = [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                ids.append(set_id(s, seed) if len(s) else None)
                proofs.append(set_id(s, ~seed & 0xFFFF) if len(s) else None)
                slots = distinct_slots(s)
                sketch[slots] = np.minimum(sketch[slots], _HIGH - 1) + 1
            rows = batch.num_rows
            longs = [pa.array(x, pa.int64()) for x in (n, ids, proofs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array([-1] * rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        parts = sketch.reshape(_SEGMENTS, -1)
        none = pa.nulls(_SEGMENTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(range(_SEGMENTS), pa.int32()), packed([pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts])], names)

    found = durable(texts.mapInArrow(lean(run), "doc_id long, n long, set long, proof long, segment int, counts binary"), "sets")
    sums = found.filter("segment >= 0").select("segment", "counts").repartition(_SEGMENTS, "segment")
    sketch = np.zeros((_SEGMENTS, (1 << SKETCH_BITS) // _SEGMENTS), np.uint8)
    for r in sums.mapInArrow(lean(_sum_sketch), "segment int, counts binary").collect():
        sketch[r["segment"]] = np.frombuffer(pa.decompress(r["counts"], sketch.shape[1], codec="zstd"), np.uint8)
    return found.filter("segment = -1").select("doc_id", "n", "set", "proof"), sketch.reshape(-1)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """What exceeds the usual load of a slot, as a byte: 8 steps for each doubling."""
    usual = counts.mean() + 3 * counts.mean() ** 0.5
    return np.minimum(np.round(8 * np.log2(1 + np.maximum(counts - usual, 0))), 255).astype(np.uint8)


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(raw, 2 << SKETCH_BITS >> 6, codec="zstd"), np.uint16)
            acc[s] = np.minimum(acc.get(s, 0) + part.astype(np.int64), 1 << 40)
    keep = sorted(acc)
    # a byte for each slot: counts over the segment's mean, rarer ones exact, others on a logarithmic scale
    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), packed([pa.compress(_scaled(acc[s]).tobytes(), codec="zstd", asbytes=True) for s in keep])], ["segment", "counts"])


def adaptive_prefix(shingles: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """The prefix of a set in the global order, how many of it are for partners no smaller, the index in MATCHES of m, and
    how common the whole set is.

    A longer prefix costs a posting for each shingle, and the candidates of frequent shingles; asking for m matches
    leaves about 1 / m of them.
    """
    excess = sketch[_slots(shingles)]
    order = np.lexsort((shingles, excess))
    n, need = len(shingles), int(required(len(shingles)))
    options = MATCHES[MATCHES <= need] if need > MATCHES[0] else np.array([need])
    sizes = n - need + options
    candidates = np.cumsum(np.exp2(excess[order[: sizes[-1]]] / 8.0) - 1)
    k = int(np.argmin(sizes + PAIR_COST * candidates[sizes - 1] / options))
    return shingles[order[: sizes[k]]], n - int(required_of_shorter(n)) + int(options[k]), k, commonness(shingles, sketch)


def rank(sets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """One order of all sets: by how common they are, ties by a hash of the id."""
    return (common.astype(np.int64) << 46) | (splitmix(sets.view(np.uint64)) >> np.uint64(18)).astype(np.int64)


def commonness(shingles: np.ndarray, sketch: np.ndarray) -> int:
    """The mean of the sketch over a set's shingles, in 16 bits: the centre of a group of copies has the fewest changes."""
    return int(256 * sketch[_slots(shingles)].mean())


def own_lists(p: np.ndarray) -> dict[str, np.ndarray]:
    """The pairs (centre, set) of the lists in an owner's postings, with the number of lists that gave each; then each set's
    lists, with no centre.

    A list's centre is the set with the highest rank. A pair is `more` where its list holds a third set; only then can other sets of the list be near each other.
    """
    p = p[np.lexsort((rank(p["set"].copy(), p["common"]), p["key"]))]
    if len(p):
        p = p[np.concatenate([[True], (p["key"][1:] != p["key"][:-1]) | (p["set"][1:] != p["set"][:-1])])]
    first = np.flatnonzero(np.concatenate([[True], p["key"][1:] != p["key"][:-1]])) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(p)))
    short = (p["bits"] & 1).astype(np.int64)
    shorts = np.add.reduceat(short, first) if len(first) else size
    last = first + size - 1
    run = np.repeat(np.arange(len(first)), size)
    at = np.flatnonzero((size[run] > 1) & (shorts[run] > 0) & (np.arange(len(p)) != last[run]))
    centre = last[run[at]]
    more = (size[run[at]] > 2) & (shorts[run[at]] > short[centre])
    order = np.lexsort((p["set"][at], p["set"][centre]))
    at, centre, more = at[order], centre[order], more[order]
    x, c = p[at], p[centre]
    pair = np.flatnonzero(np.concatenate([[True], (x["set"][1:] != x["set"][:-1]) | (c["set"][1:] != c["set"][:-1])])) if len(x) else np.zeros(0, np.int64)
    info = lambda q: (q["n"].astype(np.int64) << 3) | (q["bits"] >> 1)
    shared = np.diff(np.append(pair, len(x)))
    most = np.add.reduceat(more.astype(np.int64), pair) > 0 if len(pair) else more
    q = p[(size[run] > 1) & (shorts[run] > 0)]
    q = q[np.argsort(q["set"], kind="stable")]
    own = np.flatnonzero(np.concatenate([[True], q["set"][1:] != q["set"][:-1]])) if len(q) else np.zeros(0, np.int64)
    none = np.zeros(len(own), np.int64)
    return {
        "centre": pa.array(np.concatenate([c["set"][pair], none]), mask=np.arange(len(pair) + len(own)) >= len(pair)),
        "set": np.concatenate([x["set"][pair], q["set"][own]]),
        "shared": np.concatenate([shared, np.diff(np.append(own, len(q)))]),
        "more": np.concatenate([most, none > 0]),
        "centre_info": np.concatenate([info(c)[pair], none]),
        "info": np.concatenate([info(x)[pair], info(q)[own]]),
    }


def prefix_pairs(texts: DataFrame, sketch, owners: int, seed: int) -> DataFrame:
    """(centre, set, shared, more, centre_info, info): each set against the centres of its lists. info is a set's size
    and the index of its m."""
    hot_step = 8 * np.log2(1 + HOT_LIST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            p = np.concatenate(held) if held else np.zeros(0, POSTING)
            owner = np.where(counts[_slots(p["key"])] >= hot_step, -1, (p["key"] % np.uint64(owners)).astype(np.int64))
            order = np.argsort(owner, kind="stable")
            p, cuts = p[order], np.searchsorted(owner[order], np.arange(-1, owners + 1))
            keep = [o for o in range(owners + 1) if cuts[o] < cuts[o + 1]]
            away = -1 - TaskContext.get().partitionId() % owners
            return pa.RecordBatch.from_arrays([pa.array([o - 1 if o else away for o in keep], pa.int32()), packed([p[cuts[o] : cuts[o + 1]].tobytes() for o in keep])], ["owner", "postings"])

        for batch in batches:
            data, offsets = buffers_of(batch.column(0))
            for s in shingle_sets(data, offsets):
                if len(s) and (key := set_id(s, seed)) not in seen:
                    seen.add(key)
                    prefix, short, m, share = adaptive_prefix(s, counts)
                    p = np.empty(len(prefix), POSTING)
                    p["key"], p["set"], p["n"], p["common"] = prefix, key, len(s), share
                    p["bits"] = (m << 1) | (np.arange(len(prefix)) < short)
                    held.append(p)
                    size += len(p)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        yield send()

    names = ["centre", "set", "shared", "more", "centre_info", "info"]
    columns = "centre long, set long, shared long, more boolean, centre_info long, info long, postings binary"

    def owned(group: pa.Table) -> pa.Table:
        """An owner's pairs; postings without an owner as they are."""
        if group["owner"][0].as_py() < 0:
            n = group.num_rows
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.Table.from_arrays([pa.nulls(n, t) for t in types] + [group["postings"]], [*names, "postings"])
        found = own_lists(np.concatenate([np.frombuffer(x, POSTING) for x in group["postings"].to_pylist()]))
        return pa.table({k: pa.array(found[k]) for k in names} | {"postings": pa.nulls(len(found["set"]), pa.binary())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                p = np.frombuffer(raw, POSTING)
                info = (p["n"].astype(np.int64) << 3) | (p["bits"] >> 1)
                columns = (p["key"].copy().view(np.int64), p["set"], rank(p["set"].copy(), p["common"]), (p["bits"] & 1).astype(np.int64), np.ones(len(p), np.int64), info)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "set", "rank", "short", "far", "info"])

    sent = texts.select("text").mapInArrow(lean(run), "owner int, postings binary")
    owners_found = durable(sent.groupBy("owner").applyInArrow(owned, columns), "owned")
    dealt = owners_found.filter("postings IS NOT NULL").select("postings").mapInArrow(lean(rows), "key long, set long, rank long, short long, far long, info long")
    dealt = durable(dealt.dropDuplicates(["key", "set"]), "hot")
    hot = centred(dealt.withColumn("node", F.lit(0)), lists_of(dealt), SALTS).drop("node")
    met = owners_found.filter("postings IS NULL").drop("postings").unionByName(hot)
    alive = met.filter("centre IS NULL").groupBy("set").agg(F.sum("shared").alias("lists"), F.max(F.shiftright("info", 3)).alias("n"))
    alive = alive.filter(F.col("lists") >= sure("n"))
    pairs = met.filter("centre IS NOT NULL").join(alive.select("set"), "set", "left_semi")
    pairs = pairs.groupBy("centre", "set").agg(F.sum("shared").alias("shared"), F.max("more").alias("more"), F.max("centre_info").alias("centre_info"), F.max("info").alias("info"))
    so_far = F.sum("shared").over(Window.partitionBy("set").orderBy("shared", "centre").rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("so_far", so_far).filter(F.col("so_far") > spare("shiftright(info, 3)")).drop("so_far")


def sure(n: str) -> Column:
    """Lists that a set of n shares with any partner: partners have ceil(n * PERCENT / 100) shingles at least."""
    partner = f"(({n}) * {PERCENT} + 99) div 100"
    return F.expr(f"least({MATCHES[0]}, greatest(1, (({partner}) * {PERCENT} + 99) div 100))")


def spare(n: str) -> Column:
    """Lists that a set of n may leave: two partners and the pair itself leave fewer than they share."""
    return F.floor((sure(n) - 1) / 3)


def lists_of(rows: DataFrame) -> DataFrame:
    """The lists in rows (key, set, rank, short, far, info), one of each set in a list: their sizes and the set with the highest rank.

    Two sets of a list can be near each other only if one of them is short and one is far.
    """
    ends = [F.min("component").alias("low"), F.max("component").alias("high")] if "component" in rows.columns else [F.lit(None).alias("low"), F.lit(None).alias("high")]
    top = [F.max_by(c, "rank").alias(f"top_{c}") for c in ("set", "info", "short", "far") if c in rows.columns]
    lists = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("short").alias("shorts"), F.sum("far").alias("fars"), *top, *ends)
    return lists.filter("size > 1 AND shorts > 0 AND fars > 0 AND (low IS NULL OR low <> high)")


def centred(rows: DataFrame, lists: DataFrame, salts: int = 1) -> DataFrame:
    """The pairs of each set with the centre of its list, and each set's lists, with no centre. Lists are aggregated before they
    shuffle, and rows meet their list's centre in so many parts; beyond that Spark splits a skewed join."""
    more = F.expr("size > 2 AND shorts > top_short AND fars > top_far").alias("more")
    info = F.col("top_info") if "top_info" in lists.columns else F.lit(0).cast("long")
    centres = lists.select("key", F.col("top_set").alias("centre"), info.alias("centre_info"), more)
    met, on = rows.select("key", "node", "set", "info"), ["key"]
    if salts > 1:
        met, on = met.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(salts)).cast("int")), ["key", "salt"]
        centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = met.join(centres, on)
    both = F.array(F.when(F.col("set") != F.col("centre"), F.col("centre")), F.lit(None).cast("long"))
    met = met.withColumn("centre", F.explode(F.when(F.col("set") != F.col("centre"), both).otherwise(F.slice(both, 2, 1))))
    met = met.withColumn("more", F.col("more") & F.col("centre").isNotNull())
    return met.groupBy("node", "centre", "set").agg(F.count("*").alias("shared"), F.max("more").alias("more"), F.max("centre_info").alias("centre_info"), F.max("info").alias("info"))


def block_pairs(block: pa.Table) -> pa.Table:
    """The pairs (node, key, centre, set, spare) of one list that its rows allow: all are compared, by their places and marks."""
    names = ("set", "short", "far", "n", "differ", "place", "spare", "component")
    sets, short, far, n, differ, place, spare, component = (block[c].to_numpy() for c in names)
    marks = block["marks"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sets), -1)
    first, second = [], []
    step = max(1, (1 << 20) // marks.size)
    for a in range(0, len(sets), step):
        i, j = np.arange(a, min(a + step, len(sets)))[:, None], np.arange(a, len(sets))[None, :]
        total, left = n[i] + n[j], spare[i] + spare[j] + np.minimum(spare[i], spare[j])
        q = np.ceil((differ[i] + differ[j] - total * (100 - PERCENT) / (100 + PERCENT)) / 2 - 1e-6)
        fits = (i < j) & (component[i] != component[j]) & (short[i] + short[j] > 0) & (far[i] + far[j] > 0)
        fits &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        fits &= (place[i] <= differ[i] - q + left) & (place[j] <= differ[j] - q + left)
        x, y = np.nonzero(fits)
        x, y = x + a, y + a
        turned = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
        close = (100 + PERCENT) * turned <= (100 - PERCENT) * (n[x] + n[y])
        first.append(x[close])
        second.append(y[close])
    x, y = np.concatenate(first), np.concatenate(second)
    node, key = (np.full(len(x), block[c][0].as_py(), np.int64) for c in ("node", "key"))
    ends = np.minimum(sets[x], sets[y]), np.maximum(sets[x], sets[y])
    return pa.table({"node": node, "key": key, "centre": ends[0], "set": ends[1], "spare": np.minimum(spare[x], spare[y])})


def next_pairs(rows: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """(centre, set, more): the pairs that the lists of differences ask for. Rows also have the node (a centre and a kind of prefix),
    n, the size of the difference, the place in it, and what the set surely shares with a partner of the node. marks has each set's
    once for a node, groups the components so far."""
    ends = rows.groupBy("key").agg(F.max("short").alias("short"), F.max("far").alias("far"), F.count("*").alias("size"))
    ends = durable(ends.filter("short > 0 AND far > 0 AND size > 1").select("key"), "ends")
    # most rows are alone in their list: a bitmap of the lists' keys keeps them out of the shuffle, the join is exact
    shipped = Shipped(rows.sparkSession, key_bitmap(ends, ends.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shipped.value, batch.column(0).to_numpy())))

    rows = rows.select("key", *[c for c in rows.columns if c != "key"])
    kept = rows.mapInArrow(lean(run), rows.schema).join(ends, "key", "left_semi")
    kept = durable(kept.join(groups, "set", "left").withColumn("component", F.coalesce("component", "set")), "listed")
    shipped.free()
    apart = kept.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    kept = durable(kept.join(apart, "key", "left_semi"), "apart")
    alive = kept.groupBy("node", "set").agg(F.count("*").alias("lists"), F.first("sure").alias("sure")).filter("lists >= sure").select("node", "set")
    rows = durable(kept.join(alive, ["node", "set"], "left_semi").withColumn("spare", F.expr("(sure - 1) div 3")), "alive")
    lists = durable(lists_of(rows), "lists")
    few = F.least("shorts", "fars") <= FEW
    kind = F.when(few & (F.col("fars") <= F.col("shorts")), "far").when(few, "short").when(F.col("size") <= BLOCK, "block").otherwise("long").alias("kind")
    lists = lists.select("*", kind)
    marked = rows.drop("rank").join(lists.filter("kind <> 'long'").select("key", "kind"), "key").join(marks, ["node", "set"])
    marked = durable(marked, "marked")
    # at most FEW of a list
    ones = marked.filter("kind = 'far' AND far = 1 OR kind = 'short' AND short = 1")
    ones = ones.select("key", *[F.col(c).alias(f"{c}_1") for c in ("set", "short", "far", "n", "differ", "place", "spare", "component", "marks")])
    # the first shared elements, one more than the pair and both sets may leave, have their place before these
    left = F.col("spare") + F.col("spare_1") + F.least("spare", "spare_1")
    q = F.expr(f"CAST(ceil((differ + differ_1 - (n + n_1) * {100 - PERCENT} / {100 + PERCENT}D) / 2 - 1e-6) AS BIGINT)")
    room = (F.col("place") <= F.col("differ") - q + left) & (F.col("place_1") <= F.col("differ_1") - q + left)
    fits = F.expr(f"component <> component_1 AND short + short_1 > 0 AND far + far_1 > 0 AND 100 * least(n, n_1) >= {PERCENT} * greatest(n, n_1)")
    met = marked.filter("kind <> 'block'").join(ones, "key").filter(fits & room & marks_allow())
    met = met.select("node", "key", F.least("set", "set_1").alias("centre"), F.greatest("set", "set_1").alias("set"), F.least("spare", "spare_1").alias("spare")).distinct()
    blocks = marked.filter("kind = 'block'").groupBy("key").applyInArrow(block_pairs, "node long, key long, centre long, set long, spare long")
    direct = met.unionByName(blocks).groupBy("node", "centre", "set").agg(F.count("*").alias("shared"), F.max("spare").alias("spare")).filter("shared > spare")
    long = lists.filter("kind = 'long'")
    stars = centred(rows.withColumn("info", F.col("spare")), long).filter("centre IS NOT NULL")
    so_far = F.sum("shared").over(Window.partitionBy("node", "set").orderBy("shared", "centre").rowsBetween(Window.unboundedPreceding, 0))
    stars = stars.withColumn("so_far", so_far).filter("so_far > info")
    pairs = direct.select("centre", "set", F.lit(False).alias("more")).unionByName(stars.select("centre", "set", "more"))
    return durable(pairs.groupBy("centre", "set").agg(F.max("more").alias("more")), "pairs")


def members_of(pairs: DataFrame) -> DataFrame:
    """The sets that are in a pair, written once for the counts and bitmaps of a round."""
    return durable(pairs.select(F.explode(F.array("centre", "set")).alias("set")).distinct(), "members")


def sets_of(texts: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """(set, hashes): the whole sets of these members, at most once from each task; who joins them takes one of each."""
    shipped = Shipped(texts.sparkSession, key_bitmap(members, members.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = buffers_of(batch.column(0))
            keys, sets = [], []
            for s in shingle_sets(data, offsets):
                if len(s) and (key := set_id(s, seed)) not in seen and in_bitmap(shipped.value, np.array([key]))[0]:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), packed(sets)], ["set", "hashes"])

    out = durable(texts.select("text").mapInArrow(lean(run), "set long, hashes binary"), "hashes")
    shipped.free()
    return out


def sets_in(sets: DataFrame, shipped: Shipped) -> DataFrame:
    """One row of each set of a bitmap of members: it keeps the other sets out of the shuffle, which the joins on `set` share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shipped.value, batch.column(0).to_numpy())))

    return sets.mapInArrow(lean(run), sets.schema).groupBy("set").agg(F.first("hashes").alias("hashes"))


def ordered(elements: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return elements[np.lexsort((elements, weight))]


def difference(x: np.ndarray, c: np.ndarray, sketch: np.ndarray) -> tuple[bool, list[tuple[int, np.ndarray, int, int, int]]]:
    """Whether x is far from c, and up to two prefixes by which it finds others of the list, as (kind, elements, short, size, sure):
    of kind 0 from its symmetric difference from c, of kind 1 from x itself. short counts the elements of the short prefix.

    Two sets that are near each other and not both near c share elements of one kind, in the short prefix of one and the
    whole prefix of the other, as many as is sure of either; sets near c have the short prefix alone. A prefix leaves out all but `sure` of the elements that the set must share.
    """
    more, less = 100 + PERCENT, 100 - PERCENT
    adds, lacks = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
    f = len(adds) + len(lacks)
    union = len(c) + len(adds)
    far = 100 * f > less * union
    out = []
    if 100 * f <= 3 * less * union:
        # a partner has at most 100 / PERCENT times the shingles, and its difference is within `apart` of f: the smaller of two
        # differences shares all but apart / 2 of its elements, the larger all but apart
        apart = less * (len(x) + 100 * len(x) // PERCENT) // more
        least = max(1, (more * f + less * (len(c) - len(x))) // (2 * more) + 1)
        as_smaller, as_larger = max(least, f - apart // 2 if far else 0), max(least, f - apart if far else 0)
        if far and 100 * f <= 2 * less * union:
            # sets near c may be partners; of no others
            as_larger = min(as_larger, max(1, -(-(more * f - less * (len(x) + len(c))) // (2 * more))))
        sure = min(DIFFERENCE_MATCHES, as_larger)
        short, whole = (f - k + min(DIFFERENCE_MATCHES, k) for k in (as_smaller, as_larger))
        # rarest first: what x adds is as frequent as the sketch says; what it lacks is lacked by the centre's group but for those that have it
        frequent = np.exp2(sketch[_slots(c)].max() / 8.0)
        lacked = 8 * np.log2(1 + np.maximum(frequent - np.exp2(sketch[_slots(lacks)] / 8.0), 0))
        weight = np.concatenate([sketch[_slots(adds)].astype(np.float64), np.round(lacked)])
        out.append((0, ordered(np.concatenate([adds, lacks]), weight)[: max(short, whole if far else 0)], short, f, sure))
    if 100 * f > 2 * less * union:
        n = len(x)
        sure = min(DISTANT_MATCHES, int(required(required(n))))
        whole, short = (n - int(need) + min(DISTANT_MATCHES, int(need)) for need in (required(n), required_of_shorter(n)))
        out.append((1, ordered(x, sketch[_slots(x)])[:whole], short, n, sure))
    return far, out


def marks_of(x: np.ndarray, n: int) -> np.ndarray:
    """The marks of a set in words of 64 bits: for each bit whether an odd number of elements falls on it. The bits of all sets
    that meet a centre of n shingles are as many, 2n to 4n; each element of a symmetric difference turns one."""
    bits = 64 * min(MARK_WORDS, 1 << max(0, (int(n) - 1).bit_length() - 5))
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def marks_allow() -> Column:
    """Whether two sets of n and n_1 shingles can link by their marks: linked sets differ in (n + n_1)(1 - t) / (1 + t) elements at most."""
    turned = "aggregate(zip_with(marks, marks_1, (x, y) -> bit_count(x ^ y)), 0, (all, k) -> all + k)"
    return F.coalesce(F.expr(f"{100 + PERCENT} * {turned} <= {100 - PERCENT} * (n + n_1)"), F.lit(True))


def compared(pairs: DataFrame, sets: DataFrame, members: DataFrame, sketch) -> DataFrame:
    """Rows (centre, set, null...) of pairs that are links, rows (null, null, key, node, set...) of the differences' prefixes, and
    rows (null, null, null, node, set, null..., marks), one for each node and set of those."""
    centres = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("parts"))
    taken = Shipped(pairs.sparkSession, key_bitmap(members, members.count()))
    sets = sets_in(sets, taken)
    dealt = pairs.join(centres, "centre").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    of_centre = sets.withColumnRenamed("set", "centre").join(centres, "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias("middle"))
    whole = dealt.join(of_centre, ["centre", "part"]).select("centre", "set", "more", "middle").join(sets, "set")
    names = ["a", "b", "key", "node", "set", "rank", "short", "far", "n", "differ", "place", "sure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, out = [], [], [[] for _ in names[2:]]
            nodes, owners, marks = [], [], []
            centre, member, more = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                c, x = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (3, 4))
                if more[i]:
                    far, prefixes = difference(x, c, sketch.value)
                    ids = np.array([centre[i], member[i]], np.int64)
                    own = rank(ids[1:], np.array([commonness(x, sketch.value)]))
                    for kind, prefix, short, size, sure in prefixes:
                        at = np.arange(len(prefix))
                        node = splitmix(ids[:1].view(np.uint64) + np.uint64(kind))
                        key = splitmix(prefix * _STEP + node).view(np.int64)
                        for column, v in zip(out, (key, node.view(np.int64)[0], ids[1], own[0], at < short, far, len(x), size, at, sure), strict=True):
                            column.append(np.broadcast_to(np.asarray(v, np.int64), at.shape))
                        nodes.append(int(node.view(np.int64)[0]))
                        owners.append(member[i])
                        marks.append(marks_of(x, len(c)))
                else:
                    both = len(np.intersect1d(x, c, assume_unique=True))
                    far = 100 * both < PERCENT * (len(x) + len(c) - both)
                if not far:
                    a.append(centre[i])
                    b.append(member[i])
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]
            none, of_links, of_nodes = (pa.nulls(k, pa.int64()) for k in (len(flat[0]), len(a), len(nodes)))
            words = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[of_links] * len(flat), pa.nulls(len(a), words)], [*names, "marks"])
            yield pa.RecordBatch.from_arrays([none, none, *[pa.array(v) for v in flat], pa.nulls(len(none), words)], [*names, "marks"])
            held = [pa.array(nodes, pa.int64()), pa.array(owners, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[of_nodes] * 3, *held, *[of_nodes] * (len(names) - 5), pa.array(marks, words)], [*names, "marks"])

    columns = ", ".join(f"{c} long" for c in names) + ", marks array<long>"
    out = durable(whole.select("centre", "set", "more", "middle", "hashes").mapInArrow(lean(run), columns), "compared")
    taken.free()
    return out


def links(texts: DataFrame, sketch: np.ndarray, seed: int = 0) -> DataFrame:
    """(set, component) of the classes that have links."""
    owners = max(64, total_bytes(texts, F.col("text")) // OWNER_BYTES)
    spark = texts.sparkSession
    shipped = Shipped(spark, sketch)
    settle(spark)
    pairs = prefix_pairs(texts, shipped, int(owners), seed)
    # with sizes known, the overlap that a link needs raises the number of shared shingles over both sets' m; where the pair
    # shares them in lists of other centres that neither has left, those lists hold a third set and answer for it
    matches = F.array(*[F.lit(int(m)) for m in MATCHES])
    asked = lambda info, n: F.least(F.element_at(matches, (info.bitwiseAND(F.lit(7)) + 1).cast("int")), F.expr(f"CAST(ceil({n} * {PERCENT} / 100D) AS BIGINT)"))
    small, large = F.least("centre_info", "info"), F.greatest("centre_info", "info")
    pairs = pairs.withColumn("na", F.shiftright(small, 3)).withColumn("nb", F.shiftright(large, 3))
    overlap = F.expr(f"CAST(ceil({PERCENT} * (na + nb) / {100 + PERCENT}D) AS BIGINT)")
    of_small = F.expr(f"CAST(ceil(na * {2 * PERCENT} / {100 + PERCENT}D) AS BIGINT)")
    of_large = F.expr(f"CAST(ceil(nb * {PERCENT} / 100D) AS BIGINT)")
    least = F.least(asked(small, "na") + overlap - of_small, asked(large, "nb") + overlap - of_large) - spare("na") - spare("nb")
    enough = (F.col("shared") >= least) & F.expr(f"100 * na >= {PERCENT} * nb")
    pairs = durable(pairs.filter(F.col("more") | enough).select("centre", "set", "more"), "pairs")
    settle(spark)
    groups = pairs.select("set", F.col("set").alias("component")).limit(0)
    sets = None
    while pairs.take(1):
        members = members_of(pairs)
        sets = sets_of(texts, members, seed) if sets is None else sets
        step = compared(pairs, sets, members, shipped)
        linked = step.filter("a IS NOT NULL").select("a", "b")
        groups = durable(components(groups.toDF("a", "b").unionByName(linked)).withColumnRenamed("node", "set"), "groups")
        settle(spark)
        marks = step.filter("marks IS NOT NULL").select("node", "set", "marks")
        pairs = next_pairs(step.filter("key IS NOT NULL").drop("a", "b", "marks"), marks, groups)
        settle(spark)
    shipped.free()
    return groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    for seed in range(8):
        rows, sketch = survey(texts, seed)
        full = rows.filter("set IS NOT NULL")
        classes = full.groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("proof").alias("low"), F.max("proof").alias("high"))
        classes = durable(classes, "classes")
        if not classes.filter("low <> high").take(1):
            break
    grouped = classes.join(links(texts, sketch, seed), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = durable(grouped.join(least, "component").select("set", "rows", "component_id"), "named")
    hot = F.col("rows") >= max(2, int(full.count() * HOT_SHARE))
    # at most 1 / HOT_SHARE classes
    step = full.join(F.broadcast(named.filter(hot).select("set", "component_id", F.lit(True).alias("hot"))), "set", "left")
    # a hot class of null ids has no component_id
    done = step.filter("hot")
    rest = step.filter("hot IS NULL").select("doc_id", "n", "set").join(named.filter(~hot).select("set", "component_id"), "set")
    alone = rows.filter("set IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = done.select("doc_id", "n", "component_id").unionByName(rest.select("doc_id", "n", "component_id")).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
