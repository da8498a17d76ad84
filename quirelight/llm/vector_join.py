"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with a cosine of at least COSINE are at most epsilon = sqrt(2 - 2 COSINE) apart. Vectors are turned
onto principal axes, cut into grid cells of side epsilon on the GRID leading axes, and sorted by their cells (the epsilon
grid order). The sorted sequence is cut into intervals; two intervals meet only where the boxes around them, on all of
the leading axes, are within epsilon. A task joins a pair of intervals recursively: it halves both until the boxes are
provably distant or a block is small, and compares small blocks by one matrix product in double precision.

Equal vectors are joined first, so a vector that a third of all rows share is compared once and counted as often as it
stands. A task returns counts of links and a spanning forest of the links that it found, not the links: its output is
linear in its rows. The axes come from a bounded sample (SAMPLE_ROWS); they move only the cost.

There are at most INTERVALS intervals, so at most INTERVALS boxes of 2 * GRID numbers reach the driver; beyond some
INTERVALS * 2048 vectors intervals grow and the recursion inside a task has more levels.

Vectors of each length are joined by themselves, one length after another.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
have no link and are their own component; repeated rows are vectors of their own with equal ids; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import components, durable, packed, prepare

COSINE = 0.9
GRID = 8
SAMPLE_ROWS = 20_000
INTERVALS = 256
#: Vectors of a block that is compared without further halving.
LEAF = 512
#: A class of equal vectors with this share of all rows goes by broadcast: 64 classes at most.
HOT_SHARE = 1 / 64


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    v = vectors.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are principal directions, the widest first."""
    centred = vectors - vectors.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, np.argsort(-values)]


def boxes_apart(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    """Whether two sets of points are more than epsilon apart by the boxes around them."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) > epsilon * epsilon


class Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def join_intervals(a: np.ndarray, b: np.ndarray, same: bool, cosine: float, found) -> None:
    """Call found(i, j) with arrays of linked positions of a and b; with same, pairs of one interval once."""
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def recurse(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and j1 <= i0 or i0 >= i1 or j0 >= j1:
            return
        if (i0, i1) != (j0, j1) and boxes_apart(a[i0:i1, :GRID], b[j0:j1, :GRID], epsilon):
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            products = a[i0:i1] @ b[j0:j1].T
            i, j = np.nonzero(products >= cosine - 1e-12)
            near = np.flatnonzero(products[i, j] < cosine + 1e-12)
            if len(near):
                # on the border, products are summed exactly
                from math import fsum

                keep = np.ones(len(i), bool)
                for k in near:
                    keep[k] = fsum((a[i0 + i[k]] * b[j0 + j[k]]).tolist()) >= cosine
                i, j = i[keep], j[keep]
            i, j = i + i0, j + j0
            if same:
                later = i < j
                i, j = i[later], j[later]
            if len(i):
                found(i, j)
            return
        im, jm = ((i0 + i1) // 2, (j0 + j1) // 2)
        if same and (i0, i1) == (j0, j1):
            recurse(i0, im, i0, im)
            recurse(i0, im, im, i1)
            recurse(im, i1, im, i1)
        elif i1 - i0 >= j1 - j0:
            recurse(i0, im, j0, j1)
            recurse(im, i1, j0, j1)
        else:
            recurse(i0, i1, j0, jm)
            recurse(i0, i1, jm, j1)

    recurse(0, len(a), 0, len(b))


def classes_of(vectors: DataFrame, dims: int) -> DataFrame:
    """(least, rows, embedding): equal usable vectors once, with the smallest id and their number."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(fine)
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    prepare(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # zero has two signs; as parts of a key they are one
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    lengths = sorted(r["n"] for r in vectors.filter(size > 0).select(size.alias("n")).distinct().collect())
    out = vectors.filter(size <= 0).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for dims in lengths:
        out = out.unionByName(of_length(vectors.filter(size == dims), dims, cosine))
    return out


def of_length(vectors: DataFrame, dims: int, cosine: float) -> DataFrame:
    """near_vectors() of vectors that have dims components."""
    spark = vectors.sparkSession
    classes = classes_of(vectors, dims)
    marked = durable(classes.select("least", "rows", "embedding"), "classes")
    n = marked.count()
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = marked.select("embedding").orderBy(F.xxhash64("least"), "least").limit(SAMPLE_ROWS).collect()
    axes = spark.sparkContext.broadcast(principal_axes(unit(np.array([r["embedding"] for r in sample]))))
    epsilon = float(np.sqrt(2 - 2 * cosine))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            turned = unit(flat) @ axes.value if len(flat) else flat
            cells = np.floor(turned[:, :GRID] / epsilon).astype(np.int16) + np.int16(64)
            # cells as bytes sort in grid order
            key = np.clip(cells, 0, 127).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed([k.tobytes() for k in key]), packed([t.tobytes() for t in turned])], ["least", "rows", "cells", "vector"])

    turned = marked.mapInArrow(turn, "least long, rows long, cells binary, vector binary")
    count = int(min(INTERVALS, max(1, -(-n // 2048))))
    ordered = turned.repartitionByRange(count, "cells", "least").sortWithinPartitions("cells", "least").withColumn("interval", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            v = np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(-1, dims)
            box = np.concatenate([v[:, :GRID].min(axis=0), v[:, :GRID].max(axis=0)])
            ids, rows = (t[c].to_numpy().astype(np.int64) for c in ("least", "rows"))
            yield pa.RecordBatch.from_arrays([t["interval"].combine_chunks()[:1].cast(pa.int32()), pa.array([box.tolist()], pa.list_(pa.float64())), packed([ids.tobytes()]), packed([rows.tobytes()]), packed([v.tobytes()])], ["interval", "box", "ids", "rows", "vectors"])

    intervals = durable(ordered.select("interval", "least", "rows", "vector").mapInArrow(pack, "interval int, box array<double>, ids binary, rows binary, vectors binary"), "intervals")
    boxes = {r["interval"]: np.array(r["box"]) for r in intervals.select("interval", "box").collect()}
    pairs = [(a, b) for a in boxes for b in boxes if a <= b and (a == b or not boxes_apart(boxes[a].reshape(2, -1), boxes[b].reshape(2, -1), epsilon + 1e-9))]
    todo = spark.createDataFrame(pairs, "a int, b int").repartition(max(1, min(len(pairs), 4 * spark.sparkContext.defaultParallelism)))
    side = lambda x: intervals.select(F.col("interval").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("rows").alias(f"rows_{x}"), F.col("vectors").alias(f"vectors_{x}"))
    work = todo.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ids_a", "rows_a", "vectors_a", "ids_b", "rows_b", "vectors_b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)  # noqa: B023, E731
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                ids = [get(2, np.int64), get(5, np.int64)]
                weights = [get(3, np.int64), get(6, np.int64)]
                a, b = (get(c, np.float64).reshape(-1, dims) for c in (4, 7))
                degrees = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
                if same:
                    degrees[1] = degrees[0]
                shift = 0 if same else len(a)
                forest = Forest(shift + len(b))

                def found(i, j):
                    np.add.at(degrees[0], i, weights[1][j])  # noqa: B023
                    np.add.at(degrees[1], j, weights[0][i])  # noqa: B023
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        forest.join(x, y + shift)  # noqa: B023

                join_intervals(a, b, same, cosine, found)
                every = ids[0] if same else np.concatenate(ids)
                degree = degrees[0] if same else np.concatenate(degrees)
                hit = np.flatnonzero(degree)
                pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
                # rows (a, null, links of a), then rows (a, b, null)
                columns = [
                    np.concatenate([every[hit], every[pairs[:, 0]]]).tolist(),
                    [None] * len(hit) + every[pairs[:, 1]].tolist(),
                    degree[hit].tolist() + [None] * len(pairs),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    found = durable(work.mapInArrow(join, "a long, b long, links long"), "found")
    degree = found.filter("links IS NOT NULL").groupBy(F.col("a").alias("least")).agg(F.sum("links").alias("others"))
    groups = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "least")
    named = marked.join(degree, "least", "left").join(groups, "least", "left")
    named = durable(named.select("embedding", "rows", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "named")
    hot = F.col("rows") >= max(2, int(vectors.count() * HOT_SHARE))
    # at most 1 / HOT_SHARE classes
    first = vectors.join(F.broadcast(named.filter(hot).drop("rows")), "embedding", "left")
    done = first.filter("component_id IS NOT NULL").select("vec_id", "n_links", "component_id")
    rest = first.filter("component_id IS NULL").select("vec_id", "embedding").join(named.filter(~hot).drop("rows"), "embedding", "left")
    out = done.unionByName(rest.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.x = m.vec_id LEFT JOIN d ON d.x = m.vec_id
"""
