"""Operator 9: near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and no further along any
axis. All vectors are turned onto the principal axes of the whole table and
sorted by their grid cells of that width on the leading axes (epsilon grid
order). The sorted sequence is cut into blocks; two blocks meet only if their
boxes are within the width. A pair of blocks is joined by recursion: sequence
intervals whose boxes are provably apart are skipped, others are halved until
they are small and compared in double precision on the original values.

Equal vectors are one vector with a weight before that, so a vector that fills a
third of the table costs one row a task. Inside a pair of blocks links are
counted, and for the components reduced to a spanning set: a cluster of m close
vectors gives about m rows for each block it meets, never m * m. Blocks are rows
of bounded size, dealt out by pair.

Defined results: null, empty or zero vectors and those with a null, NaN or
infinite component link with nothing and are kept; vectors of different length
don't link; repeated rows count as other vectors; rows of one id share links and
component; a null id links with nothing and has no component; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import saved
from lintel.llm.components import components

#: Leading principal axes of the grid; those of them that deal out blocks; vectors of a block and of a leaf; pairs of blocks of a task.
AXES, DEALT, BLOCK, LEAF, PAIRS = 8, 3, 8192, 512, 16


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an array of lists, in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # keeps very large and small values in range
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal axes of all vectors, from sums over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            u = _matrix(b.column(0), dim)
            u = np.hstack([u, np.ones((len(u), 1))])
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    sums = vectors.select("embedding").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim + 1) * (dim + 1))
    for r in sums:  # (dim + 1) squared numbers, whatever the number of vectors
        total[r.at] = r.v
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[dim, dim], 1.0)
    mean = total[dim, :dim] / n
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :min(AXES, dim)].copy()


def _blocks(vectors: DataFrame, dim: int, axes: np.ndarray, eps: float) -> DataFrame:
    """The vectors in epsilon grid order, cut into rows: ids, weights, values, and the box on the leading axes."""
    k = axes.shape[1]
    placed_schema = f"vec long, weight long, embedding {vectors.schema['embedding'].dataType.simpleString()}, cells array<int>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.floor(_matrix(b.column(2), dim) @ axes / eps).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, k, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["vec", "weight", "embedding", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row(vec, weight, u):
            p = u @ axes
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{nth:06d}"]), pa.array([vec.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()),
                 pa.array([u.tobytes()], pa.binary()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()])],
                names=["block", "vecs", "weights", "units", "lo", "hi"])

        def parts():
            whole = [np.concatenate(x) for x in zip(*held)]
            pieces = -(-len(whole[0]) // BLOCK)
            yield from zip(*(np.array_split(x, pieces) for x in whole))

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)))
            n += len(b)
            if n >= 4 * BLOCK:
                for p in parts():
                    yield row(*p)
                    nth += 1
                held, n = [], 0
        if n:
            for p in parts():
                yield row(*p)
                nth += 1

    placed = vectors.select("vec", "weight", "embedding").mapInArrow(place, placed_schema)
    keys = [F.col("cells")[i] for i in range(k)] + [F.xxhash64("vec")]
    return (placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("vec", "weight", "embedding")
            .mapInArrow(cut, "block string, vecs binary, weights binary, units binary, lo array<double>, hi array<double>"))


def _near_blocks(blocks: DataFrame, eps: float, dealt: int) -> DataFrame:
    """Pairs of blocks (a <= b) whose boxes are within ``eps``; each pair is met in one cell of the dealt axes."""
    box = blocks.select("block", "lo", "hi")
    for i in range(dealt):
        box = box.withColumn(f"l{i}", F.floor(F.col("lo")[i] / eps)).withColumn(f"h{i}", F.floor(F.col("hi")[i] / eps))

    def dealt_to(df: DataFrame, wide: int, name: str) -> DataFrame:
        for i in range(dealt):
            df = df.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"l{i}") - wide, F.col(f"h{i}") + wide)))
        return df.select(*[f"c{i}" for i in range(dealt)], F.col("block").alias(name), F.col("lo").alias(f"lo_{name}"),
                         F.col("hi").alias(f"hi_{name}"), *[F.col(f"l{i}").alias(f"l{i}_{name}") for i in range(dealt)])

    a, b = dealt_to(box, 0, "a"), dealt_to(box, 1, "b")
    met = a.join(b, [f"c{i}" for i in range(dealt)]).filter(F.col("a") <= F.col("b"))
    for i in range(dealt):
        met = met.filter(F.col(f"c{i}") == F.greatest(F.col(f"l{i}_a"), F.col(f"l{i}_b") - 1))
    gap = F.aggregate(F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y),
                                 F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
                                 lambda x, y: F.greatest(x, y, F.lit(0.0))),
                      F.lit(0.0), lambda s, g: s + g * g)
    return met.filter(gap <= eps * eps).select("a", "b")


class _Pair:
    """The links between two blocks, or inside one."""

    def __init__(self, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, axes: np.ndarray, eps: float, least: float, same: bool):
        self.a, self.wa, self.b, self.wb, self.eps2, self.least, self.same = a, wa, b, wb, eps * eps, least, same
        self.pa, self.pb = a @ axes, b @ axes
        self.na, self.nb = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root.setdefault(x, x)
        while root != self.root[root]:
            self.root[root] = self.root[self.root[root]]
            root = self.root[root]
        return root

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return  # the mirror image is joined
        pa, pb = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(np.maximum(pa.min(0) - pb.max(0), pb.min(0) - pa.max(0)), 0)
        if (gap * gap).sum() > self.eps2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.leaf(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self.join(a0, mid, b0, b1)
            self.join(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self.join(a0, a1, b0, mid)
            self.join(a0, a1, mid, b1)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        near = self.a[a0:a1] @ self.b[b0:b1].T >= self.least
        if self.same:  # each pair once
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        rows, cols = near.any(axis=1), near.any(axis=0)
        if not rows.any():
            return
        self.na[a0:a1] += near @ self.wb[b0:b1]
        self.nb[b0:b1] += self.wa[a0:a1] @ near
        ia, ib = np.flatnonzero(rows), np.flatnonzero(cols)
        near = near[np.ix_(ia, ib)]
        la, far = np.arange(len(ia)), len(ia)
        while True:  # smallest row that each row and column is connected with
            lb = np.where(near, la[:, None], far).min(axis=0)
            new = np.minimum(la, np.where(near, lb[None, :], far).min(axis=1))
            if (new == la).all():
                break
            la = new
        shift = 0 if self.same else len(self.a)
        for nodes, labels, off in ((ia + a0, la, 0), (ib + b0, lb, shift)):
            for node, label in zip((nodes + off).tolist(), (ia[labels] + a0).tolist()):
                x, y = self.find(node), self.find(label)
                self.root[max(x, y)] = min(x, y)


def _linked(pairs: DataFrame, blocks: DataFrame, dim: int, axes: np.ndarray, eps: float, least: float) -> DataFrame:
    """``(vec, other, n)``: vectors with links in a pair of blocks, one they are connected with there, their links there."""
    pairs = saved(pairs.withColumn("pair", F.concat_ws("|", "a", "b")), "block-pairs")
    tasks = -(-max(pairs.count(), 1) // PAIRS)
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = (sides.join(blocks.select("block", "vecs", "weights", "units"), "block")
             .repartition(tasks, "pair").sortWithinPartitions("pair", "block").select("pair", "vecs", "weights", "units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for r in zip(*b.columns):
                    yield r[0].as_py(), *(x.as_py() for x in r[1:])

        for _, some in groupby(rows(), key=lambda r: r[0]):
            sides = [(np.frombuffer(v, dtype=np.int64), np.frombuffer(w, dtype=np.int64), np.frombuffer(u).reshape(-1, dim)) for _, v, w, u in some]
            (va, wa, ua), (vb, wb, ub), same = sides[0], sides[-1], len(sides) == 1
            pair = _Pair(ua, wa, ub, wb, axes, eps, least, same)
            pair.join(0, len(ua), 0, len(ub))
            every = va if same else np.concatenate([va, vb])
            n = pair.na + pair.nb if same else np.concatenate([pair.na, pair.nb])
            at = np.flatnonzero(n)
            other = np.array([pair.find(x) for x in at.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(every[other] if len(at) else every[:0]), pa.array(n[at])],
                                             names=["vec", "other", "n"])

    return dealt.mapInArrow(run, "vec long, other long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.9, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = math.sqrt(max(2 - 2 * least, 0.0)) + 1e-9
    e = F.col("embedding")
    odd = e.isNull() | (F.size(e) == 0) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        | ~F.exists(e, lambda x: x != 0) | F.col("vec_id").isNull()
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("odd", F.coalesce(odd, F.lit(True)))
    sound = rows.filter("NOT odd").select("vec_id", "embedding")
    single = saved(sound.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight")), "vectors")
    links = None
    for (dim,) in single.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        own = single.filter(F.size("embedding") == dim)
        axes = _axes(own, dim)
        blocks = saved(_blocks(own, dim, axes, eps), "blocks")
        found = _linked(_near_blocks(blocks, eps, min(DEALT, axes.shape[1])), blocks, dim, axes, eps, least)
        links = found if links is None else links.unionByName(found)
    lone = rows.filter("odd").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if links is None:
        done = lone
    else:
        links = saved(links, "vector-links")
        same = components(links.select(F.col("vec").alias("a"), F.col("other").alias("b")))
        counted = links.groupBy("vec").agg(F.sum("n").alias("n"))
        # An id with several values has the sum of their rows.
        weights = single.groupBy("vec").agg((F.sum("weight") - F.count("*")).alias("copies"))
        known = (weights.join(counted, "vec", "left").join(same.withColumnRenamed("node", "vec"), "vec", "left")
                 .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies")).alias("n_links"), F.coalesce("component", "vec").alias("component_id")))
        of = sound.join(single.select("embedding", "vec"), "embedding").select("vec_id", "vec")
        done = of.join(known, "vec").select("vec_id", "n_links", "component_id").unionByName(lone)
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
