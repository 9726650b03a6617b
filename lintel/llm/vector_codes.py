"""Operator 12: vector code compression with per-dimension value dictionaries.

Every component becomes the integer floor(scale * x). A vector is cut into equal
parts; a part is coded by its nearest entry in the codebook of that part.

The vectors are stored once, in blocks. A block holds for each dimension the
dictionary of the distinct integers there and a 2-byte dictionary code for each
vector. To compare a block with a codebook, the squared differences of all
dictionary values to all entries are tabulated; the distances of a part are then
rows gathered from these tables by the codes and added up. No component is
multiplied twice, and all arithmetic is on integers, hence exact.

The rounds read the blocks anew; a task adds up its own blocks and returns at most
one row for each entry, so that a round shuffles some thousand rows a task and
the driver gets one row for each entry (``parts * entries`` of them, set by
parameters). No step pairs vectors. Label sums are joined back with labels dealt
out over ``SALTS`` keys, so that a label with most of the rows stays spread.

Defined results: rows whose vector is null or holds null or non-finite components
are left out; equal vectors are coded alike, repeated ids stay rows of their own;
a null id comes last in the order that starts the codebooks, ties there go by the
vector; fewer vectors than entries give shorter codebooks, none give no rows; null
labels are summed together; other columns are not carried. Vectors of several lengths,
lengths that the parts don't divide and components beyond ``LARGEST`` (their
distances would pass 64 bits) raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lintel.llm.common import saved

#: Vectors of a block (its codes have two bytes), vectors compared at once.
BLOCK, AT_ONCE = 4096, 512
#: The largest integer component.
LARGEST = 1 << 26
#: Keys over which the rows of one label are dealt when its sum is joined back.
SALTS = 64


@dataclass
class Codebooks:
    """``entries[p]``: the entries of part ``p``, one a row."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components as decimals by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.ravel()).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """Whether a vector is there with finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); the product is exact in double precision for powers of two."""
    out = np.floor(flat.astype(np.float64) * scale)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return out.astype(np.int64)


def _blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """Rows (key, label, vector) as one row a block: keys, labels, dictionaries and codes."""
    key, label, _ = rows.schema.fields
    schema = StructType([StructField("keys", ArrayType(key.dataType)), StructField("labels", ArrayType(label.dataType)),
                         StructField("sizes", BinaryType()), StructField("values", BinaryType()), StructField("codes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                v = _integers(some.column(2).flatten().to_numpy(zero_copy_only=False), scale).reshape(some.num_rows, dims)
                known = [np.unique(v[:, d], return_inverse=True) for d in range(dims)]
                whole_block = pa.array([0, some.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(whole_block, some.column(0)), pa.ListArray.from_arrays(whole_block, some.column(1)),
                    pa.array([np.array([len(x) for x, _ in known], dtype=np.int32).tobytes()], pa.binary()),
                    pa.array([np.concatenate([np.zeros(0, np.int64), *(x for x, _ in known)]).tobytes()], pa.binary()),
                    pa.array([b"".join([code.astype(np.uint16).tobytes() for _, code in known])], pa.binary())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _read(row: dict, dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionaries of a block and its codes, one dimension a row."""
    sizes = np.frombuffer(row["sizes"], dtype=np.int32)
    values = np.split(np.frombuffer(row["values"], dtype=np.int64), np.cumsum(sizes)[:-1])
    return values, np.frombuffer(row["codes"], dtype=np.uint16).reshape(dims, -1)


def nearest(values: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a block the nearest entry of one part (the lowest of equals) and its squared distance."""
    n, width = codes.shape[1], len(values)
    span = max((int(max(v[-1], entries[:, d].max()) - min(v[0], entries[:, d].min())) for d, v in enumerate(values)), default=0)
    kind = np.int32 if width * span * span < 1 << 31 else np.int64
    tables = [((v[:, None] - entries[:, d]) ** 2).astype(kind) for d, v in enumerate(values)]
    best, far = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        some = codes[:, at:at + AT_ONCE]
        total = np.zeros((some.shape[1], len(entries)), dtype=kind)
        for table, code in zip(tables, some):
            total += table[code]
        best[at:at + AT_ONCE] = total.argmin(axis=1)
        far[at:at + AT_ONCE] = total.min(axis=1)
    return best, far


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, {name: batch.column(name)[i].as_py() for name in ("sizes", "values", "codes")}


def _improved(blocks: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floored mean of its parts."""
    entries = books.entries
    width = dims // len(entries)
    schema = StructType([StructField("part", IntegerType()), StructField("entry", IntegerType()), StructField("n", LongType()),
                         *(StructField(f"s{d}", LongType()) for d in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(e.shape, dtype=np.int64) for e in entries], [np.zeros(len(e), dtype=np.int64) for e in entries]
        for _, _, row in _rows(batches):
            values, codes = _read(row, dims)
            for p, e in enumerate(entries):
                own, part = values[p * width:(p + 1) * width], codes[p * width:(p + 1) * width]
                best, _ = nearest(own, part, e)
                counts[p] += np.bincount(best, minlength=len(e))
                np.add.at(sums[p], best, np.stack([v[code] for v, code in zip(own, part)], axis=1) if width else np.zeros((len(best), 0), np.int64))
        for p, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]),
                                              *(pa.array(s[used, d]) for d in range(width))], names=[f.name for f in schema])

    found = blocks.select("sizes", "values", "codes").mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(f.name).alias(f.name) for f in schema.fields[2:]])
    better = [e.copy() for e in entries]
    for r in found.collect():  # at most one row for each entry
        better[r.part][r.entry] = [r[3 + d] // r.n for d in range(width)]
    return Codebooks(better)


def _coded(blocks: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """One row for each vector: key_, label_, code, error, salt_."""
    entries = books.entries
    width, digits = dims // len(entries), max(2, len(f"{max(len(e) for e in entries) - 1:x}"))
    schema = StructType([StructField("key_", blocks.schema["keys"].dataType.elementType), StructField("label_", blocks.schema["labels"].dataType.elementType),
                         StructField("code", StringType()), StructField("error", LongType()), StructField("salt_", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, row in _rows(batches):
            values, codes = _read(row, dims)
            found = [nearest(values[p * width:(p + 1) * width], codes[p * width:(p + 1) * width], e) for p, e in enumerate(entries)]
            best = np.stack([b for b, _ in found], axis=1)
            written = ["".join([f"{x:0{digits}x}" for x in one]) for one in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("keys").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(), pa.array(written),
                                              pa.array(sum(far for _, far in found)), pa.array(np.arange(len(written), dtype=np.int32) % SALTS)],
                                             names=[f.name for f in schema])

    return blocks.mapInArrow(run, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """``(rows, codebooks)``: for each vector key, label, code (hex digits of the entries in part order), error and label_error."""
    rows = df.select(F.col(key).alias("key_"), F.col(label).alias("label_"), F.col(vector).cast("array<double>").alias("vector_")).filter(whole(F.col("vector_")))
    sizes = rows.agg(F.min(F.size("vector_")).alias("least"), F.max(F.size("vector_")).alias("most")).first()
    if sizes.least != sizes.most or (sizes.most or 0) % parts:
        raise ValueError(f"vectors have {sizes.least} to {sizes.most} components; one length is needed that {parts} divides")
    names = [F.col("key_").alias(key), F.col("label_").alias(label), "code", "error"]
    if sizes.most is None:
        none = rows.select("key_", "label_", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.limit(0).select(*names, "label_error"), Codebooks([np.zeros((0, 0), dtype=np.int64)] * parts)
    dims = sizes.most
    blocks = saved(_blocks(rows, dims, scale), "vector-blocks")
    first = rows.orderBy(F.col("key_").asc_nulls_last(), "vector_").select("vector_").limit(entries).collect()  # bounded by ``entries``
    start = _integers(np.array([r[0] for r in first]).reshape(-1), scale).reshape(len(first), parts, dims // parts)
    books = Codebooks([start[:, p].copy() for p in range(parts)])
    for _ in range(rounds):
        books = _improved(blocks, books, dims)
    coded = saved(_coded(blocks, books, dims), "vector-codes")
    sums = (coded.groupBy("label_").agg(F.sum("error").alias("label_error"))
            .select(F.col("label_").alias("of_"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("dealt_")))
    out = coded.join(sums, F.col("label_").eqNullSafe(F.col("of_")) & (F.col("salt_") == F.col("dealt_")))
    return out.select(*names, "label_error"), books
