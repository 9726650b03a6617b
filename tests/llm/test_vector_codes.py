"""Operator 12 against a plain computation with Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lintel.llm import vector_codes


def plain(rows, parts, entries, rounds):
    """``(id, label, vector)`` rows, worked through one by one."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = len(kept[0][2]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0], kept[j][2]) if kept[j][0] is not None else (True, 0, kept[j][2]))
    books = [[cut[j][p] for j in order[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for k, members in own.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, label, _), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, sums[label]) for (i, label, _), f, e in zip(kept, found, errors)), digest


def run(spark, rows, kind="array<float>", **how):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding {kind}").withColumn("code", F.lit(1)).withColumn("salt_", F.lit(2))
    out, books = vector_codes.compress(df, **how)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out.collect()), books


def vectors(n, dims, seed):
    r = random.Random(seed)
    base = [[r.uniform(-0.6, 0.6) for _ in range(dims)] for _ in range(max(n // 9, 2))]
    return [(i, r.choice([0, 0, 0, 1, 2, None]), [float(x + r.gauss(0, 0.02)) for x in r.choice(base)]) for i in range(n)]


@pytest.mark.parametrize("n, dims, parts, entries, block", [(150, 8, 4, 16, 4096), (70, 12, 4, 256, 32), (200, 4, 2, 5, 7), (40, 4, 4, 8, 4096)])
def test_plain(spark, monkeypatch, n, dims, parts, entries, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = vectors(n, dims, n)
    want, digest = plain(rows, parts, entries, 4)
    got, books = run(spark, rows, "array<double>", parts=parts, entries=entries)
    assert got == want and books.sha256() == digest


def test_ties_repeats_and_unused_entries(spark):
    rows = [(i % 7, i % 3, [float(i % 4), 0.5, -0.25, float(i % 2)]) for i in range(40)] + [(None, None, [9.0, 9.0, -9.0, 1.0]), (None, 1, [1.0, 0.5, -0.25, 0.0])]
    want, digest = plain(rows, 4, 6, 4)
    got, books = run(spark, rows, entries=6)
    assert got == want and books.sha256() == digest


def test_vectors_left_out_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, 1, None), (2, 1, [nan, 0.0, 0.0, 0.0]), (3, None, [1.0, None, 0.0, 0.0]), (4, 2, [inf, 0.0, 0.0, 0.0]), (5, 2, [0.0, 0.0, 0.0, -inf])]
    assert run(spark, bad)[0] == [] and run(spark, [])[0] == []
    rows = [*bad, (6, 2, [-0.1, 0.2, 0.3, 0.4])]
    assert run(spark, rows)[0] == [("6", "00000000", 0, 0)]
    with pytest.raises(ValueError, match="components"):
        run(spark, [(1, 1, [1.0] * 4), (2, 1, [1.0] * 8)])
    with pytest.raises(ValueError, match="components"):
        run(spark, [(1, 1, [1.0] * 6)])


def test_large_components_are_exact(spark):
    r = random.Random(4)
    rows = [(i, 0, [r.uniform(-60000, 60000) for _ in range(8)]) for i in range(60)]
    want, digest = plain(rows, 4, 10, 4)
    got, books = run(spark, rows, "array<double>", entries=10)
    assert got == want and books.sha256() == digest
