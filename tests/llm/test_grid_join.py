"""Operator 9 against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import grid_join


def expected(rows, least=0.9):
    ok = [(i, np.array(e, dtype=float)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(ok):
        for j, y in ok[a + 1:]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) if i is not None else (0, None, False) for i, _ in rows}


def run(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumn("vec", F.lit(1)).withColumn("block", F.lit("x"))
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_join.near_vectors(df).collect()}


def vectors(dim, n, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(n // 8, 1), dim))
    near = base[r.integers(len(base), size=n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.25, 0.45], size=(n, 1))
    return [(i, [float(np.float32(x)) for x in v * r.choice([0.01, 1, 300])]) for i, v in enumerate(near)]


@pytest.mark.parametrize("dim, block, leaf", [(3, 16, 4), (24, 40, 16), (24, 8192, 512), (1, 8, 4)])
def test_all_pairs(spark, monkeypatch, dim, block, leaf):
    monkeypatch.setattr(grid_join, "BLOCK", block)
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    rows = vectors(dim, 240, dim + block)
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0]),
            (11, [1.0, 2.0, 0.0]), (12, [-1.0, -2.0]), (13, [1e-30, 2e-30]), (14, [1e30, 2e30]), (None, [1.0, 2.0])]
    want = expected(rows)
    assert run(spark, rows) == want
    assert run(spark, [(i, e) for i, e in rows if i in (1, 2, 3)]) == {i: (0, i, True) for i in (1, 2, 3)}
    assert run(spark, []) == {}
    assert run(spark, rows, "array<double>") == want


def test_a_chain_is_one_component(spark):
    rows = [(i, [float(np.cos(i * 0.4)), float(np.sin(i * 0.4))]) for i in range(12)]
    assert run(spark, rows) == expected(rows)
