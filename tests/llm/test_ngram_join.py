"""Operator 2 against all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lintel.llm import ngram_join
from lintel.llm.components import components


def sets_of(rows):
    out = {}
    for i, x in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (x or "").encode()))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def expected(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        n = len(a & b)
        if n and 100 * n >= 75 * (len(a) + len(b) - n):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df).collect()}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=r.choice([1, 2, 5])))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(60):
        base = [word() for _ in range(r.choice([3, 6, 12, 40, 90]))]
        if k % 3 == 0:
            base = base + passage.split()
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                at = r.randrange(len(copy))
                copy[at] = word() if r.random() < 0.7 else copy[at].upper()
            rows.append((len(rows), r.choice([" ", "  ", "\n", "\t "]).join(copy)))
    return rows


def test_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == expected(rows)


def test_a_large_group_of_near_copies_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "SALT", 10)
    monkeypatch.setattr(ngram_join, "PACK_SHINGLES", 2_000)
    r = random.Random(1)
    base = [f"w{r.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(80)] = f"v{r.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    assert run(spark, rows) == expected(rows)


def test_the_threshold_is_exact(spark):
    a = [f"a{i}" for i in range(25)]  # 21 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:22])), (3, " ".join(a[3:] + ["q", "r", "s"])), (4, " ".join(a[4:] + ["q", "r", "s", "t"]))]
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one"), (9, "x " * 60_000), (8, "x " * 50_000), (7, "\u00a0 a")]
    want = expected(rows)
    assert run(spark, rows, n=F.lit(1), h=F.lit("x"), component=F.lit(2), text_=F.lit(None)) == want
    assert run(spark, [*rows, (4, "one two"), (None, "one two")]) == want
    assert run(spark, []) == {}


def test_divide_skip():
    lists = [[1, 4], [1, 2, 4], [2, 4, 5], [1, 2, 3, 4, 5, 6], [2, 4, 6]]
    want = {m: sum(m in x for x in lists) for m in range(7) if sum(m in x for x in lists) >= 3}
    assert dict(ngram_join.divide_skip(lists[:3], lists[3:], 1, 3)) == want


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (4, 4), (None, 1), (9, 8), (8, 7)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
