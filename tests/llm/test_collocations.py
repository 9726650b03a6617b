"""Operator 11 against phrases counted at every place."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import collocations

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(rows, words=3, least=10, share=50, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            lang = "und" if lang is None else lang
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + n])) for n in range(1, words + 1) for i in range(len(w) - n + 1))
    out = {}
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in frequent.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i:i + n]] = max(longer[lang, p[i:i + n]], a)
    for (lang, p), a in frequent.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("rank", F.lit(1)).withColumn("chunk_", F.lit("x"))
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [*"abcdefgh", "The", "THE", "Ärger", "été", "x" * 70, "日本", "\x1c", "-", "'s", "und"]
    fixed = ["new york city hall", "as well as", "a b a b a b", "one\ttwo  three", "the end, of the"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "; ", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join((r.choice(fixed) if r.random() < 0.2 else r.choice(vocabulary)) + r.choice(gaps) for _ in range(r.choice([0, 1, 2, 5, 40, 200])))
        rows.append((text, r.choice(["en", "en", "fr", None, "und"])))
    return rows + rows[:5] * 3 + [(None, "en"), ("", None), (" ,. ", "de"), ("z " * 500, "de")]


@pytest.mark.parametrize("seed, sparse, words, least", [(1, 16, 3, 10), (2, 1, 3, 3), (3, 2, 4, 4), (4, 3, 2, 5), (5, 1000, 3, 5)])
def test_plain(spark, monkeypatch, seed, sparse, words, least):
    monkeypatch.setattr(collocations, "SPARSE", sparse)
    monkeypatch.setattr(collocations, "COUNT_BYTES", 3_000_000 if seed % 2 else 300)  # one group of chunks, or many
    rows = corpus(seed, 60)
    assert run(spark, rows, words=words, least=least) == plain(rows, words, least)


def test_every_phrase_is_owned_by_one_chunk(monkeypatch):
    monkeypatch.setattr(collocations, "SPARSE", 3)
    texts = [(t or "").encode() for t, _ in corpus(7, 50)]
    found = [c for cs in collocations.chunks(texts, 3) for c in cs]
    for n in (1, 2, 3):
        lang, phrase, f = collocations.counted(pa.array(found), pa.array(["en"] * len(found)), np.ones(len(found), dtype=np.int64), n, 3, None)
        want = Counter()
        for t in texts:
            for piece in re.split(rb"[.,;:!?\n-\r]", t.lower()):
                w = re.findall(rb"[^ \t]+", piece)
                want.update(b" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
        assert dict(zip(phrase.to_pylist(), f.tolist())) == want


def test_kinds_beyond_one_number():
    r = np.random.default_rng(1)
    a, b, c = r.integers(0, 5, 200), r.integers(0, 4, 200), r.integers(0, 3, 200)
    first, kind = collocations._distinct([(a, 1 << 30), (b, 1 << 30), (c, 1 << 30)])
    rows = list(zip(a, b, c))
    assert len(first) == len(set(rows)) and all(rows[first[k]] == row for k, row in zip(kind, rows))


def test_a_full_filter_costs_work_only(spark, monkeypatch):
    rows = corpus(8, 40)
    want = plain(rows, least=4)
    monkeypatch.setattr(collocations, "FILTER_BITS", 64 * 8)
    assert run(spark, rows, least=4) == want


def test_ties_top_and_empty_tables(spark):
    rows = [("p q. r s. t u", "en")] * 12 + [("v w", "fr")] * 10
    assert run(spark, rows, top=2) == plain(rows, top=2)
    assert run(spark, [], top=2) == [] and run(spark, [(None, None), ("a b", "en")]) == []
