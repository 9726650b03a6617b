"""Operator 13: every token exactly once, all limits kept, ids as the tokenizers library gives them."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintel.llm import packing
from lintel.llm.packing import Limits, Packer, Piece

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def packed(examples, limits):
    packer, out = Packer(limits), []
    for p in examples:
        out += [*packer.add(p), *packer.ready()]
    return out + list(packer.rest())


def example(k, n, share, r):
    mask = None if share is None else np.array([int(r.random() < share) for _ in range(n)], dtype=np.uint8)
    return Piece(k, np.array([k * 1000 + i for i in range(n)], dtype="<u4"), mask, 0, n)


@pytest.mark.parametrize("limits", [Limits(64, 4, 64), Limits(64, 64, 20), Limits(60, 3, 25, powers=False), Limits(1, 1, 1), Limits(64, 1, 64), Limits(32, 5, 3)])
@pytest.mark.parametrize("share", [None, 0.0, 0.3, 1.0])
def test_limits_hold_and_each_token_is_in_one_piece(monkeypatch, limits, share):
    monkeypatch.setattr(packing, "WINDOW", 16)
    r = random.Random(limits.tokens + limits.segments)
    examples = [example(k, r.choice([0, 1, 2, 3, 7, 30, 64, 200]), share, r) for k in range(120)]
    out = packed(examples, limits)
    seen = {}
    for s in out:
        n = sum(len(p.ids) for p in s)
        assert 0 < n <= limits.tokens and len(s) <= limits.segments and sum(p.loss() for p in s) <= limits.loss
        assert not limits.powers or n == limits.tokens or n & (n - 1) == 0
        for p in s:
            seen.setdefault(p.key, []).append(p)
    for e in examples:
        parts = sorted(seen.get(e.key, []), key=lambda p: p.start)
        assert np.array_equal(np.concatenate([np.zeros(0), *(p.ids for p in parts)]), e.ids)
        assert [p.start for p in parts] == np.cumsum([0, *(len(p.ids) for p in parts)])[:-1].tolist()
        assert e.mask is None or np.array_equal(np.concatenate([np.zeros(0), *(p.mask for p in parts)]), e.mask)


def test_few_examples_are_cut_and_sequences_are_full():
    r = random.Random(1)
    examples = [example(k, min(int(r.paretovariate(1.0) * 40), 5000), None, r) for k in range(3000)]
    limits = Limits(2048, 64, 2048)
    out = packed(examples, limits)
    full = sum(sum(len(p.ids) for p in s) == 2048 for s in out)
    pieces = sum(map(len, out))
    assert full >= len(out) - 11
    assert pieces - len(examples) < 2 * len(out)


def test_loss_limit_mixes_prompts_with_answers():
    """Examples without loss fill what examples with loss leave open."""
    r = random.Random(2)
    examples = [example(k, 50, 1.0 if k % 2 else 0.0, r) for k in range(400)]
    out = packed(examples, Limits(100, 10, 50, powers=False))
    assert sum(sum(len(p.ids) for p in s) == 100 for s in out) >= 0.95 * len(out)


def test_ids_of_random_texts(tok):
    r = random.Random(5)
    letters = [chr(i) for i in [*range(9, 14), *range(28, 127), *range(0x80, 0x250), *range(0x2000, 0x2030), *range(0x4E00, 0x4E20)]] + [" ", "  ", "　", " ", "᠎", "​", "﻿", "'s", "\U0001f600"]
    texts = ["".join(r.choices(r.sample(letters, r.choice([1, 2, 3, 8, 30])), k=r.choice([0, 1, 3, 10, 60]))) for _ in range(6000)]
    encode = packing.Encoder(PATH)
    assert encode.fast
    texts += ["a<|endoftext|>b", " <|endoftext|>", "x  <|endoftext|>\n<|endoftext", "<|endoftext|> a b"]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_file_of_another_kind_is_left_to_its_library():
    other = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encode = packing.Encoder(P.path("word_bpe_49k.json"))
    assert not encode.fast
    assert encode("Some words, 12 of them").tolist() == other.encode("Some words, 12 of them", add_special_tokens=False).ids


def test_whole_documents_and_edges(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x y " * 60_000), (-4, "z" * 50_000), (-5, "<|endoftext|> a")], docs.schema)
    all_docs = docs.unionByName(extra)
    rows = packing.pack_texts(all_docs.withColumn("ids", F.lit(1)).withColumn("start", F.lit("x")), PATH, 1, Limits()).collect()
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in all_docs.collect()}
    got, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.length == len(ids) and r.doc_tokens == len(want[r.doc_id]) and want[r.doc_id][r.start:r.start + r.length] == ids
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {k: len(v) for k, v in want.items()}
    for s in sequences.values():
        s.sort()
        n = sum(length for _, length in s)
        assert [o for o, _ in s] == np.cumsum([0, *(length for _, length in s)])[:-1].tolist() and n <= 2048 and len(s) <= 64 and (n == 2048 or n & (n - 1) == 0)
    assert packing.pack_texts(docs.limit(0), PATH, 1, Limits()).count() == 0


def test_given_ids_masks_and_rendered_sequences(spark):
    r = random.Random(9)
    data = []
    for k in [None, 1, 1, *range(2, 60)]:
        n = r.choice([0, 3, 17, 40, 90])
        data.append((k, np.array([r.randrange(1, 9) for _ in range(n)], dtype="<u4").tobytes(), bytes(r.choice([0, 1]) for _ in range(n)) if n % 2 else None))
    data.append((77, None, None))
    df = spark.createDataFrame(data, "doc_id long, token_ids binary, mask binary").coalesce(2)
    limits = Limits(64, 5, 30, powers=False)
    pieces = packing.pack_ids(df, limits, loss_mask="mask")
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(x) // 4 for _, x, _ in data if x)
    rows = packing.sequences(pieces, limits, pad=0).collect()
    for s in rows:
        ids, segments, mask = np.frombuffer(s.input_ids, dtype="<u4"), np.frombuffer(s.segment_ids, dtype="<u4"), np.frombuffer(s.loss_mask, dtype=np.uint8)
        assert len(ids) == len(segments) == len(mask) == 64 and (ids > 0).sum() == (segments > 0).sum() == s.n_tokens and mask.sum() <= 30 and segments.max() <= 5
    with pytest.raises(Exception, match="loss mask"):
        packing.pack_ids(spark.createDataFrame([(1, b"\0" * 8, b"\1")], df.schema), limits, loss_mask="mask").collect()


def test_the_query(spark, tok):
    from lintel.llm.queries import QUERIES
    rows = QUERIES["op13_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[:200]:
        ids = [*tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
