"""Operator 1 against the tiktoken library, and an exact round trip."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lintel.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tok():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Merges.load(PATH, P.PATTERN)


def test_random_strings(tok, vocabulary):
    r = random.Random(3)
    letters = [chr(i) for i in [*range(32, 127), *range(0xC0, 0x250), *range(0x400, 0x460), *range(0x4E00, 0x4E40)]] + ["\n", "\t", " ", "  ", "\u00a0", "\x1c", "\U0001f600"]
    for _ in range(3000):
        s = "".join(r.choices(r.sample(letters, r.choice([1, 2, 3, 8, 30])), k=r.choice([1, 3, 10, 60])))
        ids = list(bpe.unpack(vocabulary.encode(s)))
        assert ids == tok.encode_ordinary(s)
        assert vocabulary.decode(vocabulary.encode(s)) == s.encode()


def test_a_piece_without_a_break_takes_linear_time(tok, vocabulary):
    s = "ab" * 50_000 + "zzzy" * 20_000
    assert list(bpe.unpack(vocabulary.encode(s))) == tok.encode_ordinary(s)


def test_other_patterns_aren_t_cut_at_spaces(tok, vocabulary):
    whole = bpe.Merges(vocabulary.ranks, r"(?s).+")
    own = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    assert list(bpe.unpack(whole.encode("one two  three"))) == own.encode_ordinary("one two  three")


@pytest.mark.parametrize("text", ["a\n \nb", "a\n ", "a\t \nb", "a \nb c", "a\u00a0 \n b", " a b\n c"])
def test_white_space_runs_with_a_space_inside_are_whole(vocabulary, text):
    runs = [b"\n ", b"\t \n", b"\n \n", b" \n", "\u00a0 \n".encode(), b"\t ", "\u00a0 ".encode()]
    ranks = vocabulary.ranks | {x: len(vocabulary.ranks) + i for i, x in enumerate(runs) if x not in vocabulary.ranks}
    own = tiktoken.Encoding("runs", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(bpe.unpack(bpe.Merges(ranks, P.PATTERN).encode(text))) == own.encode_ordinary(text)


def test_whole_documents_and_edges(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, "x" * 300_000), (None, " a")], docs.schema)
    out = bpe.decode(bpe.encode(docs.unionByName(extra).withColumn("decoded", F.lit(1)), PATH, P.PATTERN), PATH, P.PATTERN)
    rows = out.withColumn("n", bpe.count()).collect()
    assert len(rows) == docs.count() + 5
    for r in rows:
        ids = list(bpe.unpack(bytes(r.token_ids)))
        assert ids == tok.encode_ordinary(r.text or "") and r.n == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.round_trip(docs.unionByName(extra).withColumn("both", F.lit(1)), PATH, P.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.token_ids), bytes(r.decoded), r.both) for r in both.collect()) == sorted((str(r.doc_id), bytes(r.token_ids), bytes(r.decoded), 1) for r in rows)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0 == bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count()
