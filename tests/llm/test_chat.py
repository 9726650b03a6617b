"""Operator 8: folds, escapes and digests by hand."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lintel.llm import chat


def test_escapes_are_reversible():
    parts = ["\\", "#", "##", "###", "</turn>", "</turn", ">", "\n", "### User: ", "a", ":", "### @x: "]
    r = random.Random(0)
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)] + ["".join(r.choices(parts, k=12)) for _ in range(500)]
    for role in ("user", "assistant", "system", "tool:x", "", "### a\\", "User"):
        whole = "".join(chat.render(role, t)[0] for t in texts)
        assert [(a, b) for a, b, _, _ in chat.parse(whole)] == [(role, t) for t in texts]


def test_long_texts_parse():
    text = "\\#<" * 200_000
    assert next(chat.parse(chat.render("user", text)[0]))[1] == text


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, message string, seq int, kind string, role string, text string").withColumn("formatted", F.lit(0))


def test_events_fold_into_messages(spark):
    rows = [(1, 0, "a", 0, "message", "user", "hi"), (1, 1, "a", 2, "delta", None, "lo"), (1, 1, "a", 0, "message", "assistant", ""), (1, 1, "a", 1, "delta", None, "hel"),
            (1, 2, "a", 0, "message", "user", "x"), (1, 2, "a", 1, "edit", None, "y"), (1, 3, "a", 0, "message", "assistant", "bad"), (1, 3, "a", 1, "regenerate", None, None),
            (1, 3, "a", 2, "delta", None, "good"), (1, 4, "a", 0, None, "user", None), (1, 5, "a", 0, "message", "user", "gone"), (1, 5, "a", 1, "delete", None, None),
            (2, 0, "a", 0, "message", None, "n"), (None, None, "a", 0, "message", "user", "q")]
    got = chat.format_chats(log(spark, rows)).collect()
    said = {}
    for r in got:
        said.setdefault(r.conv_id, []).append(next(chat.parse(r.formatted))[:2])
    assert said == {1: [("user", "hi"), ("assistant", "hello"), ("user", "y"), ("assistant", "good"), ("user", "")], 2: [("", "n")], None: [("user", "q")]}
    whole = "".join(r.formatted for r in got if r.conv_id == 1)
    assert [whole[r.loss_start:r.loss_end] for r in got if r.loss_start is not None] == ["hello", "good"]
    assert chat.format_chats(log(spark, [])).count() == 0


def test_an_unknown_event_is_an_error(spark):
    with pytest.raises(Exception, match="unknown event"):
        chat.format_chats(log(spark, [(1, 0, "a", 0, "shout", "user", "x")])).collect()


def test_digests_of_all_conversations(spark):
    said = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky), (-8, 0, "assistant", None), (-8, 0, "assistant", None), (-9, 0, "assistant", "\U0001f600é" * 5000)]
    table = said.unionByName(spark.createDataFrame(extra, said.schema))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.log_of(table))).collect()}
    by = {}
    for r in table.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(chat.render(*t)[0] for t in turns)
        assert tuple(got[conv])[1:] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                                        len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole))
