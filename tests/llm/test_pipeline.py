"""The corpus pipeline: what each stage keeps, on whole small tables and on edges."""

import os
import subprocess
import sys

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lintel.llm import bpe, decontaminate, ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    first = d.filter("length(text) > 100").orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    extra = [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, first.text + " more", "en", "s", 1), (10_002, "", "en", "s", 0),
             (10_004, "you idiot moron " * 30, "en", "s", 480), (None, "no id at all", "en", "s", 12),
             # rows that only a number of their own tells apart: a copy and a benchmark item without an id, an id with two texts, one of them a copy
             (None, first.text, "en", "s", 2), (None, "before " + item + " behind", "en", "s", 3), (10_005, "this text is not like the other one", "en", "s", 4), (10_005, first.text, "en", "s", 5)]
    return d.unionByName(spark.createDataFrame(extra, d.schema)).withColumn("score", F.lit("x"))


def test_stages_one_after_the_other(spark, docs):
    kept = docs
    for name, stage in C.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF).cache()
        assert kept.columns == C.COLUMNS, name
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(before.filter("doc_id IS NOT NULL AND doc_id NOT IN (10002, 10005)")).collect()}
            ids = [r.doc_id for r in kept.select("doc_id").collect()]
            assert sorted(i for i in ids if i not in (None, 10_002, 10_005)) == sorted(set(groups.values())) and 10_003 not in ids
            assert sorted(i for i in ids if i in (10_002, 10_005)) == [10_002, 10_002, 10_005]
            assert [r.text[:3] for r in kept.filter("doc_id IS NULL").orderBy("text").collect()] == ["bef", "no "]
        elif name == "decontamination":
            held = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == held
            assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == ["no id at all"]
        elif name == "pii":
            assert kept.count() == before.count()
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 10_001, 10_002} <= ids
    out = C.STAGES[-1][1](spark, kept, SF).collect()
    vocabulary = bpe.Merges.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = {r.doc_id: r.text or "" for r in kept.collect()}
    assert len(out) == kept.count() and all(vocabulary.decode(bytes(r.token_ids)).decode() == text[r.doc_id] for r in out)


def test_empty_documents(spark, docs):
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_decontamination_of_a_long_document_full_of_items_fits_a_small_heap(tmp_path):
    code = """
import sys
import corpus_pipeline
from lintel.session import get_spark
spark = get_spark("local[2]", **{"spark.driver.memory": "700m"})
passage = [f"word{i}" for i in range(30)]
items = [(k, " ".join([*passage[:-1], f"end{k}"])) for k in range(20)]
spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sys.argv[1]}/benchmark.parquet")
texts = [(1, " ".join(passage * 667)), (None, items[4][1]), (2, "nothing " * 50), (2, "else " * 50), (None, None)]
docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
left = corpus_pipeline.decontaminated(spark, docs, sys.argv[1]).collect()
print("LEFT", sorted(str((x.doc_id, (x.text or "")[:3])) for x in left) == sorted(["(2, 'not')", "(2, 'els')", "(None, '')"]))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, cwd=root, capture_output=True, text=True, timeout=300)
    assert "LEFT True" in said.stdout, said.stderr[-2000:]
