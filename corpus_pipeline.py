"""A corpus pipeline of the operators in ``lintel.llm``: raw documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it back as the next stage's ``docs``.
A lost executor therefore costs at most the running stage's own tasks. Every stage
keeps the columns of ``documents`` but the last, and works on null and empty
texts, repeated rows and empty tables as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import bpe, decontaminate, ngram_join, pii, toxicity
from lintel.llm.common import numbered, saved, table, without
from lintel.llm.queries import PII_KEY, RANKS, toxicity_net
from lintel.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity net doesn't reject at the threshold of their language.

    The scoring pass gives keys of rejected texts alone; a second one drops their rows, so
    that no task holds texts for Python and for a writer at once.
    """
    docs = docs.select(*COLUMNS)
    rejected = toxicity.rejected(docs, toxicity_net(spark, sf_dir))
    return without(docs.select("*", *toxicity.content_key()), rejected, "content_a", "content_b").select(*COLUMNS)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Rows with a null or repeated id are compared like all others, and go before rows with an id of their own.
    """
    docs = numbered(docs.select(*COLUMNS))
    groups = ngram_join.jaccard_join(docs, id="own_id")
    return without(docs, groups.filter("component_id <> doc_id").select("doc_id"), "own_id").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever their ids."""
    docs = numbered(docs.select(*COLUMNS))
    held = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), id="own_id")
    return without(docs, held.select("doc_id"), "own_id").select(*COLUMNS)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    out = pii.pseudonymised(docs.select(*COLUMNS), PII_KEY)
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of all documents, and the digest of what they decode to."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.round_trip(docs.select(*COLUMNS), path, pattern)
    return out.select("doc_id", "lang", "source", bpe.count().alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("near_duplicates", near_unique), ("decontamination", decontaminated), ("pii", pseudonymised), ("tokens", tokenised)]

#: SQL can express neither the classifier nor the tokeniser; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents of ``sf_dir``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
