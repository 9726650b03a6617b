"""Registered queries of the operators: ``name -> (spark, sf_dir) -> DataFrame``.

Each query derives its result columns from the output of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import bpe, chat, collocations, decontaminate, grid_join, langid, license_scan, ngram_join, packing, pii, toxicity, url_filter, vector_codes
from lintel.llm.common import table
from lintel.llm.oracle import SQL

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark, sf_dir) -> DataFrame:
    """Encode every document, decode the ids again; digests of both."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, path, pattern)
    return out.select("doc_id", bpe.count().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_join(spark, sf_dir) -> DataFrame:
    """Near-duplicate classes of all documents at Jaccard 0.75 on 5-word shingles."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir) -> DataFrame:
    """License passages of all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: The rules of the URL query, and host words that mark a URL as unwanted for training.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UNWANTED_HOST_WORDS = ["casino", "bet", "bets", "pills", "ads", "track", "win", "porn", "viagra", "loan"]


def op4_url_filter(spark, sf_dir) -> DataFrame:
    """Judge the URL of every page by the rules, else by trees trained on URLs labelled by words of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    words = F.split(url_filter.host_of(F.col("url")), r"[.-]")
    unwanted = F.arrays_overlap(words, F.array(*[F.lit(w) for w in UNWANTED_HOST_WORDS]))
    labelled = pages.select("url", unwanted.cast("int").alias("label"))
    return url_filter.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


#: Labels up to this number are sent to the tasks; more are joined by a shuffle.
LABELS_SENT = 500_000


def held_out(doc_id):
    """Whether a document's label must not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_net(spark, sf_dir) -> toxicity.Net:
    """A net trained on all labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")).filter("label IS NOT NULL")
    few = labels.count() <= LABELS_SENT
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.train(docs.join(F.broadcast(labels) if few else labels, "doc_id"))


def op5_toxicity(spark, sf_dir) -> DataFrame:
    """Score every document; labels of held-out documents are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = toxicity.score(docs, toxicity_net(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op6_decontaminate(spark, sf_dir) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the extent of the overlap."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark, sf_dir) -> DataFrame:
    """The language of every page; the text model is fitted on documents of known language."""
    model = langid.Model.fit(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model, keep=["page_id", "url"])


def op8_chat(spark, sf_dir) -> DataFrame:
    """Format every conversation, and one whose texts hold control strings; digests read back from the output."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.read_back(chat.format_chats(chat.log_of(said.unionByName(tricky))))


def op9_grid_join(spark, sf_dir) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


#: Key of the surrogates in the registered query; a real corpus needs a secret one.
PII_KEY = "lintel-demonstration-key"


def op10_pii(spark, sf_dir) -> DataFrame:
    """Every document with personal data replaced by surrogates."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_collocations(spark, sf_dir) -> DataFrame:
    """The best phrases of two or three words of each language, counted over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir) -> DataFrame:
    """Codes and errors of all vectors under codebooks of 4 x 256 entries."""
    out, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


#: Limits of a packed sequence; every token of plain documents bears loss.
PACKED = packing.Limits(tokens=2048, segments=64, loss=2048)


def op13_packing(spark, sf_dir) -> DataFrame:
    """Every token of every document in a sequence of at most 2048."""
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1, PACKED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_bpe": op1_bpe, "op2_ngram_join": op2_ngram_join, "op3_license_scan": op3_license_scan, "op4_url_filter": op4_url_filter, "op5_toxicity": op5_toxicity, "op6_decontaminate": op6_decontaminate, "op7_langid": op7_langid, "op8_chat": op8_chat, "op9_grid_join": op9_grid_join, "op10_pii": op10_pii,
           "op11_collocations": op11_collocations, "op12_vector_codes": op12_vector_codes, "op13_packing": op13_packing}

__all__ = ["QUERIES", "SQL"]
