"""Operator 6: benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words; only its selected places are hashed, so
a window is still found if words at the other places were replaced. Windows of
the benchmark and of the training texts are joined on the hash, which holds the mask. Around every
hit the two texts are laid side by side, and a document is contaminated if some
run of ``WINDOW`` words (the whole item if that is shorter) agrees in at least
``SHARE`` of its places; items of up to ``EXACT`` words must be there whole. No such
overlap is missed: the masks leave no blind spot at any length (see ``MASKS``).

A hit is a few numbers: which text of the benchmark, and by how many words it is shifted
against the document. The pass over the corpus counts each hit of a document once while it reads and
keeps no words, so that its memory doesn't grow with a document's words times its hits. A
second pass cuts words of the documents with hits only and lays beside each item as
many words as the item has, at most ``PIECE_WORDS`` (and one item) at a time.

While the benchmark is small enough to be sent to every task (its windows are counted), hashes
of the corpus are looked up where they are made, without a shuffle. With more windows than that, all
windows are joined by a shuffle; so are documents and hits if there are more than ``BROADCAST_HITS``. The
result is the same. Items of equal words are compared once.

DataFrame functions only. Every item has at least one window, so that the bound on
windows bounds the items' texts too. Defined results: null and empty texts, and items
without words, match nothing; repeated rows of an item or document count once; null ids are left out; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import saved

#: Places of the masks that count (1), and which of them items of fewer words than ``LONG`` use. With up to a quarter of
#: the places replaced, every run of 10 to 13 words has a window that one of the first two sees whole, and every
#: shorter item one that its own mask sees. Items under five words count only if all their words are there.
MASKS = ("11101", "100111", "1", "11", "111", "1111")
LONG, OF_SHORT = 10, {1: "1", 2: "11", 3: "111", 4: "1111", 5: "11", 6: "111", 7: "111", 8: "11", 9: "111"}
WINDOW, SHARE, EXACT = 13, 0.75, 4
#: Windows of the benchmark that are sent to every task, at most.
BROADCAST_WINDOWS = 2_000_000
#: Hits that are sent to every task, at most.
BROADCAST_HITS = 1_000_000
#: Words that a task lays beside items at a time.
PIECE_WORDS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _hash(words: Column, start: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, start + i) for i in _places(MASKS[mask])])


def _starts(words: Column, mask: str) -> Column:
    last = F.size(words) - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _windows(texts: DataFrame) -> DataFrame:
    """All windows of the texts: text_id, mask, start, hash."""
    parts = []
    for m, mask in enumerate(MASKS):
        sizes = [n for n, own in OF_SHORT.items() if own == mask]
        some = texts.filter(F.size("words").isin(sizes) if sizes else F.size("words") >= LONG)
        at = some.select("text_id", "words", F.explode(_starts(F.col("words"), mask)).alias("start"))
        parts.append(at.select("text_id", F.lit(m).alias("mask"), "start", _hash(F.col("words"), F.col("start"), m).alias("hash")))
    return reduce(DataFrame.unionByName, parts)


def _hashes(docs: DataFrame, masks: list[int]) -> DataFrame:
    """``(doc_id, seen, begin, hash)`` of all windows of the documents; seen: a hash of the text."""
    words = F.inline(F.array(F.struct(words_of(F.col("text")).alias("words"), F.xxhash64("text").alias("seen"))))  # computed once
    at = docs.select("doc_id", words).select("doc_id", "seen", "words", F.posexplode("words").alias("begin", "word"))
    of = [F.when(F.col("begin") + len(MASKS[m]) <= F.size("words"), _hash(F.col("words"), F.col("begin"), m)) for m in masks]
    return at.select("doc_id", "seen", "begin", F.explode(F.array(*of)).alias("hash"))


def _agreement(words: Column, item: Column) -> Column:
    """For each place of the item 1 if ``words`` has the same word there, else 0."""
    return F.zip_with(words, item, lambda a, b: F.when(a == b, 1).otherwise(0))


def _best_run(agree: Column) -> Column:
    """The most agreeing places among ``WINDOW`` consecutive ones."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(agree) - WINDOW, F.lit(0)))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(agree, i + 1, F.lit(WINDOW)), F.lit(0), lambda s, x: s + x))
    return F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, matched_words, run_words, item_words)`` for every document and item it holds.

    matched_words: agreeing words in the best alignment; run_words: those in its best run.
    """
    items = saved(benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words"))
                  .filter(F.size("words") > 0).distinct(), "items")
    texts = saved(items.select("words").distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts")
    members = saved(items.join(texts, "words").select("item_id", "text_id"), "members")
    windows = saved(_windows(texts), "windows")
    masks = {r.mask: r.n for r in windows.groupBy("mask").agg(F.count("*").alias("n")).collect()}  # at most len(MASKS)
    small = sum(masks.values()) <= BROADCAST_WINDOWS
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    sent = windows.select("hash", "text_id", "start")  # a hash tells its mask
    hits = (_hashes(own, sorted(masks) or [0]).join(F.broadcast(sent) if small else sent, "hash")
            .select("doc_id", "seen", "text_id", (F.col("begin") - F.col("start")).alias("shift")).distinct())
    places = texts.withColumnRenamed("words", "item")
    hits = hits.join(places.select("text_id", F.size("item").alias("n")), "text_id")
    before = F.sum("n").over(Window.partitionBy("doc_id", "seen").orderBy("text_id", "shift").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0)) / PIECE_WORDS).alias("part")
    hits = hits.select("doc_id", "seen", "text_id", "shift", "n", part).groupBy("doc_id", "seen", "part")
    hits = saved(hits.agg(F.collect_list(F.struct("text_id", "shift", "n")).alias("hits")).drop("part"), "hits")
    few = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_HITS
    held = own.withColumn("seen", F.xxhash64("text")).join(F.broadcast(hits) if few else hits, ["doc_id", "seen"])
    held = held.select("doc_id", "hits", words_of(F.col("text")).alias("words"))
    beside = F.transform("hits", lambda h: F.struct(h["text_id"].alias("text_id"), F.transform(
        F.sequence(F.lit(0), h["n"] - 1), lambda i: F.get("words", i + h["shift"])).alias("piece")))
    sided = held.select("doc_id", F.inline(beside)).join(F.broadcast(places) if small else places, "text_id")
    judged = sided.select("doc_id", "text_id", F.size("item").alias("item_words"), _agreement(F.col("piece"), F.col("item")).alias("agree"))
    judged = judged.select("doc_id", "text_id", "item_words", F.aggregate("agree", F.lit(0), lambda s, x: s + x).alias("matched"), _best_run(F.col("agree")).alias("run"))
    least = F.when(F.col("item_words") <= EXACT, F.col("item_words")).otherwise(F.ceil(SHARE * F.least("item_words", F.lit(WINDOW))))
    found = judged.filter(F.col("run") >= least).join(members, "text_id")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched_words"), F.max("run").cast("long").alias("run_words"),
                                                  F.max("item_words").cast("long").alias("item_words"))
