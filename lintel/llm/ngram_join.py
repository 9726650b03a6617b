"""Operator 2: n-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link if their shingle sets overlap in T = ceil(3(a+b)/7) members
(Jaccard 0.75), a and b being the sizes. A document with n shingles then needs
at least ceil(0.75 n) members that other documents have too.

1. *Shared shingles.* One pass over the texts hashes them. Each task packs its
   shingles, those that repeat inside the task once, into rows by hash range (a
   few bytes a shingle); a reducer of a range sees which are met again and sends
   that back. Documents with fewer shared shingles than ceil(0.75 n) can't link
   and are done: no list of one document is ever searched.
2. *Copies.* Documents with equal sets are one from here on.
3. *Inverted lists.* Of the remaining documents every shingle gets its document
   count. In ascending order of count, the n - T + k rarest are a document's
   short lists, k = 1 + n/16; any two that link meet in at least the smaller k
   of their short lists. The T - k others are its long lists.
4. *Hubs.* In each list one member is the hub, and each document is compared with
   the hub it meets most. A large group of near copies is joined this way by one
   comparison a document. Then ``ROUNDS`` times each document asks the component
   that is the largest in most of its lists.
5. *The rest.* Only lists whose members are still in different components matter.
   Components that the same large component dominates are a family. Per list a
   document gives one row for each family there (not for each document), and asks
   those that it meets in enough lists. Families are dealt out in shards of
   bounded size with an inverted index each; a query takes one link with each
   other component there, as more can't change the result. Pairs inside a
   component can't either, and are the only ones left out.

Within a block or shard the query's short lists are merged by a heap, documents
with enough occurrences are looked up in its long lists by binary search, and
those that reach T stay.

Defined results: null and empty texts have no shingles and link with nothing;
repeated rows of an id are one document, that of its largest set; a null id is left out;
columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_IDS, saved, small_batches
from lintel.llm.components import components
from lintel.llm.shingles import set_key, shingle_sets, text_groups

#: Shingles and documents that a task packs at a time.
PACK_SHINGLES, PACK_DOCS = 1_000_000, 60_000
TEXT_BYTES = 1_000_000
#: Candidates of a query compared at a time, and sent to one task together (about).
BLOCK, SALT = 256, 2048
#: Documents of a component that share an index; rounds that join documents to large components before the rest is searched.
SHARD, ROUNDS = 512, 2
_MANY = 0xFFFF


def _needed(a: int, b: int) -> int:
    return -(-3 * (a + b) // 7)


# ------------------------------------------------------------ 1. shared shingles
def _packed(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of packed shingles by hash range, and a row of documents (range -1 - x) for each pack."""
    schema = "range int, pack string, a binary, b binary, c binary, d binary, e binary"

    def pack(name: str, part: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(first)
        times = np.diff(np.r_[begin, len(h)])
        met = np.bincount(doc[np.repeat(times > 1, times)], minlength=len(sets)).astype(np.uint32)
        h, doc = h[begin], np.where(times > 1, _MANY, doc[begin]).astype(np.uint16)
        pairs = np.array([set_key(s) for s in sets], dtype=np.int64)
        yield (-1 - part, name, np.array(ids, dtype=np.int64).tobytes(), sizes.tobytes(), pairs[:, 0].tobytes(),
               pairs[:, 1].tobytes(), met.tobytes())
        at = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[r], cut[r + 1])
            yield r, name, low[s].tobytes(), doc[s].tobytes(), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for some, texts in text_groups(batch.column(0).to_pylist(), batch.column(1), TEXT_BYTES):
                for i, s in zip(some, shingle_sets(texts)):
                    ids.append(i)
                    sets.append(s)
                    held += len(s)
                    if held > PACK_SHINGLES or len(ids) == PACK_DOCS:
                        yield _rows(pack(f"{part}-{nth}", part, ids, sets), schema)
                        nth, ids, sets, held = nth + 1, [], [], 0
        if ids:
            yield _rows(pack(f"{part}-{nth}", part, ids, sets), schema)

    return small_batches(docs).mapInArrow(run, schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def _rows(rows, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=_TYPES[t]) for c, (_, t) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def _met_again(packed: DataFrame) -> DataFrame:
    """For each pack and range: the places of documents and how many of their shingles other packs have."""
    schema = "pack string, a binary, b binary, c binary, d binary, e binary"

    def merged(rows: list[tuple]) -> Iterator[tuple]:
        h = np.concatenate([np.frombuffer(x[2], dtype=np.uint32) for x in rows])
        doc = np.concatenate([np.frombuffer(x[3], dtype=np.uint16) for x in rows])
        src = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x[2]) // 4 for x in rows])
        order = np.argsort(h)
        h, doc, src = h[order], doc[order], src[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:]
        again &= doc != _MANY  # their packs have counted these themselves
        doc, src = doc[again], src[again]
        order = np.argsort(src, kind="stable")
        doc, src = doc[order], src[order]
        cut = np.searchsorted(src, np.arange(len(rows) + 1))
        for k, row in enumerate(rows):
            if cut[k] < cut[k + 1]:
                yield row[1], doc[cut[k]:cut[k + 1]].tobytes(), None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for at, some in groupby(rows(), key=lambda x: x[0]):
            if at < 0:
                for x in some:
                    yield _rows([x[1:]], schema)
            else:
                yield _rows(merged(list(some)), schema)

    return packed.repartition("range").sortWithinPartitions("range", "pack").mapInArrow(run, schema)


def _documents(met: DataFrame) -> DataFrame:
    """Per document: id, n, the two set keys, and the number of shingles it shares."""
    schema = "doc_id long, n long, k1 long, k2 long, shared long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for _, some in groupby(rows(), key=lambda x: x[0]):
            ids = None
            for _, a, b, c, d, e in some:  # the pack's row of documents sorts first
                if b is not None:
                    ids, n, k1, k2 = (np.frombuffer(x, dtype=np.int64) for x in (a, b, c, d))
                    shared = np.frombuffer(e, dtype=np.uint32).astype(np.int64)
                else:
                    shared += np.bincount(np.frombuffer(a, dtype=np.uint16), minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, n, k1, k2, shared)],
                                             names=["doc_id", "n", "k1", "k2", "shared"])

    return met.repartition("pack").sortWithinPartitions("pack", F.col("b").isNull()).mapInArrow(run, schema)


def _selected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids``; shipped to the tasks if few, joined otherwise."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id")


def _sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, shingles)``: the sorted set as little-endian unsigned 64-bit numbers.

    Reads ``(doc_id, text, k1, k2)``; of repeated ids only texts with that set key stay.
    """
    schema = "doc_id long, n long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, k1, k2 = batch.columns
            keyed = list(zip(ids.to_pylist(), k1.to_pylist(), k2.to_pylist()))
            for some, held in text_groups(keyed, texts, TEXT_BYTES):
                yield _rows([(i, len(s), s.tobytes()) for (i, *key), s in zip(some, shingle_sets(held))
                             if tuple(key) == set_key(s)], schema)

    return docs.select("doc_id", "text", "k1", "k2").mapInArrow(run, schema)


def _exploded(sets: DataFrame) -> DataFrame:
    """One row for each member of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(s, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), n)), pa.array(h)],
                                                 names=["doc_id", "n", "h"])

    return sets.mapInArrow(run, "doc_id long, n long, h long")


# ------------------------------------------------------------ comparison
def divide_skip(short: list[list[int]], long: list[list[int]], least_short: int, least: int) -> Iterator[tuple[int, int]]:
    """Members of at least ``least`` of all lists, with the number; each is in at least ``least_short`` short lists.

    The short lists (sorted) are merged by a heap, the long ones searched by bisection.
    """
    for member, times in groupby(heapq.merge(*short)):
        n = sum(1 for _ in times)
        if n < least_short:
            continue
        left = len(long)
        for one in long:
            if n + left < least:
                break
            left -= 1
            at = bisect_left(one, member)
            n += at < len(one) and one[at] == member
        if n >= least:
            yield member, n


class _Index:
    """The inverted lists of some documents."""

    def __init__(self, docs: list[tuple[int, np.ndarray]]):
        self.docs = docs
        self.sizes = [len(s) for _, s in docs]
        h = np.concatenate([s for _, s in docs])
        who = np.repeat(np.arange(len(docs)), self.sizes)
        order = np.argsort(h, kind="stable")
        self.h, self.who, self.smallest = h[order], who[order], min(self.sizes)

    def links(self, s: np.ndarray) -> Iterator[int]:
        """The documents that link with the set ``s``."""
        least = _needed(len(s), max(self.smallest, -(-3 * len(s) // 4)))  # smaller ones can't link
        lo, hi = np.searchsorted(self.h, s, "left"), np.searchsorted(self.h, s, "right")
        lists = sorted((n, b) for n, b in zip((hi - lo).tolist(), lo.tolist()) if n)
        if len(lists) < least:
            return
        apart = max(least - 1 - len(s) // 16, 0)  # lists set aside as long ones; fewer than the overlap needed
        cut = max(len(lists) - apart, 0)
        short = [self.who[b:b + n].tolist() for n, b in lists[:cut]]
        long = [self.who[b:b + n].tolist() for n, b in reversed(lists[cut:])]
        for k, n in divide_skip(short, long, least - len(long), least):
            if n >= _needed(len(s), self.sizes[k]):
                yield self.docs[k][0]


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link; ``a`` is the query."""
    asked = pairs.groupBy("a").agg(F.floor((F.count("*") - 1) / SALT).alias("salts"))
    query = (sets.join(asked, F.col("doc_id") == F.col("a"))
             .select("a", F.explode(F.sequence(F.lit(0).cast("long"), "salts")).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles"))
    others = (pairs.join(asked, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts") + 1).alias("salt"), "b")
              .join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles"))
    both = query.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for a, salt, b, s in zip(*batch.columns):
                    yield a.as_py(), salt.as_py(), b.as_py(), np.frombuffer(s.as_py(), dtype=np.uint64)

        def done(a, s, others):
            hits = list(_Index(others).links(s))
            return pa.RecordBatch.from_arrays([pa.array([a] * len(hits), pa.int64()), pa.array(hits, pa.int64())], names=["a", "b"])

        for (a, _), some in groupby(rows(), key=lambda x: x[:2]):
            s, others = None, []
            for _, _, b, one in some:
                if b is None:
                    s = one
                    continue
                others.append((b, one))
                if len(others) == BLOCK:
                    yield done(a, s, others)
                    others = []
            if others:
                yield done(a, s, others)

    return both.mapInArrow(run, "a long, b long")


# ------------------------------------------------------------ the join
def _short_lists(sets: DataFrame) -> DataFrame:
    """``(doc_id, n, h)``: each document's rarest shingles that others have too."""
    rows = _exploded(sets)
    lists = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    least, k = F.ceil(F.col("n") * 0.75), F.floor(F.col("n") / 16) + 1
    mine = (rows.join(lists, "h").groupBy("doc_id", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all"))  # a document's own set
            .filter(F.size("all") >= least)
            .withColumn("short", F.slice("all", F.lit(1), F.least(F.size("all"), (F.size("all") - least + k).cast("int")))))
    return mine.select("doc_id", "n", F.explode("short").alias("s")).select("doc_id", "n", F.col("s.h").alias("h"))


def _hub_pairs(short: DataFrame) -> DataFrame:
    """Each document with the hub that it shares most lists with."""
    hub = short.groupBy("h").agg(F.min(F.struct(F.xxhash64("doc_id").alias("x"), F.col("doc_id").alias("hub"), F.col("n").alias("m"))).alias("s"))
    fits = 100 * F.least("n", "m") >= 75 * F.greatest("n", "m")
    met = (short.join(hub.select("h", "s.hub", "s.m"), "h").filter(F.col("hub") != F.col("doc_id")).filter(fits)
           .groupBy("doc_id", "hub").count())
    best = met.groupBy("doc_id").agg(F.max(F.struct("count", "hub")).alias("s"))
    return best.select(F.col("s.hub").alias("a"), F.col("doc_id").alias("b"))


def _labelled(short: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The short lists with components, and per list and component its size (over all) and smallest and largest n."""
    own = saved(short.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
                .withColumn("component", F.coalesce("component", "doc_id")), "labelled-lists")
    sizes = labels.groupBy("component").agg(F.count("*").alias("c"))  # of two components the same one always asks
    per = (own.groupBy("h", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
           .join(sizes, "component", "left").fillna({"c": 1}))
    mixed = per.groupBy("h").agg(F.count("*").alias("parts")).filter("parts > 1").select("h")
    return own, saved(per.join(mixed, "h"), "mixed-lists")


def _largest(short: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, component, family)``: each document with the component that is the largest in most of its lists, itself a family."""
    own, per = _labelled(short, labels)
    main = per.groupBy("h").agg(F.max(F.struct("c", "component")).alias("s")).select("h", F.col("s.component").alias("family"))
    met = own.join(main, "h").filter(F.col("component") != F.col("family")).groupBy("doc_id", "component", "family").count()
    best = met.groupBy("doc_id").agg(F.max(F.struct("count", "family", "component")).alias("s"))
    return best.select("doc_id", "s.component", "s.family"), per.select("component", F.col("component").alias("family")).distinct()


def _families(own: DataFrame, per: DataFrame) -> DataFrame:
    """``(component, family, whole, main)``: each component with the one that is the largest in most of its lists.

    whole: the family's number of documents; main: its largest component.
    """
    main = per.groupBy("h").agg(F.max(F.struct("c", "component")).alias("s")).select("h", F.col("s.component").alias("family"))
    met = own.select("h", "component").join(main, "h").groupBy("component", "family").count()
    best = met.groupBy("component").agg(F.max(F.struct("count", "family")).alias("s")).select("component", "s.family")
    sized = best.join(per.select("component", "c").distinct(), "component")
    of = sized.groupBy("family").agg(F.sum("c").alias("whole"), F.max(F.struct("c", "component")).alias("s"))
    return saved(best.join(of.select("family", "whole", F.col("s.component").alias("main")), "family"), "families")


def _queries(short: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, component, family)``: documents and the families that they meet in enough short lists; and the families.

    Of two families the smaller one's documents ask; inside a family all that aren't in its main component.
    """
    own, per = _labelled(short, labels)
    families = _families(own, per)
    known = families.select("component", "family", "whole", "main")
    in_list = (per.join(known, "component").groupBy("h", "family").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("whole").alias("tw"))
               .withColumnRenamed("family", "target"))
    asking = own.join(per.select("h", "component"), ["h", "component"]).join(known, "component")
    inside = (F.col("family") == F.col("target")) & (F.col("component") != F.col("main"))
    across = (F.col("whole") < F.col("tw")) | ((F.col("whole") == F.col("tw")) & (F.col("family") > F.col("target")))
    met = (asking.join(in_list, "h").filter(inside | ((F.col("family") != F.col("target")) & across))
           .filter((100 * F.col("hi") >= 75 * F.col("n")) & (75 * F.col("lo") <= 100 * F.col("n")))
           .groupBy("doc_id", "component", "target").agg(F.count("*").alias("met"), F.min("n").alias("n")))
    asked = met.filter(F.col("met") > F.floor(F.ceil(F.col("n") * 0.75) / 16))
    return asked.select("doc_id", "component", F.col("target").alias("family")), families.select("component", "family")


def _answered(queries: DataFrame, sets: DataFrame, labels: DataFrame, families: DataFrame) -> DataFrame:
    """For each query a link ``(a, b)`` with every other component of the family that it links with."""
    queries = saved(queries, "queries")
    asked = queries.select("family").distinct()
    members = (sets.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
               .withColumn("component", F.coalesce("component", "doc_id")).join(families, "component")
               .select("family", "component", "doc_id", "shingles"))
    members = saved(members.join(asked, "family", "left_semi"), "asked-members")
    salts = members.groupBy("family").agg(F.floor((F.count("*") - 1) / SHARD).alias("salts"))
    held = members.join(salts, "family").select("family", F.pmod(F.xxhash64("doc_id"), F.col("salts") + 1).alias("salt"),
                                                F.lit(0).alias("kind"), "component", "doc_id", "shingles")
    asks = (queries.join(salts, "family")
            .select("family", F.explode(F.sequence(F.lit(0).cast("long"), "salts")).alias("salt"), F.lit(1).alias("kind"), "component", "doc_id")
            .join(sets.select("doc_id", "shingles"), "doc_id").select("family", "salt", "kind", "component", "doc_id", "shingles"))
    dealt = held.unionByName(asks).repartition("family", "salt").sortWithinPartitions("family", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for family, salt, kind, component, doc, s in zip(*batch.columns):
                    yield family.as_py(), salt.as_py(), kind.as_py(), component.as_py(), doc.as_py(), np.frombuffer(s.as_py(), dtype=np.uint64)

        links = []
        for _, some in groupby(rows(), key=lambda x: x[:2]):
            docs, index, of = [], None, {}
            for _, _, kind, component, doc, s in some:
                if kind == 0:
                    docs.append((doc, s))
                    of[doc] = component
                    continue
                if index is None:
                    index, every = _Index(docs), set(of.values())
                left = every - {component}
                for hit in index.links(s) if left else ():
                    if of[hit] in left:
                        links.append((doc, hit))
                        left.discard(of[hit])
                        if not left:
                            break
            if len(links) > 10_000:
                yield _rows(links, "a long, b long")
                links = []
        if links:
            yield _rows(links, "a long, b long")

    return dealt.mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = saved(_documents(_met_again(_packed(texts, ranges)))
                  .groupBy("doc_id").agg(F.max(F.struct("n", "k1", "k2", "shared")).alias("s")).select("doc_id", "s.*"), "documents")
    able = every.filter("n > 0 AND 100 * shared >= 75 * n")
    copies = saved(able.join(able.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), ["n", "k1", "k2"])
                   .select("doc_id", "rep", "k1", "k2"), "copies")
    reps = copies.filter("doc_id = rep").select("doc_id", "k1", "k2")
    sets = saved(_sets(_selected(texts, reps)), "sets")
    short = saved(_short_lists(sets), "short-lists")
    links = saved(_compared(_hub_pairs(short), sets), "hub-links")
    labels = components(links)
    for _ in range(ROUNDS):
        queries, alone = _largest(short, labels)
        more = saved(_answered(queries, sets, labels, alone), "more-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)
    queries, families = _queries(short, labels)
    rest = saved(_answered(queries, sets, labels, families), "rest-links")
    same = copies.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(rest).unionByName(same))
    return (every.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
