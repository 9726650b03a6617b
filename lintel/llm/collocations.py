"""Operator 11: phrase collocations by prefix-free parsing.

A text is parsed into chunks. A chunk begins at every pair of words whose hash is a
trigger and reaches through the next such pair, so neighbouring chunks overlap by
``words - 1`` words and the same passage gives the same chunks wherever it stands.
The distinct chunks with their numbers are the dictionary; phrases are counted in each
distinct chunk once, weighted by its number. A phrase belongs to the chunk it begins
in before the overlap, so that overlaps count once; a text's last chunk owns all of
its phrases and ends in a line feed.

Levels go from single words to the longest phrases. A phrase is counted on the next
level only if both phrases that it is made of by leaving out a word at an end may
have been frequent: the frequent ones of a level are kept in a bit filter of fixed size
(``FILTER_BITS``, whatever the input), which is all that is sent to the tasks. False
hits cost work only: the counts are exact and made from whole phrases.

Shuffles: chunks after each task has added up its own, phrases likewise; everything
after that is frequent phrases only. A hot phrase or chunk comes as one row a task.

Words are runs without space and tab, A-Z lower-cased, in pieces between ``.,;:!?``
and line breaks (LF, VT, FF, CR). Defined results: null and empty texts have no
words; a null language is ``und`` (and counts with texts of that language); repeated
rows count each time; tables without a frequent phrase give no rows; other columns are
not carried. Texts are worked on as bytes; a very long text is one row's worth of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lintel.llm.common import saved
from lintel.llm.shingles import keys, mix, text_groups, word_hashes

#: One pair of words in so many is a trigger.
SPARSE = 16
#: Bytes of text parsed at once, bytes of chunks held for adding up, bytes of chunks counted at once.
TEXT_BYTES, HELD_BYTES, COUNT_BYTES = 1_000_000, 16_000_000, 3_000_000
#: Bits of the filter of frequent phrases (a multiple of its parts), places set by each phrase, parts it is made in.
FILTER_BITS, PLACES, FILTER_PARTS = 1 << 26, 2, 64
_U = np.uint64
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PIECE_END = np.isin(np.arange(256), list(_SEPARATORS))
_BETWEEN = _PIECE_END | np.isin(np.arange(256), [32, 9])


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each word and the place behind it; the data end between words."""
    between = _BETWEEN[data]
    word = ~between
    first = word.copy()
    first[1:] &= between[:-1]
    behind = between.copy()
    behind[1:] &= word[:-1]
    behind[0] = False
    return np.flatnonzero(first), np.flatnonzero(behind)


def chunks(texts: list[bytes], words: int) -> Iterator[list[bytes]]:
    """The chunks of each text (lower-cased). A text's last chunk ends in a line feed, the others in a word."""
    lower = [t.lower() for t in texts]
    hashes, counts = word_hashes(lower, _BETWEEN)
    data = b" ".join(lower) + b" "
    starts, ends = _edges(np.frombuffer(data, dtype=np.uint8))
    width, by = words - 1, keys(words - 1, seed=3)
    pair = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        pair += hashes[k:k + len(pair)] * by[k]
    trigger = np.flatnonzero(mix(pair) % _U(SPARSE) == 0)
    at, done = 0, 0
    for n in counts.tolist():
        if not n:
            yield []
            continue
        # places of this text where a trigger stands whole and not at the very start
        low, high = np.searchsorted(trigger, [done + 1, done + n - width + 1])
        cuts = trigger[low:high].tolist()
        begin = [done, *cuts]
        out = [data[starts[a]:ends[b + width - 1]] for a, b in zip(begin, cuts)]
        out.append(data[starts[begin[-1]]:ends[done + n - 1]] + b"\n")
        yield out
        done += n


_CHUNKS = StructType([StructField("lang_", StringType()), StructField("chunk_", BinaryType()), StructField("n_", LongType())])


def dictionary(df: DataFrame, words: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """The distinct chunks of each language with their numbers."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang_"), F.col(text).cast("binary").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()),
                                               pa.array(list(held.values()), pa.int64())], names=_CHUNKS.names)

        for batch in batches:
            for langs, texts in text_groups(batch.column(0).to_pylist(), batch.column(1), TEXT_BYTES):
                for one, found in zip(langs, chunks(texts, words)):
                    for c in found:
                        n = held.get((one, c))
                        if n is None:
                            size += len(c) + 100
                        held[one, c] = (n or 0) + 1
                if size > HELD_BYTES:
                    yield flushed()
                    held.clear()
                    size = 0
        if held:
            yield flushed()

    return rows.mapInArrow(run, _CHUNKS).groupBy("lang_", "chunk_").agg(F.sum("n_").alias("n_"))


def _phrase_hash(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    by = keys(len(words) + 1, seed=11)
    out = langs * by[0]
    for k, w in enumerate(words):
        out = out + w * by[k + 1]
    return mix(out + _U(len(words)))


def _hashes(strings: list[bytes]) -> np.ndarray:
    """Hashes of single words."""
    out = word_hashes(strings, _BETWEEN)[0]
    assert len(out) == len(strings)
    return out


def _lang_hashes(langs: list[str]) -> np.ndarray:
    """Hashes of language names, whatever characters they hold."""
    return _hashes([b"x" + s.encode().hex().encode() for s in langs])


class Filter:
    """A set of phrases in a fixed number of bits; it may say yes too often, never no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place in _places(hashes, len(self.bits) * 8):
            found &= (self.bits[place >> 3] >> (place & 7)) & 1 == 1
        return found


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes + _U(k)) % _U(bits)).astype(np.int64) for k in range(PLACES)]


def frequent_filter(phrases: DataFrame) -> Filter:
    """The filter of the phrases (lang_, phrase_), made in parts of even size by tasks."""
    bits, part = FILTER_BITS, FILTER_BITS // FILTER_PARTS
    marks = StructType([StructField("part", IntegerType()), StructField("places", BinaryType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.unique(np.concatenate(_places(_whole_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()), bits)))
            cut = np.searchsorted(found, np.arange(FILTER_PARTS + 1) * part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FILTER_PARTS, dtype=np.int32)),
                                              pa.array([(found[a:b] - p * part).astype(np.uint32).tobytes() for p, (a, b) in enumerate(zip(cut, cut[1:]))], pa.binary())], names=marks.names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                on = whole.setdefault(p, np.zeros(part, dtype=np.uint8))
                on[np.frombuffer(places.as_py(), dtype=np.uint32)] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes() for on in whole.values()], pa.binary())], names=marks.names)

    out = np.zeros(bits // 8, dtype=np.uint8)
    parts = phrases.select("lang_", "phrase_").mapInArrow(spread, marks).repartition(FILTER_PARTS, "part").mapInArrow(merged, marks)
    for r in parts.collect():  # FILTER_BITS in all
        out[r.part * part // 8:(r.part + 1) * part // 8] = np.frombuffer(bytes(r.places), dtype=np.uint8)
    return Filter(out)


def _whole_hashes(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    """The hashes of phrases of one length given as their words joined by spaces."""
    split = [p.split(b" ") for p in phrases]
    known = {s: i for i, s in enumerate(dict.fromkeys(langs))}
    lang = _lang_hashes(list(known))[[known[s] for s in langs]]
    return _phrase_hash(lang, [_hashes([s[k] for s in split]) for k in range(len(split[0]))])


def _words(view: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each word of the bytes its number in the list of distinct words, that list, and where each word starts."""
    starts, behind = _edges(view)
    ends = np.r_[0, np.cumsum(behind - starts)].astype(np.int32)
    letters = view[~_BETWEEN[view]]
    every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return every.indices.to_numpy().astype(np.int64), every.dictionary, starts


def _distinct(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows given as columns of numbers (each below its size): the place of the first of each kind, and each row's kind."""
    group, size = np.zeros(len(parts[0][0]), dtype=np.int64), 1
    for column, n in parts:
        if size * n >= 1 << 62:  # too many kinds for one number: count those there are
            group = np.unique(group, return_inverse=True)[1]
            size = len(group)
        group, size = group * n + column, size * n
    return np.unique(group, return_index=True, return_inverse=True)[1:]


def counted(chunks: pa.Array, langs: pa.Array, numbers: np.ndarray, n: int, words: int, may: Filter | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of distinct chunks with their languages and numbers: language, phrase and count of the ``n``-word phrases they own."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), b"\n")[0].as_py() + b"\n"
    view = np.frombuffer(data, dtype=np.uint8)
    ids, names, starts = _words(view)
    piece = np.cumsum(_PIECE_END[view], dtype=np.int32)[starts]
    ends = np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64) + 1)
    chunk = np.searchsorted(ends, starts, side="right")
    behind = np.searchsorted(chunk, np.arange(len(chunks)), side="right")  # the place behind each chunk's last word
    last = view[ends - 2] == 10
    owned = behind - np.where(last, 0, words - 1)
    at = np.arange(len(ids) - n + 1)
    at = at[(at < owned[chunk[at]]) & (piece[at] == piece[at + n - 1])]
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy().astype(np.int64)[chunk]
    if may is not None and len(at):
        h, hl = _hashes(names.to_pylist()), _lang_hashes(coded.dictionary.to_pylist())
        for side in (0, 1):
            at = at[may.may_hold(_phrase_hash(hl[lang[at]], [h[ids[at + side + k]] for k in range(n - 1)]))]
    if not len(at):
        return langs.slice(0, 0), pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
    first, kind = _distinct([(lang[at], len(coded.dictionary)), *((ids[at + k], len(names)) for k in range(n))])
    sums = np.zeros(len(first), dtype=np.int64)
    np.add.at(sums, kind, numbers[chunk[at]])
    phrase = [names.take(pa.array(ids[at[first] + k])) for k in range(n)]
    joined = phrase[0] if n == 1 else pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.binary()))
    return coded.dictionary.take(pa.array(lang[at[first]])), joined, sums


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of batches in groups of about ``COUNT_BYTES`` of chunks, a longer chunk alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + COUNT_BYTES - size, side="right"))
            if end == at and not held:
                end += 1
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(ends[end - 1]) - before
            if end < batch.num_rows or size >= COUNT_BYTES:
                yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(3)]
                held, size = [], 0
            at = end
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(3)]


_PHRASES = StructType([StructField("lang_", StringType()), StructField("phrase_", BinaryType()), StructField("f_", LongType())])


def level(parsed: DataFrame, n: int, words: int, may: Filter | None) -> DataFrame:
    """(lang_, phrase_, f_) of the ``n``-word phrases whose shorter ends ``may`` be frequent."""
    spark = parsed.sparkSession
    bits = spark.sparkContext.broadcast(may.bits) if may is not None else None  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filter(bits.value) if bits is not None else None

        for langs, chunks_, numbers in _grouped(batches):
            lang, phrase, f = counted(chunks_, langs, numbers.to_numpy(), n, words, seen)
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(f)], names=_PHRASES.names)

    return parsed.mapInArrow(run, _PHRASES).groupBy("lang_", "phrase_").agg(F.sum("f_").alias("f_"))


def _part(phrase: str, first: int, n: int):
    """``n`` words of a phrase column from word ``first`` on (0 is the first)."""
    return F.array_join(F.slice(F.split(F.col(phrase), " "), first + 1, n), " ")


def _scored(found: dict[int, DataFrame], least_share: int) -> DataFrame:
    """Candidates of all lengths with their lowest-scoring cut, without those that a longer one holds."""
    n = max(found)
    none = found[1].limit(0)
    parts = found[1]
    for k in range(2, n):
        parts = parts.unionByName(found[k])
    out = None
    for size in range(2, n + 1):
        cut = found[size].select("lang_", "phrase_", F.col("f_").alias("a"),
                                 F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _part("phrase_", 0, k).alias("head"), _part("phrase_", k, size - k).alias("tail")) for k in range(1, size)])).alias("c"))
        cut = cut.select("lang_", "phrase_", "a", "c.*")
        heads = parts.select(F.col("lang_").alias("hl"), F.col("phrase_").alias("hp"), F.col("f_").alias("l"))
        tails = parts.select(F.col("lang_").alias("tl"), F.col("phrase_").alias("tp"), F.col("f_").alias("r"))
        cut = cut.join(heads, (F.col("lang_") == F.col("hl")) & (F.col("head") == F.col("hp"))).join(tails, (F.col("lang_") == F.col("tl")) & (F.col("tail") == F.col("tp")))
        a, l, r = (f"CAST({c} AS DECIMAL(19,0))" for c in "alr")
        score = F.expr(f"CAST(1000000 AS DECIMAL(38,0)) * ({a} * {a}) div ({l} * {r})")
        lowest = cut.withColumn("score", score).groupBy("lang_", "phrase_", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        longer = none.select("lang_", "phrase_", F.col("f_").alias("top"))
        for more in range(size + 1, n + 1):
            inner = found[more].select("lang_", F.col("f_"), F.explode(F.array(*[_part("phrase_", k, size) for k in range(more - size + 1)])).alias("phrase_"))
            longer = longer.unionByName(inner.select("lang_", "phrase_", F.col("f_").alias("top")))
        longer = longer.groupBy("lang_", "phrase_").agg(F.max("top").alias("top"))
        kept = lowest.join(longer, ["lang_", "phrase_"], "left").filter(F.col("top").isNull() | (F.col("top") * 100 < F.col("a") * least_share))
        kept = kept.select("lang_", "phrase_", "a", "low.l", "low.r", "low.score")
        out = kept if out is None else out.unionByName(kept)
    return out


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, held_share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``words`` words: lang, rank, phrase, a, l, r, n, score."""
    if words < 2:
        raise ValueError("phrases have two words at least")
    parsed = saved(dictionary(df, words, text, lang), "chunks")
    singles = saved(level(parsed, 1, words, None), "words")
    total = singles.groupBy("lang_").agg(F.sum("f_").alias("n"))
    found, counts = {}, singles
    for n in range(1, words + 1):
        if n > 1:
            counts = level(parsed, n, words, frequent_filter(found[n - 1]))
        frequent = counts.filter(F.col("f_") >= least).select("lang_", "phrase_", "f_")
        found[n] = saved(frequent, f"phrases-{n}")
    text_of = {n: t.withColumn("phrase_", F.col("phrase_").cast("string")) for n, t in found.items()}
    scored = saved(_scored(text_of, held_share), "scored")
    order = Window.partitionBy("lang_").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase_")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang_").select(F.col("lang_").alias("lang"), F.col("rank").cast("long").alias("rank"), F.col("phrase_").alias("phrase"), "a", "l", "r", "n", "score")
