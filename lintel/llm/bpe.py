"""Operator 1: byte-level BPE encoding and decoding.

A piece of text (one match of the split pattern) is encoded from the left by the
longest vocabulary entry that can stand there, found for every position by one
Aho-Corasick pass over the bytes read as Latin-1 characters. Whether two tokens
may be neighbours in the merge result is decided from the merge ranks alone and
remembered. If no entry can follow, the last token is taken back and its next
shorter prefix tried; a position found to be a dead end is never entered again,
so a piece costs time in proportion to its length. The result is what merging
the lowest rank first gives.

Rows are independent: no shuffle, and a lost executor costs its own tasks.
Defined results: a null text is an empty one and gives no tokens; repeated rows
and extra columns are passed through; a column named like the output is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lintel.llm.common import fresh, small_batches
from lintel.llm.cuts import SPACE_PATTERN, Memory, cuts

#: Cuts and pieces of text and pairs of neighbours a worker remembers, and the longest such string; speed bounds only.
REMEMBERED, NEIGHBOURS, LONGEST = 100_000, 200_000, 48
#: Bytes of text or ids worked on at once, ids of one text decoded at once.
AT_ONCE, IDS_AT_ONCE = 1_000_000, 250_000
_NEVER = 1 << 60


class Merges:
    """The vocabulary of a rank file with its exact encoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file has no entry for {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cuts = cuts if pattern == SPACE_PATTERN else self.find
        self._ready = False
        self._placed: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _prepare(self) -> None:
        """What encoding needs, built when the first text comes."""
        self.lengths = {r: len(b) for b, r in self.ranks.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.ranks.values()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[int, bool] = {}
        self._pieces = Memory(lambda p: b"".join([self.packed[t] for t in self.encode_piece(p.encode("utf-8"))]), REMEMBERED, LONGEST)
        self._cuts = Memory(lambda c: b"".join([self._pieces[p] for p in self.find(c)]), REMEMBERED, LONGEST)
        self.matcher = ahocorasick.Automaton()
        for b, r in self.ranks.items():
            if self._merge(b, r) is not None:  # entries that merging can never produce don't take part
                self.matcher.add_word(b.decode("latin-1"), r)
        self.matcher.make_automaton()
        self._ready = True

    @classmethod
    def load(cls, path: str, pattern: str) -> Merges:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _merge(self, b: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``b`` (itself twice for one byte); None if merging goes past it."""
        if rank in self._halves:
            return self._halves[rank]
        if len(b) == 1:
            found = (rank, rank)
        else:
            parts = [b[i:i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if best >= rank:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self._halves[rank] = found
        return found

    def _prefix(self, token: int) -> int | None:
        """The longest shorter entry that ``token`` begins with."""
        try:
            return self._shorter[token]
        except KeyError:
            b = self.bytes_of[token]
            found = self._shorter[token] = next(
                (r for n in range(len(b) - 1, 0, -1)
                 if (r := self.ranks.get(b[:n])) is not None and self._merge(b[:n], r) is not None), None)
            return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between the tokens ``a`` and ``b``.

        Both are undone merge by merge, the later merge first. A border pair
        that would merge before the merge just undone breaks the border.
        """
        ranks, bytes_of, lengths, halves = self.ranks, self.bytes_of, self.lengths, self._halves
        left, right, before, fits = a, b, _NEVER, True
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], _NEVER) < before:
                fits = False
                break
            # On equal ranks the merge on the left comes first, so the one on the right is undone first.
            undo_left = lengths[left] > 1 and (left > right or lengths[right] == 1)
            if undo_left:
                before = left
                left = halves[left][1]
            elif lengths[right] > 1:
                before = right + 1  # a border merge of this rank lies further left and would come first
                right = halves[right][0]
            else:
                break
        if len(self._fits) > NEIGHBOURS:
            self._fits.clear()
        self._fits[a << 32 | b] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, lengths, fits = len(piece), self.lengths, self._fits
        longest = [0] * size
        for end, rank in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # later ends are longer
        out: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, None, longest[0]
        while True:
            end = at + lengths[token]
            if end not in dead:
                fit = True if last is None else fits.get(last << 32 | token)
                if fit is None:
                    fit = self._compatible(last, token)
                if fit:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self._prefix(token)
            while token is None:  # nothing fits here: take the last token back and shorten it
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else None
                token = self._prefix(token)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers.

        No match of the pattern runs from other characters into white space, so
        a text may be cut wherever white space begins behind another character.
        Short cuts are looked up whole among those seen before.
        """
        if not self._ready:
            self._prepare()
        return b"".join([self._cuts[c] for c in self.cuts(text)])

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries in a row, and by id where each begins and how long it is (-1: no such id)."""
        if self._placed is None:
            ids = np.fromiter(self.bytes_of, dtype=np.int64, count=len(self.bytes_of))
            sizes = np.array([len(b) for b in self.bytes_of.values()], dtype=np.int64)
            begin, length = np.zeros(ids.max() + 1, dtype=np.int64), np.full(ids.max() + 1, -1, dtype=np.int64)
            begin[ids], length[ids] = np.cumsum(sizes) - sizes, sizes
            self._placed = np.frombuffer(b"".join(self.bytes_of.values()), dtype=np.uint8), begin, length
        return self._placed

    def decode(self, ids: bytes) -> bytes:
        entries, begin, length = self._places()
        of, out = unpack(ids), []
        for at in range(0, len(of), IDS_AT_ONCE):
            some = of[at:at + IDS_AT_ONCE]
            sizes = length[some]
            if sizes.min() < 0:
                raise KeyError(int(some[sizes.argmin()]))
            places = np.repeat(begin[some] - (np.cumsum(sizes) - sizes), sizes)
            out.append(entries[places + np.arange(len(places))].tobytes())
        return b"".join(out)


def unpack(ids: bytes) -> np.ndarray:
    """Ids from little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype="<u4")


_LOADED: dict[tuple[str, str], Merges] = {}


def merges(path: str, pattern: str) -> Merges:
    """The vocabulary, built once in each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Merges.load(path, pattern)
    return _LOADED[path, pattern]


def _batched(one, path: str, pattern: str, kind: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = getattr(merges(path, pattern), one)
        for batch in batches:
            some, held = [], 0
            for x in batch:
                some.append(call(x.as_py()) if x.is_valid else None)
                held += len(some[-1] or b"")
                if held > AT_ONCE:
                    yield pa.array(some, type=kind)
                    some, held = [], 0
            if some:
                yield pa.array(some, type=kind)
    return run


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of a string column as binary (little-endian unsigned 32-bit); null is empty."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _batched("encode", path, pattern, pa.binary())(batches)
    return F.arrow_udf(run, BinaryType())(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that binary ids stand for; null stays null."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _batched("decode", path, pattern, pa.binary())(batches)
    return F.arrow_udf(run, BinaryType())(ids)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of its column ``text``."""
    return small_batches(df).withColumn(ids, encoded(F.col(text), path, pattern))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its column ``ids``."""
    return df.withColumn(out, decoded(F.col(ids), path, pattern))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: a task needs one Python worker, and ids cross to it once."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = merges(path, pattern)
        for batch in batches:
            coded, plain, held = [], [], 0
            for n, x in enumerate(batch, 1):
                coded.append(vocabulary.encode(x.as_py()))
                plain.append(vocabulary.decode(coded[-1]))
                held += len(coded[-1]) + len(plain[-1])
                if n == len(batch) or held > AT_ONCE:
                    yield pa.StructArray.from_arrays([pa.array(coded, pa.binary()), pa.array(plain, pa.binary())], names=["ids", "plain"])
                    coded, plain, held = [], [], 0

    both = F.arrow_udf(run, StructType([StructField("ids", BinaryType()), StructField("plain", BinaryType())]))(F.coalesce(F.col(text), F.lit("")))
    name = fresh(df, "both")
    return small_batches(df).withColumn(name, both).withColumn(ids, F.col(name)["ids"]).withColumn(out, F.col(name)["plain"]).drop(name)


def count(ids: str = "token_ids") -> Column:
    return (F.octet_length(F.col(ids)) / 4).cast("long")


__all__ = ["Merges", "encode", "decode", "round_trip", "encoded", "decoded", "count", "unpack"]
