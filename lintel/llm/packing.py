"""Operator 13: packing of tokenised examples into sequences by vector bin packing.

An example asks for three things at once: tokens, one segment, and loss-bearing
tokens. A sequence has a limit on each. The sequence being filled takes the
example of the window whose demand has the largest dot product with what is left
of the limits, among those that fit; demands and what is left count as shares of
the limits. Where none fits any more, the one that fills most is cut. Examples
longer than a sequence are cut into whole sequences first.

A sequence below the token limit would be padded. Where padding stops at powers of
two (``Limits.powers``), a sequence that nothing can fill up, as the last one of a
task, is cut back to the power of two below it and the rest goes on: no padding.

Tasks pack their own rows in one pass, without a shuffle. A task holds a window of
at most ``WINDOW`` pieces and about ``WINDOW_TOKENS`` tokens besides the batch at
hand. The number of the task is part of a sequence's id, so that a lost executor's
task gives the same sequences again. More tasks mean more last sequences (at most
one for each power of two and task), never more padding under ``powers``.

Defined results: a null text (or null ids) is empty; an empty text is its end token
alone, an example without any tokens has no piece; repeated rows and null keys are
examples of their own; a null loss mask means that all tokens bear loss, a mask of
another length than its ids is an error; other columns are not carried.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lintel.llm.cuts import SPACE_PATTERN

#: Pieces and tokens among which a sequence's next one is chosen.
WINDOW, WINDOW_TOKENS = 2048, 1 << 20
#: Bytes of ids returned at once.
OUT_BYTES = 4_000_000


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``powers``: a sequence whose length is a power of two isn't padded."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    powers: bool = True


@dataclass
class Piece:
    key: object
    ids: np.ndarray
    mask: np.ndarray | None  # 0 or 1 for each token; None: all ones
    start: int
    doc_tokens: int

    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """The length of the longest beginning within both limits."""
        if self.mask is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(np.cumsum(self.mask), loss, side="right")))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.mask is None else (self.mask[:n], self.mask[n:])
        return Piece(self.key, self.ids[:n], a, self.start, self.doc_tokens), Piece(self.key, self.ids[n:], b, self.start + n, self.doc_tokens)


class Packer:
    """Examples in (``add``), whole sequences out (``ready``; ``rest`` at the end), each a list of pieces."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = limits
        self.window: list[Piece] = []
        self.size = np.zeros(0, dtype=np.int64)
        self.cost = np.zeros(0, dtype=np.int64)
        self.free: list[int] = []
        self.held = self.tokens = 0

    def _put(self, piece: Piece) -> None:
        if self.free:
            at = self.free.pop()
            self.window[at] = piece
        else:
            at = len(self.window)
            self.window.append(piece)
            if at >= len(self.size):
                more = np.zeros(max(64, len(self.size)), dtype=np.int64)
                self.size, self.cost = np.r_[self.size, more], np.r_[self.cost, more]
        self.size[at], self.cost[at] = len(piece.ids), piece.loss()
        self.held += 1
        self.tokens += len(piece.ids)

    def _take(self, at: int) -> Piece:
        piece = self.window[at]
        self.window[at] = None
        self.free.append(at)
        self.size[at] = self.cost[at] = 0
        self.held -= 1
        self.tokens -= len(piece.ids)
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Hold an example, cut so that each part fits an empty sequence; whole sequences come out at once."""
        limits = self.limits
        while len(piece.ids):
            n = piece.fitting(limits.tokens, limits.loss)
            head, piece = piece.cut(n)
            if n == limits.tokens:
                yield [head]
            else:
                self._put(head)

    def ready(self) -> Iterator[list[Piece]]:
        """Sequences, once the window is full, until it is half full."""
        if self.held >= WINDOW or self.tokens >= WINDOW_TOKENS:
            while self.held > WINDOW // 2 or self.tokens > WINDOW_TOKENS // 2:
                yield self._sequence()

    def rest(self) -> Iterator[list[Piece]]:
        while self.held:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        limits, out = self.limits, []
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        while tokens and segments and self.held:
            size, cost = self.size[:len(self.window)], self.cost[:len(self.window)]
            fits = (size > 0) & (size <= tokens) & (cost <= loss)
            if segments == 1:  # the last segment: only what fills the sequence
                fits &= size == tokens
            if fits.any():
                worth = size * (tokens / limits.tokens ** 2) + cost * (loss / limits.loss ** 2) + segments / limits.segments ** 2
                piece = self._take(int(np.where(fits, worth, -1).argmax()))
            else:
                piece = self._longest_beginning(tokens, loss)
                if piece is None:
                    break
            out.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - piece.loss()
        if tokens and limits.powers:
            self._cut_back(out, limits.tokens - tokens)
        return out

    def _longest_beginning(self, tokens: int, loss: int) -> Piece | None:
        """Of all pieces that don't fit, the one whose beginning fills most; its rest stays in the window."""
        most = np.minimum(self.size[:len(self.window)], tokens)
        best, at = 0, -1
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] <= best:
                break
            n = self.window[i].fitting(tokens, loss)
            if n > best:
                best, at = n, i
        if not best:
            return None
        head, tail = self._take(at).cut(best)
        if len(tail.ids):
            self._put(tail)
        return head

    def _cut_back(self, out: list[Piece], length: int) -> None:
        """Give back what is beyond the largest power of two."""
        over = length - (1 << (length.bit_length() - 1))
        while over:
            last = out.pop()
            keep = len(last.ids) - over
            if keep > 0:
                head, last = last.cut(keep)
                out.append(head)
            self._put(last)
            over -= len(last.ids)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {chr(b if b in own else 256 + sum(x not in own for x in range(b))): b for b in range(256)}


def _ranks(said: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokeniser file by rank, if its ids are the order of its merges and it splits by the usual pattern."""
    model, split = said["model"], said["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not said["normalizer"]
    if not plain or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary, of = model["vocab"], _bytes_of()
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)) or any(vocabulary.get(c, 256) > 255 for c in of):
        return None
    added = {t["content"] for t in said["added_tokens"]}
    return {bytes([of[c] for c in word]): i for word, i in vocabulary.items() if word not in added}


class Encoder:
    """Ids of texts as the tokenizers library gives them for a file, without added special tokens.

    A file of the common byte-level kind, whose ids are the order of its merges, is
    run by tiktoken: the same merges and ids in a fifth of the time. Any other file
    is run by the tokenizers library itself. Added tokens' strings in a text are
    those tokens, as that library has it by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        ranks, added = _ranks(said), {t["content"]: t["id"] for t in said["added_tokens"]}
        simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"])
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=SPACE_PATTERN, mergeable_ranks=ranks, special_tokens=added) if ranks and simple else None
        self.slow = None if self.fast else tokenizers.Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _pieces_schema(df: DataFrame, key: str) -> StructType:
    return StructType([StructField(key, df.schema[key].dataType), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()),
                       StructField("loss_mask", BinaryType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType())])


def _packed(rows: DataFrame, schema: StructType, limits: Limits, examples: Callable[[pa.RecordBatch], Iterator[Piece]]) -> DataFrame:
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, out, held = Packer(limits), TaskContext.get().partitionId() << 33, [], 0
        key_type = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

        def sequences() -> Iterator[list[Piece]]:
            nonlocal key_type
            for b in batches:
                key_type = b.column(0).type
                for piece in examples(b):
                    yield from packer.add(piece)
                    yield from packer.ready()
            yield from packer.rest()

        for sequence in sequences():
            offset = 0
            for p in sequence:
                mask = None if p.mask is None else p.mask.tobytes()
                out.append((p.key, p.start, len(p.ids), p.ids.tobytes(), mask, p.doc_tokens, number, offset))
                offset += len(p.ids)
                held += 4 * len(p.ids) + 200
            number += 1
            if held > OUT_BYTES:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


def pack_ids(df: DataFrame, limits: Limits, key: str = "doc_id", ids: str = "token_ids", loss_mask: str | None = None) -> DataFrame:
    """Pieces of examples given as binary ids (little-endian unsigned 32-bit) and, optionally, a byte 0 or 1 for each token's loss."""
    mask = F.col(loss_mask).cast("binary") if loss_mask else F.lit(None).cast("binary")
    rows = df.select(F.col(key), F.coalesce(F.col(ids), F.lit(b"")).alias("ids_"), mask.alias("mask_"))

    def examples(batch: pa.RecordBatch) -> Iterator[Piece]:
        for k, x, m in zip(*batch.columns):
            own = np.frombuffer(x.as_py(), dtype="<u4")
            bears = np.frombuffer(m.as_py(), dtype=np.uint8) if m.is_valid else None
            if bears is not None and (len(bears) != len(own) or (len(bears) and bears.max() > 1)):
                raise ValueError("a loss mask needs a byte 0 or 1 for each token")
            yield Piece(k.as_py(), own, bears, 0, len(own))

    return _packed(rows, _pieces_schema(df, key), limits, examples)


def pack_texts(df: DataFrame, path: str, end: int, limits: Limits, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of whole texts, tokenised by the file at ``path``, the id ``end`` behind each; all tokens bear loss."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text_"))

    def examples(batch: pa.RecordBatch) -> Iterator[Piece]:
        encode = encoder(path)
        for k, t in zip(*batch.columns):
            own = np.append(encode(t.as_py()), np.uint32(end)).astype("<u4")
            yield Piece(k.as_py(), own, None, 0, len(own))

    return _packed(rows, _pieces_schema(df, key), limits, examples)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokeniser of a worker, loaded once; one thread, as Spark's tasks are the parallel ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def sequences(pieces: DataFrame, limits: Limits, pad: int = 0) -> DataFrame:
    """One row for each sequence: input_ids, segment_ids (from 1; 0 is padding) and loss_mask, padded as ``limits`` say.

    A sequence's pieces meet in one task; they are at most ``limits.segments``.
    """
    schema = StructType([StructField("sequence_id", LongType()), StructField("n_tokens", LongType()), StructField("input_ids", BinaryType()),
                         StructField("segment_ids", BinaryType()), StructField("loss_mask", BinaryType())])
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "loss_mask"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, parts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = b"".join(p["ids"] for p in parts)
                n = len(ids) // 4
                more = 0 if limits.powers and n & (n - 1) == 0 else limits.tokens - n
                segments = np.repeat(np.arange(1, len(parts) + 1), [len(p["ids"]) // 4 for p in parts])
                mask = b"".join(p["loss_mask"] if p["loss_mask"] is not None else b"\1" * (len(p["ids"]) // 4) for p in parts)
                rows.append((number, n, ids + np.full(more, pad, dtype="<u4").tobytes(), np.r_[segments, np.zeros(more)].astype("<u4").tobytes(), mask + bytes(more)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[f.name for f in schema])

    return grouped.mapInArrow(run, schema)
