"""Operator 5: toxicity by a convolutional text classifier.

Words (runs of letters, A-Z lower-cased) are hashed into an embedding table.
Filters of widths 1, 2 and 3 run over the embedded words of the whole text; the
largest answer of each filter goes into a logistic layer. A max-pooled net sends its
gradient to one window a filter and text, so training costs little more than reading.

Every labelled text counts: words are counted by language over all of them, three
quarters (by a hash of the text, copies together) train and the others calibrate. Texts are
written once as embedding rows. In a round each task trains a copy of the net on its
share of the texts; the driver gets the sums of these copies, weighted by the texts that
moved them, from at most ``MERGED`` tasks. The round that does best on the calibration texts is kept.

For scoring, embedding and filters are folded into one small table for each place
in a filter: a window's answer is a sum of looked-up rows. Rows are independent:
no shuffle, memory bounded by a slice of texts.

The score sees the text alone. ``threshold`` is calibrated by language on all labelled
rows that the net wasn't trained on: the cut (in steps of 1 / ``BINS``) with the fewest errors
there, nearest to 0.5 among equals; languages with few of them use the overall cut.

Defined results: null and empty texts get the score of a text without words; a
null or unknown language has the overall threshold; repeated rows score alike;
without labels of both kinds the score is the share of positive labels (0 without
any); other columns stay.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from lintel.llm.common import saved, small_batches
from lintel.llm.shingles import text_groups, word_hashes

#: Hash values of words.
BUCKETS = 1 << 20
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Rounds over all texts; steps that a task makes in a round at least (it goes over a small share again) and texts it holds at a time.
ROUNDS, STEPS, STEP, TEXTS_PER_STEP = 5, 80, 0.01, 64
HELD = STEPS * TEXTS_PER_STEP
#: Tasks that add up the nets of a round, and bins of a score for calibration.
MERGED, BINS = 8, 10_000
#: Texts for which the first guess of a word's lean is scaled, and languages whose word counts a task holds.
LEAN_TEXTS, LANGUAGES = 4_500, 8
#: Share of the training texts of one language (and number) that must hold a hash value, else it has no embedding: rarer words would be learnt by heart.
LEAST_SHARE, LEAST_TEXTS = 0.004, 3
#: Calibration rows that a language needs for a threshold of its own.
LANGUAGE_ROWS = 40
#: Bytes of text scored at once; the arrays over them take some fifty times as much.
TEXT_BYTES = 400_000
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_PAD = max(WIDTHS) - 1


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of the words, with padding (0) behind every text, and where each text begins."""
    words, counts = word_hashes(texts, _BETWEEN)
    padded = counts + max(WIDTHS)
    begin = np.cumsum(padded) - padded
    out = np.zeros(int(padded.sum()), dtype=np.int32)
    at = np.arange(len(words)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    out[at] = (words % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return out, begin


@dataclass
class Net:
    row_of: np.ndarray  # embedding row of each hash value; row 0 is zero
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    overall: float = 0.5
    constant: float | None = None

    @classmethod
    def new(cls, lean: np.ndarray, used: np.ndarray) -> Net:
        """``lean``: how much each hash value speaks for the label, as a first guess; only ``used`` ones get a row."""
        r = np.random.default_rng(11)
        row_of = (np.cumsum(used) * used).astype(np.int32)
        e = r.normal(0, 0.05, (int(used.sum()) + 1, DIM))
        e[1:, 0] = lean[used]
        e[0] = 0
        filters = []
        for w in WIDTHS:
            f = r.normal(0, 0.1, (w, DIM, FILTERS))
            f[r.integers(0, w, FILTERS), 0, np.arange(FILTERS)] += 1
            filters.append(f)
        n = len(WIDTHS) * FILTERS
        return cls(row_of, e, filters, [np.zeros(FILTERS) for _ in WIDTHS], np.full(n, 2.0 / n), -2.0)

    def row_type(self) -> np.dtype:
        """What holds the number of an embedding row."""
        return np.dtype("<u2" if len(self.embedding) <= 1 << 16 else "<u4")

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.weights]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter: the answers of all embedding rows."""
        return [[(self.embedding @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def read(self, rows: np.ndarray, begin: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Scores of texts given as embedding rows."""
        tops = []
        for places, offset in zip(tables, self.offsets):
            n = len(rows) - _PAD
            answer = places[0][rows[:n]]
            for k in range(1, len(places)):
                answer += places[k][rows[k:n + k]]
            tops.append(np.maximum(np.maximum.reduceat(answer, begin, axis=0) + offset, 0))
        return 1 / (1 + np.exp(-(np.hstack(tops) @ self.weights + self.bias)))

    def score(self, texts: list[bytes], tables: list[list[np.ndarray]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        values, begin = buckets(texts)
        return self.read(self.row_of[values], begin, tables)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        tables = self.tables()
        groups = text_groups(list(range(len(texts))), [pa.scalar(t) for t in texts], TEXT_BYTES)
        return np.concatenate([np.zeros(0), *(self.score(group, tables) for _, group in groups)])


def _step(net: Net, rows: np.ndarray, begin: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the log loss over some texts, in the order of ``parameters``; the bias last."""
    n, ends = len(rows) - _PAD, np.r_[begin[1:], len(rows)]
    tops, where = [], []
    for f, offset in zip(net.filters, net.offsets):
        answer = sum(net.embedding[rows[k:n + k]] @ f[k] for k in range(len(f))) + offset
        at = np.array([b + answer[b:min(e, n)].argmax(axis=0) for b, e in zip(begin, ends)])
        where.append(at)
        tops.append(np.take_along_axis(answer, at, axis=0))
    top = np.hstack(tops)
    open_ = np.maximum(top, 0)
    wrong = (1 / (1 + np.exp(-(open_ @ net.weights + net.bias))) - labels) / len(labels)
    back = np.outer(wrong, net.weights) * (top > 0)
    g_embedding = np.zeros_like(net.embedding)
    g_filters, g_offsets = [], []
    for i, (f, at) in enumerate(zip(net.filters, where)):
        b = back[:, i * FILTERS:(i + 1) * FILTERS]
        g = np.zeros_like(f)
        for k in range(len(f)):
            seen = rows[at + k]
            g[k] = np.einsum("tfd,tf->df", net.embedding[seen], b)
            np.add.at(g_embedding, seen.ravel(), (b[:, :, None] * f[k].T[None]).reshape(-1, DIM))
        g_filters.append(g)
        g_offsets.append(b.sum(axis=0))
    g_embedding[0] = 0
    return [g_embedding, *g_filters, *g_offsets, open_.T @ wrong, np.array(wrong.sum())]


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, texts, positive)``: how many texts of a language hold a hash value, and of them with label 1; bucket 0 counts all its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                for at in np.array_split(np.flatnonzero(counts[0]), 16):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), *(pa.array(c[at], pa.int64()) for c in counts)],
                                                     names=["lang", "bucket", "texts", "positive"])
            found.clear()

        for batch in batches:
            langs, labels = batch.column("lang").to_pylist(), batch.column("label").to_pylist()
            for places, group in text_groups(range(batch.num_rows), batch.column("text"), TEXT_BYTES):
                values, begin = buckets(group)
                for i, own in zip(places, np.split(values, begin[1:])):
                    if langs[i] not in found and len(found) >= LANGUAGES:
                        yield from flush()
                    counts = found.setdefault(langs[i], np.zeros((2, BUCKETS), dtype=np.int32))
                    own = np.unique(own)  # padding gives each text one 0
                    counts[0, own] += 1
                    counts[1, own] += labels[i]
        yield from flush()

    found = small_batches(rows).select("text", "label", "lang").mapInArrow(run, "lang string, bucket int, texts long, positive long")
    return found.groupBy("lang", "bucket").agg(F.sum("texts").alias("texts"), F.sum("positive").alias("positive"))


def started(counts: DataFrame) -> tuple[Net, int]:
    """A net with a row for each hash value that enough texts of one language hold, or of all together, and how many texts there are.

    A small language's words count among its own texts. The driver gets the supported values alone, at most ``BUCKETS``.
    """
    sizes = counts.filter("bucket = 0").select("lang", F.col("texts").alias("all_texts"))
    n, positive = (int(x or 0) for x in counts.filter("bucket = 0").agg(F.sum("texts"), F.sum("positive")).first())
    if not 0 < positive < n:
        net = Net.new(np.zeros(BUCKETS), np.zeros(BUCKETS, dtype=bool))
        net.constant = positive / n if n else 0.0
        return net, n
    enough = F.greatest(F.lit(LEAST_TEXTS), F.lit(LEAST_SHARE) * F.col("all_texts"))
    words = counts.filter("bucket > 0").join(sizes, "lang").withColumn("own", F.col("texts") >= enough)
    words = words.groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("positive").alias("positive"), F.max("own").alias("own"))
    got = words.filter(F.col("own") | (F.col("texts") >= max(LEAST_TEXTS, LEAST_SHARE * n))).select("bucket", "texts", "positive").toArrow()
    at, df, hits = (got.column(c).to_numpy() for c in ("bucket", "texts", "positive"))
    rate, used, lean = positive / n, np.zeros(BUCKETS, dtype=bool), np.zeros(BUCKETS)
    used[at] = True
    lean[at] = np.clip((hits - df * rate) / np.sqrt(df * rate + 1) / 5 * min(1, LEAN_TEXTS / n) ** 0.5, -1, 3)
    return Net.new(lean, used), n


def packed(rows: DataFrame, net: Net) -> DataFrame:
    """``(label, lang, apart, words)``: the texts as embedding rows of ``net`` (unsigned, two or four bytes, padded)."""
    row_of = net.row_of.astype(net.row_type())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for _, group in text_groups(range(len(batch)), batch, TEXT_BYTES):
                values, begin = buckets(group)
                out += [own.tobytes() for own in np.split(row_of[values], begin[1:])]
            yield pa.array(out, pa.binary())

    return small_batches(rows).select("label", "lang", "apart", F.arrow_udf(run, BinaryType())("text").alias("words"))


def _texts(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(w, dtype=kind).astype(np.int32) for w in batch.column("words").to_pylist()]


class _Trainer:
    """A task's own copy of the net, trained by Adam, and how many texts moved each embedding row."""

    def __init__(self, net: Net, seed: int):
        self.net, self.random, self.bias, self.t = copy.deepcopy(net), np.random.default_rng(seed), np.array(net.bias), 0
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        self.moved, self.texts = np.zeros(len(net.embedding)), 0

    def parameters(self) -> list[np.ndarray]:
        return [*self.net.parameters(), self.bias]

    def go_over(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        order = self.random.permutation(len(texts))
        for i in range(0, len(order), TEXTS_PER_STEP):
            some = order[i:i + TEXTS_PER_STEP]
            sizes = np.array([len(texts[j]) for j in some])
            grads = _step(self.net, np.concatenate([texts[j] for j in some]), np.cumsum(sizes) - sizes, labels[some])
            self.t += 1
            for p, g, (m, v) in zip(self.parameters(), grads, self.state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                move = STEP * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)
                p -= move * (g != 0) if p is self.net.embedding else move
            self.net.bias = float(self.bias)
            self.moved += (grads[0] != 0).any(axis=1)
            self.texts += len(some)

    def sums(self) -> np.ndarray:
        """Weights and weighted parameters, to be added up: embedding rows by the steps that moved them, the rest by texts."""
        rest = np.concatenate([p.ravel() for p in self.parameters()[1:]])
        return np.concatenate([self.moved, (self.net.embedding * self.moved[:, None]).ravel(), [self.texts], rest * self.texts])


def _added(net: Net, sums: np.ndarray) -> Net:
    """``net`` with the weighted means of the tasks' copies; rows that none moved stay."""
    out, n = copy.deepcopy(net), len(net.embedding)
    moved, embedding, texts, rest = sums[:n], sums[n:n + n * DIM].reshape(n, DIM), sums[n + n * DIM], sums[n + n * DIM + 1:]
    out.embedding[moved > 0] = embedding[moved > 0] / moved[moved > 0, None]
    at = 0
    for p in out.parameters()[1:]:
        p[...] = (rest[at:at + p.size] / texts).reshape(p.shape)
        at += p.size
    out.bias = float(rest[at] / texts)
    return out


def trained(net: Net, texts: DataFrame, round_: int) -> Net:
    """One round: every task trains its own copy on its share of the packed texts; their weighted mean."""
    kind = net.row_type()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, labels, whole = _Trainer(net, 5 + round_), [], [], True
        for batch in batches:
            for words, label in zip(_texts(batch, kind), batch.column("label").to_pylist()):
                held.append(words)
                labels.append(label)
                if len(held) >= HELD:
                    trainer.go_over(held, np.array(labels, dtype=np.float64))
                    held, labels, whole = [], [], False
        for _ in range(-(-STEPS // -(-len(held) // TEXTS_PER_STEP)) if held and whole else min(len(held), 1)):
            trainer.go_over(held, np.array(labels, dtype=np.float64))
        if trainer.texts:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.sums().tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                one = np.frombuffer(x.as_py())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    copies = texts.select("label", "words").mapInArrow(run, "sums binary").repartition(MERGED).mapInArrow(add, "sums binary")
    return _added(net, sum(np.frombuffer(r.sums) for r in copies.collect()))  # at most MERGED rows


def judged(net: Net, texts: DataFrame) -> DataFrame:
    """``(lang, label, score)`` of packed texts."""
    tables, kind = net.tables(), net.row_type()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, out = _texts(batch, kind), []
            ends = np.cumsum([len(w) for w in words])
            for i in np.split(np.arange(len(words)), np.searchsorted(ends, np.arange(TEXT_BYTES, ends[-1] if len(ends) else 0, TEXT_BYTES))):
                if len(i):
                    sizes = np.array([len(words[j]) for j in i])
                    out.append(net.read(np.concatenate([words[j] for j in i]), np.cumsum(sizes) - sizes, tables))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(np.concatenate([np.zeros(0), *out]))], names=["lang", "label", "score"])

    return texts.select("lang", "label", "words").mapInArrow(run, "lang string, label int, score double")


def best_cut(bins: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> float:
    """The threshold with the fewest errors, from how many rows of a label each bin of scores has; nearest to 0.5 among equals. It leaves 0.5 only to save one error in five, and three."""
    negative, positive = (np.bincount(bins[labels == y], rows[labels == y], BINS + 1) for y in (0, 1))
    errors = negative.sum() - np.cumsum(negative) + negative + np.cumsum(positive) - positive  # with the cut below each bin
    half = BINS // 2
    if errors.min() > 0.8 * errors[half] or errors.min() > errors[half] - 3:
        return 0.5
    fewest = np.flatnonzero(errors == errors.min())
    return float(fewest[np.abs(fewest - half).argmin()] / BINS)


def calibrated(net: Net, texts: DataFrame) -> Net:
    """``net`` with its cuts, from the scores of all ``texts``: a task gets a language's bins, never its rows."""
    def cut(found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": found["lang"][:1], "cut": best_cut(*(found[c].to_numpy() for c in ("bin", "label", "n")))})

    bins = judged(net, texts).withColumn("bin", F.floor(F.col("score") * BINS).cast("int"))
    bins = saved(bins.groupBy("lang", "bin", "label").agg(F.count(F.lit(1)).alias("n")), "bins")
    wide = bins.groupBy("bin", "label").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(""))
    own = bins.groupBy("lang").agg(F.sum("n").alias("rows")).filter((F.col("lang") != "") & (F.col("rows") >= LANGUAGE_ROWS)).select("lang")
    each = bins.join(own, "lang", "left_semi").select("lang", "bin", "label", "n").unionByName(wide.select("lang", "bin", "label", "n"))
    for r in each.groupBy("lang").applyInPandas(cut, "lang string, cut double").collect():  # one row a language
        if r.lang:
            net.thresholds[r.lang] = r.cut
        else:
            net.overall = r.cut
    return net


def train(labelled: DataFrame, text: str = "text", label: str = "label", lang: str = "lang") -> Net:
    """Train on all rows; null labels are left out."""
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), (F.col(label).cast("int") == 1).cast("int").alias("label"),
                           F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")).filter("label IS NOT NULL")
    rows = rows.withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(4)) == 3)
    net, n = started(saved(word_counts(rows.filter("NOT apart")), "word-counts"))
    if net.constant is not None:
        return net
    spark = labelled.sparkSession
    shares = max(1, min(n // HELD, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    words = saved(packed(rows, net).repartition(shares), "words")
    here, apart = words.filter("NOT apart"), words.filter("apart")
    row_of, net = net.row_of, replace(net, row_of=np.zeros(0, dtype=np.int32))  # tasks of the rounds have no need of it
    best, kept = np.inf, net
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    for i in range(ROUNDS):
        net = trained(net, here, i)
        loss = judged(net, apart).agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]
        loss = -float(i) if loss is None else loss
        if loss < best:
            best, kept = loss, net
    return replace(calibrated(kept, apart), row_of=row_of)


def score(df: DataFrame, net: Net, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with score (0 to 1), threshold (of its language) and toxic (score at least the threshold)."""
    tables = net.tables()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [net.score(group, tables) for _, group in text_groups(range(len(batch)), batch, TEXT_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))


    cut = F.lit(net.overall)
    for one, value in net.thresholds.items():
        cut = F.when(F.col(lang) == one, F.lit(value)).otherwise(cut)
    out = small_batches(df).withColumn("score", F.arrow_udf(run, DoubleType())(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return out.withColumn("threshold", cut).withColumn("toxic", F.col("score") >= F.col("threshold"))


def rejected(df: DataFrame, net: Net, text: str = "text", lang: str = "lang") -> DataFrame:
    """The keys (``content_key``) of the texts that the net rejects, one row each."""
    scored = score(df.select(*content_key(text, lang), text, lang), net, text, lang)
    return scored.filter("toxic").select("content_a", "content_b").distinct()


def content_key(text: str = "text", lang: str = "lang") -> list[Column]:
    """Two hashes (128 bits) of what a score and its threshold depend on."""
    parts = [F.col(text).isNull(), F.col(text), F.col(lang).isNull(), F.col(lang)]
    return [F.xxhash64(F.lit(1), *parts).alias("content_a"), F.xxhash64(F.lit(2), *parts).alias("content_b")]
