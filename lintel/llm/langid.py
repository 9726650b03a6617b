"""Operator 7: language of web pages by Bayesian fusion of evidence.

For each page the log posterior of a language is the sum of

* the likelihood of its visible text under a naive Bayes model of hashed
  character trigrams (tempered by the square root of the text's length, as
  neighbouring trigrams aren't independent),
* the likelihood of the language declared in its markup, and of its address
  suffix, from tables of how often pages of each language declare or end so,
* a host prior: the languages of the other pages of its host, smoothed towards
  those of its domain, and these towards those of all pages.

Tables and priors are grouped sums of text posteriors over all pages
(pre-aggregated, so a host that holds a third of the pages costs one row a task);
a page's own share is taken out of its host's and domain's sums.

Defined results: a page without visible text has the same likelihood under all
languages; a null URL or declaration counts as a value of its own; equal
posteriors go to the first language in alphabetical order; repeated rows are
pages of their own; without labelled texts the language is null; other columns
stay, columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lintel.llm.common import fresh, saved, shares
from lintel.llm.shingles import keys, mix, text_groups
from lintel.llm.url_filter import host_of

#: Labelled texts of the model, code of a trigram, pages that smooth a host or domain, pseudo count of the tables.
SAMPLE, CODES, SMOOTHING, PSEUDO = 4_000, 1 << 16, 5.0, 1.0
TEXT_BYTES = 2_000_000
_BY = keys(3, seed=3)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER[[9, 10, 11, 12, 13]] = 32


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", " ")
    return F.trim(F.regexp_replace(bare, r"(?s)<[^>]*+>?|&#?\w{1,10};|\s+", " "))


def declared(html: Column) -> Column:
    """The primary language tag of the root element, lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte trigrams of the texts (A-Z lower-cased), and how many each text has."""
    data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = max(len(data) - 2, 0)
    code = (mix(data[:n] * _BY[0] + data[1:n + 1] * _BY[1] + data[2:n + 2] * _BY[2]) % np.uint64(CODES)).astype(np.int32)
    ends = np.cumsum(sizes)
    own = np.ones(n, dtype=bool)
    for k in (1, 2):  # trigrams over the border of two texts
        cut = ends - k
        own[cut[(cut >= 0) & (cut < n)]] = False
    cumulated = np.r_[0, np.cumsum(own)]
    counts = np.diff(cumulated[np.minimum(ends, n)], prepend=0)
    return code[own], counts


class Model:
    """Log likelihoods of trigram codes by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
        """From at most ``sample`` distinct labelled texts, an even share of each language; every language of the table is known."""
        known = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL AND t <> ''")
        some, sizes = shares(known, "l", "t", sample)
        rows, languages = some.collect(), sorted(sizes)  # bounded by ``sample`` and the number of languages
        counts = np.full((CODES, len(languages)), 0.05)
        for r in rows:
            code, _ = codes([r.t.encode()])
            counts[:, languages.index(r.l)] += np.bincount(code, minlength=CODES)
        return cls(languages, np.log(counts / counts.sum(axis=0)) if languages else counts)

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """Tempered log likelihood of each text by language, 0 for the best."""
        code, counts = codes(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        which = np.repeat(np.arange(len(texts)), counts)
        for k in range(len(self.languages)):
            sums[:, k] = np.bincount(which, weights=self.table[code, k], minlength=len(texts))
        sums /= np.sqrt(np.maximum(counts, 1))[:, None]
        return sums - sums.max(axis=1, keepdims=True)


def identify(pages: DataFrame, model: Model, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with language, confidence (its posterior) and text_language (by the text alone).

    ``keep`` names the columns that stay (all by default); they are stored once on the way.
    """
    names = model.languages
    keep = [c for c in keep or pages.columns if c not in ("language", "confidence", "text_language")]
    if not names:
        return pages.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"),
                            F.lit(None).cast("string").alias("text_language"))
    size = len(names)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.likelihoods(group) for _, group in text_groups(range(len(batch)), batch, TEXT_BYTES)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))

    tag = {x: fresh(pages, f"lid_{x}") for x in ("ll", "post", "declared", "host", "domain", "suffix", "hd", "hh", "hs", "hc", "best")}
    c = {x: F.col(n) for x, n in tag.items()}
    host = host_of(F.col(url))
    scored = saved(pages.select(*[F.col(c) for c in keep], F.arrow_udf(run, ArrayType(DoubleType()))(visible(F.col(html)).cast("binary")).alias(tag["ll"]), declared(F.col(html)).alias(tag["declared"]),
                                host.alias(tag["host"]), domain_of(host).alias(tag["domain"]), suffix_of(host).alias(tag["suffix"])), "language-likelihoods")
    post = F.transform(c["ll"], lambda x: F.exp(x))
    post = F.transform(post, lambda x: x / F.aggregate(post, F.lit(0.0), lambda s, y: s + y))
    scored = scored.withColumn(tag["post"], post)

    def sums(by: str, name: str) -> DataFrame:
        """The text posteriors of all pages added up by a column."""
        each = [F.sum(c["post"][k]) for k in range(size)]
        return saved(scored.groupBy(c[by].alias(tag[by])).agg(F.array(*each).alias(tag[name])), f"sums-{by}")

    overall = scored.agg(*[F.sum(c["post"][k]).alias(f"s{k}") for k in range(size)]).first()
    total = np.array([overall[k] or 0.0 for k in range(size)]) + PSEUDO
    share = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    sizes = F.array(*[F.lit(float(x)) for x in total])
    joined = (scored.join(sums("host", "hh"), tag["host"]).join(sums("domain", "hd"), tag["domain"])
              .join(sums("declared", "hc"), tag["declared"]).join(sums("suffix", "hs"), tag["suffix"]))

    def smoothed(own: Column, towards: Column) -> Column:
        """Shares of the other pages' sums, with ``SMOOTHING`` pages of the wider group."""
        others = F.zip_with(own, c["post"], lambda s, p: F.greatest(s - p, F.lit(0.0)))
        n = F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(others, towards, lambda s, t: (s + SMOOTHING * t) / (n + SMOOTHING))

    def likelihood(own: Column) -> Column:
        """Share of a value among the pages of each language, smoothed."""
        others = F.zip_with(own, c["post"], lambda s, p: F.greatest(s - p, F.lit(0.0)))
        return F.zip_with(others, sizes, lambda s, t: F.log((s + PSEUDO * 0.1) / (t + PSEUDO)))

    prior = smoothed(c["hh"], smoothed(c["hd"], share))
    evidence = [c["ll"], F.transform(prior, lambda p: F.log(p)), likelihood(c["hc"]), likelihood(c["hs"])]
    fused = evidence[0]
    for e in evidence[1:]:
        fused = F.zip_with(fused, e, lambda a, b: a + b)
    joined = joined.withColumn(tag["best"], fused)
    top = F.array_max(c["best"])
    language = F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(c["best"], top) - 1).cast("int"))
    by_text = F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(c["ll"], F.lit(0.0)) - 1).cast("int"))
    confidence = 1 / F.aggregate(c["best"], F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return joined.select(*keep, language.alias("language"), confidence.alias("confidence"), by_text.alias("text_language"))
