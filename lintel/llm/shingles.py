"""Word shingles of texts as 64-bit hashes, computed for many texts at once.

Words are the runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lower-cased. A text's set holds the hashes of
its distinct runs of ``width`` words; of the whole sequence if it has fewer
words; nothing without words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_LOWER[65:91] += _U(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keys(n: int, seed: int = 1) -> np.ndarray:
    """``n`` fixed odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_PLACES = keys(256)


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text its number of words.

    ``between``: for each byte value whether it stands between words (a space must).
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = between[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = _LOWER[data]
    value[space] = 0
    far = int(place.max()) + 1
    value *= (_PLACES if far <= len(_PLACES) else keys(far))[place]
    length = np.add.reduceat((~space).astype(np.int64), starts).astype(np.uint64)
    return mix(np.add.reduceat(value, starts) + length * _U(0xD6E8FEB86659FD93)), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    by = keys(width, seed=7)
    full = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full += words[k:k + len(full)] * by[k]
    full = mix(full + _U(width))
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            out.append(np.unique(full[end - n:end - width + 1]))
        elif n:
            out.append(mix(np.array([(words[end - n:end] * by[:n]).sum() + _U(n)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that are equal for equal sets."""
    if not len(hashes):
        return 0, 0
    return tuple(int(x) for x in np.array([mix(hashes).sum(), mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)).sum()],
                                          dtype=np.uint64).view(np.int64))


def text_groups(batch_ids: list, batch_texts, limit: int):
    """Consecutive ``(ids, texts)`` of about ``limit`` bytes, a longer text alone."""
    ids, texts, held = [], [], 0
    for i, x in zip(batch_ids, batch_texts):
        t = x.as_py() if x.is_valid else b""
        if held and held + len(t) > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(i)
        texts.append(t)
        held += len(t) + 1
    if texts:
        yield ids, texts
