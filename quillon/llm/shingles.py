"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hashes of all words one after another)."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    doc, flat = pc.list_parent_indices(lists), lists.flatten()
    full = pc.not_equal(flat, "")
    doc, flat = doc.filter(full).to_numpy(zero_copy_only=False), flat.filter(full)
    coded = flat.dictionary_encode()
    forms = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(flat) else np.empty(0, np.uint64)
    return np.bincount(doc, minlength=len(texts)), forms[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(start of each text's set, hashes): distinct and sorted inside a text.

    A text of fewer than ``size`` words, but one at least, is a single shingle.
    """
    n_words, h = word_hashes(texts)
    n = len(n_words)
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(n), n_words)
    left = np.repeat(ends, n_words) - np.arange(len(h))
    acc = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            nxt = np.zeros(len(h), np.uint64)
            if k < len(h):
                nxt[: len(h) - k] = h[k:]
            acc = np.where(left > k, mix(acc * _MIX + nxt + np.uint64(k + 1)), acc)
    first = np.arange(len(h)) == np.repeat(ends - n_words, n_words)
    keep = (left >= size) | (first & (np.repeat(n_words, n_words) < size))
    doc, acc = doc[keep], acc[keep]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]), acc[new]


def minhasher(k: int, seed: int = 1, chunk: int = 1024):
    """A function that gives the k minimum hashes (uint32) of a non-empty set."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)[:, None]
    odd = (rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
    return lambda sets: _minhashes(sets, flip, odd, chunk)


def _minhashes(sets, flip, odd, chunk):
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    best = None
    for s in range(0, len(x), chunk):
        low = ((x[None, s : s + chunk] ^ flip) * odd).min(1)
        best = low if best is None else np.minimum(best, low)
    return best
