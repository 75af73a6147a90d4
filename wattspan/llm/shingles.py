"""Sets of word shingles as sorted arrays of 64-bit hashes.

A-Z are lower-cased and words are runs without ASCII white space, which is what ``lower`` and ``split`` of
Python's bytes do. A text of fewer words than a shingle has gives its whole sequence as one shingle; a
text without words gives the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from wattspan.llm.workers import hold

WORDS = 5
MEMO_WORDS = 100_000
#: Odd multipliers of the word positions in a shingle.
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_memo: dict[bytes, int] = {}
# Give freed buffers back at once: workers are kept between tasks.
pa.set_memory_pool(pa.system_memory_pool())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output looks random (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = _memo
    try:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    k = min(size, len(h))
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += mix(h[i : i + n] * _M[i % len(_M)] + np.uint64(i + 1))
    return np.unique(mix(total))


def sets(batches: Iterator[pa.RecordBatch], most: int = 512, size: int = WORDS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of (id, text) batches, of ``most`` documents at a time."""
    hold("shingles", _memo.clear)
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            texts = part.column(1).cast(pa.binary())
            yield part.column(0).to_pylist(), [shingle_set(t.as_py(), size) for t in texts]
