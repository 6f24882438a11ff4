"""Word shingles of whole texts as 64-bit hashes, computed batch-wise on Arrow and numpy arrays.

Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with fewer words than a shingle has
its whole word sequence as its only one; a text without words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from cellarmark.llm.common import byte_slices

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order; words before each text, with the total at the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    index = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    blank = [i for i, w in enumerate(words) if not w]  # white space at the ends of a text leaves empty words
    if blank:
        real = index != blank[0]
        offsets, index = np.concatenate([[0], np.cumsum(real)])[offsets], index[real]
    return known[index], offsets


def shingle_sets(texts: pa.Array, width: int, most_words: int = 2_000_000) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in byte_slices(texts, 4 * most_words):
        hashes, offsets = word_hashes(texts.slice(a, b - a))
        joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for j in range(width):
            joined = joined * FACTOR + hashes[j : j + len(joined)]
        joined = mixed(joined)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if hi - lo >= width:
                yield np.unique(joined[lo : hi - width + 1])
            elif hi > lo:
                whole = np.zeros(1, np.uint64)
                for j in range(lo, hi):
                    whole = whole * FACTOR + hashes[j]
                yield mixed(whole + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
