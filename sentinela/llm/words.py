"""Words and shingles of Arrow text columns, as 64-bit hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                    0xE7037ED1A0B428DB, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits; one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, A-Z in lower case; where each text's words begin.

    The second array has one entry more than there are texts. A null text has no words.
    """
    # A new array: some functions misread an array that is a slice of a longer one.
    texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = split.values, np.asarray(split.offsets).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, offsets
    # White space at either end of a text leaves an empty word there.
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of words, each distinct word being hashed once."""
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in
                       pc.cast(coded.dictionary, pa.large_binary()).to_pylist()),
                      np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(flat) else own


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int = 5
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and where each text's runs begin.

    A text with fewer words, but some, has one run: all its words.
    """
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(runs)])
    with np.errstate(over="ignore"):
        long = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for place in range(size):
            long += hashes[place:place + len(long)] * _PLACES[place]
        long = mix(long)
        # The word at which each run begins.
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], runs) + np.repeat(offsets[:-1], runs)
        out = np.empty(starts[-1], np.uint64)
        whole = np.repeat(counts >= size, runs)
        out[whole] = long[at[whole]]
        for text in np.flatnonzero((counts > 0) & (counts < size)):
            value = np.uint64(counts[text]) * _MIX
            for h in hashes[offsets[text]:offsets[text + 1]]:
                value = mix(np.array([value * _PLACES[0] + h]))[0]
            out[starts[text]] = value
    return out, starts


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    flat, offsets = words(texts)
    runs, starts = shingle_hashes(word_hashes(flat), offsets, size)
    return [np.unique(runs[a:b]) for a, b in zip(starts[:-1], starts[1:])]
