"""Sets of word shingles of a batch of texts, worked out for the whole batch at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def hash_words(words: pa.Array) -> np.ndarray:
    """64 bits of BLAKE2 of each word. No two words that could be made on purpose have the same ones."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(w, digest_size=8).digest() for w in words.cast(pa.binary()).to_pylist()]), np.uint64)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text by text, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    blank = pc.index(coded.dictionary, "").as_py()  # stands where a text begins or ends with a blank
    if blank >= 0:
        full = which != blank
        which, owner = which[full], owner[full]
    return hash_words(coded.dictionary)[which], np.bincount(owner, minlength=len(texts))


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = np.full(max(0, len(words) - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ words[k : k + len(out)]) * _MULT[0]
            out ^= out >> np.uint64(32)
        out *= _MULT[1]
    return out ^ (out >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int, at_once: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The sorted, distinct shingles of each text, side by side, and how many each has.

    A text with fewer words than ``width`` has one shingle, of all of them. A batch is worked through in parts of
    at_once bytes or so, which bounds the memory beside the result.
    """
    rows = max(1, len(texts) * at_once // max(1, texts.nbytes))
    if rows < len(texts):
        found, sizes = zip(*(shingle_sets(texts.slice(i, rows), width, 1 << 62) for i in range(0, len(texts), rows)), strict=True)
        return np.concatenate(found), np.concatenate(sizes)
    words, counts = _word_hashes(texts)
    ends = np.cumsum(counts)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    short = np.repeat(counts < width, sizes)
    found = np.empty(int(sizes.sum()), np.uint64)
    whole = np.arange(max(0, len(words) - width + 1)) + width <= np.repeat(ends, counts)[: max(0, len(words) - width + 1)]
    found[~short] = _windows(words, width)[whole]
    slots = np.cumsum(sizes) - sizes
    for n in range(1, width):
        own = np.flatnonzero(counts == n)
        if len(own):
            found[slots[own]] = _windows(words, n)[ends[own] - n]
    for a, b in zip(slots.tolist(), (slots + sizes).tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[slots[sizes > 0]] = True
    return found[new], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[new], minlength=len(sizes))


def set_classes(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (of an empty one: 0)."""
    out = np.zeros(len(sizes), np.uint64)
    with np.errstate(over="ignore"):
        mixed = (shingles ^ (shingles >> np.uint64(31))) * _MULT[2]
        mixed ^= mixed >> np.uint64(28)
        full = np.flatnonzero(sizes)
        if len(full):
            sums = np.add.reduceat(mixed, (np.cumsum(sizes) - sizes)[full])
            sums = (sums ^ sizes[full].astype(np.uint64)) * _MULT[1]
            out[full] = sums ^ (sums >> np.uint64(32))
    return out.view(np.int64)
