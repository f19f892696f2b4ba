"""Sets of word shingles as sorted 64-bit hashes, computed over whole batches of texts at once.

A word's hash is a keyed one, so no text can be written to share it with another; a shingle's is a mixed sum of those of
its words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
WORD_KEY = b"shingle-words-1"
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 21


def mixed(h: np.ndarray, turn: int = 0) -> np.ndarray:
    """A permutation of the 64-bit integers; each ``turn`` is another one."""
    h = h + np.uint64((turn * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n, and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        up = np.full(n + 1, base, np.uint64)
        up[0] = 1
        out.append(np.multiply.accumulate(up))
    return out[0], out[1]


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse base to the power i, a hash of the bytes i to j. ``up``: powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=WORD_KEY).digest(), "little")


def _chunk(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text of a chunk, in turn and with repeats."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    solid = np.asarray(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(word_hash, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()][solid]
    at = np.concatenate([[0], np.cumsum(solid)])[offsets]
    whole = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        whole = whole * _STEP + words[k : k + len(whole)]
    whole = mixed(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield whole[a : b - size + 1]
        elif b == a:
            yield whole[:0]
        else:
            few = np.uint64(b - a)
            for w in words[a:b]:
                few = few * _STEP + w
            yield mixed(np.array([few], np.uint64), 1)


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text, whole and with A-Z lower-cased, its sorted distinct shingle hashes; of fewer words than ``size`` one
    for the whole sequence; none without words or text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1] if n else None
    a = 0
    with np.errstate(over="ignore"):
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
            # Arrow's ascii_lower answers with other bytes where offsets don't start at 0, as after the cast of a slice.
            own, length = pa.py_buffer(offsets[a : b + 1] - offsets[a]), int(offsets[b] - offsets[a])
            part = pa.LargeStringArray.from_buffers(b - a, own, data.slice(int(offsets[a]), length) if length else pa.py_buffer(b""))
            for h in _chunk(part, size):
                yield np.unique(h)
            a = b


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """A number for a set, which texts with the same set share, and a second one that tells sets with the same first."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
