"""Words of many texts at once, as ranges of one array of bytes, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words of letters, digits and everything beyond ASCII; words of everything but ASCII white space.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a line feed after each, where each text starts and the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pa.concat_arrays([texts]) if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = parts.buffers()[2]
    source = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    starts = ends - ends[0] + np.arange(len(ends))
    raw = np.full(int(starts[-1]), 10, np.uint8)
    keep = np.ones(len(raw), bool)
    keep[starts[1:] - 1] = False
    raw[keep] = source[ends[0] : ends[-1]]
    return raw, starts


def find_words(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end; `raw` ends with a byte that is in no word."""
    inside = kind[raw]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    return change[0::2], change[1::2]


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z in lower case."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    powers = np.ones(longest, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    table = _BYTE[LOWER]
    for at in range(0, len(starts), _CHUNK):
        s, e = starts[at : at + _CHUNK], ends[at : at + _CHUNK]
        lengths = e - s
        tops = np.cumsum(lengths)
        place = np.arange(tops[-1]) - np.repeat(tops - lengths, lengths)
        values = table[raw[np.repeat(s, lengths) + place]] * powers[place]
        out[at : at + _CHUNK] = np.add.reduceat(values, tops - lengths)
    return mixed(out)
