"""Words, grams and their hashes over Arrow text columns, vectorised in numpy.

Texts are handled as the UTF-8 bytes of an Arrow column; a null text is an empty one. Hashes are polynomials
modulo 2^64 over prefix sums, so that the hash of any span costs one subtraction and one product.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are worked on in runs of about so many bytes; a longer text is a run of its own


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


WHITE_SPACE = byte_table(bytes(range(9, 14)) + b" ")
#: Bytes outside of words of digits, a-z and anything that isn't ASCII, once A-Z are lower-cased.
NOT_ALPHANUMERIC = byte_table(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset at which each begins, plus the end."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts [i, j) of at most ``size`` bytes, or a single longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


@dataclass
class Words:
    """Spans of words in a run of texts; ``first[d]`` to ``first[d + 1]`` are those of text ``d``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal spans without separator bytes; no word crosses the border of two texts."""
    inside = ~separators[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[borders] = inside[borders]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASES[base]), -1, 1 << 64))
        ups, downs = np.ones(size, np.uint64), np.ones(size, np.uint64)
        ups[1:], downs[1:] = BASES[base], inverse
        have = _POWERS[base] = (np.cumprod(ups), np.cumprod(downs))
    return have[0][:n], have[1][:n]


def powers(n: int, base: int = 0) -> np.ndarray:
    return _powers(n, base)[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(codes: np.ndarray, base: int = 0) -> np.ndarray:
    _, downs = _powers(len(codes), base)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum((codes + np.uint64(1)) * downs, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of codes[start:end], which depends on the codes alone, not on where they stand."""
    ups, _ = _powers(len(sums), base)
    return mixed((sums[end] - sums[start]) * ups[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, words: Words, base: int = 0) -> np.ndarray:
    return span_hashes(prefix_sums(data.astype(np.uint64), base), words.start, words.end, base)


def gram_hashes(codes: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of each k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(codes, base)
    ups, _ = _powers(n, base)
    return mixed((sums[k:] - sums[:n]) * ups)


LOW = np.uint64(0xFFFFFFFF)


def window_minima(grams: np.ndarray, first: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest gram hash, leftmost if several, of any ``window`` consecutive grams.

    Text d has the grams ``first[d]`` to ``first[d] + counts[d]``. The choice within a window follows from its grams
    alone, so two texts that share the grams of a window share the chosen position.
    """
    n = len(grams)
    full = counts >= window
    if not full.any():
        return np.zeros(0, np.int64)
    keyed = (grams & ~LOW) | np.arange(n, dtype=np.uint64)
    size = -(-n // window) * window
    padded = np.full(size, ~np.uint64(0), np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    smallest = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    # windows lie inside a text
    steps = np.zeros(len(smallest) + 1, np.int32)
    np.add.at(steps, first[full], 1)
    np.add.at(steps, first[full] + counts[full] - window + 1, -1)
    chosen = smallest[np.cumsum(steps[:-1]) > 0] & LOW
    keep = np.ones(len(chosen), bool)
    keep[1:] = chosen[1:] != chosen[:-1]
    return chosen[keep].astype(np.int64)


def expand(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, first + counts): the range of each element, and the element itself."""
    owner = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else first
    return owner, base + np.arange(len(owner))


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it; names are compared like Spark does, without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end the worker gives memory that it has freed back to the system.

    Python workers serve one operator after the other, so what one of them no longer needs would add to the next one's.
    """
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        trim = None
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim:
        trim(0)
