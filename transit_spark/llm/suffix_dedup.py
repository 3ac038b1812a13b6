"""Suffix-array deduplication: bytes covered by a 400-byte string that occurs more than once go.

Segments around equal anchors (see ``repeats``) meet in shards. A shard sorts the suffixes of its segments, takes the
Burrows-Wheeler transform and derives common prefixes by increasing value: intervals of suffixes that share a prefix
are extended backward by one symbol, breadth first. An interval's upper border that is met for the first time from prefixes of
length l has a common prefix of l. The search stops at the minimum length; borders that no interval has reached by then
join suffixes that share at least that much. A string occurs as often as the segments of its suffixes do, copies included.

All occurrences are removed, also the first, and strings are judged on the input. Defined cases: a null text is an empty one;
texts shorter than 400 bytes lose nothing; a string may repeat within its own text, overlapping itself; equal rows are
copies of each other. A null id is an id like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import repeats
from transit_spark.llm import text as tx
from transit_spark.llm.bwt import Transform

MIN_BYTES = 400
GRAM_BYTES = 240
NARROW = 64  # suffixes of an interval up to which it is extended one by one, once intervals hold much of a block


def narrow_extensions(low: np.ndarray, high: np.ndarray, before: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the prefixes one symbol longer to the left, from those of disjoint intervals, suffix by suffix.

    ``before``: where each suffix goes, or -1; ``heads``: whether a place is the first of its first symbol. Suffixes of an interval
    that have one symbol before them go to consecutive places.
    """
    owner, at = tx.expand(low, high - low)
    key = before[at]
    key <<= 32
    key |= owner
    key.sort()
    key = key[np.searchsorted(key, 0) :]
    to, owner = key >> 32, key & 0xFFFFFFFF
    begins = np.ones(len(key), bool)
    begins[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | heads[to[1:]]
    return to[begins], to[np.append(begins[1:], True)] + 1 if len(key) else to


def long_prefix_borders(t: Transform, length: int) -> np.ndarray:
    """Whether suffixes i - 1 and i, in order, share at least ``length`` symbols.

    Narrow intervals are extended suffix by suffix, wide ones by the wavelet matrix, whose work doesn't grow with their width;
    where all of a round hold few suffixes, they count as narrow.
    """
    known = np.zeros(t.n + 1, bool)
    known[: t.segments + 1] = known[t.n] = True
    # prefixes of one symbol: each separator, then each symbol
    low = np.concatenate((np.arange(t.segments), t.below[1:]))
    high = np.concatenate((np.arange(1, t.segments + 1), t.below[2:], [t.n]))
    some = high > low
    low, high = low[some], high[some]
    known[high] = True
    heads, before = known.copy(), np.where(t.real, t.before(), -1)
    for _ in range(1, length):
        width = high - low
        narrow = width <= (NARROW if width.sum() > t.n >> 5 else t.n)
        a, b = narrow_extensions(low[narrow], high[narrow], before, heads)
        if not narrow.all():
            symbol, c, d = t.wavelet.distinct(low[~narrow], high[~narrow])
            real = symbol > 0
            a = np.concatenate((a, t.below[symbol[real]] + c[real]))
            b = np.concatenate((b, t.below[symbol[real]] + d[real]))
        fresh = ~known[b]
        low, high = a[fresh], b[fresh]
        known[high] = True
        if not len(low):
            break
    return ~known[:-1]


def search(reach: int):
    """Of each segment of a block, the first and last window that occur more than once.

    The suffixes between two borders that are not joined share a window; it occurs as often as their segments together.
    """

    def run(block: repeats.Block) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        window = reach + 1
        t = Transform(block.symbols, block.first, block.alphabet, window)
        interval = np.cumsum(~long_prefix_borders(t, window)) - 1
        at = t.order - t.begin[t.segment]
        full = np.diff(block.first)[t.segment] - at >= window
        occurs = np.bincount(interval, np.where(full, block.count[t.segment], 0))
        rows = np.flatnonzero(full & (occurs[interval] > 1))
        low = np.full(t.segments, np.iinfo(np.int64).max)
        high = np.full(t.segments, -1)
        np.minimum.at(low, t.segment[rows], at[rows])
        np.maximum.at(high, t.segment[rows], at[rows])
        return [(False, low, high)]

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
                    gram_bytes: int = GRAM_BYTES, block: int = repeats.BLOCK_SYMBOLS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, carried) of each row; kept: the bytes that are left; carried: its other columns."""
    kind = repeats.Spans(True, min_bytes, gram_bytes, block)
    rows = repeats.numbered(docs, id_col, text_col)
    result = repeats.removed(rows, kind, search(kind.reach), by_id=False)
    return result.select(F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept", "carried")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts, and ``chars_col``, if it is there, counted anew.

    Of a character that a cut splits, what is left becomes U+FFFD. A null text becomes an empty one.
    """
    result = without_repeats(docs, id_col, text_col, **options)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    columns = [text.alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    out = result.select(*columns)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
