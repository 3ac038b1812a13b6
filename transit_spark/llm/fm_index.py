"""Substring deduplication with compressed FM-indexes: words covered by 50 words that an earlier text holds too go.

Segments around equal anchors (see ``repeats``) meet in shards. A shard builds an FM-index of its distinct segments: the
suffix order of the block, a wavelet matrix over the Burrows-Wheeler transform, stored as bit vectors with sampled counts, and
the smallest id of the segment at each suffix with a table for range minima. Every segment is then streamed through
the index, for its smallest id and for any greater one: from a place a backward search extends a match word by word, as long
as the match's occurrences include one of a smaller id. The lengths reached are the matching statistics; where they reach the
threshold, the interval is reported. A match that ends early rules out all windows that hold it and the word it stopped at, so
the next place is the first one beyond these.

Windows are judged on the input. Defined cases: a null or empty text has no words; texts of fewer than 50 words lose
nothing. A row with a null id takes no part: it loses nothing and is no other's earlier text. Rows that share an id are not
earlier than each other; each gets its own row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import repeats
from transit_spark.llm.bwt import Transform

WINDOW_WORDS = 50
GRAM_WORDS = 20
QUERIES_AT_ONCE = 1 << 19


class RangeMinimum:
    """Smallest value of any range, from minima over ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(len(low), np.iinfo(np.int64).max)
        scale = np.frexp((high - low).astype(np.float64))[1] - 1
        for s in np.unique(scale[high > low]).tolist():
            mine = np.flatnonzero((scale == s) & (high > low))
            table = self.tables[s]
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << s)])
        return out


class FMIndex:
    def __init__(self, block: repeats.Block, depth: int) -> None:
        self.t = Transform(block.symbols, block.first, block.alphabet, depth)
        self.smallest = RangeMinimum(block.least[self.t.segment])

    def matching_lengths(self, pattern: np.ndarray, end: np.ndarray, most: int, below: np.ndarray) -> np.ndarray:
        """For each place ``end`` of the pattern, how far back the longest match that ends there reaches, up to ``most``
        symbols, in segments of an id smaller than ``below``."""
        length = np.zeros(len(end), np.int64)
        active = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.t.n)
        for step in range(most):
            symbol = pattern[end[active] - 1 - step] + 1
            base = self.t.below[symbol]
            low = base + self.t.wavelet.rank(symbol, low)
            high = base + self.t.wavelet.rank(symbol, high)
            go = self.smallest(low, high) < below[active]
            active, low, high = active[go], low[go], high[go]
            length[active] += 1
            if not len(active):
                break
        return length


def _first_and_last(index: FMIndex, block: repeats.Block, window: int, some: np.ndarray, below: np.ndarray):
    """Of each segment in ``some``, the first and last window that stands in a segment of an id smaller than ``below``."""
    low, high = np.full(len(block.first) - 1, np.iinfo(np.int64).max), np.full(len(block.first) - 1, -1)
    begin, last = block.first[some], block.first[some + 1]

    def lengths(who: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0, np.int64)]
        for i in range(0, len(who), QUERIES_AT_ONCE):
            w, e = who[i : i + QUERIES_AT_ONCE], end[i : i + QUERIES_AT_ONCE]
            parts.append(index.matching_lengths(block.symbols, e, window, below[w]))
        return np.concatenate(parts)

    who = np.flatnonzero(last - begin >= window)
    whole = np.zeros(len(some), bool)  # whether the last window matches
    whole[who] = lengths(who, last[who]) >= window
    high[some[whole]] = (last - begin)[whole] - window
    end = begin[who] + window
    while len(who):
        reached = lengths(who, end)
        hit = reached >= window
        at, which = end[hit] - window - begin[who[hit]], some[who[hit]]
        low[which], high[which] = np.minimum(low[which], at), np.maximum(high[which], at)
        end = np.where(hit, end + 1, end - reached + window)
        # what is known: the last window, and with it and a first one all
        go = np.where(whole[who], ~hit & (end <= last[who]), end < last[who])
        who, end = who[go], end[go]
    return low, high


def search(reach: int):
    """Of each segment, the first and last window that a segment of a smaller id holds too: for its smallest id, if that is asked
    for, and for its other ids, to which the segment itself is one of a smaller id."""

    def run(block: repeats.Block) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        index = FMIndex(block, reach + 1)
        asked, copied = np.flatnonzero(block.asked), np.flatnonzero(block.copied)
        return [
            (False, *_first_and_last(index, block, reach + 1, asked, block.least[asked])),
            (True, *_first_and_last(index, block, reach + 1, copied, block.least[copied] + 1)),
        ]

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS,
                    gram: int = GRAM_WORDS,
                    block: int = repeats.BLOCK_SYMBOLS) -> DataFrame:
    """(id, n_words, n_removed, n_spans, kept, carried) of each row; kept: the words left, joined by one space."""
    kind = repeats.Spans(False, window, gram, block)
    rows = repeats.numbered(docs, id_col, text_col)
    result = repeats.removed(rows, kind, search(kind.reach), by_id=True)
    return result.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept", "carried")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
