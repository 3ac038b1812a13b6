"""Token ids of texts, by the tokenizers library, with repeated chunks encoded once.

The vocabulary drops white space and never joins what stands on two sides of it, so a text is encoded chunk by chunk. A
vocabulary that lower-cases and splits letters from punctuation also gives a word the ids of its lower-case letters and
those of the marks at its end. Each Python worker keeps the ids of the chunks and pieces that it has met, up to ``KEPT`` and
``KEPT_CHUNKS``.

Chunks are found in the bytes of a whole batch. One of up to 16 bytes is two numbers, which are all that it is looked up and
compared by; longer ones, and those with a zero byte, are looked up as text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from transit_spark.llm.text import byte_table, expand, find_words, mixed, text_bytes

KEPT, KEPT_CHUNKS = 500_000, 1 << 21
PACKED = 16
MERGED = 1 << 15  # chunks learned before they are sorted in among the others
RUN_PIECES = 512
#: White space of every vocabulary of this kind; other white space stays inside chunks and is the library's to drop.
_PLAIN_SPACE = byte_table(b" \t\n\r")
_END_MARKS = ".,!?;:"


class _Table:
    """Id sequences by key."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))

    def get(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys, one after the other, and the number of each."""
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(total)], sizes


class _Cache:
    """Two generations of a table: when the newer one is full it becomes the older, and what is met again moves over."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.learn, self.new, self.old = learn, _Table(), _Table()

    def get(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        missing = set(keys).difference(self.new.known)
        if len(self.new.known) + len(missing) > KEPT // 2:
            self.old, self.new, missing = self.new, _Table(), set(keys)
        kept = [k for k in missing if k in self.old.known]
        if kept:
            self.new.add(kept, *self.old.get(kept))
            missing.difference_update(kept)
        if missing:
            unseen = list(missing)
            self.new.add(unseen, *self.learn(unseen))
        return self.new.get(keys)


class _Packed:
    """Ids of packed chunks: sorted runs of (mix, two halves, first id, number of ids), the newest of them small.

    Beyond ``KEPT_CHUNKS`` all are forgotten, and what is frequent is soon known again.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.ids = np.zeros(0, np.uint32)

    def held(self) -> int:
        return sum(len(run[0]) for run in self.runs)

    def find(self, mix: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each chunk; the number is -1 for one that isn't known."""
        first, sizes = np.zeros(len(mix), np.int64), np.full(len(mix), -1)
        for keys, lows, highs, firsts, counts in self.runs:
            at = np.minimum(np.searchsorted(keys, mix), len(keys) - 1)
            same = (keys[at] == mix) & (lows[at] == low) & (highs[at] == high)
            first[same], sizes[same] = firsts[at[same]], counts[at[same]]
        return first, sizes

    def add(self, mix: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate((self.ids, ids))
        run = (mix, low, high, first, sizes)
        while self.runs and len(self.runs[-1][0]) <= max(MERGED, 2 * len(run[0])):
            run = tuple(np.concatenate(pair) for pair in zip(self.runs.pop(), run))
        order = np.argsort(run[0], kind="stable")
        self.runs.append(tuple(column[order] for column in run))


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.between, self.between_id = max(added.items(), key=lambda t: t[1]) if added else ("", -1)
        rules = json.loads(self.tokenizer.to_str())
        split = json.dumps(rules["pre_tokenizer"])
        self.by_word = '"Lowercase"' in json.dumps(rules["normalizer"]) and r"[\\p{L}]+" in split and r"[^\\s\\p{L}\\p{N}]+" in split
        # Lower-case ASCII words need neither normalising nor splitting.
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.words_only = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": bytewise})) if self.by_word else None
        self.pieces, self.chunks, self.packed = _Cache(self._piece_ids), _Cache(self._chunk_ids), _Packed()

    def _runs(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces are one text for the library, with a special token, which nothing is merged with, between them."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        runs = [self.between.join(pieces[i : i + RUN_PIECES]) for i in range(0, len(pieces), RUN_PIECES)]
        for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            run = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(run == self.between_id)
            sizes.append(np.diff(np.concatenate(([-1], marks, [len(run)]))) - 1)
            flat.append(np.delete(run, marks))
        return np.concatenate(flat), np.concatenate(sizes)

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        where: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, c in enumerate(pieces):
            kind = 2 if self.between in c else 0 if self.by_word and c.isascii() and c.isalpha() and c.islower() else 1
            kinds[kind].append(c)
            where[kind].append(i)
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(kinds[2], add_special_tokens=False)]
        found = [
            self._runs(self.words_only, kinds[0]), self._runs(self.tokenizer, kinds[1]),
            (np.array([i for ids in alone for i in ids], np.uint32), np.array([len(ids) for ids in alone], np.int64)),
        ]
        # back to the order of the pieces
        ids, sizes = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(np.concatenate([np.array(w, np.int64) for w in where]))
        first = np.cumsum(sizes) - sizes
        owner, at = expand(first[order], sizes[order])
        return ids[at], sizes[order]

    def _split(self, chunk: str) -> tuple[str, str]:
        """A word of ASCII letters and the marks at its end; anything else stays whole."""
        if self.by_word and chunk.isascii():
            stem = chunk.rstrip(_END_MARKS)
            if stem.isalpha():
                return stem.lower(), chunk[len(stem) :]
        return chunk, ""

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.pieces.get([p for c in chunks for p in self._split(c)])
        return ids, sizes.reshape(-1, 2).sum(1)

    def _short(self, halves: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id, in the table of packed chunks, and number of ids of each chunk of up to ``PACKED`` bytes."""
        low, high = halves[:, 0], halves[:, 1]
        mix = mixed(mixed(low) + high)
        order = np.argsort(mix, kind="stable")
        turn = np.ones(len(order), bool)
        turn[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        heads = order[turn]
        first, sizes = self.packed.find(mix[heads], low[heads], high[heads])
        if (sizes < 0).any():
            if self.packed.held() + int((sizes < 0).sum()) > KEPT_CHUNKS:
                self.packed.clear()
                sizes[:] = -1
            unseen = heads[sizes < 0]
            raw = data.tobytes()
            words = [raw[i:j].decode() for i, j in zip(start[unseen].tolist(), end[unseen].tolist())]
            ids, amount = self._chunk_ids(words)
            self.packed.add(mix[unseen], low[unseen], high[unseen], ids, amount)
            first, sizes = self.packed.find(mix[heads], low[heads], high[heads])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(turn) - 1
        return first[group], sizes[group]

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each; a null text is an empty one."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, offsets = text_bytes(column)
        words = find_words(data, offsets, _PLAIN_SPACE)
        length = words.end - words.start
        short = length <= PACKED
        zeros = np.flatnonzero(data == 0)
        if len(zeros):
            short[np.maximum(np.searchsorted(words.start, zeros, side="right") - 1, 0)] = False
        start, end = words.start[short], words.end[short]
        padded = np.concatenate((data, np.zeros(PACKED, np.uint8)))
        window = np.lib.stride_tricks.sliding_window_view(padded, PACKED)[start]
        packed = np.where(np.arange(PACKED) < length[short][:, None], window, 0).astype(np.uint8)
        halves = packed.view(np.uint64).reshape(len(start), 2)
        first, sizes = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        if len(start):
            first[short], sizes[short] = self._short(halves, data, start, end)
        table = self.packed.ids
        if not short.all():
            long_ = np.flatnonzero(~short)
            raw = [data[i:j].tobytes().decode() for i, j in zip(words.start[long_].tolist(), words.end[long_].tolist())]
            ids, amount = self.chunks.get(raw)
            first[long_], sizes[long_] = len(table) + np.cumsum(amount) - amount, amount
            table = np.concatenate((table, ids))
        _, at = expand(first, sizes)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return table[at], np.diff(upto[words.first])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
