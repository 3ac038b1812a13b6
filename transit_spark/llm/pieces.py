"""Piece encoding and decoding with sampled segmentations: Gumbel top-k without replacement by perturbed A-star search.

The vocabulary is a SentencePiece file, whose path is a parameter. Its merge ranks give each piece a log-weight of
``-log(2 + rank)``; a character that is no piece is its UTF-8 bytes, each with the weight of the last rank. A segmentation's
probability is proportional to the product of its pieces' weights. As no piece has a space after another character, a
text's lattice is a chain of the lattices of its chunks: spaces and the characters that follow them.

Sums over the rest of a chunk (backward) turn edge weights into exact probabilities of the next piece. The search goes
over prefixes of segmentations, best perturbed log-probability first. A prefix's children share its Gumbel value as their
maximum, so the child that inherits it is drawn by probability, and the best of the other children follows from one
truncated Gumbel. A prefix that is taken from the agenda is completed at once down to a whole segmentation, which is the next
sample; what was passed by on the way goes to the agenda, best ones only, as no more than are still to be drawn can matter.
The best value left on the agenda is the threshold of the inclusion scores: a sample with log-probability q is included
with probability 1 - exp(-exp(q - threshold)), whose logarithm is returned.

All numbers drawn are hashes of the row's key and the place in the text, so a repeated task gives the same rows. Texts of a run
are completed together, vectorised; only the agenda is kept text by text.

Defined cases: a null or empty text has one segmentation, without pieces. A text with fewer segmentations than asked for gives
them all, each with a log-inclusion of 0 if nothing is left on the agenda. As in the library, a space is kept as U+2581 in
pieces, so a text's own U+2581 is decoded as a space. Rows that repeat id and text draw the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from transit_spark.llm import text as tx

SAMPLES = 2
SEED = 42
RUN_BYTES = 3 << 17
SPACE = "▁"
SLOT_BITS = 20
WIDTHS = np.repeat([1, 2, 3, 4], [0x80, 0x60, 0x10, 0x10])  # bytes of a character, by its first one


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, np.int64)
        weight = np.zeros(size)
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        for rank, i in enumerate(normal):
            self.raw[i] = sp.id_to_piece(i).encode()
            weight[i] = -np.log(2 + rank)
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.raw[i], weight[i] = i, bytes([value]), -np.log(2 + len(normal))
        self.weight, self.byte_weight = weight, -np.log(2 + len(normal))
        # All beginnings of pieces by hash, and the piece that each is, if it is one.
        whole = {self.raw[i]: i for i in normal}
        starts = list({r[:n] for r in whole for n in range(1, len(r) + 1)})
        size = np.array([len(r) for r in starts], np.int64)
        end = np.cumsum(size)
        flat = np.frombuffer(b"".join(starts), np.uint8).astype(np.uint64)
        self.keys = np.append(tx.span_hashes(tx.prefix_sums(flat), end - size, end), np.uint64(0))
        self.piece_at = np.array([whole.get(r, -1) for r in starts], np.int32)
        self.longest = int(size.max())
        self.slots, left = [], np.arange(len(starts), dtype=np.int32)
        while len(left):  # what loses its slot to another beginning gets one in the next table
            table = np.full(1 << SLOT_BITS, len(starts), np.int32)
            slot = self._slot(self.keys[left], len(self.slots))
            table[slot] = left
            self.slots.append(table)
            left = left[table[slot] != left]
        # decoding: pieces' bytes with spaces put back
        shown = [p.replace(SPACE.encode(), b" ") for p in self.raw]
        self.shown_sizes = np.array([len(p) for p in shown])
        self.shown_first = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - SLOT_BITS - 9 * level)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the beginning with each hash, or -1."""
        found = self.slots[0][self._slot(keys, 0)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        for level in range(1, len(self.slots)):
            found[wrong] = self.slots[level][self._slot(keys[wrong], level)]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        found[wrong] = -1
        return found

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of the pieces of texts that end at ``ends``, without the space that encoding puts before a text."""
        sizes = self.shown_sizes[ids]
        _, at = tx.expand(self.shown_first[ids], sizes)
        raw, upto = self.shown[at].tobytes(), np.concatenate(([0], np.cumsum(sizes)))[ends].tolist()
        return [raw[a + raw.startswith(b" ", a, b) : b] for a, b in zip([0, *upto[:-1]], upto)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([len(ids)]))[0]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


@dataclass
class Lattice:
    """Lattices of distinct chunks. A node is a byte position or an end; a node's edges stand together, long pieces first."""

    start: np.ndarray  # first node of each chunk
    final: np.ndarray  # whether a node is its chunk's end
    first: np.ndarray  # first edge of each node, and the end of its edges
    last: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray  # id, or -1 for the bytes of a character
    log_p: np.ndarray  # of the edge, given its node
    upto: np.ndarray  # sum of the probabilities of the node's edges so far
    data: np.ndarray  # byte at each node


def lattice(chunks: list[bytes], voc: Vocabulary) -> Lattice:
    sizes = np.array([len(c) for c in chunks], np.int64)
    raw = np.frombuffer(b"\0".join(chunks) + b"\0", np.uint8)  # an end node after each chunk
    start = np.cumsum(sizes + 1) - sizes - 1
    left = np.repeat(start + sizes, sizes + 1) - np.arange(len(raw))  # bytes up to the chunk's end
    head = (raw & 0xC0 != 0x80) & (left > 0)
    sums = tx.prefix_sums(raw.astype(np.uint64))
    lengths, sources, pieces = [], [], []
    degree = np.zeros(len(raw), np.int32)
    single = np.zeros(len(raw), bool)
    width = WIDTHS[raw]
    at = np.flatnonzero(head)
    base, up, room = sums[at], tx.powers(len(raw))[at], left[at]
    for n in range(1, voc.longest + 1):
        i = voc.find(tx.mixed((sums[at + n] - base) * up + np.uint64(n)))
        on = i >= 0
        at, i = at[on], voc.piece_at[i[on]]
        hit = i >= 0
        s = at[hit]
        lengths.append(n)
        sources.append(s)
        pieces.append(i[hit])
        degree[s] += 1
        if n <= 4:
            single[s[width[s] == n]] = True
        base, up, room = base[on], up[on], room[on]
        longer = room > n
        at, base, up, room = at[longer], base[longer], up[longer], room[longer]
        if not len(at):
            break
    rest = np.flatnonzero(head & ~single)
    degree[rest] += 1
    # Nodes near their chunk's end first; each one's edges by falling length, then the bytes of a character that is no piece.
    nodes = np.flatnonzero(head)
    distance = left[nodes]
    order = np.argsort(distance.astype(np.min_scalar_type(int(distance.max(initial=0)))), kind="stable")
    nodes, distance = nodes[order], distance[order]
    counts = degree[nodes].astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    starts = bounds[:-1]
    source, target, piece = (np.empty(bounds[-1], np.int32) for _ in range(3))
    slot = np.zeros(len(raw), np.int64)
    slot[nodes] = starts
    for n, s, i in zip(lengths[::-1], sources[::-1], pieces[::-1]):
        to = slot[s]
        slot[s] += 1
        source[to], target[to], piece[to] = s, s + n, i
    to = slot[rest]
    source[to], target[to], piece[to] = rest, np.minimum(rest + width[rest], rest + left[rest]), -1
    weight = voc.weight[piece]
    weight[to] = voc.byte_weight * (target[to] - source[to])
    # log of the summed weights from each node to its chunk's end
    beta = np.where(left == 0, 0.0, -np.inf)
    levels = np.flatnonzero(np.concatenate(([True], distance[1:] != distance[:-1]))) if len(nodes) else nodes
    for a, b in zip(levels.tolist(), [*levels[1:].tolist(), len(starts)]):
        x, y = bounds[a], bounds[b]
        inner = starts[a:b] - x
        value = weight[x:y] + beta[target[x:y]]
        top = np.maximum.reduceat(value, inner)
        beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts[a:b])), inner))
    log_p = np.minimum(weight + beta[target] - beta[source], 0.0)
    first, last = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    first[nodes], last[nodes] = starts, bounds[1:]
    upto = np.exp(log_p)
    at, k = starts[counts > 1], 1
    while len(at):  # sums within nodes, so that they don't depend on what else is in the run
        upto[at + k] += upto[at + k - 1]
        k += 1
        at = at[last[source[at]] - at > k]
    upto[bounds[1:] - 1] = 1.0  # exact at each node's last edge
    return Lattice(start, left == 0, first, last, source, target, piece, log_p, upto, raw)


def uniform(seed: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from a row's seed, a place in its text and the number of the stream."""
    h = tx.mixed(tx.mixed(seed + np.uint64(stream * 0x9E3779B97F4A7C15 % (1 << 64))) + place.astype(np.uint64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def truncated(mu, top, u):
    """A Gumbel value with location mu, given that it is at most top."""
    with np.errstate(over="ignore", divide="ignore"):
        return mu - np.log(np.exp(mu - top) - np.log(u))


def completed(lat: Lattice, chunk: np.ndarray, node: np.ndarray, seed: np.ndarray, place: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws edges from each node to its chunk's end: edges in order, and how many of each chunk."""
    n = len(node)
    counts = np.zeros(n, np.int64)
    active, at, rounds = np.flatnonzero(~lat.final[node]), node[~lat.final[node]], []
    while len(active):
        u = uniform(seed[active], (place[active] << 16) + counts[active], stream)
        edge = lat.first[at]
        on = np.flatnonzero(lat.upto[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[lat.upto[edge[on]] < u[on]]
        rounds.append((active, edge))
        counts[active] += 1
        at = lat.target[edge]
        on = ~lat.final[at]
        active, at = active[on], at[on]
    first = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for depth, (who, edge) in enumerate(rounds):
        edges[first[who] + depth] = edge
    return edges, counts


@dataclass
class Path:
    edges: np.ndarray
    occurrence: np.ndarray  # chunk of the text that each edge is in
    log_p: float
    value: float


def samples_of(lat: Lattice, chunk: np.ndarray, first: np.ndarray, seeds: np.ndarray, k: int) -> tuple[list[list[Path]], np.ndarray]:
    """For each text, up to k distinct segmentations in falling perturbed order, and the threshold after them.

    ``chunk``: the distinct chunk at each place of the texts; ``first``: each text's first place.
    """
    n = len(first) - 1
    paths: list[list[Path]] = [[] for _ in range(n)]
    agenda: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
    threshold = np.full(n, -np.inf)
    value = -np.log(-np.log(uniform(seeds, np.zeros(n, np.int64), 0)))
    begin_place, begin_node = first[:-1].copy(), None
    prefix = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)] * n
    docs = np.arange(n)
    for r in range(k):
        # whole segmentations from here on
        sizes = first[docs + 1] - begin_place[docs]
        owner, place = tx.expand(begin_place[docs], sizes)
        doc = docs[owner]
        node = lat.start[chunk[place]] if len(place) else np.zeros(0, np.int64)
        if begin_node is not None:
            inside = sizes > 0
            node[(np.cumsum(sizes) - sizes)[inside]] = begin_node[docs[inside]]
        relative = place - first[doc]
        edges, counts = completed(lat, chunk[place] if len(place) else node, node, seeds[doc], relative, 2 * r + 1)
        upto = np.concatenate(([0], np.cumsum(counts)))
        ends = upto[np.concatenate(([0], np.cumsum(sizes)))]
        where = np.repeat(relative, counts)
        log_p = lat.log_p[edges]
        step_doc = np.repeat(np.arange(len(docs)), np.diff(ends))
        total = np.empty(len(log_p))
        for d, a, b in zip(docs.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            np.cumsum(log_p[a:b], out=total[a:b])
            total[a:b] += prefix[d][2]
        before = total - log_p
        with np.errstate(divide="ignore"):
            mu = before + np.log(-np.expm1(np.minimum(log_p, 0.0)))
        leaving = lat.source[edges]
        several = lat.last[leaving] - lat.first[leaving] > 1
        index = np.arange(len(edges)) - ends[:-1][step_doc]
        rest = np.where(several & np.isfinite(mu), truncated(mu, value[docs][step_doc], uniform(seeds[docs][step_doc], index, 2 * r + 2)), -np.inf)
        more = k - r
        for x, d in enumerate(docs.tolist()):
            a, b = int(ends[x]), int(ends[x + 1])
            old_edges, old_where, phi = prefix[d]
            path = Path(np.concatenate((old_edges, edges[a:b])), np.concatenate((old_where, where[a:b])), float(total[b - 1]) if b > a else phi, float(value[d]))
            mine = rest[a:b]
            best = np.argpartition(-mine, more - 1)[:more] if len(mine) > more else np.arange(len(mine))
            for s in best.tolist():
                if mine[s] > -np.inf:
                    agenda[d].append((float(mine[s]), len(paths[d]), len(old_edges) + s, (int(edges[a + s]),)))
            paths[d].append(path)
        on = [d for d in docs.tolist() if agenda[d]]
        if r == k - 1:
            for d in on:
                threshold[d] = max(agenda[d])[0]
            break
        begin_node = np.zeros(n, np.int64)
        taken_up = []
        for d in on:
            agenda[d].sort(reverse=True)
            taken_up.append(agenda[d].pop(0))
        steps = np.array([step for _, _, step, _ in taken_up], np.int64)
        drawn, others = (uniform(seeds[on], steps, stream + 3 * r).tolist() if on else [] for stream in (1000, 1001))
        for d, (top, source, step, taken), u, v in zip(on, taken_up, drawn, others):
            parent = paths[d][source]
            node_ = int(lat.source[parent.edges[step]])
            options = [e for e in range(int(lat.first[node_]), int(lat.last[node_])) if e not in taken]
            phi = float(lat.log_p[parent.edges[:step]].sum())
            p = np.exp(lat.log_p[options])
            pick = options[min(int(np.searchsorted(np.cumsum(p), u * p.sum())), len(options) - 1)]
            left = [e for e in options if e != pick]
            if left:
                mass = float(np.exp(lat.log_p[left]).sum())
                if mass > 0:
                    agenda[d].append((float(truncated(phi + np.log(mass), top, v)), source, step, (*taken, pick)))
            value[d] = top
            inside = int(parent.occurrence[step])
            prefix[d] = (np.append(parent.edges[:step], pick), parent.occurrence[: step + 1], phi + float(lat.log_p[pick]))
            begin_place[d], begin_node[d] = first[d] + inside, lat.target[pick]
        docs = np.array(on, np.int64)
        if not len(docs):
            break
    return paths, threshold


def ids_of(lat: Lattice, voc: Vocabulary, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all edges, and how many each edge has: the bytes of a character that is no piece have one each."""
    piece, node = lat.piece[edges], lat.source[edges]
    sizes = np.where(piece < 0, lat.target[edges] - node, 1).astype(np.int64)
    if (piece >= 0).all():
        return piece, sizes
    owner, at = tx.expand(node.astype(np.int64), sizes)
    return np.where((piece < 0)[owner], voc.byte_ids[lat.data[np.minimum(at, len(lat.data) - 1)]], piece[owner]), sizes


def chunks_of(text: str) -> list[str]:
    """Spaces and the characters after them; the first of a chunk's spaces is left out, as each chunk has one.

    The first chunk's is the one that encoding puts before the text.
    """
    if not text:
        return []
    parts = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts[:-1]:
        if part:
            out.append(SPACE * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return [*out, SPACE * spaces + parts[-1]]


SCHEMA = "sample int, n_pieces bigint, log_prob double, log_inclusion double, ids binary, round_trip boolean"
FIELDS = [("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64()), ("ids", pa.binary()), ("round_trip", pa.bool_())]


def encoded(docs: DataFrame, path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, sample, n_pieces, log_prob, log_inclusion, ids, round_trip): up to k rows for each row of ``docs``.

    ids: unsigned 32-bit little-endian; round_trip: whether they decode to the text.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            _, offsets = tx.text_bytes(batch.column("text"))
            for i, j in tx.runs(offsets, RUN_BYTES):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                seeds = batch.column("key").slice(i, j - i).to_numpy().view(np.uint64)
                split = [chunks_of(t) for t in texts]
                first = np.cumsum([0, *map(len, split)])
                flat = [c for cs in split for c in cs]
                known = {c: n for n, c in enumerate(dict.fromkeys(flat))}
                chunk = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                lat = lattice([(SPACE + c).encode() for c in known], voc)
                paths, threshold = samples_of(lat, chunk, first, seeds, k)
                flat = [p for found in paths for p in found]
                owners = np.repeat(np.arange(len(paths)), [len(found) for found in paths])
                edges = np.concatenate([np.zeros(0, np.int64), *(p.edges for p in flat)])
                ids, sizes = ids_of(lat, voc, edges)
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(p.edges) for p in flat], dtype=np.int64)]
                plain = [t.replace(SPACE, " ").encode() if SPACE in t else t.encode() for t in texts]
                same = [raw == plain[d] for d, raw in zip(owners.tolist(), voc.decode_all(ids, ends))]
                over = np.array([p.log_p for p in flat]) - threshold[owners]
                with np.errstate(over="ignore", divide="ignore"):
                    inclusion = np.where(over < -30, over, np.log(-np.expm1(-np.exp(np.clip(over, -30, 700)))))
                coded = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(flat), [None, pa.py_buffer(np.concatenate(([0], ends * 4))), pa.py_buffer(ids.astype("<u4"))]
                ).cast(pa.binary())
                out = [
                    np.concatenate([np.zeros(0, np.int32), *(np.arange(1, len(f) + 1, dtype=np.int32) for f in paths)]),
                    np.diff(ends, prepend=0), np.array([p.log_p for p in flat]), inclusion, coded, same,
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(i + owners, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(out, FIELDS))],
                    ["id", *(name for name, _ in FIELDS)],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda batches: tx.released(run(batches)), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` but the ids, and the text that they stand for; bytes that are no UTF-8 become U+FFFD."""
    names = rows.columns
    keep = [f for f in rows.schema.fields if f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            ids = batch.column(names.index(ids_col)).to_pylist()
            texts = [None if b is None else voc.decode(np.frombuffer(b, "<u4").astype(np.int64)).decode("utf-8", "replace") for b in ids]
            kept = [batch.column(names.index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*(f.name for f in keep), "decoded"])

    return rows.mapInArrow(lambda batches: tx.released(run(batches)), StructType([*keep, StructField("decoded", StringType())]))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "sample", "n_pieces", F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"),
        F.crc32("ids").alias("ids_crc32"), "round_trip",
    )
