"""Routing of repeated passages: which stretches of which texts have to be searched together.

Two operators look for spans of ``span`` units (bytes or words) that occur more than once. An index over all texts can't be
searched by all texts, as that work grows with the square of the corpus. Instead each text marks anchors: grams of ``gram``
units whose hash is the smallest of ``span - gram + 1`` consecutive ones. Every span holds an anchor at a place that follows
from the span's content alone, so equal spans hold equal anchors at equal places. An anchor's segment is the stretch of
text that all spans around it can reach. Only segments of equal anchors have to meet, and only anchors that occur more
than once have segments at all. Segments that read the same are one row with a count and the smallest id before they are sent.

An operator's shard is a set of anchors; it holds all distinct segments of its anchors, with their counts and ids, and searches
each of them, so that nothing is covered but what a search has found. A segment is given as its units
left of the gram, one symbol for the gram, and those right of it; a span of a text is a window of ``span - gram + 1``
symbols there, and as it holds the gram's symbol, windows match only where they stand alike around the same gram.

An anchor whose distinct segments are more than one block of a shard, such as the border of a passage that a third of all
texts hold, isn't given to one task: its windows are hashed, and counted by a distributed aggregate with map-side sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from transit_spark.llm import text as tx
from transit_spark.llm.skew import spread
from transit_spark.session import materialise

BLOCK_SYMBOLS = 1 << 20
SHARD_SEGMENTS = 1 << 14


@dataclass(frozen=True)
class Spans:
    """``bytewise``: units are bytes, else words between white space."""

    bytewise: bool
    span: int
    gram: int
    block: int = BLOCK_SYMBOLS

    @property
    def most_segments(self) -> int:
        """Distinct segments of one anchor that a block can hold."""
        return self.block // (2 * self.reach + 2)

    @property
    def reach(self) -> int:
        """Units that a span can have on one side of its gram."""
        return self.span - self.gram

    def units(self, data: np.ndarray, offsets: np.ndarray):
        """Codes of all units, the first unit of each text, and where units begin and end in ``data``."""
        if self.bytewise:
            at = np.arange(len(data) + 1)
            return data.astype(np.uint64), offsets, at[:-1], at[1:]
        words = tx.find_words(data, offsets, tx.WHITE_SPACE)
        return tx.word_hashes(data, words), words.first, words.start, words.end


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, text, carried). Rows that share an id and a text share a key and get the same result.

    carried: all columns but the text, as they were.
    """
    text = F.col(text_col)
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"), carried.alias("carried"))


ANCHOR = "id bigint, row_key bigint, key bigint, seg bigint, at int, left int, right int"


def anchors(rows: DataFrame, kind: Spans) -> DataFrame:
    """One row for each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_bytes(batch.column("text"))
            ids, row_keys = batch.column("id"), batch.column("row_key")
            for i, j in tx.runs(offsets):
                codes, first, _, _ = kind.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.diff(first)
                grams = tx.gram_hashes(codes, kind.gram)
                at = tx.window_minima(grams, first[:-1], np.maximum(counts - kind.gram + 1, 0), kind.reach + 1) if len(grams) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, at, side="right") - 1
                begin, end = np.maximum(first[doc], at - kind.reach), np.minimum(first[doc + 1], at + kind.span)
                seg = tx.span_hashes(tx.prefix_sums(codes, 1), begin, end, 1) + (at - begin).astype(np.uint64)
                where = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(where), row_keys.take(where), pa.array(tx.signed(grams[at])), pa.array(tx.signed(seg)),
                     pa.array((at - first[doc]).astype(np.int32)), pa.array((at - begin).astype(np.int32)),
                     pa.array((end - at - kind.gram).astype(np.int32))],
                    ["id", "row_key", "key", "seg", "at", "left", "right"],
                )

    return rows.select("id", "row_key", "text").mapInArrow(lambda batches: tx.released(run(batches)), ANCHOR)


SEGMENT = "key bigint, seg bigint, n bigint, least bigint, asked boolean, copied boolean, left int, hot boolean, body binary"


SEGMENT_COLUMNS = ["key", "seg", "n", "least", "asked", "copied", "left", "hot"]


def _bodies(rows: DataFrame, wanted: DataFrame, kind: Spans) -> DataFrame:
    """The units of each wanted segment (id, row_key, at, left, right, ...), as codes of 8 bytes or plain bytes."""
    per_doc = wanted.groupBy(F.col("id").alias("w_id"), F.col("row_key").alias("w_key")).agg(
        F.collect_list(F.struct("key", "seg", "n", "least", "asked", "copied", "at", "left", "right", "hot")).alias("wanted")
    ).hint("shuffle_hash")
    rows = rows.select("id", "row_key", "text")
    texts = rows.join(per_doc, rows["id"].eqNullSafe(per_doc["w_id"]) & (rows["row_key"] == per_doc["w_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            inner, upto = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for i, j in tx.runs(offsets):
                codes, first, _, _ = kind.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                codes = codes.astype(np.uint8) if kind.bytewise else codes
                part = inner.slice(int(upto[i]), int(upto[j] - upto[i]))
                get = {f.name: part.field(f.name) for f in part.type}
                at = np.repeat(first[: j - i], np.diff(upto[i : j + 1])) + get["at"].to_numpy()
                left, right = get["left"].to_numpy(), get["right"].to_numpy()
                body = [
                    codes[p - a : p].tobytes() + codes[p + kind.gram : p + kind.gram + b].tobytes()
                    for p, a, b in zip(at.tolist(), left.tolist(), right.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(get[c] for c in SEGMENT_COLUMNS), pa.array(body, pa.binary())], [*SEGMENT_COLUMNS, "body"],
                )

    return texts.select("text", "wanted").mapInArrow(lambda batches: tx.released(run(batches)), SEGMENT)


@dataclass
class Block:
    """Distinct segments of some anchors. Symbols: units as dense codes from 0, then one symbol for each anchor."""

    symbols: np.ndarray
    first: np.ndarray
    count: np.ndarray  # how many texts' segments read like this one
    least: np.ndarray  # the smallest id of these
    asked: np.ndarray  # whether its row of the smallest id is searched for
    copied: np.ndarray  # whether there are rows of other ids
    alphabet: int


#: Of each segment, the first and last window that match; with the rows that this holds for: those of the segment's
#: smallest id (or all, where ids don't matter), or, marked True, those of its other ids.
Search = Callable[[Block], list[tuple[bool, np.ndarray, np.ndarray]]]


def _codes(body: pa.Array, kind: Spans) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tx.text_bytes(body)
    if kind.bytewise:
        return data, offsets
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def _block(table: pa.Table, kind: Spans) -> Block:
    codes, offsets = _codes(table.column("body").combine_chunks(), kind)
    if kind.bytewise:
        dense = (np.cumsum(np.bincount(codes, minlength=256) > 0) - 1)[codes]
    else:
        _, dense = np.unique(codes, return_inverse=True)
    keys, group = np.unique(table.column("key").to_numpy(), return_inverse=True)
    size = int(dense.max()) + 1 if len(dense) else 0
    at = offsets[:-1] + table.column("left").to_numpy()
    symbols = np.insert(dense.astype(np.int64), at, size + group)
    least = table.column("least").fill_null(np.iinfo(np.int64).max).to_numpy()
    counts, asked, copied = (table.column(c).to_numpy() for c in ("n", "asked", "copied"))
    return Block(symbols, offsets + np.arange(len(offsets)), counts, least, asked, copied, size + len(keys))


COVER = "key bigint, seg bigint, least bigint, later boolean, begin int, finish int"


def _covers(table: pa.Table, kind: Spans, search: Search) -> Iterator[pa.RecordBatch]:
    """Of each segment of a block, the first and last window that match, as units around the anchor."""
    for later, low, high in search(_block(table, kind)):
        found = low <= high
        left = table.column("left").to_numpy()[found]
        yield pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks().filter(pa.array(found)) for c in ("key", "seg", "least")), pa.array(np.full(len(left), later)),
             pa.array((low[found] - left).astype(np.int32)), pa.array((high[found] - left + kind.span).astype(np.int32))],
            ["key", "seg", "least", "later", "begin", "finish"],
        )


def _shards(segments: DataFrame, kind: Spans, search: Search, tasks: int) -> DataFrame:
    """Searches the segments of each shard, a block of whole anchors at a time."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: pa.Table | None = None
        unit = 1 if kind.bytewise else 8
        for batch in batches:
            rest = pa.Table.from_batches([batch])
            held = rest if held is None else pa.concat_tables([held, rest]).combine_chunks()
            while held.num_rows:
                keys = held.column("key").to_numpy()
                size = np.cumsum(np.diff(tx.text_bytes(held.column("body").combine_chunks())[1]) // unit + 2)
                cut = int(np.searchsorted(size, kind.block))
                if cut >= held.num_rows:
                    break
                same = np.flatnonzero(keys != keys[cut])
                before, after = same[same < cut], same[same > cut]
                if len(before):
                    cut = int(before[-1]) + 1
                elif len(after):
                    cut = int(after[0])
                else:
                    break
                yield held.slice(0, cut)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            yield from _covers(table.combine_chunks(), kind, search)

    return segments.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda batches: tx.released(run(batches)), COVER)


def _hot(segments: DataFrame, kind: Spans, by_id: bool) -> DataFrame:
    """The same as a search, for anchors with very many segments: counts windows by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                codes, offsets = _codes(part.column("body"), kind)
                left = part.column("left").to_numpy()
                sums = tx.prefix_sums(codes.astype(np.uint64), 1)
                counts = np.maximum(np.diff(offsets) - kind.reach + 1, 0)
                owner, start = tx.expand(offsets[:-1], counts)
                shift = (start - offsets[:-1][owner] - left[owner]).astype(np.int32)
                h = tx.span_hashes(sums, start, start + kind.reach, 1)
                where = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(where) for c in names] + [pa.array(shift), pa.array(tx.signed(h))], [*names, "shift", "h"]
                )

    names = ["key", "seg", "n", "least", "copied"]
    schema = "key bigint, seg bigint, n bigint, least bigint, copied boolean, shift int, h bigint"
    windows = segments.mapInArrow(lambda batches: tx.released(run(batches)), schema)
    counted = windows.groupBy("key", "shift", "h").agg(F.sum("n").alias("all"), F.min("least").alias("lowest")).where("all > 1")
    hit = windows.join(counted, ["key", "shift", "h"])
    if by_id:
        own, others = F.when(F.col("lowest") < F.col("least"), False), F.when(F.col("copied"), True)
        hit = hit.withColumn("later", F.explode(F.array_compact(F.array(own, others))))
    else:
        hit = hit.withColumn("later", F.lit(False))
    return hit.groupBy("key", "seg", "least", "later").agg(
        F.min("shift").cast("int").alias("begin"), (F.max("shift") + kind.span).cast("int").alias("finish")
    )


def covered(rows: DataFrame, kind: Spans, search: Search, by_id: bool) -> DataFrame:
    """(id, row_key, spans): the stretches of each text that repeated spans cover.

    ``by_id``: a span counts where a text with a smaller id holds it too; else wherever it occurs more than once.
    """
    every = materialise(anchors(rows, kind), "anchors")
    if by_id:
        every = every.where("id IS NOT NULL")
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    # Stored, so that both sides of the join are dealt anew and a frequent anchor's rows can be split among tasks.
    keys = materialise(keys.where("lo < hi" if by_id else "n > 1").select("key"), "shared-keys")
    shared = materialise(every.join(keys, "key", "left_semi"), "shared-anchors")
    place = F.struct("id", "row_key", "at", "left", "right")
    segments = materialise(
        shared.groupBy("key", "seg").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), (F.max("id") > F.min("id")).alias("copied"), F.min(place).alias("place")
        ),
        "segments",
    )
    groups = segments.groupBy("key").agg(F.min("least").alias("lowest"), (F.count(F.lit(1)) > kind.most_segments).alias("hot"))
    asked = F.col("least") > F.col("lowest") if by_id else F.lit(True)
    wanted = segments.join(groups, "key").select("place.*", "key", "seg", "n", "least", asked.alias("asked"), "copied", "hot")
    bodies = materialise(_bodies(rows, wanted.withColumn("copied", F.coalesce("copied", F.lit(False))), kind), "segment-bodies")
    cold = bodies.where("NOT hot").drop("hot")
    found = _shards(cold, kind, search, max(1, -(-bodies.count() // SHARD_SEGMENTS)))
    found = materialise(found.unionByName(_hot(bodies.where("hot"), kind, by_id)), "found")
    # A segment's hash covers its gram, so it names the anchor too. Rows of a common segment are dealt to several tasks.
    dealt, covers = spread(shared, found, segments.select("seg", "n"), "seg", "id")
    role = (F.col("id") > F.col("least")) == F.col("later") if by_id else F.lit(True)
    spans = dealt.join(covers, ["key", "seg", "salt"]).where(role).select(
        "id", "row_key", F.struct((F.col("at") + F.col("begin")).alias("a"), (F.col("at") + F.col("finish")).alias("b")).alias("s")
    )
    return spans.groupBy("id", "row_key").agg(F.collect_set("s").alias("spans"))


def removed(rows: DataFrame, kind: Spans, search: Search, by_id: bool) -> DataFrame:
    """(id, n_units, n_removed, n_spans, kept, carried) of each row; kept: what is left, words joined by one space."""
    spans = covered(rows, kind, search, by_id)
    spans = spans.select(F.col("id").alias("s_id"), F.col("row_key").alias("s_key"), "spans").hint("shuffle_hash")
    marked = rows.join(spans, rows["id"].eqNullSafe(spans["s_id"]) & (rows["row_key"] == spans["s_key"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_bytes(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for d, found in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[d] : offsets[d + 1]].tobytes()
                units = raw if kind.bytewise else raw.split()
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for m in merged for x in m), len(units)]
                kept = [units[a:b] for a, b in zip(edges[::2], edges[1::2])]
                out[0].append(len(units))
                out[1].append(sum(b - a for a, b in merged))
                out[2].append(len(merged))
                out[3].append(b"".join(kept) if kind.bytewise else b" ".join(w for k in kept for w in k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), batch.column("carried")],
                ["id", "n_units", "n_removed", "n_spans", "kept", "carried"],
            )

    numbers = [StructField(c, LongType()) for c in ("id", "n_units", "n_removed", "n_spans")]
    schema = StructType([*numbers, StructField("kept", BinaryType()), rows.schema["carried"]])
    return marked.select("id", "text", "spans", "carried").mapInArrow(lambda batches: tx.released(run(batches)), schema)
