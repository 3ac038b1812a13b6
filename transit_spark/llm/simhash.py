"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint takes the XXH64 hashes of a text's 4-word shingles, repeats included, and sets a bit that is set in over
half of them. Two fingerprints that differ in at most ``RADIUS`` bits share a variant: a value within half the radius of
both. Every distinct fingerprint emits all its variants; equal variants meet, the fingerprints behind them are compared,
and what differs in no more than ``RADIUS`` bits is linked.

The variants travel factored. A variant is a prefix of ``PREFIX_BITS`` and a suffix, and its flipped bits are split among
the two; a fingerprint is sent once to each prefix within half the radius of its own (137 of them for 16 bits), and the
task that owns the prefix expands the suffixes within what is left of the half radius. All 2,081 variants of a
fingerprint are compared, but 137 rows are shuffled. All fingerprints behind one variant lie within the radius of each
other, so linking each to the first of them loses nothing, and no task makes pairs within a group.

A prefix with more than a task's share of variants or rows is cut by the suffix bits that halve it best: its fingerprints go to each
value of these bits within what is left of the half radius, and are dealt by prefix and value. A task expands what it has of
one prefix in pieces of bounded size, cut the same way.

Equal fingerprints are one row before the ball is made. Links of one task are folded to a spanning forest before they
leave it.

Defined cases: a text without words, also a null one, has fingerprint zero and is linked like any other. Rows that repeat
an id stay rows. A null id is no component's smallest id; a component of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.components import components
from transit_spark.session import materialise

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
PREFIX_BITS = 16
ROWS_PER_TASK = 1 << 19
VARIANTS_AT_ONCE = 1 << 21
VARIANTS_PER_TASK = 1 << 23  # about what ROWS_PER_TASK rows have; a prefix with more is cut
MOST_CUTS = 16
LINKS_AT_ONCE = 1 << 20


def fingerprint(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of the hashes of each text; a text without hashes gets zero."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > counts[full, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    lower = tx.LOWER[data]
    words = tx.find_words(lower, offsets, tx.WHITE_SPACE)
    n, counts = len(words.start), np.diff(words.first)
    # the words, joined by one space each
    size = words.end - words.start + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    owner, at = tx.expand(words.start, size)
    spaced = np.full(len(at) + 1, 32, np.uint8)
    inner = np.ones(len(at), bool)
    inner[begin[1:] - 1] = False
    spaced[: len(at)][inner] = lower[at[inner]]
    grams = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc, head = tx.expand(words.first[:-1], grams)
    tail = np.minimum(head + shingle, words.first[1:][doc]) if n else head
    digest, raw = xxhash.xxh64_intdigest, spaced.tobytes()
    spans = zip(begin[head].tolist(), (begin[tail] - 1).tolist())
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(head))
    return fingerprint(hashes, np.concatenate(([0], np.cumsum(grams))))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_bytes(batch.column("text"))
            parts = [np.zeros(0, np.uint64)]
            for i, j in tx.runs(offsets, 1 << 20):
                parts.append(fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tx.signed(np.concatenate(parts)))], ["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: tx.released(run(batches)), f"id {id_type}, fp bigint")


def flips(bits: int | Sequence[int], most: int) -> list[int]:
    """All values of so many bits, or of the bits given, with at most so many ones, by number of ones."""
    places = range(bits) if isinstance(bits, int) else bits
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(places, k)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b to links from each vertex to the smallest vertex of its component."""
    vertices, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(vertices))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    tied = np.flatnonzero(root != np.arange(len(root)))
    return vertices[tied], vertices[root[tied]]


def _tied(z: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants and the fingerprints behind them: links between those behind equal variants, as a spanning forest."""
    ordered = np.sort(z)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return z[:0], z[:0]
    found = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, z), len(twice) - 1)] == z)
    found = found[np.lexsort((f[found], z[found]))]
    zz, ff = z[found], f[found]
    start = np.concatenate(([True], zz[1:] != zz[:-1]))
    hub = ff[np.maximum.accumulate(np.where(start, np.arange(len(zz)), 0))]
    pairs = np.unique(np.stack((hub[~start], ff[~start])), axis=1)
    near = np.bitwise_count(pairs[0] ^ pairs[1]) <= radius
    return forest(pairs[0][near], pairs[1][near])


def _variants(base: np.ndarray, fp: np.ndarray, left: np.ndarray, free: Sequence[int], half: int) -> tuple[np.ndarray, np.ndarray]:
    """Each base with at most ``left`` of the free bits flipped, and the fingerprint that it stands for."""
    masks = np.array(flips(free, half), np.uint64)
    values, owners = [], []
    for k in range(half + 1):
        mine = left == k
        size = sum(comb(len(free), ones) for ones in range(k + 1))
        values.append((base[mine][:, None] ^ masks[None, :size]).reshape(-1))
        owners.append(np.repeat(fp[mine], size))
    return np.concatenate(values), np.concatenate(owners)


def _pieces(fp: np.ndarray, left: np.ndarray, free: list[int], half: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The fingerprints of one prefix in pieces (fp, left, free bits) of at most VARIANTS_AT_ONCE variants.

    A piece holds the variants that agree in the bits that aren't free any more; each cut fixes the bit that halves best.
    """
    stack = [(np.arange(len(fp), dtype=np.int32), left.astype(np.int8), free)]
    while stack:
        rows, left, free = stack.pop()
        if len(rows) < 2:
            continue
        sizes = np.cumsum([comb(len(free), ones) for ones in range(half + 1)])
        if not free or sizes[left].sum() <= VARIANTS_AT_ONCE:
            yield fp[rows], left, free
            continue
        some = fp[rows[:: -(-len(rows) // 4096)]]
        share = [abs(2 * int((some >> np.uint64(b) & np.uint64(1)).sum()) - len(some)) for b in free]
        bit = free[int(np.argmin(share))]
        rest, own = [b for b in free if b != bit], fp[rows] >> np.uint64(bit) & np.uint64(1)
        for value in (0, 1):
            flipped = own != value
            keep = ~flipped | (left > 0)
            stack.append((rows[keep], left[keep] - flipped[keep].astype(np.int8), rest))


def meet(bucket: np.ndarray, fp: np.ndarray, prefix_bits: int, radius: int, pattern: np.ndarray | None = None,
         fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that were sent to prefixes: links between those that share a variant, as a spanning forest.

    ``fixed``: suffix bits that the prefix is cut by, of each row; ``pattern``: the values of these bits that the row was sent to.
    """
    suffix_bits, half = 64 - prefix_bits, radius // 2
    pattern = np.zeros(len(fp), np.uint64) if pattern is None else pattern
    fixed = np.zeros(len(fp), np.uint64) if fixed is None else fixed
    own = (fp >> np.uint64(suffix_bits)).astype(np.int64)
    left = half - np.bitwise_count(own ^ bucket).astype(np.int64) - np.bitwise_count((fp & fixed) ^ pattern).astype(np.int64)
    order = np.lexsort((pattern, bucket))
    bucket, fp, left, pattern, fixed = bucket[order], fp[order], left[order], pattern[order], fixed[order]
    amount = np.array([len(flips(suffix_bits, most)) for most in range(half + 1)])[left]
    begins = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (pattern[1:] != pattern[:-1])))) if len(bucket) else np.zeros(0, int)
    ends = np.append(begins[1:], len(bucket))
    several = ends - begins > 1  # a prefix with a single fingerprint has nothing to meet
    begins, ends = begins[several], ends[several]
    total = np.concatenate(([0], np.cumsum(amount)))
    alone = (total[ends] - total[begins] > VARIANTS_AT_ONCE) | (fixed[begins] != 0)
    low = np.uint64((1 << suffix_bits) - 1)
    heads, tails, held = [], [], 0

    def note(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal heads, tails, held
        heads, tails, held = [*heads, a], [*tails, b], held + len(a)
        if held > LINKS_AT_ONCE:
            a, b = forest(np.concatenate(heads), np.concatenate(tails))
            heads, tails, held = [a], [b], 0

    for i, j in zip(begins[alone].tolist(), ends[alone].tolist()):
        free = [b for b in range(suffix_bits) if not int(fixed[i]) >> b & 1]
        for mine, most, rest in _pieces(fp[i:j], left[i:j], free, half):
            open_bits = np.uint64(sum(1 << b for b in rest))  # in the others, all variants of a piece agree
            note(*_tied(*_variants(mine & open_bits, mine, most, rest, half), radius))
    begins, ends, i = begins[~alone], ends[~alone], 0
    while i < len(begins):
        j, upto = i + 1, total[ends[i]] - total[begins[i]]
        while j < len(begins) and upto + total[ends[j]] - total[begins[j]] <= VARIANTS_AT_ONCE:
            upto += total[ends[j]] - total[begins[j]]
            j += 1
        rows = np.concatenate([np.arange(a, b) for a, b in zip(begins[i:j], ends[i:j])])
        at = bucket[rows].astype(np.uint64) << np.uint64(suffix_bits)
        note(*_tied(*_variants(at | (fp[rows] & low), fp[rows], left[rows], range(suffix_bits), half), radius))
        i = j
    if not heads:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(heads), np.concatenate(tails))


def cuts(fps: DataFrame, radius: int = RADIUS, prefix_bits: int = PREFIX_BITS) -> list[tuple[int, list[int]]]:
    """Prefixes with more than a task's share of variants or rows, each with the suffix bits to cut it by: those that halve it best.

    The driver holds a number for each prefix.
    """
    suffix_bits, half = 64 - prefix_bits, radius // 2
    own = F.shiftrightunsigned("fp", suffix_bits).cast("int")
    count, every = np.zeros(1 << prefix_bits, np.int64), np.arange(1 << prefix_bits)
    for row in fps.groupBy(own.alias("own")).count().collect():
        count[row["own"]] = row["count"]
    sizes = [len(flips(suffix_bits, most)) for most in range(half + 1)]
    near = flips(prefix_bits, half)
    variants = sum(sizes[half - m.bit_count()] * count[every ^ m] for m in near)
    load = np.maximum(variants / VARIANTS_PER_TASK, sum(count[every ^ m] for m in near) / ROWS_PER_TASK)  # in tasks
    large = np.flatnonzero(load > 1).tolist()
    if not large:
        return []
    weights = [(m, sizes[half - m.bit_count()]) for m in near]
    moved = F.explode(F.array([F.struct(F.lit(m).alias("m"), F.lit(w).cast("long").alias("w")) for m, w in weights]))
    sent = fps.select("fp", own.alias("own"), moved.alias("s")).select(F.col("own").bitwiseXOR(F.col("s.m")).alias("bucket"), F.col("s.w").alias("w"), "fp")
    sent = sent.join(F.broadcast(fps.sparkSession.createDataFrame([(p,) for p in large], "bucket int")), "bucket")
    ones = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1)) * F.col("w")).alias(f"b{b}") for b in range(suffix_bits)]
    out = []
    for row in sent.groupBy("bucket").agg(F.sum("w").alias("w"), *ones).toLocalIterator():
        share = sorted((max(row[f"b{b}"], row["w"] - row[f"b{b}"]) / row["w"], b) for b in range(suffix_bits))
        bits, rest = [], load[row["bucket"]]  # about what the largest value of the bits gets
        while rest > 1 and len(bits) < MOST_CUTS:
            rest *= share[len(bits)][0]
            bits.append(share[len(bits)][1])
        out.append((row["bucket"], bits))
    return out


def sent_to(fps: DataFrame, cut: list[tuple[int, list[int]]], radius: int = RADIUS, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(base, fp): each fingerprint at the prefixes within half the radius; at a cut one, at the values of the cutting bits
    within what is left of it. ``base`` is the prefix, and these bits in their places."""
    suffix_bits, half = 64 - prefix_bits, radius // 2
    near = F.array([F.lit(m) for m in flips(prefix_bits, half)])
    prefix = F.shiftrightunsigned("fp", suffix_bits).cast("int")
    sent = fps.select("fp", prefix.alias("own")).select("fp", F.explode(near).alias("m"), "own").select(
        F.col("own").bitwiseXOR(F.col("m")).alias("bucket"), "fp", (half - F.bit_count("m")).alias("left")
    )
    top = F.shiftleft(F.col("bucket").cast("long"), suffix_bits)
    if not cut:
        return sent.select(top.alias("base"), "fp")
    table = [(p, [1 << b for b in bits], sum(1 << b for b in bits)) for p, bits in cut]
    by_prefix = F.broadcast(fps.sparkSession.createDataFrame(table, "bucket int, bits array<bigint>, fixed bigint"))
    level = upto = F.array(F.lit(0).cast("long"))
    choice = F.when(F.col("bits").isNull() | (F.col("left") == 0), upto)
    for k in range(1, half + 1):
        level = F.flatten(F.transform(level, lambda x: F.transform(F.filter("bits", lambda y: y > x), lambda y: x.bitwiseOR(y))))
        upto = F.concat(upto, level)
        choice = choice.when(F.col("left") == k, upto)
    sent = sent.join(by_prefix, "bucket", "left").select(top.alias("top"), "fp", "fixed", F.explode(choice).alias("flip"))
    pattern = F.col("fp").bitwiseAND(F.coalesce("fixed", F.lit(0).cast("long"))).bitwiseXOR(F.col("flip"))
    return sent.select(F.col("top").bitwiseOR(pattern).alias("base"), "fp")


def links(fps: DataFrame, n: int, radius: int = RADIUS, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, ``n`` of them, that connect what lies within the radius."""
    suffix_bits, cut = 64 - prefix_bits, cuts(fps, radius, prefix_bits)
    table = np.zeros(1 << prefix_bits, np.uint64)
    for p, bits in cut:
        table[p] = sum(1 << b for b in bits)
    tasks = max(1, -(-n * len(flips(prefix_bits, radius // 2)) // ROWS_PER_TASK))
    shared = fps.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("base").to_numpy().view(np.uint64), b.column("fp").to_numpy().view(np.uint64)) for b in batches]
        if rows:
            base, fp = (np.concatenate(column) for column in zip(*rows))
            bucket = (base >> np.uint64(suffix_bits)).astype(np.int64)
            a, b = meet(bucket, fp, prefix_bits, radius, base & np.uint64((1 << suffix_bits) - 1), shared.value[bucket])
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(a)), pa.array(tx.signed(b))], ["a", "b"])

    sent = sent_to(fps, cut, radius, prefix_bits)
    return sent.repartition(tasks, "base").mapInArrow(lambda batches: tx.released(run(batches)), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) of each row; component: smallest id among the rows linked to it, itself included."""
    rows = materialise(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distinct.count(), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    group = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = group.groupBy("root").agg(F.min("least").alias("component"))
    named = group.select("fp", "root").join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Of rows that share that id, the one whose text has the smallest hash stays. A row with a null id stays.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    of_id = found.groupBy(F.col(id_col).alias("near_id")).agg(F.min("component").alias("near_least"), F.count(F.lit(1)).alias("near_rows"))
    decided = materialise(of_id.where("near_least < near_id OR near_rows > 1"), "near-duplicates")
    known = decided.select("near_id")
    rest = docs.join(known, docs[id_col] == known["near_id"], "left_anti")
    kept = decided.where("near_least = near_id").select(F.col("near_id").alias("kept_id"))  # the first row of an id that repeats
    again = docs.join(kept, docs[id_col] == kept["kept_id"], "left_semi")
    place = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    number = tx.unused(docs.columns, "near_place")
    again = again.withColumn(number, F.row_number().over(place)).where(F.col(number) == 1).drop(number)
    return rest.unionByName(again)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
