"""Approximate nearest neighbours by cosine: multiprobe hashing with p-stable projections.

Vectors are scaled to length one, where the order of distances is that of cosines. A table cuts ``FUNCTIONS`` Gaussian
projections into cells of ``WIDTH``; a vector's cells are its bucket. A query visits its own bucket and those that differ by one
cell up or down in some projections, in the order of the estimated chance that a near vector fell there: the sum of the
squared distances to the borders crossed. ``PROBES`` buckets a table are visited, candidates of all tables are merged, and
each candidate's cosine is computed in double precision from the original vectors.

Equal vectors are one entry that carries the ``k + 1`` smallest of its ids, which is all that a query can need of them. Entries
and queries are dealt to parts by table and bucket; a query is sent once to each part with the buckets that it visits there.
A bucket of more than ``PART_ENTRIES`` entries is spread by id over parts of its own, and its visitors go to all of these.
Every vector is indexed; nothing is fitted to the data. All entries of a visited bucket are compared, so a bucket of many
near, unequal vectors costs its size for each query that visits it. A query that finds fewer than it asks for, in spite of
enough vectors, is compared with all of them, in blocks.

Defined cases: a vector that is null, zero, empty, or holds a null or non-finite component, or whose id is null, takes no
part. Vectors of different dimensions aren't compared. Of rows that share an id the smallest vector, component by component, takes
part; a query's own id is never its neighbour. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.text import mixed
from transit_spark.session import materialise

TABLES = 8
FUNCTIONS = 6
WIDTH = 1.2
PROBES = 400
SEED = 42
PART_ENTRIES = 1 << 14
ENTRIES_AT_ONCE, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 4096, 1024, 1 << 20
MOVES = np.array(list(product((0, -1, 1), repeat=FUNCTIONS)), np.int64)


def projections(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, dim])
    return rng.normal(size=(dim, FUNCTIONS)), rng.uniform(0, WIDTH, FUNCTIONS)


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    key = np.zeros(cells.shape[:-1], np.uint64)
    for f in range(FUNCTIONS):
        key = mixed(key * np.uint64(31) + cells[..., f].astype(np.uint64) + np.uint64(f + 1))
    return key.view(np.int64)


def hashed(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Keys of the buckets that each vector visits, the own one first, in order of estimated success."""
    a, b = projections(table, vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    place = (unit @ a + b) / WIDTH
    cell = np.floor(place).astype(np.int64)
    if probes == 1:
        return bucket_keys(cell)[:, None]
    below = place - cell
    cost = (below**2) @ (MOVES == -1).T + ((1 - below) ** 2) @ (MOVES == 1).T
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return bucket_keys(cell[:, None, :] + MOVES[order])


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension."""
    sizes = np.diff(np.asarray(column.offsets))
    flat, first = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[first[rows][:, None] + np.arange(dim)]))
    return out


def _large(dealt: DataFrame, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each table, the buckets with over PART_ENTRIES of the dealt entries: (sorted keys, first part, number of parts)."""
    table = F.floor(F.col("slice") / parts).cast("int")
    sizes = dealt.groupBy(table.alias("table"), F.element_at("buckets", 1).alias("key")).count().where(F.col("count") > PART_ENTRIES)
    out, first = {}, TABLES * parts
    rows = sorted((r["table"], r["key"], -(-r["count"] // PART_ENTRIES)) for r in sizes.collect())
    for t in sorted({r[0] for r in rows}):
        keys, amount = (np.array([r[i] for r in rows if r[0] == t], np.int64) for i in (1, 2))
        out[t] = keys, first + np.cumsum(amount) - amount, amount
        first += int(amount.sum())
    return out


def _spread(key: np.ndarray, where: np.ndarray, cid: np.ndarray, asking: bool, large: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``key``, parts): an entry of a large bucket goes to one of its parts, a visitor to all."""
    keys, first, amount = large
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    found = keys[at] == key
    if not asking:
        own = first[at] + (mixed(cid.astype(np.int64).view(np.uint64)) % amount[at].astype(np.uint64)).astype(np.int64)
        return np.arange(len(key)), np.where(found, own, where)
    owner, part = tx.expand(np.where(found, first[at], where), np.where(found, amount[at], 1))
    return owner, part


def _dealt(rows: DataFrame, parts: int, probes: int, asking: bool, large: dict | None = None) -> DataFrame:
    """(slice, asking, cid, embedding, buckets) for each table and part that holds a bucket of the vector."""
    large = large or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, matrix in _vectors(batch.column("embedding")):
                for i in range(0, len(rows_), 1024):
                    own = rows_[i : i + 1024]
                    for table in range(TABLES):
                        keys = hashed(matrix[i : i + 1024], table, probes)
                        where = table * parts + (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                        row, flat, key = np.repeat(np.arange(len(own)), keys.shape[1]), where.reshape(-1), keys.reshape(-1)
                        if table in large:
                            ids = batch.column("cid").to_numpy()[own[row]]
                            at, flat = _spread(key, flat, ids, asking, large[table])
                            row, key = row[at], key[at]
                        order = np.lexsort((flat, row))
                        row, flat, key = row[order], flat[order], key[order]
                        starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (flat[1:] != flat[:-1]))))
                        take = pa.array(own[row[starts]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(flat[starts].astype(np.int32)), pa.array(np.full(len(starts), asking)), batch.column("cid").take(take),
                             batch.column("embedding").take(take), pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(key))],
                            ["slice", "asking", "cid", "embedding", "buckets"],
                        )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("cid", "embedding").mapInArrow(lambda batches: tx.released(run(batches)), f"slice int, asking boolean, cid bigint, embedding {kind}, buckets array<bigint>")


def best_of(query: np.ndarray, entry: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best pairs of each query, ties to the smaller entry."""
    order = np.lexsort((entry, -score, query))
    ordered = query[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def compare(q_ids: np.ndarray, q: np.ndarray, q_list: tuple[np.ndarray, np.ndarray], e_ids: np.ndarray, e: np.ndarray,
            e_bucket: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest entries of each query among the buckets that it visits: (query id, entry id, cosine)."""
    owner, visited = q_list
    order = np.argsort(e_bucket, kind="stable")
    keys, first = np.unique(e_bucket[order], return_index=True)
    last = np.append(first[1:], len(order))
    by_bucket = np.argsort(visited, kind="stable")
    at = np.searchsorted(visited[by_bucket], keys), np.searchsorted(visited[by_bucket], keys, side="right")
    q_norm, e_norm = np.linalg.norm(q, axis=1), np.linalg.norm(e, axis=1)
    unit_q, unit_e = q / q_norm[:, None], (e / e_norm[:, None])[order]
    none = np.zeros(0, np.int64)
    best = none, none, np.zeros(0)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best so far and the pairs found since, the k best of each query: (query, entry, cosine)."""
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        score = np.empty(len(x))
        for i in range(0, len(x), 1 << 16):
            s = slice(i, i + (1 << 16))
            score[s] = np.einsum("ij,ij->i", q[x[s]], e[y[s]]) / (q_norm[x[s]] * e_norm[y[s]])
        x, y, score = np.append(best[0], x), np.append(best[1], y), np.append(best[2], score)
        keep = best_of(q_ids[x], e_ids[y], score, k)
        return x[keep], y[keep], score[keep]

    held = 0
    for a, b, c, d in zip(first.tolist(), last.tolist(), at[0].tolist(), at[1].tolist()):
        for g in range(c, d, QUERIES_AT_ONCE):
            asking = owner[by_bucket[g : min(d, g + QUERIES_AT_ONCE)]]
            for i in range(a, b, ENTRIES_AT_ONCE):
                near = unit_q[asking] @ unit_e[i : min(b, i + ENTRIES_AT_ONCE)].T
                keep = min(k, near.shape[1])
                if near.shape[1] > 2 * keep:  # rounding can't matter: what is within 1e-9 of the k-th stays
                    bar = np.partition(near, near.shape[1] - keep, axis=1)[:, -keep] - 1e-9
                    x, y = np.nonzero(near >= bar[:, None])
                else:
                    x, y = (g.reshape(-1) for g in np.indices(near.shape))
                found.append((asking[x], order[i + y]))
                held += len(x)
                if held > PAIRS_AT_ONCE:
                    best, found, held = merged(), [], 0
    if found:
        best = merged()
    return q_ids[best[0]], e_ids[best[1]], best[2]


def _searched(dealt: DataFrame, tasks: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def parts(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            slices = whole.column("slice").to_numpy()
            for s in np.unique(slices).tolist():
                part = whole.filter(pa.array(slices == s)).combine_chunks()
                emb, cid = part.column("embedding").combine_chunks(), part.column("cid").to_numpy()
                asking, lists = part.column("asking").to_numpy(), part.column("buckets").combine_chunks()
                upto, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten().to_numpy()
                for rows, matrix in _vectors(emb):
                    q, e = np.flatnonzero(asking[rows]), np.flatnonzero(~asking[rows])
                    if not len(q) or not len(e):
                        continue
                    sizes = np.diff(upto)[rows[q]]
                    owner = np.repeat(np.arange(len(q)), sizes)
                    visited = np.concatenate([flat[upto[r] : upto[r + 1]] for r in rows[q]])
                    a, b, c = compare(cid[rows[q]], matrix[q], (owner, visited), cid[rows[e]], matrix[e], flat[upto[rows[e]]], k)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["q", "cid", "score"])

        for batch in batches:
            rest = pa.Table.from_batches([batch])
            held = rest if held is None else pa.concat_tables([held, rest])
            last = batch.column("slice")[len(batch) - 1].as_py() if len(batch) else None
            if last is not None and held.column("slice")[0].as_py() != last:
                done = held.column("slice").to_numpy() != last
                yield from parts(held.filter(pa.array(done)))
                held = held.filter(pa.array(~done))
        if held is not None and held.num_rows:
            yield from parts(held)

    return dealt.repartition(tasks, "slice").sortWithinPartitions("slice").mapInArrow(lambda batches: tx.released(run(batches)), "q bigint, cid bigint, score double")


def _short(ranked: DataFrame, asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Entries whose queries have fewer neighbours than ``k`` and than there are candidates of their dimension."""
    dim = F.size("embedding")
    # An entry has at most k + 1 ids, so the sums are no counts of rows, but they tell whether there are k candidates.
    there = entries.groupBy(dim.alias("dim")).agg(F.sum(F.size("ids")).alias("there"))
    counts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = asked.join(counts, "query_id", "left").join(entries.select("cid", "embedding", dim.alias("dim")), "cid").join(F.broadcast(there), "dim")
    few = F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("there") - 1)
    return rows.where(few).select("cid", "embedding").dropDuplicates(["cid"])


def _compared_with_all(short: DataFrame, entries: DataFrame, n: int, k: int) -> DataFrame:
    """The k nearest of all entries for each of ``short``, by blocks of queries and entries."""
    tiles, blocks = -(-short.count() // QUERIES_AT_ONCE), max(1, -(-n // PART_ENTRIES))

    def dealt(rows: DataFrame, asking: bool) -> DataFrame:
        own, other = (tiles, blocks) if asking else (blocks, tiles)
        mine = F.pmod(F.xxhash64("cid"), F.lit(own))
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        rows = rows.select("cid", "embedding", mine.alias("mine"), every.alias("every"))
        place = F.col("mine") * blocks + F.col("every") if asking else F.col("every") * blocks + F.col("mine")
        return rows.select(place.cast("int").alias("slice"), F.lit(asking).alias("asking"), "cid", "embedding", F.array(F.lit(0).cast("long")).alias("buckets"))

    return _searched(dealt(entries, False).unionByName(dealt(short, True)), tiles * blocks, k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries``, which are rows of ``vectors``."""
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), vector.alias("embedding")).groupBy("id").agg(F.min("embedding").alias("embedding"))

    place = Window.partitionBy("embedding").orderBy("id")
    few = clean(vectors).withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.element_at("ids", 1))
    entries = materialise(entries, "entries")
    asked = materialise(clean(queries).join(entries.select("embedding", "cid"), "embedding").select(F.col("id").alias("query_id"), "cid"), "asked")
    asking = entries.join(asked.select("cid").distinct(), "cid", "left_semi")
    n = entries.count()
    parts = max(1, -(-n // PART_ENTRIES))
    large = _large(_dealt(entries, parts, 1, False), parts) if parts > 1 else {}
    dealt = _dealt(entries, parts, 1, False, large).unionByName(_dealt(asking, parts, probes, True, large))
    found = _searched(dealt, parts * TABLES + sum(int(amount.sum()) for _, _, amount in large.values()), k + 1).distinct()
    ranked = materialise(_ranked(found, asked, entries, k), "neighbours")
    short = materialise(_short(ranked, asked, entries, k), "short-queries")
    if short.isEmpty():
        return ranked
    again = asked.join(short.select("cid"), "cid", "left_semi")
    rest = ranked.join(again.select("query_id"), "query_id", "left_anti")
    return rest.unionByName(_ranked(_compared_with_all(short, entries, n, k + 1), again, entries, k))


def _ranked(found: DataFrame, asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query among the ids of the entries found for it."""
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "cid")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "cid", "score")
    rows = found.join(entries.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    rows = asked.select("query_id", F.col("cid").alias("q")).join(rows, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
