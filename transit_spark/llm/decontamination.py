"""Benchmark decontamination by winnowing.

Words are runs of digits, a-z (A-Z are lower-cased) and characters beyond ASCII. A window is ``WINDOW`` consecutive words
of a benchmark item, or a whole shorter item. Of the word 5-grams of documents and items, the smallest hash of each 6
consecutive ones is kept; any 10 words that both sides share hold such a gram on both sides, at the same place. Kept
grams are joined by hash; a hit is extended to the windows of 10 words that hold the gram, which must be the same on both
sides. A shorter item has too few words for that; all grams of its length are kept instead, which is winnowing with a window
of one.

Documents' grams meet a bitmap of the benchmark's hashes before the shuffle. It has 2^24 bits whatever the benchmark's
size; a large benchmark fills it, lets more grams pass to the join and changes no result.

Defined cases: a null or empty text has no words and no hits. Rows with the same id and text get the same result, each its
own row. Items without words match nothing; the windows of items with a null id are hits like any other, but the lists and
their lengths leave these items out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.session import materialise

WINDOW = 10
GRAM = 5
SLOTS = 1 << 24
BUCKET_BITS = 15  # of Spark's bitmap aggregate

SPAN = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("gram", pa.int32()), ("left", pa.int32()), ("words", pa.string())])
SPAN_DDL = "array<struct<key: bigint, at: int, gram: int, left: int, words: string>>"


def _keys(grams: np.ndarray, k: int) -> np.ndarray:
    """Grams of different lengths get different hashes."""
    return tx.mixed(grams + np.uint64(k))


def _passes(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(keys), bool)
    slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _positions(codes: np.ndarray, first: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams: their positions and keys."""
    grams = tx.gram_hashes(codes, k)
    at = tx.window_minima(grams, first, np.maximum(counts - k + 1, 0), window) if len(grams) else np.zeros(0, np.int64)
    return at, _keys(grams[at], k)


def _spans(data: bytes, words: tx.Words, doc: np.ndarray, at: np.ndarray, keys: np.ndarray, k: int, around: int) -> list[dict]:
    """Grams with up to ``around`` words of their text on each side."""
    out = []
    for d, p, key in zip(doc.tolist(), at.tolist(), keys.tolist()):
        begin, end = words.first[d], words.first[d + 1]
        a, b = max(begin, p - around), min(end, p + k + around)
        shown = b" ".join(data[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist()))
        out.append({"key": key, "at": p - begin, "gram": k, "left": p - a, "words": shown.decode("utf-8", "replace")})
    return out


def kept_grams(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], bits: np.ndarray | None, items: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to rows (id, text_key, n_words, spans). ``lengths``: of items shorter than a window."""
    for batch in batches:
        data, offsets = tx.text_bytes(batch.column("text"))
        n_words, spans = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
        for i, j in tx.runs(offsets):
            lower = tx.LOWER[data[offsets[i] : offsets[j]]]
            words = tx.find_words(lower, offsets[i : j + 1] - offsets[i], tx.NOT_ALPHANUMERIC)
            codes, counts = tx.word_hashes(lower, words), np.diff(words.first)
            n_words[i:j] = counts
            raw = None
            passes = [(GRAM, WINDOW - GRAM + 1, WINDOW - GRAM)] + [(m, 1, 0) for m in lengths]
            for k, window, around in passes:
                at, keys = _positions(codes, words.first[:-1], counts, k, window)
                doc = np.searchsorted(words.first, at, side="right") - 1
                if items:  # long items have windows; a shorter one is its own
                    keep = (counts[doc] >= WINDOW) if around else (counts[doc] == k)
                else:
                    keep = _passes(bits, keys)
                if not keep.any():
                    continue
                raw = lower.tobytes() if raw is None else raw
                doc, at, keys = doc[keep], at[keep], tx.signed(keys[keep])
                for d, span in zip(doc.tolist(), _spans(raw, words, doc, at, keys, k, around)):
                    spans[i + d].append(span)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array(n_words), pa.array(spans, pa.list_(SPAN))],
            ["id", "text_key", "n_words", "spans"],
        )


def _pass(df: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...], bits, items: bool) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches):
        return kept_grams(batches, lengths, shared.value if shared is not None else None, items)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    return rows.mapInArrow(lambda batches: tx.released(run(batches)), f"id {id_type}, text_key bigint, n_words bigint, spans {SPAN_DDL}")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """One bit for each hash modulo SLOTS: at most SLOTS / 8 bytes on the driver."""
    slot = F.col("key").bitwiseAND(SLOTS - 1)
    rows = (
        grams.select(slot.alias("slot")).distinct()
        .groupBy(F.shiftright("slot", BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << BUCKET_BITS) - 1)).alias("bits"))
        .collect()
    )
    size = 1 << (BUCKET_BITS - 3)
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in rows:
        bits[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def _windows(spans: DataFrame, whole: Column) -> DataFrame:
    """Each span of a kept gram with the windows around it: adds (shift, size, window).

    ``whole`` says for which spans the gram itself is the window, that of an item of so many words; for the others it is
    each ``WINDOW`` consecutive words that hold the gram.
    """
    own = F.array(F.struct(F.lit(0).alias("shift"), F.col("gram").alias("size"), F.array_join(F.slice("parts", F.col("left") + 1, F.col("gram")), " ").alias("window")))
    begins = F.expr(
        f"filter(sequence(greatest(left - {WINDOW - GRAM}, 0), left), s -> s + {WINDOW} <= size(parts) AND gram = {GRAM})"
    )
    longer = F.transform(begins, lambda s: F.struct(
        (s - F.col("left")).alias("shift"), F.lit(WINDOW).alias("size"), F.array_join(F.slice("parts", s + 1, F.lit(WINDOW)), " ").alias("window")))
    both = F.concat(F.when(whole, own).otherwise(F.slice(own, 1, 0)), longer)
    return spans.withColumn("parts", F.split("words", " ")).withColumn("w", F.explode(both)).select(*spans.columns, "w.*")


def hits(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their word counts, covered spans with their items): the parts of :func:`contamination`.

    Spans of kept grams are joined by the gram's hash and a window around it. A window that many documents share with many
    items is one row of items, so the join has a row for each occurrence in a document, not for each item there.
    """
    items = materialise(_pass(benchmark, item_col, item_text_col, tuple(range(1, WINDOW)), None, True), "benchmark-grams")
    lengths = tuple(sorted(r.n_words for r in items.where(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect()))
    grams = items.select(F.col("id").cast("string").alias("item_id"), "n_words", F.explode("spans").alias("s")).select("item_id", "n_words", "s.*")
    docs = materialise(_pass(documents, id_col, text_col, lengths, _bitmap(grams), False), "document-grams")
    found = docs.where(F.size("spans") > 0).select("id", "text_key", F.explode("spans").alias("s")).select("id", "text_key", "s.*").distinct()
    theirs = _windows(grams, F.col("n_words") < WINDOW).groupBy("key", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    met = _windows(found, F.lit(True)).join(theirs, ["key", "window"])
    start = F.col("at") + F.col("shift")
    return docs.select("id", "text_key", "n_words"), met.select("id", "text_key", start.alias("start"), (start + F.col("size")).alias("end"), "item_ids")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_key, n_words, n_hit, items: sorted ids as strings, spans) of each document row."""
    docs, covered = hits(documents, benchmark, id_col, text_col, item_col, item_text_col)
    union = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = covered.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    ).withColumn("n_hit", union)
    h = per_doc.select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans", "items", "n_hit")
    joined = docs.join(h, docs["id"].eqNullSafe(h["hit_id"]) & (docs["text_key"] == h["hit_key"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_col), "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without those that hold a window of the benchmark."""
    found = contamination(documents, benchmark, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    same = documents[id_col].eqNullSafe(found["leak_id"]) & (F.xxhash64(documents[text_col]) == found["leak_key"])
    return documents.join(found, same, "left_anti")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
