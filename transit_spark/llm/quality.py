"""Quality classifier: a byte-level convolutional network in numpy.

Each byte is a learned vector of ``EMBEDDING`` numbers and a flag: whether the ``GRAM`` bytes from here on stood earlier in
the text. Learned filters slide over overlapping chunks of ``CHUNK`` bytes, one every ``STRIDE`` bytes, from the text's first
byte to its last; each filter's largest response over the whole text goes through a rectifier into a logistic unit, which
gives one probability. Gradients flow through the chunks that won.

The network is fitted in one task on a bounded sample: of the labelled rows, the ``SAMPLE`` of each class that come first by
hash and whose text has at most ``SAMPLE_BYTES`` bytes. Classes weigh in the fit as they do among the labelled rows.

Defined cases: an empty or null text is one chunk of padding and is scored like any other. Rows keep their number. Labels
that are null or other than 0 and 1 are left out; without labels of both classes all scores are the share of class 1,
or 0.5 if there is none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from transit_spark.llm import text as tx

SAMPLE = 1500
SAMPLE_BYTES = 1 << 17
EMBEDDING = 7
STRIDE = 8
BLOCKS = 4
CHUNK = STRIDE * BLOCKS
FILTERS = 16
GRAM = 12
EPOCHS = 12
BATCH = 48
RATE = 0.01
SEED = 42
THRESHOLD = 0.3
RUN_BYTES = 1 << 18
PAD = 256


@dataclass
class Network:
    embedding: np.ndarray  # (257, EMBEDDING)
    filters: np.ndarray  # (CHUNK * (EMBEDDING + 1), FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def seen_before(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, whether the GRAM bytes from it on stand earlier in the same text."""
    n = len(data) - GRAM + 1
    out = np.zeros(len(data), bool)
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = tx.gram_hashes(data.astype(np.uint64), GRAM) + doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slots = max(16, (4 * n - 1).bit_length())
    slot = (grams >> np.uint64(64 - slots)).astype(np.int64)
    first = np.empty(1 << slots, np.int32)
    at = np.arange(n, dtype=np.int32)
    first[slot[::-1]] = at[::-1]  # the last value written stays: the first place of each slot
    found = first[slot]
    out[:n] = (found < at) & (grams[found] == grams) & (doc[:n] == doc[GRAM - 1 :])
    return out


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as rows of STRIDE bytes (values to 256, padding) and flags, and the first row of each text."""
    sizes = np.diff(offsets)
    rows = np.maximum(-(-sizes // STRIDE), BLOCKS)
    first = np.concatenate(([0], np.cumsum(rows)))
    codes = np.full(int(first[-1]) * STRIDE, PAD, np.int16)
    flags = np.zeros(len(codes), np.float32)
    at = np.repeat(first[:-1] * STRIDE - offsets[:-1], sizes) + np.arange(len(data))
    codes[at] = data
    flags[at] = seen_before(data, offsets)
    return codes.reshape(-1, STRIDE), flags.reshape(-1, STRIDE), first


def _inputs(net: Network, codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    x = np.empty((*codes.shape, EMBEDDING + 1), np.float32)
    x[..., :EMBEDDING] = net.embedding[codes]
    x[..., EMBEDDING] = flags
    return x.reshape(len(codes), -1)


def pooled(net: Network, codes: np.ndarray, flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over each text's chunks, and all responses (chunks that cross texts: -inf)."""
    x = _inputs(net, codes, flags)
    width = STRIDE * (EMBEDDING + 1)
    parts = x @ np.concatenate([net.filters[k * width : (k + 1) * width] for k in range(BLOCKS)], axis=1)
    n = len(x) - BLOCKS + 1
    out = np.full((len(x), FILTERS), -np.inf, np.float32)
    out[:n] = net.bias
    for k in range(BLOCKS):
        out[:n] += parts[k : n + k, k * FILTERS : (k + 1) * FILTERS]
    for k in range(1, BLOCKS):
        out[first[1:] - k] = -np.inf
    return np.maximum.reduceat(out, first[:-1], axis=0), out


def probability(net: Network, largest: np.ndarray) -> np.ndarray:
    z = np.maximum(largest, 0) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def fit(texts: list[bytes], labels: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(CHUNK), (CHUNK * (EMBEDDING + 1), FILTERS)).astype(np.float32),
        np.full(FILTERS, -0.5, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )
    values = [net.embedding, net.filters, net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            data = np.frombuffer(b"".join(texts[d] for d in chosen), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(texts[d]) for d in chosen])))
            codes, flags, first = blocks_of(data, offsets)
            largest, out = pooled(net, codes, flags, first)
            p = probability(net, largest)
            loss = ((p - labels[chosen]) * weight[chosen]).astype(np.float32) / len(chosen)
            active = np.maximum(largest, 0)
            dz = loss[:, None] * net.weights * (largest > 0)
            winner = np.stack([
                out[a:b].argmax(axis=0) + a for a, b in zip(first[:-1], first[1:])
            ])
            rows = winner[..., None] + np.arange(BLOCKS)
            x = _inputs(net, codes[rows.reshape(-1)], flags[rows.reshape(-1)]).reshape(*winner.shape, -1)
            g_filters = np.einsum("df,dfx->xf", dz, x)
            g_x = (dz[..., None] * net.filters.T).reshape(*winner.shape, CHUNK, EMBEDDING + 1)[..., :EMBEDDING]
            g_embedding = np.zeros_like(net.embedding)
            np.add.at(g_embedding, codes[rows].reshape(*winner.shape, CHUNK), g_x)
            step += 1
            for v, g, (m, s) in zip(values, [g_embedding, g_filters, dz.sum(0), active.T @ loss, loss.sum(keepdims=True)], moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """Fits on the bounded sample in one task; the result is a few hundred KB."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label"))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * SAMPLE rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, F.col("id") == F.col("l_id"))
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["id"], (r["text"] or "").encode(), r["label"]) for b in batches for r in b.to_pylist())
        label = np.array([r[2] for r in found], np.float32)
        total = sum(shares.values())
        if len(set(label.tolist())) < 2:
            model = shares.get(1, 0) / total if total else 0.5
        else:
            weight = np.where(label == 1, shares[1] / total / label.mean(), shares[0] / total / (1 - label.mean()))
            model = fit([r[1] for r in found], label, weight)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = rows.repartition(1).mapInArrow(lambda batches: tx.released(run(batches)), "model binary").first()
    return fitted.model if fitted else pickle.dumps(0.5)


def scored(docs: DataFrame, model: bytes, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, which takes the place of a column of that name."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(shared.value)
        for batch in batches:
            scores = np.full(len(batch), net if isinstance(net, float) else 0.0)
            data, offsets = tx.text_bytes(batch.column(names.index(text_col)))
            for i, j in tx.runs(offsets, RUN_BYTES) if isinstance(net, Network) else ():
                largest, _ = pooled(net, *blocks_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                scores[i:j] = probability(net, largest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score_col])

    return docs.mapInArrow(lambda batches: tx.released(run(batches)), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; held-out rows give no labels to the fit."""
    model = train(docs, labels.where(~held_out()))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score reaches the threshold, with the columns they have."""
    score = tx.unused(docs.columns, "quality_score")
    return scored(docs, train(docs, labels.where(~held_out())), score_col=score).where(F.col(score) >= threshold).drop(score)
