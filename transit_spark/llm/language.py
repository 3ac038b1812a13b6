"""Language identification by multilingual mixture inference.

A language's model is the smoothed distribution of its hashed byte trigrams within words, word borders included. A word's
likelihood under a language is that of its trigrams. A document is a mixture: expectation-maximisation over its words gives
the proportion of each language. The set of languages is chosen by penalised likelihood: starting from all, the language with
the smallest proportion is dropped again and again, and the set whose log-likelihood less ``PENALTY`` times the logarithm of
the number of words for each language is greatest stays. The prediction is the language with the largest proportion there.

Models are counted in one task on a bounded sample: of each language's training rows the ``SAMPLE`` first by hash, with
texts of at most ``SAMPLE_BYTES`` bytes.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language first in order of name.
Rows keep their number. Without training rows every text is ``und``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from transit_spark.llm import text as tx

SAMPLE = 2000
SAMPLE_BYTES = 1 << 17
SLOT_BITS = 16
SMOOTHING = 0.1
PENALTY = 2.0
FIRST_ROUNDS = 8
MORE_ROUNDS = 4
RUN_BYTES = 1 << 19
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters part words.
_PARTS = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, the first trigram of each word, and the first word of each text."""
    words = tx.find_words(data, offsets, _PARTS)
    sizes = words.end - words.start + 2  # with a border on both sides
    first = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.full(int(first[-1]), ord(" "), np.uint32)
    owner, at = tx.expand(words.start, words.end - words.start)
    codes[at - words.start[owner] + first[:-1][owner] + 1] = tx.LOWER[data[at]]
    grams = (codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]) if len(codes) > 2 else np.zeros(0, np.uint32)
    slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
    inside = np.ones(len(codes), bool)
    inside[first[1:] - 1] = inside[first[1:] - 2] = False
    return slots[inside[:-2]].astype(np.int64), first[:-1] - 2 * np.arange(len(sizes)), words.first


def fit(texts: list[bytes], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Names, and the log-probability of each trigram slot in each language."""
    names = sorted(set(languages))
    counts = np.zeros((len(names), 1 << SLOT_BITS))
    for k, name in enumerate(names):
        own = [t for t, l in zip(texts, languages) if l == name]
        for i in range(0, len(own), 64):
            part = own[i : i + 64]
            slots, _, _ = trigrams(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in part]))))
            counts[k] += np.bincount(slots, minlength=1 << SLOT_BITS)
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T.copy()


def mixtures(loglik: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of languages in each text; ``loglik``: words by languages, ``first``: each text's first word.

    Texts without words get proportions of zero.
    """
    n_words = np.diff(first)
    full = np.flatnonzero(n_words)
    out = np.zeros((len(n_words), loglik.shape[1]))
    if not len(full):
        return out
    starts, sizes, k = first[full], n_words[full].astype(np.float64), loglik.shape[1]
    peak = loglik.max(axis=1, keepdims=True)
    like = np.exp(loglik - peak, dtype=np.float32)
    base = np.add.reduceat(peak[:, 0].astype(np.float64), starts)
    doc = np.repeat(np.arange(len(full)), n_words[full])
    share = np.full((len(full), k), 1 / k, np.float32)
    best, chosen = np.full(len(full), -np.inf), share.copy()
    tiny = np.float32(1e-30)
    for left in range(k, 0, -1):
        for _ in range(FIRST_ROUNDS if left == k else MORE_ROUNDS):
            weighted = like * share[doc]
            weighted /= weighted.sum(axis=1, keepdims=True) + tiny
            share = (np.add.reduceat(weighted, starts, axis=0) / sizes[:, None]).astype(np.float32)
        total = np.log((like * share[doc]).sum(axis=1) + tiny)
        score = base + np.add.reduceat(total.astype(np.float64), starts) - PENALTY * left * np.log(sizes + 1)
        better = score > best
        best[better], chosen[better] = score[better], share[better]
        lowest = np.where(share > 0, share, np.inf).argmin(axis=1)
        share[np.arange(len(full)), lowest] = 0
        rest = share.sum(axis=1, keepdims=True)
        share = np.where(rest > 0, share / np.maximum(rest, tiny), share)
    out[full] = chosen
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Counts the models on the bounded sample, in one task."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    keys = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    chosen = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE).select(F.col("id").alias("s_id"), F.col("lang").alias("s_lang")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = texts.where(F.octet_length("text") <= SAMPLE_BYTES).join(
        F.broadcast(chosen), (F.col("id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang"))
    ).select("id", "text", "lang")  # SAMPLE rows of an id and a name for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["id"], r["text"], r["lang"]) for b in batches for r in b.to_pylist())
        model = fit([t.encode() for _, t, _ in found], [lang for _, _, lang in found])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = rows.repartition(1).mapInArrow(lambda batches: tx.released(run(batches)), "model binary").first()
    return fitted.model if fitted else pickle.dumps(fit([], []))


def predicted(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, lang_pred and lang_score, which take the place of columns of these names."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = pickle.loads(shared.value)
        labels = np.array([*names, UNDETERMINED], object)
        for batch in batches:
            texts = batch.column(columns.index(text_col))
            data, offsets = tx.text_bytes(texts)
            best, score = np.full(len(batch), len(names)), np.zeros(len(batch))
            for i, j in tx.runs(offsets, RUN_BYTES) if names else ():
                slots, grams, first = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(slots):
                    continue
                shares = mixtures(np.add.reduceat(table[slots], grams, axis=0), first)
                some = shares.sum(axis=1) > 0
                best[i:j] = np.where(some, shares.argmax(axis=1), best[i:j])
                score[i:j] = np.clip(shares.max(axis=1), 0, 1)
            # Words of non-ASCII marks alone have no letter.
            ascii_letter = np.add.reduceat(np.append(~_PARTS[data] & (data < 0x80), False), offsets[:-1]) * (np.diff(offsets) > 0)
            for d in np.flatnonzero((ascii_letter == 0) & (best < len(names))).tolist():
                if not _LETTER.search(texts[d].as_py() or ""):
                    best[d], score[d] = len(names), 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels[best].tolist(), pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"]
            )

    fields = [*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    return docs.mapInArrow(lambda batches: tx.released(run(batches)), StructType(fields))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; held-out rows give nothing to the models."""
    model = train(docs.where(~held_out()))
    rows = predicted(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
