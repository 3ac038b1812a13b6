"""From raw documents to sampled piece ids: five stages over a table of documents.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of ``documents``. The near-
duplicate stage uses the fingerprints and the radius of ``simhash``: 4-word shingles and 4 of 64 bits. Sets of 5-word shingles
that are so close overlap by more than 0.8; copies edited more heavily than that radius sees stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from transit_spark.llm import decontamination, pieces, quality, simhash, suffix_dedup
from transit_spark.session import materialise


#: Fifty words are 250 to 400 bytes of the languages at hand, so that a passage of more than fifty holds such a string.
PASSAGE_BYTES, PASSAGE_GRAM = 256, 128


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur more than once are cut out of the texts."""
    return suffix_dedup.cleaned(docs, min_bytes=PASSAGE_BYTES, gram_bytes=PASSAGE_GRAM)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text, with their ids."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: Trained scores, shared passages and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
