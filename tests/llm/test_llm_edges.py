"""Clashing names, path forms, lonely queries and very long texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transit_spark.llm import language, neighbours, quality, simhash, token_files

from test_llm_operators import WORD_BPE, docs, prose, rows_of, texts  # noqa: F401


def nearest(rows, queries, k=5):
    rows = {i: np.array(v) for i, v in rows if v is not None and any(v)}
    out = []
    for q in queries:
        if q in rows:
            scores = [(-float(rows[q] @ v / math.sqrt(rows[q] @ rows[q]) / math.sqrt(v @ v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])]
            out += [(q, r, i) for r, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (50, [0.0, 1.0]), (51, [0.0, -1.0])],
    [(0, [1.0] * 8), (1, [-1.0] * 8)],
    [(0, [1.0] * 8)],
    [(0, [1.0] + [0.0] * 15)] + [(i, [-1.0] + [0.01 * math.sin(i * j) for j in range(1, 16)]) for i in range(1, 296)],
])
def test_each_query_gets_all_there_are_up_to_k(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.neighbours(frame, frame.where("vec_id % 50 = 0"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == nearest(rows, range(0, 300, 50))


def test_queries_left_short_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(neighbours, "PART_ENTRIES", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.neighbours(frame, frame.where("vec_id % 20 = 0"), probes=1)  # finds next to nothing by hashing
    assert got.groupBy("query_id").count().where("count <> 5").count() == 0
    short = frame.select(F.col("vec_id").alias("cid"), "embedding")
    entries = short.withColumn("ids", F.array("cid"))
    found = neighbours._ranked(neighbours._compared_with_all(short.where("cid % 20 = 0"), entries, 200, 6),
                               short.where("cid % 20 = 0").select(F.col("cid").alias("query_id"), "cid"), entries, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == nearest(rows, range(0, 200, 20))


def test_columns_with_the_operators_own_names(spark, docs):  # noqa: F811
    taken = docs.withColumns({n: F.lit("7") for n in ("quality_score", "QUALITY_SCORE_", "near_place", "near_id", "near_least", "kept_id", "root", "label")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 17)], "doc_id bigint, quality int")
    kept = quality.accepted(taken, labels, 0.0)
    assert kept.columns == taken.columns and kept.count() == taken.count() and {r.quality_score for r in kept.collect()} == {"7"}
    once = simhash.one_of_each(taken)
    assert once.columns == taken.columns and rows_of(once.select("doc_id")) == rows_of(simhash.one_of_each(docs).select("doc_id"))
    named = language.predicted(docs.withColumns({"lang_pred": F.lit(1), "lang_score": F.lit("x")}), language.train(docs))
    assert named.columns == [*docs.columns, "lang_pred", "lang_score"] and {r.lang_score for r in named.collect()} != {"x"}


def test_token_files_in_any_form_of_path(docs, folder):  # noqa: F811
    want = None
    for form in (folder, f"file:{folder}", f"file://{folder}"):
        manifest = token_files.write_tokens(docs, f"{form}/tokens", WORD_BPE)
        got = rows_of(token_files.digest(token_files.read_tokens(manifest)))
        want = want or got
        assert got == want and len(got) == docs.count()


def test_very_long_texts(spark):
    long_ = prose(900, 200_000)
    frame = spark.createDataFrame([(1, long_, "aa"), (2, prose(901, 50), "bb"), (3, "x" * 1_200_000, "aa")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(frame, labels).collect())
    assert {r.doc_id for r in language.identify(frame).collect()} == {1, 2, 3}


def test_a_template_of_many_items_and_documents_makes_no_pairs(spark):
    from transit_spark.llm import decontamination

    template = prose(700, 14)
    items = spark.createDataFrame([(i, f"{template} {prose(8000 + i, 12)}") for i in range(300)], "item_id bigint, text string")
    frame = spark.createDataFrame([(i, f"{prose(9000 + i, 12)} {template} {prose(9500 + i, 12)}") for i in range(300)], "doc_id bigint, text string")
    found = decontamination.contamination(frame, items)
    # a neighbouring word may be an item's by chance
    assert all(14 <= r.n_hit <= 17 and r.items == 300 for r in found.select("n_hit", F.size("items").alias("items")).collect())
    assert decontamination.hits(frame, items)[1].count() < 300 * 300 / 10  # pairs of a document and an item
