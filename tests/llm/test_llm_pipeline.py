"""The corpus pipeline against its stages' brute-force rules, on documents planted here."""

import random

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from transit_spark.llm import quality

from test_llm_operators import ALNUM, LOWER, fingerprint, prose, suffix_rows


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(150):
        junk = i % 5 == 0
        text = prose(1000 + i, rng.randint(60, 130))
        docs.append((i, " ".join(w.upper() + "!!" for w in text.split()) if junk else text, "en", "s", len(text)))
        labels.append((i, int(not junk), 0))
    leak, passage = prose(7, 30), prose(8, 120)
    docs += [(200, docs[1][1], "en", "s", 1), (201, docs[2][1], "en", None, 2), (202, f"{prose(20, 40)} {leak} {prose(21, 40)}", "en", "s", 3)]
    docs += [(203 + i, f"{prose(30 + i, 50)} {passage} {prose(40 + i, 50)}", None, "t", 4) for i in range(3)]
    docs += [(300, None, None, None, None), (None, prose(50, 80), "en", "s", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(9, 30))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, leak


def test_stages_follow_their_rules(spark, planted):
    folder, docs, leak = planted
    read = spark.read.parquet
    frame = read(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(frame, read(f"{folder}/labels.parquet")).collect()}
    kept = [(d[0], d[1]) for d in docs if scores[d[0]]]
    assert all(scores[i] == (i % 5 > 0) for i in range(150))
    fps = {d: fingerprint(t) for d, t in kept if d is not None}
    groups = {d: min(x for x in fps if bin(fps[x] ^ f).count("1") <= 4) for d, f in fps.items()}
    kept = [(d, t) for d, t in kept if d is None or groups[d] == d]
    assert not {200, 201} & {d for d, _ in kept}
    cut = {}
    for (d, t), row in zip(kept, suffix_rows(kept)):
        cut[d] = (row[2], t)
    assert all(cut[203 + i][0] > 400 for i in range(3))
    grams = {tuple(leak.split(" ")[i : i + 10]) for i in range(21)}
    clean = [d for d, t in kept if not any(tuple(ALNUM.findall((t or "").translate(LOWER))[i : i + 10]) in grams for i in range(2000))]
    assert 202 not in clean
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(clean) and all(r.round_trip for r in out)


def test_stages_return_the_columns_of_documents(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0


def test_all_queries_are_registered():
    names = contract.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in names if q.startswith("op")} and "pipeline" in names
    assert np.all([q in names for q in contract.oracle_sql()])
