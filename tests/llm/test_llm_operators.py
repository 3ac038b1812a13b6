"""The dealt operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transit_spark.llm import (
    decontamination, fm_index, language, neighbours, pieces, quality, sharding, simhash, suffix_dedup, token_files,
)
from transit_spark.llm import text as tx
from transit_spark.llm.components import components
from transit_spark.llm.tokens import ChunkEncoder

SMALL = Path("/root/testdata/sf0.001")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, spans int, key double, fp string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdklmnrstäß") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    passage = prose(1, 90)
    base = prose(2, 140)
    words = base.split(" ")
    return [
        (1, base), (2, base), (3, " ".join(["changed", *words[1:]])), (4, f"{prose(3, 60)} {passage} {prose(4, 60)}"),
        (5, f"{prose(5, 20)}\n{passage}\t{prose(6, 10)}"), (6, passage), (7, None), (8, ""), (9, " \n\t "), (10, "one"),
        (11, "of " * 300), (12, prose(7, 3000)), (13, base.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))), (None, base), (None, prose(8, 70)), (1, base),
        (14, "日本語 é x ▁ ▁▁y  z\x1c<|endoftext|>a<|endoftext|>"), (15, f"{words[5]} x " + " ".join(words[20:75])), (16, "x" * 2000),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en" if d and d % 2 else None, None if d and d % 3 == 0 else "s", None, "id", 1, 0.5, "fp") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# words and windows


def test_words_and_minima_follow_brute_force():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    raw = [p.encode() for p in parts]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = tx.find_words(data, offsets, tx.WHITE_SPACE)
    got = [[data[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first, words.first[1:])]
    assert got == [WHITE.findall(p) for p in parts]
    k, window = 3, 4
    grams = tx.gram_hashes(data.astype(np.uint64), k)
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    want = set()
    for first, n in zip(offsets[:-1], counts):
        for j in range(n - window + 1):
            span = [int(g) >> 32 for g in grams[first + j : first + j + window]]
            want.add(int(first) + j + span.index(min(span)))
    assert set(tx.window_minima(grams, offsets[:-1], counts, window).tolist()) == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 1 quality, 2 language


def test_quality_learns_what_separates_the_classes(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        text, label = prose(i, rng.randint(5, 60)), int(i % 4 > 0)
        if not label:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 8 else ("bla bla " + text.split()[0] + " ") * 20
        rows.append((i, text, "x", i))
        labels.append((i, label, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, score int")
    known = spark.createDataFrame(labels + [(999, None, 1), (1, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(docs, known).toPandas()
    held = got[got.held_out]
    assert set(got.columns[:4]) == {"doc_id", "held_out", "score", "predicted"} and len(held) > 20
    assert ((held.doc_id % 4 > 0) == (held.predicted == 1)).mean() > 0.95
    assert got.held_out.tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    kept = quality.accepted(docs, known)
    assert kept.columns == docs.columns and kept.count() == (got.predicted == 1).sum()


def test_quality_without_labels_or_rows(spark, docs, empty, texts):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == len(texts) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(empty, none).count() == 0 and quality.accepted(empty, one).count() == 0


def test_language_of_mixtures(spark):
    rng = random.Random(9)
    vocab = {"aa": [f"the{c}ing" for c in "bcdfgh"], "bb": [f"{c}ung" for c in "klmnpr"], "cc": [f"ción{c}o" for c in "stvxyz"]}
    rows = []
    for i in range(180):
        lang = rng.choice(sorted(vocab))
        other = rng.choice(sorted(vocab))
        rows.append((i, " ".join([rng.choice(vocab[lang]) for _ in range(30)] + [rng.choice(vocab[other]) for _ in range(8)]), lang))
    rows += [(500, None, "aa"), (501, "", None), (502, "123 -- 456", None), (503, "—— 12", None), (504, "日本", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).toPandas().set_index("doc_id")
    truth = pd.Series({r[0]: r[2] for r in rows[:180]})
    assert (got.lang_pred[truth.index] == truth).mean() > 0.98
    assert [got.lang_pred[i] for i in (500, 501, 502, 503)] == ["und"] * 4 and got.lang_pred[504] != "und"
    assert got.score.between(0, 1).all() and (got.score[got.lang_pred == "und"] == 0).all()
    assert got.held_out.tolist() == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.index]


def test_mixture_proportions_are_those_of_the_words():
    rng = np.random.default_rng(2)
    near = np.where(rng.random((400, 1)) < 0.7, [[0.0, -9.0, -9.0]], [[-9.0, 0.0, -9.0]]).astype(np.float32)
    share = language.mixtures(near, np.array([0, 0, 400, 400]))
    assert abs(share[1, 0] - (near[:, 0] == 0).mean()) < 0.01 and share[1, 2] == 0 and (share[[0, 2]] == 0).all()


def test_language_without_training_rows(docs, empty, texts):
    got = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(texts) and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify(empty).count() == 0


# 3 near-duplicates


def fingerprint(text) -> int:
    w = WHITE.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_match_brute_force(docs, texts):
    fps = [fingerprint(t) for _, t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (d, _), g in zip(texts, group):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    want = [(d, f"{f:016x}", least[g]) for (d, _), f, g in zip(texts, fps, group)]
    assert rows_of(simhash.digest(simhash.near_duplicates(docs))) == sorted(want, key=repr)


def test_ball_hashing_links_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [base]
    for bits in range(1, 7):
        for b in base[:30]:
            flip = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64))
            fps.append(np.array([b ^ flip]))
    fps = np.unique(np.concatenate(fps))
    near = np.array(simhash.flips(16, 2))
    bucket = ((fps >> np.uint64(48)).astype(np.int64)[:, None] ^ near).reshape(-1)
    a, b = simhash.meet(bucket, np.repeat(fps, len(near)), 16, 4)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    got = {find(int(f)) for f in fps}
    want = {int(f): int(f) for f in fps}
    for _ in range(8):
        for x in fps:
            close = fps[np.bitwise_count(fps ^ x) <= 4]
            low = min(want[int(c)] for c in close)
            for c in close:
                want[int(c)] = min(want[int(c)], low)
    assert len(got) == len(set(want.values()))
    assert len({(find(int(f)), want[int(f)]) for f in fps}) == len(got)


def one_prefix(n: int) -> np.ndarray:
    """Fingerprints around one value, all with its 16-bit prefix."""
    rng = np.random.default_rng(8)
    spots = rng.permuted(np.tile(np.arange(48), (n, 1)), axis=1)[:, :4].astype(np.uint64)
    return np.unique(np.uint64(0xFACE << 48 | 0x123456789ABC) ^ np.bitwise_or.reduce(np.uint64(1) << spots, axis=1))


def grouped(a, b) -> list[tuple]:
    """Groups of the links' ends, as sorted tuples."""
    low, high = simhash.forest(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    ends, roots = np.concatenate((low, high)), np.concatenate((high, high))
    return sorted({tuple(np.unique(ends[roots == r]).tolist()) for r in np.unique(roots)})


def close_pairs(fps: np.ndarray):
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    return fps[x], fps[y]


def test_one_prefix_is_expanded_in_bounded_pieces(monkeypatch):
    fps = one_prefix(3000)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 15)
    tracemalloc.start()
    a, b = simhash.meet(np.full(len(fps), 0xFACE), fps, 16, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and grouped(a, b) == grouped(*close_pairs(fps))


def test_large_prefix_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_PER_TASK", 1 << 13)
    monkeypatch.setattr(simhash, "ROWS_PER_TASK", 1 << 8)
    rng = np.random.default_rng(9)
    far = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = one_prefix(800)
    near ^= rng.integers(0, 256, len(near), dtype=np.uint64) << np.uint64(20)
    fps = np.unique(np.concatenate((near, near[:200] ^ np.uint64(3 << 47), far, far ^ np.uint64(5 << 46))))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint").cache()
    cut = simhash.cuts(frame)
    assert 0xFACE in dict(cut)
    assert max(r["count"] for r in simhash.sent_to(frame, cut).groupBy("base").count().collect()) < 500  # uncut, 1,000
    found = np.array([(r.a, r.b) for r in simhash.links(frame, len(fps)).collect()], np.int64).view(np.uint64)
    assert grouped(found[:, 0], found[:, 1]) == grouped(*close_pairs(fps))


def test_one_of_each_group_stays(docs, empty, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[13] and ids[None] == 2
    assert ids[7] == 1 and not ids[8] and not ids[9]  # no words: fingerprint zero
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# 4 decontamination


def test_contamination_matches_brute_force(spark, docs, empty, texts):
    passage = next(t for d, t in texts if d == 6).split(" ")
    items = [(1, " ".join(passage[10:30])), (2, "One"), (3, None), (4, ""), (5, " ".join(passage[50:54])), (10, prose(99, 25)), (None, "one"),
             (11, "of, OF of of of of of of of of of"), (11, " ".join(passage[10:30])), (12, " ".join(passage[40:50]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for d, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for item, u in items:
            v = ALNUM.findall((u or "").translate(LOWER))
            if not v or item is None:
                continue
            k = min(10, len(v))
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    names.add(str(item))
        want.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    got = decontamination.digest(decontamination.contamination(docs, benchmark))
    assert rows_of(got) == sorted(want, key=repr)
    assert decontamination.clean(docs, benchmark).count() == sum(not w[-1] for w in want)
    none = benchmark.where("false")
    assert decontamination.clean(docs, none).count() == len(texts)
    assert decontamination.contamination(empty, benchmark).count() == 0


def test_items_with_a_null_id_are_hits(spark):
    passage, plain = prose(301, 30), prose(302, 40)
    benchmark = spark.createDataFrame([(None, passage), (None, "zebra"), (7, prose(303, 25))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{plain} {passage} {plain}"), (2, f"{plain} zebra"), (3, plain)], "doc_id bigint, text string")
    found = decontamination.digest(decontamination.contamination(docs, benchmark))
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()} == {1: (30, 0, True), 2: (1, 0, True), 3: (0, 0, False)}
    assert [r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()] == [3]


# 5 token files


def token_rows(texts):
    from tokenizers import Tokenizer

    plain, at, out = Tokenizer.from_file(WORD_BPE), 0, []
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(docs, empty, texts, folder):
    manifest = token_files.write_tokens(docs, f"{folder}/tokens", WORD_BPE)
    want = token_rows(texts)
    assert rows_of(token_files.digest(token_files.read_tokens(manifest))) == sorted(want, key=repr)
    some = token_files.digest(token_files.read_tokens(manifest, [4, 12, 77]))
    assert rows_of(some) == sorted((w for w in want if w[0] in (4, 12)), key=repr)
    assert token_files.read_tokens(manifest, []).count() == 0
    assert token_files.token_digest(empty, WORD_BPE).count() == 0


def test_frames_are_independent_and_checked(folder):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(1)
    parts = [(i if i % 5 else None, rng.integers(0, 50_000, int(n)).astype(np.uint32)) for i, n in enumerate(rng.integers(1, 60_000, 12))]
    path = f"{folder}/a.zst"
    with pafs.LocalFileSystem().open_output_stream(path, compression=None) as sink:
        writer = token_files.FrameWriter(sink)
        for doc_id, ids in parts:
            writer.add(doc_id, ids)
        writer.close()
    reader = token_files.FrameReader(pafs.LocalFileSystem().open_input_file(path))
    assert [(d, ids.tolist()) for d, _, ids in reader.documents()] == [(d, ids.tolist()) for d, ids in parts]
    opened = []
    frame, reader.frame = reader.frame, lambda k: opened.append(k) or frame(k)
    assert [d for d, _, _ in reader.documents({11})] == [11] and len(opened) == 1 < len(reader.frames)
    raw = bytearray(Path(path).read_bytes())
    raw[int(reader.offsets[1]) + 40] ^= 1
    Path(path).write_bytes(raw)
    with pytest.raises(Exception):
        list(token_files.FrameReader(pafs.LocalFileSystem().open_input_file(path)).documents())


def test_chunk_encoder_equals_the_library(monkeypatch, texts):
    from tokenizers import Tokenizer

    import transit_spark.llm.tokens as tokens

    monkeypatch.setattr(tokens, "KEPT", 40)  # generations change often
    plain, own = Tokenizer.from_file(WORD_BPE), ChunkEncoder(WORD_BPE)
    odd = ["It's DON'T 3.14 a.b. ...x!! ΑΣ Σ İ ﬁ", "a\x1cb\x0bc\x85d e", "é ́x", "<|startoftext|>hi<|endoftext|>", "\x00\x01", "end.,!? A.B"]
    for batch in ([t for _, t in texts], odd, [prose(i, 30) for i in range(20)], odd):
        ids, sizes = own.encode(batch)
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in batch]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# 6 sharding


def test_shards_match_the_mixture(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(1000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), n_shards=7).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for shard, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    share = got.groupby("source").size() / len(got)
    assert (abs(by - np.outer(share, sizes)) <= 2.0).all().all()


def test_shards_edge_cases(docs, empty, texts):
    got = sharding.digest(sharding.shards(docs)).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"rows"}
    assert Counter(got["size"]) == Counter(len((t or "").encode()) + 1 for _, t in texts)
    assert Counter(got.text_crc32) == Counter(zlib.crc32((t or "").encode()) for _, t in texts)
    plan = sharding.shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.shards(empty).count() == 0


# 7 pieces


def segmentations(voc, raw: bytes, ids: dict) -> list[tuple[tuple, float]]:
    if not raw:
        return [((), 0.0)]
    return [((ids[raw[:n]], *rest), voc.weight[ids[raw[:n]]] + w) for n in range(1, len(raw) + 1) if raw[:n] in ids for rest, w in segmentations(voc, raw[n:], ids)]


def drawn(voc, texts, seeds, k):
    split = [pieces.chunks_of(t) for t in texts]
    flat = [c for cs in split for c in cs]
    known = {c: n for n, c in enumerate(dict.fromkeys(flat))}
    lat = pieces.lattice([(pieces.SPACE + c).encode() for c in known], voc)
    chunk = np.array([known[c] for c in flat], np.int64)
    paths, bar = pieces.samples_of(lat, chunk, np.cumsum([0, *map(len, split)]), np.array(seeds, np.uint64), k)
    return [[(tuple(pieces.ids_of(lat, voc, p.edges)[0].tolist()), p.log_p, p.value) for p in found] for found in paths], bar


def test_samples_without_replacement_have_exact_probabilities():
    voc = pieces.vocabulary(PIECES)
    flat = pieces.Vocabulary(PIECES)
    flat.weight = voc.weight * 0.25  # an even distribution, so that rare ones are seen too
    ids = {r: i for i, r in enumerate(voc.raw) if r and i >= 259}
    every = segmentations(flat, "▁of▁it".encode(), ids)
    total = np.logaddexp.reduce([w for _, w in every])
    p = {s: float(np.exp(w - total)) for s, w in every}
    n = 6000
    found, bar = drawn(flat, ["of it"] * n, range(1, n + 1), 3)
    first, pairs, weight = Counter(), Counter(), Counter()
    for d, samples in enumerate(found):
        assert len({s for s, _, _ in samples}) == 3 and all(a[2] > b[2] for a, b in zip(samples, samples[1:])) and samples[-1][2] > bar[d]
        first[samples[0][0]] += 1
        pairs[samples[0][0], samples[1][0]] += 1
        for s, q, _ in samples:
            assert abs(np.log(p[s]) - q) < 1e-9
            weight[s] += 1 / -np.expm1(-np.exp(q - bar[d]))
    for s in p:
        assert abs(first[s] / n - p[s]) < 5 * np.sqrt(p[s] / n) + 1e-3
        if p[s] > 0.02:
            assert abs(weight[s] / n - 1) < 0.15  # inverse inclusion weights are unbiased
    for (s, t), c in pairs.items():
        want = p[s] * p[t] / (1 - p[s])
        assert abs(c / n - want) < 5 * np.sqrt(want / n) + 1e-3


def test_pieces_decode_to_the_text(docs, empty, texts):
    got = pieces.encoded(docs, PIECES, k=3).collect()
    assert all(r.round_trip for r in got)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_pieces == 0), []).append(r)
    assert len(by[10, False]) == 3 and len({r.ids for r in by[10, False]}) == 3
    assert [r.sample for r in by[8, True]] == [1] and by[8, True][0].log_inclusion == 0
    again = pieces.encoded(docs.repartition(1), PIECES, k=3)
    assert rows_of(again) == sorted(map(tuple, got), key=repr)  # the same draws however rows are dealt
    shown = {(r.doc_id, r.decoded) for r in pieces.decoded(again, PIECES).collect()}
    assert shown == {(d, (t or "").replace("▁", " ")) for d, t in texts}
    assert pieces.encoded(empty, PIECES).count() == 0


def test_pieces_decode_as_the_library_does():
    import sentencepiece

    sp, voc = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.vocabulary(PIECES)
    for text in ("the cat  sat\n\n on", " lead", "日本 é 😀", "a" * 50):
        (samples,), _ = drawn(voc, [text], [5], 2)
        for ids, _, _ in samples:
            assert sp.decode(list(ids)) == voc.decode(np.array(ids)).decode() == text


def test_branches_of_all_texts_are_drawn_together(monkeypatch):
    voc = pieces.vocabulary(PIECES)
    texts, seeds = [prose(i, 6) for i in range(12)], list(range(1, 13))
    alone = [drawn(voc, [t], [s], 3) for t, s in zip(texts, seeds)]
    streams, uniform = [], pieces.uniform
    monkeypatch.setattr(pieces, "uniform", lambda seed, place, stream: (streams.append(stream), uniform(seed, place, stream))[1])
    samples, _ = drawn(voc, texts, seeds, 3)
    assert [[ids for ids, _, _ in found] for found in samples] == [[ids for ids, _, _ in found] for (found,), _ in alone]
    assert sorted(s for s in streams if s >= 1000) == [1000, 1001, 1003, 1004]  # not once more for each text


# 8 and 10 repeated passages


def substring_rows(texts, window=50):
    least = {}
    split = [(d, WHITE.findall(t or "")) for d, t in texts]
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_rows(texts, length=400):
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 2, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + length + 1] -= 1
        mask = np.cumsum(gone)[1:-1] > 0
        n_spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append((d, len(b), int(mask.sum()), n_spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])  # the small block sends anchors down the counted path
def test_repeated_passages_match_brute_force(docs, texts, block):
    assert rows_of(fm_index.digest(fm_index.without_repeats(docs, block=block))) == sorted(substring_rows(texts), key=repr)
    assert rows_of(suffix_dedup.digest(suffix_dedup.without_repeats(docs, block=block))) == sorted(suffix_rows(texts), key=repr)


def test_nothing_is_removed_that_no_search_has_found(docs, monkeypatch):
    def none(reach):
        return lambda block: [(later, np.ones(len(block.count)), np.zeros(len(block.count))) for later in (False, True)]

    for op in (fm_index, suffix_dedup):
        assert op.without_repeats(docs).agg({"n_removed": "sum"}).collect()[0][0] > 0
        monkeypatch.setattr(op, "search", none)
        assert op.without_repeats(docs).agg({"n_removed": "sum"}).collect()[0][0] == 0


@pytest.mark.parametrize("seed", range(6))
def test_searches_of_a_block_match_brute_force(seed):
    from transit_spark.llm import repeats

    rng = np.random.default_rng(seed)
    reach, m = 5, 40
    texts = [(rng.integers(0, 2, a), rng.integers(0, 2, b), int(g)) for a, b, g in rng.integers(0, [reach + 1, reach + 1, 3], (m, 3))]
    texts = list({(tuple(a), tuple(b), g): (a, b, g) for a, b, g in texts}.values())
    symbols = [np.concatenate((a, [2 + g], b)) for a, b, g in texts]
    n, least = rng.integers(1, 3, len(texts)), rng.permutation(len(texts)) // 2
    copied, asked = n > 1, rng.random(len(texts)) < 0.8
    block = repeats.Block(np.concatenate(symbols), np.cumsum([0, *map(len, symbols)]), n, least, asked, copied, 5)
    places = {}
    for s, x in enumerate(symbols):
        for at in range(len(x) - reach):
            places.setdefault(tuple(x[at : at + reach + 1]), []).append((s, at))

    def spans(wanted, ok):
        out = {}
        for where in places.values():
            for s, at in where:
                if wanted[s] and ok(s, where):
                    low, high = out.get(s, (at, at))
                    out[s] = min(low, at), max(high, at)
        return out

    def got(low, high):
        return {s: (int(low[s]), int(high[s])) for s in range(len(symbols)) if low[s] <= high[s]}

    (_, *all_), = suffix_dedup.search(reach)(block)
    assert got(*all_) == spans([True] * len(symbols), lambda s, where: sum(n[x] for x, _ in where) > 1)
    (_, *own), (_, *others) = fm_index.search(reach)(block)
    assert got(*own) == spans(asked, lambda s, where: min(least[x] for x, _ in where) < least[s])
    assert got(*others) == spans(copied, lambda s, where: True)


@pytest.mark.parametrize("narrow", [0, 3, 64])
def test_borders_match_brute_force_and_narrow_intervals_need_no_wavelet_matrix(monkeypatch, narrow):
    from transit_spark.llm.bwt import Transform, WaveletMatrix

    rng = np.random.default_rng(narrow)
    segments = [rng.integers(0, 3, size) for size in rng.integers(1, 30, 60)]
    segments += segments[:20]
    t = Transform(np.concatenate(segments), np.cumsum([0, *map(len, segments)]), 3, 9)
    tails = [t.joined[i : i + 9].tolist() for i in t.order]
    want = [False] + [a == b and len(a) == 9 for a, b in zip(tails, tails[1:])]
    monkeypatch.setattr(suffix_dedup, "NARROW", narrow)
    widths, distinct = [], WaveletMatrix.distinct

    def seen(self, low, high):
        widths.extend((high - low).tolist())
        return distinct(self, low, high)

    monkeypatch.setattr(WaveletMatrix, "distinct", seen)
    assert suffix_dedup.long_prefix_borders(t, 9).tolist() == want and any(want)
    assert len(widths) > 0 and min(widths) > narrow


@pytest.mark.parametrize("size", [1, 5, 1000, 1 << 21])  # three ranks of the last don't fit in 63 bits
def test_suffixes_are_ordered_by_their_first_symbols(size):
    from transit_spark.llm.bwt import suffix_order

    symbols = np.random.default_rng(size).integers(0, 1 << 20, size) >> 14
    symbols[size // 2 :] = symbols[: size - size // 2]
    order = suffix_order(symbols, 12)
    assert np.array_equal(np.sort(order), np.arange(size))
    padded = np.concatenate((symbols, np.full(12, -1)))
    undecided = np.arange(size - 1)
    for k in range(12):
        a, b = padded[np.minimum(order[undecided] + k, size)], padded[np.minimum(order[undecided + 1] + k, size)]
        assert (a <= b).all()
        undecided = undecided[a == b]


def test_cleaned_documents_keep_their_columns(docs, empty, texts):
    got = suffix_dedup.cleaned(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (None, 1)}
    assert by[12].text == next(t for d, t in texts if d == 12) and by[2].text == "" and by[12].n_chars == len(by[12].text) and by[12].fp == "fp"
    for op in (fm_index, suffix_dedup):
        assert op.without_repeats(empty).count() == 0


def test_wavelet_matrix_ranks():
    from transit_spark.llm.bwt import WaveletMatrix, suffix_order

    rng = np.random.default_rng(8)
    seq = rng.integers(0, 11, 300)
    w = WaveletMatrix(seq, 11)
    at = rng.integers(0, 301, 50)
    for c in range(11):
        assert w.rank(np.full(50, c), at).tolist() == [int((seq[:x] == c).sum()) for x in at]
    symbol, a, b = w.distinct(np.array([17]), np.array([60]))
    assert sorted(zip(symbol.tolist(), a.tolist(), b.tolist())) == [
        (c, int((seq[:17] == c).sum()), int((seq[:60] == c).sum())) for c in sorted(set(seq[17:60].tolist()))
    ]
    assert suffix_order(seq, 300).tolist() == sorted(range(300), key=lambda i: seq[i:].tolist())


# 9 neighbours


def test_neighbours_recall_and_order(spark, empty):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 24))).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [None] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [], 1), (2005, [1.0, 2.0], 1),
             (2006, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), (5, vectors[5].tolist(), 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = neighbours.neighbours(frame, frame.where("vec_id % 20 = 0 or vec_id > 1000")).toPandas()
    wide = vectors.astype(np.float64)
    cos = (wide @ wide.T) / np.outer(np.linalg.norm(wide, axis=1), np.linalg.norm(wide, axis=1))
    hits = []
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and q not in part.vec_id.tolist()
        assert np.allclose(part.score, cos[q, part.vec_id], atol=1e-12)
        assert sorted(zip(-part.score, part.vec_id)) == list(zip(-part.score, part.vec_id))
        others = [i for i in range(900) if i != q]
        best = sorted(others, key=lambda i: (-cos[q, i], i))[:5]
        hits.append(len(set(best) & set(part.vec_id)) / 5)
    assert set(got.query_id) == set(range(0, 900, 20)) and np.mean(hits) >= 0.9
    near = got[got.query_id == 120].sort_values("rank")
    assert near.vec_id.tolist() == [100, 101, 102, 103, 104]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.neighbours(none, none).count() == 0


def test_large_bucket_is_spread_and_queries_are_blocked(spark, monkeypatch):
    rng = np.random.default_rng(11)
    wide = rng.normal(size=24) + 0.001 * rng.normal(size=(600, 24))  # near, unequal: few buckets a table
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(neighbours, "PART_ENTRIES", 100)
    rows = frame.selectExpr("vec_id AS cid", "embedding")
    large = neighbours._large(neighbours._dealt(rows, 6, 1, False), 6)
    assert large
    dealt = neighbours._dealt(rows, 6, 1, False, large)
    assert max(r["count"] for r in dealt.groupBy("slice").count().collect()) < 250  # in one part, up to 600
    got = neighbours.neighbours(frame, frame.where("vec_id % 60 = 0")).toPandas()
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    for q, part in got.groupby("query_id"):
        best = sorted((i for i in range(600) if i != q), key=lambda i: -(unit[q] @ unit[i]))[:5]
        assert len(set(best) & set(part.vec_id)) >= 4
    assert len(got) == 50
    args = np.arange(600), wide, (np.arange(600), np.zeros(600, np.int64)), np.arange(600), wide, np.zeros(600, np.int64), 6
    whole = sorted(zip(*(c.tolist() for c in neighbours.compare(*args)[:2])))
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 50)
    monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", 1000)
    monkeypatch.setattr(neighbours, "ENTRIES_AT_ONCE", 128)
    assert sorted(zip(*(c.tolist() for c in neighbours.compare(*args)[:2]))) == whole
