"""Chunks looked up by their bytes give the library's ids, whatever is kept and forgotten."""

import random

import numpy as np
import pyarrow as pa

from transit_spark.llm import tokens
from transit_spark.llm.tokens import ChunkEncoder

from test_llm_operators import WORD_BPE, prose


def library(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    return [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def split(ids, sizes):
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


ODD = [None, "", " \t\r\n", "a", "a b", "abcdefghijklmnop abcdefghijklmnopq", "exactly-16-bytes 16\x00zero\x00bytes a\x00 \x00a \x00", "Word WORD word, word.", "a\x0bb c\x0cd",
       "a\xa0b　c\x85d", "\x1c\x1d x\x1ey", "日本語 日本語です これは長い日本語の文章です", "é ÉÉÉ ß", "x" * 5000, "<|endoftext|>a b<|endoftext|>", "🎉🎉🎉🎉 🎉"]


def test_ids_are_the_librarys():
    encoder, want = ChunkEncoder(WORD_BPE), library(ODD)
    assert split(*encoder.encode(ODD)) == want
    assert split(*encoder.encode(pa.array(["skipped", *ODD, "x"], pa.large_string()).slice(1, len(ODD)))) == want
    assert encoder.encode([])[1].tolist() == []


def test_small_tables_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "Word,", prose(i * 7 + j, 1), f"n{i}"]) for j in range(40)) for i in range(120)]
    want = library(texts)
    for kept, merged in ((1 << 21, 1 << 15), (60, 4), (700, 16)):
        monkeypatch.setattr(tokens, "KEPT_CHUNKS", kept)
        monkeypatch.setattr(tokens, "MERGED", merged)
        encoder = ChunkEncoder(WORD_BPE)
        got = [part for i in range(0, 120, 10) for part in split(*encoder.encode(texts[i : i + 10]))]
        assert got == want
