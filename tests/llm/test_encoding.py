"""Encoding against the public library, over the corpus and over hand-made texts."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphskein.llm import bpe
from graphskein.llm.encoding import VOCABULARY, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "  a  b ", "it's don't we're I'll I've he'd I'm", "''s 's  's x's'st '''re", "'", "'r", "'re", "'LL 'S", "a'll'", "'sæ 'træ", "\t\n  \r\n a", "a　b  c\x1cd\x85e",
    "<|endoftext|> x<|endoftext|>", "x" * 700, "ab" * 900, "aaa " * 300, "١٢٣ ½² 12a3", "日本語のテキスト" * 80, "é é ﻿", "🤷🏽‍♀️!?!?", "=" * 1500, "\\frac{a}{b} $x^{2}_{ij}$ % note", " " * 400 + "x",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts):
    e = bpe.encoder(VOCABULARY)
    words, per_text = e.encode_texts(texts)
    return [x.tolist() for x in np.split(e.gather(words), np.cumsum(e.lengths(words, per_text))[:-1])]


def test_hand_made_texts(library):
    assert ours(TEXTS) == library(TEXTS)
    for t in TEXTS:
        assert ours([t]) == library([t])


def test_every_code_point(library):
    points = [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00), *range(0x2F800, 0x2FA20)]
    texts = ["".join(map(chr, points[i : i + 61])) for i in range(0, len(points), 61)] + ["".join(f"{chr(p)} {chr(p)}{chr(p)}'s" for p in points[i : i + 61]) for i in range(0, len(points), 61)]
    assert ours(texts) == library(texts)


def test_random_texts(library):
    r = random.Random(5)
    alphabet = "aeiou  \n'strmdlv.,-=0123456789é🤷　{}\\$"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(3000)]
    assert ours(texts) == library(texts)


def test_forgetting_and_growing_tables(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 64)
    e = bpe.Encoder(VOCABULARY)
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(60)) for _ in range(40)]
    for k in range(0, 40, 10):
        words, per_text = e.encode_texts(texts[k : k + 10])
        assert e.gather(words).tolist() == [i for ids in library(texts[k : k + 10]) for i in ids]


def test_matrix_and_single_word_ways_agree(monkeypatch):
    texts = ["x" * 200, "abab" * 60, "日本語" * 30, "internationalisation" * 12, "=" * 255]
    e = bpe.Encoder(VOCABULARY)
    a = [e.gather(e.encode_texts([t])[0]).tolist() for t in texts]
    monkeypatch.setattr(bpe, "LONG_WORD", 4)
    e = bpe.Encoder(VOCABULARY)
    assert a == [e.gather(e.encode_texts([t])[0]).tolist() for t in texts]


def test_over_the_corpus(spark, library):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.ids for r in token_ids(docs).collect()}
    table = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    assert got == dict(zip(table["doc_id"], library(table["text"])))
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_rows_in_rows_out(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("id", F.lit(0)).withColumn("out", F.lit(0))
    got = sorted((r.doc_id or 0, len(r.ids)) for r in token_ids(df).collect())
    assert got == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert token_ids(df.limit(0)).count() == 0
    assert token_ids(df).columns == ["doc_id", "ids"] and dict(token_ids(df).dtypes)["ids"] == "array<int>"
