"""Shared spans against a dictionary of all windows."""

import random

import pytest
from pyspark.sql import functions as F

from graphskein.llm import spans
from graphskein.llm.spans import shared_part, shared_spans


def plain(docs, span):
    owner, several = {}, set()
    for doc, text in docs:
        if doc is None or text is None:
            continue
        for i in range(len(text) - span + 1):
            w = text[i : i + span]
            if owner.setdefault(w, doc) != doc:
                several.add(w)
    out = set()
    for doc, text in docs:
        if doc is None or text is None:
            continue
        run = None
        for i in range(len(text) - span + 1):
            if text[i : i + span] in several:
                if run and i <= run[1]:
                    run[1] = i + span
                else:
                    if run:
                        out.add((doc, *run))
                    run = [i, i + span]
        if run:
            out.add((doc, *run))
    return sorted(out)


def check(spark, docs, span, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("r", F.lit("x")).withColumn("span_start", F.lit(1))
    got = sorted(tuple(r) for r in shared_spans(df, span, **how).collect())
    assert got == plain(docs, span)
    return got


def mosaic(r, n, alphabet, blocks, length):
    pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(5, length))) for _ in range(blocks)]
    return [(i, "".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(r.randrange(1, length))) for _ in range(r.randrange(0, 12)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "span", "gram"), [(1, 20, None), (2, 20, 20), (3, 31, 8), (4, 5, 1)])
def test_mosaics(spark, seed, span, gram):
    docs = mosaic(random.Random(seed), 120, "abcdefgh é😀\n", 25, 60)
    assert check(spark, docs, span, gram=gram)


def test_few_letters(spark):
    docs = mosaic(random.Random(5), 60, "ab", 10, 40) + [(1000, "a" * 300), (1001, "b" + "a" * 150 + "c"), (1002, "ab" * 100)]
    assert check(spark, docs, 12)


def test_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(spans, "PIECE", 64)
    monkeypatch.setattr(spans, "CHUNK", 128)
    word = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    common = word(500)
    docs = [(1, word(90) + common + word(70)), (2, word(13) + common), (3, common[100:300] + word(50) + common[20:45]), (4, word(400))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    batch = table.toPandas()
    found = set()
    # in this process, where the sizes are changed
    for cp, where in spans.pieces(batch.doc_id.to_numpy(), batch.text.tolist(), 25):
        seg = spans.Segments(cp, where, 25, 16)
        assert len(cp) <= 128 + 64
        for text, lo, n in zip(seg.text, seg.lo, seg.n):
            found.update((int(text), int(lo) + i) for i in range(int(n) + 1))
    assert found == {(k, i) for k, (_, t) in enumerate(docs) for i in range(len(t) - 24)}


def test_special_rows(spark):
    t = "".join(random.Random(7).choice("abcdefghij") for _ in range(60))
    docs = [(1, t), (1, t), (2, None), (3, ""), (4, t[:19]), (None, t), (5, t + t)]
    assert check(spark, docs, 20) == [(1, 0, 60), (5, 0, 120)]
    assert check(spark, [(1, t), (1, t), (1, "x" + t), (2, "y" * 30)], 20) == []
    assert check(spark, [], 20) == []
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 10, gram=11)


def test_exactly_the_least_length(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    for n in (39, 40, 41):
        x = word(n)
        assert bool(check(spark, [(1, word(50) + "-" + x + "+" + word(9)), (2, word(7) + "/" + x + "!" + word(80))], 40)) == (n >= 40)


def test_touching_and_changing_partners(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    a, b, c = word(30), word(30), word(25)
    docs = [(1, a + b + c), (2, a + "1"), (3, "2" + b), (4, a[10:] + b[:15]), (5, c[:24])]
    assert (1, 0, 60) in check(spark, docs, 25)


def test_share_of_each_text(spark):
    docs = spark.createDataFrame([(1, "abcdefgh12"), (2, "xabcdefghx"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.n_shared, r.share) for r in shared_part(docs, shared_spans(docs, 6)).collect()}
    assert got == {1: (10, 8, 0.8), 2: (10, 8, 0.8), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}
