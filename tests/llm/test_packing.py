"""Packing: whole items, no container too full, and close to the best on small cases."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphskein.llm.packing import best_fit, best_pair, pack, pack_documents, pack_histogram, reduce_dominated, _Sizes


def containers(packing):
    return sum(n for _, n in packing)


def contents(packing):
    out = Counter()
    for items, n in packing:
        for size, each in items:
            out[size] += each * n
    return +out


def fewest(sizes, capacity):
    """The least number of containers, by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(20, 30))
def test_reduction_keeps_a_best_packing(sizes, capacity):
    fixed, rest = reduce_dominated(Counter(sizes), capacity)
    assert contents(fixed) + Counter(rest) == Counter(sizes)
    assert all(sum(s * n for s, n in items) <= capacity for items, _ in fixed)
    assert containers(fixed) + fewest(list(Counter(rest).elements()), capacity) == fewest(sizes, capacity)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
def test_best_fit_places_every_item(histogram):
    packing = best_fit(histogram, 60)
    assert contents(packing) == Counter(histogram)
    assert all(sum(s * n for s, n in items) <= 60 for items, _ in packing)
    # the same as placing item by item
    rooms = []
    for size in sorted(Counter(histogram).elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(60 - size)
    assert containers(packing) == len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=8), st.integers(2, 40), st.data())
def test_best_pair_against_all_pairs(histogram, room, data):
    without = data.draw(st.sampled_from(sorted(histogram)))
    left = list((Counter(histogram) - Counter([without])).elements())
    want = max((a + b for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room), default=0)
    assert sum(best_pair(_Sizes(histogram), room, without)) == want


def test_large_histogram_is_close_to_full():
    r = random.Random(3)
    h = Counter(min(4096, int(r.lognormvariate(6.8, 0.9)) + 1) for _ in range(20_000))
    packing = pack_histogram(h, 4096)
    assert contents(packing) == h
    bound = -(-sum(s * n for s, n in h.items()) // 4096)
    assert containers(packing) <= bound * 1.01


def check(rows, sizes, capacity):
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.container] += r.size
        parts[r.doc_id].append((r.piece, r.start, r.size))
    assert all(0 < u <= capacity for u in used.values()) and set(used) == set(range(len(used)))
    for doc, n in sizes.items():
        got = sorted(parts.pop(doc, []))
        want = [(i, i * capacity, min(capacity, n - i * capacity)) for i in range(-(-n // capacity))] if n else []
        assert got == want
    assert not parts
    return len(used)


def test_items_are_split_only_if_too_large(spark):
    r = random.Random(4)
    sizes = {i: (0 if i % 50 == 0 else r.choice([1, 7, 50, 99, 100, 101, 250, 1000, r.randrange(1, 100)])) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").withColumn("container", F.lit("x")).withColumn("size", F.lit(1))
    for salts in (1, 5):
        check(pack(df, "doc_id", "n_tokens", 100, salts=salts).collect(), sizes, 100)


def test_one_size_only_and_nothing(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_tokens"))
    assert check(pack(df, "doc_id", "n_tokens", 100).collect(), {i: 30 for i in range(1000)}, 100) == 334
    empty = spark.createDataFrame([(1, 0), (2, None), (3, -5)], "doc_id long, n_tokens long")
    assert pack(empty, "doc_id", "n_tokens", 100).count() == 0
    assert pack(empty.limit(0), "doc_id", "n_tokens", 100).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x y " * 3000)], "doc_id long, text string")
    rows = pack_documents(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.doc_id] += r.size
    assert sizes[1] == 3 and sizes[4] > 4096 and set(sizes) == {1, 4}
    check(rows, sizes, 4096)


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_capacity(spark, capacity):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "doc_id long, n_tokens long")
    assert check(pack(df, "doc_id", "n_tokens", capacity).collect(), {1: 3, 2: 1, 3: 1}, capacity) == (5 if capacity == 1 else 3)
