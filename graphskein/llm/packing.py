"""Items into containers of fixed capacity: dominance reduction, then best fit, over the histogram of sizes.

Sizes are whole numbers up to the capacity, so an instance of any number of items is a histogram of at most
``capacity`` entries. The packing is found on that histogram, with multiplicities; its work and result depend on the capacity,
not on the number of items. Items then take their places by their rank among the items of their size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphskein.llm.encoding import VOCABULARY, token_counts
from graphskein.plans.scratch import cut

#: A packing: (items of a container as ((size, number), ...), number of such containers)
Packing = list[tuple[tuple[tuple[int, int], ...], int]]


class _Sizes:
    """A histogram with its sizes in order."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, most: int, used: dict[int, int] | None = None) -> int:
        """The largest size of at most ``most`` with an item beyond those ``used``; 0 if there is none."""
        k = bisect_left(self.order, most + 1) - 1
        while k >= 0 and used and self.n[self.order[k]] <= used.get(self.order[k], 0):
            k -= 1
        return self.order[k] if k >= 0 else 0

    def smallest_sum(self, items: int, without: int, above: int = 0) -> float:
        """The sum of the ``items`` smallest items larger than ``above``, beside one of size ``without``; infinite if
        there are fewer."""
        total, left = 0, items
        for s in self.order[bisect_left(self.order, above + 1) :]:
            c = min(left, self.n[s] - (s == without))
            total, left = total + s * c, left - c
            if not left:
                return total
        return float("inf")


def best_pair(sizes: _Sizes, room: int, without: int) -> tuple[int, int]:
    """The two items of greatest sum of at most ``room``, beside one of size ``without``; (0, 0) if none fit."""
    best, pair, order = 0, (0, 0), sizes.order
    j = bisect_left(order, room) - 1
    i = 0
    while i <= j and best < room:
        a, b = order[i], order[j]
        need = {a: 1}
        need[b] = need.get(b, 0) + 1
        if a + b > room:
            j -= 1
        elif any(sizes.n[s] - (s == without) < c for s, c in need.items()):
            # one item of this size only: neighbours of it are tried on both sides
            if i < j:
                i, j = (i + 1, j) if sizes.n[a] - (a == without) < need[a] else (i, j - 1)
            else:
                break
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
            i += 1
    return pair


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[Packing, dict[int, int]]:
    """Fixes containers that some best packing holds, and gives them with the histogram of what is left.

    By falling size j, with room = capacity - j for companions, after Martello and Toth's dominance criterion (a set of
    companions may be exchanged for one item at least as large as their sum, item by item):
    - no item fits beside j: {j} is fixed;
    - the largest fitting item k fills the room, or no two items fit, or no three fit and k is at least as large as the
      best fitting pair: {j, k} is fixed;
    - no three fit, the best fitting pair is (k, b), and no two items that are both larger than b fit: {j, k, b} is
      fixed, since any fitting pair is item by item no larger.
    Taking items away only makes these conditions easier, so equal containers are fixed as often as their items allow.
    """
    sizes, fixed, done = _Sizes(histogram), [], capacity + 1
    while True:
        at = bisect_left(sizes.order, done) - 1
        if at < 0:
            return fixed, dict(sizes.n)
        j = sizes.order[at]
        room = capacity - j
        k = sizes.largest(room, {j: 1})
        if not k:
            fixed.append((((j, 1),), sizes.n[j]))
            sizes.take(j, sizes.n[j])
            continue
        two, three = sizes.smallest_sum(2, j), sizes.smallest_sum(3, j)
        chosen: tuple[int, ...] = ()
        if k == room or two > room:
            chosen = (j, k)
        elif three > room:
            a, b = best_pair(sizes, room, j)
            if k >= a + b:
                chosen = (j, k)
            elif k == max(a, b) and sizes.smallest_sum(2, j, min(a, b)) > room:
                chosen = (j, a, b)
        if not chosen:
            done = j
            continue
        need: dict[int, int] = {}
        for s in chosen:
            need[s] = need.get(s, 0) + 1
        times = min(sizes.n[s] // c for s, c in need.items())
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))
        for s, c in need.items():
            sizes.take(s, c * times)


def best_fit(histogram: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing: every item goes into the fullest container it fits in; containers with equal room and
    contents are one entry with a number."""
    open_: dict[int, list[list]] = {}  # room left -> [contents, number]
    rooms: list[int] = []

    def put(room: int, contents: tuple, number: int) -> None:
        if number:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append([contents, number])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put(capacity - each * size, ((size, each),), left // each)
                put(capacity - left % each * size, ((size, left % each),), int(left % each > 0))
                break
            room = rooms[at]
            contents, number = entry = open_[room][-1]
            each = room // size
            full = min(number, left // each)
            some = left - full * each if full < number and left - full * each < each else 0
            entry[1] -= full + (some > 0)
            if not entry[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            put(room - each * size, contents + ((size, each),), full)
            put(room - some * size, contents + ((size, some),), int(some > 0))
            left -= full * each + some
    return [(contents, number) for room in rooms for contents, number in open_[room]]


def pack_histogram(histogram: dict[int, int], capacity: int) -> Packing:
    """A packing of all items of ``histogram``: the reduction's containers, then best fit of the rest."""
    fixed, rest = reduce_dominated(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def _places(packing: Packing) -> np.ndarray:
    """Rows (size, first rank, first container, items a container): the items of a size, by rank, in containers."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for contents, number in packing:
        for size, each in contents:
            rows.append((size, ranks.get(size, 0), first, each))
            ranks[size] = ranks.get(size, 0) + each * number
        first += number
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(sized: DataFrame, id_col: str, size_col: str, capacity: int, *, salts: int = 32) -> DataFrame:
    """``id_col, piece, start, size, container``: every item of positive size in a container of ``capacity``.

    An item larger than ``capacity`` is split into pieces of ``capacity`` and one of the rest, numbered from 0, with
    ``start`` counted in the item; no other item is split. Items of size 0, null or less need no container and give no row.
    Rows repeat as they do in the input. Containers are numbered from 0. An empty table gives no rows.

    The driver sees only the histogram by size and salt, ``capacity * salts`` numbers; ranks are counted within size
    and salt, so no task holds all items of a size, and get the counts before them added.
    """
    items = sized.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n"))
    pieces = items.select("id", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity))).alias("piece", "_p"), "n")
    pieces = pieces.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counted = pieces.groupBy("size", "salt").count().collect()
    by_salt = np.zeros((capacity + 1, salts), np.int64)
    for r in counted:
        by_salt[r[0], r[1]] = r[2]
    total = by_salt.sum(1)
    before = np.cumsum(by_salt, 1) - by_salt
    places = _places(pack_histogram({int(s): int(total[s]) for s in np.flatnonzero(total)}, capacity))
    key = (places[:, 0] << 40) | places[:, 1]  # ranks of a size stay below 2**40
    if int(total.max(initial=0)) >= 1 << 40:
        raise ValueError("too many items of one size")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, salt, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            rank = rank - 1 + before[size, salt]
            row = places[np.searchsorted(key, (size << 40) | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(row[:, 2] + (rank - row[:, 1]) // row[:, 3])], ["id", "piece", "start", "size", "container"])

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece")))
    out = ranked.mapInArrow(placed, f"id {sized.schema[id_col].dataType.simpleString()}, piece int, start long, size int, container long")
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """:func:`pack` of the whole texts, sized in tokens of the vocabulary in ``path``; texts without tokens give no row."""
    return pack(cut(token_counts(docs, id_col, text_col, path).where("n_tokens > 0")), id_col, "n_tokens", capacity)
