"""Searches from many sources over a graph small enough to be broadcast.

All-pairs results are the square of the number of vertices, so their graphs are small beside them. If the edges are at
most a given number (checked by a count before anything is collected), adjacency arrays are broadcast and the
sources are spread over tasks, each of which searches from its sources one after the other; larger graphs
take the relational loops of ``paths`` and ``betweenness``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edges up to which adjacency arrays are broadcast: 12 bytes each, so at most 24 MB beside the ids.
KERNEL_EDGES = 2_000_000
#: Rows of results sent at once.
BATCH_ROWS = 1 << 16


@dataclass
class Adjacency:
    """Neighbours of vertex i are ``to[start[i]:start[i + 1]]``, by numbers; ``ids[i]`` is its id; ``times`` are edge multiplicities."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, edges: DataFrame, most: int) -> Adjacency | None:
        """From ``src, dst, m`` without repetitions; None if there are more than ``most``."""
        if most <= 0 or edges.count() > most:
            return None
        t = edges.select("src", "dst", "m").toPandas()
        number, ids = pd.factorize(pd.concat([t["src"], t["dst"]], ignore_index=True))
        src, dst = number[: len(t)], number[len(t) :]
        order = np.argsort(src, kind="stable")
        return cls(np.asarray(ids), np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order].astype(np.int32), t["m"].to_numpy(np.float64)[order])

    def out(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``to`` of all edges from ``front``, and for each the place of its start in ``front``."""
        lo, size = self.start[front], self.start[front + 1] - self.start[front]
        return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(front)), size)

    def layers(self, source: int, seen: np.ndarray, depth: int | None = None) -> Iterator[np.ndarray]:
        """Vertices by their distance from ``source``. ``seen`` is all False and is so again at the end."""
        front, all_ = np.array([source]), []
        seen[source] = True
        while len(front) and (depth is None or len(all_) <= depth):
            all_.append(front)
            yield front
            near = self.to[self.out(front)[0]]
            front = np.unique(near[~seen[near]])
            seen[front] = True
        seen[front] = False
        for f in all_:
            seen[f] = False

    def dependencies(self, source: int, depth_of: np.ndarray, paths: np.ndarray, part: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vertices reached, and what each contributes to shortest paths from ``source`` to all others, which count by
        ``weight`` (Brandes). ``depth_of`` is all -1, ``paths`` and ``part`` 0, and are so again; ``slot`` is room for numbers."""
        front, layers, edges = np.array([source]), [], []
        depth_of[source], paths[source] = 0, 1.0
        while len(front):
            layers.append(front)
            at, of = self.out(front)
            near = self.to[at]
            new = near[depth_of[near] < 0]
            slot[new] = np.arange(len(new))
            fresh = new[slot[new] == np.arange(len(new))]
            depth_of[fresh] = len(layers)
            on = np.flatnonzero(depth_of[near] == len(layers))
            a, near, times = front[of[on]], near[on], self.times[at[on]]
            np.add.at(paths, near, paths[a] * times)
            edges.append((a, near, times))
            front = fresh
        for a, near, times in reversed(edges):
            np.add.at(part, a, paths[a] / paths[near] * times * (weight[near] + part[near]))
        reached = np.concatenate(layers)
        part[source] = 0.0
        found = part[reached]
        depth_of[reached], paths[reached], part[reached] = -1, 0.0, 0.0
        return reached, found

    def blocks(self, starts: np.ndarray) -> Blocks:
        """The blocks (without a cut vertex of their own) of three vertices or more of a graph with every edge in both directions. ``starts``: whether a vertex is a source."""
        n = len(self.ids)
        lo, to = self.start.tolist(), self.to.tolist()
        seen, low, at, above = [-1] * n, [0] * n, list(lo[:-1]), [-1] * n
        # what hangs on each vertex through blocks below it, as sources and as targets, with itself
        hang_s, hang_t = starts.astype(int).tolist(), [1] * n
        pairs = [0] * n  # of a source and a target in the same branch
        found, clock = [], 0
        for root in range(n):
            if seen[root] >= 0:
                continue
            open_, trail, cut_off = [root], [root], []
            seen[root] = low[root] = clock
            clock += 1
            while trail:
                v = trail[-1]
                if at[v] < lo[v + 1]:
                    w = to[at[v]]
                    at[v] += 1
                    if seen[w] < 0:
                        seen[w] = low[w] = clock
                        clock += 1
                        above[w] = v
                        trail.append(w)
                        open_.append(w)
                    elif w != above[v] and seen[w] < low[v]:
                        low[v] = seen[w]
                    continue
                trail.pop()
                if (u := above[v]) < 0:
                    continue
                low[u] = min(low[u], low[v])
                if low[v] >= seen[u]:
                    i = len(open_) - 1
                    while open_[i] != v:
                        i -= 1
                    inner = open_[i:]
                    del open_[i:]
                    own_s, own_t = [hang_s[x] for x in inner], [hang_t[x] for x in inner]
                    s, t = sum(own_s), sum(own_t)
                    hang_s[u] += s
                    hang_t[u] += t
                    pairs[u] += s * t
                    cut_off.append((u, inner, own_s, own_t, s, t))
            s_all, t_all = hang_s[root], hang_t[root]
            for u, inner, own_s, own_t, s, t in cut_off:
                for x, xs, xt in zip(inner, own_s, own_t):
                    pairs[x] += (s_all - xs) * (t_all - xt)
                if len(inner) > 1:
                    found.append(([*inner, u], [*own_s, s_all - s], [*own_t, t_all - t]))
            for _, inner, *_ in cut_off:
                for x in inner:
                    pairs[x] = (s_all - starts[x]) * (t_all - 1) - pairs[x]
            pairs[root] = (s_all - starts[root]) * (t_all - 1) - pairs[root]
        of = np.array([x for b, _, _ in found for x in b], np.int64)
        block = np.repeat(np.arange(len(found)), [len(b) for b, _, _ in found])
        # edges inside a block, by the copies of their ends there
        edges, copy = self.out(of)
        n_blocks = max(1, len(found))
        keys = of * n_blocks + block
        order = np.argsort(keys)
        wanted = self.to[edges].astype(np.int64) * n_blocks + block[copy]
        place = np.minimum(np.searchsorted(keys[order], wanted), max(0, len(keys) - 1))
        inside = keys[order][place] == wanted if len(keys) else np.zeros(0, bool)
        g = Adjacency(of, np.searchsorted(copy[inside], np.arange(len(of) + 1)), order[place[inside]].astype(np.int32) if len(keys) else np.zeros(0, np.int32), self.times[edges[inside]])
        sources, targets = (np.array([x for b in found for x in b[i]], np.float64) for i in (1, 2))
        return Blocks(g, sources, targets, np.array(pairs, np.float64))


@dataclass
class Blocks:
    """``parts`` has a vertex for every vertex of every block, whose id is its number in the whole graph. ``sources`` and
    ``targets`` are how many of the whole graph are that vertex or reach the block through it. ``between`` has for each
    vertex of the whole graph the pairs of a source and a target that only it connects."""

    parts: Adjacency
    sources: np.ndarray
    targets: np.ndarray
    between: np.ndarray


def _spread(sources: DataFrame) -> DataFrame:
    return sources.repartition(max(2, 4 * sources.sparkSession.sparkContext.defaultParallelism))


def per_source(sources: DataFrame, a: Adjacency, result: Callable[[object, list[np.ndarray], Adjacency], tuple[np.ndarray, ...]], kind: str, depth: int | None = None) -> DataFrame:
    """A table of ``result(source id, layers of vertex numbers, adjacency)`` for each ``id`` of ``sources``; ``kind`` is its schema.

    A source without edges has itself as its only layer, by number -1."""
    shown = sources.sparkSession.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shown.value
        where, seen = pd.Index(g.ids), np.zeros(len(g.ids), bool)
        held, n = [], 0
        for b in batches:
            for source, k in zip(b.column(0).to_pylist(), where.get_indexer(b.column(0).to_pandas())):
                layers = list(g.layers(k, seen, depth)) if k >= 0 else [np.array([-1])]
                held.append(result(source, layers, g))
                n += len(held[-1][0])
                if n >= BATCH_ROWS:
                    yield _batch(held, kind)
                    held, n = [], 0
        if held:
            yield _batch(held, kind)

    return _spread(sources.select("id")).mapInArrow(run, kind)


def _batch(rows: list[tuple[np.ndarray, ...]], kind: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in kind.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)


#: Sources that are searched together, a bit of a word each: at most 64.
TOGETHER = 64


def distances(sources: DataFrame, a: Adjacency, depth: int | None = None) -> DataFrame:
    """``source, id, distance`` (int). Sources near each other are searched together: a vertex is met once for all that it is as far from."""
    spark, kind = sources.sparkSession, sources.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(sources.schema["id"].dataType)
    one, other = np.repeat(np.arange(len(a.ids)), np.diff(a.start)), a.to
    ends = np.concatenate([one, other])
    by = np.argsort(ends, kind="stable")
    order, _ = _near_order(Adjacency(a.ids, np.searchsorted(ends[by], np.arange(len(a.ids) + 1)), np.concatenate([other, one])[by].astype(np.int32), np.zeros(0)))
    rank = np.full(len(order) + 1, -1)  # the last for those without edges
    rank[order] = np.arange(len(order))
    shown = spark.sparkContext.broadcast((a, rank))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, rank = shown.value
        where = pd.Index(g.ids)
        for b in batches:
            k = where.get_indexer(b.column(0).to_pandas())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rank[k] // TOGETHER), pa.array(k)], ["id", "part", "k"])

    def search(starts: np.ndarray, g: Adjacency, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By distance the vertices that are met, and bit by bit from which of ``starts``. ``seen`` is all 0 and is so again at the end."""
        front, bits, met = starts, np.left_shift(np.uint64(1), np.arange(len(starts), dtype=np.uint64)), []
        while len(front):
            seen[front] |= bits
            met.append(front)
            yield front, bits
            if depth is not None and len(met) > depth:
                break
            edges, of = g.out(front)
            near = g.to[edges]
            bits = bits[of] & ~seen[near]
            new = np.flatnonzero(bits)
            near, bits = near[new], bits[new]
            by = np.argsort(near, kind="stable")
            near = near[by]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            front, bits = near[first], np.bitwise_or.reduceat(bits[by], first) if len(first) else bits[:0]
        for x in met:
            seen[x] = 0

    def table(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """``held``: vertices, how many sources each has and which, the distance of each vertex."""
        ids, size, found, distance = (np.concatenate(c) for c in zip(*held))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(found, id_type))
        return pa.RecordBatch.from_arrays([lists, pa.array(ids, id_type), pa.array(distance)], ["sources", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, _ = shown.value
        seen, ks, parts = np.zeros(len(g.ids), np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            part, k = b.column(1).to_numpy(), b.column(2).to_numpy()
            if (part < 0).any():
                alone = b.column(0).filter(pa.array(part < 0)).to_numpy(zero_copy_only=False)
                yield table([(alone, np.ones(len(alone), np.int64), alone, np.zeros(len(alone), np.int32))])
            ks.append(k[part >= 0])
            parts.append(part[part >= 0])
        ks, parts = np.concatenate(ks), np.concatenate(parts)
        by = np.argsort(parts, kind="stable")
        for starts in np.split(ks[by], np.flatnonzero(np.diff(parts[by])) + 1) if len(ks) else ():
            held, n = [], 0
            for d, (front, bits) in enumerate(search(starts, g, seen)):
                for lo in range(0, len(front), BATCH_ROWS // 16):
                    ends, from_ = front[lo : lo + BATCH_ROWS // 16], bits[lo : lo + BATCH_ROWS // 16]
                    found = np.flatnonzero(np.unpackbits(from_.astype("<u8").view(np.uint8), bitorder="little")) & 63
                    held.append((g.ids[ends], np.bitwise_count(from_).astype(np.int64), g.ids[starts[found]], np.full(len(ends), d, np.int32)))
                    n += len(found)
                    if n >= BATCH_ROWS:
                        yield table(held)
                        held, n = [], 0
            if held:
                yield table(held)

    found = sources.select("id").mapInArrow(ranked, f"id {kind}, part long, k long")
    spread = F.when(F.col("part") < 0, F.xxhash64("id")).otherwise(F.col("part"))
    found = found.repartition(max(2, 4 * spark.sparkContext.defaultParallelism), spread).mapInArrow(run, f"sources array<{kind}>, id {kind}, distance int")
    return found.select(F.explode("sources").alias("source"), "id", "distance")


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``lo[i], lo[i] + 1, ...``, ``size[i]`` of them, one i after the other."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def path_lists(targets: DataFrame, a: Adjacency) -> DataFrame:
    """``id, target, distance`` (double), ``paths``: all shortest paths to each ``id`` of ``targets`` along the edges of ``a``
    turned round; each the target first and the first hop last, without the start."""
    kind, id_type = targets.schema["id"].dataType.simpleString(), to_arrow_type(targets.schema["id"].dataType)
    shown = targets.sparkSession.sparkContext.broadcast(a)

    def parts(target: int, g: Adjacency, seen: np.ndarray, paths: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, numbers of paths of each, and beside each other the paths, as many starts at a time as fit. The paths of a
        layer are kept if they fit, and those of later layers go on from them. ``seen`` is all False and is so again at
        the end; ``paths`` and ``slot`` are room for numbers."""
        front, hops = np.array([target]), []
        seen[target], paths[target], slot[target] = True, 1.0, 0
        # paths of that many hops, and from which row on each vertex of that layer has its own
        base, kept, rows = 0, np.zeros((1, 0), np.int32), np.array([0, 1])

        def listed(at: np.ndarray) -> np.ndarray:
            """The paths of vertices of the last layer."""
            taken = []
            for start, after in reversed(hops[base:]):
                lo = start[slot[at]]
                size = start[slot[at] + 1] - lo
                of = np.repeat(np.arange(len(at)), size)
                at = after[_ranges(lo, size)]
                taken.append((at, of))
            lo = rows[slot[at]]
            size = rows[slot[at] + 1] - lo
            steps, row = np.empty((int(size.sum()), len(hops)), np.int32), np.repeat(np.arange(len(at)), size)
            steps[:, :base] = kept.take(_ranges(lo, size), 0)
            for k, (at, of) in enumerate(reversed(taken), base):
                steps[:, k], row = at[row], of[row]
            return steps

        met = [front]
        yield front, np.array([1]), kept
        while True:
            edges, of = g.out(front)
            near = g.to[edges]
            new = np.flatnonzero(~seen[near])
            if not len(new):
                break
            new = new[np.argsort(near[new], kind="stable")]
            near, after = near[new], front[of[new]]
            start = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1, [len(near)]])
            front = near[start[:-1]]
            paths[front] = np.add.reduceat(paths[after], start[:-1])
            seen[front], slot[front] = True, np.arange(len(front))
            met.append(front)
            hops.append((start, after))
            sizes = paths[front]
            ends = np.cumsum(sizes) * len(hops)
            if ends[-1] <= BATCH_ROWS * 64:
                base, kept, rows = len(hops), listed(front), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            lo = 0
            while lo < len(front):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_ROWS * 4, "right")))
                yield front[lo:hi], sizes[lo:hi].astype(np.int64), kept[rows[lo] : rows[hi]] if base == len(hops) else listed(front[lo:hi])
                lo = hi
        for x in met:
            seen[x] = False

    def batch(ids: pa.Array, target: pa.Array, distance: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, steps: pa.Array) -> pa.RecordBatch:
        """``sizes`` are numbers of paths of each row, ``lengths`` those of steps of each path."""
        from_ = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(from_(sizes), pa.ListArray.from_arrays(from_(lengths), steps))
        return pa.RecordBatch.from_arrays([ids, target, pa.array(distance), lists], ["id", "target", "distance", "paths"])

    def table(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], names: pa.Array) -> pa.RecordBatch:
        """``held``: target, starts, numbers of paths of each, the paths beside each other; all by numbers, whose ids are ``names``."""
        target, starts, sizes, steps = zip(*held)
        n, hops = [len(x) for x in starts], [x.shape[1] for x in steps]
        ids, ends = names.take(pa.array(np.concatenate(starts))), names.take(pa.array(np.repeat(target, n)))
        return batch(ids, ends, np.repeat(np.array(hops, np.float64), n), np.concatenate(sizes), np.repeat(hops, [len(x) for x in steps]), names.take(pa.array(np.concatenate([x.ravel() for x in steps]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shown.value
        names = pa.array(g.ids, id_type)
        where, seen, paths, slot = pd.Index(g.ids), np.zeros(len(g.ids), bool), np.zeros(len(g.ids)), np.zeros(len(g.ids), np.int64)
        held, n = [], 0
        for b in batches:
            ks = where.get_indexer(b.column(0).to_pandas())
            if (ks < 0).any():
                alone = b.column(0).filter(pa.array(ks < 0))
                yield batch(alone, alone, np.zeros(len(alone)), np.ones(len(alone), np.int64), np.zeros(len(alone), np.int64), names[:0])
            for k in ks[ks >= 0]:
                for starts, sizes, steps in parts(k, g, seen, paths, slot):
                    held.append((k, starts, sizes, steps))
                    n += steps.size + len(steps)
                    if n >= BATCH_ROWS * 4:
                        yield table(held, names)
                        held, n = [], 0
        if held:
            yield table(held, names)

    return _spread(targets.select("id")).mapInArrow(run, f"id {kind}, target {kind}, distance double, paths array<array<{kind}>>")


def distance_sums(sources: DataFrame, a: Adjacency) -> DataFrame:
    """``id, total, inverse``: of each source the sums of the distances of all others reached, and of their inverses (null if none is)."""
    kind = sources.schema["id"].dataType.simpleString()

    def rows(source: object, layers: list[np.ndarray], g: Adjacency) -> tuple[np.ndarray, ...]:
        n, d = np.array([len(x) for x in layers[1:]]), np.arange(1, len(layers))
        return np.array([source]), np.array([float((n * d).sum()) if len(n) else np.nan]), np.array([float((n / d).sum()) if len(n) else np.nan])

    return per_source(sources, a, rows, f"id {kind}, total double, inverse double")


def coarse_distances(wanted: DataFrame, members: DataFrame, groups: Adjacency, edges: Adjacency) -> DataFrame:
    """``id, target, between, near`` (doubles), a row for each pair: for ``target, tl`` of ``wanted`` (``tl`` its group), all
    ``id, label`` of ``members`` with the hops ``between`` their groups, unless it is one; 1 or 2 where it is ``near``, 0 for itself.

    Both graphs have their edges turned round."""
    kind, id_type = wanted.schema["target"].dataType.simpleString(), to_arrow_type(wanted.schema["target"].dataType)
    m = members.select("id", "label").toPandas()
    group = pd.Index(groups.ids).get_indexer(m["label"])
    m, group = m[group >= 0], group[group >= 0]
    # numbers of vertices: those with edges as there, then the rest
    number, ids = pd.factorize(pd.concat([pd.Series(edges.ids), m["id"]], ignore_index=True))
    order = np.argsort(group, kind="stable")
    of_group = Adjacency(groups.ids, np.searchsorted(group[order], np.arange(len(groups.ids) + 1)), number[len(edges.ids) :][order].astype(np.int32), np.zeros(0))
    shown = wanted.sparkSession.sparkContext.broadcast((np.asarray(ids), groups, of_group, edges))

    def table(held: list[tuple[object, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.array(i, id_type) for _, i, _, _ in held]), pa.concat_arrays([pa.array([t], id_type).take(pa.array(np.zeros(len(i), np.int32))) for t, i, _, _ in held])]
        columns += [pa.array(x, mask=np.isnan(x)) for x in (np.concatenate([h[k] for h in held]) for k in (2, 3))]
        return pa.RecordBatch.from_arrays(columns, ["id", "target", "between", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, of_group, edges = shown.value
        where, which = pd.Index(ids), pd.Index(groups.ids)
        seen, between, near, slot = np.zeros(len(groups.ids), bool), np.full(len(ids), np.nan), np.full(len(ids), np.nan), np.zeros(len(ids), np.int64)
        held, n = [], 0
        for b in batches:
            for t, k, c in zip(b.column(0).to_pylist(), where.get_indexer(b.column(0).to_pandas()), which.get_indexer(b.column(1).to_pandas())):
                if k < 0 and c < 0:
                    held.append((t, np.array([t]), np.array([np.nan]), np.array([0.0])))
                    continue
                touched = []
                for d, layer in enumerate(groups.layers(c, seen) if c >= 0 else ()):
                    if d:
                        touched.append(of_group.to[of_group.out(layer)[0]])
                        between[touched[-1]] = d
                if k >= 0:
                    one = edges.to[edges.out(np.array([k]))[0]] if k < len(edges.ids) else np.zeros(0, np.int32)
                    two = edges.to[edges.out(one)[0]]
                    near[two], near[one], near[k] = 2.0, 1.0, 0.0
                    touched += [two, one, np.array([k])]
                at = np.concatenate(touched) if touched else np.zeros(0, np.int64)
                slot[at] = np.arange(len(at))
                at = at[slot[at] == np.arange(len(at))]
                held.append((t, ids[at], between[at], near[at]))
                between[at], near[at] = np.nan, np.nan
                n += len(at)
                if n >= BATCH_ROWS:
                    yield table(held)
                    held, n = [], 0
        if held:
            yield table(held)

    return _spread(wanted.select("target", "tl")).mapInArrow(run, f"id {kind}, target {kind}, between double, near double")


def dependency_sums(sources: DataFrame, a: Adjacency) -> DataFrame:
    """``id, delta``: the sums of Brandes' dependencies over the sources; rows of an id are to be added.

    Paths between vertices on two sides of a cut vertex pass it, so that each block is searched by itself, from vertices
    that count for all that lie behind them."""
    spark, kind = sources.sparkSession, sources.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(sources.schema["id"].dataType)
    starts = np.zeros(len(a.ids), bool)
    number = pd.Index(a.ids).get_indexer(sources.select("id").toPandas()["id"])
    starts[number[number >= 0]] = True
    found = a.blocks(starts)
    shown = spark.sparkContext.broadcast((a.ids, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by = shown.value
        g, n = by.parts, len(by.parts.ids)
        depth_of, paths, part, slot, total = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(len(ids))
        for b in batches:
            for k in b.column(0).to_numpy():
                if k == n:
                    total += by.between
                elif by.sources[k]:
                    reached, delta = g.dependencies(k, depth_of, paths, part, slot, by.targets)
                    np.add.at(total, g.ids[reached], by.sources[k] * delta)
        some = np.flatnonzero(total)
        for i in range(0, len(some), BATCH_ROWS):
            at = some[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], id_type), pa.array(total[at])], ["id", "delta"])

    # one number more than there are vertices of blocks, for the pairs between them
    return _spread(spark.range(len(found.parts.ids) + 1)).mapInArrow(run, f"id {kind}, delta double")


@dataclass
class Currents:
    """``n`` equal currents from ``s`` to ``t``, by numbers, in the order of ``s``: those from vertex i are ``at_s[i]`` up to
    ``at_s[i + 1]``, those to it the same of ``at_t`` in ``by_t``. ``part`` has the component of each vertex, ``size`` its vertices.
    ``place`` is that of each vertex in its component, in an order in which ends of currents are near each other."""

    s: np.ndarray
    t: np.ndarray
    n: np.ndarray
    at_s: np.ndarray
    by_t: np.ndarray
    at_t: np.ndarray
    part: np.ndarray
    size: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, s: np.ndarray, t: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray) -> Currents:
        place = np.zeros(len(part), np.int64)
        place[s] = at
        order = np.argsort(s, kind="stable")
        s, t, n, every = s[order].astype(np.int32), t[order].astype(np.int32), n[order], np.arange(len(part) + 1)
        by_t = np.argsort(t, kind="stable")
        return cls(s, t, n.astype(np.float64), np.searchsorted(s, every), by_t, np.searchsorted(t[by_t], every), part, np.bincount(part), place)

    def at(self, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The currents that start or end in each vertex, and for each its place in ``vertices``."""
        of, found = [], []
        for at, order in ((self.at_s, None), (self.at_t, self.by_t)):
            size = at[vertices + 1] - at[vertices]
            place = np.repeat(at[vertices] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found.append(place if order is None else order[place])
            of.append(np.repeat(np.arange(len(vertices)), size))
        return np.concatenate(found), np.concatenate(of)


#: Edges whose other ends are read together.
BLOCK_EDGES = 1 << 11


class Region:
    """The vertices within ``depth`` edges of ``ends``, those of most neighbours first; what spreads from ``ends`` for ``depth``
    rounds is nothing beyond. ``local`` is room for a number per vertex of the graph, all ``-1``; :meth:`leave` makes it so again."""

    def __init__(self, g: Adjacency, c: Currents, ends: np.ndarray, depth: int, seen: np.ndarray, local: np.ndarray):
        front, all_ = np.unique(ends), []
        seen[front] = True
        while len(front):
            all_.append(front)
            if len(all_) > depth:
                break
            near = g.to[g.out(front)[0]]
            front = np.unique(near[~seen[near]])
            seen[front] = True
        at = np.concatenate(all_)
        seen[at] = False
        size = g.start[at + 1] - g.start[at]
        order = np.argsort(-size, kind="stable")
        self.vertices, size, self.room, self.c = at[order], size[order], local, c
        local[self.vertices] = np.arange(len(at))
        edges, of = g.out(self.vertices)
        self.deg = np.bincount(of, g.times[edges], len(at))
        near, times = local[g.to[edges]].astype(np.int64), g.times[edges]
        near[near < 0] = len(at)
        # vertices of as many neighbours side by side, first the first neighbours of all
        start, self.blocks, lo = np.append(0, np.cumsum(size)), [], 0
        while lo < len(at):
            k = int(size[lo])
            hi = int(min(np.searchsorted(-size, -k, "right"), lo + max(1, BLOCK_EDGES // k)))
            part = np.arange(start[lo], start[hi]).reshape(hi - lo, k).T.ravel()
            self.blocks.append((lo, hi, near[part], None if (times[part] == 1).all() else times[part][:, None]))
            lo = hi
        self.by_part = np.argsort(c.part[self.vertices], kind="stable")
        parts, self.first = np.unique(c.part[self.vertices[self.by_part]], return_index=True)
        self.parts, self.whole = parts, np.diff(np.append(self.first, len(at))) == c.size[parts]

    def leave(self) -> None:
        self.room[self.vertices] = -1

    def covers(self, ends: np.ndarray) -> bool:
        """Whether a region of ``ends`` could be no other, whatever its depth: they lie in its only component, all of which it has."""
        return len(self.parts) == 1 and bool(self.whole[0]) and bool((self.c.part[ends] == self.parts[0]).all())

    def width(self) -> int:
        return int(np.clip((1 << 20) // len(self.vertices), 4, 256))

    def place(self, vertices: np.ndarray) -> np.ndarray:
        """Their rows; for those outside the last, which is always 0."""
        found = self.room[vertices]
        return np.where(found < 0, len(self.vertices), found)

    def zeros(self, width: int, kind: type = np.float64) -> np.ndarray:
        return np.zeros((len(self.vertices) + 1, width), kind)

    def over_edges(self, p: np.ndarray, out: np.ndarray, add: np.ufunc) -> Iterator[tuple[int, int]]:
        """Puts into ``out`` what ``add`` makes of ``p`` over the edges of each vertex; gives the rows that are done."""
        width = p.shape[1]
        room = np.empty((max(len(near) for _, _, near, _ in self.blocks), width), p.dtype)
        for lo, hi, near, times in self.blocks:
            got = np.take(p, near, axis=0, out=room[: len(near)], mode="clip")
            if times is not None and p.dtype != bool:
                got *= times
            add.reduce(got.reshape(-1, (hi - lo) * width), axis=0, out=out[lo:hi].reshape(-1))
            yield lo, hi

    def mean(self, p: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Of each vertex the mean of ``p`` over its edges; ``out`` is room whose last row is 0."""
        out = np.zeros_like(p) if out is None else out
        for lo, hi in self.over_edges(p, out, np.add):
            out[lo:hi] /= self.deg[lo:hi, None]
        return out

    def potentials(self, g: Adjacency, columns: np.ndarray, rounds: int) -> np.ndarray:
        """By vertex and column, after so many rounds, of one unit that is supplied at the column's vertex."""
        p, width = self.zeros(len(columns)), len(columns)
        flat, col = p.reshape(-1), np.arange(width)
        supplied = self.place(columns) * width + col
        flat[supplied] = 0.5 / self.deg[supplied // width]
        some = supplied
        # at first few are reached, each by itself
        while rounds and len(some) * len(g.to) // len(g.ids) < p.size // 10:
            edges, of = g.out(self.vertices[some // width])
            share = flat[some][of] * g.times[edges]
            flat[some] = 0.0
            np.add.at(flat, self.room[g.to[edges]] * width + (some % width)[of], share)
            flat[supplied] += 1.0
            some = np.flatnonzero(flat)
            flat[some] /= self.deg[some // width]
            rounds -= 1
        other, unit = np.zeros_like(p), 1.0 / self.deg[supplied // width]
        for _ in range(rounds):
            p, other = self.mean(p, other), p
            p.reshape(-1)[supplied] += unit
        return p

    def reached(self, ends: np.ndarray, rounds: int) -> np.ndarray:
        """By vertex and end, whether it is at most so many edges away."""
        now = self.zeros(len(ends), bool)
        now[self.place(ends), np.arange(len(ends))] = True
        for _ in range(rounds):
            new = np.zeros_like(now)
            for _rows in self.over_edges(now, new, np.logical_or):
                pass
            new |= now
            if np.array_equal(new, now):
                break
            now = new
        return now

    def spread(self, p: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By column the largest less the smallest value in the component of its end; those outside the region are 0."""
        if len(self.parts) == 1:
            return p[:-1].max(0) - (p[:-1].min(0) if self.whole[0] else 0.0)
        own, k = np.searchsorted(self.parts, self.c.part[ends]), np.arange(len(ends))
        sorted_ = p[self.by_part]
        return np.maximum.reduceat(sorted_, self.first)[own, k] - np.where(self.whole[own], np.minimum.reduceat(sorted_, self.first)[own, k], 0.0)

    def currents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of starts and ends and numbers of all currents that start or end here."""
        found, _ = self.c.at(self.vertices)
        found = np.unique(found)
        return self.place(self.c.s[found]), self.place(self.c.t[found]), self.c.n[found]


def _near_order(a: Adjacency) -> tuple[np.ndarray, np.ndarray]:
    """Vertices by component and distance from its first vertex, and the component of each."""
    label, of = np.arange(len(a.ids)), np.repeat(np.arange(len(a.ids)), np.diff(a.start))
    while True:
        one, other = label[of], label[a.to]
        if (one == other).all():
            break
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    depth, front, k = np.full(len(a.ids), -1), np.unique(label), 0
    while len(front):
        depth[front] = k
        near = a.to[a.out(front)[0]]
        front, k = np.unique(near[depth[near] < 0]), k + 1
    return np.lexsort((depth, label)), label


#: Vertices by columns of a component that is taken as a whole.
COLUMN_CELLS = 1 << 22
#: Vertices from which it pays, and distances that are looked up one by one before.
WHOLE_VERTICES, FAR_VERTICES = 256, 256


@dataclass
class EdgesOfRegion:
    """Edges inside a region, once each, by rows of their ends ``one`` and ``other``."""

    r: Region
    one: np.ndarray
    other: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, g: Adjacency, r: Region) -> EdgesOfRegion:
        edges, one = g.out(r.vertices)
        other = r.place(g.to[edges])
        once = np.flatnonzero(one < other)
        return cls(r, one[once], other[once], g.times[edges[once]])

    def through(self, g: Adjacency, c: Currents, sources: np.ndarray, rounds: int) -> np.ndarray:
        """By vertex of the region, a whole component, what flows through it of the currents from ``sources`` that neither start nor end in it."""
        found = np.repeat(c.at_s[sources + 1] - np.cumsum(c.at_s[sources + 1] - c.at_s[sources]), c.at_s[sources + 1] - c.at_s[sources])
        found += np.arange(len(found))
        s, t, n = c.s[found], c.t[found], c.n[found]
        ends = np.unique(np.concatenate([s, t]))
        by = np.argsort((c.place[ends] - c.place[sources[0]]) % len(self.r.vertices), kind="stable")
        p = self.r.potentials(g, ends[by], rounds)
        column = np.empty(len(ends), np.int64)
        column[by] = np.arange(len(ends))
        a, z = column[np.searchsorted(ends, s)], column[np.searchsorted(ends, t)]
        # currents between columns as far from each other, side by side
        order = np.lexsort((a, z - a))
        a, z, n, s, t = a[order], z[order], n[order], s[order], t[order]
        cuts = np.flatnonzero((np.diff(a) != 1) | (np.diff(z) != 1)) + 1
        beside = [(a[i], z[i], z[j - 1] + 1 - z[i], n[i:j]) for i, j in zip([0, *cuts], [*cuts, len(a)])]
        flow, step = np.zeros(len(self.one)), max(1, (1 << 15) // len(ends))
        near, far, room = (np.empty((step, len(ends))) for _ in range(3))
        for lo in range(0, len(flow), step):
            hi = min(len(flow), lo + step)
            one, other = near[: hi - lo], far[: hi - lo]
            np.take(p, self.one[lo:hi], axis=0, out=one, mode="clip")
            np.take(p, self.other[lo:hi], axis=0, out=other, mode="clip")
            one -= other
            for i, j, k, m in beside:
                x = room.reshape(-1)[: (hi - lo) * k].reshape(hi - lo, k)
                np.subtract(one[:, i : i + k], one[:, j : j + k], out=x)
                flow[lo:hi] += np.abs(x, out=x) @ m
        flow *= self.times / 2
        out = np.bincount(self.one, flow, len(self.r.vertices)) + np.bincount(self.other, flow, len(self.r.vertices))
        for x in (s, t):
            edges, of = g.out(x)
            row, end, i, j = self.r.place(g.to[edges]), self.r.place(x)[of], a[of], z[of]
            np.subtract.at(out, end, n[of] * g.times[edges] / 2 * np.abs(p[end, i] - p[end, j] - (p[row, i] - p[row, j])))
        return out


def _all_reached(g: Adjacency, c: Currents, rounds: int) -> np.ndarray:
    """By component, whether it is large, has more edges than vertices and no vertex is more than so many edges from another."""
    by = np.argsort(c.part, kind="stable")
    start, degree, seen = np.searchsorted(c.part[by], np.arange(len(c.size) + 1)), np.diff(g.start), np.zeros(len(g.ids), bool)
    out = np.zeros(len(c.size), bool)
    for k in np.flatnonzero(c.size >= WHOLE_VERTICES):
        own = by[start[k] : start[k + 1]]
        if degree[own].sum() < 3 * len(own):
            continue
        layers = list(g.layers(own[np.argmax(degree[own])], seen, 2 * rounds))
        # distances of a vertex are at most those by way of the first
        limit = rounds - (len(layers) - 1)
        far = np.concatenate([x for d, x in enumerate(layers) if d > limit] or [own[:0]])
        out[k] = len(far) <= FAR_VERTICES and all(sum(len(x) for x in g.layers(v, seen, rounds)) == len(own) for v in far)
    return out


#: Columns that a region is made for.
REGION_COLUMNS = 128
#: Currents by columns that are looked at together.
CURRENT_CELLS = 1 << 19


def flow_sums(runs: DataFrame, a: Adjacency, eps: float, max_rounds: int) -> DataFrame:
    """``id, total, n``, rows of an id to be added: over the currents ``s, t, n`` that reach it and neither start nor end in it
    the sum of what flows through it, and their number, both ``n``-fold.

    Potentials are linear in the supply, and what a unit supplied at v gives u is what one at u gives v. So there is a column
    per vertex or edge, from which all currents read, not one per current. A first pass finds the rounds until no potential
    changes by ``eps`` or more (changes never grow), the second makes as many for all."""
    spark, kind = runs.sparkSession, runs.schema["s"].dataType.simpleString()
    id_type = to_arrow_type(runs.schema["s"].dataType)
    order, label = _near_order(a)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    edges, of = a.out(order)
    g = Adjacency(a.ids[order], np.searchsorted(of, np.arange(len(order) + 1)), rank[a.to[edges]].astype(np.int32), a.times[edges])
    drawn, where = runs.select("s", "t", "n", "at").toArrow(), pd.Index(g.ids)
    s, t = (where.get_indexer(drawn.column(k).to_pandas()) for k in ("s", "t"))
    c = Currents.of(s, t, drawn.column("n").to_numpy(), drawn.column("at").to_numpy(), np.unique(label[order], return_inverse=True)[1])
    del drawn, where
    shown = spark.sparkContext.broadcast((g, c))

    def changes(batches: Iterator[pa.RecordBatch], known: np.ndarray | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Vertices, from which round on all changes at each are below ``eps``, and the last round in which one of a current is
        not. Without ``known`` only currents from or to the vertex itself are looked at, with it those of all, of ``known``
        vertices and from round ``least`` on."""
        g, c = shown.value
        every, room, seen = np.arange(len(g.ids)) if known is None else known, np.full(len(g.ids), -1), np.zeros(len(g.ids), bool)
        r = None
        for b in batches:
            for i in b.column(0).to_numpy():
                ends = every[i * REGION_COLUMNS : (i + 1) * REGION_COLUMNS]
                settled, last, depth, k = np.full(len(ends), max_rounds + 1), 0, 32, 1
                if r is None or not r.covers(ends):
                    if r is not None:
                        r.leave()
                    r = Region(g, c, ends, depth, seen, room)
                columns = np.arange(len(ends))
                x = r.zeros(len(ends))
                x[r.place(ends), columns] = 0.5 / r.deg[r.place(ends)]
                x += r.mean(x)
                found, of = c.at(ends)
                other = np.where(c.s[found] == ends[of], c.t[found], c.s[found])
                rows = r.place(ends), r.place(other), r.currents() if known is not None else None
                while True:
                    own = np.empty(len(ends), np.int64)
                    own[columns] = np.arange(len(columns))
                    here = np.isin(of, columns)
                    col = own[of[here]]
                    at = rows[0][of[here]], rows[1][here]
                    high = bool((np.abs(x[at[0], col] - x[at[1], col]) >= eps).any())
                    if not high and known is not None and k >= least:
                        ss, tt, _ = rows[2]
                        step = max(1, CURRENT_CELLS // len(columns))
                        high = any((np.abs(x[ss[j : j + step]] - x[tt[j : j + step]]) >= eps).any() for j in range(0, len(ss), step))
                    if high:
                        last = k
                    if (done := r.spread(x, ends[columns]) < eps).any():
                        settled[columns[done]] = k
                        columns, x = columns[~done], np.ascontiguousarray(x[:, ~done])
                    if not len(columns) or k >= max_rounds:
                        break
                    if k == depth and not r.whole.all():
                        depth *= 2
                        held, old = x[:-1], r.vertices
                        r.leave()
                        r = Region(g, c, ends, depth, seen, room)
                        x = r.zeros(len(columns))
                        x[r.place(old)] = held
                        rows = r.place(ends), r.place(other), r.currents() if known is not None else None
                    x = r.mean(x)
                    k += 1
                yield ends, settled, last

    def count(known: np.ndarray | None = None, least: int = 0) -> pa.Table:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ends, settled, last in changes(batches, known, least):
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(settled, pa.int64()), pa.array(np.full(len(ends), last), pa.int64())], ["v", "settled", "last"])

        parts = -(-(len(g.ids) if known is None else len(known)) // REGION_COLUMNS)
        return _spread(spark.range(parts)).mapInArrow(run, "v long, settled long, last long").toArrow()

    seen = count()
    rounds = 1 + int(seen.column("last").to_numpy().max())
    slow = np.sort(seen.column("v").to_numpy()[seen.column("settled").to_numpy() > rounds])
    if rounds <= max_rounds and len(slow):
        rounds = max(rounds, 1 + int(count(slow, rounds).column("last").to_numpy().max()))
    if rounds > max_rounds:
        raise RuntimeError(f"potentials still change after {max_rounds} rounds")

    whole = _all_reached(g, c, rounds)
    blocks, of_part = [], np.lexsort((c.place, c.part))
    for k in np.flatnonzero(whole):
        own = of_part[np.searchsorted(c.part[of_part], k) : np.searchsorted(c.part[of_part], k, "right")]
        ahead = int(c.n[c.part[c.s] == k].sum()) // len(own)
        width = max(ahead, COLUMN_CELLS // len(own) - ahead)
        blocks += [own[lo : lo + width] for lo in range(0, len(own), width)]
    planned = spark.sparkContext.broadcast((whole, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (g, c), (whole, blocks) = shown.value, planned.value
        room, seen = np.full(len(g.ids), -1), np.zeros(len(g.ids), bool)
        total, number = np.zeros(len(g.ids)), np.zeros(len(g.ids))
        every = np.bincount(c.part[c.s], c.n, len(c.size))
        one = np.repeat(np.arange(len(g.ids)), np.diff(g.start))
        once = np.flatnonzero((one < g.to) & ~whole[c.part[one]])
        first = np.zeros((2, len(once)), bool)  # every vertex is counted by one of its edges
        ends_of = np.concatenate([one[once], g.to[once]])
        first.reshape(-1)[np.unique(ends_of, return_index=True)[1]] = True
        r = lines = None
        for b in batches:
            for i in b.column(0).to_numpy():
                if i < len(blocks):
                    if r is None or not r.covers(blocks[i]):
                        if r is not None:
                            r.leave()
                        r, lines = Region(g, c, blocks[i], len(g.ids), seen, room), None
                    lines = lines or EdgesOfRegion.of(g, r)
                    total[r.vertices] += lines.through(g, c, blocks[i], rounds)
                    here, of = c.at(blocks[i])
                    number[blocks[i]] = every[c.part[blocks[i]]] - np.bincount(of, c.n[here], len(blocks[i]))
                    continue
                i -= len(blocks)
                if r is not None:
                    r.leave()
                block = np.arange(i * REGION_COLUMNS, min(len(once), (i + 1) * REGION_COLUMNS))
                lines, r = None, Region(g, c, np.concatenate([one[once[block]], g.to[once[block]]]), rounds, seen, room)
                ss, tt, n = r.currents()
                for lo in range(0, len(block), r.width()):
                    part = block[lo : lo + r.width()]
                    sides, col, times = (one[once[part]], g.to[once[part]].astype(np.int64)), np.arange(len(part)), g.times[once[part]]
                    supply = r.zeros(len(part))
                    supply[r.place(sides[0]), col] = 1.0 / r.deg[r.place(sides[0])]
                    supply[r.place(sides[1]), col] = -1.0 / r.deg[r.place(sides[1])]
                    p = supply / 2
                    for _ in range(rounds):
                        p = r.mean(p)
                        p += supply
                    reach = [r.reached(x, rounds) for x in sides]
                    all_ = all(x[:-1].all() for x in reach) and r.whole.all() and len(r.parts) == 1
                    sums, counts = np.zeros((2, len(part))), np.zeros((2, len(part)))
                    step = max(1, CURRENT_CELLS // len(part))
                    for j in range(0, len(ss), step):
                        a, z, m = ss[j : j + step], tt[j : j + step], n[j : j + step]
                        through = np.abs(p[a] - p[z])
                        if all_:
                            sums += m @ through
                            counts += m.sum()
                        else:
                            for k, x in enumerate(reach):
                                there = x[a] | x[z]
                                sums[k] += m @ (through * there)
                                counts[k] += m @ there
                    for k, x in enumerate(sides):  # without those that start or end in it
                        found, of = c.at(x)
                        sums[k] -= np.bincount(of, c.n[found] * np.abs(p[r.place(c.s[found]), of] - p[r.place(c.t[found]), of]), len(part))
                        counts[k] -= np.bincount(of, c.n[found], len(part))
                        np.add.at(total, x, sums[k] * times / 2)
                        number[x[first[k, part]]] = counts[k, first[k, part]]
        some = np.flatnonzero((total != 0) | (number != 0))
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[some], id_type), pa.array(total[some]), pa.array(number[some])], ["id", "total", "n"])

    rest = int(np.count_nonzero(~whole[c.part[np.repeat(np.arange(len(g.ids)), np.diff(g.start))]])) // 2
    return _spread(spark.range(len(blocks) - (-rest // REGION_COLUMNS))).mapInArrow(run, f"id {kind}, total double, n double")
