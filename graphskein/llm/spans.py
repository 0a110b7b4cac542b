"""Long spans that occur verbatim in more than one record."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphskein.llm.bpe import _mix
from graphskein.plans.scratch import cut

#: Code points hashed at once, and window starts of a text in one piece; longer texts are cut into pieces that overlap by a window.
CHUNK, PIECE = 1 << 19, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 20) - 1)
#: A sketch has two rows of at most 2**27 cells, so its bitmap stays below 32 MB.
MAX_CELL_BITS = 27
_BLOCK = 16  # cells are sent in blocks of 2**16
#: Cells remembered by a task before it sends them.
FLUSH = 1 << 22


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per code point; powers of the base and of its inverse, all modulo 2**64."""
    letters = _mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(_BASE))
    n = CHUNK + PIECE + (1 << 12)
    power = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))])
    return letters, power(np.uint64(_BASE)), power(np.uint64(pow(_BASE, -1, 1 << 64)))


def pieces(ids: np.ndarray, texts: list[str | None], span: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Chunks of code points, with (text number, offset in the text, length) of each piece in a chunk."""
    parts: list[str] = []
    where: list[tuple[int, int, int]] = []
    total = 0
    for k, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        for at in range(0, len(t) - span + 1, PIECE):
            part = t[at : at + PIECE + span - 1]
            if total and total + len(part) > CHUNK:
                yield np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), where
                parts, where, total = [], [], 0
            parts.append(part)
            where.append((k, at, len(part)))
            total += len(part)
    if total:
        yield np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), where


class Segments:
    """The windows of a chunk, by the anchor that each window chooses.

    A window of ``span`` code points chooses, among its stretches of ``gram`` code points, the one of least hash (the
    rightmost of equals). The choice depends on the window alone, so a window chooses the same anchor wherever it
    occurs. Neighbouring windows of one choice are a segment: ``lo`` (start of its first window), ``n`` (windows less one),
    ``anchor`` (hash of the stretch), ``whole`` (hash of all its text); ``text`` is the number of the piece.
    """

    def __init__(self, cp: np.ndarray, where: list[tuple[int, int, int]], span: int, gram: int):
        letters, power, inverse = _tables()
        self.span, self.inverse = span, inverse
        self.sum = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(letters[cp] * power[: len(cp)], out=self.sum[1:])
        grams = (self.sum[gram:] - self.sum[:-gram]) * inverse[: len(cp) - gram + 1]
        least = (grams & ~_POSITION) | (_POSITION - np.arange(len(grams), dtype=np.uint64))
        width, reach = span - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        chosen = (_POSITION - (least & _POSITION)).astype(np.int64)  # of each window start
        size = np.array([x[2] for x in where])
        first = np.cumsum(size) - size
        starts = np.zeros(len(cp), bool)
        valid = np.ones(len(chosen), bool)
        starts[first] = True
        for e in first[1:]:  # windows that reach into the next piece
            valid[max(0, e - span + 1) : e] = False
        new = np.ones(len(chosen), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        new |= starts[: len(chosen)]
        edge = np.flatnonzero(new | ~valid | np.concatenate([[False], ~valid[:-1]]))
        lo, hi = edge, np.append(edge[1:], len(chosen)) - 1
        keep = valid[lo]
        self.at, self.n = lo[keep], (hi - lo)[keep]
        self.anchor = _mix(grams[chosen[self.at]])
        self.whole = _mix(self.between(self.at, self.at + self.n + span) ^ (self.n.astype(np.uint64) << np.uint64(40)))
        piece = np.searchsorted(first, self.at, "right") - 1
        self.text = np.array([x[0] for x in where])[piece]
        self.lo = self.at - first[piece] + np.array([x[1] for x in where])[piece]

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sum[hi] - self.sum[lo]) * self.inverse[lo]

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments ``of``: each window's segment, its place in the segment, its hash."""
        count = self.n[of] + 1
        seg = np.repeat(of, count)
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return seg, off, _mix(self.between(self.at[seg] + off, self.at[seg] + off + self.span))


def _cells(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of a 64-bit key in either row of a sketch of two rows of 2**bits cells."""
    shift = np.uint64(64 - bits)
    return (_mix(key) >> shift).astype(np.int64), ((_mix(key ^ np.uint64(_BASE)) >> shift) + np.uint64(1 << bits)).astype(np.int64)


class Bitmap:
    """Which cells were hit often enough; a key passes if both of its cells were."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.set = np.zeros((2 << bits) >> 3, np.uint8)
        for block, data in blocks.items():
            self.set[block << (_BLOCK - 3) : (block << (_BLOCK - 3)) + len(data)] = np.frombuffer(data, np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for cell in _cells(key, self.bits):
            out &= (self.set[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return out


def _sparse(keys: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Cells that the keys hit, by block: those hit once, and those hit more often."""
    cell, count = np.unique(np.concatenate([c for k in keys for c in _cells(k, bits)]), return_counts=True)
    edge = np.flatnonzero(np.diff(cell >> _BLOCK, prepend=-1))
    rows: dict[str, list] = {"block": [], "once": [], "more": []}
    for lo, hi in zip(edge, np.append(edge[1:], len(cell))):
        at, often = (cell[lo:hi] & ((1 << _BLOCK) - 1)).astype(np.uint16), count[lo:hi] > 1
        rows["block"].append(int(cell[lo] >> _BLOCK))
        rows["once"].append(at[~often].tobytes())
        rows["more"].append(at[often].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["more"], pa.binary())], ["block", "once", "more"])


def sketch(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int) -> Bitmap:
    """A count-min sketch of two rows over all keys of ``rows``, reduced to the cells counted at least ``least`` (1 or 2) times.

    Each task sends the cells it hit (about four bytes a key); the counts of a block of cells are merged in a stream.
    The driver gets one bit per cell, at most 32 MB.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield from _sparse(held, bits)
                    held, n = [], 0
        if n:
            yield from _sparse(held, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << _BLOCK, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(1 << _BLOCK, np.uint8)
                at = np.frombuffer(once, np.uint16)
                total[at] = np.minimum(total[at] + 1, 2)
                total[np.frombuffer(more, np.uint16)] = 2
        if now is not None:
            yield done()

    sent = rows.mapInArrow(count, "block int, once binary, more binary")
    merged = sent.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    return Bitmap(bits, {r[0]: bytes(r[1]) for r in merged.collect()})


def _pair_key(a: np.ndarray, s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _mix(a ^ (s * np.uint64(3)) ^ _mix(doc.astype(np.int64).view(np.uint64)))


def _bits_for(n: int) -> int:
    return min(MAX_CELL_BITS, max(_BLOCK, int(np.ceil(np.log2(max(1, n) * 8)))))


def _segments(b: pa.RecordBatch, span: int, gram: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Segments]]:
    ids = b.column(0).to_numpy(zero_copy_only=False)
    texts = b.column(1) if wanted is None else pc.if_else(pa.array(wanted), b.column(1), None)
    for cp, where in pieces(ids, texts.to_pylist(), span):
        yield ids, Segments(cp, where, span, gram)


def shared_spans(docs: DataFrame, span: int = 200, *, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, span_start, span_end``: the maximal runs of positions of each text that lie in a stretch of at least
    ``span`` code points occurring verbatim in the text of another id. Starts count from 0, ends are exclusive.

    Texts that are null or shorter than ``span`` share nothing, rows with a null id are left out. If an id stands on
    several rows, its texts are one record: what only they share is not shared, and runs are given of each text (distinct).
    Further columns are ignored. An empty table gives no rows. ``id_col`` is an integer.

    1. Every window of ``span`` code points chooses an anchor (:class:`Segments`); a count-min sketch over the anchors of all
       texts overestimates in how many texts each occurs. 2. A second pass keeps the segments whose anchor may occur twice
       (a shared window's anchor always does) and groups them exactly, by the hash of anchor and whole text (128 bits
       together): a segment found in two records is shared as a whole. 3. Where an anchor occurs with several
       segments, single windows count: a second sketch, over one record of each such segment, overestimates in how many of
       them each window occurs, and those estimated to occur in several are grouped exactly, for one or two records of
       each (a window of one segment only is shared if its segment is). 4. Shared windows of each text are merged to runs. Groups are only ever reduced to their least and
       greatest id, combined before the shuffle; no pairs are made. The sketch's size follows the number of
       anchors up to ``MAX_CELL_BITS``; a fuller sketch lets more through to the exact grouping, and loses nothing.
    """
    gram = gram or max(1, span * 16 // 25)
    if not 1 <= gram <= span:
        raise ValueError("gram must lie between 1 and span")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    density = (span - gram + 2) / 2

    def anchors(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for ids, seg in _segments(b, span, gram):
            # once a record
            key = seg.anchor ^ _mix(ids[seg.text].astype(np.int64).view(np.uint64))
            yield seg.anchor[np.unique(key, return_index=True)[1]]

    often = sketch(rows, anchors, _bits_for(int(chars / density)), 2)
    shown = spark.sparkContext.broadcast(often)
    kind = "doc long, a long, s long, lo int, n int, r long"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, seg in _segments(b, span, gram):
                k = np.flatnonzero(shown.value.has(seg.anchor))
                if len(k):
                    a, s = seg.anchor[k].view(np.int64), seg.whole[k].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[seg.text[k]]), pa.array(a), pa.array(s), pa.array(seg.lo[k].astype(np.int32)), pa.array(seg.n[k].astype(np.int32)), b.column(2).take(pa.array(seg.text[k]))], ["doc", "a", "s", "lo", "n", "r"])

    found = cut(rows.withColumn("r", F.xxhash64("text")).mapInArrow(candidates, kind))
    whole = cut(found.groupBy("a", "s").agg(F.min("doc").alias("mn"), F.max("doc").alias("mx"), F.first("n").alias("n")))
    several = whole.groupBy("a").agg(F.min("mn").alias("amn"), F.max("mx").alias("amx"), F.count("*").alias("m")).where("m > 1 and amn < amx").select("a")
    border = cut(whole.join(several, "a").select("a", "s", "mn", "mx"))
    size = _bits_for(border.count() * 4)

    def owners(*columns: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        def keys(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            a, s, *docs_of = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1, *columns))
            for doc in docs_of:
                yield np.concatenate([_pair_key(a, s, doc), _mix(doc)])

        return keys

    first, ends = (spark.sparkContext.broadcast(sketch(border, owners(*columns), size, 1)) for columns in ((2,), (2, 3)))

    def windows_of(b: pa.RecordBatch, asked: Bitmap) -> Iterator[tuple[np.ndarray, ...]]:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for _, seg in _segments(b, span, gram, asked.has(_mix(ids.view(np.uint64)))):
            doc = ids[seg.text]
            k = np.flatnonzero(asked.has(_pair_key(seg.anchor, seg.whole, doc)))
            if len(k):
                at, off, w = seg.windows(k)
                yield doc[at], seg.anchor[at], seg.whole[at], off, w

    def once_a_segment(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for doc, a, s, off, w in windows_of(b, first.value):
            # a text may hold a segment several times
            yield (a ^ w)[np.unique(_pair_key(a, s, doc) ^ _mix(off.astype(np.uint64)), return_index=True)[1]]

    again = spark.sparkContext.broadcast(sketch(rows, once_a_segment, _bits_for(border.count() * (span - gram + 1)), 2))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, a, s, off, w in windows_of(b, ends.value):
                k = again.value.has(a ^ w)
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (doc, a.view(np.int64), s.view(np.int64), off.astype(np.int32), w.view(np.int64))], ["doc", "a", "s", "off", "w"])

    single = cut(rows.mapInArrow(windows, "doc long, a long, s long, off int, w long"))
    shared = single.groupBy("a", "w").agg(F.min("doc").alias("mn"), F.max("doc").alias("mx")).where("mn < mx").select("a", "w")
    hits = single.join(shared, ["a", "w"]).select("a", "s", "off").distinct()
    island = F.col("off") - F.row_number().over(Window.partitionBy("a", "s").orderBy("off"))
    some = hits.withColumn("i", island).groupBy("a", "s", "i").agg(F.min("off").alias("f"), F.max("off").alias("t")).drop("i")
    all_ = whole.where("mn < mx").select("a", "s", F.lit(0).alias("f"), F.col("n").alias("t"))
    runs = found.join(all_.union(some), ["a", "s"]).select("doc", "r", (F.col("lo") + F.col("f")).alias("b"), (F.col("lo") + F.col("t") + span).alias("e"))
    in_text = Window.partitionBy("doc", "r").orderBy("b", "e")
    before = F.max("e").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("new", F.when(F.col("b") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_text))
    out = numbered.groupBy("doc", "r", "run").agg(F.min("b").cast("long").alias("span_start"), F.max("e").cast("long").alias("span_end"))
    return out.select(F.col("doc").alias(id_col), "span_start", "span_end").distinct()


def shared_part(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, n_shared, share`` of every row of ``docs``, from its :func:`shared_spans`: the code points in shared
    runs, and their part of the text (0 for a null or empty text)."""
    total = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    out = docs.select(id_col, n.alias("n_chars")).join(total, id_col, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(0.0))
