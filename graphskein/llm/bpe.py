"""Byte-level BPE over whole batches of texts with numpy: no loop over texts, words or merges of a word.

A batch is one array of code points. Words are found from the classes of neighbouring code points; equal words are
encoded once. Words of about the same length form a padded matrix; in each round every row merges its leftmost pair
of lowest rank, found in a hashed table of pairs, and finished rows are removed.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np

# fixed values: bytes that the vocabulary writes as themselves
PRINTABLE = [(33, 126), (161, 172), (174, 255)]

SPACE, LETTER, NUMBER, OTHER, END = 0, 1, 2, 3, 4
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are merged one by one, all places of a pair at once.
LONG_WORD = 256
#: A worker's table of known words is emptied when it holds this many.
MAX_WORDS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Of every code point: white space, letter, number or other; one beyond is END.

    As the public encoders' own regular expressions have them (through tiktoken), since packages follow different
    versions of Unicode; without it, as the ``regex`` package has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        try:
            import tiktoken

            single = tiktoken.Encoding(f"bytes of {pattern}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found = bytes(single.encode_ordinary(every)).decode()  # what the pattern does not match is left out
        except ImportError:
            import regex

            found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[0x110000] = END
    return out


def word_starts(cp: np.ndarray) -> np.ndarray:
    """Where words start in ``cp``, code points in which 0x110000 ends each text. The ends are words of their own."""
    n = len(cp)
    kind = code_point_classes()[cp]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == END
    space = kind == SPACE
    # the last white space before something else is a word by itself, or begins the next word if it is a plain blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != END))
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # a lone apostrophe that begins a word takes a short ending with it
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 2 < n]
    quote = quote[kind[quote + 1] == LETTER]
    one, two = cp[quote + 1], cp[quote + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[short], 1), (quote[long], 2)):
        start[at + 1] = False
        start[at + 1 + size] |= kind[at + 1 + size] == LETTER
    return np.flatnonzero(start)


class PairTable:
    """Open addressing from pairs of ids to merge ranks; the rank gives the new id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, new: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        self.new = new.astype(np.int32)
        self.none = len(new)
        key, rank = (left.astype(np.int64) << 32) | right, np.arange(len(left), dtype=np.int32)
        slot, mask, self.probes = self._slot(key), (1 << self.bits) - 1, 0
        while len(key):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            placed = self.keys[slot] == key
            self.rank[slot[placed]] = rank[placed]
            key, rank, slot = key[~placed], rank[~placed], (slot[~placed] + 1) & mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``none`` for pairs that do not merge and for those with a negative id."""
        key = (left.astype(np.int64) << 32) | right
        slot, mask = self._slot(key), (1 << self.bits) - 1
        out = np.full(key.shape, self.none, np.int32)
        hit = self.keys[slot] == key
        out[hit] = self.rank[slot[hit]]
        rest = np.nonzero(~hit & (self.keys[slot] >= 0))
        for step in range(1, self.probes):
            if not len(rest[0]):
                break
            found = self.keys[at := (slot[rest] + step) & mask]
            hit = found == key[rest]
            out[tuple(r[hit] for r in rest)] = self.rank[at[hit]]
            more = ~hit & (found >= 0)
            rest = tuple(r[more] for r in rest)
        out[(left < 0) | (right < 0)] = self.none
        return out


class Encoder:
    """Encodes batches of texts by the vocabulary in ``path`` (a JSON file with a BPE model of bytes)."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        shown = {b: chr(b) for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
        hidden = [b for b in range(256) if b not in shown]
        shown |= {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(*(np.array([vocab[x] for x in side], np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])))
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(MAX_WORDS * 4, -1, np.int32)
        self.hash_a, self.hash_b = np.zeros(MAX_WORDS * 2, np.uint64), np.zeros(MAX_WORDS * 2, np.uint64)
        self.begin, self.size = np.zeros(MAX_WORDS * 2, np.int64), np.zeros(MAX_WORDS * 2, np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 20, np.int32), 0, 0

    def merge_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[start:start + size]`` (bytes), one after the other, and their number per word."""
        counts = np.zeros(len(start), np.int32)
        rows_of, ids_of = [], []
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LONG_WORD, "right"))
        for k in order[short:]:
            rows_of.append(np.array([k]))
            ids_of.append(self._merge_long(self.byte_ids[data[start[k] : start[k] + size[k]]])[None, :])
        order, at = order[:short], 0
        while at < len(order):
            width = max(2, int(size[order[at]]))
            top = width + (width >> 2)  # a bucket's padding stays below a fourth
            most = (1 << 22) // top  # and its matrix below 16 MB
            end = min(int(np.searchsorted(size[order], top, "right")), at + most)
            take = order[at:end]
            at = end
            width = int(size[take[-1]])
            cols = np.arange(width)
            inside = cols < size[take, None]
            m = np.where(inside, self.byte_ids[data[np.minimum(start[take, None] + cols, len(data) - 1)]], -1)
            for rows, ids in self._merge(m, take):
                rows_of.append(rows)
                ids_of.append(ids)
        flat_rows = np.concatenate([np.repeat(r, (i >= 0).sum(1)) for r, i in zip(rows_of, ids_of)]) if rows_of else np.zeros(0, np.int64)
        flat_ids = np.concatenate([i[i >= 0] for i in ids_of]) if ids_of else np.zeros(0, np.int32)
        counts += np.bincount(flat_rows, minlength=len(start)).astype(np.int32)
        return flat_ids[np.argsort(flat_rows, kind="stable")], counts

    def _merge(self, m: np.ndarray, rows: np.ndarray):
        """Rounds over a padded matrix (padding -1 at the right). Yields finished rows with their ids."""
        rank = self.pairs(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 1), self.pairs.none, np.int32)
        while len(m):
            at = rank.argmin(1)
            best = rank[np.arange(len(m)), at]
            done = best == self.pairs.none
            if done.any():
                yield rows[done], m[done]
                go = ~done
                m, rank, rows, at, best = m[go], rank[go], rows[go], at[go], best[go]
                if not len(m):
                    return
            r, w = np.arange(len(m)), m.shape[1]
            if w == 2:
                yield rows, self.pairs.new[best][:, None]
                return
            # the pair becomes one id: what follows moves up by one place
            m[r, at] = self.pairs.new[best]
            cols = np.arange(w - 1)
            shifted = cols + (cols > at[:, None])
            m = np.take_along_axis(m, shifted, 1)
            rank = np.take_along_axis(rank, np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), w - 2), 1)
            right = at < w - 2
            rank[r[right], at[right]] = self.pairs(m[r[right], at[right]], m[r[right], at[right] + 1])
            left = at > 0
            rank[r[left], at[left] - 1] = self.pairs(m[r[left], at[left] - 1], m[r[left], at[left]])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One word. A merge only makes pairs of higher rank, so all places of the lowest pair go in one round."""
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != self.pairs.none:
            at = np.flatnonzero(rank == best)
            # of overlapping places (x x x) the leftmost goes, then every second
            run = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = self.pairs.new[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            at -= np.arange(len(at))
            rank = rank[keep[1:]]  # a pair goes with its right id; pairs beside the merged ids are looked up again
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(ids) - 1)]
                rank[side] = self.pairs(ids[side], ids[side + 1])
        return ids

    def _known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the words with hashes a and b; -1 for unknown ones."""
        mask = len(self.slots) - 1
        slot = (a & np.uint64(mask)).astype(np.int64)
        word = self.slots[slot]
        wrong = np.flatnonzero((word >= 0) & ((self.hash_a[word] != a) | (self.hash_b[word] != b)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            word[wrong] = w = self.slots[slot[wrong]]
            wrong = wrong[(w >= 0) & ((self.hash_a[w] != a[wrong]) | (self.hash_b[w] != b[wrong]))]
        return word

    def _learn(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        new = np.arange(self.words, self.words + len(a), dtype=np.int32)
        if (need := self.words + len(a)) > len(self.size):
            self.hash_a, self.hash_b, self.begin, self.size = (np.concatenate([x, np.zeros(need, x.dtype)]) for x in (self.hash_a, self.hash_b, self.begin, self.size))
        if (need := self.used + len(ids)) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, np.int32)])
        if (self.words + len(a)) * 2 > len(self.slots):
            self._resize(a)
        self.hash_a[new], self.hash_b[new], self.size[new] = a, b, counts
        self.begin[new] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.words = self.used + len(ids), self.words + len(a)
        self._place(new)

    def _resize(self, more: np.ndarray) -> None:
        self.slots = np.full(1 << int(np.ceil(np.log2((self.words + len(more)) * 4))), -1, np.int32)
        self._place(np.arange(self.words, dtype=np.int32))

    def _place(self, new: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hash_a[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            placed = self.slots[slot] == new
            new, slot = new[~placed], (slot[~placed] + 1) & mask

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, one after the other, and the number of words in each text."""
        if self.words > MAX_WORDS:
            self._forget()
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        cp = np.empty(int(sizes.sum()) + len(texts), np.uint32)
        text = "".join(t for t in texts if t)
        inner = np.ones(len(cp), bool)
        inner[ends] = False
        cp[inner] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cp[ends] = 0x110000
        start = word_starts(cp)
        size = np.diff(np.append(start, len(cp)))
        is_end = cp[start] == 0x110000
        a, b = self._hashes(cp, start, size)
        start, size, a, b = start[~is_end], size[~is_end], a[~is_end], b[~is_end]
        per_text = np.diff(np.searchsorted(start, np.append(0, ends + 1)))
        word = self._known(a, b)
        unknown = np.flatnonzero(word < 0)
        if len(unknown):
            _, first = np.unique(a[unknown] ^ (b[unknown] * _MULT), return_index=True)
            fresh = unknown[first]
            utf8, from_, long = self._bytes(cp, start[fresh], size[fresh])
            ids, counts = self.merge_words(utf8, from_, long)
            self._learn(a[fresh], b[fresh], ids, counts)
            word[unknown] = self._known(a[unknown], b[unknown])
        return word, per_text

    @staticmethod
    def _bytes(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words as UTF-8 in one array, with their starts and lengths in it."""
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        points = cp[at]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        utf8 = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        long = np.add.reduceat(width, np.cumsum(size) - size)
        return utf8, np.cumsum(long) - long, long

    @staticmethod
    def _hashes(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word: sums over its code points, each mixed with its place in the word."""
        place = (np.arange(len(cp)) - np.repeat(start, size)).astype(np.uint64)
        mixed = _mix((cp.astype(np.uint64) << np.uint64(32)) ^ place ^ np.uint64(0x5851F42D4C957F2D))
        a = np.add.reduceat(mixed, start)
        mixed *= mixed | np.uint64(1)
        mixed ^= mixed >> np.uint64(32)
        return _mix(a), _mix(np.add.reduceat(mixed, start))

    def gather(self, word: np.ndarray) -> np.ndarray:
        """The ids of the words, one after the other."""
        size = self.size[word].astype(np.int64)
        at = np.repeat(self.begin[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[at]

    def lengths(self, word: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        total = np.concatenate([[0], np.cumsum(self.size[word], dtype=np.int64)])
        edge = np.concatenate([[0], np.cumsum(per_text)])
        return total[edge[1:]] - total[edge[:-1]]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
