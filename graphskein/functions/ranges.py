"""Ranges of byte strings, and what conditions on a key make of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Range:
    """Keys from ``start`` (inclusive) to ``stop`` (exclusive); None is open."""

    start: bytes = b""
    stop: bytes | None = None

    @property
    def empty(self) -> bool:
        return self.stop is not None and self.start >= self.stop

    @property
    def point(self) -> bytes | None:
        return self.start if self.stop == self.start + b"\x00" else None

    def holds(self, key: bytes) -> bool:
        return self.start <= key and (self.stop is None or key < self.stop)


ALL = (Range(),)


def point(key: bytes) -> Range:
    return Range(key, key + b"\x00")


def prefix(data: bytes) -> Range:
    """All keys that begin with ``data``."""
    kept = data.rstrip(b"\xff")
    return Range(data, kept[:-1] + bytes([kept[-1] + 1]) if kept else None)


def union(ranges: Sequence[Range]) -> tuple[Range, ...]:
    """Sorted ranges without overlap that hold the same keys."""
    out: list[Range] = []
    for r in sorted((r for r in ranges if not r.empty), key=lambda r: r.start):
        if out and (out[-1].stop is None or r.start <= out[-1].stop):
            stop = None if out[-1].stop is None or r.stop is None else max(out[-1].stop, r.stop)
            out[-1] = Range(out[-1].start, stop)
        else:
            out.append(r)
    return tuple(out)


def intersection(a: Sequence[Range], b: Sequence[Range]) -> tuple[Range, ...]:
    out = []
    for x in a:
        for y in b:
            stops = [s for s in (x.stop, y.stop) if s is not None]
            out.append(Range(max(x.start, y.start), min(stops) if stops else None))
    return union(out)


def compared(op: str, value: object, kind: str, encode) -> tuple[Range, ...] | None:
    """The keys for ``key op value`` under the primitive byte order, or None if bytes do not tell.

    Numbers sort by their bytes within a sign: non-negative ones ascending below the negative ones, negative integers
    ascending, negative floats descending. Ranges are inclusive at both ends, so strict conditions are wider here."""
    if op == "=":
        return (point(encode(value)),)
    at = encode(value)
    low, high = Range(b"", at + b"\x00"), Range(at)
    if kind in ("string", "binary"):
        return ((low,) if op in ("<", "<=") else (high,)) if op in ("<", "<=", ">", ">=") else None
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") or op not in ("<", "<=", ">", ">="):
        return None
    if value != value:
        return None
    positive, negative = Range(b"", b"\x80"), Range(b"\x80")
    falling = kind in ("float", "double")
    below = op in ("<", "<=")
    if at[0] < 0x80:
        rising = intersection((low if below else high,), (positive,))
        return union([*rising, negative] if below else [*rising, Range(b"\x80", b"\x80" + b"\x00" * (len(at) - 1) + b"\x00")] if falling and value == 0 else rising)
    inner = intersection((high if below == falling else low,), (negative,))
    return union(inner if below else [*inner, positive])
