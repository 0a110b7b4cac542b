"""A wide-column store, read and written by a JSON catalog. Format ``wide-column``.

The catalog has ``table`` (namespace, name, tableCoder), ``rowkey`` ('a' or 'a:b') and ``columns`` (name -> cf, col, type or
DDL type, length, coder). Cells are (row, family, qualifier, timestamp, value). Option ``store`` says where they are:
``folder`` (sorted regions of JSON lines below ``path``) or ``module:Class`` with the methods of :class:`FolderStore`.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import DataType, MapType, StructType

from graphskein.functions.coders import FORMATS, coder
from graphskein.functions.ranges import ALL, Range, compared, intersection, point, prefix, union

ROW_KEY = "rowkey"
#: Rows per bulk get; regions of a new table at least.
BULK_GET, LEAST_REGIONS = 100, 4


@dataclass(frozen=True)
class Field:
    name: str
    family: str
    qualifier: str
    kind: str
    coder: str
    length: int = -1

    @property
    def is_key(self) -> bool:
        return self.family == ROW_KEY


@dataclass(frozen=True)
class Catalog:
    namespace: str
    table: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]

    @classmethod
    def parse(cls, text: str) -> Catalog:
        doc = json.loads(text)
        table = doc["table"]
        default = table.get("tableCoder", "primitive")
        key = tuple(doc[ROW_KEY].split(":"))
        fields = tuple(Field(n, c["cf"], c["col"], c.get("type", "binary").lower(), c.get("coder", default), int(c.get("length", -1))) for n, c in doc["columns"].items())
        names = {f.qualifier: f for f in fields if f.is_key}
        if set(names) != set(key):
            raise ValueError("the row key does not match the columns of family 'rowkey'")
        if len(key) > 1:
            if any(not coder(names[k].coder).composite for k in key):
                raise ValueError("composite keys need the primitive coder")
            widths = [names[k].length if names[k].length > 0 else _width(names[k].kind) for k in key]
            if any(w < 0 for w in widths[:-1]):
                raise ValueError("only the last part of a composite key may have an open length")
        return cls(table.get("namespace", "default"), table["name"], key, fields)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{f.name}` {f.kind}" for f in self.fields)

    @property
    def key_fields(self) -> list[Field]:
        by = {f.qualifier: f for f in self.fields if f.is_key}
        return [by[k] for k in self.key]


def _width(kind: str) -> int:
    return 1 if kind == "boolean" else {">b": 1, ">h": 2, ">i": 4, ">q": 8, ">f": 4, ">d": 8}.get(FORMATS.get(kind, ""), -1)


def split_key(catalog: Catalog, row: bytes) -> dict[str, object]:
    """The values of the key's parts."""
    out, at = {}, 0
    parts = catalog.key_fields
    for f in parts:
        width = len(row) - at if f is parts[-1] and f.length < 0 and _width(f.kind) < 0 else (f.length if f.length > 0 else _width(f.kind))
        width = len(row) - at if len(parts) == 1 else width
        out[f.name] = coder(f.coder).decode(row[at : at + width], f.kind, True) if len(parts) == 1 else coder(f.coder).decode(row[at : at + width], f.kind)
        at += width
    return out


def join_key(catalog: Catalog, values: dict[str, object]) -> bytes:
    parts = catalog.key_fields
    if any(values.get(f.name) is None for f in parts):
        raise ValueError("a row key is null")
    if len(parts) == 1:
        return coder(parts[0].coder).encode(values[parts[0].name], parts[0].kind, True)
    out = b""
    for f in parts:
        data = coder(f.coder).encode(values[f.name], f.kind)
        if f.length > 0 and len(data) != f.length:
            raise ValueError(f"{f.name} has {len(data)} bytes, not {f.length}")
        out += data
    return out


# -- the store

Cell = tuple[str, str, int, bytes]  # family, qualifier, timestamp, value


class FolderStore:
    """Regions as files of JSON lines ``{"row": ..., "cells": [[family, qualifier, timestamp, value], ...]}``, bytes in base64.

    ``regions.json`` lists the first keys. Writers add files to a region; a reader merges those of its region."""

    def __init__(self, options: dict[str, str]):
        self.root = Path(options["path"].removeprefix("file://"))

    def _table(self, catalog: Catalog) -> Path:
        return self.root / catalog.namespace / catalog.table

    def exists(self, catalog: Catalog) -> bool:
        return (self._table(catalog) / "regions.json").exists()

    def create(self, catalog: Catalog, starts: Sequence[bytes]) -> None:
        self._table(catalog).mkdir(parents=True, exist_ok=True)
        (self._table(catalog) / "regions.json").write_text(json.dumps([base64.b64encode(s).decode() for s in starts]))

    def regions(self, catalog: Catalog) -> list[Range]:
        starts = [base64.b64decode(s) for s in json.loads((self._table(catalog) / "regions.json").read_text())]
        return [Range(s, e) for s, e in zip(starts, [*starts[1:], None])]

    def put(self, catalog: Catalog, rows: Iterator[tuple[bytes, list[Cell]]], name: str) -> list[str]:
        """Writes to temporary files, by region; their names are for :meth:`commit`."""
        regions, files, made = self.regions(catalog), {}, []
        try:
            for row, cells in rows:
                k = max(i for i, r in enumerate(regions) if r.start <= row)
                if k not in files:
                    path = self._table(catalog) / f"region-{k}" / f".{name}.jsonl"
                    path.parent.mkdir(exist_ok=True)
                    files[k] = path.open("w")
                    made.append(str(path))
                files[k].write(json.dumps({"row": base64.b64encode(row).decode(), "cells": [[c[0], c[1], c[2], base64.b64encode(c[3]).decode()] for c in cells]}) + "\n")
        finally:
            for f in files.values():
                f.close()
        return made

    def commit(self, names: Sequence[str]) -> None:
        for n in names:
            Path(n).rename(Path(n).with_name(Path(n).name.removeprefix(".")))

    def abort(self, names: Sequence[str]) -> None:
        for n in names:
            Path(n).unlink(missing_ok=True)

    def scan(self, catalog: Catalog, region: Range, ranges: Sequence[Range], families: set[str] | None) -> Iterator[tuple[bytes, list[Cell]]]:
        """Rows of a region in key order, with all versions of their cells."""
        k = self.regions(catalog).index(region)
        rows: dict[bytes, list[Cell]] = {}
        for path in sorted((self._table(catalog) / f"region-{k}").glob("[!.]*.jsonl")):
            with path.open() as lines:
                for line in lines:
                    x = json.loads(line)
                    row = base64.b64decode(x["row"])
                    if any(r.holds(row) for r in ranges):
                        rows.setdefault(row, []).extend((c[0], c[1], c[2], base64.b64decode(c[3])) for c in x["cells"] if families is None or c[0] in families)
        yield from sorted(rows.items())

    def get(self, catalog: Catalog, region: Range, keys: Sequence[bytes], families: set[str] | None) -> Iterator[tuple[bytes, list[Cell]]]:
        yield from self.scan(catalog, region, [point(k) for k in keys], families)


def _store(options: dict[str, str]):
    kind = options.get("store", "folder")
    if ":" in kind:
        module, _, name = kind.partition(":")
        return getattr(importlib.import_module(module), name)(options)
    if kind != "folder":
        raise ValueError(f"unknown store: {kind}")
    return FolderStore(options)


@dataclass(frozen=True)
class Times:
    """Which versions count: at one timestamp, within [min, max), at most so many of the newest; null where none does."""

    timestamp: int | None = None
    least: int | None = None
    most: int | None = None
    versions: int | None = None
    to_latest: bool = True

    @classmethod
    def of(cls, options: dict[str, str]) -> Times:
        get = lambda k: int(options[k]) if k in options else None
        t = cls(get("timestamp"), get("minstamp"), get("maxstamp"), get("maxversions"), options.get("mergetolatest", "true").lower() == "true")
        if (t.least is None) != (t.most is None) or (t.timestamp is not None and t.least is not None):
            raise ValueError("give timestamp, or minStamp and maxStamp, or neither")
        return t

    def pick(self, cells: Sequence[Cell]) -> list[Cell]:
        """The versions of one column that count, newest first."""
        keep = [c for c in cells if (self.timestamp is None or c[2] == self.timestamp) and (self.least is None or self.least <= c[2] < self.most)]
        return sorted(keep, key=lambda c: -c[2])[: self.versions or 1]


@dataclass(frozen=True)
class Part(InputPartition):
    region: Range | None
    ranges: tuple[Range, ...] = ()


@dataclass
class Pushed:
    """Key ranges from the filters given."""

    catalog: Catalog
    ranges: tuple[Range, ...] = ALL

    def add(self, f: Filter) -> None:
        got = self.of(f)
        if got is not None:
            self.ranges = intersection(self.ranges, got)

    def of(self, f: Filter) -> tuple[Range, ...] | None:
        """The key ranges that can meet ``f``, None if any can."""
        key = self.catalog.key_fields[0]
        if isinstance(f, Not) or not hasattr(f, "attribute") or f.attribute != (key.name,):
            return None
        one = len(self.catalog.key) == 1
        c = coder(key.coder)
        encode = lambda v: c.encode(v, key.kind, one)
        plain = key.coder == "primitive"
        if isinstance(f, EqualTo) and f.value is not None:
            return (point(encode(f.value)),) if one else (prefix(encode(f.value)),) if _fixed(key) else None
        if isinstance(f, In):
            found = [encode(v) for v in f.value if v is not None]
            return union([point(x) if one else prefix(x) for x in found]) if one or _fixed(key) else None
        for kind, op in ((LessThan, "<"), (LessThanOrEqual, "<="), (GreaterThan, ">"), (GreaterThanOrEqual, ">=")):
            if isinstance(f, kind) and plain and f.value is not None:
                got = compared(op, f.value, key.kind, encode)
                if got is not None and not one:  # a part's greatest value is followed by other parts
                    got = union([Range(r.start, prefix(r.stop[:-1]).stop if r.stop and r.stop.endswith(b"\x00") else r.stop) for r in got])
                return got
        if isinstance(f, StringStartsWith) and plain and key.kind == "string":
            return (prefix(f.value.encode()),)
        return None


def _fixed(f: Field) -> bool:
    return f.length > 0 or _width(f.kind) > 0


class WideColumnReader(DataSourceReader):
    def __init__(self, options: dict[str, str], catalog: Catalog, schema: StructType):
        self.options, self.catalog, self.schema_ = options, catalog, schema
        self.times, self.pushed = Times.of(options), Pushed(catalog)
        self.restrictive = options.get("restrictive", "FAMILY").upper()
        if self.restrictive not in ("NONE", "FAMILY", "COLUMN"):
            raise ValueError(f"unknown value of restrictive: {self.restrictive}")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            self.pushed.add(f)
            yield f  # ranges may be wider than the filter, so Spark looks again

    def partitions(self) -> Sequence[Part]:
        parts = [Part(r, hit) for r in _store(self.options).regions(self.catalog) if (hit := intersection((r,), self.pushed.ranges))]
        return parts or [Part(None)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part is None or part.region is None:
            return
        wanted = [next(f for f in self.catalog.fields if f.name == n) for n in self.schema_.names]
        families = None if self.restrictive == "NONE" else {f.family for f in wanted if not f.is_key}
        families = families or None
        store = _store(self.options)
        points = [r.point for r in part.ranges]
        if part.ranges and all(p is not None for p in points):
            rows = (x for i in range(0, len(points), BULK_GET) for x in store.get(self.catalog, part.region, points[i : i + BULK_GET], families))
        else:
            rows = store.scan(self.catalog, part.region, part.ranges, families)
        types = {f.name: t.dataType for f, t in zip(wanted, self.schema_.fields)}
        for row, cells in rows:
            keys = split_key(self.catalog, row)
            yield tuple(keys[f.name] if f.is_key else self._value(f, types[f.name], cells) for f in wanted)

    def _value(self, f: Field, kind: DataType, cells: Sequence[Cell]) -> object:
        own = [c for c in cells if c[0] == f.family]
        c = coder(f.coder)
        decode = lambda data, t: c.decode(data, t.simpleString())
        if not isinstance(kind, MapType):
            got = self.times.pick([x for x in own if x[1] == f.qualifier])
            return decode(got[0][3], kind) if got else None
        if kind.keyType.simpleString() == "bigint":  # versions
            return {x[2]: decode(x[3], kind.valueType) for x in self.times.pick([x for x in own if x[1] == f.qualifier])}
        fixed = {g.qualifier for g in self.catalog.fields if g.family == f.family and g is not f}
        by: dict[str, list[Cell]] = {}
        for x in own:
            if x[1] not in fixed:  # qualifiers without a column of their own
                by.setdefault(x[1], []).append(x)
        inner = kind.valueType
        out = {}
        for q, xs in by.items():
            if got := self.times.pick(xs):
                out[q] = {x[2]: decode(x[3], inner.valueType) for x in got} if isinstance(inner, MapType) else decode(got[0][3], inner)
        return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WideColumnWriter(DataSourceWriter):
    """Adds rows; a null cell is left out. An option ``timestamp`` dates them, else the clock."""

    def __init__(self, options: dict[str, str], catalog: Catalog, schema: StructType):
        self.options, self.catalog, self.names = options, catalog, schema.names
        self.stamp = int(options["timestamp"]) if "timestamp" in options else None
        store = _store(options)
        if not store.exists(catalog):
            regions = int(options.get("newtable", LEAST_REGIONS))
            if regions < LEAST_REGIONS:
                raise ValueError(f"a new table needs at least {LEAST_REGIONS} regions")
            store.create(catalog, [b"", *(bytes([256 * i // regions]) for i in range(1, regions))])

    def write(self, iterator: Iterator) -> Written:
        now = self.stamp if self.stamp is not None else int(time.time() * 1000)
        cells = [f for f in self.catalog.fields if not f.is_key]

        def rows() -> Iterator[tuple[bytes, list[Cell]]]:
            for r in iterator:
                values = dict(zip(self.names, r))
                yield join_key(self.catalog, values), [(f.family, f.qualifier, now, coder(f.coder).encode(values[f.name], f.kind)) for f in cells if values.get(f.name) is not None]

        return Written(_store(self.options).put(self.catalog, rows(), uuid.uuid4().hex))

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                _store(self.options).commit(m.files)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                _store(self.options).abort(m.files)


class WideColumnSource(DataSource):
    """Option ``catalog`` has the JSON; others: timestamp, minStamp and maxStamp, maxVersions, mergeToLatest, restrictive, newTable."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.settings = {k.lower(): v for k, v in options.items()}
        self.catalog = Catalog.parse(self.settings["catalog"])

    @classmethod
    def name(cls) -> str:
        return "wide-column"

    def schema(self) -> str:
        return self.catalog.schema

    def reader(self, schema: StructType) -> WideColumnReader:
        return WideColumnReader(self.settings, self.catalog, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WideColumnWriter:
        return WideColumnWriter(self.settings, self.catalog, schema)
