"""A graph store with predicates, read as triples, nodes or edges.

Formats: ``graph-triples`` (option ``dgraph.triples.mode`` typed or string), ``graph-nodes`` (``dgraph.nodes.mode`` typed or
wide), ``graph-edges``. Option ``transport`` says how the store is reached: ``http`` (a cluster at ``dgraph.target(s)`` or
``path``), ``folder`` (an export in ``path``: schema.json, state.json, nodes.jsonl), or ``module:Class``.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

# fixed values: the store's types -> (type in results, its column)
TYPES = {
    "uid": ("uid", "objectUid"), "string": ("string", "objectString"), "int": ("long", "objectLong"), "float": ("double", "objectDouble"), "datetime": ("timestamp", "objectTimestamp"),
    "bool": ("boolean", "objectBoolean"), "geo": ("geo", "objectGeo"), "password": ("password", "objectPassword"), "default": ("default", "objectString"),
}
# fixed values: types in results -> Spark types, and result schemas
SPARK_TYPES = {"uid": "bigint", "string": "string", "long": "bigint", "double": "double", "timestamp": "timestamp", "boolean": "boolean", "geo": "string", "password": "string", "default": "string"}
_VALUES = "objectString string, objectLong bigint, objectDouble double, objectTimestamp timestamp, objectBoolean boolean, objectGeo string, objectPassword string, objectType string"
STRING_TRIPLES = "subject bigint, predicate string, objectString string, objectType string"
TYPED_TRIPLES = f"subject bigint, predicate string, objectUid bigint, {_VALUES}"
TYPED_NODES = f"subject bigint, predicate string, {_VALUES}"
EDGES = "subject bigint, predicate string, objectUid bigint"
# fixed values: defaults of options
CHUNK_SIZE, PREDICATES_PER_PARTITION, UIDS_PER_PARTITION, MAX_LEASE_ID, RESERVED = 100_000, 1000, 1_000_000, 1000, "dgraph."


def uid_of(text: str) -> int:
    """A uid as a number: '0x1f' or '31'; negative ones are refused."""
    n = int(text, 16) if text.lower().startswith("0x") else int(text)
    if n < 0:
        raise ValueError(f"negative uid: {text}")
    return n


@dataclass(frozen=True)
class Predicate:
    name: str
    store_type: str
    lang: bool = False

    @property
    def kind(self) -> str:
        return TYPES[self.store_type][0]


@dataclass(frozen=True)
class Ask(InputPartition):
    """What one partition asks the store for. No predicates: nothing."""

    targets: tuple[str, ...]
    predicates: tuple[Predicate, ...]
    uids: tuple[int, ...] | None = None
    range: tuple[int, int] | None = None  # from, to (exclusive)
    having: tuple[str, ...] = ()  # predicates that a node must have
    values: tuple[tuple[str, tuple], ...] = ()  # allowed values of predicates

    def text(self, first: int, after: int) -> str:
        """The store's query for the next ``first`` nodes after uid ``after``."""
        page = f", first: {first}, after: {hex(after)}"
        names = {p.name: f"pred{i + 1}" for i, p in enumerate(sorted(self.predicates, key=lambda p: p.name))}
        tests = [f"has(<{n}>)" for n in self.having]
        tests += ["(" + " OR ".join(f"eq(<{n}>, {json.dumps(v, default=str)})" for v in vs) + ")" for n, vs in self.values]
        kept = f" @filter({' AND '.join(tests)})" if tests else ""
        # each block pages over matches only, so that a short page means that no match is left
        blocks = ("" if self.uids is not None else "".join(f"\n  {v} as var(func: has(<{n}>){page}){kept}" for n, v in names.items())) + "\n"
        source = ",".join(map(hex, sorted(self.uids))) if self.uids is not None else ",".join(names.values())
        paths = "".join(f"    <{p.name}{'@*' if p.lang else ''}>{' { uid }' if p.kind == 'uid' else ''}\n" for p in sorted(self.predicates, key=lambda p: p.name))
        return f"{{{blocks}  result (func: uid({source}){page}){kept} {{\n    uid\n{paths}  }}\n}}"


# -- reaching the store


class HttpTransport:
    """A cluster reached over HTTP at one of the targets (host:port)."""

    def __init__(self, options: dict[str, str], targets: Sequence[str]):
        self.targets = targets

    def _call(self, path: str, body: str | None = None, targets: Sequence[str] | None = None) -> dict:
        error: Exception | None = None
        for target in targets or self.targets:
            try:
                request = urllib.request.Request(f"http://{target}{path}", body.encode() if body else None, {"Content-Type": "application/dql"})
                with urllib.request.urlopen(request, timeout=300) as answer:
                    return json.load(answer)
            except OSError as e:
                error = e
        raise ConnectionError(f"no target answers: {self.targets}") from error

    def schema(self) -> dict:
        return self._call("/query", "schema { predicate type lang }")["data"]

    def state(self) -> dict:
        return self._call("/state")

    def page(self, ask: Ask, first: int, after: int) -> list[dict]:
        return self._call("/query?ro=true", ask.text(first, after), ask.targets)["data"]["result"]


class FolderTransport:
    """An export in a folder: schema.json, state.json and nodes.jsonl (a node per line, ascending uid)."""

    def __init__(self, options: dict[str, str], targets: Sequence[str]):
        self.folder = Path(options.get("path") or targets[0])

    def schema(self) -> dict:
        return json.loads((self.folder / "schema.json").read_text())

    def state(self) -> dict:
        return json.loads((self.folder / "state.json").read_text())

    def page(self, ask: Ask, first: int, after: int) -> list[dict]:
        out, names = [], {p.name for p in ask.predicates}
        with (self.folder / "nodes.jsonl").open() as lines:
            for line in lines:
                node = json.loads(line)
                uid = uid_of(node["uid"])
                if uid <= after or (ask.uids is not None and uid not in ask.uids):
                    continue
                if any(n not in node for n in ask.having) or any(n in node and not set(_items(node[n])) & set(vs) for n, vs in ask.values):
                    continue
                got = {k: v for k, v in node.items() if k.split("@")[0] in names}
                if got:
                    out.append({"uid": node["uid"]} | got)
                if len(out) == first:
                    break
        return out


def _items(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _transport(options: dict[str, str], targets: Sequence[str]):
    kind = options.get("transport", "http")
    if ":" in kind:
        module, _, name = kind.partition(":")
        return getattr(importlib.import_module(module), name)(options, targets)
    return {"http": HttpTransport, "folder": FolderTransport}[kind](options, targets)


def targets_of(options: dict[str, str]) -> list[str]:
    """From ``dgraph.target``, ``dgraph.targets`` (comma list or JSON list), ``path`` or ``paths``; none is an error."""
    found: list[str] = []
    for name in ("dgraph.target", "dgraph.targets", "path", "paths"):
        if text := options.get(name, "").strip():
            found += json.loads(text) if text.startswith("[") else [t.strip() for t in text.split(",") if t.strip()]
    if not found:
        raise ValueError("no targets given")
    return list(dict.fromkeys(found))


def reserved_filter(options: dict[str, str]):
    """Which reserved predicates are read: globs in ``dgraph.include`` / ``dgraph.exclude.reserved-predicates``."""

    def patterns(text: str) -> list[re.Pattern]:
        globs = text.split(",")
        if any(not g.startswith(RESERVED) for g in globs):
            raise ValueError(f"filters of reserved predicates must start with '{RESERVED}': {text}")
        return [re.compile(".*".join(map(re.escape, g.split("*")))) for g in globs]

    take = patterns(options.get("dgraph.include.reserved-predicates", RESERVED + "*"))
    leave = patterns(options["dgraph.exclude.reserved-predicates"]) if "dgraph.exclude.reserved-predicates" in options else []
    hit = lambda some, name: any(p.fullmatch(name) for p in some)
    return lambda name: not name.startswith(RESERVED) or (hit(take, name) and not hit(leave, name))


@dataclass(frozen=True)
class Cluster:
    """groups: targets and predicates of each; lease: the greatest uid that may exist."""

    groups: dict[str, tuple[tuple[str, ...], frozenset[str]]]
    lease: int

    @classmethod
    def parse(cls, state: dict) -> Cluster:
        groups = {}
        for name, g in state.get("groups", {}).items():
            members = tuple(f"{(a := m['addr']).rsplit(':', 1)[0]}:{int(a.rsplit(':', 1)[1]) + 2000}" for m in g.get("members", {}).values())
            groups[name] = (members, frozenset(t["predicate"] for t in g.get("tablets", {}).values()))
        return cls(groups, int(state.get("maxLeaseId") or MAX_LEASE_ID))

    @property
    def targets(self) -> tuple[str, ...]:
        return tuple(t for members, _ in self.groups.values() for t in members)


def _rotated(xs: tuple, by: int) -> tuple:
    return xs[by % len(xs) :] + xs[: by % len(xs)] if xs else xs


def spread(predicates: Sequence[Predicate], parts: int) -> list[tuple[Predicate, ...]]:
    """Predicates in the order of the MD5 of their names, dealt to ``parts`` in turn."""
    if parts < 1:
        raise ValueError("partitions must be larger than zero")
    order = sorted(predicates, key=lambda p: hashlib.md5(p.name.encode()).digest())
    return [tuple(order[i::parts]) for i in range(min(parts, len(order)))]


def partitions_of(options: dict[str, str], cluster: Cluster, predicates: Sequence[Predicate]) -> list[Ask]:
    """By option ``dgraph.partitioner``: singleton, group, alpha, predicate, uid-range, or one of them with '+uid-range'."""
    name = options.get("dgraph.partitioner", "predicate+uid-range")
    base, _, ranged = name.partition("+")
    if (ranged and ranged != "uid-range") or (ranged and base == "uid-range"):
        raise ValueError(f"unknown partitioner: {name}")
    number = lambda key, default: int(options.get(key, default))
    of_group = lambda names: [p for p in predicates if p.name in names]
    if base in ("singleton", "uid-range"):
        asks = [Ask(cluster.targets, tuple(predicates))]
    elif base == "group":
        asks = [Ask(t, tuple(of_group(names))) for t, names in cluster.groups.values() if of_group(names)]
    elif base == "alpha":
        per = number("dgraph.partitioner.alpha.partitionsPerAlpha", 1)
        asks = [Ask(_rotated(t, i), part) for t, names in cluster.groups.values() if of_group(names) for i, part in enumerate(spread(of_group(names), max(1, len(t)) * per))]
    elif base == "predicate":
        per = number("dgraph.partitioner.predicate.predicatesPerPartition", PREDICATES_PER_PARTITION)
        asks = [Ask(_rotated(t, i), part) for t, names in cluster.groups.values() if (own := of_group(names)) for i, part in enumerate(spread(own, 1 + (len(own) - 1) // per))]
    else:
        raise ValueError(f"unknown partitioner: {name}")
    if ranged or base == "uid-range":
        size = number("dgraph.partitioner.uidRange.uidsPerPartition", UIDS_PER_PARTITION)
        if (estimator := options.get("dgraph.partitioner.uidRange.estimator", "maxLeaseId").lower()) != "maxleaseid":
            raise ValueError(f"unknown estimator: {estimator}")
        most = number("dgraph.partitioner.uidRange.estimator.maxLeaseId.id", cluster.lease)
        parts = (most - 1) // size + 1
        if parts > 1:
            asks = [replace(a, targets=_rotated(a.targets, i), range=(1 + i * size, 1 + (i + 1) * size)) for a in asks for i in range(parts)]
    return asks


# -- filters


@dataclass
class Wanted:
    """What pushed filters allow; None allows all."""

    uids: set[int] | None = None
    names: set[str] | None = None
    kinds: set[str] | None = None
    having: set[str] = field(default_factory=set)
    values: dict[str, set] = field(default_factory=dict)  # per column

    def add(self, f: Filter, mode: str) -> None:
        column = f.attribute[0]
        allowed = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if allowed is not None:
            allowed.discard(None)
        both = lambda now, more: more if now is None else now & more
        if column == "subject":
            self.uids = self.uids if allowed is None else both(self.uids, allowed)
        elif mode == "wide":
            self.having.add(column)
            if allowed is not None:
                self.values[column] = both(self.values.get(column), allowed)
        elif column == "predicate":
            self.names = self.names if allowed is None else both(self.names, allowed)
        elif column == "objectType":
            self.kinds = self.kinds if allowed is None else both(self.kinds, allowed)
        else:
            if mode != "string":  # a filled column tells the type
                self.kinds = both(self.kinds, {kind for kind, c in TYPES.values() if c == column})
            if allowed is not None:
                self.values[column] = both(self.values.get(column), allowed)


def narrowed(asks: list[Ask], wanted: Wanted, mode: str) -> list[Ask]:
    """Only what the filters allow. Value filters go to the store where a partition has a single predicate, or the table is wide."""
    out = []
    for a in asks:
        keep = tuple(p for p in a.predicates if (wanted.names is None or p.name in wanted.names) and (wanted.kinds is None or p.kind in wanted.kinds))
        uids = None if wanted.uids is None else tuple(sorted(u for u in wanted.uids if a.range is None or a.range[0] <= u < a.range[1]))
        if not keep or uids == () or any(not v for v in wanted.values.values()):
            continue
        names = {p.name for p in a.predicates}
        having = tuple(sorted(wanted.having & names)) if mode == "wide" else ()
        values: tuple = ()
        plain = lambda vs: all(isinstance(v, (str, int, float, bool)) for v in vs)
        if mode == "wide":
            values = tuple((n, tuple(vs)) for n, vs in wanted.values.items() if n in names and plain(vs))
        elif len(keep) == 1 and keep[0].kind not in ("uid", "timestamp", "geo", "password") and mode != "string":
            values = tuple((keep[0].name, tuple(vs)) for c, vs in wanted.values.items() if c == TYPES[keep[0].store_type][1] and plain(vs))
        out.append(replace(a, predicates=keep, uids=uids, having=having, values=values))
    return out


# -- rows


def value_of(kind: str, raw: object) -> object:
    """A value of the store's JSON in the result's type."""
    if kind == "uid":
        return uid_of(raw["uid"])
    if kind == "long":
        return int(raw)
    if kind == "double":
        return float(raw)
    if kind == "boolean":
        return raw if isinstance(raw, bool) else str(raw).lower() == "true"
    if kind == "timestamp":
        t = datetime.fromisoformat(str(raw).replace("Z", "+00:00"))
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    if kind == "geo":
        return json.dumps(raw, separators=(",", ":")) if not isinstance(raw, str) else raw
    return str(raw)


def _facts(node: dict, known: dict[str, Predicate]) -> Iterator[tuple[str, Predicate, object]]:
    for key, raw in node.items():
        name = key.split("@")[0]
        p = known.get(key) or (known.get(name) if name in known and known[name].lang else None)
        if key != "uid" and p is not None:
            for item in _items(raw):
                if item is not None:
                    yield key, p, item


def rows_of(node: dict, predicates: Sequence[Predicate], mode: str, columns: Sequence[str]) -> Iterator[tuple]:
    """The rows of a node: one per value, or one for all in wide mode."""
    uid, known = uid_of(node["uid"]), {p.name: p for p in predicates}
    if mode == "wide":
        cells = {}
        for key, p, item in _facts(node, known):
            cells.setdefault(key.split("@")[0] if key not in columns else key, value_of(p.kind, item))
        yield tuple(uid if c == "subject" else cells.get(c) for c in columns)
        return
    for key, p, item in _facts(node, known):
        value = value_of(p.kind, item)
        if mode == "string":
            text = str(value).lower() if isinstance(value, bool) else value.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(value, datetime) else str(value)
            yield uid, key, text, p.kind
        elif mode == "edges":
            yield uid, key, value
        else:
            row = {"subject": uid, "predicate": key, "objectType": p.kind, TYPES[p.store_type][1]: value}
            yield tuple(row.get(c) for c in columns)


class GraphStoreReader(DataSourceReader):
    def __init__(self, source: GraphStoreSource, schema: StructType):
        self.options, self.mode, self.columns = source.settings, source.mode, schema.names
        self.predicates, self.targets, self.cluster, self.wanted = source.predicates(), source.targets, source.cluster(), Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1:
                self.wanted.add(f, self.mode)
            yield f  # the store may know more than the filter says, so Spark looks again

    def partitions(self) -> Sequence[Ask]:
        options = self.options | ({"dgraph.partitioner": "singleton+uid-range"} if self.mode == "wide" else {})
        asks = narrowed(partitions_of(options, self.cluster, self.predicates), self.wanted, self.mode)
        return [replace(a, targets=a.targets or tuple(self.targets)) for a in asks] or [Ask(tuple(self.targets), ())]

    def read(self, ask: Ask) -> Iterator[tuple]:
        if ask is None or not ask.predicates:
            return
        transport, size = _transport(self.options, ask.targets), int(self.options.get("dgraph.chunksize", CHUNK_SIZE))
        after, until = (ask.range[0] - 1, ask.range[1]) if ask.range else (0, None)
        while True:
            page = transport.page(ask, size, after)
            for node in page:
                after = uid_of(node["uid"])
                if until is not None and after >= until:
                    return
                yield from rows_of(node, ask.predicates, self.mode, self.columns)
            if len(page) < size:
                return


class GraphStoreSource(DataSource):
    """Base of the three formats. Option names are read in any case; ``columns`` limits a wide table to these predicates."""

    only: str | None = None

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        lower = {k.lower(): v for k, v in options.items()}
        names = ("dgraph.include.reserved-predicates", "dgraph.partitioner.alpha.partitionsPerAlpha", "dgraph.partitioner.predicate.predicatesPerPartition", "dgraph.partitioner.uidRange.uidsPerPartition", "dgraph.partitioner.uidRange.estimator", "dgraph.partitioner.uidRange.estimator.maxLeaseId.id")
        self.settings = lower | {n: lower[n.lower()] for n in names if n.lower() in lower}
        self.targets = targets_of(self.settings)
        if self.settings.get("dgraph.transaction.mode", "none") not in ("none", "read"):
            raise ValueError(f"unknown transaction mode: {self.settings['dgraph.transaction.mode']}")

    @property
    def mode(self) -> str:
        raise NotImplementedError

    def _chosen(self, key: str, default: str, known: Sequence[str]) -> str:
        if (mode := self.settings.get(key, default).lower()) not in known:
            raise ValueError(f"unknown mode in {key}: {mode}")
        return mode

    def predicates(self) -> list[Predicate]:
        keep, out = reserved_filter(self.settings), []
        for x in _transport(self.settings, self.targets).schema().get("schema", []):
            if x.get("type", "default") not in TYPES:
                raise ValueError(f"unknown type of predicate {x['predicate']}: {x['type']}")
            p = Predicate(x["predicate"], x.get("type", "default"), bool(x.get("lang", False)))
            if keep(p.name) and (self.only is None or (p.kind == "uid") == (self.only == "edges")):
                out.append(p)
        if (columns := self.settings.get("columns")) and self.mode == "wide":
            out = [p for p in out if p.name in columns.split(",")]
        return sorted(out, key=lambda p: p.name)

    def cluster(self) -> Cluster:
        return Cluster.parse(_transport(self.settings, self.targets).state())

    def reader(self, schema: StructType) -> GraphStoreReader:
        return GraphStoreReader(self, schema)


class TripleSource(GraphStoreSource):
    """All predicates, a row per value."""

    @classmethod
    def name(cls) -> str:
        return "graph-triples"

    @property
    def mode(self) -> str:
        return self._chosen("dgraph.triples.mode", "typed", ("typed", "string"))

    def schema(self) -> str:
        return STRING_TRIPLES if self.mode == "string" else TYPED_TRIPLES


class NodeSource(GraphStoreSource):
    """Predicates with values only: a row per value, or a row per node with a column per predicate."""

    only = "nodes"

    @classmethod
    def name(cls) -> str:
        return "graph-nodes"

    @property
    def mode(self) -> str:
        return self._chosen("dgraph.nodes.mode", "typed", ("typed", "wide"))

    def schema(self) -> str:
        if self.mode == "typed":
            return TYPED_NODES
        return ", ".join(["subject bigint", *(f"`{p.name}` {SPARK_TYPES[p.kind]}" for p in self.predicates())])


class EdgeSource(GraphStoreSource):
    """Predicates between nodes only."""

    only, mode = "edges", "edges"

    @classmethod
    def name(cls) -> str:
        return "graph-edges"

    def schema(self) -> str:
        return EDGES
