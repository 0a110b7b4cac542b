"""Sources over exports in folders: rows, pushed filters, partitions, queries."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, StringStartsWith

from graphskein.functions.coders import PrimitiveCoder, TypedCoder
from graphskein.functions.ranges import Range, compared, intersection, point, prefix, union
from graphskein.sources import register
from graphskein.sources.graphstore import Ask, Cluster, EdgeSource, NodeSource, Predicate, TripleSource, partitions_of, reserved_filter, rows_of, spread, targets_of
from graphskein.sources.readers import EDGE_COLUMNS, VERTEX_COLUMNS, GraphStoreGraphs, WideColumnGraphs, catalog
from graphskein.sources.widecolumn import Catalog, Pushed, join_key, split_key

SCHEMA = [("name", "string", True), ("age", "int", False), ("score", "float", False), ("on", "bool", False), ("born", "datetime", False), ("at", "geo", False), ("pass_word", "password", False), ("friend", "uid", False), ("dgraph.type", "string", False)]
NODES = [
    {"uid": "0x1", "name": "A", "name@en": "A en", "age": 3, "friend": [{"uid": "0x2"}, {"uid": "0x3"}], "dgraph.type": ["P", "Q"]},
    {"uid": "0x2", "name": "B", "score": 1.5, "on": True, "born": "2020-01-02T03:04:05Z", "friend": [{"uid": "0x1"}]},
    {"uid": "0x3", "age": 4, "at": {"type": "Point", "coordinates": [1, 2]}, "pass_word": "x"},
    {"uid": "0x10", "friend": {"uid": "0x3"}},
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    register(spark)
    d = tmp_path_factory.mktemp("store")
    (d / "schema.json").write_text(json.dumps({"schema": [{"predicate": p, "type": t, "lang": lang} for p, t, lang in SCHEMA]}))
    tablets = lambda names: {n: {"predicate": n} for n in names}
    groups = {"1": {"members": {"1": {"addr": "a:7080"}, "2": {"addr": "b:7080"}}, "tablets": tablets([p for p, _, _ in SCHEMA[:5]])}, "2": {"members": {"3": {"addr": "c:7080"}}, "tablets": tablets([p for p, _, _ in SCHEMA[5:]])}}
    (d / "state.json").write_text(json.dumps({"cid": "x", "maxLeaseId": 40, "groups": groups}))
    (d / "nodes.jsonl").write_text("".join(json.dumps(n) + "\n" for n in NODES))
    return {"path": str(d), "transport": "folder"}


def read(spark, store, kind, **more):
    return spark.read.format(f"graph-{kind}").options(**store | more).load()


def test_triples(spark, store):
    t = read(spark, store, "triples")
    assert t.columns[0] == "subject" and t.count() == 16
    assert t.where("objectType = 'uid'").count() == 4
    assert t.where("predicate = 'age'").select("objectLong").collect() == [(3,), (4,)]
    assert t.where("objectTimestamp is not null").first().objectTimestamp == datetime(2020, 1, 2, 3, 4, 5)
    s = {(r.subject, r.predicate, r.objectString, r.objectType) for r in read(spark, store, "triples", **{"dgraph.triples.mode": "string"}).collect()}
    assert (1, "name@en", "A en", "string") in s and (2, "on", "true", "boolean") in s and (1, "friend", "2", "uid") in s and (2, "born", "2020-01-02T03:04:05Z", "timestamp") in s


def test_pages_and_partitions_change_nothing(spark, store):
    want = sorted(map(str, read(spark, store, "triples").collect()))
    for more in ({"dgraph.chunkSize": "1"}, {"dgraph.partitioner": "singleton"}, {"dgraph.partitioner": "group"}, {"dgraph.partitioner": "alpha+uid-range", "dgraph.partitioner.uidRange.uidsPerPartition": "2"}, {"dgraph.partitioner": "predicate", "dgraph.partitioner.predicate.predicatesPerPartition": "2"}):
        assert sorted(map(str, read(spark, store, "triples", **more).collect())) == want


def test_nodes_and_edges(spark, store):
    assert read(spark, store, "nodes").where("predicate = 'friend'").count() == 0
    wide = read(spark, store, "nodes", **{"dgraph.nodes.mode": "wide", "dgraph.exclude.reserved-predicates": "dgraph.*"})
    assert wide.columns == ["subject", "age", "at", "born", "name", "on", "pass_word", "score"]
    assert wide.where("subject = 2").select("name", "on", "score").first() == ("B", True, 1.5)
    assert wide.where("age = 4").select("subject").collect() == [(3,)]
    assert read(spark, store, "nodes", **{"dgraph.nodes.mode": "wide", "columns": "age,name"}).columns == ["subject", "age", "name"]
    assert sorted(map(tuple, read(spark, store, "edges").collect())) == [(1, "friend", 2), (1, "friend", 3), (2, "friend", 1), (16, "friend", 3)]
    assert read(spark, store, "edges").where("subject in (1, 16)").count() == 3
    assert read(spark, store, "edges").where("predicate = 'nope'").count() == 0


def asks(source, store, *filters, **more):
    r = source(store | more)
    reader = r.reader(type("S", (), {"names": [c.split(" ")[0] for c in r.schema().split(", ")]}))
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader.partitions()


def test_pushed_filters(store):
    one = asks(TripleSource, store, EqualTo(("objectType",), "long"), In(("subject",), (1, 7)))
    assert [(tuple(p.name for p in a.predicates), a.uids) for a in one] == [(("age",), (1, 7))]
    assert [a.values for a in asks(TripleSource, store, EqualTo(("objectLong",), 3))] == [(("age", (3,)),)]
    assert [a.predicates for a in asks(TripleSource, store, EqualTo(("predicate",), "a"), EqualTo(("predicate",), "b"))] == [()]
    assert {p.kind for a in asks(TripleSource, store, IsNotNull(("objectDouble",))) for p in a.predicates} == {"double"}
    wide = asks(NodeSource, store, IsNotNull(("age",)), EqualTo(("name",), "A"), **{"dgraph.nodes.mode": "wide"})
    assert wide[0].having == ("age", "name") and wide[0].values == (("name", ("A",)),)
    assert len(asks(EdgeSource, store)) == 1


def test_query_text():
    ask = Ask(("t",), (Predicate("name", "string", True), Predicate("friend", "uid")))
    assert ask.text(10, 31) == "{\n  pred1 as var(func: has(<friend>), first: 10, after: 0x1f)\n  pred2 as var(func: has(<name>), first: 10, after: 0x1f)\n  result (func: uid(pred1,pred2), first: 10, after: 0x1f) {\n    uid\n    <friend> { uid }\n    <name@*>\n  }\n}"
    some = Ask(("t",), (Predicate("age", "int"),), uids=(3, 1), having=("age",), values=(("age", (5,)),))
    assert some.text(2, 0) == "{\n  result (func: uid(0x1,0x3), first: 2, after: 0x0) @filter(has(<age>) AND (eq(<age>, 5))) {\n    uid\n    <age>\n  }\n}"


class TextTransport:
    """Answers the text of the query as the store does: every block filters, pages, and hands its uids on."""

    def __init__(self, options, targets):
        pass

    def schema(self):
        return {"schema": [{"predicate": "age", "type": "int"}, {"predicate": "name", "type": "string"}]}

    def state(self):
        return {"maxLeaseId": 50, "groups": {"1": {"members": {"1": {"addr": "a:7080"}}, "tablets": {n: {"predicate": n} for n in ("age", "name")}}}}

    def page(self, ask, first, after):
        nodes = {u: {"age": u % 10} | ({"name": "A"} if u % 7 == 0 else {}) for u in range(1, 51)}
        found = {}
        for block in re.findall(r"^  \S+ .*func: .*$", ask.text(first, after), re.M):
            name, func, at = re.search(r"^  (\w+) .*func: (\w+\(.*?\)), first: \d+, after: (\w+)\)", block).groups()
            args = re.findall(r"[\w.]+", func)[1:]
            uids = [u for u in nodes if args[0] in nodes[u]] if func.startswith("has") else sorted({u for a in args for u in (found[a] if a in found else [int(a, 16)])})
            for n in re.findall(r"(?<!func: )has\(<(\w+)>\)", block):
                uids = [u for u in uids if n in nodes[u]]
            for group in re.findall(r"\((eq\(.*?\)(?: OR eq\(.*?\))*)\)", block):
                uids = [u for u in uids if any(nodes[u].get(n) == json.loads(v) for n, v in re.findall(r"eq\(<(\w+)>, (.*?)\)", group))]
            found[name] = [u for u in uids if u > int(at, 16)][:first]
        return [{"uid": hex(u)} | {k: v for k, v in nodes[u].items() if k in {p.name for p in ask.predicates}} for u in found["result"]]


def test_filtered_pages_are_read_to_the_end():
    options = {"path": "x", "transport": f"{__name__}:TextTransport", "dgraph.chunkSize": "4"}

    def subjects(source, *filters, **more):
        r = source(options | more)
        reader = r.reader(type("S", (), {"names": [c.split(" ")[0].strip("`") for c in r.schema().split(", ")]}))
        list(reader.pushFilters(list(filters)))
        return sorted({row[0] for ask in reader.partitions() for row in reader.read(ask)})

    wide = {"dgraph.nodes.mode": "wide"}
    assert subjects(TripleSource) == list(range(1, 51))
    assert subjects(TripleSource, EqualTo(("objectLong",), 3)) == [3, 13, 23, 33, 43]
    assert subjects(TripleSource, In(("objectLong",), (3, 9)), In(("subject",), (3, 4, 9, 13, 19, 23))) == [3, 9, 13, 19, 23]
    assert subjects(NodeSource, IsNotNull(("name",)), **wide) == [7, 14, 21, 28, 35, 42, 49]
    assert subjects(NodeSource, IsNotNull(("name",)), In(("age",), (5, 9)), **wide) == [35, 49]


def test_options_and_partitions():
    assert targets_of({"dgraph.target": "a:1", "dgraph.targets": "b:1, a:1"}) == ["a:1", "b:1"]
    for bad in ({}, {"path": " "}):
        with pytest.raises(ValueError):
            targets_of(bad)
    keep = reserved_filter({"dgraph.include.reserved-predicates": "dgraph.type,dgraph.g*", "dgraph.exclude.reserved-predicates": "dgraph.graphql.*"})
    assert [keep(n) for n in ("x", "dgraph.type", "dgraph.typed", "dgraph.graph", "dgraph.graphql.x")] == [True, True, False, True, False]
    with pytest.raises(ValueError):
        reserved_filter({"dgraph.include.reserved-predicates": "name"})
    preds = [Predicate(f"p{i}", "string") for i in range(7)]
    assert sorted(p.name for part in spread(preds, 3) for p in part) == [p.name for p in preds] and [len(x) for x in spread(preds, 3)] == [3, 2, 2]
    cluster = Cluster({"1": (("a", "b"), frozenset(p.name for p in preds))}, 10)
    parts = partitions_of({"dgraph.partitioner": "singleton+uid-range", "dgraph.partitioner.uidRange.uidsPerPartition": "4"}, cluster, preds)
    assert [(a.range, a.targets[0]) for a in parts] == [((1, 5), "a"), ((5, 9), "b"), ((9, 13), "a")]
    for bad in ("other", "uid-range+uid-range", "group+x"):
        with pytest.raises(ValueError):
            partitions_of({"dgraph.partitioner": bad}, cluster, preds)
    assert list(rows_of({"uid": "0x1", "x": [1, 2]}, [Predicate("x", "int")], "edges", [])) == [(1, "x", 1), (1, "x", 2)]
    with pytest.raises(ValueError):
        TripleSource({"path": "x", "dgraph.triples.mode": "other"}).schema()


def test_graph_of_a_store(spark, store):
    g = GraphStoreGraphs(spark, store).load_graph()
    assert "pass__word" in g.vertices.columns and "dgraph_type" in g.vertices.columns and "id" in g.vertices.columns
    assert g.edges.columns == ["src", "dst", "predicate"]


def wide(spark, tmp_path, columns, key="key", **more):
    text = json.dumps({"table": {"namespace": "n", "name": "t", "tableCoder": "primitive"}, "rowkey": key, "columns": columns})
    return {"path": str(tmp_path), "catalog": text} | more


def test_wide_column_round_trip(spark, tmp_path):
    register(spark)
    o = wide(spark, tmp_path, {"k": {"cf": "rowkey", "col": "key", "type": "bigint"}, "s": {"cf": "f", "col": "s", "type": "string"}, "d": {"cf": "g", "col": "d", "type": "double"}, "b": {"cf": "g", "col": "b", "type": "boolean"}})
    rows = [(k, None if k == 3 else f"v{k}", k / 2, k > 0) for k in range(-20, 21)]
    df = spark.createDataFrame(rows, "k bigint, s string, d double, b boolean")
    df.write.format("wide-column").options(**o).mode("append").save()
    back = spark.read.format("wide-column").options(**o).load()
    assert sorted(map(tuple, back.collect())) == rows
    for condition in ("k = 5", "k in (-3, 4, 99)", "k < -4", "k <= 0", "k > 7 and k < 9", "k >= -2 and s = 'v1'", "s is null", "not k = 1"):
        assert sorted(map(tuple, back.where(condition).collect())) == sorted(map(tuple, df.where(condition).collect())), condition
    df.limit(1).withColumn("s", F.lit("new")).write.format("wide-column").options(**o).mode("append").save()
    assert back.where("k = -20").select("s").collect() == [("new",)]


def test_wide_column_versions_and_maps(spark, tmp_path):
    register(spark)
    base = {"k": {"cf": "rowkey", "col": "key", "type": "string"}, "a": {"cf": "f", "col": "a", "type": "string"}, "b": {"cf": "f", "col": "b", "type": "string"}}
    for stamp in (10, 20, 30):
        o = wide(spark, tmp_path, base, timestamp=str(stamp))
        spark.createDataFrame([("x", f"a{stamp}", f"b{stamp}")], "k string, a string, b string").write.format("wide-column").options(**o).mode("append").save()
    read_ = lambda columns, **more: spark.read.format("wide-column").options(**wide(spark, tmp_path, columns, **more)).load().collect()
    assert read_(base) == [("x", "a30", "b30")]
    assert read_(base, timestamp="20") == [("x", "a20", "b20")]
    assert read_(base, minStamp="10", maxStamp="30") == [("x", "a20", "b20")]
    maps = {"k": base["k"], "a": {"cf": "f", "col": "a", "type": "map<bigint,string>"}, "rest": {"cf": "f", "col": "", "type": "map<string,string>"}}
    assert read_(maps, maxVersions="2") == [("x", {30: "a30", 20: "a20"}, {"b": "b30"})]
    with pytest.raises(Exception, match="minStamp"):
        read_(base, minStamp="1")


def test_composite_keys():
    c = Catalog.parse(json.dumps({"table": {"name": "t"}, "rowkey": "a:b", "columns": {"x": {"cf": "rowkey", "col": "a", "type": "int"}, "y": {"cf": "rowkey", "col": "b", "type": "string"}, "v": {"cf": "f", "col": "v", "type": "int"}}}))
    row = join_key(c, {"x": -7, "y": "long tail"})
    assert split_key(c, row) == {"x": -7, "y": "long tail"}
    p = Pushed(c)
    p.add(EqualTo(("x",), -7))
    assert all(r.holds(row) for r in p.ranges) and not any(r.holds(join_key(c, {"x": 8, "y": ""})) for r in p.ranges)
    for f in (LessThan(("x",), -6), GreaterThan(("x",), -8)):
        p = Pushed(c)
        p.add(f)
        assert any(r.holds(row) for r in p.ranges)
    with pytest.raises(ValueError):
        join_key(c, {"x": None, "y": "a"})
    with pytest.raises(ValueError):
        Catalog.parse(json.dumps({"table": {"name": "t"}, "rowkey": "a:b", "columns": {"x": {"cf": "rowkey", "col": "a", "type": "string"}, "y": {"cf": "rowkey", "col": "b", "type": "int"}}}))


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "float", "double", "string"])
def test_ranges_hold_what_the_condition_holds(kind):
    c = PrimitiveCoder()
    values = [-100, -7, -1, 0, 1, 7, 100] if kind != "string" else ["", "a", "ab", "b", "é"]
    values = [v * 1.25 for v in values] if kind in ("float", "double") else values
    for op, test in (("<", lambda a, b: a < b), ("<=", lambda a, b: a <= b), (">", lambda a, b: a > b), (">=", lambda a, b: a >= b), ("=", lambda a, b: a == b)):
        for bound in values:
            ranges = compared(op, bound, kind, lambda v: c.encode(v, kind))
            for v in values:
                held = any(r.holds(c.encode(v, kind)) for r in ranges)
                assert held >= test(v, bound)
                if v != bound:
                    assert held == test(v, bound), (op, bound, v)


def test_range_algebra():
    assert union([Range(b"c", b"d"), Range(b"a", b"b"), Range(b"b", b"c")]) == (Range(b"a", b"d"),)
    assert intersection((Range(b"a", b"m"),), (Range(b"k"), point(b"b"))) == (point(b"b"), Range(b"k", b"m"))
    assert prefix(b"a\xff").stop == b"b" and prefix(b"\xff").stop is None and point(b"x").point == b"x" and Range(b"b", b"a").empty
    p = Pushed(Catalog.parse(catalog("n", "t", VERTEX_COLUMNS, "primitive")))
    p.add(StringStartsWith(("id",), "ab"))
    assert p.ranges == (prefix(b"ab"),)


@pytest.mark.parametrize(("kind", "values"), [("bigint", [-5, 0, 2**40]), ("int", [-5, 7]), ("double", [-1.5, 0.0, 2.25]), ("string", ["", "é"]), ("boolean", [False, True]), ("binary", [b"\x00\x01"])])
def test_coders(kind, values):
    for c in (PrimitiveCoder(), TypedCoder()):
        for v in values:
            assert c.decode(c.encode(v, kind), kind) == v
    t = TypedCoder()
    assert [t.encode(v, kind) for v in values] == sorted(t.encode(v, kind) for v in values)
    assert t.decode(t.encode(values[0], kind, True), kind, True) == values[0] and t.decode(t.encode(None, kind), kind) is None
    with pytest.raises(TypeError):
        PrimitiveCoder().encode(1, "struct<a:int>")


def test_graph_of_a_wide_column_store(spark, tmp_path):
    register(spark)
    for table, columns, rows, kind in (("vertices", VERTEX_COLUMNS, [("1", "A", 3), ("2", "B", None)], "id string, name string, age int"), ("edges", EDGE_COLUMNS, [("9", "knows", "1", "2")], "id string, relationship string, src string, dst string")):
        spark.createDataFrame(rows, kind).write.format("wide-column").option("path", str(tmp_path)).option("catalog", catalog("ns", table, columns)).mode("append").save()
    g = WideColumnGraphs(spark, {"hbase.namespace": "ns", "path": str(tmp_path)}).load_graph()
    assert sorted(map(tuple, g.vertices.collect())) == [("1", "A", 3), ("2", "B", None)]
    assert [tuple(r) for r in g.edges.collect()] == [("9", "knows", "1", "2")]
