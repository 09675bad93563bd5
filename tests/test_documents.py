"""Documents in and out: mapped answers, algorithm results, exports, groups; supply networks, diagrams and selections on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates, diagrams, export, filters, groups, rdf, supply, views
from graphloom.plans.graph import Graph
from graphloom.sources import mapped


def docs(spark, *rows):
    return spark.createDataFrame([(k, r if isinstance(r, (str, type(None))) else json.dumps(r)) for k, r in enumerate(rows)], "k int, body string")


def test_three_shapes_of_answers(spark):
    flat = {"nodes": [{"id": "a", "type": "T", "properties": {"x": 1, "deep": {"y": [1, 2]}, "no": None}}, {"id": "b"}, {"type": "no id"}], "edges": [{"id": "e1", "source": "a", "target": "b", "type": "to"}, {"source": "a", "target": "gone"}, {"source": "a", "target": "b"}]}
    nested = {"data": {"people": [{"key": {"v": 7}, "labels": ["P", "Q"], "first": "Ann"}, {"key": {"v": "a"}, "labels": "Late"}], "links": {"all": [{"f": "7", "t": "a"}]}}}
    mapping = mapped.Mapping(
        (mapped.Items("$.nodes"), mapped.Items("$.data.people", id="$.key.v", type="$.labels", properties={"name": "$.first"})),
        (mapped.Items("$.edges", default_type="related"), mapped.Items("$.data.links.all", source="$.f", target="$.t", default_type="linked")),
    )
    given = docs(spark, flat, nested, '{"nodes": [{"id": "z"', None, "[1, 2]", {"nodes": "none"})
    g, rejects = mapped.mapped_graph(given, "body", mapping, key="k")
    nodes = {r["id"]: (r["types"], r["props"]) for r in g.nodes.collect()}
    assert nodes == {"a": (["T"], {"x": "1", "deep": '{"y":[1,2]}'}), "b": (["Resource"], {}), "7": (["P", "Q"], {"name": "Ann"})}
    edges = g.edges.collect()
    assert sorted((r["src"], r["dst"], r["type"]) for r in edges) == [("7", "a", "linked"), ("a", "b", "related"), ("a", "b", "to")]
    assert "e1" in {r["id"] for r in edges} and len({r["id"] for r in edges}) == 3
    assert sorted((r["k"], r["reason"]) for r in rejects.collect()) == [(2, "not JSON"), (3, "no document")]


def test_algorithm_documents(spark):
    given = docs(
        spark, {"version": 1, "kind": "nodeProperties", "algorithm": "rank", "properties": {"a": {"score": 0.5, "group": "x"}, "none": {"score": 9}}}, {"version": 1, "kind": "nodeProperties", "properties": {"a": {"score": 0.75}}},
        {"version": 1, "kind": "edgeProperties", "properties": {"e": {"flow": 3}}}, {"version": 1, "kind": "overlay", "algorithm": "path", "overlay": {"id": "p", "nodeIds": ["a", "b"], "edgeIds": ["e"]}},
        {"version": 2, "kind": "overlay", "overlay": {"id": "q"}}, {"version": "1", "kind": "overlay", "overlay": {"id": "q"}}, {"kind": "overlay"}, {"version": 1, "kind": "other"}, {"version": 1, "kind": "overlay", "overlay": {"label": "no id"}},
        {"version": 1, "kind": "nodeProperties"}, "{", {"version": 1, "kind": "overlay", "overlay": {"id": "empty", "label": "Nothing"}},
    )
    found, rejects = mapped.algorithm_results(given, "body")
    assert {r["k"]: r["reason"] for r in rejects.collect()} == {4: "unsupported version", 5: "unsupported version", 6: "unsupported version", 7: "unknown kind", 8: "overlay without id", 9: "no properties object", 10: "not JSON"}
    g = Graph(spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, score double"), spark.createDataFrame([("e", "a", "b", "to")], "id string, src string, dst string, type string"))
    after, shown = mapped.applied(g, found, {"score": "double", "group": "string"}, {"flow": "long"}, order="k")
    assert sorted((r["id"], r["score"], r["group"]) for r in after.nodes.collect()) == [("a", 0.75, "x"), ("b", 0.2, None)]
    assert [(r["id"], r["flow"]) for r in after.edges.collect()] == [("e", 3)]
    assert sorted(tuple(r) for r in shown.collect()) == [("p", "p", "path", "edge", "e"), ("p", "p", "path", "node", "a"), ("p", "p", "path", "node", "b")]


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([("a", ["T"], "A, \"quoted\"", 1), ("b", ["U"], None, None), ("c", ["T"], "C", 3)], "id string, types array<string>, name string, size int")
    return Graph(nodes, spark.createDataFrame([("1", "a", "b", "to"), ("2", "b", "c", "to")], "id string, src string, dst string, type string"))


def test_one_json_document(spark, small):
    for g in (small, Graph(small.nodes.limit(0), small.edges.limit(0)), Graph(small.nodes.filter("id = 'b'"), small.edges.limit(0))):
        scope, tables = export.export(g, "json")
        text = "\n".join(r["line"] for r in tables["document"].orderBy("section", "key").collect())
        got = json.loads(text)
        assert scope == "graph" and got["version"] == 1 and len(got["nodes"]) == g.nodes.count() and len(got["edges"]) == g.edges.count()
    ids = spark.createDataFrame([("a",), ("b",), ("none",)], "id string")
    scope, tables = export.export(small, "csv", ids)
    assert scope == "selection" and tables["nodes"].count() == 2 and [r["id"] for r in tables["edges"].collect()] == ["1"]
    assert export.export(small, "turtle", ids.limit(0))[0] == "graph"
    with pytest.raises(ValueError, match="unknown format"):
        export.export(small, "xml")


def test_groups_there_and_back(spark):
    details = spark.createDataFrame([("combo_1", "One"), ("combo_12", "Twelve"), ("own", "Empty")], "id string, name string")
    own = spark.createDataFrame([("combo_1", "a"), ("combo_1", "b"), ("combo_12", "a")], "group string, id string")
    written = groups.serialized(own, details)
    back, named, following = groups.deserialized(written, "json")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.collect())) and sorted(map(tuple, named.collect())) == sorted(map(tuple, details.collect())) and following == 13
    assert groups.deserialized(written.limit(0), "json")[2] == 1


def test_supply_networks_and_gaps(spark):
    s, p = spark.createDataFrame([("s1", "S1"), ("s2", "S2")], "id string, name string"), spark.createDataFrame([("p1", "P1", "DE"), ("p2", "P2", None), ("p3", "P3", None)], "id string, name string, country string")
    links = spark.createDataFrame([("s1", "p1", "supplies"), ("s1", "p1", "supplies"), ("s1", "p2", "supplies"), ("s2", "p2", "supplies"), ("s1", "gone", "supplies")], "src string, dst string, type string")
    g = supply.network({"supplier": s, "part": p}, links)
    assert sorted((r["id"], r["types"][0], r["country"]) for r in g.nodes.collect()) == [("p1", "part", "DE"), ("p2", "part", None), ("p3", "part", None), ("s1", "supplier", None), ("s2", "supplier", None)]
    assert g.edges.count() == 3
    held = spark.createDataFrame([("p1", "iso"), ("p1", "iso"), ("p1", "abc"), ("p2", "abc")], "id string, certificate string")
    assert sorted((r["id"], r["supplier_count"], r["status"]) for r in supply.thread(p, g.edges, held, "iso").collect()) == [("p1", 1, "covered"), ("p2", 2, "missing"), ("p3", 0, "n/a")]
    found = spark.createDataFrame([("p3", "name", "info"), ("p3", "name", "info")], "id string, path string, severity string")
    got = supply.gaps(g.edges, F.col("id") == "p1", found)
    assert sorted(map(tuple, got.collect())) == [("p1", "sole-source", "violation"), ("p3", "shape:name", "info"), ("s1", "single-point", "warning")]


def test_requirements_below_and_blocks_that_satisfy_them(spark):
    none = "string"
    blocks = spark.createDataFrame([("b1", "Brake", "block", None, None, None, None)], f"id string, name string, kind string, stereotype {none}, parts array<struct<id:string,name:string,type:string,ports:array<string>>>, parameters array<string>, constraint string")
    wanted = spark.createDataFrame([("r", "Stop", "t", None), ("r1", "Soon", "t", "r"), ("r2", "Safely", "t", "r1"), ("x", "Other", "t", None)], "id string, name string, text string, parent string")
    links = spark.createDataFrame([("s1", "b1", "r2", "dep", "satisfy", None, None, None), ("s2", "b1", "x", "dep", "satisfy", None, None, None)], "id string, source string, target string, kind string, stereotype string, label string, source_port string, target_port string")
    shown = spark.createDataFrame([("d1", "req", None, ["r", "s1", "s2"]), ("d2", "req", None, ["r1"]), ("d3", "bdd", None, ["b1", "nothing"])], "id string, type string, context string, members array<string>")
    model = diagrams.Model(blocks, links, wanted, shown)
    g = diagrams.requirements(model)
    assert sorted((r["diagram"], r["id"]) for r in g.nodes.collect()) == [("d1", "b1"), ("d1", "r"), ("d1", "r1"), ("d1", "r2"), ("d2", "r1"), ("d2", "r2")]
    assert sorted((r["diagram"], r["source"], r["target"], r["kind"]) for r in g.edges.collect()) == [("d1", "b1", "r2", "dependency"), ("d1", "r", "r1", "composition"), ("d1", "r1", "r2", "composition"), ("d2", "r1", "r2", "composition")]
    g = diagrams.definitions(model)
    assert [(r["diagram"], r["id"], r["header"]) for r in g.nodes.collect()] == [("d3", "b1", "Brake")] and g.edges.count() == 0


def test_instances_keep_all_values(spark):
    rows = [("urn:x#a", rdf.TYPE, "urn:x#T", "uri"), ("urn:x#a", rdf.TYPE, "urn:x#U", "uri"), ("urn:x#a", "urn:x#tag", "one", "literal"), ("urn:x#a", "urn:x#tag", "two", "literal"), ("urn:x#a", f"{rdf.RDFS}label", "Anna", "literal"), ("urn:x#b", rdf.TYPE, "urn:x#T", "uri"), ("urn:x#a", "urn:x#knows", "urn:x#b", "uri"), ("urn:x#a", "urn:x#knows", "urn:x#c", "uri"), ("urn:x#c", rdf.TYPE, "urn:x#V", "uri")]
    t = spark.createDataFrame([(*r, None, None, k) for k, r in enumerate(rows)], "s string, p string, o string, otype string, datatype string, lang string, ord long")
    g = rdf.instances(t, ["urn:x#T", "urn:x#U"])
    assert sorted((r["id"], r["types"], r["name"], r["props"]) for r in g.nodes.collect()) == [("urn:x#a", ["T", "U"], "Anna", {"tag": ["one", "two"]}), ("urn:x#b", ["T"], "b", {})]
    assert [(r["src"], r["dst"], r["type"]) for r in g.edges.collect()] == [("urn:x#a", "urn:x#b", "knows")]
    assert rdf.instances(t).edges.count() == 2


def test_coercion_and_selection(spark):
    rows = [("a", "1", True), ("b", " 0x10 ", False), ("c", "x", True), ("d", None, True), ("e", "3", None)]
    df = spark.createDataFrame(rows, "id string, n string, flag boolean")
    p = aggregates.points(df, "n", "flag")
    assert sorted((r["id"], r["x"], r["y"]) for r in p.collect()) == [("a", 1.0, 1.0), ("b", 16.0, 0.0)]
    assert [r["id"] for r in aggregates.in_box(p, (0, 2), (1, 1)).collect()] == ["a"]
    numbers = spark.createDataFrame([(str(k), float(k)) for k in range(101)], "id string, v double")
    assert sorted(int(r["id"]) for r in aggregates.in_buckets(numbers, F.col("v"), 9, 9, 10).collect()) == list(range(90, 101))
    assert {r["id"] for r in filters.locked(df, spark.createDataFrame([("a",), ("z",)], "id string")).collect()} == {"a"} and filters.locked(df, df.limit(0), all_pinned=True).count() == 5


@pytest.mark.parametrize(("text", "want"), [
    ("x.PNG?v=1.2", True), ("/a/b c.png", False), ("data:image/png;base64,", True), ("DATA:IMAGE/x", True), ("data:text/plain,x.png", True), ("https://h", True), ("ftp://h/x", False), ("x.jpeg", True), (".png", False), ("/.png", False),
    ("png", False), ("x.png.txt", False), ("x.txt?y=.png", False), ("", False), (None, False), ("http:/x", False), ("a\n.svg", False), ("user", False),
])
def test_image_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(views.is_image(F.col("t"))).first()[0] is want
