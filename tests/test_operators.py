"""Operators on small fixtures: depths beyond any cap, cycles, readers over files, streams that run, scalar functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import aggregates, edges, encodings, filters, groups, ontology, overlays, provenance, rdf, traversal, updates
from graphloom.plans.graph import Graph
from graphloom.plans.session import number_rows
from graphloom.sources import readers
from graphloom.streaming import changes

_T = "s string, p string, o string, otype string, datatype string, lang string, ord long"


def triples(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), k) for k, r in enumerate(rows)], _T)


def edge_rows(spark, pairs, kind="next"):
    return spark.createDataFrame([(f"e{k}", a, b, kind) for k, (a, b) in enumerate(pairs)], "id string, src string, dst string, type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def a_list(name, items, last=rdf.NIL):
    out = []
    for k, v in enumerate(items):
        out += [(f"{name}{k}", rdf.FIRST, v, "literal"), (f"{name}{k}", rdf.REST, f"{name}{k + 1}" if k + 1 < len(items) else last, "uri")]
    return out


def test_lists_of_any_length_and_cycles(spark):
    long = [f"v{k}" for k in range(250)]
    rows = [("x", "items", "l0", "uri"), *a_list("l", long), ("y", "one", "m0", "uri"), *a_list("m", ["only"]), ("z", "round", "c0", "uri"), *a_list("c", ["a", "b", "d"], last="c1"), ("z", "plain", "w", "uri")]
    got = {(r["s"], r["p"]): r["o"] for r in rdf.fold_lists(triples(spark, rows)).collect()}
    assert json.loads(got["x", "items"]) == long and json.loads(got["y", "one"]) == ["only"]
    assert got["z", "round"] == "c0" and got["c0", rdf.FIRST] == "a" and got["c2", rdf.REST] == "c1" and got["z", "plain"] == "w"
    assert not any(s.startswith(("l", "m")) for s, _ in got)


def test_paths_trees_and_breadcrumbs_are_not_cut(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(22)]
    e = edge_rows(spark, [*chain, ("loop", "loop"), ("p", "q"), ("q", "p")])
    path = traversal.shortest_path(e, "n00", "n22").orderBy("step").collect()
    assert [r["id"] for r in path] == [f"n{k:02}" for k in range(23)]
    assert traversal.shortest_path(e, "n00", "n22", max_hops=2).count() == 0
    assert traversal.shortest_path(e, "n00", "p").count() == 0
    assert [r["id"] for r in traversal.shortest_path(e, "nowhere", "nowhere").collect()] == ["nowhere"]
    assert traversal.tree_depths(e, ids(spark, "n00")).agg(F.max("depth")).first()[0] == 22
    crumbs = traversal.breadcrumbs(e, ids(spark, "n22", "p", "loop"))
    n = {r["id"]: r["n"] for r in crumbs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"n22": 23, "p": 2, "loop": 1}


def test_components_of_a_chain_a_hub_and_a_cycle(spark):
    pairs = [(f"n{k:02}", f"n{k + 1:02}") for k in range(40)] + [("hub", f"leaf{k}") for k in range(300)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("s", "s")]
    nodes = ids(spark, *sorted({v for p in pairs for v in p}), "alone")
    got = {r["id"]: r["component"] for r in traversal.components(nodes, edge_rows(spark, pairs)).collect()}
    assert {got[f"n{k:02}"] for k in range(41)} == {"n00"} and {got[f"leaf{k}"] for k in range(300)} == {"hub"}
    assert [got[k] for k in ("x3", "s", "alone")] == ["x1", "s", "alone"]
    numbers = {r["id"]: r["component"] for r in traversal.numbered_components(nodes, edge_rows(spark, pairs)).collect()}
    assert (numbers["hub"], numbers["n07"], numbers["x2"], numbers["alone"]) == (0, 1, 2, 3)


def test_long_property_chains_are_inferred_whole(spark):
    rows = [(f"p{k}", f"{rdf.RDFS}subPropertyOf", f"p{k + 1}", "uri") for k in range(3)] + [("a", "p0", "b", "uri")]
    got = {(r["s"], r["p"], r["o"]) for r in rdf.infer(triples(spark, rows)).collect()}
    assert ("a", "p3", "b") in got
    with pytest.raises(RuntimeError):
        rdf.infer(triples(spark, rows), passes=1)


def test_degrees_count_loops_and_parallels(spark):
    nodes, e = ids(spark, "a", "b", "c"), edge_rows(spark, [("a", "a"), ("a", "b"), ("b", "a"), ("a", "b")])
    assert {r["id"]: r["degree"] for r in aggregates.degree_centrality(nodes, e).collect()} == {"a": 5, "b": 3, "c": 0}
    assert {r["degree"]: r["n"] for r in aggregates.degree_distribution(nodes, e).collect()} == {2: 1, 1: 1, 0: 1}


def test_numbers_are_dense(spark):
    rows = [(random.Random(k).random(), k) for k in range(500)]
    got = number_rows(spark.createDataFrame(rows, "x double, k int").repartition(7), "x").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 501)) and [r["k"] for r in got] == [k for _, k in sorted(rows)]


def test_update_join_and_diff_with_repeated_keys(spark):
    target = spark.createDataFrame([("1", 5.0), ("2", 6.0)], "id string, x double")
    rows = spark.createDataFrame([(1, 1.0, 2), (1, 2.0, 1), (2, None, 1)], "key int, x double, at int")
    assert sorted(map(tuple, updates.update_join(target, rows, "key", order="at").collect())) == [("1", 1.0), ("2", 6.0)]
    assert sorted(map(tuple, updates.update_join(target, rows.drop("at"), "key").collect())) == [("1", 2.0), ("2", 6.0)]
    before = spark.createDataFrame([("1", 1.0), ("1", 1.0), ("2", 2.0)], "id string, x double")
    assert sorted((r["id"], r["status"]) for r in updates.diff(before, target, ["x"]).collect()) == [("1", "changed"), ("2", "changed")]
    assert updates.change_ratio(updates.diff(before, target, ["x"]), 2) == "none"
    assert updates.change_ratio(updates.diff(before, before.filter("id = '1'"), ["x"]), 5) == "incremental"
    assert updates.working_set(before, 2) == (False, 3) and updates.working_set(before, 3) == (True, 3)


def test_readers(spark, tmp_path):
    nt = tmp_path / "g.nt"
    nt.write_text('# comment\n<urn:a> <urn:p> "x \\"y\\" \\n"@en .\n<urn:a> <urn:q> <urn:b> .\n_:n <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:graph> .\n<urn:a> <urn:r> _:n .\n')
    got = {(r["s"], r["p"]): (r["o"], r["otype"], r["datatype"], r["lang"]) for r in readers.ntriples(spark, str(nt)).collect()}
    assert got == {
        ("urn:a", "urn:p"): ('x "y" \n', "literal", None, "en"), ("urn:a", "urn:q"): ("urn:b", "uri", None, None),
        ("_:n", "urn:p"): ("5", "literal", "http://www.w3.org/2001/XMLSchema#integer", None), ("urn:a", "urn:r"): ("_:n", "bnode", None, None),
    }
    (tmp_path / "r.csv").write_text("id,size\n a , 12 \nb,abc\n")
    assert sorted(map(tuple, readers.csv_rows(spark, str(tmp_path / "r.csv"), ["size"]).collect()), key=str) == [("a", 12.0), ("b", None)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"id": "1", "src": "a", "dst": "b"}, {"id": "2", "src": "a", "dst": "gone"}]}))
    g = readers.json_graph(spark, str(tmp_path / "g.json"))
    assert g.nodes.count() == 2 and [r["id"] for r in g.edges.collect()] == ["1"]


def test_answers_of_graph_services(spark):
    def term(kind, value):
        return {"type": kind, "value": value}

    answer = {"results": {"bindings": [{"s": term("uri", "urn:a"), "p": term("uri", "urn:x#name"), "o": term("literal", "A")}, {"s": term("uri", "urn:a"), "p": term("uri", "urn:x#name"), "o": term("literal", "B")}, {"s": term("uri", "urn:a"), "p": term("uri", "urn:x#knows"), "o": term("uri", "urn:b")}]}}
    g = readers.bindings(spark.createDataFrame([(json.dumps(answer),)], "a string"), "a")
    assert {r["id"]: r["props"] for r in g.nodes.collect()} == {"urn:a": {"name": "B"}, "urn:b": None}
    assert [(r["src"], r["dst"], r["type"]) for r in g.edges.collect()] == [("urn:a", "urn:b", "knows")]
    graph = {"nodes": [{"id": "1", "labels": ["P"], "properties": {"name": "x"}}, {"id": "2", "labels": ["Q"], "properties": {}}], "relationships": [{"id": "9", "type": "R", "startNode": "1", "endNode": "2", "properties": {"confidence": "0.5"}}, {"id": "8", "type": "R", "startNode": "1", "endNode": "7", "properties": {}}]}
    again = {"nodes": [{"id": "1", "labels": ["Z"], "properties": {}}], "relationships": []}
    g = readers.transaction(spark.createDataFrame([(json.dumps({"results": [{"data": [{"graph": graph}, {"graph": again}]}]}),)], "a string"), "a")
    assert sorted((r["id"], r["types"][0]) for r in g.nodes.collect()) == [("1", "P"), ("2", "Q")] and [(r["id"], r["confidence"]) for r in g.edges.collect()] == [("9", 0.5)]
    h = spark.createDataFrame([("h1", ["A"], [("p1", "h2", "to"), ("p2", "gone", "to")]), ("h2", ["B"], [])], "id string, types array<string>, portals array<struct<id:string,target:string,label:string>>")
    g = readers.holons(h)
    assert sorted((r["id"], r["portal_count"]) for r in g.nodes.collect()) == [("h1", 2), ("h2", 0)] and [r["dst"] for r in g.edges.collect()] == ["h2"]


def test_change_stream(spark, tmp_path):
    schema = "id string, seq long, x int, op string"
    rows = [("a", 1, 1, "upsert"), ("b", 2, 1, "upsert")], [("a", 5, 9, "upsert"), ("a", 3, 7, "upsert"), ("b", 4, None, "remove"), ("c", 6, 2, "upsert")]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes.apply_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    last = spark.read.schema("id string, seq long, x int").parquet(str(tmp_path / "out" / "v=1")).collect()
    assert sorted((r["id"], r["seq"], r["x"]) for r in last) == [("a", 5, 9), ("c", 6, 2)]


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_of_a_stream_drop_what_is_too_late(spark, tmp_path, slide):
    schema = "ts timestamp, k string, v double"
    src, name = tmp_path / "in", f"w{'s' if slide else 't'}"
    out = changes.windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), F.col("ts"), ["k"], "v", "1 hour", slide, late="10 minutes") if src.mkdir() is None else None
    for part in ([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], [("2024-01-01 05:00:00", "a", 4.0)], [("2024-01-01 00:10:00", "a", 8.0), ("2024-01-01 09:00:00", "b", 1.0)], [("2024-01-01 15:00:00", "b", 1.0)]):
        df = spark.createDataFrame(part, "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v").coalesce(1)
        df.write.mode("append").parquet(str(src))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(str(r["start"]), r["k"]): r["total"] for r in spark.read.parquet(str(tmp_path / name)).collect()}
    assert got["2024-01-01 00:00:00", "a"] == 3.0 and got["2024-01-01 05:00:00", "a"] == 4.0
    assert ("2024-01-01 00:30:00", "a") in got if slide else len(got) == 3


def test_scalars(spark):
    row = spark.range(1).select(
        values.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("bw"), values.contrast(F.lit("#000"), F.lit("#ffffff")).alias("bad"), values.to_time(F.lit("2024-02-30")).alias("no"),
        values.to_time(F.lit("2024-02-29T10:00:00Z")).isNotNull().alias("yes"), values.literal_number(F.lit("5"), F.lit(None).cast("string")).alias("n"), values.literal_number(F.lit("5"), F.lit("urn:text")).alias("t"),
    ).first()
    assert row["bw"] == pytest.approx(21.0) and row["bad"] is None and row["no"] is None and row["yes"] and row["n"] == 5.0 and row["t"] is None


def test_derived_expressions(spark):
    df = spark.createDataFrame([(0.5, 90.0), (0.3, 90.0)], "risk double, score double")
    got = encodings.derived(df, {"both": "risk*100+score", "four": "sqrt(16)", "none": "score/(risk-risk)", "bad": "__import__('os')", "later": "both-four^2"}).collect()
    assert [(r["both"], r["four"], r["none"], r["later"]) for r in got] == [(140.0, 4.0, None, 124.0), (120.0, 4.0, None, 104.0)] and "bad" not in got[0]


def test_sizes_with_empty_and_equal_domains(spark):
    for rows, want in (([("a", None)], 18.0), ([("a", 3.0), ("b", 3.0)], 18.0), ([("a", 1.0), ("b", 3.0)], 4.0)):
        got = encodings.size_column(spark.createDataFrame(rows, "id string, x double"), encodings.Size("x")).orderBy("id").first()
        assert got["size"] == want


def test_graph_edits_and_lookups(spark):
    nodes = spark.createDataFrame([("a", ["T"], 0, "A"), ("b", ["T"], 1, "B")], "id string, types array<string>, ord long, name string")
    g = Graph(nodes, edge_rows(spark, [("a", "b"), ("a", "b"), ("b", "b")]))
    more = edges.add_nodes(g, spark.createDataFrame([("a", ["X"], 9, "other"), ("c", ["T"], 2, "C")], nodes.schema))
    assert sorted((r["id"], r["name"]) for r in more.nodes.collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    added = edges.add_edges(more, spark.createDataFrame([("a", "b", "next"), ("a", "b", "next"), ("a", "none", "next")], "src string, dst string, type string"))
    assert added.edges.count() == 5 and added.edges.select("id").distinct().count() == 5
    assert edges.between(g.edges, "a", "b").count() == 2 and edges.incident(g.edges, ids(spark, "b")).count() == 3
    registry = aggregates.registry(g.nodes, g.edges)
    assert edges.schema_hash(registry) == edges.schema_hash(registry.orderBy(F.desc("name"))) != edges.schema_hash(registry.filter("name != 'name'"))
    part, cut_off = groups.subgraph(g, ids(spark, "a", "b"), most=1)
    assert cut_off and [r["id"] for r in part.nodes.collect()] == ["a"]
    same, collapsed = groups.collapse_above(g, "name", threshold=2)
    assert not collapsed and same is g
    many, collapsed = groups.collapse_above(g, "name", threshold=1)
    assert collapsed and sorted(r["cluster"] for r in many.nodes.collect()) == ["A", "B"]
    left = groups.dissolved(spark.createDataFrame([("g", "a"), ("h", "g"), ("h", "b")], "group string, id string"), "g")
    assert [tuple(r) for r in left.collect()] == [("h", "b")]


def test_ontology_search_and_annotations(spark):
    rows = [("urn:o#Dog", rdf.TYPE, f"{rdf.OWL}Class", "uri"), ("urn:o#Dog", f"{rdf.RDFS}label", "Hound", "literal"), ("urn:o", rdf.TYPE, f"{rdf.OWL}Ontology", "uri"), ("urn:o#rex", rdf.TYPE, "urn:o#Dog", "uri"), ("urn:o#note", rdf.TYPE, f"{rdf.OWL}AnnotationProperty", "uri"), ("urn:o#rex", "urn:o#note", "good", "literal")]
    t = triples(spark, rows)
    assert [tuple(r) for r in ontology.search(t, "hOUN").collect()] == [("urn:o#Dog", "Hound")] and ontology.search(t, "urn:o").count() == 3
    assert {tuple(r) for r in ontology.annotations(t).collect()} == {("urn:o#Dog", "label", "Hound"), ("urn:o#rex", "note", "good")}
    assert [tuple(r) for r in ontology.instance_counts(t).collect()] == [("urn:o#Dog", 1)]
    assert {(r["id"], r["kind"]) for r in rdf.kinds(t).collect()} >= {("urn:o#Dog", "Class"), ("urn:o#rex", "Individual"), ("urn:o", "Ontology")}


def test_overlays_of_findings(spark):
    f = spark.createDataFrame([("a", "s", "p", "warning"), ("a", "s", "p", "violation"), ("b", "s", "q", "info")], "id string, shape string, path string, severity string")
    assert {tuple(r) for r in overlays.by_worst(f).select("overlay", "id").collect()} == {("gap-violation", "a"), ("gap-info", "b")}
    assert overlays.by_severity(f).count() == 3 and {tuple(r) for r in overlays.row_severities(f).collect()} == {("s::prop::p", "violation"), ("s::prop::q", "info")}


def test_copied_properties(spark):
    def one(*pairs):
        return spark.range(1).select(provenance.copied_properties(F.create_map(*map(F.lit, pairs))).alias("p")).first()["p"].get("temporal_start")

    assert one("prov:startedAtTime", "1", "startedAtTime", "2") == "2" and one("startedAtTime", "2", "prov:startedAtTime", "1") == "1"
    assert one("temporal_start", "0", "startedAtTime", "2") == "0" and one("x", "1") is None


def test_hidden_types(spark):
    nodes = spark.createDataFrame([("a", ["T"]), ("b", ["U"])], "id string, types array<string>")
    assert [r["id"] for r in filters.without_types(nodes, ["T"]).collect()] == ["b"]


def test_full_addresses_are_copied(spark):
    p = "http://www.w3.org/ns/prov#"
    props = F.create_map(*map(F.lit, (f"{p}startedAtTime", "1", "prov:startedAtTime", "2", f"{p}used", "u", f"{p}wasDerivedFrom", "d", "derivedFrom", "own", f"{p}other", "x")))
    got = spark.range(1).select(provenance.copied_properties(props).alias("p")).first()["p"]
    assert (got["temporal_start"], got["used"], got["derivedFrom"], len(got)) == ("2", "u", "own", 8) and len(provenance.COPIED) == 13
