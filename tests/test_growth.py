"""Work that must not grow faster than the input, or be less than the whole job."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import filters, overlays, provenance, rdf, search, traversal
from graphloom.plans import catalog, catalog_scale, catalog_views
from graphloom.plans.graph import Graph
from graphloom.plans.session import stored
from graphloom.streaming import summaries


def test_scale_graph_is_the_standard_one_and_more(spark, sf_dir):
    got = {r["group"]: r["members"] for r in catalog_views.scale_graph(spark, sf_dir).collect()}
    assert all(got[f"g{k}"] == 200 for k in range(40))
    assert len(got) == 40 + spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def test_inference_keeps_only_triples_that_rules_touch(spark):
    rows = [(f"x{k}", "contains", f"y{k}") for k in range(50)] + [("x1", rdf.TYPE, "Order"), ("x2", rdf.TYPE, "Customer"), ("Customer", f"{rdf.RDFS}subClassOf", "Party"), ("x2", "in", "x3"), ("in", f"{rdf.RDFS}range", "Place")]
    t = spark.createDataFrame([(*r, "uri") for r in rows], "s string, p string, o string, otype string").select("s", "p", "o", F.lit(True).alias("iri"))
    rules = rdf._Axioms(t)
    kept = {(r["s"], r["p"], r["o"]) for r in rules.touched(t).collect()}
    assert kept == {r for r in rows if r[1] != "contains" and r[2] != "Order"}
    rules.release()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_without_an_index_makes_none(spark):
    nodes = spark.createDataFrame([("a", ["T"], 1, "harbour"), ("b", ["T"], 2, "hill")], "id string, types array<string>, ord long, name string")
    found = search.search(nodes, "harbuor")
    assert "Join" not in _plan(found) and [r["id"] for r in found.collect()] == ["a"]


def test_first_incoming_edges_are_found_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(traversal, "stored", lambda df: kept.append(df.columns) or stored(df))
    e = spark.createDataFrame([(f"e{k}", f"n{k}", f"n{k + 1}") for k in range(4)], "id string, src string, dst string")
    got = traversal.breadcrumbs(e, spark.createDataFrame([("n4",)], "id string"))
    assert kept.count(["at", "up"]) == 1
    assert [r["ancestor"] for r in got.orderBy("depth").collect()] == ["n4", "n3", "n2", "n1", "n0"]


def test_types_are_kept_up_without_the_edges(spark, sf_dir):
    assert "lineitem" not in _plan(catalog_scale.incremental_types(spark, sf_dir))
    assert "l_orderkey" not in _plan(catalog_scale.incremental_types(spark, sf_dir))


def test_folds_that_find_nothing_write_nothing(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(rdf, "stored", lambda df: kept.append(df) or stored(df))
    t = spark.createDataFrame([("a", "in", "b", "uri", None, None, 1), ("a", rdf.TYPE, "C", "uri", None, None, 2)], "s string, p string, o string, otype string, datatype string, lang string, ord long")
    g = rdf.project(t, rdf.PRESETS["standard"])
    assert [(r["src"], r["dst"]) for r in g.edges.collect()] == [("a", "b")] and g.nodes.count() == 2
    assert len(kept) == 1


@pytest.mark.parametrize("few", [0, 10])
def test_induced_edges_are_not_sorted(spark, monkeypatch, few):
    monkeypatch.setattr(filters, "_FEW", few)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "b", "a"), ("e4", None, "a")], "id string, src string, dst string")
    got = filters.induced(Graph(nodes, edges), spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "id string"))
    plan = got.edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and ("ShuffledHashJoin" in plan) == (few == 0)
    assert sorted(r["id"] for r in got.edges.collect()) == ["e1", "e3"] and sorted(r["id"] for r in got.nodes.collect()) == ["a", "b"]


def test_lines_and_cells_of_lists_are_grouped_once(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(rdf, "stored", lambda df: plans.append(_plan(df)) or stored(df))
    got = catalog.list_collapse(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert not any("l_linenumber" in p for p in plans)
    assert plans[0].count("Aggregate") == 1 and "Join" not in plans[0]


def test_statements_are_grouped_once_from_narrow_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(rdf, "stored", lambda df: kept.append(df.columns) or stored(df))
    r, n = rdf.RDF, None
    rows = [
        ("st", rdf.TYPE, f"{r}Statement", "uri"), ("st", rdf.TYPE, "Claim", "uri"), ("st", f"{r}subject", "a", "uri"), ("st", f"{r}predicate", "http://x/knows", "uri"), ("st", f"{r}object", "b", "uri"),
        ("st", "http://x/since", "1999", "literal"), ("st", "http://x/by", "c", "uri"), ("st", n, "lost", "literal"),
        # no statements, so all of it stays
        ("a", "http://x/knows", "b", "uri"), ("a", rdf.TYPE, "Person", "uri"), ("q", f"{r}object", "b", "uri"), ("q", "http://x/size", "2", "literal"), ("v", n, "kept", "literal"), (n, rdf.TYPE, "Person", "uri"),
    ]
    t = spark.createDataFrame([(*x, n, n, k) for k, x in enumerate(rows)], "s string, p string, o string, otype string, datatype string, lang string, ord long")
    got = rdf.fold_statements(t)
    made = [("a", "edge-meta:knows:since", "1999", "literal", 5), ("a", "edge-meta:knows:by", "c", "literal", 6)]
    want = made + [(*x, k) for k, x in enumerate(rows) if k > 7]
    assert got.columns == t.columns
    assert sorted(((x["s"], x["p"], x["o"], x["otype"], x["ord"]) for x in got.collect()), key=str) == sorted(want, key=str)
    assert kept == [["s", "mark", "subj", "pred"]]
    monkeypatch.setattr(rdf, "_NAMES", 0)
    assert sorted(((x["s"], x["p"], x["o"], x["otype"], x["ord"]) for x in rdf.fold_statements(t).collect()), key=str) == sorted(want, key=str)


def test_pairs_of_neighbours_are_made_distinct_once(spark):
    nodes = spark.createDataFrame([("a", ["T"]), ("b", ["U"]), ("c", None)], "id string, types array<string>")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "a"), ("c", "c"), ("b", None)], "src string, dst string")
    got = overlays.node_summaries(nodes, edges)
    assert {tuple(r) for r in got.collect()} == {("a", 2, "1 U, 1 Unknown"), ("b", 1, "1 T"), ("c", 1, "1 T")}
    plan = _plan(got)
    # explode comes above the distinct pairs, not below
    assert plan.index("Generate explode") < plan.index("least(")


def test_only_roots_whose_ways_meet_are_walked_again(spark, monkeypatch):
    again, plain = [], provenance._first_ways
    monkeypatch.setattr(provenance, "_first_ways", lambda every: again.extend(r["root"] for r in every.select("root").distinct().collect()) or plain(every))
    nodes = spark.createDataFrame([(v, ["Entity"], v != "d") for v in "abcde"], "id string, types array<string>, attributed boolean")
    edges = [("e1", "a", "b", "used"), ("e2", "b", "c", "used"), ("e3", "e", "d", "used")]

    def rows(more):
        g = Graph(nodes, spark.createDataFrame(edges + more, "id string, src string, dst string, type string"))
        roots = spark.createDataFrame([("a",), ("a",), ("e",)], "id string")
        return {(r["root"], r["id"], r["depth"], r["place"]) for r in provenance.chains(g, roots).collect()}

    tree = {("a", "a", 0, 0), ("a", "b", 1, 1), ("a", "c", 2, 2), ("e", "e", 0, 0), ("e", "d", 1, 1), ("e", "d::absence", 2, 2)}
    assert rows([]) == tree and not again
    assert rows([("e4", "a", "c", "used")]) == tree and again == ["a"]


def test_edits_meet_no_edges_but_their_own(spark, sf_dir, monkeypatch):
    nodes = spark.createDataFrame([("a", ["T"]), ("b", ["U"]), ("c", None), ("d", ["U"])], "id string, types array<string>")
    edges = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "c"), ("e4", "b", "gone"), ("e5", "d", "c"), ("e6", "a", "d"), ("e7", "b", "b"), ("e8", "c", "a")]
    g = Graph(nodes, spark.createDataFrame(edges, "id string, src string, dst string").withColumn("type", F.lit("x")))
    # degrees ask for no types
    assert "Join" not in _plan(summaries.degrees(summaries.counted(summaries.contents(g))))
    edits = spark.createDataFrame([("a", None), ("b", "V"), ("d", "U"), ("gone", "V")], "id string, type string")
    after = Graph(spark.createDataFrame([("b", ["V"]), ("c", None), ("d", ["U"])], nodes.schema), g.edges.filter("src != 'a' and dst != 'a'"))
    for few in (10, 0):
        monkeypatch.setattr(summaries, "_FEW", few)
        got = summaries.edited(g, edits)
        assert sorted(map(str, got.collect())) == sorted(map(str, summaries.changes_between(g, after).collect()))
    assert {r["id"] for r in got.collect()} == {"a", "b", "e1", "e2", "e4", "e6", "e7", "e8"}


def test_rows_of_a_root_are_gathered_once(spark, monkeypatch):
    nodes = spark.createDataFrame([(v, ["Entity"], v not in "cd") for v in "abcdef"], "id string, types array<string>, attributed boolean")
    # edges' ids go by text, and c is a leaf that nothing is recorded of, as root and further on
    edges = [("e10", "a", "b", "used"), ("e9", "a", "c", "used"), ("e2", "b", "d", "used"), ("e1", "d", "a", "used"), ("e3", "d", "e", "used"), ("e4", "e", "f", "used")]
    g = Graph(nodes, spark.createDataFrame(edges, "id string, src string, dst string, type string"))
    got = provenance.chains(g, nodes)
    assert _plan(got).count("Join") == 0 and got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    walks = {}
    for r in sorted(got.collect(), key=lambda r: (r["root"], r["place"])):
        walks.setdefault(r["root"], []).append((r["id"], r["depth"], r["parent"]))
    assert walks["a"] == [("a", 0, None), ("b", 1, "a"), ("d", 2, "b"), ("e", 3, "d"), ("c", 1, "a"), ("c::absence", 2, "c")]
    assert walks["c"] == [("c", 0, None), ("c::absence", 1, "c")] and walks["f"] == [("f", 0, None)]
    assert walks["d"] == [("d", 0, None), ("a", 1, "d"), ("b", 2, "a"), ("c", 2, "a"), ("c::absence", 3, "c"), ("e", 1, "d"), ("f", 2, "e")]
