"""Communities against a plain computation, and views, sources and values on small rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import communities, groups, views
from graphloom.plans.graph import Graph
from graphloom.sources import readers


def _plain_modularity(edges, of):
    two_m, inside, weight = 2 * len(edges), 0, {}
    for a, b in edges:
        inside += 2 * (of[a] == of[b])
        for x in (a, b):
            weight[of[x]] = weight.get(of[x], 0) + 1
    return inside / two_m - sum(k * k for k in weight.values()) / two_m**2


def _plain_louvain(edges):
    """Single moves and merged levels over dictionaries, nodes in order."""
    of, graph = {}, {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            graph.setdefault(x, {}).setdefault(y, 0)
            graph[x][y] += 1
    of, two_m = {v: v for v in graph}, 2 * len(edges)
    while True:
        k = {v: sum(n.values()) for v, n in graph.items()}
        c, sums, go = {v: v for v in graph}, dict(k), True
        while go:
            go = False
            for v, n in graph.items():
                toward = {c[v]: 0}
                for u, w in n.items():
                    if u != v:
                        toward[c[u]] = toward.get(c[u], 0) + w
                sums[c[v]] -= k[v]
                best = max(toward, key=lambda x, v=v, t=toward: (t[x] - k[v] * sums[x] / two_m, x == c[v]))
                if best != c[v] and toward[best] - k[v] * sums[best] / two_m > toward[c[v]] - k[v] * sums[c[v]] / two_m + 1e-9:
                    c[v], go = best, True
                sums[c[v]] += k[v]
        if len(set(c.values())) == len(graph):
            return of
        of, merged = {v: c[x] for v, x in of.items()}, {}
        for v, n in graph.items():
            for u, w in n.items():
                merged.setdefault(c[v], {}).setdefault(c[u], 0)
                merged[c[v]][c[u]] += w
        graph = merged


@pytest.mark.parametrize(("groups_", "members", "one_task"), [(4, 12, 4_000_000), (40, 50, 4_000_000), (40, 50, 2_000)])
def test_communities(spark, groups_, members, one_task):
    g = communities.planted(spark, groups=groups_, members=members)
    of = {r["id"]: r["community"] for r in communities.communities(g.nodes, g.edges, one_task=one_task).collect()}
    edges = [(r["src"], r["dst"]) for r in g.edges.collect()]
    own = {r["id"]: r["group"] for r in g.nodes.collect()}
    assert set(of) == set(own)
    got = communities.modularity(g.edges, spark.createDataFrame(list(of.items()), "id string, community string"))
    assert abs(got - _plain_modularity(edges, of)) < 1e-9
    assert got >= 0.9 * _plain_modularity(edges, own) and got >= 0.9 * _plain_modularity(edges, _plain_louvain(edges))
    members_of = {}
    for i, c in of.items():
        members_of.setdefault(c, []).append(i)
    assert all(c == min(m) for c, m in members_of.items())


def _weighed(spark, pairs):
    links = spark.createDataFrame([(x, y, 1.0) for p in pairs for x, y in (p, p[::-1])], "a long, b long, w double")
    k = links.groupBy("a").agg(F.sum("w").alias("ka"))
    return links.join(k, "a").join(k.selectExpr("a as b", "ka as kb"), "b").select("a", "ka", "b", "kb", "w"), 2.0 * len(pairs)


def test_what_nothing_picks_joins_in_one_round(spark):
    # centres with 20 leaves each, tied in a ring
    pairs = [(100 * c, 100 * c + k) for c in range(10) for k in range(1, 21)] + [(100 * c, 100 * ((c + 1) % 10)) for c in range(10)]
    moves, left = communities._contracted(*_weighed(spark, pairs), 0)
    assert {(r["v"], r["to"]) for r in moves.collect()} == {(y, x) for x, y in pairs if y % 100}
    assert {(r["a"], r["b"]) for r in left.collect()} == {(x, y) for p in pairs if not p[1] % 100 for x, y in (p, p[::-1])}


def test_no_node_joins_one_that_moves(spark):
    rng = random.Random(3)
    e, total = _weighed(spark, sorted({(v, rng.randrange(max(0, v - 9), v)) for v in range(1, 600) for _ in range(2)}))
    e = e.cache()
    for turn in range(3):
        moves = [(r["v"], r["to"]) for r in communities._contracted(e, total, turn)[0].collect()]
        assert len(moves) == len({v for v, _ in moves}) > 0 and not {v for v, _ in moves} & {to for _, to in moves}
    e.unpersist()


def test_picks_come_from_links_where_they_lie(spark, monkeypatch):
    plans, kept = [], communities.stored_by
    monkeypatch.setattr(communities, "stored_by", lambda df, *x: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or kept(df, *x))
    g = communities.planted(spark, groups=4, members=30)
    communities.communities(g.nodes, g.edges, one_task=50)
    picks = [p for columns, p in plans if columns == ["a", "ka", "to"]]
    assert picks and not any("Exchange" in p for p in picks)
    # weights come by one shuffle of the links, and moves by two
    dealt = [p.count("REPARTITION_BY_NUM") for columns, p in plans if columns == ["a", "ka", "b", "kb", "w"]]
    assert dealt[0] == 1 and set(dealt[1:]) == {2}


def test_quality_of_choices_and_edges_to_missing_nodes(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(300)] + [("n1", "n1"), ("n1", "n1"), ("n2", "n3"), ("n2", "n3")]
    nodes, edges = spark.createDataFrame([(f"n{k}",) for k in range(40)], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    v = F.regexp_extract("id", r"n(.*)", 1).cast("long")
    links = communities._links(edges.select(*(F.regexp_extract(x, r"n(.*)", 1).cast("long").alias(x) for x in ("src", "dst"))))
    k = links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"))
    e = links.filter("a != b").join(k.selectExpr("v as a", "k as ka"), "a").join(k.selectExpr("v as b", "k as kb"), "b")
    of = nodes.select(v.alias("v"), (v % 7).alias("c"))
    total = 2.0 * len(pairs)
    got = communities._quality(communities._choices(e, of, k, total, 4), total)
    assert abs(got - _plain_modularity(pairs, {f"n{x}": x % 7 for x in range(40)})) < 1e-9
    lost = edges.unionAll(spark.createDataFrame([("n1", "gone"), ("gone", "away"), (None, "n1"), ("n0", "gone")], "src string, dst string"))
    same = [{tuple(r) for r in communities.communities(nodes, x).collect()} for x in (edges, lost)]
    assert same[0] == same[1] and len(same[0]) == 40


def test_collapsing_without_a_property(spark):
    g = communities.planted(spark, groups=4, members=12)
    small, collapsed = groups.collapse_above(g, threshold=40)
    assert collapsed and small.nodes.agg(F.sum("members")).first()[0] == 48
    assert groups.collapse_above(g, threshold=48) == (g, False)


def test_communities_without_links(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    none = spark.createDataFrame([], "src string, dst string")
    assert sorted(map(tuple, communities.communities(nodes, none).collect())) == [("a", "a"), ("b", "b")]


def test_elements(spark):
    data = [
        {"id": "1", "label": "Person", "properties": {"age": [{"value": "30"}, {"value": "31"}]}},
        {"label": "knows", "outV": "1", "inV": "2", "inVLabel": "Dog"}, {"id": "2", "label": "Cat", "name": "late"}, {"id": "3", "color": "red"}, {"color": "none"},
    ]
    g = readers.elements(spark.createDataFrame([(json.dumps({"result": {"data": data}}),)], "j string"), "j")
    assert {r["id"]: (r["types"], r["props"]) for r in g.nodes.collect()} == {"1": (["Person"], {"name": "1", "age": "30"}), "2": (["Dog"], {}), "3": (["Vertex"], {"color": "red"})}
    assert [(r["src"], r["dst"], r["type"]) for r in g.edges.collect()] == [("1", "2", "knows")]


def test_values_and_views(spark):
    one = spark.range(1)
    x = "http://www.w3.org/2001/XMLSchema#"
    lit = [values.cast_literal(F.lit(v), F.lit(t)) for v, t in (("12px", f"{x}int"), ("1.5e1z", f"{x}double"), ("no", f"{x}boolean"), ("7", None), ("abc", f"{x}int"))]
    assert [tuple(v) for v in one.select(*(c.alias(f"c{k}") for k, c in enumerate(lit))).first()] == [(12.0, None, None), (15.0, None, None), (None, False, None), (None, None, "7"), (None, None, None)]
    p = {"a": "http://a/"}
    assert tuple(one.select(values.expanded(F.lit("a:b:c"), p), values.expanded(F.lit("z:b"), p), values.shortened(F.lit("http://a/q"), p), values.shortened(F.lit("http://b/q"), p)).first()) == ("http://a/b:c", "z:b", "a:q", "q")
    assert list(one.select(*(views.is_image(F.lit(v)) for v in ("x.PNG?v=1", "data:image/png;base64,", "user", "https://h")), views.is_image(F.lit(None).cast("string"))).first()) == [True, True, False, True, False]
    assert list(one.select(views.coerced("number", F.lit("x")), views.coerced("number", F.lit(" 4 ")), views.coerced("checkbox", F.lit("")), views.coerced("text", F.lit("t"))).first()) == [0.0, 4.0, False, "t"]
    assert list(one.select(*views.coverage(F.lit(0.5), F.lit(0.2))).first()) == [0.5, 0.5, 0.0]


def test_neighborhood_of_unknown_start(spark):
    g = Graph(spark.createDataFrame([("a", ["T"], 0)], "id string, types array<string>, ord int"), spark.createDataFrame([], "id string, src string, dst string, type string"))
    assert views.neighborhood(g, spark.createDataFrame([("z",)], "id string"), 2).nodes.count() == 0
