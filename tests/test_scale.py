"""Operators whose method is meant for scale, on small inputs that force each of their ways: inference, tours, paths, search, history."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import groups, history, preorder, provenance, rdf, search, traversal
from graphloom.plans.graph import Graph
from graphloom.plans.session import _STEPS

_T = "s string, p string, o string, otype string, ord long"
SUB, SUBP, DOM, RNG = (f"{rdf.RDFS}{k}" for k in ("subClassOf", "subPropertyOf", "domain", "range"))
INV, EQ = f"{rdf.OWL}inverseOf", f"{rdf.OWL}equivalentClass"
SYM, TRA = f"{rdf.OWL}SymmetricProperty", f"{rdf.OWL}TransitiveProperty"


def triples(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else "uri", k) for k, r in enumerate(rows)], _T)


def edge_rows(spark, pairs, kind="next"):
    return spark.createDataFrame([(f"e{k:04}", a, b, kind) for k, (a, b) in enumerate(pairs)], "id string, src string, dst string, type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def closed(rows):
    """All triples by the rules, one after another until nothing is new; literals are marked by a leading quote."""
    known = {r[:3] for r in rows}
    builtin = (rdf.RDF, rdf.RDFS, rdf.OWL)
    while True:
        new = set()
        for s, p, o in known:
            if p == SUB:
                new |= {(s, SUB, c) for b, q, c in known if q == SUB and b == o and c != s}
            if p == EQ:
                new |= {(s, SUB, o), (o, SUB, s)}
            if p == rdf.TYPE:
                new |= {(s, rdf.TYPE, c) for b, q, c in known if q == SUB and b == o}
            if p.startswith(builtin):
                continue
            link = not o.startswith('"')
            for a, q, b in known:
                if a == p:
                    if q == SUBP:
                        new.add((s, b, o))
                    if q == DOM:
                        new.add((s, rdf.TYPE, b))
                    if q == RNG and link:
                        new.add((o, rdf.TYPE, b))
                    if q == INV and link:
                        new.add((o, b, s))
                    if q == rdf.TYPE and b == SYM and link:
                        new.add((o, p, s))
                    if q == rdf.TYPE and b == TRA and link:
                        new |= {(s, p, z) for y, r, z in known if r == p and y == o and z != s and not z.startswith('"')}
                if q == INV and b == p and link:
                    new.add((o, a, s))
        if new <= known:
            return known - {r[:3] for r in rows}
        known |= new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inference_equals_plain_rules(spark, seed):
    rng = random.Random(seed)
    classes, props, things = [f"C{k}" for k in range(6)], [f"p{k}" for k in range(5)], [f"x{k}" for k in range(7)]
    rows = [(rng.choice(classes), SUB, rng.choice(classes)) for _ in range(4)] + [(rng.choice(classes), EQ, rng.choice(classes))]
    rows += [(rng.choice(props), SUBP, rng.choice(props)) for _ in range(2)] + [("p0", DOM, "C0"), ("p1", RNG, "C1"), ("p2", INV, "p3"), (rng.choice(props), rdf.TYPE, SYM), (rng.choice(props), rdf.TYPE, TRA)]
    # a class of properties, and a property above a builtin one: axioms that only inference finds
    rows += [("Chain", SUB, TRA), ("p4", rdf.TYPE, "Chain"), ("kind", SUBP, SUB), ("C5", "kind", "C0")]
    rows += [(rng.choice(things), rng.choice(props), rng.choice(things)) for _ in range(8)] + [(rng.choice(things), rdf.TYPE, rng.choice(classes)) for _ in range(3)]
    rows += [("x0", "p0", '"text', "literal"), ("x1", "p1", '"text', "literal")]
    rows = list(dict.fromkeys(rows))
    got = {tuple(r) for r in rdf.infer(triples(spark, rows)).collect()}
    assert got == closed(rows)


def test_a_chain_takes_as_many_passes_as_it_has_doublings(spark):
    rows = [("next", rdf.TYPE, TRA)] + [(f"n{k:03}", "next", f"n{k + 1:03}") for k in range(130)]
    got = rdf.infer(triples(spark, rows), passes=10)
    assert got.count() == 130 * 131 // 2 - 130


def test_no_step_is_left_but_the_result(spark):
    before = set(_STEPS)
    e = edge_rows(spark, [(f"n{k}", f"n{k + 1}") for k in range(9)])
    traversal.hops(e, ids(spark, "n0")).count()
    traversal.components(ids(spark, "n0", "n9"), e).count()
    rdf.infer(triples(spark, [("a", SUB, "b"), ("b", SUB, "c"), ("x", rdf.TYPE, "a")])).count()
    # number_rows keeps its sorted rows, the others their result alone
    assert len(set(_STEPS) - before) <= 4


def test_nested_groups(spark):
    chain = [(f"g{k}", f"g{k + 1}") for k in range(12)] + [("g12", "leaf"), ("a", "b"), ("b", "a")]
    got = {tuple(r) for r in groups.nested(spark.createDataFrame(chain, "group string, id string")).collect()}
    want = {(f"g{k}", f"g{j}") for k in range(13) for j in range(k + 1, 13)} | {(f"g{k}", "leaf") for k in range(13)} | {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
    assert got == want


def _walk(children, roots):
    out, stack = [], list(reversed(roots))
    while stack:
        v = stack.pop()
        out.append(v)
        stack += reversed(children.get(v, []))
    return out


@pytest.mark.parametrize("one_task", [preorder.ONE_TASK, 0])
def test_places_in_depth_first_order(spark, one_task):
    rng = random.Random(5)
    n = 10_000 if one_task else 300
    parent = {f"n{k:05}": f"n{rng.randint(max(0, k - 40), k - 1):05}" if k % 997 else None for k in range(n)}
    # a path as well, and a parent that isn't there
    parent |= {f"p{k:05}": f"p{k - 1:05}" if k else None for k in range(n // 2)} | {"orphan": "gone"}
    children, roots = {}, []
    for v in sorted(parent):
        children.setdefault(parent[v], []).append(v) if parent[v] in parent else roots.append(v)
    tree = spark.createDataFrame(list(parent.items()), "id string, parent string").repartition(5)
    got = {r["id"]: r["place"] for r in preorder.preorder(tree, one_task=one_task).collect()}
    roots.sort(key=lambda v: (parent[v] is not None, v))
    assert got == {v: k for k, v in enumerate(_walk(children, roots))}
    assert preorder.preorder(tree.limit(0)).count() == 0


def test_long_tours_are_folded_by_ranges_and_thinned(spark, monkeypatch):
    sizes, thin = [], preorder._thinned
    monkeypatch.setattr(preorder, "_thinned", lambda now, turn: sizes.append(now.count()) or thin(now, turn))
    rng = random.Random(7)
    # two fans of leaves under one root, and a path whose ids are in no order
    fans = {"a": None, "b": "a", "c": "a"} | {f"{p}{k:03}": p for p in "bc" for k in range(300)}
    names = [f"p{k:03}" for k in range(120)]
    rng.shuffle(names)
    parent = fans | dict(zip(names, [None, *names[:-1]], strict=True))
    children = {}
    for v in sorted(parent):
        children.setdefault(parent[v], []).append(v)
    tree = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r["id"]: r["place"] for r in preorder.preorder(tree, one_task=100, wide=50).collect()}
    assert got == {v: k for k, v in enumerate(_walk(children, children[None]))}
    # 1446 ways: the fans' fold to a few, the path's do not; each round leaves fewer
    assert sizes[0] < 300 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("steps", [1, 2, 3, 4, 5])
def test_paths_of_exact_length(spark, steps):
    rng = random.Random(steps)
    pairs = [(f"n{rng.randint(0, 11)}", f"n{rng.randint(0, 11)}") for _ in range(22)] + [("n0", "n1"), ("n1", "n0"), ("n3", "n3")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    sources, targets = ["n0", "n5", "none"], ["n1", "n5", "n7"]

    def go(path):
        if len(path) == steps + 1:
            return [tuple(path)] if path[-1] in targets else []
        return [p for x in near.get(path[-1], ()) if x not in path for p in go([*path, x])]

    want = sorted(p for s in sources for p in go([s]))
    got = traversal.paths_of_length(edge_rows(spark, pairs), ids(spark, *sources), ids(spark, *targets), steps)
    assert sorted(tuple(r["path"]) for r in got.collect()) == want and want


def test_fuzzy_search_finds_what_scoring_all_finds(spark):
    rng = random.Random(9)
    nodes = [(f"id-{k}", [rng.choice(["Supplier", "Customer", "Warehouse"])], k, "".join(rng.choices("abcdefgh ", k=12)), "".join(rng.choices("klmnop ", k=20)), float(k)) for k in range(120)]
    nodes += [("id-x", ["Depot"], 200, "Hamburg harbour", "cold storage", 1.5), ("id-y", ["Harbour"], 201, None, "near hamburg", None), ("harbourless", ["Depot"], 202, "x", None, None), ("id-z", ["Depot"], 203, "", "the harbor", None)]
    df = spark.createDataFrame(nodes, "id string, types array<string>, ord int, name string, note string, size double")
    texts = [(r["id"], r["field"], r["text"]) for r in search.fields(df).collect()]

    def plain(query):
        q, scores = query.strip().lower(), {}
        for i, field, text in texts:
            edits = search._edits(q, text)
            if edits <= int(0.35 * len(q)):
                scores[i] = scores.get(i, 0) + search.WEIGHTS[field] * (1 - edits / len(q))
        return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:20]

    index = search.gram_index(search.fields(df))
    # typos in four fields, a prefix, short ones that have to look everywhere
    for query in ("harbour", "harbuor", "Hamborg", "suplier", "id-x", "1.5", "warehuose", "ab", "abc", "storage", "zzzzzzzz"):
        want = plain(query)
        assert [tuple(r) for r in search.search(df, query, index=index).collect()] == want, query
    found = search.search(df, "harbuor")
    assert {r["id"] for r in found.collect()} >= {"id-x", "id-y", "harbourless", "id-z"}
    assert search.others(df, found).count() == len(nodes) - found.count()
    assert search.search(df, " ").count() == search.search(df, "h").count() == 0


def test_undo_and_redo(spark):
    nodes, edges = "id string, types array<string>, x int", "id string, src string, dst string, type string"

    def graph(ns, es):
        return Graph(spark.createDataFrame(ns, nodes), spark.createDataFrame(es, edges))

    def rows(g):
        return sorted((r["id"], r["x"]) for r in g.nodes.collect()), sorted(r["id"] for r in g.edges.collect())

    rng, state, links = random.Random(1), {"a": 1, "b": 2}, {"e0": ("a", "b")}
    versions = [graph([(i, ["T"], x) for i, x in state.items()], [(i, *e, "to") for i, e in links.items()])]
    for k in range(1, 51):
        kind = rng.randint(0, 3)
        if kind == 0 or not state:
            state[f"n{k}"] = k
        elif kind == 1:
            state[rng.choice(sorted(state))] = None if k % 5 == 0 else k
        elif kind == 2:
            state.pop(rng.choice(sorted(state)))
        else:
            links[f"e{k}"] = ("a", "b")
        versions.append(graph([(i, ["T"], x) for i, x in state.items()], [(i, *e, "to") for i, e in links.items()]))
    kept = history.begun(versions[0], depth=40)
    for a, b in zip(versions, versions[1:], strict=False):
        kept = history.recorded(kept, a, b)
        kept = history.replace(kept, nodes=spark.createDataFrame(kept.nodes.collect(), kept.nodes.schema), edges=spark.createDataFrame(kept.edges.collect(), kept.edges.schema))
    assert (kept.at, kept.undo_count, kept.redo_count) == (50, 40, 0)
    assert kept.nodes.agg(F.min("version")).first()[0] > 10
    log, at = kept, versions[-1]
    for k in range(49, 9, -1):
        log, at = history.undone(log, at)
        assert rows(at) == rows(versions[k])
        at = graph([tuple(r) for r in at.nodes.collect()], [tuple(r) for r in at.edges.collect()])
    assert history.undone(log, at) is None and log.redo_count == 40
    for k in range(11, 14):
        log, at = history.redone(log, at)
        assert rows(at) == rows(versions[k])
    fresh = history.recorded(log, at, versions[0])
    assert (fresh.at, fresh.redo_count, fresh.undo_count) == (14, 0, 4) and history.redone(fresh, versions[0]) is None
    assert rows(history.undone(fresh, versions[0])[1]) == rows(at)
    assert history.undone(history.cleared(fresh), at) is None


def _plain_chain(graph, entities, bare, root, most=3):
    seen, out = set(), []

    def walk(v, depth, parent, via):
        seen.add(v)
        out.append((v, depth, parent, via, False))
        queued, children = set(), []
        if depth < most:
            for edge, kind, to in sorted(graph.get(v, [])):
                if kind in provenance.CHAIN and to not in seen and to not in queued:
                    queued.add(to)
                    children.append((to, kind))
        if not children and v in bare:
            out.append((f"{v}::absence", depth + 1, v, None, True))
        for to, kind in children:
            if to not in seen:
                walk(to, depth + 1, v, kind)

    walk(root, 0, None, None)
    return [(*r, k) for k, r in enumerate(out)]


@pytest.mark.parametrize("seed", range(4))
def test_chains_follow_the_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"v{k}" for k in range(9)]
    rows = [(f"e{k:02}", rng.choice(names), rng.choice(names), rng.choice([*provenance.CHAIN, "other"])) for k in range(26)]
    bare = set(rng.sample(names, 4))
    nodes = spark.createDataFrame([(v, ["Entity"], v not in bare) for v in names], "id string, types array<string>, attributed boolean")
    graph = {}
    for e, a, b, kind in rows:
        graph.setdefault(a, []).append((e, kind, b))
    got = provenance.chains(Graph(nodes, spark.createDataFrame(rows, "id string, src string, dst string, type string")), nodes)
    found = {}
    for r in got.collect():
        found.setdefault(r["root"], []).append((r["id"], r["depth"], r["parent"], r["via"], r["absence"], r["place"]))
    for v in names:
        assert sorted(found[v], key=lambda r: r[-1]) == _plain_chain(graph, names, bare, v)
