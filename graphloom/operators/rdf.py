"""Triples: projection to a graph, collapsing steps, pattern matching and RDFS-plus inference.

``triples``: s, p, o, otype (uri, literal or bnode), datatype, lang, ord.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.values import local_part
from graphloom.plans.graph import Graph
from graphloom.plans.session import joined, released, stored

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE, FIRST, REST, NIL = f"{RDF}type", f"{RDF}first", f"{RDF}rest", f"{RDF}nil"
_BUILTIN = (RDF, RDFS, OWL, "http://purl.org/dc/")


def _literal(df: DataFrame, s: Column, p: Column, o: Column, order: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit("literal").alias("otype"), none.alias("datatype"), none.alias("lang"), order.alias("ord"))


def drop_types(t: DataFrame) -> DataFrame:
    return t.filter(F.col("p") != TYPE)


def drop_literals(t: DataFrame) -> DataFrame:
    """Without literals, but for those of blank nodes."""
    return t.filter((F.col("otype") != "literal") | F.col("s").startswith("_:"))


def fold_blank_nodes(t: DataFrame) -> DataFrame:
    """A blank node's properties become literals of the named subject that refers to it last."""
    blank = F.col("s").startswith("_:")
    if t.filter(blank | F.col("o").startswith("_:")).isEmpty():
        return t
    parent = t.filter(~blank & F.col("o").startswith("_:")).groupBy(F.col("o").alias("b")).agg(F.max_by(F.struct("s", "p"), "ord").alias("up"), F.max("ord").alias("uo"))
    props = t.filter(blank).groupBy(F.col("s").alias("b"), local_part(F.col("p")).alias("k")).agg(F.max_by("o", "ord").alias("v"))
    held = parent.join(props, "b")
    whole = held.groupBy("b", "up", "uo").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))
    rest = t.filter(~blank & ~F.col("o").startswith("_:"))
    return rest.unionByName(_literal(whole, F.col("up.s"), F.col("up.p"), F.col("json"), F.col("uo"))).unionByName(
        _literal(held, F.col("up.s"), F.concat("up.p", F.lit("/"), "k"), F.col("v"), F.col("uo"))
    )


def fold_lists(t: DataFrame) -> DataFrame:
    """rdf:first/rest chains of any length with a parent outside the list become a JSON array literal of the last parent.

    Cells reach their elements by jumps of 1, 2, 4 ... cells, so a list of n takes about log n
    rounds. Chains that run into a cycle are no lists: all their triples stay.
    """
    if t.filter(F.col("p").isin(FIRST, REST)).isEmpty():
        return t
    first, rest = F.col("p") == FIRST, F.col("p") == REST
    cells = t.filter(first | rest).groupBy(F.col("s").alias("cell"))
    cells = stored(cells.agg(F.max_by("o", F.when(first, F.col("ord"))).alias("v"), F.max_by("o", F.when(rest, F.col("ord"))).alias("next"), F.bool_or(first).alias("filled")))
    n = cells.count()
    jump = stored(cells.select("cell", F.col("next").alias("to")).join(cells.select(F.col("cell").alias("to")), "to", "left_semi").select("cell", "to"))
    jumps = []
    while not jump.isEmpty() and 2 ** len(jumps) <= n:
        jumps.append(jump)
        jump = stored(jump.select("cell", F.col("to").alias("over")).join(jump.select(F.col("cell").alias("over"), "to"), "over").select("cell", "to"))
    # what can still go on after as many steps as there are cells goes round
    endless = jump.select("cell")
    outer = t.filter(~F.col("p").isin(FIRST, REST))
    heads = outer.join(cells.filter("filled").select(F.col("cell").alias("o")), "o", "left_semi").groupBy(F.col("o").alias("cell")).agg(F.max_by(F.struct("s", "p"), "ord").alias("up"), F.max("ord").alias("ord"))
    heads = stored(heads.join(endless, "cell", "left_anti"))
    members = stored(heads.select(F.col("cell").alias("head"), "cell", F.lit(0).cast("long").alias("pos")))
    for k in range(len(jumps) - 1, -1, -1):
        further = members.join(jumps[k], "cell").select("head", F.col("to").alias("cell"), (F.col("pos") + 2**k).alias("pos"))
        members, old = stored(members.unionAll(further)), members
        released(old, jumps[k])
    items = members.join(cells.select("cell", "v"), "cell").groupBy("head").agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])).alias("vs"))
    done = heads.join(items, heads["cell"] == items["head"])
    gone = members.select("cell")
    plain = outer.join(gone.withColumnRenamed("cell", "s"), "s", "left_anti").join(gone.withColumnRenamed("cell", "o"), "o", "left_anti")
    if not endless.isEmpty():
        round_ = t.filter(F.col("p").isin(FIRST, REST)).join(endless.withColumnRenamed("cell", "s"), "s", "left_semi")
        plain = plain.select(t.columns).unionByName(round_.select(t.columns))
    out = plain.select(t.columns).unionByName(_literal(done, F.col("up.s"), F.col("up.p"), F.to_json("vs"), F.col("ord")))
    out = stored(out)
    released(cells, jump, heads, members)
    return out


def fold_statements(t: DataFrame) -> DataFrame:
    """Reified statements: their further properties become ``edge-meta:<predicate>:<key>`` literals of the subject.

    What makes up the statements is grouped once, one row a statement; only further properties are
    joined with it, and the rest of a statement's own triples never moves again.
    """
    mark = F.coalesce((F.col("p") == TYPE) & (F.col("o") == f"{RDF}Statement"), F.lit(False))
    if t.filter(mark).isEmpty():
        return t
    # these make up a statement, unless nothing marks their subject as one
    own = F.coalesce(F.col("p").isin([RDF + n for n in ("type", "subject", "predicate", "object")]) & F.col("s").isNotNull(), F.lit(False))

    def part(name: str) -> Column:
        return F.when(F.col("p") == RDF + name, F.col("o"))

    # narrow rows, as strings are grouped by sorting
    narrow = t.filter(own).select("s", mark.alias("mark"), part("subject").alias("subj"), part("predicate").alias("pred"))
    heads = stored(narrow.groupBy("s").agg(*(F.max(c).alias(c) for c in ("mark", "subj", "pred"))))
    more = t.filter(~own).join(heads.filter("mark"), "s", "left")
    folded = F.col("mark").isNotNull()
    made = {"s": F.col("subj"), "p": F.concat(F.lit("edge-meta:"), local_part(F.col("pred")), F.lit(":"), local_part(F.col("p"))), "otype": F.lit("literal"), "datatype": F.lit(None), "lang": F.lit(None)}
    more = more.filter(~folded | F.col("p").isNotNull()).select(*(F.when(folded, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in t.columns))
    return more.unionByName(_of_names(t.filter(own), "s", heads.filter("not mark").select(F.col("s").alias("n"))))


Step = Callable[[DataFrame], DataFrame]
PRESETS: dict[str, list[Step]] = {
    "standard": [drop_types, fold_blank_nodes, fold_lists, fold_statements, drop_literals],
    "ontology": [fold_blank_nodes, fold_lists, fold_statements, drop_literals],
    "provenance": [drop_types, fold_blank_nodes, fold_lists, drop_literals],
    "statements-first": [fold_statements, drop_types, fold_blank_nodes, fold_lists, drop_literals],
}


def project(triples: DataFrame, steps: list[Step]) -> Graph:
    """Graph of a triple table: types and literals are taken first, then the steps run, then edges are made.

    Nodes have a props map (last literal of a key wins; those that steps made only fill gaps).
    """
    named = ~F.col("s").startswith("_:")
    types = triples.filter(named & (F.col("p") == TYPE)).groupBy(F.col("s").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", local_part(F.col("o")).alias("t")))), lambda x: x["t"]).alias("types"))

    def props(t: DataFrame, name: str) -> DataFrame:
        last = t.filter(named & (F.col("otype") == "literal")).groupBy(F.col("s").alias("id"), local_part(F.col("p")).alias("k")).agg(F.max_by("o", "ord").alias("v"))
        return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))

    # each folding step reads its input several times, so its result is kept until the next one is there;
    # filters, and folds that find nothing to fold, are not written again
    triples = stored(triples)
    stepped, kept = triples, triples
    for step in steps:
        made, before = step(stepped), stepped
        if step in (drop_types, drop_literals) or made is before:
            stepped = made
            continue
        stepped, old = stored(made), kept
        kept = stepped
        if old is not triples:
            released(old)
    edges = stepped.filter(named & (F.col("otype") == "uri") & ~F.col("o").startswith("_:"))
    ids = triples.filter(named).select(F.col("s").alias("id")).unionAll(edges.select(F.col("o").alias("id"))).distinct()
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    nodes = ids.join(types, "id", "left").join(props(triples, "pre"), "id", "left").join(props(stepped, "made"), "id", "left")
    own = F.coalesce("pre", empty)
    extra = F.map_filter(F.coalesce("made", empty), lambda k, v: ~F.map_contains_key(own, k))
    nodes = nodes.select("id", F.coalesce("types", F.array(F.lit("Resource"))).alias("types"), F.map_concat(own, extra).alias("props"))
    return Graph(nodes, edges.select(F.concat_ws("|", "s", "p", "o").alias("id"), F.col("s").alias("src"), F.col("o").alias("dst"), local_part(F.col("p")).alias("type"), "ord"))


def instances(triples: DataFrame, classes: list[str] | None = None) -> Graph:
    """The graph of what has a type among ``classes`` (all types, if none are given).

    Nodes have their types, a name (the last label, else the local part) and ``props``, a map from
    local key to all values of it in order; edges are the links between such nodes but for types and subclasses.
    """
    t = triples.filter((F.col("p") == TYPE) & (F.col("otype") == "uri"))
    t = t.filter(F.col("o").isin(classes)) if classes is not None else t
    label = f"{RDFS}label"
    types = t.groupBy(F.col("s").alias("id"), F.col("o")).agg(F.min("ord").alias("ord")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", local_part(F.col("o")).alias("t")))), lambda x: x["t"]).alias("types"))
    names = triples.filter(F.col("p") == label).groupBy(F.col("s").alias("id")).agg(F.max_by("o", "ord").alias("label"))
    values = triples.filter((F.col("otype") == "literal") & (F.col("p") != label)).groupBy(F.col("s").alias("id"), local_part(F.col("p")).alias("k"))
    values = values.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "o"))), lambda x: x["o"]).alias("v"))
    props = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    nodes = types.join(names, "id", "left").join(props, "id", "left")
    empty = F.create_map().cast("map<string,array<string>>")
    nodes = nodes.select("id", "types", F.coalesce("label", local_part(F.col("id"))).alias("name"), F.coalesce("props", empty).alias("props"))
    links = triples.filter((F.col("otype") == "uri") & ~F.col("p").isin(TYPE, f"{RDFS}subClassOf"))
    for end in ("s", "o"):
        links = links.join(types.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(nodes, links.select(F.concat_ws("|", "s", "p", "o").alias("id"), F.col("s").alias("src"), F.col("o").alias("dst"), local_part(F.col("p")).alias("type"), F.lit(1.0).alias("confidence")))


def answers(bindings: DataFrame, variables: dict[str, Column | str], *, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None, distinct: bool = False) -> DataFrame:
    """The variables of a pattern's bindings, filtered, ordered, made distinct and cut, in the order that queries do it."""
    out = bindings if where is None else bindings.filter(where)
    if order and not distinct:
        out = out.orderBy(*order)
    out = out.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in variables.items()))
    if distinct:
        out = out.distinct()
        out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern: one column a variable (``?x``), joined on shared variables.

    Patterns with more constants go first and each next one shares a variable where it can, so
    no step is a product unless the pattern itself is.
    """
    left = sorted(patterns, key=lambda p: sum(v.startswith("?") for v in p))
    out: DataFrame | None = None
    while left:
        bound = set(out.columns) if out is not None else set()
        pick = next((p for p in left if out is None or {v[1:] for v in p if v.startswith("?")} & bound), left[0])
        left.remove(pick)
        part, names = triples, {}
        for c, v in zip(("s", "p", "o"), pick, strict=True):
            if not v.startswith("?"):
                part = part.filter(F.col(c) == v)
            elif v[1:] in names:
                part = part.filter(F.col(c) == F.col(names[v[1:]]))
            else:
                names[v[1:]] = c
        part = part.select(*(F.col(c).alias(v) for v, c in names.items()))
        out = part if out is None else out.join(part, sorted(bound & names.keys())) if bound & names.keys() else out.crossJoin(part)
    return out


def _is_builtin(p: Column) -> Column:
    return reduce(lambda a, b: a | b, (p.startswith(x) for x in _BUILTIN))


#: So many axioms may be sent to every executor; more are joined by a shuffle.
_AXIOMS = 200_000
#: So many names may stand in a filter; more are joined.
_NAMES = 1_000


def _of_names(df: DataFrame, c: str, names: DataFrame) -> DataFrame:
    """The rows whose column ``c`` is one of ``names`` (n)."""
    few = names.distinct().limit(_NAMES + 1).collect()
    if len(few) <= _NAMES:
        return df.filter(F.col(c).isin([r["n"] for r in few]))
    return df.join(names.distinct().withColumnRenamed("n", c), c, "left_semi").select(df.columns)


def _closed(pairs: DataFrame, through: Column | None = None) -> DataFrame:
    """(a, b): what ``b`` can be reached from ``a``, not a itself, in as many rounds as the longest way has doublings; ``through`` limits the places between (m)."""
    known = stored(pairs.select("a", "b").filter("a != b").distinct())
    new, parts = known, [known]
    while not new.isEmpty():
        every = reduce(DataFrame.unionAll, parts)
        ways = []
        for x, y in ((new, every), (every, new)):
            first = x.select("a", F.col("b").alias("m"))
            first = first if through is None else first.filter(through)
            ways.append(first.join(y.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
        new = stored(reduce(DataFrame.unionAll, ways).filter("a != b").distinct().join(every, ["a", "b"], "left_anti"))
        parts.append(new)
    return joined(parts)


class _Axioms:
    """The classes' and properties' axioms among some triples, closed, as small tables."""

    #: What axioms are made of.
    KEYS = tuple(f"{RDFS}{k}" for k in ("subClassOf", "subPropertyOf", "domain", "range")) + tuple(f"{OWL}{k}" for k in ("equivalentClass", "inverseOf"))
    KINDS = (f"{OWL}SymmetricProperty", f"{OWL}TransitiveProperty")

    def __init__(self, known: DataFrame) -> None:
        own = stored(known.filter(self.among()).select("s", "p", "o"))
        n = own.count()

        def of(p: str, a: str, b: str) -> DataFrame:
            return own.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))

        equal = of(f"{OWL}equivalentClass", "a", "b")
        self.same = equal.filter("a = b")
        self.sub = _closed(of(f"{RDFS}subClassOf", "a", "b").unionAll(equal).unionAll(equal.select("b", "a")))
        # a property between two others hands on only what it states itself, and builtin ones state nothing
        above = _closed(of(f"{RDFS}subPropertyOf", "a", "b"), ~_is_builtin(F.col("m")))
        inverse = of(f"{OWL}inverseOf", "p", "q")
        kind = own.filter(F.col("p") == TYPE)
        self._steps = [own, self.sub, above]
        small = F.broadcast if n <= _AXIOMS and max(self.sub.count(), above.count()) <= _AXIOMS else (lambda df: df)
        self.sub_of, self.above = small(self.sub), small(above.select(F.col("a").alias("p"), F.col("b").alias("q")))
        self.domain, self.range = small(of(f"{RDFS}domain", "p", "c").distinct()), small(of(f"{RDFS}range", "p", "c").distinct())
        self.inverse = small(inverse.unionAll(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct())
        self.symmetric, self.transitive = (small(kind.filter(F.col("o") == k).select(F.col("s").alias("p")).distinct()) for k in self.KINDS)

    @classmethod
    def among(cls) -> Column:
        return F.col("p").isin(*cls.KEYS) | ((F.col("p") == TYPE) & F.col("o").isin(*cls.KINDS))

    def touched(self, triples: DataFrame) -> DataFrame:
        """The triples that some rule starts from or could derive: those of the axioms' properties, and types of the axioms' classes."""
        def names(*parts: tuple[DataFrame, str]) -> DataFrame:
            return reduce(DataFrame.unionAll, (df.select(F.col(c).alias("n")) for df, c in parts)).filter("n is not null")

        fixed = triples.sparkSession.createDataFrame([(k,) for k in self.KEYS], "n string")
        kinds = triples.sparkSession.createDataFrame([(k,) for k in self.KINDS], "n string")
        properties = names((fixed, "n"), (self.above, "p"), (self.above, "q"), (self.domain, "p"), (self.range, "p"), (self.inverse, "p"), (self.inverse, "q"), (self.symmetric, "p"), (self.transitive, "p"))
        classes = names((kinds, "n"), (self.sub, "a"), (self.sub, "b"), (self.domain, "c"), (self.range, "c"))
        # a property may lead to types itself; then all of them count
        if not properties.filter(F.col("n") == TYPE).isEmpty():
            return _of_names(triples, "p", properties)
        return _of_names(triples, "p", properties).unionAll(_of_names(triples.filter(F.col("p") == TYPE), "o", classes))

    def lacks(self, triples: DataFrame) -> bool:
        """Whether some triples are axioms that aren't in the closure yet."""
        subclass = F.col("p") == f"{RDFS}subClassOf"
        known = self.sub.select(F.col("a").alias("s"), F.col("b").alias("o"))
        return not triples.filter(self.among()).join(known.withColumn("p", F.lit(f"{RDFS}subClassOf")), ["s", "p", "o"], "left_anti").filter(~subclass | (F.col("s") != F.col("o"))).isEmpty()

    def release(self) -> None:
        released(*self._steps)


def infer(triples: DataFrame, passes: int | None = None) -> DataFrame:
    """New triples (s, p, o) by RDFS-plus rules, pass by pass until nothing is new, or an error after ``passes``.

    Subclass and subproperty closure, type inheritance, equivalent classes, domain, range,
    inverse, symmetric and transitive properties. The axioms are closed first; a pass then joins
    only the last pass's new triples with them and, for transitive properties, with all known
    triples from both sides, so a chain's length doubles with each pass. A pass that brings new
    axioms closes them anew and starts over from all triples. Triples that no rule starts from
    and none could derive change nothing, so they are never stored or compared with the new ones.
    """
    def made(df: DataFrame, s: str, p: Column | str, o: str, iri: Column | None = None) -> DataFrame:
        return df.select(F.col(s).alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), F.col(o).alias("o"), (iri if iri is not None else F.lit(True)).alias("iri"))

    given = triples.select("s", "p", "o", (F.col("otype") != "literal").alias("iri"))
    rules = _Axioms(given)
    start = stored(rules.touched(given).distinct())
    parts, delta, done, anew = [start], start, 0, True
    while True:
        if passes is not None and done >= passes:
            raise RuntimeError(f"inference isn't finished after {passes} passes")
        done += 1
        if not anew and rules.lacks(delta):
            old = rules
            rules, anew = _Axioms(reduce(DataFrame.unionByName, parts)), True
            # new axioms touch more of the given triples
            start = stored(rules.touched(given).distinct())
            old.release()
            released(parts[0])
            parts[0] = start
        known = reduce(DataFrame.unionByName, parts)
        if anew:
            delta, anew = known, False
            closure = [made(df, "a", f"{RDFS}subClassOf", "b") for df in (rules.sub, rules.same)]
        else:
            closure = []

        facts = delta.filter(~_is_builtin(F.col("p")))
        links = facts.filter("iri")
        types = delta.filter(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("a"))
        here, all_ = (df.filter(~_is_builtin(F.col("p")) & F.col("iri")).join(rules.transitive, "p", "left_semi") for df in (delta, known))

        def hop(first: DataFrame, second: DataFrame) -> DataFrame:
            way = first.select("p", "s", F.col("o").alias("m")).join(second.select("p", F.col("s").alias("m"), "o"), ["p", "m"])
            return made(way.filter("s != o"), "s", F.col("p"), "o")

        new = [
            made(types.join(rules.sub_of, "a"), "x", TYPE, "b"),
            made(facts.join(rules.above, "p"), "s", F.col("q"), "o", F.col("iri")),
            made(facts.join(rules.domain, "p"), "s", TYPE, "c"),
            made(links.join(rules.range, "p"), "o", TYPE, "c"),
            made(links.join(rules.inverse, "p"), "o", F.col("q"), "s"),
            made(links.join(rules.symmetric, "p", "left_semi"), "o", F.col("p"), "s"),
            hop(here, all_), hop(all_, here), *closure,
        ]
        fresh = stored(reduce(DataFrame.unionAll, new).distinct().join(known, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            released(fresh)
            break
        parts.append(fresh)
        delta = fresh
        if len(parts) > 8:
            parts = [start, joined(parts[1:-1]), fresh]
    rules.release()
    empty = start.limit(0)
    out = stored(reduce(DataFrame.unionByName, parts[1:], empty).select("s", "p", "o").distinct())
    released(*parts)
    return out


def kinds(triples: DataFrame) -> DataFrame:
    """(id, kind): Class, property kinds or Individual, by the first recognised type."""
    names = {f"{OWL}Class": "Class", f"{RDFS}Class": "Class", f"{OWL}ObjectProperty": "ObjectProperty", f"{OWL}DatatypeProperty": "DatatypeProperty", f"{OWL}AnnotationProperty": "AnnotationProperty", f"{OWL}Ontology": "Ontology"}
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("o"))
    first = triples.filter(F.col("p") == TYPE).withColumn("k", kind).groupBy("s").agg(F.min_by("k", F.when(F.col("k").isNotNull(), F.col("ord"))).alias("k"))
    return first.select(F.col("s").alias("id"), F.coalesce("k", F.lit("Individual")).alias("kind"))


def observed_classes(triples: DataFrame) -> DataFrame:
    """(cls, instances): the classes that anything is typed with, and how many things each has."""
    return triples.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("cls")).agg(F.countDistinct("s").alias("instances"))


def ontology_summary(triples: DataFrame) -> DataFrame:
    """(predicate, domain, range, n): observed classes at both ends of each predicate."""
    t = triples.filter(F.col("p") == TYPE).groupBy("s").agg(F.max_by("o", "ord").alias("c"))
    links = triples.filter((F.col("p") != TYPE) & (F.col("otype") == "uri"))
    j = links.join(t.withColumnRenamed("c", "domain"), "s").join(t.select(F.col("s").alias("o"), F.col("c").alias("range")), "o")
    return j.groupBy(F.col("p").alias("predicate"), "domain", "range").agg(F.count(F.lit(1)).alias("n"))
