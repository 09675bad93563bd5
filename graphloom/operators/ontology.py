"""An ontology in triples: entities by kind, classes and instances, axioms, search, class hierarchy and instance graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import local_part
from graphloom.operators.rdf import OWL, RDFS, TYPE, kinds
from graphloom.plans.graph import Graph

_SUB = f"{RDFS}subClassOf"
_CLASSES = (f"{OWL}Class", f"{RDFS}Class")


def with_inferred(asserted: DataFrame, inferred: DataFrame) -> DataFrame:
    """(s, p, o, inferred): the union of both; what is asserted isn't inferred."""
    both = asserted.select("s", "p", "o", F.lit(False).alias("inferred")).unionAll(inferred.select("s", "p", "o", F.lit(True).alias("inferred")))
    return both.groupBy("s", "p", "o").agg(F.min("inferred").alias("inferred"))


def labels(t: DataFrame) -> DataFrame:
    """(id, label): the first rdfs:label of each subject, or its local part."""
    own = t.filter(F.col("p") == f"{RDFS}label").groupBy("s").agg(F.min_by("o", "ord").alias("label"))
    return t.select("s").distinct().join(own, "s", "left").select(F.col("s").alias("id"), F.coalesce("label", local_part(F.col("s"))).alias("label"))


def stats(t: DataFrame) -> DataFrame:
    """(kind, n) of the entities."""
    return kinds(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def instance_counts(t: DataFrame) -> DataFrame:
    """(cls, n) of the classes that have instances, the largest first."""
    classes = t.filter((F.col("p") == TYPE) & F.col("o").isin(*_CLASSES)).select(F.col("s").alias("cls")).distinct()
    n = t.filter(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return n.join(classes, "cls", "left_semi").orderBy(F.desc("n"), "cls")


def children(t: DataFrame) -> DataFrame:
    """(cls, child): direct subclasses."""
    return t.filter(F.col("p") == _SUB).select(F.col("o").alias("cls"), F.col("s").alias("child")).distinct()


def types_of(flagged: DataFrame) -> DataFrame:
    """(id, type, inferred) from triples with an ``inferred`` flag."""
    return flagged.filter(F.col("p") == TYPE).groupBy(F.col("s").alias("id"), F.col("o").alias("type")).agg(F.min("inferred").alias("inferred"))


def axioms(t: DataFrame) -> DataFrame:
    """(id, axiom): readable lines about classes and properties."""
    words = {
        _SUB: "SubClassOf", f"{OWL}equivalentClass": "EquivalentTo", f"{OWL}disjointWith": "DisjointWith", f"{RDFS}subPropertyOf": "SubPropertyOf", f"{RDFS}domain": "Domain",
        f"{RDFS}range": "Range", f"{OWL}inverseOf": "InverseOf",
    }
    word = F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), F.col("p"))
    marks = t.filter((F.col("p") == TYPE) & F.col("o").startswith(OWL) & F.col("o").endswith("Property") & ~F.col("o").isin(*(f"{OWL}{k}Property" for k in ("Object", "Datatype", "Annotation"))))
    lines = t.filter(F.col("p").isin(*words)).select(F.col("s").alias("id"), F.concat_ws(" ", word, local_part(F.col("o"))).alias("axiom"))
    return lines.unionAll(marks.select(F.col("s").alias("id"), local_part(F.col("o")).alias("axiom"))).distinct()


def annotations(t: DataFrame) -> DataFrame:
    """(id, property, value): labels, comments and all properties declared as annotations."""
    declared = t.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}AnnotationProperty")).select(F.col("s").alias("p")).distinct()
    fixed = t.filter(F.col("p").isin(f"{RDFS}label", f"{RDFS}comment"))
    return fixed.unionByName(t.join(declared, "p", "left_semi").select(t.columns)).select(F.col("s").alias("id"), local_part(F.col("p")).alias("property"), F.col("o").alias("value")).distinct()


def search(t: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """(id, label): entities whose label or IRI holds the text, in any case; ontologies themselves don't count. The limit is the feature's."""
    named = kinds(t).filter("kind != 'Ontology'").join(labels(t), "id")
    hit = F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower("id"), F.lit(text.lower()))
    return named.filter(hit).orderBy("label", "id").limit(limit).select("id", "label")


def class_hierarchy(flagged: DataFrame) -> Graph:
    """Classes and their subclass links, with whether a link is asserted."""
    links = flagged.filter(F.col("p") == _SUB).groupBy("s", "o").agg((~F.min("inferred")).alias("asserted"))
    ids = links.select(F.col("s").alias("id")).unionAll(links.select("o")).unionAll(flagged.filter((F.col("p") == TYPE) & F.col("o").isin(*_CLASSES)).select("s")).distinct()
    return Graph(ids.select("id", F.array(F.lit("Class")).alias("types"), local_part(F.col("id")).alias("name")), links.select(F.concat_ws("|", "s", "o").alias("id"), F.col("s").alias("src"), F.col("o").alias("dst"), F.lit("subClassOf").alias("type"), "asserted"))


def color_keys(nodes: DataFrame, left_out: tuple[str, ...] = ("name", "iri", "kind")) -> DataFrame:
    """(key): property keys of a props map that may carry a colour, sorted."""
    keys = nodes.select(F.explode(F.map_keys("props")).alias("key")).distinct()
    return keys.filter(~F.col("key").startswith("http") & ~F.col("key").isin(*left_out)).orderBy("key")


def raw_graph(t: DataFrame) -> Graph:
    """Every resource a node, every literal occurrence a node of its own, every triple an edge."""
    from graphloom.plans.session import number_rows

    n = number_rows(t, "ord", "s", "p", "o")
    literal = F.col("otype") == "literal"
    to = F.when(literal, F.concat(F.lit("literal:"), F.col("n").cast("string"))).otherwise(F.col("o"))
    edges = n.select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("id"), F.col("s").alias("src"), to.alias("dst"), local_part(F.col("p")).alias("type"), literal.alias("lit"), "o")
    things = edges.select(F.col("src").alias("id")).unionAll(edges.filter("not lit").select("dst")).distinct().select("id", F.lit("Resource").alias("kind"), local_part(F.col("id")).alias("label"))
    return Graph(things.unionAll(edges.filter("lit").select(F.col("dst").alias("id"), F.lit("Literal").alias("kind"), F.col("o").alias("label"))), edges.drop("lit", "o"))


def node_properties(t: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, key, value): all properties of the given subjects by local name; the last of a key counts."""
    return t.join(ids.select(F.col("id").alias("s")).distinct(), "s", "left_semi").groupBy(F.col("s").alias("id"), local_part(F.col("p")).alias("key")).agg(F.max_by("o", F.struct("ord", "o")).alias("value"))
