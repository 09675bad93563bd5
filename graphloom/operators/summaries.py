"""A registry of summaries: what each makes of a graph, and how a selection in it leads back to ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import aggregates
from graphloom.plans.graph import Graph, primary_type


@dataclass(frozen=True)
class Summary:
    """``rows`` gives (label, n), ``members`` (label, id); both see the whole graph."""

    id: str
    name: str
    rows: Callable[[Graph], DataFrame]
    members: Callable[[Graph], DataFrame]

    def selected(self, graph: Graph, labels: list[str]) -> DataFrame:
        """(id): what stands behind some labels."""
        return self.members(graph).filter(F.col("label").isin(labels)).select("id").distinct()


def of_key(id_: str, name: str, part: Callable[[Graph], DataFrame], key: Callable[[], Column]) -> Summary:
    """Counts by a key of the nodes or edges, which ``part`` takes from the graph."""
    return Summary(id_, name, lambda g: aggregates.count_by(part(g), key()), lambda g: aggregates.members(part(g), key()))


class Registry:
    """Summaries by id; registering an id again replaces it."""

    def __init__(self, *summaries: Summary) -> None:
        self._known = {s.id: s for s in summaries}

    def register(self, summary: Summary) -> None:
        self._known[summary.id] = summary

    def get(self, id_: str) -> Summary | None:
        return self._known.get(id_)

    def remove(self, id_: str) -> bool:
        return self._known.pop(id_, None) is not None

    def list(self) -> list[Summary]:
        return [*self._known.values()]

    def run(self, graph: Graph) -> DataFrame:
        """(summary, label, n) of all registered summaries."""
        return reduce(DataFrame.unionByName, (s.rows(graph).select(F.lit(s.id).alias("summary"), "label", "n") for s in self.list()))


def standard() -> Registry:
    """Nodes by type and edges by type."""
    return Registry(
        of_key("count-by-type", "Nodes by type", lambda g: g.nodes, primary_type), of_key("edge-types", "Edges by type", lambda g: g.edges, lambda: F.col("type")),
    )
