"""Undo and redo: a log of changes by version, read backwards or forwards, with no copies of a graph.

The log has one row for each element that a version changed, with the element before and after
it. Undoing a version puts the elements before it in place, redoing it the ones after it; both
touch only that version's ids. Recording a new version forgets the ones that were undone, and
versions further back than ``depth`` can't be undone any more and leave the log.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph

_LOG = ("nodes", "edges")


@dataclass(frozen=True)
class History:
    """``at`` versions are in force; those up to ``floor`` can't be undone, those up to ``top`` can be redone."""

    nodes: DataFrame
    edges: DataFrame
    depth: int = 50
    at: int = 0
    top: int = 0
    floor: int = 0

    @property
    def undo_count(self) -> int:
        return self.at - self.floor

    @property
    def redo_count(self) -> int:
        return self.top - self.at


def _packed(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", F.struct(*df.columns).alias(name))


def _changed(before: DataFrame, after: DataFrame, version: int) -> DataFrame:
    """(version, id, old, new) of the rows that differ; ids are unique."""
    both = _packed(before, "old").join(_packed(after.select(*before.columns), "new"), "id", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.lit(version).alias("version"), "id", "old", "new")


def _restored(rows: DataFrame, log: DataFrame, side: str) -> DataFrame:
    kept = rows.join(log.select("id"), "id", "left_anti").select(*rows.columns)
    return kept.unionByName(log.filter(F.col(side).isNotNull()).select(f"{side}.*"))


def begun(graph: Graph, depth: int = 50) -> History:
    """A history without versions for graphs with the columns of this one."""
    return History(*(_changed(df.limit(0), df.limit(0), 0) for df in (graph.nodes, graph.edges)), depth=depth)


def recorded(history: History, before: Graph, after: Graph) -> History:
    """The history with one more version; what had been undone is forgotten."""
    version = history.at + 1
    floor = max(history.floor, version - history.depth)
    keep = F.col("version").between(floor + 1, history.at)
    logs = {name: getattr(history, name).filter(keep).unionByName(_changed(getattr(before, name), getattr(after, name), version)) for name in _LOG}
    return replace(history, **logs, at=version, top=version, floor=floor)


def undone(history: History, graph: Graph) -> tuple[History, Graph] | None:
    """The graph before the last version in force, or None if there is none to undo."""
    if not history.undo_count:
        return None
    parts = (_restored(getattr(graph, n), getattr(history, n).filter(F.col("version") == history.at), "old") for n in _LOG)
    return replace(history, at=history.at - 1), Graph(*parts)


def redone(history: History, graph: Graph) -> tuple[History, Graph] | None:
    """The graph after the first undone version, or None if there is none."""
    if not history.redo_count:
        return None
    parts = (_restored(getattr(graph, n), getattr(history, n).filter(F.col("version") == history.at + 1), "new") for n in _LOG)
    return replace(history, at=history.at + 1), Graph(*parts)


def cleared(history: History) -> History:
    """The history with nothing to undo or redo."""
    return replace(history, **{n: getattr(history, n).limit(0) for n in _LOG}, floor=history.at, top=history.at)
