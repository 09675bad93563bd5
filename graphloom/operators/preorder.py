"""Depth-first order of trees by an Euler tour and list ranking.

The tour goes down to each node and up from it again: from a node to its first child or back,
from a last child to its parent, from each other child to its next sibling. A node's place is
the number of ways down up to its own. A tour that one task holds is ranked there, by jumps that
double with each round, so a path of any depth takes as many rounds as its length has binary
digits. A longer one is cut into ranges of ways, and each task ranks those of a range as far as
they stay in it, so siblings without children fold into one; only ways that another range leads to
are left. If these are still too many, each round drops about a quarter of them and all rounds
together cost a few times the first; they are put back in the opposite order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.session import number_rows, released, stored

#: A tour of so many ways is ranked in one task; a longer one is shortened first.
ONE_TASK = 4_000_000
#: Ways of a range that is folded by itself.
RANGE = 400_000


def _tour(tree: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes numbered with siblings side by side, and the tour's ways (x, next): 2v leads down to v, 2v + 1 up from it."""
    v = stored(number_rows(tree.select("id", "parent", *order), "parent", *order, "id", name="v"))
    up = v.select(F.col("id").alias("parent"), F.col("v").alias("p"))
    nodes = v.join(up, "parent", "left").select("v", "p", "parent")
    # roots are siblings; a parent that isn't in the tree counts as none
    held = F.coalesce("p", F.lit(-1))
    nodes = stored(nodes.withColumn("p", held))
    first = nodes.filter("p >= 0").groupBy(F.col("p").alias("v")).agg(F.min("v").alias("child"))
    # siblings have consecutive numbers, so the next one is found by an equi-join
    after = nodes.select((F.col("v") - 1).alias("v"), F.col("v").alias("sibling"), F.col("p").alias("same"))
    linked = nodes.join(first, "v", "left").join(after, "v", "left")
    sibling = F.when(F.col("same") == F.col("p"), 2 * F.col("sibling"))
    down = F.struct((2 * F.col("v")).alias("x"), F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("next"))
    back = F.struct((2 * F.col("v") + 1).alias("x"), F.coalesce(sibling, F.when(F.col("p") >= 0, 2 * F.col("p") + 1)).alias("next"))
    ways = stored(linked.select(F.explode(F.array(down, back)).alias("w")).select("w.*"))
    released(nodes)
    return v, ways


def _in_one_task(table: pa.Table) -> pa.Table:
    """(x, next, rest, entry): ways down from each way on to the first that isn't in the table, which is next; entry if no way of the table leads to it."""
    x = table["x"].to_numpy()
    order = np.argsort(x)
    x, rest = x[order], np.append(table["rest"].to_numpy()[order], 0)
    after = table["next"].combine_chunks().take(pa.array(order))
    ends, to = after.is_null().to_numpy(zero_copy_only=False), after.fill_null(-1).to_numpy()
    last = len(x)
    at = np.minimum(np.searchsorted(x, to), last - 1)
    here = ~ends & (x[at] == to)
    jump = np.append(np.where(here, at, last), last)
    entry = np.ones(last, bool)
    entry[at[here]] = False
    # the last way of each that stays in the table
    stays = np.append(np.where(here, at, np.arange(last)), last)
    while (jump != last).any():
        rest, jump, stays = rest + rest[jump], jump[jump], stays[stays]
    leaves = stays[:-1]
    return pa.table({"x": x, "next": pa.array(to[leaves], mask=ends[leaves]), "rest": rest[:-1], "entry": entry})


_FOLDED = "x long, next long, rest long, entry boolean"


def _thinned(now: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Ways without about a quarter of them, which the ways before them leap over, and those left out."""
    def keeps(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0

    before = now.filter(keeps("x") & ~keeps("next")).select(F.col("next").alias("x"), F.col("x").alias("before"))
    # a way has one way before it at most
    met = stored(now.join(before, "x", "left"))
    out = met.filter("before is not null")
    leaps = out.select(F.col("before").alias("x"), F.col("next").alias("further"), F.col("rest").alias("more"), F.lit(True).alias("leaps"))
    kept = met.filter("before is null").join(leaps, "x", "left")
    kept = stored(kept.select("x", F.when(F.col("leaps"), F.col("further")).otherwise(F.col("next")).alias("next"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")))
    out = stored(out.select("x", "next", "rest"))
    released(met)
    return kept, out


def _onward(ways: DataFrame, ranked: DataFrame) -> DataFrame:
    """(x, rest) of ways whose next ones are ranked."""
    further = ranked.select(F.col("x").alias("next"), F.col("rest").alias("more"))
    return ways.join(further, "next", "left").select("x", (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest"))


def _ranked(ways: DataFrame, one_task: int, wide: int) -> DataFrame:
    """(x, rest): ways down from each way on to the end of its tour; of the ways down alone."""
    ways = ways.select("x", "next", (F.col("x") % 2 == 0).cast("long").alias("rest"))
    if ways.count() <= one_task:
        return stored(ways.groupBy(F.lit(0).alias("all")).applyInArrow(_in_one_task, _FOLDED).filter("x % 2 = 0").select("x", "rest"))
    folded = ways.groupBy(F.floor(F.col("x") / wide).alias("range")).applyInArrow(_in_one_task, _FOLDED)
    folded = stored(folded.filter("entry or x % 2 = 0"))
    now, left_out = stored(folded.filter("entry").select("x", "next", "rest")), []
    while now.count() > one_task and not now.filter("next is not null").isEmpty():
        (now, out), old = _thinned(now, len(left_out)), now
        left_out.append(out)
        released(old)
    if now.count() <= one_task:
        now, old = stored(now.groupBy(F.lit(0).alias("all")).applyInArrow(_in_one_task, _FOLDED).select("x", "rest")), now
        released(old)
    for out in reversed(left_out):
        now, old = stored(now.select("x", "rest").unionByName(_onward(out, now))), now
        released(old, out)
    out = stored(_onward(folded.filter("x % 2 = 0"), now))
    released(folded, now)
    return out


def preorder(tree: DataFrame, order: list[str] | None = None, *, one_task: int = ONE_TASK, wide: int = RANGE) -> DataFrame:
    """(id, place) of the nodes of ``tree(id, parent, ...)``, roots having a null parent; siblings go by ``order``, then id.

    Places start at 0; ids are unique and parents don't go round. An empty tree gives no rows.
    """
    v, ways = _tour(tree, order or [])
    rest = _ranked(ways, one_task, wide)
    n = v.count()
    out = stored(rest.select((F.col("x") / 2).cast("long").alias("v"), (F.lit(n) - F.col("rest")).alias("place")).join(v, "v").select("id", "place"))
    released(v, ways, rest)
    return out
