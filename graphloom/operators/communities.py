"""Communities by modularity, and a planted-partition graph to try them on.

Links get 64-bit hashes of their ends, under a seed that gives no two nodes the same one, and lie
in buckets by their first ends. As long as there are more links than one task may hold, rounds of
contraction halve the graph: every node weighs its links by the gain in modularity of joining
the two ends, which is its pick. Nodes that nothing picks all join their picks in one round; what
else there is, a hash deals into heads and tails, and a tail joins its pick if that is a head. A
round is a grouped minimum and two equi-joins of the links, which are shuffled twice: to their
second ends and to where these go. No hub is gathered, and each round leaves fewer links. The
small graph that remains is finished in one task, by moving single nodes while modularity rises,
and the same again with the communities as nodes. If there were rounds of contraction, nodes of
the whole graph are then moved once more where that raises modularity. No number of rounds is
fixed: each part ends when nothing improves.

Defined cases: a node without links is a community of its own, loops count in a node's weight
only, parallel links add up, ties go to the least hash, and an empty graph gives no rows. An
edge to a missing node doesn't count, unless that id shares its hash with a node's (less than one
in 10^10 such ids with 100 million nodes).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph
from graphloom.plans.session import number_rows, released, stored, stored_by

#: Links (each from both ends) that one task may hold.
ONE_TASK = 4_000_000
_EPS = 1e-9
#: Modularity that a round of moves has to bring.
_LEAST = 1e-4
#: Nodes in one bucket of links.
_NODES_A_PART = 100_000


def _links(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, w): each undirected link from both ends, dealt by the first one if ``parts`` is given; a loop once, with twice its weight."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = edges.select(F.explode(ends).alias("x")).select("x.a", "x.b")
    return (both.repartition(parts, "a") if parts else both).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _modularity(links: DataFrame, of: DataFrame) -> float:
    """Share of weight inside communities less the share expected from the nodes' weights."""
    named = links.join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    per = named.groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("k").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return row["inside"] / row["all"] - row["squares"] / row["all"] ** 2 if row["all"] else 0.0


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Modularity of (id, community) on undirected edges; parallel edges add up."""
    return _modularity(_links(edges), membership.select("id", F.col("community").alias("c")))


def _sweeps(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: list[float], total: float) -> list[int]:
    """Each node's community: single nodes move to the neighbouring community of greatest gain until none improves.

    After the first sweep only nodes beside a move are looked at, until they rest; the last sweep is over all.
    """
    order = np.argsort(a, kind="stable")
    ends = np.searchsorted(a[order], np.arange(len(k) + 1)).tolist()
    to, weight = b[order].tolist(), w[order].tolist()
    of, sums, waiting = list(range(len(k))), list(k), range(len(k))
    while True:
        beside = bytearray(len(k))
        moved = False
        for v in waiting:
            links = to[ends[v] : ends[v + 1]]
            toward: dict[int, float] = defaultdict(float)
            for u, x in zip(links, weight[ends[v] : ends[v + 1]], strict=True):
                toward[of[u]] += x
            own = of[v]
            sums[own] -= k[v]
            best, most = own, toward.get(own, 0.0) - k[v] * sums[own] / total
            for c, x in toward.items():
                gain = x - k[v] * sums[c] / total
                if gain > most + _EPS or (gain > most - _EPS and c < best and best != own):
                    best, most = c, gain
            sums[best] += k[v]
            if best != own:
                of[v], moved = best, True
                for u in links:
                    beside[u] = 1
        if moved:
            waiting = np.flatnonzero(np.frombuffer(beside, np.uint8)).tolist()
        elif len(waiting) == len(k):
            return of
        else:
            waiting = range(len(k))


def _finished(table: pa.Table, total: float) -> pa.Table:
    """(v, c) of a graph that one task holds: sweeps, then sweeps over the communities, until nothing merges."""
    ids, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    a, b, w = at[: table.num_rows], at[table.num_rows :], table["w"].to_numpy()
    k = np.zeros(len(ids))
    k[a] = table["ka"].to_numpy()
    # heavy nodes are looked at first
    order = np.lexsort((ids, -k))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, k, a, b = ids[order], k[order], place[a], place[b]
    c = np.arange(len(ids))
    while True:
        names, of = np.unique(_sweeps(a, b, w, k.tolist(), total), return_inverse=True)
        if len(names) == len(k):
            break
        c, k = of[c], np.bincount(of, k)
        a, b = of[a], of[b]
        apart = a != b
        pairs, place = np.unique(a[apart] * len(names) + b[apart], return_inverse=True)
        a, b, w = pairs // len(names), pairs % len(names), np.bincount(place, w[apart], len(pairs))
    least = np.full(len(k), np.iinfo(np.int64).max)
    np.minimum.at(least, c, ids)
    return pa.table({"v": ids, "c": least[c]})


def _contracted(e: DataFrame, total: float, turn: int, parts: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(v, to) of a round's moves and the links between what is left, in ``parts`` buckets; None if no pair would gain by joining.

    ``e`` has each link from both ends with the ends' weights: a, ka, b, kb, w.
    """
    parts = parts or _parts(e.sparkSession)
    gain = F.col("w") - F.col("ka") * F.col("kb") / total
    # all nodes, also those that pick none
    best = F.min(F.when(F.col("gain") > _EPS, F.struct(_rank(F.col("gain")).alias("rank"), "b")))
    every = stored_by(e.withColumn("gain", gain).groupBy("a", "ka").agg(best["b"].alias("to")), "a", parts)
    picks = every.filter("to is not null").select("a", "to")
    if picks.isEmpty():
        released(every)
        return None

    def dealt(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0

    # what a node picks that nothing picks stays, and all that pick it join it
    ends = stored(picks.join(picks.select(F.col("to").alias("a")).distinct().hint("shuffle_hash"), "a", "left_anti").select("to").distinct())
    met = picks.join(ends.withColumnRenamed("to", "a").hint("shuffle_hash"), "a", "left_anti").join(ends.withColumn("stays", F.lit(True)).hint("shuffle_hash"), "to", "left")
    # dealt out are only those that neither stay nor join what stays
    met = stored(met.select("a", "to", "stays"))
    rest = met.filter("stays is null")
    pairs = rest.filter(~dealt("a") & dealt("to")).join(rest.select(F.col("a").alias("to")), "to", "left_semi")
    moves = stored(met.filter("stays").select("a", "to").unionByName(pairs.select("a", "to")).withColumnRenamed("a", "v"))
    # where each end goes and what it weighs there
    placed = every.select(F.col("a").alias("v"), "ka").join(moves.hint("shuffle_hash"), "v", "left").select("v", F.coalesce("to", "v").alias("to"), "ka")
    places = stored_by(placed.join(placed.groupBy("to").agg(F.sum("ka").alias("k")).hint("shuffle_hash"), "to").select("v", "to", "k").repartition(parts, "v"), "v", parts)
    released(every, ends, met)
    # links go to their other ends and from there to where these go
    first, second = (places.select(F.col("v").alias(x), F.col("to").alias(f"t{x}"), F.col("k").alias(f"n{x}")).hint("shuffle_hash") for x in "ab")
    left = e.join(first, "a").select("b", "ta", "na", "w").repartition(parts, "b").join(second, "b").filter("ta != tb")
    left = left.select(F.col("tb").alias("a"), F.col("nb").alias("ka"), F.col("ta").alias("b"), F.col("na").alias("kb"), "w").repartition(parts, "a")
    left = stored_by(left.groupBy("a", "ka", "b", "kb").agg(F.sum("w").alias("w")), "a", parts)
    released(places)
    return moves, left


def _rank(gain: Column) -> Column:
    """Less for greater gains, and the same for those that differ by rounding alone."""
    return -F.rint(gain * 1e9)


def _parts(spark: SparkSession, nodes: int = 0) -> int:
    """Buckets of links, by their first ends."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes // _NODES_A_PART)


def _choices(e: DataFrame, of: DataFrame, k: DataFrame, total: float, parts: int) -> DataFrame:
    """(v, k, c, to, better, inside, out) of all nodes with links: the community around a node with the greatest gain over its own, if there is any, and its weight of links in its own and at all."""
    held = of.join(k, "v")
    held = stored(held.join(held.groupBy("c").agg(F.sum("k").alias("sum")), "c"))
    ends = held.select(F.col("v").alias("a"), F.col("c").alias("to"), F.col("sum").alias("there"))
    around = e.join(ends.hint("shuffle_hash"), "a").select("b", "to", "there", "w").repartition(parts, "b").groupBy("b", "to", "there").agg(F.sum("w").alias("w"))
    seen = around.join(held.withColumnRenamed("v", "b").hint("shuffle_hash"), "b")
    own = F.col("to") == F.col("c")
    gain = F.col("w") - F.col("k") * F.col("there") / total
    best = F.min(F.when(~own, F.struct(_rank(gain).alias("rank"), "to", gain.alias("gain"))))
    seen = seen.groupBy("b", "k", "c", "sum").agg(best.alias("best"), F.sum(F.when(own, F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("out"))
    better = F.col("best.gain") - (F.col("inside") - F.col("k") * (F.col("sum") - F.col("k")) / total)
    # staying wins ties
    seen = seen.withColumn("better", better).withColumn("to", F.when(F.col("better") > _EPS, F.col("best.to")))
    out = stored(seen.select(F.col("b").alias("v"), "k", "c", "to", "better", "inside", "out"))
    released(held)
    return out


def _quality(choices: DataFrame, total: float) -> float:
    """Modularity of the communities that ``choices`` were made from; what a node weighs beyond its links is loops."""
    per = choices.groupBy("c").agg(F.sum("k").alias("k"), F.sum(F.col("inside") + F.col("k") - F.col("out")).alias("inside"))
    row = per.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return (row["inside"] or 0.0) / total - (row["squares"] or 0.0) / total**2


def _hashed(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(id, v) with a 64-bit hash for each id, and the seed under which no two of them share one."""
    seed = 0
    while True:
        ids = stored(nodes.select("id").distinct().withColumn("v", F.xxhash64("id", F.lit(seed))))
        if ids.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return ids, seed
        released(ids)
        seed += 1


def communities(nodes: DataFrame, edges: DataFrame, *, one_task: int = ONE_TASK) -> DataFrame:
    """(id, community), a community called by its least member."""
    ids, seed = _hashed(nodes)
    parts = _parts(nodes.sparkSession, ids.count())
    ends = edges.filter("src is not null and dst is not null").select(*(F.xxhash64(x, F.lit(seed)).alias(x) for x in ("src", "dst")))
    every = stored_by(_links(ends, parts), "a", parts)
    k = stored(every.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")))
    if not k.join(ids, "v", "left_anti").isEmpty():
        # edges to missing nodes don't count
        a, b = (ids.select(F.col("v").alias(x)).hint("shuffle_hash") for x in "ab")
        there = stored_by(every.join(a, "a", "left_semi").repartition(parts, "b").join(b, "b", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"), "a", parts)
        released(every, k)
        every, k = there, stored(there.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")))
    total = k.agg(F.sum("k")).first()[0] or 0.0
    first, second = (k.select(F.col("v").alias(x), F.col("k").alias(f"k{x}")).hint("shuffle_hash") for x in "ab")
    # every link is there from both ends, so what comes to lie by its second end may as well be called by it
    whole = every.filter("a != b").join(first, "a").repartition(parts, "b").join(second, "b")
    whole = e = stored_by(whole.select(F.col("b").alias("a"), F.col("kb").alias("ka"), F.col("a").alias("b"), F.col("ka").alias("kb"), "w"), "a", parts)
    released(every)
    of = stored(ids.select("v", F.col("v").alias("c")))
    turn = 0
    while (n := e.count()) > one_task and (step := _contracted(e, total, turn, parts)):
        moves, left = step
        of, old = stored(of.join(moves.select(F.col("v").alias("c"), "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c"))), of
        released(old, moves)
        if e is not whole:
            released(e)
        e, turn = left, turn + 1
    if n <= one_task:
        done = e.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _finished(t, total), "v long, c long")
        done = done.select(F.col("v").alias("c"), F.col("c").alias("to"))
        of, old = stored(of.join(done, "c", "left").select("v", F.coalesce("to", "c").alias("c"))), of
        released(old)
    if e is not whole:
        released(e)
        of = _refined(whole, of, k, total, parts)
    released(whole, k)
    named = of.join(ids, "v")
    out = stored(named.join(named.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community"))
    released(of, ids)
    return out


def _refined(e: DataFrame, of: DataFrame, k: DataFrame, total: float, parts: int) -> DataFrame:
    """Memberships after rounds of moves over the whole graph, each of a half of the nodes dealt by hash, as long as two in a row bring something."""
    choices = _choices(e, of, k, total, parts)
    best, turn, idle = _quality(choices, total), 0, 0
    while idle < 2:
        mine = choices.filter(F.col("to").isNotNull() & (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0))
        idle, turn = idle + 1, turn + 1
        # where moves promise too little one by one, they aren't tried
        if 2 * (mine.agg(F.sum("better")).first()[0] or 0.0) / total <= _LEAST:
            continue
        tried = stored(of.join(mine.select("v", "to"), "v", "left").select("v", F.coalesce("to", "c").alias("c")))
        again = _choices(e, tried, k, total, parts)
        q = _quality(again, total)
        if q > best + _LEAST:
            released(of, choices)
            of, choices, best, idle = tried, again, q, 0
        else:
            released(tried, again)
    released(choices)
    return of


def numbered(membership: DataFrame) -> DataFrame:
    """(id, cluster): communities as c0, c1, ..., the largest first, then by least member."""
    sizes = number_rows(membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")), F.desc("size"), "community")
    return membership.join(sizes.select("community", F.concat(F.lit("c"), (F.col("n") - 1).cast("string")).alias("cluster")), "community").select("id", "cluster")


def planted(spark: SparkSession, groups: int = 40, members: int = 200, inside: int = 6, outside: int = 1, seed: int = 42) -> Graph:
    """Equal groups; each node starts ``inside`` edges within its group and ``outside`` to any node, all drawn by hash."""
    n = groups * members
    nodes = spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.array(F.lit("Item")).alias("types"), F.col("id").alias("ord"), F.concat(F.lit("g"), F.floor(F.col("id") / members).cast("string")).alias("group"))
    draws = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(inside + outside - 1))).alias("k"))
    drawn = F.xxhash64("id", "k", F.lit(seed))
    near = F.floor(F.col("id") / members) * members + F.pmod(drawn, F.lit(members))
    to = F.when(F.col("k") < inside, near).otherwise(F.pmod(drawn, F.lit(n)))
    edges = draws.select("id", "k", to.alias("to")).filter("id != to")
    return Graph(nodes, edges.select(F.concat_ws("-", F.lit("e"), "id", "k").alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("to").cast("string")).alias("dst"), F.lit("linked").alias("type")))
