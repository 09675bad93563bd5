"""Streams that run over files: a working set in state, two streams joined, state in buckets, summaries from changes."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates
from graphloom.plans.graph import Graph
from graphloom.streaming import changes, joins, summaries, working_set

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def _run(df, path, checkpoint, mode="append"):
    q = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def test_working_set_ages_out_but_for_pins(spark, rocks, tmp_path):
    schema, rng = "id string, seq long, op string", random.Random(4)
    arrivals = [(f"n{rng.randint(0, 60)}", k, "arrive") for k in range(150)]
    rng.shuffle(arrivals)
    arrivals += [("n1", None, "pin"), ("n2", None, "pin"), ("late", None, "pin"), ("n2", None, "unpin"), ("late", 1, "arrive"), ("never", None, "unpin")] + arrivals[:20]
    pinned = {"n1", "late"}
    # each run of the stream starts from the state of the one before
    for k in range(0, len(arrivals), 44):
        _written(spark, tmp_path / "in", arrivals[k : k + 44], schema)
        feed = working_set.working_set_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit=10, shards=3)
        feed.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start().awaitTermination(180)
    got = working_set.current(spark.read.schema(working_set.FEED).parquet(str(tmp_path / "out")), limit=10)
    last = {}
    for i, seq, op in arrivals:
        if op == "arrive":
            last[i] = max(seq, last.get(i, -1))
    batch = changes.recent(spark.createDataFrame(list(last.items()), "id string, seq long"), 10, pinned=spark.createDataFrame([(p,) for p in pinned], "id string"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.select("id", "seq").collect()} and got.count() == 12


def test_two_streams_joined_without_what_is_too_late(spark, tmp_path):
    node, edge = "id string, at timestamp, name string", "id string, src string, dst string, type string, at timestamp"

    def t(minute):
        return f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00"

    def rows(given, at):
        return [(*r[:at], t(r[at]), *r[at + 1 :]) for r in given]

    batches = [
        ([("a", 0, "A"), ("b", 5, "B")], [("e1", "a", "b", "to", 3), ("e2", "b", "a", "to", 50)]),
        # newer rows push the watermarks to 03:50
        ([("c", 240, "C")], [("e3", "c", "a", "to", 240)]),
        ([("d", 245, "D")], [("e4", "d", "a", "to", 250)]),
        # too late on either side, and in time
        ([("late", 10, "L"), ("e", 236, "E")], [("e5", "late", "a", "to", 12), ("e6", "a", "b", "to", 1), ("e7", "e", "a", "to", 262)]),
    ]
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("edges", edge), ("nodes", node)) if (tmp_path / n).mkdir() is None]
    out = joins.edges_with_nodes(*streams, within="30 minutes", late="10 minutes")
    kept_nodes, kept_edges = [], []
    for k, (n, e) in enumerate(batches):
        for name, given, at, schema, text in (("nodes", n, 1, node, "id string, at string, name string"), ("edges", e, 4, edge, "id string, src string, dst string, type string, at string")):
            df = spark.createDataFrame(rows(given, at), text).withColumn("at", F.to_timestamp("at")).coalesce(1)
            df.write.mode("append").parquet(str(tmp_path / name))
        _run(out, tmp_path / "out", tmp_path / "ck")
        kept_nodes += [r for r in n if r[0] != "late"]
        kept_edges += [r for r in e if r[0] not in ("e5", "e6")]
    batch = joins.edges_with_nodes(
        spark.createDataFrame(rows(kept_edges, 4), "id string, src string, dst string, type string, at string").withColumn("at", F.to_timestamp("at")),
        spark.createDataFrame(rows(kept_nodes, 1), "id string, at string, name string").withColumn("at", F.to_timestamp("at")), within="30 minutes", late="10 minutes", watermark=False,
    )
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [("e1", "A"), ("e3", "C"), ("e4", "D"), ("e7", "E")]


def test_state_in_buckets(spark, tmp_path):
    schema, rng = "id string, seq long, x int, op string", random.Random(2)
    base, seq, want = str(tmp_path / "out"), 0, {}
    for number in range(5):
        part = []
        for _ in range(6):
            seq += 1
            part.append((f"i{rng.randint(0, 9)}", seq, rng.randint(0, 99), rng.choice(["upsert", "upsert", "remove"])))
        for i, s, x, op in part:
            want[i] = (s, x) if op == "upsert" else None
        rng.shuffle(part)
        _written(spark, tmp_path / "in", part, schema)
        changes.apply_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "ck"), buckets=4).awaitTermination(120)
        got = changes.state_at(spark, base, spark.createDataFrame([], "id string, seq long, x int").schema, number)
        assert {r["id"]: (r["seq"], r["x"]) for r in got.collect()} == {i: v for i, v in want.items() if v}
    kept = sorted(p.name for p in (tmp_path / "out" / "places").iterdir() if p.is_dir())
    assert kept == ["v=3", "v=4"]


def _random_graph(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{k}", [rng.choice("ABC")]) for k in range(20) if rng.random() < 0.8]
    edges = [(f"e{k}", f"n{rng.randint(0, 22)}", f"n{rng.randint(0, 22)}", rng.choice("xy")) for k in range(60) if rng.random() < 0.8]
    return Graph(spark.createDataFrame(nodes, "id string, types array<string>"), spark.createDataFrame(edges, "id string, src string, dst string, type string"))


def test_summaries_from_changes(spark, tmp_path):
    graphs = [_random_graph(spark, k) for k in range(4)]
    feeds = [summaries.contents(graphs[0]), *(summaries.changes_between(a, b) for a, b in zip(graphs, graphs[1:], strict=False))]
    path, base = tmp_path / "in", str(tmp_path / "out")
    for number, (feed, g) in enumerate(zip(feeds, graphs, strict=True)):
        feed.coalesce(1).write.mode("append").parquet(str(path))
        summaries.keep_summaries(spark.readStream.schema(feed.schema).parquet(str(path)), base, str(tmp_path / "ck")).awaitTermination(120)
        now = spark.read.parquet(f"{base}/v={number}")
        full = summaries.counted(summaries.contents(g))
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, full.select(*now.columns).collect()))
        ends = aggregates.both_ends(g.edges).groupBy("id").count()
        assert {tuple(r) for r in summaries.degrees(now).collect()} == {tuple(r) for r in ends.collect()}
        assert {tuple(r) for r in summaries.type_matrix(now).collect()} == {tuple(r) for r in aggregates.type_matrix(g.edges, g.nodes).collect()}
        assert {tuple(r) for r in summaries.types(now).collect()} == {(r["label"], r["n"]) for r in aggregates.count_by_type(g.nodes).collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["v=2", "v=3"]
