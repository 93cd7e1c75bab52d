"""Streams with state against tables and plain folds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import clusters
from tarnwell.streaming import state, windows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKS)
    yield
    spark.conf.set(key, before)


def run(frame, folder):
    query = windows.stream_to_table(frame, "s", f"{folder}/out", f"{folder}/state")
    assert query.awaitTermination(240) and query.exception() is None


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_clusters_go_on_after_a_restart(spark, rocks, tmp_path):
    draw = random.Random(1)
    schema = "g string, i long, x double, y double"
    rows = [(draw.choice("ab"), i, draw.choice([0.0, 50.0, 200.0]) + draw.random(), draw.choice([None, 1.0])) for i in range(90)]
    named = lambda n: f"cluster {n}"
    for part in (rows[:40], rows[40:60], rows[60:]):  # each run ends, and the next starts from its checkpoint
        put(spark, tmp_path, part, schema)
        run(state.clustered(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "g", "i", ["x", "y"], name=named), tmp_path)
    got = {(r["g"], r["i"]): r["cluster_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for g in "ab":
        known = []
        for _, i, x, y in (r for r in rows if r[0] == g):
            want[g, i] = clusters.match_or_create(known, {"x": x} | ({"y": y} if y is not None else {}), name=named).cluster_id
    assert got == want and len(set(got.values())) > 2
    table = {(r["g"], r["i"]): r["cluster_id"] for r in state.clustered(spark.createDataFrame(rows, schema), "g", "i", ["x", "y"], name=named).collect()}
    assert table == want


def test_clusters_that_take_no_row_are_forgotten(spark, rocks, tmp_path):
    schema = "g string, i long, x double"
    got = {}
    for i in (1, 2):  # such a stream goes on until it is stopped
        put(spark, tmp_path, [("a", i, 1.0)], schema)
        frame = state.clustered(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "g", "i", ["x"], live=1)
        query = frame.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        ends = time.time() + 90
        while len(got) < i and time.time() < ends and query.exception() is None:
            time.sleep(1)
            files = list((tmp_path / "out").glob("*.parquet"))
            got = {r["i"]: r["cluster_id"] for r in spark.read.schema("g string, i long, cluster_id string").parquet(*map(str, files)).collect()} if files else {}
        query.stop()
        time.sleep(1.5)
    assert got == {1: "FC-001", 2: "FC-002"}


def test_stream_join_leaves_late_rows_out(spark, tmp_path):
    at = 1_700_000_000
    left = [(i, i % 3, at + 600 * i) for i in range(40)]
    right = [(100 + i, i % 3, at + 600 * i + 300) for i in range(40)]
    names = ("id long, k int, a long", "other long, k int, b long")
    timed = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    for side, rows, late in (("l", left, (999, 1, at)), ("r", right, (998, 1, at + 300))):
        put(spark, f"{tmp_path}/{side}", rows, names[side == "r"])
        put(spark, f"{tmp_path}/{side}late", [late], names[side == "r"])

    def read(side):
        return spark.readStream.schema(names[side == "r"]).parquet(f"{tmp_path}/{side}/in")

    frame = lambda: windows.joined(timed(read("l"), "a"), timed(read("r"), "b"), ["k"], "a", "b", "30 minutes")
    run(frame(), tmp_path)
    for side in "lr":  # rows of the beginning, now beyond the watermark
        spark.read.parquet(f"{tmp_path}/{side}late/in").write.mode("append").parquet(f"{tmp_path}/{side}/in")
    run(frame(), tmp_path)
    got = {(r["id"], r["other"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = windows.joined(timed(spark.createDataFrame(left, names[0]), "a"), timed(spark.createDataFrame(right, names[1]), "b"), ["k"], "a", "b", "30 minutes")
    want = {(i, j) for i, k, a in left for j, h, b in right if k == h and a <= b <= a + 1800}
    assert got == want == {(r["id"], r["other"]) for r in table.collect()}


def test_repeats_within_the_watermark(spark, tmp_path):
    at = 1_700_000_000
    rows = [(i % 10, at + i) for i in range(40)]
    schema = "id int, s long"
    put(spark, tmp_path, rows[:20], schema)
    stream = lambda: windows.distinct_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s")), ["id"], "ts")
    run(stream(), tmp_path)
    put(spark, tmp_path, rows[20:], schema)
    run(stream(), tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 10 == windows.distinct_events(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")), ["id"], "ts").count()
