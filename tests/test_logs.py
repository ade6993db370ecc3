"""Undo logs and recent lists as streaming state against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import edits
from pixelmill.streaming import logs

SCHEMA = "image_id long, seq long, action string, value string"
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    logs.state_store(spark)


def run(spark, make, folder, out, checkpoint, name, key="image_id"):
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), key)

    def keep(batch, _):
        batch.write.mode("append").parquet(out)

    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def listed(spark, out, key="image_id"):
    got = {}
    for r in logs.latest(spark.read.parquet(out), key).orderBy(key, "place").collect():
        got.setdefault(r[key], []).append((r["seq"], r["value"]))
    return got


def test_undo_survives_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), k, rng.choices(["edit", "undo", "clear"], [12, 4, 0.3])[0], f"v{k}") for k in range(300)]
    want = {}
    for i, seq, action, value in rows:
        log = want.setdefault(i, [])
        if action == "edit":
            want[i] = [(seq, value), *log][:10]
        else:
            want[i] = log[1:] if action == "undo" else []
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for half in (rows[:130], rows[130:]):
        for part in (half[:60], half[60:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            run(spark, logs.undo_stream, folder, out, checkpoint, "undo")  # a new query each time, on the old state
    assert listed(spark, out) == {i: log for i, log in want.items() if log}


def test_streams_equal_the_batch_queries(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("value"))
    log = edits.undo_log(events, "image_id", ["ts", "seq"], "place").collect()
    folder, out, recent_out = (str(tmp_path / n) for n in ("in", "out", "recent"))
    ordered = events.orderBy("ts", "seq").select("image_id", "seq", "value").collect()
    for k in range(0, len(ordered), 400):
        part = spark.createDataFrame([(r["image_id"], k + j, "edit", f"{r['seq']}") for j, r in enumerate(ordered[k : k + 400])], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
    run(spark, logs.undo_stream, folder, out, str(tmp_path / "c1"), "undo")
    want = {}
    for r in sorted(log, key=lambda r: r["place"]):
        want.setdefault(r["image_id"], []).append(str(r["seq"]))
    assert {i: [v for _, v in entries] for i, entries in listed(spark, out).items()} == want

    # The ten users seen last, all under one key.
    whole = lambda stream, key: logs.recent_stream(stream.select(F.lit(0).cast("long").alias(key), "seq", F.lit("use").alias("action"), F.col("image_id").alias("value")), key)
    run(spark, whole, folder, recent_out, str(tmp_path / "c2"), "recent")
    top = [str(r["image_id"]) for r in edits.recent(events, "image_id", ["ts", "seq"]).collect()]
    assert [v for _, v in listed(spark, recent_out)[0]] == top


def test_a_trigger_told_twice_changes_nothing(spark):
    schema = "image_id long, version long, place long, seq long, value string"
    table = spark.createDataFrame([(1, 1, 1, 5, "a"), (2, 4, 1, 6, "b"), (2, 4, 2, 3, "c")], schema)
    batch = spark.createDataFrame([(1, 2, 1, 9, "x"), (1, 2, 2, 5, "a"), (3, 1, 0, None, None)], schema)
    once = logs.replaced(table, batch, "image_id")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in logs.replaced(once, batch, "image_id").collect()} and once.count() == 5
    assert {r["image_id"] for r in logs.latest(once, "image_id").collect()} == {1, 2}


def test_idle_keys_are_forgotten(spark, tmp_path):
    folder, checkpoint, told = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    spark.createDataFrame([(1, 0, "edit", "v"), (1, 1, "edit", "w")], SCHEMA).coalesce(1).write.parquet(folder)
    stream = logs.undo_stream(spark.readStream.schema(SCHEMA).parquet(folder), idle=0.5)
    query = stream.writeStream.foreachBatch(lambda batch, _: told.extend(map(tuple, batch.collect()))).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and (1, 2, 0, None, None) not in told:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(told, key=str) == [(1, 1, 1, 1, "w"), (1, 1, 2, 0, "v"), (1, 2, 0, None, None)]
