"""Streams of trace events: written once across restarts, and the same end as the batch queries, whatever the order of arrival."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.streaming import traces
from corpusflow.streaming.traces import EVENT, machine_stream, read_traces, stage_results, stage_results_stream, trace_sink

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark, folder, batches, schema):
    """One file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_sink_writes_each_event_once(spark, tmp_path, monkeypatch):
    make = lambda run, i, **kw: tuple(({"run": run, "elapsed_seconds": float(i), "stage": "model", "action": "request", "result": "é<", "details": '{"n": [1, 2]}', "prompt_tokens": None, "completion_tokens": 5} | kw).values())
    batches = [[make(f"r{i % 3}", 10 * b + i) for i in range(9)] for b in range(4)]
    batches[2] += [make("r0", -1), make("r0", 50, stage=""), make("r0", 51, prompt_tokens=-2), make("r0", 52, details="[1]"), make("r1", 53, details=None), make("r1", 54, result=None)]
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = files(spark, folder, batches, EVENT)
    lines, calls = traces.event_lines, []

    def failing(events):
        calls.append(1)
        if len(calls) == 3:
            # what a lost driver leaves: lines of the batch that will be made again
            lines(events).select("run", "value").write.partitionBy("run").text(f"{out}/events/batch=2")
            raise RuntimeError("lost")
        return lines(events)

    monkeypatch.setattr(traces, "event_lines", failing)
    with pytest.raises(Exception, match="lost"):
        trace_sink(stream, out, checkpoint).awaitTermination()
    trace_sink(files(spark, folder, [], EVENT), out, checkpoint).awaitTermination()
    trace_sink(files(spark, folder, [], EVENT), out, checkpoint).awaitTermination()  # nothing new
    got = read_traces(spark, out)
    want = sorted((r[0], r[1]) for b in batches for r in b if r[1] >= 0 and r[2] and r[4] and r[5] != "[1]" and (r[6] or 0) >= 0)
    assert sorted((r["run"], r["elapsed_seconds"]) for r in got.collect()) == want and len(want) == 37
    first = got.filter("run = 'r1' and elapsed_seconds = 1").first()
    assert json.loads(first["details"]) == {"n": [1, 2]} and first["result"] == "é<" and first["prompt_tokens"] is None and first["completion_tokens"] == 5
    assert "\\u00E9" in spark.read.text(f"{out}/events/batch=0").filter("value like '%model%'").first()["value"].replace("\\u00e9", "\\u00E9")
    assert {r["fault"]: r["n"] for r in spark.read.json(f"{out}/rejected").groupBy("fault").agg(F.count("*").alias("n")).collect()} == {"elapsed_seconds": 1, "required": 2, "tokens": 1, "details": 1}
    assert read_traces(spark, str(tmp_path / "none")).count() == 0


def arrivals(seed: int, n: int, column: str):
    """Events of six keys in four batches, out of order across batches by up to an hour."""
    draw = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(f"k{draw.randrange(6)}", start + timedelta(minutes=i), i, draw.choice(["click", "error", "view", "purchase"])) for i in range(n)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=draw.randrange(30)))
    return [rows[i * n // 4 : (i + 1) * n // 4] for i in range(4)], f"key string, at timestamp, id long, {column} string"


def run(spark, frame, name: str, mode: str):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.table(name)


def test_last_results_of_a_stream_equal_the_batch(spark, tmp_path):
    batches, schema = arrivals(3, 200, "result")
    stage = lambda df: df.withColumn("stage", F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).withColumnRenamed("key", "run")
    told = run(spark, stage_results_stream(stage(files(spark, tmp_path / "in", batches, schema))), "last_results", "update")
    every = stage(spark.createDataFrame([r for b in batches for r in b], schema))
    want = {tuple(r) for r in stage_results(every, "run", "stage", "result", ["at", "id"]).collect()}
    end = told.groupBy("run", "stage").agg(F.max_by(F.struct("n", "result"), "n").alias("x")).select("run", "stage", "x.*")
    assert {tuple(r) for r in end.collect()} == want and not told.filter("closed").count()


def test_an_idle_run_is_closed_once(spark, tmp_path):
    batches, schema = arrivals(3, 80, "result")
    batches += [[("z", datetime(2024, 1, 9), 900, "view")], [("z", datetime(2024, 1, 20), 901, "click")], [("z", datetime(2024, 1, 21), 902, "click")]]
    rename = lambda df: df.withColumn("stage", F.lit("s")).withColumnRenamed("key", "run")
    told = run(spark, stage_results_stream(rename(files(spark, tmp_path / "in", batches, schema))), "closed_runs", "update").filter("closed and run != 'z'")
    every = rename(spark.createDataFrame([r for b in batches for r in b], schema)).filter("run != 'z'")
    want = {tuple(r) for r in stage_results(every, "run", "stage", "result", ["at", "id"]).collect()}
    got = [tuple(r) for r in told.select("run", "stage", "n", "result").collect()]
    assert set(got) == want and len(got) == len(want)


def test_machine_on_a_stream_follows_time(spark, tmp_path):
    batches, schema = arrivals(5, 120, "event")
    batches += [[("z", datetime(2024, 2, 1), 900, "view")], [("z", datetime(2024, 3, 1), 901, "view")]]
    moves = [("idle", "active", ["click", "view"]), ("active", "failed", ["error"]), ("active", "bought", ["purchase"]), ("failed", "active", ["click"])]
    told = run(spark, machine_stream(files(spark, tmp_path / "in", batches, schema), "idle", moves), "machine_states", "append")
    table = {(a, e): b for a, b, kinds in moves for e in kinds}
    want, now = set(), {}
    for key, at, i, event in sorted((r for b in batches[:4] for r in b), key=lambda r: (r[1], r[2])):
        now[key] = table.get((now.get(key, "idle"), event), now.get(key, "idle"))
        want.add((key, at, i, now[key]))
    got = [tuple(r) for r in told.filter("key != 'z'").collect()]
    assert set(got) == want and len(got) == len(want)
