"""Traces of runs as streams: a sink that writes each event once, the last result of every stage, and a state machine over events in their order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: A trace event; ``details`` is the JSON text of an object.
EVENT = "run string, elapsed_seconds double, stage string, action string, result string, details string, prompt_tokens long, completion_tokens long"


def event_fault(names: Column | None = None) -> Column:
    """What keeps a row from being an event: a negative time or count, or no stage, action or result; null if nothing does."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    counts = F.coalesce(F.col("prompt_tokens") < 0, F.lit(False)) | F.coalesce(F.col("completion_tokens") < 0, F.lit(False))
    return (
        F.when(~F.coalesce(F.col("elapsed_seconds") >= 0, F.lit(False)), "elapsed_seconds")
        .when(blank("stage") | blank("action") | blank("result"), "required")
        .when(counts, "tokens")
        .when(F.coalesce(F.schema_of_variant(F.try_parse_json("details")), F.lit("OBJECT<>")).startswith("OBJECT"), None)
        .otherwise("details")
    )


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event (``value``), with its run beside it; characters beyond ASCII are escaped, counts that are null left out."""
    details = F.coalesce(F.try_parse_json("details"), F.parse_json(F.lit("{}"))).alias("details")
    body = F.struct("elapsed_seconds", "stage", "action", "result", details, "prompt_tokens", "completion_tokens")
    return events.select("run", "elapsed_seconds", F.to_json(body, {"writeNonAsciiCharacterAsCodePoint": "true"}).alias("value"))


def trace_sink(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream of events (EVENT) below ``path`` as JSON lines by run, each event once; rows that are none go below ``path/rejected`` with their fault.

    A batch owns the folder of its number and replaces it as a whole. A batch that failed, or whose commit was lost with the driver, is made again from the offsets in
    the checkpoint under the same number, so what it had written is overwritten, never added to. A folder without its success file is not read.
    """

    def write(batch: DataFrame, number: int) -> None:
        told = batch.withColumn("fault", event_fault()).persist()
        try:
            lines = event_lines(told.filter("fault is null"))
            # a run's events stay in one file, in order
            lines.repartition("run").sortWithinPartitions("run", "elapsed_seconds").select("run", "value").write.mode("overwrite").partitionBy("run").text(f"{path}/events/batch={number}")
            told.filter("fault is not null").write.mode("overwrite").json(f"{path}/rejected/batch={number}")
        finally:
            told.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """The events of a sink, with their run and batch. Only batches that ended are read."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/events")
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in files.listStatus(top)] if files.exists(top) else []
    whole = [f.toString() for f in folders if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    fields = EVENT.removeprefix("run string, ")
    if not whole:
        return spark.createDataFrame([], f"{EVENT}, batch long")
    # details are kept as they are: a schema of string takes an object's text
    rows = spark.read.option("basePath", f"{path}/events").schema(f"{fields}, batch long, run string").json(whole)
    return rows.select(*[x.split()[0] for x in EVENT.split(", ")], "batch")


def stage_results(events: DataFrame, run: str, stage: str, result: str, order: list[str]) -> DataFrame:
    """(run, stage, n, result): how many events every stage of a run has, and its last result; sums and maxima that combine before the shuffle."""
    return events.groupBy(run, stage).agg(F.count(F.lit(1)).alias("n"), F.max_by(result, F.struct(*order)).alias("result"))


class _LastResults(StatefulProcessor):
    """State of a run: by stage the number of events, and time, number and result of the last."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "n long, us long, id long, result string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[str, list] = {}
        for r in rows:
            n, *last = new.get(r["stage"], (0, -(2**63), 0, None))
            new[r["stage"]] = [n + 1, *max(tuple(last), (r["us"], r["id"], r["result"]), key=lambda x: x[:2])]
        for stage, (n, *last) in new.items():
            if self.stages.containsKey((stage,)):
                before, *old = self.stages.getValue((stage,))
                n, last = n + before, max(tuple(old), tuple(last), key=lambda x: x[:2])
            self.stages.updateValue((stage,), (n, *last))
            yield Row(run=key[0], stage=stage, n=n, result=last[-1], closed=False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(v[1] for v in new.values()) // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A run that is idle is told once more as closed, and forgotten."""
        for (stage,), (n, _, _, result) in list(self.stages.iterator()):
            yield Row(run=key[0], stage=stage, n=n, result=result, closed=True)
        self.stages.clear()

    def close(self) -> None:
        pass


def stage_results_stream(events: DataFrame, late: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """The same of a stream (run, stage, result, at, id): a row for every stage that a batch changes, and all stages once more, ``closed``, when a run has been idle.

    ``late`` is the watermark: a run is closed when it has passed the run's last event by ``idle_seconds``. Events that come in another order than they happened give the same end state.
    """
    rows = events.select("run", "stage", "result", "at", F.unix_micros("at").alias("us"), "id").withWatermark("at", late)
    schema = f"run {events.schema['run'].dataType.simpleString()}, stage string, n long, result string, closed boolean"
    return rows.groupBy("run").transformWithState(_LastResults(idle_seconds * 1000), schema, "Update", "EventTime")


class _Machine(StatefulProcessor):
    """State of a key: the machine's state, and events that wait until no earlier one can come."""

    def __init__(self, start: str, moves: dict[tuple[str, str], str]):
        self.start, self.moves = start, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string")
        self.waiting = handle.getMapState("waiting", "us long, id long", "event string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r["us"], r["id"]), (r["event"],))
            # due when the watermark has passed it
            self.handle.registerTimer(r["us"] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((k, v[0]) for k, v in self.waiting.iterator() if k[0] < passed)
        state = self.now.get()[0] if self.now.exists() else self.start
        for k, event in due:
            state = self.moves.get((state, event), state)
            self.waiting.removeKey(k)
            yield Row(key=key[0], us=k[0], id=k[1], state=state)
        self.now.update((state,))

    def close(self) -> None:
        pass


def machine_stream(events: DataFrame, start: str, moves: list[tuple[str, str, list[str]]], late: str = "1 hour") -> DataFrame:
    """(key, at, id, state): the state of a machine after each event of a stream (key, at, id, event), in the order of time, then id, whatever order they come in.

    An event waits until the watermark has passed it. Those later than the watermark are dropped by it, as in every windowed stream.
    """
    table = {(a, e): b for a, b, kinds in moves for e in kinds}
    rows = events.select("key", "at", F.unix_micros("at").alias("us"), "id", "event").withWatermark("at", late)
    schema = f"key {events.schema['key'].dataType.simpleString()}, us long, id long, state string"
    told = rows.groupBy("key").transformWithState(_Machine(start, table), schema, "Append", "EventTime")
    return told.select("key", F.timestamp_micros("us").alias("at"), "id", "state")
