"""Incremental twins of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues


def work_queue(tasks: DataFrame, done_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "task_key") -> StreamingQuery:
    """Run `work` on each task once: a resumable queue with a durable progress log.

    Tasks already in the log at `done_path` are skipped, so a micro-batch that is repeated after a failure adds nothing
    twice. Each batch of results is one atomic append, tagged with its batch number as seq."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            todo = todo.join(spark.read.parquet(done_path).select(key), key, "left_anti")
        work(todo).withColumn("seq", F.lit(n)).write.mode("append").parquet(done_path)

    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(log: DataFrame, key: str = "task_key", value: str = "output") -> DataFrame:
    """(key, value): the last record of each key wins."""
    return log.groupBy(key).agg(F.max_by(value, "seq").alias(value))


def ring_memory(rows: DataFrame, capacity: int) -> DataFrame:
    """(epoch, batch, filled, clock): what a FIFO memory of `capacity` rows holds when each batch arrives; one state per epoch.

    rows: epoch, batch, n (rows of the batch), batches of an epoch in order. The state is two counters, whatever the epoch holds."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, clock = state.get if state.exists else (0, 0)
        out = []
        for batch, n in pd.concat(frames).sort_values("batch")[["batch", "n"]].itertuples(index=False):
            out.append((key[0], batch, min(seen, capacity), clock))
            seen, clock = seen + int(n), clock + 1
        state.update((seen, clock))
        yield pd.DataFrame(out, columns=["epoch", "batch", "filled", "clock"])

    return rows.groupBy("epoch").applyInPandasWithState(step, "epoch long, batch long, filled long, clock long", "seen long, clock long", "append", GroupStateTimeout.NoTimeout)


class _Ring(StatefulProcessor):
    """The last `capacity` rows of an epoch: one map entry per batch that still has rows in the memory."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "clock long")
        self.batches = handle.getMapState("batches", "born long", "ids array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else 0
        kept = deque(sorted((k[0], list(v[0])) for k, v in self.batches.iterator())) if clock and self.batches.exists() else deque()
        size = sum(len(ids) for _, ids in kept)
        for batch, f in pd.concat(rows).sort_values(["batch", "pos"]).groupby("batch", sort=True):
            held = [(i, clock - born) for born, ids in kept for i in ids][max(0, size - self.capacity) :]
            if held:
                yield pd.DataFrame({"epoch": key[0], "batch": batch, "row_id": [i for i, _ in held], "age": [age for _, age in held]})
            new = f.row_id.tolist()[max(0, len(f) - self.capacity) :]
            if new:
                kept.append((clock, new))
                self.batches.updateValue((clock,), (new,))
                size += len(new)
            while kept and size - len(kept[0][1]) >= self.capacity:
                born, gone = kept.popleft()
                self.batches.removeKey((born,))
                size -= len(gone)
            clock += 1
        self.clock.update((clock,))

    def close(self) -> None:
        pass


def ring_contents(rows: DataFrame, capacity: int) -> DataFrame:
    """(epoch, batch, row_id, age): the rows that a FIFO memory holds when each batch arrives, oldest first; one state per epoch.

    rows: epoch, batch, pos, row_id, batches of an epoch in order. age counts batches. A batch is written to the state once
    and removed when its last row has left the memory. A capacity of 0 holds nothing, and of a batch larger than it the last
    rows stay. Keyed map state needs the RocksDB state store, which the caller's session sets (rocksdb_state)."""
    if capacity < 0:
        raise ValueError("the capacity can't be negative")
    return rows.groupBy("epoch").transformWithStateInPandas(_Ring(capacity), "epoch long, batch long, row_id long, age long", "append", "none")


def rocksdb_state(spark: SparkSession) -> None:
    """Keep the state of the session's new streaming queries in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def best_so_far(log: DataFrame, floor: float, patience: int) -> DataFrame:
    """(run, step, best, bad, stopped) after each evaluation of each run's metric log (run, step, map, r10), in order of step."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, stopped = state.get if state.exists else (-1.0, 0, False)
        out = []
        for at, value, r10 in pd.concat(frames).sort_values("step")[["step", "map", "r10"]].itertuples(index=False):
            if not stopped:
                good = value > best and r10 >= floor
                best, bad = (value, 0) if good else (best, bad + 1)
                stopped = bad >= patience
            out.append((key[0], at, best, bad, stopped))
        state.update((float(best), int(bad), bool(stopped)))
        yield pd.DataFrame(out, columns=["run", "step", "best", "bad", "stopped"])

    return log.groupBy("run").applyInPandasWithState(step, "run string, step long, best double, bad int, stopped boolean", "best double, bad int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def score_stream(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """`rows` with a column from an external scorer that sees Arrow batches (works on streams and on tables)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{name: scorer(f).astype("float64")})

    scored = rows.mapInPandas(run, rows.withColumn(name, F.lit(0.0)).schema)
    return scored.observe("scoring", F.count(F.lit(1)).alias("rows"), F.sum(F.col(name).isNull().cast("long")).alias("without"))


def throughput(query: StreamingQuery) -> DataFrame:
    """(batch, rows, without, seconds, per_second) of the recent batches of a query over score_stream(): rows scored, rows
    without a score, and the time that the batch took. Spark keeps as many as spark.sql.streaming.numRecentProgressUpdates says."""
    out = []
    for p in query.recentProgress:
        seen = (p["observedMetrics"] or {}).get("scoring")
        if seen is not None:
            seconds = p["batchDuration"] / 1000
            out.append((int(p["batchId"]), int(seen["rows"]), int(seen["without"] or 0), seconds, int(seen["rows"]) / max(seconds, 1e-3)))
    return SparkSession.active().createDataFrame(out, "batch long, rows long, without long, seconds double, per_second double")

