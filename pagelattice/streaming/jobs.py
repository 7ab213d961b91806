"""Structured Streaming: job events, monitors, pacing, statistics, an outbox.

Streams read folders of Parquet files (any streaming source with the same columns will
do), keep their state in Spark's state store and write through idempotent sinks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pace import PACED, Pace, step


def folder_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, with the folder's schema. A path that is one
    file streams that file (and successors of its name) out of its folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what is there into a Parquet folder and stops; the next run with the same
    checkpoint goes on from there. Files are committed once, also after a failure."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


# --- job events --------------------------------------------------------------------------


def job_events(steps: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each event once by its id: repeats within ``late`` of the first are dropped, and older
    ids are forgotten, so the state stays bounded."""
    return steps.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fan_out(stream: DataFrame, sinks: dict[str, Any], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to each sink: ``name -> f(batch, batch_id)``. A batch that is run
    again has the same id, by which a sink can tell."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for f in sinks.values():
                f(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_sink(folder: str) -> Any:
    """Sink that writes a batch to the sub-folder of its id, overwriting what an earlier try
    of the same batch left: exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def snapshot(steps: DataFrame, job: str) -> DataFrame:
    """Running totals per job."""
    return steps.groupBy(job).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "success").alias("succeeded"), F.max("seq").alias("last_seq")
    )


# --- windows ---------------------------------------------------------------------------------


def windowed(events: DataFrame, at: str, by: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; windows close when the watermark passes."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        events.withWatermark(at, late)
        .groupBy(w, by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "value")
    )


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of events with no gap of ``gap`` between them."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.session_window(at, gap).alias("s"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


# --- stateful operators ------------------------------------------------------------------------


def monitor_stream(observations: DataFrame, key: str = "run_id") -> DataFrame:
    """Change events of each monitor, its baseline kept as state: rows
    ``key, seq, sha, valid`` in, ``key, seq, event, version`` out. Within a micro-batch
    rows are taken in order of ``seq``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, version = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, sha, valid in zip(rows["seq"], rows["sha"], rows["valid"]):
            if not valid:
                event = "cannot_verify"
            elif base is None:
                event, base, version = "initialized", sha, version + 1
            elif sha == base:
                event = "unchanged"
            else:
                event, base, version = "changed", sha, version + 1
            out.append((k[0], seq, event, version))
        state.update((base, version))
        yield pd.DataFrame(out, columns=["key", "seq", "event", "version"])

    rows = observations.select(F.col(key).alias("key"), "seq", "sha", "valid")
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, seq long, event string, version long", "base string, version long", "append", GroupStateTimeout.NoTimeout
    )


def pacing_stream(pages: DataFrame, host: str = "host", baseline: int = 0, idle: str | None = None) -> DataFrame:
    """The pace of each host after each page, kept as state; rows ``host, seq, signal`` (null for
    a normal page) and, if there, ``earlier``. A host's rows of a micro-batch pass one task in
    order of ``seq``, so a batch is to be bounded by the source. With ``idle`` a host not seen
    for so long is forgotten, and the state does not grow with every host ever met; that is for
    streams that run on, as ``run_once`` would wait for it without end."""

    def one(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = Pace(*state.get) if state.exists else Pace(delay=baseline)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, signal, earlier in zip(rows["seq"], rows["signal"], rows["earlier"]):
            p, change, hold = step(p, signal, earlier, baseline)
            out.append((k[0], seq, p.delay, change, hold))
        state.update(tuple(p))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["host", "seq", "delay_ms", "change", "hold_ms"])

    rows = pages.select(F.col(host).alias("host"), "seq", "signal", (F.col("earlier") if "earlier" in pages.columns else F.lit(None)).cast("string").alias("earlier"))
    state = "delay long, streak int, calm int, slowdowns int, floor long, cause string, eased boolean, settled string"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("host").applyInPandasWithState(one, PACED, state, "append", timeout)


def route_statistics(calls: DataFrame, ttl: str = "7 days", least: int = 3) -> DataFrame:
    """Tries and successes per route over the last ``ttl``, of routes with ``least`` tries;
    older windows are dropped from the state."""
    return (
        calls.withWatermark("at", ttl)
        .groupBy(F.window("at", ttl), "route")
        .agg(F.count(F.lit(1)).alias("tries"), F.count_if("ok").alias("successes"))
        .where(F.col("tries") >= least)
        .select("route", F.col("window.start").alias("since"), "tries", "successes")
    )


# --- outbox -------------------------------------------------------------------------------------


def deliver(events: DataFrame, send: Any, most_tries: int = 5) -> DataFrame:
    """One round of an outbox: ``events`` (``event_id, payload, tries, state``) that are pending
    are handed to ``send(pandas frame) -> acknowledged booleans`` in batches; the result has the
    new states: ``acknowledged``, ``pending`` again, or ``dead`` after ``most_tries``. At least
    once: a lost executor's batch is sent again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            due = b["state"] == "pending"
            ok = pd.Series(False, index=b.index)
            if due.any():
                ok[due] = list(send(b[due]))
            b.loc[due, "tries"] += 1
            b.loc[due & ok, "state"] = "acknowledged"
            b.loc[due & ~ok & (b["tries"] >= most_tries), "state"] = "dead"
            yield b

    return events.select("event_id", "payload", "tries", "state").mapInPandas(run, "event_id string, payload string, tries int, state string")


def replay(events: DataFrame, since: str) -> DataFrame:
    """Dead and acknowledged events from an id on, pending again."""
    return events.withColumn("state", F.when(F.col("event_id") >= since, "pending").otherwise(F.col("state"))).withColumn(
        "tries", F.when(F.col("event_id") >= since, 0).otherwise(F.col("tries"))
    )
