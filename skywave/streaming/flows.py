"""Structured Streaming flows; each has the batch operator's result once its input has ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state
from ..sources import lines


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "line")


def hourly_rollup(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly mean and deviation states by frequency and dongle (ts a timestamp); late rows within the
    watermark update their hour. State is bounded by the open hours' keys."""
    d = scans.withWatermark("ts", late)
    d = d.groupBy(F.window("ts", "1 hour"), "freq_hz", "dongle_id").agg(*state.partials("power_dbfs"))
    return d.select(F.col("window.start").alias("hour"), "freq_hz", "dongle_id", "n", "s", "s2")


def sliding_counts(events: DataFrame, length: str = "30 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).count().select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.col("count").alias("n"))


def routed(messages: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Starts a stream that writes each route of scanner messages to its own table; the batch's id is part
    of the path, so that a batch that runs again replaces what it wrote. flush messages only end a batch."""
    routes = {"bin": "scans", "peak": "peaks", "event": "events", "health": "sweep_health", "run_start": "scan_runs", "run_update": "scan_runs", "run_end": "scan_runs"}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for table in dict.fromkeys(routes.values()):
                own = [r for r, t in routes.items() if t == table]
                batch.where(F.col("route").isin(own)).write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch_id}")
        finally:
            batch.unpersist()

    out = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def scanner_ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, every: str | None = None):
    return routed(lines.scanner_lines(text_stream(spark, source)), folder, checkpoint, every)


def on_cadence(spark: SparkSession, task: Callable[[SparkSession, int], None], checkpoint: str, every: str = "5 minutes"):
    """Starts a stream that runs task(session, number of the run) at a cadence: features, classification or health over the tables as they are then.
    A run that takes longer than the cadence delays the next one, so no two overlap, and one that fails is run again under its number."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda batch, number: task(batch.sparkSession, number)
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upsert(stream: DataFrame, path: Callable[[int], str], checkpoint: str):
    """Starts a stream that appends versions; readers take the last one (state.latest_by)."""
    return stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(path(i))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assembled(parts: DataFrame, timeout_s: int = 30, late: str = "1 minute") -> DataFrame:
    """lines.assemble() of a stream of fragments (at: arrival in seconds, and nmea_fields()): messages of one sentence as
    they come, others with one open message a key as state. Time is that of the fragments, which come in its order: an open message goes when the
    watermark passes its timeout, so results do not depend on the clock, and a stream that has ended stops."""

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        opened, last, texts = held.get if held.exists else (0.0, 0.0, "")
        got = texts.split(",") if texts else []
        out = []
        for d in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.at):
            if d.num == 1:
                opened, got = d.at, [d.payload]
            elif got and d.at - last <= timeout_s and d.at - opened <= lines.OPEN_TIMEOUTS * timeout_s:
                got.append(d.payload)
                if d.num == d.count:
                    out.append((d.at, "".join(got), d.fill))
                    got = []
            else:
                got = []
            last = d.at
        if got:
            held.update((opened, last, ",".join(got)))
            held.setTimeoutTimestamp(max(int((last + 1 + timeout_s) * 1000), held.getCurrentWatermarkMs()) + 1)
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=["at", "payload", "fill"])

    # a second is added, as Spark takes a row of the epoch itself for late before the first watermark
    parts = parts.withColumn("seen", F.timestamp_seconds(F.col("at") + 1)).withWatermark("seen", late)
    single = parts.where("count = 1").select("at", "payload", "fill")
    whole = parts.where("count > 1").groupBy("count", "msg_id", "channel").applyInPandasWithState(run, "at double, payload string, fill int", "opened double, last double, texts string", "append", GroupStateTimeout.EventTimeTimeout)
    return single.unionByName(whole)
