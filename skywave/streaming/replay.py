"""Replays: a table as a stream of micro-batches in the order of time, for flows to be held against batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.tables import shared_folder


def in_batches(df: DataFrame, ts: str, batches: int, files: int = 1) -> tuple[DataFrame, str]:
    """A stream that gives df in so many batches, cut by ranges of ts, and the shared folder that holds them. A batch is up to so many files, which
    tasks read side by side, or more where Spark writes more. Files are stamped in the order of their ranges, since a file source reads the oldest first."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    df.repartitionByRange(batches * files, ts).write.parquet(f"{folder}/in")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = sorted(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    for k, f in enumerate(paths):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f), 1_600_000_000_000 + 1000 * k, -1)
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", max(1, -(-len(paths) // batches))).parquet(f"{folder}/in")
    return stream, folder


def replayed(df: DataFrame, ts: str, flow: Callable[[DataFrame], DataFrame], batches: int = 6) -> DataFrame:
    """What flow makes of df as a stream, once all batches and the timers up to the last watermark are done."""
    stream, folder = in_batches(df, ts, batches, df.sparkSession.sparkContext.defaultParallelism)
    out = flow(stream)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")
