"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark opens the path, so any store that it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a local master (one machine, as in tests)
    gets a folder of its own; on a cluster this is an error, as executors could not read each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skywave-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in checkpoint_folder(). The files go once the frame is unreachable if
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def in_few_files(df: DataFrame) -> DataFrame:
    """cut_lineage() in no more tasks than four a core, each of which goes through its partitions one by one. Each
    file of a checkpoint costs time, and on Hadoop's local file system two processes (chmod) besides."""
    return cut_lineage(df.coalesce(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def fixed_layout(df: DataFrame) -> DataFrame:
    """cut_lineage() that keeps the partitioning which df was given by repartition(n, key), so that
    later joins and cogroups on the key need no exchange of these rows."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def scratch(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has, whatever case it is written in."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator, rows: int) -> Iterator:
    """Batches of a pandas iterator in pieces of so many rows, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows].reset_index(drop=True)


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_batches(df: DataFrame, name: str, kind: str, parts_of: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with one more column of a type, whose values for an Arrow batch come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(parts_of(b))], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))]))
