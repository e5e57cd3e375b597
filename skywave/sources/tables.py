"""Tables: reading by time, writing by date, exports, swaps and formats."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import state


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master (one machine)
    gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skywave-shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def write_facts(df: DataFrame, path: str, ts: str, sort: list[str], mode: str = "append") -> None:
    """Parquet by date, rows of a date sorted so that row groups prune by the sort columns too."""
    d = df.withColumn("date", F.to_date(ts))
    d.repartition("date").sortWithinPartitions("date", *sort).write.mode(mode).partitionBy("date").parquet(path)


def read_facts(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """Rows of [start, end]; the date predicate prunes partitions, the time predicate reaches the scan."""
    d = spark.read.parquet(path).where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return d.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).drop("date")


def export_csv(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as CSV with a header; returns (name, rows), counted as they are written."""
    counted = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        counted.append((name, seen.get["rows"]))
    return next(iter(tables.values())).sparkSession.createDataFrame(counted, "name string, rows long")


def export_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def as_vertical(df: DataFrame) -> DataFrame:
    """One column `value`: each row as lines `name: value`."""
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in df.columns]
    return df.select(F.concat_ws("\n", *cells).alias("value"))


def rebuild(spark: SparkSession, source: str, target: str, change) -> None:
    """Writes change(source) to a new path beside target's old one and leaves the old one alone."""
    change(spark.read.parquet(source)).write.mode("errorifexists").parquet(target)


def swap(spark: SparkSession, table: str, change) -> None:
    """Rebuilds a catalogue table: change(table) is written as a new one, the names are changed over, the old one goes
    last, so that a run that fails on the way leaves a whole table under one of the names."""
    new, old = f"{table}_new", f"{table}_old"
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    change(spark.table(table)).write.saveAsTable(new)
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")


class Versions:
    """A table in a shared folder as versions of which readers see one whole one: each is written beside the others, and counts from the moment at which
    the manifest names it. The manifest is a small file for each version, made by a rename, which takes effect at once or not
    at all; the greatest complete one is current, so a writer that is lost on the way leaves the last version current."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def current(self) -> int | None:
        return max(self._names("manifest"), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise ValueError("the table has no version")
        return self.spark.read.parquet(f"{self.folder}/data/{version}")

    def write(self, df: DataFrame, keys: list[str] | None = None, buckets: int | None = None) -> int:
        """A new version, in files by ranges of keys if given; its number. Two writers at a time get two numbers, or one of them an error."""
        version = max(self._names("data") + self._names("manifest"), default=-1) + 1
        if keys:
            df = (df.repartition(buckets, *keys) if buckets else df.repartition(*keys)).sortWithinPartitions(*keys)
        df.write.mode("errorifexists").parquet(f"{self.folder}/data/{version}")
        new = self._path(f"{self.folder}/manifest/.{version}")
        self._fs.create(new, True).close()
        if not self._fs.rename(new, self._path(f"{self.folder}/manifest/{version}")):
            raise RuntimeError(f"version {version} could not be named")
        return version

    def compact(self, keys: list[str], version: str, *ties, buckets: int | None = None) -> int:
        """A version with the row of the greatest `version` of each key only, in files by key: readers of the one before go on undisturbed."""
        return self.write(state.latest_by(self.read(), keys, version, *ties), keys, buckets)

    def clean(self, keep: int = 1) -> None:
        """Removes all but the last `keep` versions, and what lost writers left. Its manifest goes first, so that no reader
        finds a version of which a part is gone; readers that opened one of them have to be done."""
        named = self._names("manifest")
        for v in named[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifest/{v}"), False)
        for v in self._names("data"):
            if v not in named[-keep:] and v < max(named, default=-1):
                self._fs.delete(self._path(f"{self.folder}/data/{v}"), True)
