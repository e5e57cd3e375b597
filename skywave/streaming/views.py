"""Incremental views: rollups and latest values kept as mergeable partial states, one set a micro-batch.

A batch's rows are aggregated to states (counts, sums, least and greatest values, by the view's grain) that are written under the batch's
id: a batch that runs again replaces what it wrote, and rows that come late, however late, are
one more batch. Readers merge states, so a view is always the rollup of all rows. compact() merges the states of many batches into one
set; it counts from the moment at which its writing is complete (Spark's _SUCCESS file), as batches up to its
number are then no longer read; clean() removes what no reader needs any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """grain: columns of a state by their SQL; states: (SQL of a batch's aggregate, how two are merged: sum, min or max);
    by: columns of a result; result: aggregates over states by their SQL. Distinct values that a result counts are part of the grain."""

    source: str
    grain: dict[str, str]
    states: dict[str, tuple[str, str]]
    by: list[str]
    result: dict[str, str]
    where: str = "true"

    def partials(self, rows: DataFrame) -> DataFrame:
        d = rows.where(self.where)
        return d.groupBy(*[F.expr(e).alias(c) for c, e in self.grain.items()]).agg(*[F.expr(e).alias(c) for c, (e, _) in self.states.items()])

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.grain).agg(*[F.expr(f"{how}({c})").alias(c) for c, (_, how) in self.states.items()])

    def finished(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.by).agg(*[F.expr(e).alias(c) for c, e in self.result.items()])


def mean(value: str, name: str = "s") -> dict[str, tuple[str, str]]:
    """States of a mean; sum(<name>) / sum(<name>_n) is the result."""
    return {name: (f"sum({value})", "sum"), f"{name}_n": (f"count({value})", "sum")}


def latest(columns: list[str], ts: str = "ts") -> tuple[dict[str, tuple[str, str]], dict[str, str]]:
    """States and results of the last value of each column that is not null."""
    states = {f"{c}_v": (f"max(CASE WHEN {c} IS NOT NULL THEN struct({ts}, {c}) END)", "max") for c in columns}
    return states | {"last_seen": (f"max({ts})", "max"), "n": ("count(*)", "sum")}, {"last_seen": "max(last_seen)", "n": "sum(n)"} | {c: f"max({c}_v).{c}" for c in columns}


_HOUR = {"hour": "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)"}
_N = {"n": ("count(*)", "sum")}


def _last(source: str, keys: list[str], columns: list[str], where: str = "true") -> View:
    states, result = latest(columns)
    return View(source, {k: k for k in keys}, states, keys, result, where)


#: The rollups and latest values by their relation's columns.
VIEWS: dict[str, View] = {
    "hourly_baseline": View(
        "scans",
        _HOUR | {"freq_hz": "freq_hz", "dongle_id": "dongle_id"},
        _N | mean("power_dbfs") | {"s2": ("sum(power_dbfs * power_dbfs)", "sum")},
        ["hour", "freq_hz", "dongle_id"],
        {"n": "sum(n)", "mean": "sum(s) / sum(s_n)", "std": "sqrt(greatest(sum(s2) / sum(s_n) - (sum(s) / sum(s_n)) * (sum(s) / sum(s_n)), 0e0))"},
    ),
    "acars_hourly": View(
        "messages",
        _HOUR | {"freq_mhz": "freq_mhz", "flight": "flight", "tail": "tail"},
        _N | mean("level_db"),
        ["hour", "freq_mhz"],
        {"n": "sum(n)", "level": "sum(s) / sum(s_n)", "flights": "count(DISTINCT flight)", "tails": "count(DISTINCT tail)"},
    ),
    "flight_latest": _last("messages", ["flight"], ["tail", "label", "depa", "dsta", "freq_mhz"], "flight <> ''"),
    "tail_latest": _last("messages", ["tail"], ["flight", "label", "depa", "dsta", "freq_mhz"], "tail <> ''"),
    "frequency_stats": View(
        "messages",
        {"freq_mhz": "freq_mhz", "dongle_id": "dongle_id"},
        _N | mean("level_db") | {"last": ("max(ts)", "max")},
        ["freq_mhz", "dongle_id"],
        {"last_seen": "max(last)", "message_count": "sum(n)", "avg_level": "sum(s) / sum(s_n)"},
    ),
    "aircraft_hourly": View(
        "positions",
        _HOUR | {"hex_ident": "hex_ident"},
        _N | mean("ground_speed") | {"top": ("max(altitude)", "max")},
        ["hour"],
        {"n": "sum(n)", "aircraft": "count(DISTINCT hex_ident)", "max_altitude": "max(top)", "speed": "sum(s) / sum(s_n)"},
    ),
    "aircraft_latest": _last("positions", ["hex_ident"], ["callsign", "altitude", "ground_speed"]),
    "ship_hourly": View("ships", _HOUR | {"mmsi": "mmsi"}, _N | mean("speed"), ["hour"], {"n": "sum(n)", "ships": "count(DISTINCT mmsi)", "speed": "sum(s) / sum(s_n)"}),
    "ship_latest": _last("ships", ["mmsi"], ["ship_name", "callsign", "ship_type", "lat", "lon", "speed", "course"]),
    "sensor_hourly": View(
        "sensors",
        _HOUR | {"model": "model", "device": "coalesce(device_id, '?')"},
        _N | mean("temperature_c"),
        ["hour", "model"],
        {"n": "sum(n)", "devices": "count(DISTINCT device)", "temperature": "sum(s) / sum(s_n)"},
    ),
    "device_latest": _last("sensors", ["model", "device_id"], ["channel", "temperature_c", "humidity"]),
    "pass_latest": View(
        "passes",
        {"pass_start": "pass_start", "name": "replace(satellite, ' ', '-')"},
        {"v": ("max(struct(seq, satellite, status))", "max")},
        ["pass_start", "name"],
        {"seq": "max(v).seq", "satellite": "max(v).satellite", "status": "max(v).status"},
    ),
    "pass_summary": View(
        "passes",
        {"month": "CAST(date_trunc('MONTH', pass_start) AS TIMESTAMP_NTZ)", "satellite": "satellite", "pass_start": "pass_start"},
        _N | {"decoded": ("count_if(status = 'decoded')", "sum")} | mean("CASE WHEN status = 'decoded' THEN snr_db END"),
        ["month", "satellite"],
        {"rows": "sum(n)", "passes": "count(DISTINCT pass_start)", "decoded": "sum(decoded)", "snr": "try_divide(sum(s), sum(s_n))"},
    ),
}


class Kept:
    """A view's states in a folder that all executors share."""

    def __init__(self, spark: SparkSession, view: View, folder: str) -> None:
        self.spark, self.view, self.folder = spark, view, folder

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """One batch; the same id again replaces it."""
        self.view.partials(rows).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def stream(self, rows: DataFrame, checkpoint: str, **trigger):
        """Starts the stream that keeps the view up to date; without a trigger it takes what is there and ends."""
        out = rows.writeStream.foreachBatch(lambda d, i: self.apply(d, i)).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).start()

    def _complete(self) -> tuple[dict[str, list[int]], Callable]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"batch": [], "base": []}
        for f in fs.listStatus(path) if fs.exists(path) else []:
            kind, _, number = f.getPath().getName().partition("=")
            if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
        return found, lambda name: fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)

    def states(self) -> DataFrame | None:
        """The states that count: the last complete base and the batches after it."""
        found, _ = self._complete()
        base = max(found["base"], default=-1)
        names = [f"base={base}"] * (base >= 0) + [f"batch={b}" for b in sorted(found["batch"]) if b > base]
        parts = [self.spark.read.parquet(f"{self.folder}/{n}") for n in names]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame:
        states = self.states()
        if states is None:
            raise ValueError("nothing has been written yet")
        return self.view.finished(states)

    def compact(self) -> None:
        """Merges all batches that are complete; a stream may go on meanwhile. Batches have to come in the order of their ids, as a
        stream's do."""
        found, _ = self._complete()
        last = max(found["batch"], default=-1)
        if last > max(found["base"], default=-1):
            self.view.merged(self.states()).write.mode("overwrite").parquet(f"{self.folder}/base={last}")

    def clean(self) -> None:
        """Removes what the last base holds."""
        found, remove = self._complete()
        base = max(found["base"], default=-1)
        for kind, numbers in found.items():
            for n in numbers:
                if n < base or (kind == "batch" and n <= base):
                    remove(f"{kind}={n}")
