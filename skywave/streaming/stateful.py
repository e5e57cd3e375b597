"""Keyed state across micro-batches: rows in the order of their time, transients against the sweep before, and levels of
silent receivers. Each has the result of the batch operator that it names, however its input is cut into batches.

The state store has to be one that keeps several states a key: with_state_store() sets it for a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The store that these flows need; queries that are started later use it."""
    spark.conf.set(_STORE, _ROCKS)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, so that step() gets them in the order of time, whatever
    their order within the watermark's delay was. Rows that come later than that are dropped by Spark. Held rows are
    those of the delay: a bounded number for a receiver."""

    #: columns of a row besides its time in microseconds, as DDL
    columns = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at long, {self.columns}")
        self.names = ["at", *(c.split()[0] for c in self.columns.split(", "))]
        whole = [True, *(c.split()[1] in ("long", "int") for c in self.columns.split(", "))]
        self.plain = lambda r: tuple(None if v is None or v != v else int(v) if w else v for v, w in zip(r, whole, strict=True))
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further states."""

    def step(self, key: tuple, rows: pd.DataFrame, until_ms: int) -> list[tuple]:
        """Output for rows (by time) that are whole up to until_ms."""
        raise NotImplementedError

    def _due(self, key: tuple, new: list[tuple], until_ms: int) -> list[tuple]:
        rows = [*self.held.get(), *new] if self.held.exists() else new
        # the watermark has milliseconds: a row of the last one may not be the last of it
        due = [tuple(r) for r in rows if r[0] // 1000 < until_ms]
        if due or new:
            rest = [tuple(r) for r in rows if r[0] // 1000 >= until_ms]
            if rest:
                self.held.put(rest)
                self.handle.registerTimer(max(r[0] for r in rest) // 1000 + 1)
            else:
                self.held.clear()
        return self.step(key, pd.DataFrame(sorted(due, key=lambda r: r[0]), columns=self.names), until_ms)

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for d in rows for r in d[self.names].itertuples(index=False, name=None)]
        yield from self._frame(self._due(key, [self.plain(r) for r in new], timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._due(key, [], timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _by_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn("seen", F.col(ts).cast("timestamp")).withWatermark("seen", late).withColumn("at", F.unix_micros("seen"))


class _Transients(InOrder):
    """State: the number of the sweep that is open, and of each bin its last power and the number of its sweep."""

    columns = "sweep string, freq_hz long, power_dbfs double"
    output = ("sweep", "freq_hz", "power_dbfs", "prev_power")

    def __init__(self, least: float) -> None:
        self.least = least

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sweep string, n long, freq binary, number binary, power binary")

    def step(self, key: tuple, rows: pd.DataFrame, until_ms: int) -> list[tuple]:
        if rows.empty:
            return []
        sweep, n, bins = None, 0, {}
        if self.last.exists():
            sweep, n, *packed = self.last.get()
            freq, number, power = (np.frombuffer(v, k) for v, k in zip(packed, ("<i8", "<i8", "<f8"), strict=True))
            bins = dict(zip(freq.tolist(), zip(number.tolist(), power.tolist(), strict=True), strict=True))
        out = []
        for r in rows.itertuples(index=False):
            if r.sweep is None:
                continue
            if sweep is None or r.sweep > sweep:
                sweep, n = r.sweep, n + 1
                bins = {f: b for f, b in bins.items() if b[0] == n - 1}  # older ones are no neighbours of any sweep to come
            if r.freq_hz is None or r.power_dbfs is None or r.sweep != sweep:
                continue
            was = bins.get(int(r.freq_hz))
            if was is not None and was[0] == n - 1 and abs(r.power_dbfs - was[1]) >= self.least:
                out.append((r.sweep, int(r.freq_hz), r.power_dbfs, was[1]))
            bins[int(r.freq_hz)] = (n, r.power_dbfs)
        cols = [np.array(list(bins), "<i8"), np.array([b[0] for b in bins.values()], "<i8"), np.array([b[1] for b in bins.values()], "<f8")]
        self.last.update((sweep, n, *(c.tobytes() for c in cols)))
        return [(*key, *row) for row in out]


def transients(bins: DataFrame, within: tuple[str, ...] = ("dongle_id", "run_id"), sweep: str = "sweep_id", ts: str = "ts", least: float = 15.0, late: str = "1 minute") -> DataFrame:
    """detect.transients() of a stream of bins (within, sweep, ts, freq_hz, power_dbfs): changes of `least` dB or more against
    the sweep before of the same receiver and run, which may have come in earlier batches. Sweeps of a key follow each
    other in time and by name; a row comes out once the watermark has passed it.

    A receiver's state is its last two sweeps (some thousand bins): kept whole, as an event needs to know which sweep
    was the one before, also where that has no row of the bin."""
    d = _by_time(bins, ts, late).select(*within, "seen", "at", F.col(sweep).alias("sweep"), "freq_hz", "power_dbfs")
    kept = [bins.schema[c].dataType.simpleString() for c in within]
    processor = _Transients(least)
    processor.output = (*within, *_Transients.output)
    schema = ", ".join([*(f"{c} {k}" for c, k in zip(within, kept, strict=True)), "sweep string, freq_hz long, power_dbfs double, prev_power double"])
    out = d.groupBy(*within).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    delta = F.col("power_dbfs") - F.col("prev_power")
    return out.withColumnRenamed("sweep", sweep).withColumn("event_type", F.when(delta > 0, "appeared").otherwise("disappeared")).withColumn("delta_db", F.abs(delta))


LEVELS = ("OK", "WARN", "CRITICAL")
_NEVER = np.iinfo("<i8").min


class _Silence(StatefulProcessor):
    """State of a part of the receivers, handled at once as arrays: of each when it was last heard and its level since, rows that the
    watermark has not passed, and the one timer of the part."""

    def __init__(self, after_ms: tuple[int, ...]) -> None:
        self.after = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "names string, at binary, level binary, code binary, held binary, timer long")

    def _next(self, at: np.ndarray, level: np.ndarray, held: np.ndarray) -> int:
        """The millisecond at which the watermark next passes a change or a row; 0 if none."""
        due = [held, *(at[(level == k) & (at != _NEVER)] + ms * 1000 for k, ms in enumerate(self.after))]
        return min((int(d.min()) // 1000 + 1 for d in due if len(d)), default=0)

    def _step(self, names: np.ndarray, times: np.ndarray, until_ms: int, fired: bool) -> Iterator[pd.DataFrame]:
        """Changes that are due up to until_ms, with new rows: names and times."""
        known, timer = np.array([], object), 0
        at, level, code, held = (np.array([], k) for k in ("<i8", "i1", "<i4", "<i8"))
        if self.state.exists():
            text, *packed, timer = self.state.get()
            known = np.array(json.loads(text), object)
            at, level, code, held = (np.frombuffer(v, k) for v, k in zip(packed, ("<i8", "i1", "<i4", "<i8"), strict=True))
        codes, uniques = pd.factorize(np.concatenate([known, names]))
        fresh = len(uniques) - len(known)
        at, level = np.concatenate([at, np.full(fresh, _NEVER, "<i8")]), np.concatenate([level, np.zeros(fresh, "i1")])
        code, held = np.concatenate([code, codes[len(known) :].astype("<i4")]), np.concatenate([held, times])
        # the watermark has milliseconds: a row of the last one may not be the last of it
        whole = held // 1000 < until_ms
        was = np.flatnonzero(at != _NEVER)  # the last rows of before come first
        c, t, cur = np.concatenate([was, code[whole]]), np.concatenate([at[was], held[whole]]), np.concatenate([level[was], np.zeros(whole.sum(), "i1")])
        code, held = code[~whole], held[~whole]
        order = np.lexsort((t, c))
        c, t, cur = c[order], t[order], cur[order]
        follows = np.append(c[1:] == c[:-1], False)[: len(c)]
        after = np.append(t[1:], 0)[: len(t)]
        until = np.where(follows, after - 1, until_ms * 1000 - 1)
        out = []
        for k, ms in enumerate(self.after, 1):
            due = (cur < k) & (t + ms * 1000 <= until)
            out.append((c[due], t[due] + ms * 1000, cur[due], np.full(due.sum(), k, "i1")))
            cur = np.where(due, k, cur).astype("i1")
        back = follows & (cur > 0)
        out.append((c[back], after[back], cur[back], np.zeros(back.sum(), "i1")))
        at[c[~follows]], level[c[~follows]] = t[~follows], cur[~follows]
        due = self._next(at, level, held)
        if timer != due:
            if timer and not fired:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)  # fires though no row comes
        self.state.update((json.dumps(uniques.tolist()), at.tobytes(), level.tobytes(), code.tobytes(), held.tobytes(), due))
        c, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(c):
            yield pd.DataFrame(dict(zip(("name", "at", "was", "level"), (uniques[c], *rest), strict=True))).astype({"was": "int32", "level": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat([d[["name", "at"]] for d in rows])
        yield from self._step(d["name"].to_numpy(object), d["at"].to_numpy("<i8"), timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(np.array([], object), np.array([], "<i8"), timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def silence_levels(sweeps: DataFrame, key: str = "dongle_id", ts: str = "ts", warn_s: int = 600, crit_s: int = 1500, late: str = "1 minute", parts: int = 256) -> DataFrame:
    """detect.silence_changes() of a stream: (key, ts, was, level). A receiver of which nothing is heard changes its level
    warn_s and crit_s seconds after its last row, by a timer of event time: when the watermark, which
    other receivers drive, has passed that time. It is OK again with its next row. Rows without a time are none.

    Receivers are dealt to so many parts by a hash, each with one state and one timer: a call of Python costs some milliseconds, and there
    may be millions of receivers. A part's rows of a batch are in memory at once. The number of a stream does not change."""
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a missing key is one too
    d = _by_time(sweeps.withColumn("name", name), ts, late).where("at IS NOT NULL").select("name", "seen", "at", F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part"))
    out = d.groupBy("part").transformWithStateInPandas(
        statefulProcessor=_Silence((warn_s * 1000, crit_s * 1000)), outputStructType="name string, at long, was int, level int", outputMode="Append", timeMode="EventTime"
    )
    level = lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), F.col(c) + 1).alias(c)
    own = F.when(F.col("name") != "", F.expr("substring(name, 2)")).cast(sweeps.schema[key].dataType)
    return out.select(own.alias(key), F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), level("was"), level("level"))


def lonely(events: DataFrame, keys: tuple[str, ...] = ("freq_hz",), ts: str = "ts", within_s: int = 300, late: str = "1 minute") -> DataFrame:
    """Rows of a stream with no other one of their keys, at another time, within so many seconds (whole seconds, bound
    included) before or after: sessions of which all rows are of one time. State is that of open sessions, two times and a count each, and work
    is in proportion to the rows, however close they are. A row without a neighbour comes out when the watermark has passed the time in which
    one could have come. A row whose time or one of whose keys is null has no neighbours."""
    # less than within_s + 1 seconds apart, at microseconds
    own = F.session_window("seen", f"{within_s} seconds 999999 microseconds")
    d = events.withColumn("seen", F.col(ts).cast("timestamp")).withWatermark("seen", late)
    apart = F.when(F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False)), F.col("seen"))
    d = d.groupBy(*keys, apart.alias("apart"), own).agg(F.min("seen").alias("first"), F.max("seen").alias("last"), F.count("*").alias("n")).where("first = last")
    out = d.select(*keys, F.col("first").cast("timestamp_ntz").alias(ts), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_")).drop("_")
    return out.unionByName(events.where(F.col(ts).isNull()).select(*keys, F.col(ts).cast("timestamp_ntz").alias(ts)))


class _Flushed(StatefulProcessor):
    """State: a receiver's rows since its last write, the number of the next one, and when it is due at the latest."""

    def __init__(self, most: int, after_ms: int, schema: str) -> None:
        self.most, self.after, self.names = most, after_ms, [c.split()[0] for c in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long, message string")
        self.next = handle.getValueState("next", "write long, n long, due long")

    def _write(self, key: tuple, rows: list[tuple], write: int) -> list[tuple]:
        return [(*key, write, seq, message) for seq, message in rows]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        write, n, due = self.next.get() if self.next.exists() else (0, 0, 0)
        held = [tuple(r) for r in self.held.get()] if n else []
        out = []
        for r in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            if not r.flush:
                held.append((r.seq, r.message))
            if held and (r.flush or len(held) == self.most):
                out += self._write(key, held, write)
                held, write = [], write + 1
        if held:
            self.held.put(held)
            if len(held) <= n or not n or not due:  # a new write has begun
                due = timerValues.getCurrentProcessingTimeInMs() + self.after
                self.handle.registerTimer(due)
        else:
            self.held.clear()
            due = 0
        self.next.update((write, len(held), due))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        write, n, due = self.next.get() if self.next.exists() else (0, 0, 0)
        out = []
        if n and due <= expiredTimerInfo.getExpiryTimeInMs():  # not that of an earlier write
            out = self._write(key, [tuple(r) for r in self.held.get()], write)
            self.held.clear()
            self.next.update((write + 1, 0, 0))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def flushed(messages: DataFrame, key: str = "dongle_id", seq: str = "seq", flush: str = "flush", most: int = 500, after_s: float = 5.0) -> DataFrame:
    """A stream of messages in writes: the columns of messages but flush, with `write`, which numbers the writes of a receiver from 0. A write ends
    with a flush marker (a row whose flush is true: the end of a sweep), with `most` rows, or after_s seconds of the clock after it
    began, so that what a receiver sends before it falls silent is written too. Rows of a receiver come in the order of seq; a marker may
    come in a later batch than its rows. What is open when the stream is stopped is state, and written when it goes on. Timers of the clock keep
    a stream going until it is stopped, whatever its trigger."""
    names = [c for c in messages.columns if c not in (key, seq, flush)]
    d = messages.select(key, F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(flush), F.lit(False)).alias("flush"), F.to_json(F.struct(*names)).alias("message"))
    schema = f"{key} {messages.schema[key].dataType.simpleString()}, write long, seq long, message string"
    out = d.groupBy(key).transformWithStateInPandas(statefulProcessor=_Flushed(most, int(after_s * 1000), schema), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    fields = messages.select(*names).schema
    return out.withColumn("m", F.from_json("message", fields)).select(key, F.col("seq").alias(seq), "m.*", "write")


def written(writes: DataFrame, folder: str, checkpoint: str, key: str = "dongle_id", **trigger):
    """Starts a stream that puts each write of flushed() in a folder of its own, by receiver and number: a batch that runs again
    replaces its writes and no others."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.repartition(key, "write").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "write").parquet(folder)

    out = writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()
