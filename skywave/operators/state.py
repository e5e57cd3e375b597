"""Latest versions, merged latest values, partial aggregates, run folding, retention and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], version: str, *ties: Column) -> DataFrame:
    """The row of the greatest version of each key (ties by `ties`)."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), *ties))
    return df.withColumn("_v", last).where("_v = 1").drop("_v")


def latest_values(df: DataFrame, keys: list[str], version: str, cols: list[str], keep_nulls: bool = False) -> DataFrame:
    """Each column's last value by version; nulls are skipped unless keep_nulls. Combines map-side."""
    skip = "" if keep_nulls else " FILTER (WHERE {0} IS NOT NULL)"
    return df.groupBy(*keys).agg(F.max(version).alias("last_seen"), F.count("*").alias("n"), *[F.expr(f"max_by({c}, {version})" + skip.format(c)).alias(c) for c in cols])


def partials(value: str | Column) -> list[Column]:
    """State columns of mean and deviation that add up: n, s, s2."""
    x = F.col(value) if isinstance(value, str) else value
    return [F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("s2")]


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the same keys as one."""
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])


def finished(states: DataFrame) -> DataFrame:
    """mean and std (population) of states."""
    mean = F.col("s") / F.col("n")
    return states.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))).drop("s", "s2")


def fold_runs(messages: DataFrame) -> DataFrame:
    """run_start, run_update and run_end messages (run_id, kind, ts, fields...) as one row a run: the last
    value of each field that is not null; runs without a start are left out."""
    fields = [c for c in messages.columns if c not in ("run_id", "kind", "ts")]
    out = messages.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "run_start", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("kind") == "run_end", F.col("ts"))).alias("ended_at"), *[F.expr(f"max_by({c}, ts) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in fields])
    return out.where("started_at IS NOT NULL")


def retain(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows not older than so many days; on a table partitioned by date Spark prunes the partitions."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys the table has not: an idempotent insert."""
    return rows.join(table.select(*keys).distinct(), keys, "left_anti")


def recode(df: DataFrame, col: str, rules: list[tuple[Column, object]]) -> DataFrame:
    """Conditional recodes of a column; the first rule that holds counts."""
    out = F.col(col)
    for cond, value in reversed(rules):
        out = F.when(cond, F.lit(value)).otherwise(out)
    return df.withColumn(col, out)


def seed_if_empty(table: DataFrame, rows: DataFrame, present: Column) -> DataFrame:
    """rows if no row of table is `present`, else none: a seed that runs again adds nothing."""
    any_ = table.where(present).limit(1).select(F.lit(True).alias("_any"))
    return rows.withColumn("_one", F.lit(True)).join(F.broadcast(any_), F.col("_one") == F.col("_any"), "left_anti").drop("_one")


def logged(entries: DataFrame, at: str) -> DataFrame:
    """Operator log entries as rows of the listening log: the confirmed frequency in Hz is rounded from MHz, an id and the time `at`
    are filled in; entries without a frequency or class are left out. The id is a hash of the entry, so a repeat gives the same one."""
    d = entries.where("freq_mhz IS NOT NULL AND class_id IS NOT NULL").withColumn("logged_at", F.lit(at).cast("timestamp_ntz"))
    d = d.withColumn("confirmed_freq_hz", F.round(F.col("freq_mhz") * 1_000_000).cast("long"))
    return d.withColumn("id", F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256))


def with_defaults(rows: DataFrame, id_col: str = "id", at_col: str = "logged_at") -> DataFrame:
    """rows with a random id and the time of the clock where they have none, as an ingest fills them in. A task that runs again draws other
    ids: rows that may be written twice need logged(), whose ids are hashes of the rows."""
    made = {id_col: F.uuid(), at_col: F.current_timestamp()}
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in made.items()})


def reshaped(df: DataFrame, defaults: dict[str, object] | None = None, rename: dict[str, str] | None = None, types: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Changes of a table's columns, in this order: drop, rename, types, then defaults, which add a column or fill its nulls."""
    d = df.drop(*(drop or [])).withColumnsRenamed(rename or {})
    d = d.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in d.columns else F.lit(v) for c, v in (defaults or {}).items()})


def conditional(value: str, cond: Column) -> list[Column]:
    """State columns of a count, and of a sum and mean under a condition."""
    on = F.when(cond, F.col(value))
    return [F.count("*").alias("n"), F.count(on).alias("n_if"), F.coalesce(F.sum(on), F.lit(0.0)).alias("s_if")]


def merge_conditional(states: DataFrame, keys: list[str], distinct: str) -> DataFrame:
    """States of conditional() (held by keys, `distinct` and anything else) by keys: n, sum_if, avg_if, and the exact number of
    distinct values as `<distinct>s`; states of a value are put together first."""
    one = states.groupBy(*keys, distinct).agg(*[F.sum(c).alias(c) for c in ("n", "n_if", "s_if")])
    out = one.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(distinct).alias(f"{distinct}s"), F.sum("s_if").alias("sum_if"), F.sum("n_if").alias("_n"))
    return out.withColumn("avg_if", F.try_divide("sum_if", "_n")).drop("_n")


def sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable sketches of distinct values; merge_sketches() adds them up."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value).alias("sketch"))


def merge_sketches(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
