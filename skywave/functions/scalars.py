"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ts: Column, unit: str) -> Column:
    """Start of the minute, hour, day or month, as a timestamp without zone like ts."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def minutes_bucket(ts: Column, minutes: int) -> Column:
    """Start of the interval of so many minutes since the hour (minutes divides 60)."""
    hour = F.date_trunc("hour", ts)
    return (hour + F.make_dt_interval(mins=(F.minute(ts) / minutes).cast("int") * minutes)).cast("timestamp_ntz")


def unit_diff(unit: str, a: Column, b: Column) -> Column:
    """Number of unit boundaries between a and b (not elapsed time cut down)."""
    return F.timestamp_diff(unit, F.date_trunc(unit, a), F.date_trunc(unit, b))


def readable(n: Column) -> Column:
    """A count as text with two digits: 1234567 is 1.23 million."""
    two = lambda d, s: F.concat(F.format_string("%.2f", n / d), F.lit(s))
    return F.when(n >= 1e9, two(1e9, " billion")).when(n >= 1e6, two(1e6, " million")).when(n >= 1e3, two(1e3, " thousand")).otherwise(F.format_string("%.2f", n.cast("double")))


def number_or(text: Column, default: float | None) -> Column:
    """text as a double; default where it is no number."""
    out = text.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def plain(text: Column) -> Column:
    """Text form of an optional value: null is empty, booleans are true and false."""
    return F.coalesce(text.cast("string"), F.lit(""))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits as C and DuckDB round it: x * 10^digits goes to the next whole number, halves away from zero. F.round()
    rounds the decimal form of x, and so takes 28.049999999999997 to 28.0 where this takes it to 28.1; a zero keeps its sign."""
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < 0.5, x * F.lit(0.0)).when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def epoch_ms(seconds: Column) -> Column:
    """Epoch seconds as a timestamp cut to milliseconds."""
    return F.timestamp_micros((F.floor(seconds * 1000) * 1000).cast("long")).cast("timestamp_ntz")


def within(x: Column, lo: float, hi: float) -> Column:
    """Half-open range."""
    return (x >= lo) & (x < hi)


def band(freq: Column, bands: list[tuple[str, int, int]]) -> Column:
    """The first band (inclusive) that holds freq, null if none."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        out = F.when(freq.between(lo, hi), F.lit(name)).otherwise(out)
    return out
