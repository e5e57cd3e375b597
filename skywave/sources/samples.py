"""Power spectra and clipping of raw IQ captures (interleaved unsigned bytes), by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_power(iq: bytes, fft_size: int = 1024) -> np.ndarray:
    """Power of each bin, lowest frequency first; captures shorter than one transform raise."""
    raw = np.frombuffer(iq, np.uint8)
    if len(raw) < 2 * fft_size:
        raise ValueError(f"a capture has {len(raw)} bytes; {2 * fft_size} are needed")
    x = (raw[: 2 * fft_size].astype(np.float64) - 127.5) / 127.5
    spectrum = np.fft.fftshift(np.fft.fft((x[0::2] + 1j * x[1::2]) * np.hanning(fft_size)))
    return np.abs(spectrum) ** 2 / fft_size


def clip_fraction(iq: bytes) -> float:
    raw = np.frombuffer(iq, np.uint8)
    return float(((raw == 0) | (raw == 255)).mean()) if len(raw) else 0.0


def capture_files(spark: SparkSession, path: str, capture_bytes: int, pattern: str = "*.iq") -> DataFrame:
    """Recordings as captures of capture_bytes: (path, capture, iq), in the order of the recording; what is left at its end, and
    shorter, is no capture. A row of the source is a file, so recordings are files of bounded size (2 GB is Spark's limit); their captures
    are cut on the JVM and dealt out before they go on."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where(F.col("length") >= capture_bytes)
    n = F.floor(F.col("length") / capture_bytes)
    d = d.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("capture"))
    d = d.select("path", "capture", F.substring("content", (F.col("capture") * capture_bytes + 1).cast("int"), F.lit(capture_bytes)).alias("iq"))
    return d.repartition("path", "capture")


def swept_bins(captures: DataFrame, keys: list[str], sample_rate: int, out_hz: int, fft_size: int = 1024) -> DataFrame:
    """Bins of each tile's captures(keys, center_hz, iq): spectra, their mean in linear power, decibels and bins of out_hz: (keys,
    center_hz, freq_hz, power_dbfs). Captures shorter than one transform are left out, as they have no spectrum."""
    d = captures.where(F.octet_length("iq") >= 2 * fft_size).select(*keys, "center_hz", power_spectrum(fft_size)("iq").alias("power"))
    d = mean_power(d, [*keys, "center_hz"]).withColumn("db", to_db(F.col("power")))
    return downsample(d, "db", "center_hz", sample_rate, out_hz, fft_size).select(*keys, "center_hz", "freq_hz", "power_dbfs")


def swept_health(captures: DataFrame, keys: list[str], threshold: float = 0.05) -> DataFrame:
    """sweep_rollup() of captures(keys, center_hz, iq)."""
    d = captures.select(*keys, F.col("center_hz").alias("tile_hz"), clipping(threshold)("iq").alias("c")).select(*keys, "tile_hz", "c.*")
    return sweep_rollup(d, keys)


def power_spectrum(fft_size: int = 1024):
    """UDF: captures to arrays of linear power."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: linear_power(x, fft_size))

    return F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)


def clipping(threshold: float = 0.05):
    """UDF: (fraction, clipped) of captures; clipped is strictly over threshold."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b.map(clip_fraction).astype(float)
            yield pd.DataFrame({"fraction": f.round(4), "clipped": f > threshold})

    return F.pandas_udf(run, "fraction double, clipped boolean", F.PandasUDFType.SCALAR_ITER)


def to_db(power: Column) -> Column:
    """Decibels of linear powers, not under -200."""
    return F.transform(power, lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-20))))


def mean_power(captures: DataFrame, keys: list[str], power: str = "power") -> DataFrame:
    """Captures averaged bin by bin in linear power: (keys, power)."""
    d = captures.select(*keys, F.posexplode(power).alias("pos", "p")).groupBy(*keys, "pos").agg(F.avg("p").alias("p"))
    d = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("a"))
    return d.select(*keys, F.transform("a", lambda x: x.p).alias(power))


def downsample(df: DataFrame, power_db: str, center: str, sample_rate: int, out_hz: int, n_bins: int) -> DataFrame:
    """Bins of out_hz: means of k bins in linear power, in dB with one decimal; the last may be partial.
    A bin's frequency is that of the middle one of its k."""
    bin_hz = sample_rate / n_bins
    k = max(1, int(out_hz / bin_hz))
    part = lambda i: F.slice(F.col(power_db), i * k + 1, F.lit(k))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x / 10)) / F.size(a)
    starts = F.sequence(F.lit(0), F.lit((n_bins - 1) // k))
    one = lambda i: F.struct((F.col(center) - sample_rate / 2 + (i * k + k // 2) * bin_hz).cast("long").alias("freq_hz"), F.round(10 * F.log10(F.greatest(mean(part(i)), F.lit(1e-20))), 1).alias("power_dbfs"))
    return df.withColumn("b", F.explode(F.transform(starts, one))).select("*", "b.*").drop("b")


def sweep_rollup(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Clipping of a sweep's tiles (tile_hz, fraction, clipped): counts and the first worst tile."""
    return tiles.groupBy(*keys).agg(F.count("*").alias("total_captures"), F.count_if("clipped").alias("clipped_captures"), F.max("fraction").alias("max_clip_fraction"), F.max_by("tile_hz", F.struct("fraction", -F.col("tile_hz"))).alias("worst_clip_freq_hz"))
