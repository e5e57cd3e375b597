"""Periodic runs of words: an all-lag scan of the array of word ids.

A run is a stretch of consecutive words with smallest period q and a length of at least least_words and of
least_exponent * q words that no neighbouring word extends. The array is compared with itself shifted by each
lag up to n / least_exponent, and the stretches of equal places are measured: `m` equal places at lag p are m + p
words of period p. A stretch of m places holds a multiple of m, so a lag is compared at the multiples of the
least m that makes a run, and in full only around those that agree: n log n comparisons for a text, not n * n.
A run of period q is met again at multiples of q, with the same start and length: the least lag is its period
(lengths of twice a period make it unique), and places that a known run explains are not measured again.

Documents are scanned in slices, one numpy comparison a lag for all of a slice, longest first, so that those with
enough words for a lag are a prefix. A document of more than 2 * lags words is dealt out: one task a range
of `lags` lags, and its runs meet by document (fewer than its words).

Defined results: null and empty texts have no words and no runs; texts in which all words are equal have one run;
repeated rows and null ids are rows like others; no rows give none. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read, scratch, text_of, with_batches

LEAST_WORDS = 12
LEAST_EXPONENT = 2
LAGS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4_000_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_FOUND = f"struct<n_words: bigint, runs: {_RUNS}, collapsed: string>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and where each text's begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    row = pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.searchsorted(row, np.arange(len(texts) + 1))


def _reach(x: np.ndarray, at: np.ndarray, lag: int, step: int, most: int, limit: int) -> np.ndarray:
    """How many places next to each of `at`, in one direction and up to `most`, equal those a lag on."""
    out = np.zeros(len(at), np.int64)
    live, width = np.arange(len(at)), 4
    while len(live) and most > 0:
        far = out[live, None] + np.arange(1, width + 1)
        place = at[live, None] + step * far
        inside = (far <= most) & (place >= 0) & (place < limit)
        place = np.clip(place, 0, limit - 1)
        same = inside & (x[place] == x[place + lag])
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[live] += n
        live = live[n == width]
        width = max(4, min(2 * width, 1_000_000 // max(1, len(live))))
    return out


def scan(x: np.ndarray, cut: np.ndarray, lo: int, hi: int, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, lag) of what repeats with each lag from lo to hi - 1. x holds the ids of documents, the longest first,
    which begin at cut and share no id. A run of a period under its lag may be among them if its own is under lo."""
    sizes, found = -np.diff(cut), []
    end_of, lag_of = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)  # of a known run at each word
    for p in range(lo, hi):
        length = max(exponent * p, least)
        limit = int(cut[np.searchsorted(sizes, -length, side="right")]) - p
        if limit <= 0:
            break
        m = length - p
        at = np.flatnonzero(x[:limit:m] == x[p : limit + p : m]) * m
        if not len(at):
            continue
        known = (end_of[at] > at + p) & (p % lag_of[at] == 0)
        right = np.minimum(m - 1, end_of[at] - p - 1 - at)
        right[~known] = _reach(x, at[~known], p, 1, m - 1, limit)
        head = np.append(0, 1 + np.flatnonzero((np.diff(at) > m) | (right[:-1] < m - 1)))
        tail = np.append(head[1:], len(at)) - 1
        new = ~np.logical_or.reduceat(known, head)
        head, tail = head[new], tail[new]
        start = at[head] - _reach(x, at[head], p, -1, m - 1, limit)
        end = at[tail] + right[tail] + 1 + p
        for a, b in zip(start[end - start >= length].tolist(), end[end - start >= length].tolist(), strict=True):
            found.append((a, b - a, p))
            own = end_of[a:b] < b
            end_of[a:b][own], lag_of[a:b][own] = b, p
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def least_lags(doc: np.ndarray, start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch once, with its least lag; by document, start and lag."""
    order = np.lexsort((lag, length, start, doc))
    doc, start, length, lag = (v[order] for v in (doc, start, length, lag))
    first = np.ones(len(doc), bool)
    first[1:] = (np.diff(doc) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    doc, start, length, lag = (v[first] for v in (doc, start, length, lag))
    order = np.lexsort((lag, start, doc))
    return tuple(v[order] for v in (doc, start, length, lag))


def _lists(doc: np.ndarray, start: np.ndarray, length: np.ndarray, lag: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(v) for v in (start, length, lag)], fields=list(_RUN)))


def _result(words: pa.Array, begin: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """What is returned of some documents, given their runs (document, start, length, period)."""
    doc, start, length, lag = runs
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, begin[doc] + start + lag, 1)
    np.add.at(step, begin[doc] + start + length, -1)
    kept = np.cumsum(step[:-1]) == 0
    at = np.append(0, np.cumsum(kept))[begin]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    n = len(begin) - 1
    return pa.StructArray.from_arrays([pa.array(np.diff(begin), pa.int64()), _lists(*runs, n), joined.cast(pa.string())], names=["n_words", "runs", "collapsed"])


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield texts.slice(a, b - a)
        a = b


def runs_of(texts: pa.Array, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> pa.Array:
    """All lags of each of some texts."""
    words, begin = words_of(texts)
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    cut = np.append(0, np.cumsum(size[order]))
    place = np.repeat(begin[order] - cut[:-1], size[order]) + np.arange(len(words))
    code = pc.dictionary_encode(words)
    x = np.repeat(np.arange(len(order)) * max(1, len(code.dictionary)), size[order]) + code.indices.to_numpy()[place]
    start, length, lag = scan(x, cut, 1, int(size.max(initial=0)) // exponent + 1, least, exponent)
    rank = np.searchsorted(cut, start, side="right") - 1
    return _result(words, begin, least_lags(order[rank], start - cut[rank], length, lag))


def periodic_runs(docs: DataFrame, text_col: str = "text", into: str = "periods", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT, lags: int = LAGS) -> DataFrame:
    """docs with the column `into`: struct of n_words, runs (array of start, length, period by start and period; words
    are numbered from 0) and collapsed (the words that no run holds after its first period, joined by one space)."""
    if least_exponent < 2 or least_words < 1 or lags < 1:
        raise ValueError("runs need a whole exponent of 2 or more, a word and a lag")
    row, lo, found = scratch(docs, "row", "lo", "found")

    def whole(b: pa.RecordBatch) -> list[pa.Array]:
        return [runs_of(s, least_words, least_exponent) for s in _slices(b.column(text_col), SLICE_BYTES)]

    def piece(b: pa.RecordBatch) -> list[pa.Array]:
        parts = []
        for k, at in enumerate(b.column(lo).to_pylist()):
            words, begin = words_of(b.column(found).slice(k, 1))
            x = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)
            start, length, lag = scan(x, begin, at, min(at + lags, len(x) // least_exponent + 1), least_words, least_exponent)
            parts.append(_lists(*least_lags(np.zeros(len(start), np.int64), start, length, lag), 1))
        return parts

    def met(b: pa.RecordBatch) -> list[pa.Array]:
        parts = []
        for k in range(b.num_rows):
            own = b.column(found).slice(k, 1).flatten()
            cols = [own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length", "period")]
            words, begin = words_of(b.column(text_col).slice(k, 1))
            parts.append(_result(words, begin, least_lags(np.zeros(len(own), np.int64), *cols)))
        return parts

    # a word takes two bytes at least, so words are counted only in texts that can have enough
    text = text_of(text_col)
    words = F.when(F.octet_length(text) >= 2 * least_exponent * lags, F.regexp_count(text, F.lit(WORD))).otherwise(0)
    long = words >= least_exponent * (lags + 1)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    one = with_batches(docs.where(~long), into, _FOUND, whole)
    many = cut_lineage(docs.where(long).withColumn(row, F.monotonically_increasing_id()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = many.select(row, text.alias(found), F.explode(F.sequence(F.lit(1), F.floor(words / least_exponent).cast("int"), F.lit(lags))).alias(lo)).repartition(n, row, lo)
    runs = with_batches(ranges, into, _RUNS, piece).groupBy(row).agg(F.flatten(F.collect_list(into)).alias(found))
    return one.unionByName(with_batches(many.join(runs, row), into, _FOUND, met).drop(row, found))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs; in a tenth of them, by a hash of the id, words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))

    def repeated(d: Column) -> Column:
        n = F.size(d.words).cast("long")
        a = d.g % n
        p = 1 + F.floor((n - a) / (3 + d.g % 8))
        word = lambda i: F.get(d.words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), word), " "))

    # the array is bound to a lambda's variable, else each of its words would make it again
    again = F.transform(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g"))), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(planted(read(spark, sf_dir, "documents")))
    runs = F.col("periods.runs")
    # greatest length, then smallest start, then smallest period
    top = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("a"), (-r.period).alias("p"))))
    line = F.transform(runs, lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    d = d.withColumn("top", top)
    return d.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("top.a")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(F.col("top.length") * 1000 / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periods.collapsed"), 256).alias("collapsed_sha256"),
        F.col("periods.n_words").alias("n_words"),
    )
