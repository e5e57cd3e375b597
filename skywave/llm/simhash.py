"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: words are runs of other bytes than space and \\x09-\\x0d after lower-casing A-Z;
shingles are `words` words joined by spaces, repeats included (fewer words: all of them; none:
fingerprint 0); a bit is 1 if more than half of the shingles' XXH64 (seed 42) have it.

Links at 3 or fewer of 64 differing bits. A fingerprint is cut into segments of 23, 23 and 18 bits.
For a pair with (e1, e2, e3) differing bits in these:
- e3 = 0: one 23-bit segment differs in at most one bit. Key: segment 3, Golay key of the segment.
- e1 = 0 or e2 = 0: the other differs in at most 3 - e3 <= 2. Key: the equal one, Golay key of the other.
- otherwise each differs in one bit. Key: Golay key of segment 1, an equal half of 2, an equal half of 3.
Words within 2 bits share a Golay key, so some key is equal for every linked pair: none is missed.
About 42 keys of 30 bits or more a fingerprint; pairs of equal key are verified.

Work is on distinct fingerprints. A key that more than GROUP fingerprints share is split into pairs
of blocks, each its own group; a group yields a spanning forest of its links, never all pairs, so
rows stay in proportion to the fingerprints and no task holds more than two blocks of a key.

Defined results: a null text has no words; empty texts have fingerprint 0 and link like any other; a
null id takes part, and a component of null ids only has a null component_id; repeated rows each get
their row; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, in_few_files, read, sliced
from .components import components
from .golay import keys as golay_keys

BITS = 3
GROUP = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return majority(xxhash.xxh64_digest(b" ".join(found), 42))
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    return majority(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]))


def majority(digests: bytes) -> int:
    """The fingerprint of hashes of 8 bytes each, as a signed long: bits that more than half of them have."""
    n = len(digests) // 8
    ones = np.zeros(64, dtype=np.int64)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):  # very long texts: bits of 65,536 shingles at a time
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, 1000):
            yield pd.DataFrame({"id": b["id"], "fp": np.fromiter((fingerprint(t, words) for t in b["text"]), np.int64, len(b))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, fp long")


def fuzzy_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 48) keys of signed fingerprints; -1 where a fingerprint has fewer."""
    x = fp.astype(np.int64).view(np.uint64)
    one, two, rest = (x >> np.uint64(41)).astype(np.int64), (x >> np.uint64(18)).astype(np.int64) & 0x7FFFFF, x.astype(np.int64) & 0x3FFFF
    g1, g2 = golay_keys(one), golay_keys(two)
    out = []

    def add(kind: int, exact: np.ndarray, code: np.ndarray) -> None:
        out.append(np.where(code < 0, -1, (np.int64(kind) << 48) | (exact[:, None] << 12) | code))

    add(1, rest, g1)
    add(2, rest, g2)
    add(3, one, g2)
    add(4, two, g1)
    kind = 5
    for half in (two >> 11, two & 0x7FF):
        for part in (rest >> 9, rest & 0x1FF):
            add(kind, (half << 9) | part, g1)
            kind += 1
    return np.concatenate(out, axis=1)


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of one group."""
    left = np.arange(len(fp))
    a, b, queue = [], [], []
    u = fp.view(np.uint64)
    while len(left) or queue:
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        if not len(left):
            break
        near = np.bitwise_count(u[left] ^ u[at]) <= bits
        found = left[near]
        left = left[~near]
        queue.extend(found)
        a.append(np.full(len(found), at))
        b.append(found)
    if not a:
        return fp[:0], fp[:0]
    return fp[np.concatenate(a)], fp[np.concatenate(b)]


def _linker(bits: int):
    def flush(d: pd.DataFrame) -> pd.DataFrame:
        fp = d["fp"].to_numpy()
        g = np.concatenate(([True], np.any(d[["key", "i", "j"]].to_numpy()[1:] != d[["key", "i", "j"]].to_numpy()[:-1], axis=1)))
        first = np.flatnonzero(g)
        size = np.diff(np.append(first, len(fp)))
        a, b = [], []
        small = np.repeat(size <= 8, size)
        left = np.repeat(size, size) - (np.arange(len(fp)) - np.repeat(first, size))
        for shift in range(1, 8):
            at = np.flatnonzero(small & (left > shift))
            near = np.bitwise_count((fp[at] ^ fp[at + shift]).view(np.uint64)) <= bits
            a.append(fp[at[near]])
            b.append(fp[at[near] + shift])
        for s, n in zip(first[size > 8], size[size > 8], strict=True):
            x, y = forest(fp[s : s + n], bits)
            a.append(x)
            b.append(y)
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
        pairs.sort(axis=1)
        return pd.DataFrame(np.unique(pairs, axis=0), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the group that may go on in the next batch
        for d in batches:
            if not len(d):
                continue
            last = d.iloc[-1]
            open_ = (d["key"] == last["key"]) & (d["i"] == last["i"]) & (d["j"] == last["j"])
            if open_.all() and kept and kept[-1].iloc[-1][["key", "i", "j"]].tolist() == last[["key", "i", "j"]].tolist():
                kept.append(d)
                continue
            whole = pd.concat([*kept, d[~open_]])
            if open_.iloc[0] and kept and not (kept[-1].iloc[-1][["key", "i", "j"]].tolist() == last[["key", "i", "j"]].tolist()):
                whole = pd.concat(kept)
            kept = [d[open_]]
            if len(whole):
                yield flush(whole)
        if kept:
            yield flush(pd.concat(kept))

    return run


def links(fps: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all links of fps(fp, distinct) do."""
    if bits > 3:
        raise ValueError("the keys find pairs within 3 bits")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, 4000):
            fp = b["fp"].to_numpy()
            keys = fuzzy_keys(fp)
            keep = keys >= 0
            yield pd.DataFrame({"key": keys[keep], "fp": np.repeat(fp, keep.sum(axis=1))})

    keyed = fps.select("fp").mapInPandas(emit, "key long, fp long")
    keyed = in_few_files(keyed)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = in_few_files(keyed.join(counts, "key"))
    blocks = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    cold = shared.where(F.col("n") <= group).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    hot = shared.where(F.col("n") > group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    hot = hot.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = cold.union(hot).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInPandas(_linker(bits), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", words: int = 3, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    prints = cut_lineage(fingerprints(docs, id_col, words))
    least = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(least.select("fp"), bits))
    least = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(whole, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
