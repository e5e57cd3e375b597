"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (lower-cased, cut at white space, outer punctuation stripped): each word, its
leading 4, 5 and 6 characters (word forms of one stem), adjacent pairs and pairs around one word,
each hashed to 2**dims_log2 buckets and present or not. Per-coordinate rates follow the summed
squared gradients; L1 leaves few weights, so the model is a short table that is broadcast.

Training uses at most max_rows labelled rows: those of the least hash of id, so the sample is the
same on every run, and its ids are a bounded table that is broadcast to fetch their texts. Of the rows that have
these ids again max_rows are taken, and of these the first ones that have max_bytes of text together; a text of more than max_bytes is
passed over. They are
dealt over `shards` models by that hash, each trained by one task for `epochs` passes (max_bytes
bounds its memory), and the weights that survive in any are averaged. The bound on the broadcast is
2**dims_log2 rows of 16 bytes; L1 keeps it far below.

Defined results: null and empty texts have the bias as their score; null labels are not learned
from, and a repeated id's labels count once each; where all rows learned from have the same label, every score is
that label (within 1e-15), with none at all it is 0 (likewise). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, text_of

MAX_ROWS = 12_288
MAX_BYTES = 256_000_000
SHARDS = 1
DIMS_LOG2 = 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
THRESHOLD = 0.3
_PRE = (4, 5, 6)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pd.Series, dims_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a batch, repeats included. Each distinct word is hashed once."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts.fillna(""), type=pa.large_string())))
    row = pc.list_parent_indices(words).to_numpy()
    coded = pc.dictionary_encode(pc.utf8_trim(pc.list_flatten(words), characters=".,;:!?\"'()[]{}*#%&$<>«»¿¡…-_"))
    code = coded.indices.to_numpy()
    kinds = np.empty((len(coded.dictionary), 1 + len(_PRE)), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, w in enumerate(coded.dictionary.to_pylist()):
        kinds[i, 0] = digest(w, 1)
        for k, n in enumerate(_PRE, 1):
            kinds[i, k] = digest(w[:n], n) if len(w) > n else kinds[i, 0]
    shift = np.uint64(64 - dims_log2)
    h = kinds[code]
    rows, found = [np.repeat(row, 1 + len(_PRE))], [h.ravel()]
    for gap in (1, 2):
        a, b = h[:-gap, 0], h[gap:, 0]
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        found.append((a[same] * _MIX + b[same]) ^ np.uint64(gap))
    with np.errstate(over="ignore"):
        buckets = (np.concatenate(found) * _MIX) >> shift
    return np.concatenate(rows), buckets.astype(np.int64)


def train(rows: list[tuple[np.ndarray, float]], dims: int, epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights and bias of rows (distinct buckets, label)."""
    z, n = np.zeros(dims), np.zeros(dims)
    bz = bn = 0.0
    for _ in range(epochs):
        for at, label in rows:
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            b = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            s = (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA
            bz += g - s * b
            bn += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, float(-bz / ((BETA + np.sqrt(bn)) / ALPHA))


def fit(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, shards: int = SHARDS, dims_log2: int = DIMS_LOG2, epochs: int = EPOCHS) -> dict:
    """A model from docs(id, text) and labelled(id, label): {dims_log2, bias, bucket, weight}."""
    dims = 1 << dims_log2
    sample = labelled.where("id IS NOT NULL AND label IS NOT NULL").select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id", F.lit(7)).alias("h"))
    sample = sample.orderBy("h", "id", "label").limit(max_rows)
    rows = docs.select("id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(sample), "id")
    rows = rows.withColumn("h2", F.xxhash64("text")).orderBy("h", "id", "label", "h2").limit(max_rows)
    upto = Window.orderBy("h", "id", "label", "h2").rowsBetween(Window.unboundedPreceding, 0)  # over max_rows rows
    rows = rows.withColumn("sum", F.sum(F.octet_length("text")).over(upto)).where(F.col("sum") <= max_bytes).drop("sum", "h2")

    def learn(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["h", "label", "text"], kind="stable").reset_index(drop=True)
        if d["label"].nunique() == 1:
            return pd.DataFrame({"bucket": [-1], "weight": [35.0 if d["label"].iloc[0] else -35.0]})
        sets = []
        for at in range(0, len(d), 256):
            part = d.iloc[at : at + 256].reset_index(drop=True)
            row, bucket = features(part["text"], dims_log2)
            both = np.unique(row.astype(np.int64) << dims_log2 | bucket)
            cut = np.searchsorted(both >> dims_log2, np.arange(len(part) + 1))
            flat = (both & (dims - 1)).astype(np.int32)
            sets += [flat[cut[i] : cut[i + 1]] for i in range(len(part))]
        w, bias = train(list(zip(sets, d["label"].astype(float), strict=True)), dims, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(w[at], bias)})

    dealt = rows.withColumn("shard", F.pmod(F.shiftright("h", 32), F.lit(shards)))
    parts = dealt.groupBy("shard").applyInPandas(learn, "bucket long, weight double")
    found = cut_lineage(parts.groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    models = found.where("bucket = -1").first()
    if models is None:
        return {"dims_log2": dims_log2, "bias": -35.0, "bucket": np.empty(0, np.int64), "weight": np.empty(0)}
    kept = found.where("bucket >= 0").select("bucket", (F.col("weight") / models.n).alias("weight")).toPandas().sort_values("bucket")
    return {"dims_log2": dims_log2, "bias": models.weight / models.n, "bucket": kept["bucket"].to_numpy(), "weight": kept["weight"].to_numpy()}


def score_texts(texts: pd.Series, model: dict) -> np.ndarray:
    """Scores of a batch; only buckets with a weight are made distinct."""
    dims_log2 = model["dims_log2"]
    weight = np.zeros(1 << dims_log2)
    weight[model["bucket"]] = model["weight"]
    row, bucket = features(texts, dims_log2)
    hit = weight[bucket] != 0
    both = np.unique(row[hit].astype(np.int64) << dims_log2 | bucket[hit])
    sums = np.bincount(both >> dims_log2, weights=weight[both & ((1 << dims_log2) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(sums + model["bias"], -35, 35)))


def score(docs: DataFrame, model: dict, out_col: str = "score") -> DataFrame:
    """docs with a column of scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = [score_texts(b.iloc[at : at + 500].reset_index(drop=True), shared.value) for at in range(0, len(b), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(out_col, F.pandas_udf(run, "double", _scalar_iter())(text_of()))


def _scalar_iter():
    from pyspark.sql.functions import PandasUDFType

    return PandasUDFType.SCALAR_ITER


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def toxicity_model(docs: DataFrame, labels: DataFrame, **options) -> dict:
    """Fitted on the labelled rows of docs that are not held out."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).where(~held_out("id"))
    return fit(docs.select(F.col("doc_id").alias("id"), text_of().alias("text")), own, **options)


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), toxicity_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
