"""Language identification: nearest centroid of normalised TF-IDF vectors of character n-grams.

A text is lower-cased, whatever is no letter ends a word, and the letters, pairs and triples of a word (with its two
ends) are hashed to 2**dims_log2 buckets. Weights are 1 + log(count) times log of the inverse share of documents.
Each language has up to `clusters` centroids (spherical k-means; seeds are drawn by squared distance from a fixed generator, so
that a run gives what another one gave), and a text takes the language of the centroid of greatest cosine. Each centroid keeps the distance
(1 - cosine) of the farthest of its members: what is farther than that is rejected, if asked for.

Document frequencies are counted over all rows that may be learned from. Centroids are fitted on at most max_rows of
them for each language, those of the least hash of their ids, and of these on the first ones of max_bytes of text
together (the first one in any case): one task a language, with max_rows vectors. The model that is broadcast has
2**dims_log2 * 4 bytes for each centroid, and grows with the number of languages only. Texts are counted whole, in
parts of `CHUNK` characters that end at white space (a word without any is cut).

Defined results: null texts and those without a letter are `und` with score 0; texts that have letters but nothing in
common with any centroid get the language of most rows; without rows to learn from all are `und`. Null languages are
not learned, null ids are counted but not sampled; a repeated id's rows may all be learned. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, with_batches
from .toxicity import held_out

DIMS_LOG2 = 14
CLUSTERS = 4
MAX_ROWS = 1024
MAX_BYTES = 64_000_000
CHUNK = 1 << 20
GROUP = 256
UNKNOWN = "und"
BROADCAST_ROWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of CHUNK characters; what is longer in parts that end at white space."""
    rows, parts, size = [], [], 0
    for k, t in enumerate(texts):
        a, t = 0, t or ""
        while a < len(t):
            b = len(t)
            if b - a > CHUNK:
                b = max(t.rfind(c, a, a + CHUNK) for c in " \n") + 1 or a + CHUNK
            if size + b - a > CHUNK and rows:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(k)
            parts.append(t[a:b])
            size += b - a
            a = b
    if rows:
        yield rows, parts


def _grams(parts: list[str], dims_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, bucket) of each letter, pair and triple of parts of texts."""
    lower = [p.lower() for p in parts]
    code = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.append(0, np.repeat(np.arange(len(parts)), [len(p) + 1 for p in lower]))
    used = np.flatnonzero(np.bincount(code))
    letter = np.zeros(int(used[-1]) + 1, bool)
    letter[used] = [chr(c).isalpha() for c in used.tolist()]
    is_letter = letter[code]
    kept = is_letter.copy()
    kept[0] = True
    kept[1:] |= is_letter[:-1]  # what ends a word, once
    c, row = np.where(is_letter, code, 0)[kept].astype(np.uint64), row[kept]
    full = c > 0
    with np.errstate(over="ignore"):
        two = c[1:] * np.uint64(0x10001) + (c[:-1] << np.uint64(21)) + np.uint64(1 << 50)
        three = c[2:] * np.uint64(0x10001) + (c[1:-1] << np.uint64(21)) + (c[:-2] << np.uint64(42)) + np.uint64(1 << 63)
        some = [(row[full], c[full]), (row[1:], two), (row[2:][full[1:-1]], three[full[1:-1]])]
        bucket = np.concatenate([(g * _MIX ^ (g >> np.uint64(29))) * _MIX >> np.uint64(64 - dims_log2) for _, g in some])
    return np.concatenate([r for r, _ in some]), bucket.astype(np.int64)


def counts_of(texts: list[str | None], dims_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each bucket (a dense array of not too many texts), and which texts have letters."""
    dims = 1 << dims_log2
    total = np.zeros((len(texts), dims), np.float32)
    for rows, parts in _chunks(texts):
        part, bucket = _grams(parts, dims_log2)
        first, last = rows[0], rows[-1]
        at = np.array(rows)[part] - first
        total[first : last + 1] += np.bincount(at * dims + bucket, minlength=(last - first + 1) * dims).reshape(-1, dims)
    return total, total.any(axis=1)


def vectors_of(texts: list[str | None], idf: np.ndarray, dims_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors (zero for texts without letters), and which texts have letters."""
    x, there = counts_of(texts, dims_log2)
    on = x > 0
    x[on] = np.log(x[on]) + 1
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x, there


def centroids_of(x: np.ndarray, clusters: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of unit vectors, the number of their members and how far the farthest one is."""
    rng, seeds = np.random.default_rng(0), [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(clusters, len(x)):
        far = np.where(near > 1 - 1e-6, 0, 1 - near) ** 2  # copies of a seed are none
        if not far.any():
            break
        seeds.append(int(rng.choice(len(x), p=far / far.sum())))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for k in range(len(c)):
            mean = x[own == k].mean(axis=0) if (own == k).any() else c[k]
            c[k] = mean / (np.sqrt(mean @ mean) or 1)
    cosine = x @ c.T
    own = np.argmax(cosine, axis=1)
    size = np.bincount(own, minlength=len(c))
    far = np.array([1 - cosine[own == k, k].min() if size[k] else 0.0 for k in range(len(c))])
    return c[size > 0], size[size > 0], far[size > 0]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", dims_log2: int = DIMS_LOG2, clusters: int = CLUSTERS, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict:
    """A model of the rows of docs with a language: {dims_log2, idf, langs, centroids, reach}, the languages of most rows first."""
    dims = 1 << dims_log2
    d = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros(dims, np.int64), 0
        for b in batches:
            texts = b["text"].tolist()
            for at in range(0, len(texts), GROUP):
                x, there = counts_of(texts[at : at + GROUP], dims_log2)
                found += np.count_nonzero(x, axis=0)
                rows += int(there.sum())
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(found[at], rows)})

    seen = d.select("text").mapInPandas(frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**dims_log2 rows at most
    n = int(seen.loc[seen["bucket"] < 0, "n"].sum())
    df = np.zeros(dims)
    own = seen[seen["bucket"] >= 0]
    df[own["bucket"]] = own["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    counts = cut_lineage(d.groupBy("lang").agg(F.count("*").alias("rows")))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    # the least hashes are looked for among those under a bound that twice as many are expected to be under, so that no task
    # gets a language's ids
    under = F.pmod("h", F.lit(2**31)) * F.col("rows") < F.lit(2.0 * max_rows * 2**31)
    ids = d.where("id IS NOT NULL").select("lang", "id", F.xxhash64("id", F.lit(11)).alias("h")).join(small(counts), "lang").where(under)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**31)), "h", "id"))
    ids = cut_lineage(ids.withColumn("k", place).where(F.col("k") <= max_rows).select("lang", "id", "h").distinct())
    rows = d.join(small(ids), ["lang", "id"])
    tie = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    before = F.coalesce(F.sum(F.octet_length("text")).over(tie.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("k", F.row_number().over(tie)).withColumn("before", before).where((F.col("k") <= max_rows) & (F.col("before") < max_bytes))

    def cluster(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        texts = b.sort_values("k")["text"].tolist()
        x = np.zeros((len(texts), dims), np.float32)
        there = np.zeros(len(texts), bool)
        for at in range(0, len(texts), GROUP):
            x[at : at + GROUP], there[at : at + GROUP] = vectors_of(texts[at : at + GROUP], idf, dims_log2)
        if not there.all():
            x = x[there]
        c, size, far = centroids_of(x, clusters) if len(x) else (x, np.empty(0, np.int64), np.empty(0))
        return pd.DataFrame({"lang": key[0], "k": np.arange(len(c)), "n": size, "reach": far, "vector": [v.astype("<f4").tobytes() for v in c]})

    fitted = rows.groupBy("lang").applyInPandas(cluster, "lang string, k long, n long, reach double, vector binary")
    found = fitted.join(counts, "lang").toPandas().sort_values(["rows", "lang", "k"], ascending=[False, True, True])
    matrix = np.array([np.frombuffer(v, "<f4") for v in found["vector"]], np.float32).reshape(-1, dims)
    return {"dims_log2": dims_log2, "idf": idf, "langs": found["lang"].tolist(), "centroids": matrix, "reach": found["reach"].to_numpy(float)}


def nearest(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest centroid of each text (-1: no letters) and its cosine."""
    at, cosine = np.full(len(texts), -1), np.zeros(len(texts))
    for a in range(0, len(texts), GROUP):
        x, there = vectors_of(texts[a : a + GROUP], model["idf"], model["dims_log2"])
        if len(model["centroids"]):
            like = x @ model["centroids"].T
            best = np.argmax(like, axis=1)  # of equal ones the first: the language of more rows
            at[a : a + GROUP] = np.where(there, best, -1)
            cosine[a : a + GROUP] = np.where(there, np.clip(like[np.arange(len(x)), best], 0, 1), 0)
    return at, cosine


def identify(docs: DataFrame, model: dict, text_col: str = "text", into: str = "language", rejecting: bool = True) -> DataFrame:
    """docs with the column `into`: struct of lang, score (cosine of the nearest centroid) and far (farther from it than
    any of its members); if rejecting, what is far is `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        at, cosine = nearest(b.column(text_col).to_pylist(), m)
        reach = np.append(m["reach"], -1.0)[at]  # -1: the last
        far = 1 - cosine > reach + 1e-6
        names = np.array([*m["langs"], UNKNOWN], object)[np.where(far & rejecting, -1, at)]
        return [pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(cosine), pa.array(far)], names=["lang", "score", "far"])]

    return with_batches(docs.withColumn(text_col, F.col(text_col).cast("string")), into, "struct<lang: string, score: double, far: boolean>", run)


def op12_language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    # `und` is asked for where there is no letter, so what is far is said beside the language
    d = identify(docs.select("doc_id", "text"), model, rejecting=False)
    return d.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.far").alias("far"))
