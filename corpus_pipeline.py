"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next.

Toxic documents go; of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more, exact
copies included) the one of the least doc_id stays; strings of 200 bytes that start elsewhere too are cut out;
live-looking secrets are redacted; what is left is packed into sequences. All stages but the last
return the columns of documents as they got them, extra ones included; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywave.llm import nearcopies, packing, secrets, substrings, toxicity
from skywave.llm.common import checkpoint_folder, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the threshold; the model learns from labels of rows that are not held out."""
    model = toxicity.toxicity_model(docs, read(spark, sf_dir, "labels"))
    (own,) = scratch(docs, "toxicity")
    return toxicity.score(docs, model, own).where(F.col(own) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash groups, then MinHash bands for what few bits do not link, every link verified.
    One row of each group: that of the least doc_id, of rows that share this id the one of the least hash
    of its text. A null doc_id stays only where its group has no other."""
    groups = nearcopies.near_copies(docs).groupBy("component", "id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "n")).alias("first")
    id_, hash_, n = scratch(docs, "kept_id", "kept_hash", "kept_rows")
    kept = groups.groupBy("component").agg(first).select(F.col("first.id").alias(id_), F.col("first.text_hash").alias(hash_), F.col("first.n").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_))
    rows = docs.join(kept, same)
    repeated = rows.where(F.col(n) > 1).dropDuplicates(["doc_id", "text"])  # rows alike in both
    return rows.where(F.col(n) == 1).unionByName(repeated).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; a document of which nothing but white space is left goes."""
    (own,) = scratch(docs, "repeats")
    rows = substrings.remove_repeats(docs, into=own)
    removed = F.col(f"{own}.n_removed")
    rows = rows.withColumn("text", F.when(removed == 0, F.col("text")).otherwise(F.trim("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.where((removed == 0) | (F.col("text") != "")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither a learned model nor XXH64 fingerprints, byte strings of all texts or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared checkpoint folder, and goes when
    the next one is written. The last one's stays, as the frame reads it."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = at
    return docs
