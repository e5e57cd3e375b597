"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are a group and stay in one shard, unless the group has more bytes than a shard
can take; then it is cut into parts that fit, each a group. A group is
a vector (bytes, tokens, rows), each as a share of a shard's capacity, and goes to the shard where
the dot product with the residual capacity is highest, largest groups first.

Large groups (over 1 / FINE of a shard in some dimension: 3 * FINE * shards at most) are placed by
the driver; the rest are dealt by hash into parts, and each part is packed by its own task against
an equal slice of the capacity that is left, so that parts' imbalances, of the order of a small
group each, neither depend on one another nor grow with the input.

Law `bytes`: sizes (UTF-8 bytes of the text plus 8) of shards are near equal. Defined results: a null
text has no bytes and tokens and is its own group, apart from empty texts; repeated rows and null ids
are rows like any other; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read

SHARDS = 24
FINE = 200
PART_ROWS = 20_000


def place(groups: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shards of groups (n, 3), in the order given; residual (shards, 3) is what each can still take
    and is updated. Among shards that have bytes left for the whole group the dot product decides (a
    shard that is over in rows or tokens counts against itself); where none has, the most bytes left do."""
    out = np.empty(len(groups), np.int64)
    for i, g in enumerate(groups):
        fits = residual[:, 0] >= g[0] - 1e-12
        score = np.where(fits, residual @ g, -np.inf) if fits.any() else residual[:, 0]
        out[i] = at = int(score.argmax())
        residual[at] -= g
    return out


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(grp, size, tokens, ...) with a column shard."""
    totals = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    cap = [max(1.0, (totals[k] or 0) / shards) for k in ("size", "tokens", "n")]
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = F.greatest(F.col("size") / cap[0], F.col("tokens") / cap[1], F.col("n") / cap[2])
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("size") / cap[0]), F.col("n"))).cast("long")
    groups = cut_lineage(groups.withColumn("parts", parts).withColumn("share", share / parts))
    large = groups.where((F.col("share") > 1 / FINE) | (F.col("parts") > 1)).toPandas()  # 3 * FINE * shards rows at most
    left = np.ones((shards, 3))
    placed = []
    if len(large):
        large = large.loc[large.index.repeat(large["parts"])].sort_values(["share", "grp"], ascending=[False, True]).reset_index(drop=True)
        large["part"] = large.groupby("grp").cumcount()
        v = large[["size", "tokens", "n"]].to_numpy() / large[["parts"]].to_numpy() / np.array(cap)
        large["shard"] = place(v, left)
        placed = [tuple(r) for r in large[["grp", "part", "parts", "shard"]].astype("int64").itertuples(index=False)]
    spark = rows.sparkSession
    schema = "grp long, part long, parts long, shard long"
    big = spark.createDataFrame(placed, schema)
    small = groups.where((F.col("share") <= 1 / FINE) & (F.col("parts") == 1))
    n_small = small.count()
    n_parts = max(1, -(-n_small // PART_ROWS))
    weights = small.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    # each part's slice of the residual is in proportion to what is left to place, not to the capacity
    rest = np.array([float(x or 0) for x in weights]) / np.array(cap)
    over = left - (left.sum(0) - rest) / shards

    def pack(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["share", "grp"], ascending=[False, True])
        v = d[["size", "tokens", "n"]].to_numpy() / np.array(cap)
        room = over / np.maximum(over.sum(0), 1e-12) * v.sum(0)
        return pd.DataFrame({"grp": d["grp"], "part": 0, "parts": 1, "shard": place(v, room)})

    dealt = small.withColumn("p", F.pmod(F.xxhash64("grp", F.lit(3)), F.lit(n_parts)))
    found = dealt.groupBy("p").applyInPandas(pack, schema)
    if placed:
        few = F.broadcast(big.groupBy("grp").agg(F.max("parts").alias("parts"), F.map_from_entries(F.collect_list(F.struct("part", "shard"))).alias("to")))
        marked = rows.join(few, "grp", "left")
        own = marked.where("parts IS NOT NULL").withColumn("shard", F.element_at("to", F.pmod(F.xxhash64("row"), F.col("parts")))).drop("parts", "to")
        rest_rows = marked.where("parts IS NULL").drop("parts", "to").join(found.select("grp", "shard"), "grp")
        return own.unionByName(rest_rows)
    return rows.join(found.select("grp", "shard"), "grp")


def numbered(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(shard, row) with slot: gapless from 0 in each shard. Rows are numbered within blocks of a
    shard; a window over the blocks' counts (shards * blocks rows) gives each block its start."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return rows.withColumn("rank", rank).join(starts, ["shard", "block"]).withColumn("slot", F.col("first") + F.col("rank") - 1).drop("block", "rank", "first")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs."""
    text = F.col(text_col).cast("string")
    data = F.coalesce(text, F.lit("")).cast("binary")

    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
        words.alias("tokens"),
        F.xxhash64(F.lit(11), text).alias("second"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut_lineage(rows.withColumn("grp", F.xxhash64("grp", "second")).drop("second"))
    n = rows.count()
    return numbered(assign(rows, shards), max(1, n // 50_000)).select("id", "size", "text_crc32", "shard", "slot")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
