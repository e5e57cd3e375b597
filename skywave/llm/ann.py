"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared
priority queue, and exact reranking of the leaves' vectors.

Equal vectors are one point with its k + 1 smallest ids, which is all that a list of k can show of
them (ties go to smaller ids). Trees are fitted on at most sample_rows points, those of the least
hash: a node splits at the median of the projection on the line between two centres. All points are
then routed to a leaf of each tree. The forest is broadcast; its size is bounded by trees * 2**depth *
dim * 4 bytes, depth by max_depth. A query takes leaves of all trees from one queue, by the squared margins
at which the path turned away from it, added up (the bound of the distance to the leaf where planes are at right
angles), until these hold search_share times as many points as there are; a point counts in each tree, so a
share of 0.9 of three trees meets some 0.63 of the points. Vectors without structure need a
large share for a recall of 0.9, clustered ones a small one: it is a parameter, and measured. At a share of 1 or
more an exact scan of all pairs, leaf by leaf, costs no more than this search.

Leaves meet their queries in groups of at most block_rows points (leaves of more are cut by hash) and about block_rows
queries, and yield the k + 1 best of each query, so that no list of candidates is shuffled. Trees work on vectors
less the sample's mean; distances are those of the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than the first one (of the smallest id); null ids take no part; an
id that is repeated with other vectors is each of them; repeated rows count once; fewer than k
candidates give fewer rows, none give none. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, sliced

TREES = 3
LEAF = 512
MIN_DEPTH, MAX_DEPTH = 7, 14
SAMPLE_ROWS = 16_384
SEARCH_SHARE = 0.95
BLOCK_ROWS = 4096


def fit_forest(x: np.ndarray, trees: int, depth: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Normals (trees, 2**depth - 1, dim) and thresholds of complete trees; node i has 2i+1 and 2i+2."""
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    normals, cuts = np.zeros((trees, nodes, x.shape[1]), np.float32), np.zeros((trees, nodes))
    for t in range(trees):
        rows = {0: np.arange(len(x))}
        for i in range(nodes):
            own = rows.pop(i, np.empty(0, np.int64))
            if len(own) < 2:
                normals[t, i] = rng.standard_normal(x.shape[1])
                rows[2 * i + 1], rows[2 * i + 2] = own, own[:0]
                continue
            some = x[rng.choice(own, min(len(own), 256), replace=False)].astype(np.float64)
            a, b = some[0], some[1]
            for _ in range(4):  # two centres of the node's points
                near = ((some - a) ** 2).sum(1) <= ((some - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = some[near].mean(0), some[~near].mean(0)
            line = b - a
            normals[t, i] = line / (np.sqrt((line**2).sum()) or 1.0)
            at = x[own] @ normals[t, i]
            cuts[t, i] = np.median(at)
            left = at <= cuts[t, i]
            rows[2 * i + 1], rows[2 * i + 2] = own[left], own[~left]
    return normals, cuts


def route(x: np.ndarray, normals: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(n, trees): the leaf of each vector in each tree."""
    trees, nodes, _ = normals.shape
    out = np.empty((len(x), trees), np.int64)
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        while nodes and at[:1].size and at[0] < nodes:
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[t, at]) > cuts[t, at])
        out[:, t] = at - nodes
    return out


def search(q: np.ndarray, normals: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of the shared queue until they hold `enough` points."""
    trees, nodes, _ = normals.shape
    queue, out, held = [(0.0, t, 0) for t in range(trees)], [], 0
    while queue and held < enough:
        away, t, at = heapq.heappop(queue)
        while at < nodes:
            d = float(normals[t, at] @ q) - cuts[t, at]
            heapq.heappush(queue, (away + d * d, t, 2 * at + 1 + (d <= 0)))
            at = 2 * at + 1 + (d > 0)
        if sizes[t, at - nodes]:
            out.append((t, at - nodes))
            held += int(sizes[t, at - nodes])
    return out


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("vec", lambda v: v != 0))
    first = rows.agg(F.min_by(F.size("vec"), F.struct("id", "vec"))).first()[0]
    return rows.where(F.size("vec") == (first or 0))


def _block(least: np.ndarray, mark: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    mixed = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mark.astype(np.uint64)
    return ((mixed >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def rerank(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 points of `right` nearest to each query of `left`, ties by the least id. A product of matrices on vectors
    less their mean finds who can be among them, rounding allowed for; these are measured exactly."""
    out = []
    if len(left) and len(right):
        a, b = np.array(left["vec"].tolist()), np.array(right["vec"].tolist())
        least, mark, short = right["least"].to_numpy(), right["mark"].to_numpy(), min(len(b), k + 1)
        middle = b.mean(0)
        far_a, far_b = a - middle, b - middle
        norm = (far_b**2).sum(1)
        slack = 1e-12 * b.shape[1] * (norm.max() + (far_a**2).sum(1).max()) + 1e-13 * (np.abs(b).max() + np.abs(a).max()) ** 2
        for at in range(0, len(a), 256):
            rough = norm - 2 * far_a[at : at + 256] @ far_b.T
            last = np.partition(rough, short - 1, axis=1)[:, short - 1] + slack
            for i, own in enumerate((np.flatnonzero(~(r > f)) for r, f in zip(rough, last, strict=True)), at):  # all that tie with the last place
                d = np.sqrt(((b[own] - a[i]) ** 2).sum(1))
                best = np.lexsort((least[own], d))[: k + 1]
                out.append(pd.DataFrame({"q": left["q"].iloc[i], "q_mark": left["q_mark"].iloc[i], "least": least[own[best]], "mark": mark[own[best]], "score": d[best]}))
    none = pd.DataFrame({"q": [], "q_mark": [], "least": [], "mark": [], "score": []})
    return pd.concat(out) if out else none.astype({"q": "int64", "q_mark": "int64", "least": "int64", "mark": "int64", "score": "float64"})


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, min_depth: int = MIN_DEPTH, max_depth: int = MAX_DEPTH, sample_rows: int = SAMPLE_ROWS, search_share: float = SEARCH_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id satisfies is_query(id column)."""
    rows = cut_lineage(valid(vectors, id_col, vec_col).distinct())
    # a point's key is its least id and a hash, as an id may come with several vectors
    as_point = lambda d, name: d.groupBy("vec").agg(F.min("id").alias(name)).withColumn(f"{name}_mark", F.xxhash64("vec"))
    points = cut_lineage(as_point(rows, "least").withColumnRenamed("least_mark", "mark"))
    place_of = F.row_number().over(Window.partitionBy("vec").orderBy("id"))  # Spark cuts each task's rows of a vector to k + 1 before the exchange
    few = rows.withColumn("rn", place_of).where(F.col("rn") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ids = few.select(F.col("ids")[0].alias("least"), F.xxhash64("vec").alias("mark"), "ids")
    asked = rows.where(is_query(F.col("id")))
    searched = cut_lineage(as_point(asked, "q"))
    queries = asked.join(searched, "vec").select(F.col("id").alias("query_id"), "q", "q_mark")

    n, n_queries = points.count(), searched.count()
    sample = points.orderBy(F.xxhash64("least", "mark", F.lit(1)), "least", "mark").limit(sample_rows).toPandas()
    depth = int(min(max_depth, max(min_depth, np.ceil(np.log2(max(n, 1) / leaf)))))
    x = np.array(sample["vec"].tolist(), dtype=np.float64).reshape(len(sample), len(sample["vec"].iloc[0]) if n else 1)
    middle = x.mean(0) if len(x) else np.zeros(1)
    context = vectors.sparkSession.sparkContext
    forest = context.broadcast((middle, *fit_forest((x - middle).astype(np.float32), trees, depth)))
    q_blocks = max(1, -(-n_queries // block_rows))

    def leaves_of(column: pd.Series) -> np.ndarray:
        centre, normals, cuts = forest.value
        return route((np.array(column.tolist()) - centre).astype(np.float32), normals, cuts) + (np.arange(trees) << 32)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, 2000):
            at, found = np.unique(leaves_of(b["vec"]), return_counts=True)
            yield pd.DataFrame({"leaf": at, "n": found})

    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in points.select("vec").mapInPandas(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # at most trees * 2**depth rows
        sizes[r.leaf >> 32, r.leaf & 0xFFFFFFFF] = r.n
    size_of = context.broadcast(sizes)
    enough = search_share * n

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = np.maximum(1, -(-size_of.value // block_rows))
        for b in sliced(batches, 2000):
            at = leaves_of(b["vec"]).ravel()
            out = pd.DataFrame({"leaf": at, "least": np.repeat(b["least"].to_numpy(), trees), "mark": np.repeat(b["mark"].to_numpy(), trees), "vec": np.repeat(b["vec"].to_numpy(), trees)})
            out["block"] = _block(out["least"].to_numpy(), out["mark"].to_numpy(), blocks[at >> 32, at & 0xFFFFFFFF])
            yield out

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = np.maximum(1, -(-size_of.value // block_rows))
        centre, normals, cuts = forest.value
        for b in sliced(batches, 100):
            found = []
            for q, mark, v in zip(b["q"], b["q_mark"], b["vec"], strict=True):
                own = int(_block(np.array([q]), np.array([mark]), np.array([q_blocks]))[0])
                for t, at in search((np.asarray(v) - centre).astype(np.float32), normals, cuts, size_of.value, enough):
                    found += [(t << 32 | at, j, own, q, mark, v) for j in range(blocks[t, at])]
            yield pd.DataFrame(found, columns=["leaf", "block", "q_block", "q", "q_mark", "vec"])

    index = points.mapInPandas(place, "leaf long, block long, least long, mark long, vec array<double>")
    index = index.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    probes = searched.mapInPandas(probe, "leaf long, block long, q_block long, q long, q_mark long, vec array<double>")
    key = ["leaf", "block", "q_block"]
    met = probes.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(lambda left, right: rerank(left, right, k), "q long, q_mark long, least long, mark long, score double").distinct()
    # of points at one distance, those of smaller ids come first; k + 1 leave k besides the query's own
    named = met.join(ids, ["least", "mark"]).select("q", "q_mark", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q", "q_mark").orderBy("score", "vec_id"))
    named = named.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank")
    mine = queries.join(named, ["q", "q_mark"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q", "q_mark").orderBy("score", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
