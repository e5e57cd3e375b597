"""Groups of near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or
more, linked to whole components.

Shingles are made as in simhash (words of the bytes after lower-casing A-Z; fewer words than five: all of
them; none: no shingle), as a set of XXH64. Equal sets are one node. Candidates are first the nodes of one SimHash
group: fingerprints of the sets, linked by simhash.links() at 3 or fewer differing bits. At a similarity of 0.8 some ten
bits differ, so nodes that share one of BANDS keys, each the hash of ROWS minimum hashes, are candidates too: of
pairs at exactly 0.8 one in 300,000 shares none (0.59 ** 24), of more similar ones fewer. Every link is then
verified on the sets themselves, so no pair under 0.8 is linked.

Keys with the same nodes are one group. First each node is searched in its SimHash group only, or where it is alone there
in the largest of its groups; groups all of whose nodes are in one component after that are done, and so are most. The others are searched whole. A search
is a spanning forest of a group's links, never all pairs; nodes already in one component are not compared. A group of
more than GROUP nodes is first dealt into blocks which all hold its least node; what is
not connected to that node afterwards then meets all of the group, block by block.

Defined results: a null text has no words; texts without words are copies of each other; a null id takes
part; repeated rows each get their row; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import in_few_files, sliced
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
GROUP = 1024
_RNG = np.random.default_rng(42)
_MUL, _ADD = (_RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_MUL |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, as signed longs; none of the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def _fingerprint(hashes: np.ndarray) -> int:
    return simhash.majority(hashes.astype(">u8").tobytes())


def prints(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, text_hash, node, fp, keys): text_hash is Spark's xxhash64 of the text, fp the SimHash of its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, 1000):
            sets = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "node": np.array([_node(s) for s in sets], np.int64), "fp": np.array([_fingerprint(s) for s in sets], np.int64), "keys": [band_keys(s) for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("id", F.col("id").cast("string"))  # pandas has no long with nulls
    return rows.mapInPandas(run, "id string, text_hash long, node long, fp long, keys array<long>").withColumn("id", F.col("id").cast("long"))


def sets_of(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in wanted(id, node), made from the texts of these ids again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, 1000):
            sets = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"node": np.array([_node(s) for s in sets], np.int64), "hashes": [s.tobytes() for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(wanted.select(F.col("id").alias("_id")).distinct(), F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    return rows.mapInPandas(run, "node long, hashes binary").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def similar(sets: list[np.ndarray]):
    """f(at, others): which of the others are at least SIMILARITY to set `at`."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    first = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(code.max(initial=-1)) + 1, np.int64)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        fit = others[(np.minimum(size[others], size[at]) >= SIMILARITY * np.maximum(size[others], size[at])) & (size[others] > 0)]
        if not len(fit):
            return fit
        mark[code[first[at] : first[at + 1]]] = 1
        both = np.array([mark[code[first[o] : first[o + 1]]].sum() for o in fit])
        mark[code[first[at] : first[at + 1]]] = 0
        return fit[5 * both >= 4 * (size[fit] + size[at] - both)]

    return near


def linked(d: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links of a group(node, root, hashes, side) that connect what all its links do, where nodes of one root
    are connected already. Where sides are 1 and 2, only pairs of both sides count."""
    nodes, root, side = d["node"].to_numpy(), d["root"].to_numpy(), d["side"].to_numpy()
    near = similar([np.frombuffer(h, np.uint64) for h in d["hashes"]])
    a, b = [], []
    if side.any():
        ones, twos = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        for at in ones:
            met = near(at, twos[root[twos] != root[at]])
            a += [nodes[at]] * len(met)
            b += nodes[met].tolist()
    else:
        left, queue = np.arange(len(nodes)), []
        while len(left):
            if not queue:
                queue.append(left[0])
                left = left[1:]
            at = queue.pop()
            same = root[left] == root[at]
            met = near(at, left[~same])
            queue.extend(left[same])
            queue.extend(met)
            left = left[~same & ~np.isin(left, met)]
            a += [nodes[at]] * len(met)
            b += nodes[met].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _search(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of groups(key, i, j, node, root, side)."""
    return groups.join(sets, "node").groupBy("key", "i", "j").applyInPandas(lambda d: linked(d), "a long, b long")


def _dealt(members: DataFrame, group: int) -> DataFrame:
    """Groups for _search() of members(key, node, root, n, least): whole ones, or blocks that all hold the least node."""
    blocks = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    at = F.when(F.col("node") == F.col("least"), every).otherwise(F.array(own))
    return members.withColumn("i", F.explode(at)).select("key", "i", F.lit(0).alias("j"), "node", "root", F.lit(0).alias("side"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return members.drop("root").join(named, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")


def links(nodes: DataFrame, sets_for, group: int = GROUP) -> DataFrame:
    """(a, b): verified links that connect what all links of nodes(node, keys, distinct) do; sets_for gives
    (node, hashes) of a frame of nodes. Nodes may have a column simhash, a key to be searched before the others."""
    keyed = nodes.select("node", F.explode("keys").alias("key"), F.lit(False).alias("first"))
    if "simhash" in nodes.columns:
        keyed = keyed.union(nodes.select("node", "simhash", F.lit(True)))
    keyed = keyed.distinct()
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), same[0].alias("x"), same[1].alias("y"), F.max("first").alias("first")).where("n > 1")
    found = in_few_files(found.groupBy("n", "least", "x", "y").agg(F.min("key").alias("key"), F.max("first").alias("first")))
    members = in_few_files(keyed.drop("first").join(found.select("key", "n", "least", "first"), "key"))
    sets = in_few_files(sets_for(members.select("node").distinct()))

    # each node in its SimHash group, or the largest of its groups
    own = members.groupBy("node").agg(F.max(F.struct("first", "n", "key")).alias("m")).select("node", F.col("m.key").alias("key"))
    sizes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    first = own.join(sizes, "key").withColumn("root", F.col("node"))
    met = in_few_files(_search(_dealt(first, group), sets))
    members = _rooted(members, in_few_files(components(met)))
    open_ = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = in_few_files(members.join(open_, "key"))
    met = met.union(in_few_files(_search(_dealt(members, group), sets)))
    hot = members.where(F.col("n") > group)
    if not hot.limit(1).count():
        return met

    # large groups: what is not connected to the least node meets all others of the group
    blocks = F.ceil(F.col("n") / group).cast("int")
    named = in_few_files(_rooted(hot, in_few_files(components(met))).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")))
    heads = named.where("node = least").select("key", F.col("root").alias("head"))
    rest = named.join(heads, "key").where("root <> head")
    tried = rest.groupBy("key").agg(F.collect_set("own").alias("tried"))  # at most n / group numbers a key
    ones = rest.select("key", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), "node", "root", F.lit(1).alias("side"))
    twos = named.join(tried, "key").select("key", F.explode("tried").alias("i"), F.col("own").alias("j"), "node", "root", F.lit(2).alias("side"))
    return met.union(_search(ones.union(twos), sets))


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """nodes(fp) with a column simhash, one key for all whose fingerprints are connected by links of 3 or fewer bits."""
    roots = components(simhash.links(nodes.select("fp").distinct()))
    named = roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    key = F.xxhash64(F.lit("simhash"), F.coalesce("_root", "fp")).alias("simhash")
    return nodes.join(named, F.col("fp") == F.col("_fp"), "left").select(*nodes.columns, key)


def near_copies(docs: DataFrame, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """(id, text_hash, component) for each row of docs: rows of one component are near copies."""
    rows = in_few_files(prints(docs, id_col))
    nodes = in_few_files(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    found = links(simhash_groups(nodes).select("node", "keys", "simhash"), lambda some: sets_of(docs, id_col, nodes.join(some, "node", "left_semi").select("id", "node")), group)
    roots = components(found)
    named = roots.select(F.col("node").alias("_node"), "root")
    return rows.join(named, rows.node == named["_node"], "left").select("id", "text_hash", F.coalesce("root", "node").alias("component"))
