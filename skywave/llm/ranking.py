"""Ranked lexical search: exact top lists from max trees over document ranges, by best-first branch and bound.

Documents are cut into ranges of RANGE rows in the order of the scan. A range holds the counts of the queries' terms
only; over it stands one tree for each term: LEAF documents a leaf, FAN children a node, and each node holds the
greatest impact of the term below it. A query's bound at a node is the sum of its terms' weighted maxima. From a queue the
node of the greatest bound is opened: inner nodes give their children, leaves the scores of their documents. The
search of a range ends when no bound reaches the k-th best score; a node whose bound equals it is still opened, as a
smaller id wins a tie. The k-th best score of a task goes on from range to range, so that later ones are often done
at their roots. Each task gives k rows a query at most, and a window takes the k best of these.

Queries are taken in blocks of at most BLOCK_TERMS distinct terms (or one query), collected on the driver: a block is
what is broadcast. For each block the documents are scanned once and their ranges written to the shared checkpoint
folder, as weights and impacts need counts of all documents first.

A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact 10**9 tf div (1000 tf + 8 m), with m of
10 + 90 n N div L for a document of n terms; N documents with terms have L together.

Defined results: null and empty texts have no terms; queries without terms have no rows; rows of null or repeated
ids are documents like others (null last among equal scores); queries that are repeated with the same text count once,
with other texts each is ranked by itself. Extra columns are ignored; no documents or no queries give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANGE, LEAF, FAN = 2048, 32, 8
BLOCK_TERMS = 16_384
SLICE_BYTES = 4_000_000
K = 10

# what separates terms becomes a space, A-Z lower case; bytes over 127 stay
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def _terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts, one after another, and the text of each."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    lists = pc.ascii_split_whitespace(pa.array(folded, pa.large_binary()).cast(pa.large_string(), safe=False))
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)]


def _counts(texts: list[str | None], terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text), and (text, term, count) of the given terms."""
    size, found, at, many = np.zeros(len(texts), np.int64), [], 0, len(terms)
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held < SLICE_BYTES):
            held += len(texts[end] or "")
            end += 1
        flat, row = _terms(texts[at:end])
        size[at:end] = np.bincount(row, minlength=end - at)
        if len(flat):
            code = pc.dictionary_encode(flat)
            known = pc.fill_null(pc.index_in(code.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
            term = known[code.indices.to_numpy()]
            both, n = np.unique(row[term >= 0] * many + term[term >= 0], return_counts=True)
            found.append((both // many + at, both % many, n))
        at = end
    doc, term, n = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return size, doc, term, n


def _ranges(batches: Iterator[pa.RecordBatch], terms: pa.Array, rows: int) -> Iterator[pa.RecordBatch]:
    """The index of each range of rows, as arrays in bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0

    def done() -> pa.RecordBatch:
        at = np.append(0, np.cumsum([len(h[0]) for h in held]))
        held[:] = [(i, e, s, d + a, t, n) for (i, e, s, d, t, n), a in zip(held, at, strict=False)]
        packed = [np.concatenate(c).astype(kind).tobytes() for c, kind in zip(zip(*held), _INDEX.values(), strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed], names=list(_INDEX))

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, min(rows - n_held, b.num_rows - at))
            ids = part.column("id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), *_counts(part.column("text").to_pylist(), terms)))
            at, n_held = at + part.num_rows, n_held + part.num_rows
            if n_held == rows:
                yield done()
                n_held = 0
    if n_held:
        yield done()


#: columns of an index, each an array: of a document its id, whether that is null, its number of terms; of a count its document, term and number
_INDEX = {"ids": "<i8", "none": "?", "size": "<i8", "doc": "<i4", "term": "<i4", "n": "<i8"}


def _read(b: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """Some columns of each range of a batch."""
    for values in zip(*(b.column(c) for c in names), strict=True):
        yield [np.frombuffer(v.as_buffer(), _INDEX[c]) for c, v in zip(names, values, strict=True)]


class Tree:
    """A range's impacts, and above them the greatest ones of leaves, inner nodes and all."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        self.leaf, self.fan, self.docs = leaf, fan, docs
        self.terms, row = np.unique(term, return_inverse=True)
        level = np.zeros((len(self.terms), -(-max(docs, 1) // leaf) * leaf), np.int32)
        level[row, doc] = impact
        self.levels = [level]
        while level.shape[1] > 1 or len(self.levels) == 1:
            width = leaf if len(self.levels) == 1 else fan
            level = np.pad(level, ((0, 0), (0, -level.shape[1] % width)))
            self.levels[-1] = level
            level = level.reshape(len(level), level.shape[1] // width, width).max(axis=2)
            self.levels.append(level)

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, none: np.ndarray, best: list[tuple], k: int) -> int:
        """Adds the documents of a query to best: its k greatest (score, not null, -id), as a heap. The number of nodes opened."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at, weights, opened = at[there], weights[there], 0
        if not len(at):
            return 0
        top = len(self.levels) - 1
        queue = [(-int(weights @ self.levels[top][at, 0]), top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break
            opened += 1
            width = self.leaf if level == 1 else self.fan
            sums = weights @ self.levels[level - 1][at, node * width : (node + 1) * width]
            least = best[0][0] if len(best) == k else 1
            for j in np.flatnonzero(sums >= max(least, 1)).tolist():
                place, score = node * width + j, int(sums[j])
                if level > 1:
                    heapq.heappush(queue, (-score, level - 1, place))
                    continue
                row = (score, not none[place], -int(ids[place]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return opened


def _blocks(queries: DataFrame, most: int) -> Iterator[list]:
    """Queries (item, terms) in blocks of at most so many terms, or one query: one block on the driver at a time."""
    dealt = cut_lineage(queries.withColumn("h", F.xxhash64("item", "text")))
    n = -(-(dealt.agg(F.sum(F.size("terms"))).first()[0] or 0) // most)
    for block in range(n):
        rows, held = [], 0
        for r in dealt.where(F.pmod("h", F.lit(n)) == block).orderBy("h", "item", "text").toLocalIterator():
            if rows and held + len(r.terms) > most:
                yield rows
                rows, held = [], 0
            rows.append((r.item, sorted(r.terms)))
            held += len(r.terms)
        if rows:
            yield rows


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_terms: int = BLOCK_TERMS, range_rows: int = RANGE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 of each query, by score and id."""
    spark = docs.sparkSession
    # only A-Z: lower() would change other letters too
    folded = F.translate(F.col(query_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    q = queries.select(F.col(item_col).alias("item"), F.col(query_col).cast("string").alias("text"), F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms"))
    q = q.where(F.size("terms") > 0).distinct()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = q.schema["item"].dataType.simpleString()
    out = None
    for block in _blocks(q, block_terms):
        found = _search(spark, d, block, k, range_rows)
        items = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(block)], f"q long, item_id {kind}")
        found = found.join(F.broadcast(items), "q").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _search(spark: SparkSession, docs: DataFrame, block: list[tuple], k: int, range_rows: int) -> DataFrame:
    words = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(words)}
    shared = spark.sparkContext.broadcast(words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ranges(batches, pa.array(shared.value, pa.large_string()), range_rows)

    ranges = cut_lineage(docs.mapInArrow(index, ", ".join(f"{c} binary" for c in _INDEX)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_, terms_ = np.zeros(len(shared.value), np.int64), 0, 0
        for b in batches:
            for size, term in _read(b, "size", "term"):
                df += np.bincount(term, minlength=len(df))
                docs_ += int((size > 0).sum())
                terms_ += int(size.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2]), pa.array([*df[at].tolist(), docs_, terms_])], names=["term", "n"])

    totals = {r.term: r.n for r in ranges.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # BLOCK_TERMS rows and two
    n_docs, n_terms = totals.get(-1, 0), totals.get(-2, 0)
    weight = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * totals.get(i, 0) + 1)))) for i in range(len(words))], np.int64)
    asked = spark.sparkContext.broadcast([np.array([number[t] for t in terms], np.int64) for _, terms in block])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.value]
        for b in batches:
            for ids, none, size, doc, term, n in _read(b, *_INDEX):
                m = 10 + 90 * size * n_docs // max(1, n_terms)
                tree = Tree(len(ids), doc, term, 1_000_000_000 * n // (1000 * n + 8 * m[doc]))
                for own, terms in zip(best, asked.value, strict=True):
                    tree.search(terms, weight[terms], ids, none, own, k)
        rows = [(q, score, -at if there else None) for q, own in enumerate(best) for score, there, at in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["q", "score", "doc_id"])

    found = ranges.mapInArrow(search, "q long, score long, doc_id long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SPLIT = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, {_SPLIT} AS ts FROM documents),
sizes AS (SELECT doc_id, len(ts) AS n FROM words WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_SPLIT}) AS t FROM benchmark)),
counts AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY t, docs),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM counts JOIN asked USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), total GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10"""
