"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses (DataFrame functions only).

Sections end after a blank line, paragraphs after a line feed, clauses (the leaves) after punctuation
or after a space that follows e or o; pieces keep their separators, so they join up to the text. Each
digest is the SHA-256 of its children's digests, a leaf's that of its text: equal roots mean equal
texts, and walking down unequal branches locates an edit.

The fingerprint is `root|section|section...`, a section `digest16:paragraph,paragraph...`, a
paragraph `digest16.leaves`, where leaves are the first 6 hex digits of each leaf's digest in order.
The likeness of two fingerprints is the share of distinct leaves that they have in common, of the
larger number of distinct leaves.

Defined results: a null text is the empty one (no leaves; alike only to another empty one); a null id comes after all others in
descending order; rows that share an id are ordered by their text's hash and text; a document that
is alone is its own next one; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, text_of

SECTION = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"(?<=\n)"
CLAUSE = r"(?<=[.!?,;:\n])(?![.!?,;:\n])|(?<=[eo]\x20)"
LEAF_DIGITS = 6
BLOCK_ROWS = 1024
MOST_BLOCKS = 32_768
SAMPLE = 32  # rows of the sample for each block


def _pieces(text: Column, regex: str) -> Column:
    return F.filter(F.split(text, regex, -1), lambda x: x != "")


def tree(text: Column) -> Column:
    """array of sections, each an array of paragraphs, each an array of the leaves' digests."""
    leaves = lambda p: F.transform(_pieces(p, CLAUSE), lambda c: F.sha2(c, 256))
    return F.transform(_pieces(text, SECTION), lambda s: F.transform(_pieces(s, PARAGRAPH), leaves))


def digests(nodes: Column) -> Column:
    """Of a tree(): array<struct<digest, paragraphs: array<struct<digest, leaves>>>>."""
    paragraph = lambda leaves: F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("digest"), F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, LEAF_DIGITS)), "").alias("leaves"))
    section = lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda p: p.digest), ""), 256).alias("digest"), s.alias("paragraphs"))
    return F.transform(F.transform(nodes, lambda s: F.transform(s, paragraph)), section)


def fingerprint(parts: Column) -> Column:
    """The string form of digests()."""
    root = F.sha2(F.array_join(F.transform(parts, lambda s: s.digest), ""), 256)
    short = lambda x: F.substring(x, 1, 16)
    body = F.transform(parts, lambda s: F.concat(short(s.digest), F.lit(":"), F.array_join(F.transform(s.paragraphs, lambda p: F.concat(short(p.digest), F.lit("."), p.leaves)), ",")))
    return F.concat(root, F.lit("|"), F.array_join(body, "|"))


def leaf_set(print_: Column) -> Column:
    """Distinct leaves that a fingerprint names: what stands between . and the next , | or end."""
    runs = F.array_join(F.regexp_extract_all(print_, F.lit(r"\.([0-9a-f]+)"), F.lit(1)), "")
    return F.array_distinct(F.filter(F.split(runs, rf"(?<=\G.{{{LEAF_DIGITS}}})", -1), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two leaf_set()s, 0 to 1."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint."""
    return docs.withColumn("fingerprint", fingerprint(digests(tree(text_of(text_col)))))


def _block(bounds: list, none: Column, key: Column, hash_: Column) -> Column:
    """How many bounds (none, key, hash) a row is not before, by bisection: the order is none, descending
    key, hash."""
    kinds = ("int", "bigint", "bigint")
    flat = [F.lit([int(b[i]) for b in bounds]).cast(f"array<{kinds[i]}>") if bounds else F.array().cast(f"array<{kinds[i]}>") for i in range(3)]

    def step(at, s):
        b_none, b_key, b_hash = (F.try_element_at(x, at + s) for x in flat)
        reached = (b_none < none) | ((b_none == none) & ((b_key > key) | ((b_key == key) & (b_hash <= hash_))))
        return F.when(reached, at + s).otherwise(at)  # past the last bound all are null

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))])
    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, print_: bool = False) -> DataFrame:
    """(id, text, next_text) by descending id, after the last the first; with print_ also each row's
    fingerprint and that of the next.

    Rows are dealt to ranges of about block_rows rows (MOST_BLOCKS ranges at most), whose bounds come from a
    sample of ids and hashes of texts, so that uneven or repeated ids make even ranges too; the sample decides the
    layout only. A window finds the next row within a range, and
    a copy of each range's first row is sent to the range before it, so that texts are shuffled once
    and no task sees more than a range.
    """
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), id_.isNull().cast("int").alias("none"), F.coalesce(id_, F.lit(0)).alias("key"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    n = docs.count()
    blocks = min(MOST_BLOCKS, -(-n // block_rows)) or 1
    share = min(1.0, SAMPLE * blocks / max(n, 1))
    sample = sorted((r.none, -r.key, r.hash) for r in rows.select("none", "key", "hash").sample(share, seed=1).collect()) if blocks > 1 else []  # some SAMPLE * blocks rows
    bounds = sorted({sample[i * len(sample) // blocks] for i in range(1, blocks)}) if len(sample) >= blocks else []
    rows = rows.withColumn("block", _block([(a, -b, c) for a, b, c in bounds], F.col("none"), F.col("key"), F.col("hash")))
    first = F.max(F.struct((-F.col("none")).alias("none"), "key", F.bitwise_not("hash").alias("hash"))).alias("first")
    heads = rows.groupBy("block").agg(first)
    # one row for each range, MOST_BLOCKS at most: a window orders them, and they are broadcast
    to = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sent = heads.select("block", (-F.col("first.none")).alias("none"), F.col("first.key").alias("key"), F.bitwise_not("first.hash").alias("hash"), to.alias("to"))
    ghosts = rows.join(F.broadcast(sent), ["block", "none", "key", "hash"]).select("id", "none", "key", "hash", "text", F.col("to").alias("block"), F.lit(True).alias("ghost"))
    both = rows.select("id", "none", "key", "hash", "text", "block", F.lit(False).alias("ghost")).unionByName(ghosts)
    if print_:
        both = both.repartition("block").withColumn("fingerprint", fingerprint(digests(tree(F.col("text")))))
    order = Window.partitionBy("block").orderBy("ghost", "none", F.desc("key"), "hash", "text")
    both = both.withColumn("next_text", F.lead("text").over(order))
    if print_:
        both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return both.where(~F.col("ghost")).drop("none", "key", "hash", "block", "ghost")


def edited(text: Column, other: Column) -> Column:
    """text with its last third of code points replaced by the first as many (or all) of other."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read(spark, sf_dir, "documents"))


def compared(docs: DataFrame, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of each document its fingerprint, that of its edited text, and its likeness to this and to the next document."""
    rows = with_next(docs, id_col, block_rows, print_=True)
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(digests(tree(F.col("edit")))).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    rows = rows.withColumn("own", leaf_set(F.col("fingerprint")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own"), leaf_set(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("own"), leaf_set(F.col("next_fingerprint"))).alias("near_next"),
    )
