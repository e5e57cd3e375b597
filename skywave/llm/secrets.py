"""Secret scans by corpus-wide ownership frequency (DataFrame functions only).

Base kinds, each leftmost and non-overlapping: `assign` (a keyword, : or =, a value of 6 or more
characters), `access` (AKIA and 16 or more of A-Z0-9), `hex` (24 or more of 0-9a-f). Besides these,
any run of 20 or more of [A-Za-z0-9+/_-] with lower case, upper case and digits that no base span
meets is a candidate. Values of both are hashed; over all documents, the distinct repositories and
owners that hold a value are counted. A value of at most max_owners owners is live-looking; one
that more owners share is a widely copied example. Live-looking candidates become spans of kind
`owned`; base spans always stay, and are told apart in n_live and n_copied.

Matches become rows, so that a text with very many costs in proportion to their number: windows over a text's rows
place them (the running sum of the lengths of matches and of the pieces between them) and tell which
candidates meet a base span.

Offsets are code points, ends exclusive. Defined results: null text is empty (no spans); a null
owner or repository counts as one of its own; repeated rows each get their row; no rows give no
rows. Other columns are ignored. A value that very many rows hold is counted after a distinct per
task, and joined back by a sort-merge join whose large partitions Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, scratch, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With {16,} and {24,} the same as all runs with the short ones dropped: a run is taken whole.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
REGEX = [ASSIGN, ACCESS, HEX, CANDIDATE]
MAX_OWNERS = 2
MARK = "[SECRET]"
_MATCH = "array<struct<gap:int,len:int,kept:boolean,hash:bigint>>"


def matches(text: Column, kind: int) -> Column:
    """All matches of a kind in order: characters since the one before, length, whether it counts, and the
    hash of its value."""
    regex = REGEX[kind]
    gaps = F.split(text, regex, -1)
    value = (lambda m: F.regexp_extract(m, regex, 2)) if kind == 0 else (lambda m: m)
    kept = [lambda v: F.length(v) >= 6, lambda v: F.lit(True), lambda v: F.lit(True), lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")][kind]
    # zipped, as an array named inside a lambda is made again for each element; after the last match only a gap is left
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    found = F.transform(F.filter(pairs, lambda x: x.m.isNotNull()), lambda x: F.struct(x.gap, F.length(x.m).alias("len"), kept(value(x.m)).alias("kept"), F.xxhash64(value(x.m)).alias("hash")))
    return F.when(text.rlike(regex), found.cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def found_spans(docs: DataFrame, id_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """(id, text_hash, owner, repo, kind, start, end, hash) of base spans and of candidates that meet none."""
    text = text_of()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(*repo_cols).alias("repo"), *[matches(text, k).alias(f"m{k}") for k in range(4)])
    some = reduce(lambda a, b: a | b, [F.size(f"m{k}") > 0 for k in range(4)])
    rows = cut_lineage(rows.where(some).withColumn("row", F.monotonically_increasing_id()))
    own = ["row", "id", "text_hash", "owner", "repo"]
    each = [rows.select(*own, F.lit(k).alias("kind"), F.posexplode(f"m{k}").alias("at", "m")) for k in range(4)]
    all_ = reduce(DataFrame.union, each).select(*own, "kind", "at", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("at")
    all_ = all_.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before).cast("int")).withColumn("start", F.col("end") - F.col("len")).where("kept")
    # a candidate meets a base span if one that begins before its end goes on beyond its start
    base = F.col("kind") < 3
    up_to = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    from_ = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    behind = F.coalesce(F.max(F.when(base, F.col("end"))).over(up_to), F.lit(-1)) > F.col("start")
    ahead = F.coalesce(F.min(F.when(base, F.col("start"))).over(from_), F.lit(2**31 - 1)) < F.col("end")
    met = all_.withColumn("met", behind | ahead)
    return met.where(base | ~F.col("met")).select("id", "text_hash", "owner", "repo", "kind", "start", "end", "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """One narrow row for each row of docs that has a base span or candidate:
    (id, text_hash, spans, n_live, n_copied); rows with equal id and text come once."""
    spans = cut_lineage(found_spans(docs, id_col, owner_col, repo_cols))
    held = spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    told = spans.drop("owner", "repo").distinct().join(held, "hash")
    live = F.col("owners") <= max_owners
    span = F.struct("start", "end", "kind", live.alias("live"), "owners", "repos")
    return told.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | live, span))).alias("spans"),
        F.count_if((F.col("kind") < 3) & live).alias("n_live"),
        F.count_if((F.col("kind") < 3) & ~live).alias("n_copied"),
    )


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s.kind), s.start, s.end)), ",")


def runs(spans: DataFrame, *key: str) -> DataFrame:
    """(key, runs): the maximal runs (start, end) of overlapping or touching spans(key, start, end), in order."""
    by = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("fresh", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("fresh").over(by))
    d = d.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return d.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def redacted(text: Column, runs_: Column, block: int = 1024) -> Column:
    """text with each of its runs (one at least) replaced by MARK. It is cut into blocks once, and what is between two runs
    comes from its own blocks: substring() counts characters from the start of what it is given."""

    def part(d: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int")
        own = F.array_join(F.slice(d.blocks, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(own, a - first * block + 1, b - a)).otherwise("")

    def marked(d: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(d.runs, i - 1).end)
        return F.concat(F.array_join(F.transform(d.runs, lambda r, i: part(d, before(i), r.start)), MARK), F.lit(MARK), part(d, F.element_at(d.runs, -1).end, d.n))

    # bound to a lambda's variable, so that the blocks are made once
    own = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"), runs_.alias("runs"), F.length(text).alias("n"))
    return F.transform(F.array(own), marked)[0]


def redact(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with live-looking secrets, base or owned, replaced by MARK; copied examples stay. Only rows
    that can hold a secret are shuffled; the columns stay as they are, n_chars follows the text."""
    text = text_of()
    suspect = reduce(lambda a, b: a | b, [text.rlike(r) for r in REGEX])
    id_, hash_, own = scratch(docs, "scan_id", "scan_hash", "scan_runs")
    live = scan(docs, id_col, **options).select("id", "text_hash", F.explode("spans").alias("s")).where("s.live").select("id", "text_hash", "s.start", "s.end")
    live = runs(live, "id", "text_hash").select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.col("runs").alias(own))
    rows = docs.where(suspect).join(live, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    rows = rows.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(redacted(text, F.col(own))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*docs.columns).unionByName(docs.where(~suspect))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs)
    keys = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"))
    rows = keys.join(found, keys.doc_id.eqNullSafe(found.id) & (keys.text_hash == found.text_hash), "left").drop(found.text_hash)
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return rows.withColumn("spans", spans).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s.kind < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
