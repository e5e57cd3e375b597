"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

A document's ids are cut into pieces of `capacity` at most (only the first may be shorter), and
pieces are packed into as few sequences as can be found. Full pieces are sequences of their own. The rest are dealt
into chunks of about chunk_rows pieces, so that every chunk has the same mix of lengths. Each chunk
is evolved on several islands, each a task with its own population of packings: crossover injects
whole well-filled sequences of one parent into the other, removes the sequences that hold the same
pieces, and the displaced ones replace pieces where they fill a sequence better, and are best-fitted; mutation does so
with the pieces of the emptiest sequences. A chunk whose first packing is at the lower bound (least_bins()) is not evolved. After each epoch
the elite of every island migrates to the next one of its chunk. Sequences of the best packing that
are at least `keep` full are final; the pieces of the others meet in fewer chunks in the next round,
until one chunk is left or a round has placed less than a tenth of its pieces (others of the same mix would not
fare better): then the best packing of every chunk is final.

A packing is held as lengths only; pieces of equal length are alike, so a chunk is its count of
pieces by length. Defined results: null and empty texts are one piece of the end id; repeated rows
and null ids are documents like any other; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, sliced

CAPACITY = 2048
END = 0
CHUNK_ROWS = 6000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 40
POPULATION = 6
STALL = 10
KEEP = 0.998
VOCABULARY = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks: the same ids, made faster
ADDED = "<|endoftext|>"  # its one added token, which the ranks lack: its string in a text is this id
ADDED_ID = 50256
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_WORDS = 400_000


def token_bytes(vocabulary: str = VOCABULARY):
    """text -> its ids as little-endian unsigned 32-bit numbers.

    A text is cut at each ADDED, then where a single space stands between two other characters: a token never
    goes over such a place, so each distinct piece is encoded once and kept (400,000 pieces at most)."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            out = np.array(encode(" " + word), dtype="<u4").tobytes()
            if len(self) >= _WORDS:
                self.clear()
            self[word] = out
            return out

    known, added = Known(), np.array([ADDED_ID], dtype="<u4").tobytes()

    def plain(text: str) -> bytes:
        parts = _SAFE.split(text)
        return np.array(encode(parts[0]), dtype="<u4").tobytes() + b"".join([known[p] for p in parts[1:]])

    return lambda text: added.join([plain(t) for t in text.split(ADDED)])


def pieces(docs: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = token_bytes(vocabulary), np.array([END], dtype="<u4").tobytes()
        for b in sliced(batches, 1000):
            out = []
            for id_, text in zip(b["id"], b["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                start, length = 0, min(first, n)
                piece = 0
                while start < n:
                    out.append((id_, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length, piece = start + length, capacity, piece + 1
            d = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])
            yield d.astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


# --- a chunk: counts of lengths; a packing: a list of sequences, each a tuple of lengths ---


def best_fit(items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts items, longest first, each where it leaves least room; bins is extended and returned."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i, b in enumerate(bins):
        r = capacity - sum(b)
        by_room[r].append(i)
        mask |= 1 << r
    for x in sorted(items, reverse=True):
        above = mask >> x
        if above:
            r = x + (above & -above).bit_length() - 1
            i = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[i].append(x)
            r -= x
        else:
            i, r = len(bins), capacity - x
            bins.append([x])
        by_room[r].append(i)
        mask |= 1 << r
    return bins


def random_fit(items: list[int], capacity: int, rng) -> list[list[int]]:
    """Another start: best fit of one piece after another in random order."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for x in rng.permutation(items).tolist():
        above = mask >> x
        if above:
            r = x + (above & -above).bit_length() - 1
            i = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[i].append(x)
            r -= x
        else:
            i, r = len(bins), capacity - x
            bins.append([x])
        by_room[r].append(i)
        mask |= 1 << r
    return bins


def least_bins(items: list[int], capacity: int) -> int:
    """A bound of the number of sequences: for each k, pieces of over capacity - k share with none of k or more, those of over half the
    capacity not with each other, and what remains of pieces of k or more has to fit in as well."""
    n = np.bincount(items, minlength=capacity + 1).astype(np.int64)
    number, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))  # of pieces under a length
    half = capacity // 2
    k = np.arange(half + 1)
    big, mid = number[-1] - number[capacity - k + 1], number[capacity - k + 1] - number[half + 1]
    room = mid * capacity - (total[capacity - k + 1] - total[half + 1])
    rest = np.maximum(0, -(-(total[half + 1] - total[k] - room) // capacity))
    return int(max(np.max(big + mid + rest), -(-total[-1] // capacity))) if len(items) else 0


class Loose:
    """Displaced pieces by length, and as bits, so that a piece or pair that fills a room is found at once."""

    def __init__(self, items: list[int], capacity: int) -> None:
        self.capacity, self.count, self.mask, self.turned = capacity, [0] * (capacity + 1), 0, 0
        for v in items:
            self.add(v)

    def add(self, v: int) -> None:
        self.count[v] += 1
        self.mask |= 1 << v
        self.turned |= 1 << (self.capacity - v)

    def take(self, v: int) -> None:
        self.count[v] -= 1
        if not self.count[v]:
            self.mask ^= 1 << v
            self.turned ^= 1 << (self.capacity - v)

    def longest(self, room: int) -> int:
        """The longest piece that fits, 0 if none does."""
        return max(0, (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two pieces of a total, the most equal ones."""
        found = self.mask & (self.turned >> (self.capacity - total)) & ((1 << (total // 2 + 1)) - 1)
        while found:
            v = found.bit_length() - 1
            if 2 * v != total or self.count[v] > 1:
                return v, total - v
            found ^= 1 << v
        return None

    def items(self) -> list[int]:
        return [v for v, n in enumerate(self.count) for _ in range(n)]


def replace(bins: list[list[int]], displaced: list[int], capacity: int, rng) -> list[list[int]]:
    """Puts displaced pieces where they fill sequences better than what is there: two pieces of a sequence go for two that fill
    it, or one for a longer one or for two that fill it. Displaced pieces get shorter by that; they are best-fitted at last."""
    loose = Loose(displaced, capacity)

    def swap(b: list[int], out: tuple, in_: tuple) -> None:
        for v in out:
            b.remove(v)
            loose.add(v)
        for v in in_:
            loose.take(v)
        b += in_

    for i in rng.permutation(len(bins)).tolist():
        b = bins[i]
        room = capacity - sum(b)
        if not room:
            continue
        pairs = [(x, y) for k, x in enumerate(b[:5]) for y in b[k + 1 : 5]]  # few pieces make a sequence hard to fill
        for x, y in pairs:
            if x + y + room <= capacity and (two := loose.pair(x + y + room)):
                swap(b, (x, y), two)
                room = 0
                break
        for x in list(b) if room else ():
            one = loose.longest(min(capacity, x + room))
            if one > x:
                swap(b, (x,), (one,))
                room += x - one
            elif x + room <= capacity and (two := loose.pair(x + room)):
                swap(b, (x,), two)
                room = 0
            if not room:
                break
    return best_fit(loose.items(), bins, capacity)


def cost(bins: list, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; then the more unequal their fill, the better."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(a: list, b: list, capacity: int, rng) -> list[list[int]]:
    """Whole sequences of a that are well filled, and what of b does not meet them; displaced pieces replace others and are best-fitted."""
    fill = np.array([sum(x) for x in a])
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    injected = [list(a[i]) for i in rng.permutation(well)[: max(1, len(well) // 2)]]
    need = np.bincount([v for x in injected for v in x], minlength=capacity + 1)
    kept, displaced = [], []
    for x in sorted(b, key=lambda x: -sum(x)):
        hit = False
        mine = []
        for v in x:
            if need[v]:
                need[v] -= 1
                hit = True
            else:
                mine.append(v)
        if hit:
            displaced += mine
        else:
            kept.append(list(x))
    return replace(injected + kept, displaced, capacity, rng)


def mutate(a: list, capacity: int, rng, share: float = 0.05) -> list[list[int]]:
    """Breaks up the emptiest sequences and some at random; their pieces replace others and are best-fitted."""
    order = np.argsort([sum(x) for x in a], kind="stable")
    n = max(1, int(len(a) * share))
    out = set(order[: 2 * n].tolist()) | set(rng.choice(len(a), n, replace=False).tolist())
    loose = [v for i in out for v in a[i]]
    return replace([list(x) for i, x in enumerate(a) if i not in out], loose, capacity, rng)


def evolve(population: list, items: list[int], capacity: int, generations: int, size: int, rng, stall: int = STALL) -> list:
    """The population after so many generations, best first; it ends early at the bound, or when `stall` generations have not bettered the
    best."""
    least = least_bins(items, capacity)
    population = [*population, best_fit(items, [], capacity)]
    idle = 0
    for _ in range(generations):
        population.sort(key=lambda p: cost(p, capacity))
        if len(population[0]) <= least or idle >= stall:
            break
        while len(population) < size:
            population.append(random_fit(items, capacity, rng))
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        child = crossover(population[i], population[j], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        idle = 0 if cost(child, capacity) < cost(population[0], capacity) else idle + 1
        population[-1] = child
    return sorted(population, key=lambda p: cost(p, capacity))


def _flat(bins: list) -> list[int]:
    """A packing as one list: each sequence's lengths, then 0."""
    out: list[int] = []
    for b in bins:
        out += b
        out.append(0)
    return out


def _unflat(flat) -> list[list[int]]:
    bins: list[list[int]] = [[]]
    for v in flat:
        if v:
            bins[-1].append(int(v))
        else:
            bins.append([])
    return bins[:-1]


def ga_round(counts: DataFrame, capacity: int, islands: int, epochs: int, generations: int, size: int, last: bool, keep: float) -> DataFrame:
    """counts(chunk, length, n) -> (chunk, bin, lengths, final): each chunk's best packing."""
    spread = counts.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("counts"))  # at most capacity entries
    state = spread.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.array().cast("array<int>"))

    def epoch_of(epoch: int):
        def epoch_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in sliced(batches, 8):
                elites = []
                for chunk, island, counted, elite in zip(b["chunk"], b["island"], b["counts"], b["elite"], strict=True):
                    rng = np.random.default_rng([int(chunk), int(island), epoch])
                    items = [r["length"] for r in counted for _ in range(r["n"])]
                    start = [_unflat(elite)] if len(elite) else []
                    elites.append(np.array(_flat(evolve(start, items, capacity, generations, size, rng)[0]), dtype=np.int32))
                yield pd.DataFrame({"chunk": b["chunk"], "island": b["island"], "counts": b["counts"], "elite": elites})

        return epoch_run

    schema = "chunk long, island int, counts array<struct<length:long,n:long>>, elite array<int>"
    # few rows of much work: without a number they would be put together by their size
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for e in range(epochs):
        state = state.repartition(tasks, "chunk", "island").mapInPandas(epoch_of(e), schema)
        # the elite moves on to the next island of its chunk
        state = state.withColumn("island", (F.col("island") + 1) % islands)

    def best(key, d: pd.DataFrame) -> pd.DataFrame:
        found = min((_unflat(x) for x in d["elite"]), key=lambda p: cost(p, capacity))
        full = [last or sum(x) >= keep * capacity for x in found]
        return pd.DataFrame({"chunk": d["chunk"].iloc[0], "bin": range(len(found)), "lengths": found, "final": full})

    return state.groupBy("chunk").applyInPandas(best, "chunk long, bin long, lengths array<int>, final boolean")


def pack(parts: DataFrame, capacity: int = CAPACITY, chunk_rows: int = CHUNK_ROWS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, keep: float = KEEP) -> DataFrame:
    """parts(row, length, ...) with sequence_id and offset."""
    rows = parts.where(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("length"))
    done, round_, before_ = None, 0, None
    while True:
        n = rows.count()
        if not n:
            break
        chunks = max(1, round(n / chunk_rows))
        last = chunks == 1 or (before_ is not None and n > 0.9 * before_)
        before_ = n
        chunk = F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(chunks))
        rows = rows.select("row", "length", chunk.alias("chunk"))
        counts = rows.groupBy("chunk", "length").agg(F.count("*").alias("n"))
        bins = cut_lineage(ga_round(counts, capacity, islands, epochs, generations, population, last, keep))
        # places are matched with pieces of the same chunk and length by their rank
        slots = bins.select("chunk", "bin", "final", F.posexplode("lengths").alias("at", "length"))
        by = lambda *o: F.row_number().over(Window.partitionBy("chunk", "length").orderBy(*o))
        slots = slots.withColumn("k", by("bin", "at"))
        # of the places in a sequence, the offset is the sum of the lengths before
        before = Window.partitionBy("chunk", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        placed = cut_lineage(rows.withColumn("k", by("row")).join(slots, ["chunk", "length", "k"]).select("row", "length", "final", F.lit(round_).alias("round"), "chunk", "bin", F.col("offset").cast("long").alias("offset")))
        got = placed.where("final").drop("final", "length")
        done = got if done is None else done.unionByName(got)
        rows = placed.where(~F.col("final")).select("row", "length")
        round_ += 1
        if last:
            break
    # numbers of shared sequences are even, of full pieces odd
    alone = parts.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    if done is None:
        return alone
    where = done.select("row", ((F.col("round").cast("long") * (1 << 56)) + F.col("chunk") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    shared = parts.where(F.col("length") < capacity).join(where.withColumn("sequence_id", F.col("sequence_id") * 2), "row")
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    parts = cut_lineage(pieces(docs, id_col).withColumn("row", F.monotonically_increasing_id()))
    return pack(parts, **options).select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
