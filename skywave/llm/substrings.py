"""Suffix-array dedup by prefix-free parsing: bytes of strings of `width` bytes that start elsewhere too.

Triggers: a hash rolls over each text, 8 bytes at a time. The trigger of a width-byte string is the place of the
least hash in its middle, so equal strings have their trigger at the same offset, wherever they stand, and every
string has one (with `hash mod p = 0` as the trigger, strings without any would be missed). A text's strings fall
into runs with one trigger each. A run is a phrase: the text from its first string's start to its last one's
end, with the trigger in it; phrases of neighbouring runs overlap.

A string is what its phrase holds before the trigger, then what the text goes on with from the trigger: a suffix
of the dictionary, then a suffix of the parse. Two strings are equal if both parts are, so two suffix arrays in each context decide:
the dictionary's (what stands before the trigger, read from the trigger) and the parse's (what follows),
each with its longest common prefixes. Strings whose places in both arrays fall into one interval of the
wanted depths are next to each other in corpus order, and repeat. Bytes are compared, not hashes.

Most text is settled before, without its bytes: the context of a trigger (108 bytes around it that every string
of the run holds) is sent as a hash, with the hash of its phrase. A context that stands at one place settles its
run: nothing in it repeats (a chance hit here only means more to sort). One whose phrases are all alike
by both hashes, 128 bits together, settles it too: all its strings repeat. Phrases of the other, mixed contexts
travel whole. A mixed context of more than `hot` phrases (a line that is in all documents, with other text around
it each time) would be too much for a task: its strings are counted one by one, by 128-bit hashes, dealt over all tasks.

Documents are dealt to buckets of bucket_bytes once and kept there in a checkpoint, compressed. A bucket sends
one entry for each context, string and phrase, whatever it holds of them, as packed arrays by ranges of the hash;
the answer is an array in the same order. With more than `fan` buckets, entries of fan buckets are merged first, so that
what all buckets hold is at most fan entries in a task, on any level.

Defined results: a null text is empty; texts shorter than width have no spans; repeated rows are
documents of their own, so their texts repeat; null ids are kept; no rows give no rows. Other columns
are kept as they are. Strings never cross documents.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fixed_layout, read, scratch, text_of

WIDTH = 200
BUCKET_BYTES = 6_000_000
PART_ENTRIES = 300_000
MOST_PARTITIONS = 100_000  # buckets share partitions beyond
HOT = 20_000
FAN = 4096
BLOCK = 1 << 20
_MARGIN, _GRAM = 50, 8
_DEEP = 160  # bytes of a phrase on either side of its trigger, at most width - _MARGIN


def _hashes(t: np.ndarray) -> np.ndarray:
    """The rolling hash: of the 8 bytes from each position."""
    n = len(t) - _GRAM + 1
    out = np.empty(n, np.uint64)
    raw = t.tobytes()
    for k in range(_GRAM):
        part = np.frombuffer(raw, "<u8", (len(t) - k) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(a) - w + 1
    full = np.full(-(-len(a) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(a)] = a
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(t: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger): the strings first..last of t, texts end at `ends`, share their trigger."""
    n = len(t) - width + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    w = width - 2 * _MARGIN - _GRAM + 1
    h = _hashes(t)[_MARGIN : _MARGIN + n + w - 1]
    # equal hashes: the first one counts, so that strings alone decide
    least = _least((h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), w)
    inside = np.ones(n, bool)
    for e in ends[:-1]:
        inside[max(0, e - width + 1) : min(n, e)] = False
    s = np.flatnonzero(inside)
    if not len(s):
        return none, none, none
    x = (least[s] & np.uint64(0xFFFFFF)).astype(np.int64) + _MARGIN
    cut = np.flatnonzero((np.diff(x) != 0) | (np.diff(s) != 1)) + 1
    return s[np.concatenate(([0], cut))], s[np.concatenate((cut, [len(s)])) - 1], x[np.concatenate(([0], cut))]


def blocks(texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Texts in blocks of about a million bytes: (bytes, ends, (document, its offset there)); a long
    text is cut into blocks that overlap by width - 1 bytes, so that each string is in one of them."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), BLOCK):
            part = t[at : at + BLOCK + width - 1]
            if len(part) < width:
                continue
            if size + len(part) > BLOCK and held:
                yield b"".join(p for _, _, p in held), np.cumsum([len(p) for _, _, p in held]), [(d, o) for d, o, _ in held]
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield b"".join(p for _, _, p in held), np.cumsum([len(p) for _, _, p in held]), [(d, o) for d, o, _ in held]


def parsed(texts: list[bytes], width: int):
    """For each block: bytes, ends, documents, first, last, the 64-bit contexts and phrases, and triggers."""
    digest = xxhash.xxh64_intdigest
    for raw, ends, docs in blocks(texts, width):
        first, last, x = runs(np.frombuffer(raw, np.uint8), ends, width)
        context = np.array([digest(raw[a - _MARGIN : a + _MARGIN + _GRAM], 1) for a in x.tolist()], dtype=np.uint64)
        phrase = np.array([digest(raw[a : b + width], 2) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
        yield raw, ends, docs, first, last, context, phrase, x


def strings(raw: bytes, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and 128-bit hash (two numbers) of every string of runs."""
    n = last - first + 1
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    digest = xxhash.xxh3_128_digest
    return at, np.frombuffer(b"".join([digest(raw[a : a + width]) for a in at.tolist()]), "<u8").reshape(-1, 2)


# --- what travels: arrays, packed ---


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays; an ascending `key` as differences, byte by byte: the upper bytes are zeros, and vanish."""
    if "key" in arrays:
        gaps = np.diff(arrays["key"], prepend=np.uint64(0))
        arrays["key"] = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps({k: (str(v.dtype), v.shape, v.tobytes()) for k, v in arrays.items()}))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    got = {k: np.frombuffer(raw, kind).reshape(shape) for k, (kind, shape, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items()}
    if "key" in got:
        got["key"] = np.cumsum(np.ascontiguousarray(got["key"].T).view(np.uint64).ravel(), dtype=np.uint64)
    return got


def _ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in ascending keys."""
    low = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(key, low), len(key))


def _grouped(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each group in it) by equal values of all cols, the first one first."""
    order = np.lexsort(cols[::-1]) if len(cols) > 1 else np.argsort(cols[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in cols:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(new)


def _merged(key: np.ndarray, other: np.ndarray, n: np.ndarray, kinds: np.ndarray, unlike: np.ndarray, pairs: bool):
    """One entry for each key (each key and other, if pairs): places n, phrases kinds, whether they are unlike;
    and for each entry the place of its own."""
    order, start = _grouped(key, other) if pairs else _grouped(key)
    if not len(order):
        return {"key": key, "other": other, "n": n, "kinds": kinds, "unlike": unlike}, order
    own = np.empty(len(order), np.int64)
    own[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    o = other[order]
    apart = np.append(0, o[1:] != o[:-1])
    apart[start] = 0
    total = lambda x: np.add.reduceat(x[order], start)
    differ = (np.add.reduceat(apart, start) > 0) | (total(unlike.astype(np.int64)) > 0)
    return {"key": key[order][start], "other": o[start], "n": total(n), "kinds": total(kinds), "unlike": differ}, own


def _entries(d: pd.DataFrame) -> tuple[dict, np.ndarray, list[int]]:
    got = [_unpack(x) for x in d["data"]]
    all_ = [np.concatenate([g[k] for g in got]) for k in ("key", "other", "n", "kinds", "unlike")]
    merged, own = _merged(*all_, pairs=bool(d["pairs"].iloc[0]))
    return merged, own, np.cumsum([len(g["key"]) for g in got])[:-1].tolist()


_ENTRY = "part long, child long, pairs boolean, data binary"
_ANSWER = "part long, child long, pairs boolean, data binary"
_NOTHING = {"part": [], "child": [], "pairs": [], "data": []}
_TYPES = {"part": "int64", "child": "int64", "pairs": "bool"}


def _sent(child: int, parts: int, first: int, pairs: bool, merged: dict) -> list[tuple]:
    """Rows of merged entries by range of key, from part number `first` on."""
    bound = _ranges(merged["key"], parts)
    return [(first + p, child, pairs, _pack(**{k: v[a:b] for k, v in merged.items()})) for p, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if a < b]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(_NOTHING)).astype(_TYPES)


def _judge(merged: dict, hot: int) -> np.ndarray:
    """0: at one place only; 1: at more, all alike; 2: unlike ones; 3: unlike ones, and more than hot."""
    return np.where(merged["n"] < 2, 0, np.where(~merged["unlike"], 1, np.where(merged["kinds"] <= hot, 2, 3))).astype(np.uint8)


def _reply(d: pd.DataFrame, of_merged: np.ndarray, own: np.ndarray, cuts: list[int]) -> pd.DataFrame:
    return _frame([(p, c, q, _pack(answer=x)) for p, c, q, x in zip(d["part"], d["child"], d["pairs"], np.split(of_merged[own], cuts), strict=True)])


def _met(entries: DataFrame, n_buckets: int, fan: int, hot: int) -> DataFrame:
    """The answers to entries of buckets."""

    def settle(d: pd.DataFrame) -> pd.DataFrame:
        merged, own, cuts = _entries(d)
        return _reply(d, _judge(merged, hot), own, cuts)

    def up(key, d: pd.DataFrame) -> pd.DataFrame:
        merged, _, _ = _entries(d)
        return _frame([(d["part"].iloc[0], int(key[1]), d["pairs"].iloc[0], _pack(**merged))])

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return _frame([])
        _, own, cuts = _entries(left)
        return _reply(left, _unpack(right["data"].iloc[0])["answer"], own, cuts)

    if n_buckets <= fan:
        return cut_lineage(entries.groupBy("part").applyInPandas(lambda d: settle(d), _ANSWER))
    entries = cut_lineage(entries)
    group = F.floor(F.col("child") / fan).cast("long")
    above = entries.groupBy("part", group.alias("g")).applyInPandas(up, _ENTRY)
    told = _met(above, -(-n_buckets // fan), fan, hot)
    by = entries.groupBy("part", group.alias("g"))
    return cut_lineage(by.cogroup(told.groupBy("part", "child")).applyInPandas(lambda left, right: down(left, right), _ANSWER))


# --- mixed contexts: suffix arrays over bytes ---


def _side(raw: np.ndarray, at: np.ndarray, n: np.ndarray, step: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of what stands from `at` on (step 1) or before it, read backwards (step -1), within
    each context: (order, common prefix with the one before, -1 where a context begins)."""
    off = np.arange(_DEEP)
    text = np.where(off < n[:, None], raw[np.clip(at[:, None] + step * off, 0, len(raw) - 1)], 0).astype(np.uint8)
    keyed = np.concatenate((context.astype(">u8").view(np.uint8).reshape(-1, 8), text), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{8 + _DEEP}").ravel(), kind="stable")
    s = keyed[order]
    same = s[1:] == s[:-1]
    common = np.where(same.all(axis=1), 8 + _DEEP, same.argmin(axis=1)) - 8
    return order, np.append(-1, np.where(common < 0, -1, common))


def repeated(raw: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, twice: np.ndarray, width: int) -> np.ndarray:
    """Which strings of phrases repeat (n, width - 2 * margin - 7), by their place from the phrase's first: phrases
    have `left` bytes before and `right` bytes from their trigger on, which stands at `at`."""
    out = np.zeros((len(at), width - 2 * _MARGIN - _GRAM + 1), bool)
    after, behind = _side(raw, at, right, 1, context), _side(raw, at - 1, left, -1, context)
    a, b = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for before in range(int((width - right).min()), int(left.max()) + 1):  # bytes of a string before the trigger
        own = np.flatnonzero((left >= before) & (width - right <= before))
        if not len(own):
            continue
        a[after[0]], b[behind[0]] = np.cumsum(after[1] < width - before), np.cumsum(behind[1] < before)
        both = a[own] * (len(at) + 1) + b[own]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again = np.zeros(len(own), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        out[own, left[own] - before] = again | twice[own]
    return out


def _sorted_out(d: pd.DataFrame, width: int, most: int = 20_000) -> pd.DataFrame:
    """For each row of phrases, bits of their repeated strings. Contexts are taken `most` phrases at a time, or one
    by one; one has HOT at most."""
    got = [_unpack(x) for x in d["data"]]
    context, left, right, twice = (np.concatenate([g[k] for g in got]) for k in ("key", "left", "right", "twice"))
    raw = np.concatenate([g["raw"] for g in got])
    left, right = left.astype(np.int64), right.astype(np.int64)
    at = np.cumsum(left + right) - right
    order, start = _grouped(context)
    size = np.diff(np.append(start, len(order)))
    bits = np.zeros((len(order), -(-(width - 2 * _MARGIN - _GRAM + 1) // 8)), np.uint8)
    a = 0
    while a < len(start):
        b, n = a, 0
        while b < len(start) and (b == a or n + size[b] <= most):
            n += size[b]
            b += 1
        mine = order[start[a] : start[a] + n]
        bits[mine] = np.packbits(repeated(raw, at[mine], left[mine], right[mine], context[mine], twice[mine], width), axis=1)
        a = b
    cuts = np.cumsum([len(g["key"]) for g in got])[:-1].tolist()
    return _frame([(p, c, False, _pack(answer=x)) for p, c, x in zip(d["part"], d["child"], np.split(bits, cuts), strict=True)])


# --- a bucket ---


class Bucket:
    """The texts of a bucket, parsed; its contexts and phrases in order. What it sends depends on the set of its
    texts only, so answers in the same order find their entries again."""

    def __init__(self, texts: list[bytes], width: int):
        self.width, self.blocks = width, list(parsed(texts, width))
        join = lambda i: np.concatenate([b[i] for b in self.blocks]) if self.blocks else np.empty(0, np.uint64)
        context, phrase = join(5), join(6)
        order, start = _grouped(context, phrase)
        self.where = np.empty(len(order), np.int64)  # of each run: its phrase
        self.where[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.some = order[start]  # a run of each phrase
        self.context, self.phrase, self.n = context[self.some], phrase[self.some], np.diff(np.append(start, len(order)))
        one = np.ones(len(start), np.int64)
        self.entries, self.of_phrase = _merged(self.context, self.phrase, self.n, one, np.zeros(len(start), bool), pairs=False)

    def kinds(self, answer: np.ndarray) -> np.ndarray:
        """_judge() of each phrase's context."""
        return answer[self.of_phrase] if len(self.of_phrase) else np.empty(0, np.uint8)

    def runs_of(self, chosen: np.ndarray) -> Iterator[tuple]:
        """Of each block: (block, numbers of its runs whose phrase is chosen, their phrases)."""
        at = 0
        for b in self.blocks:
            own = self.where[at : at + len(b[3])]
            at += len(b[3])
            mine = np.flatnonzero(chosen[own])
            yield b, mine, own[mine]

    def strings(self, kinds: np.ndarray):
        """Of hot contexts: for each block the starts of strings and their places among the distinct ones; these, merged."""
        found = [(b, *strings(b[0], b[3][m], b[4][m], self.width)) for b, m, _ in self.runs_of(kinds == 3)]
        hashes = np.concatenate([h for _, _, h in found]) if found else np.empty((0, 2), np.uint64)
        one = np.ones(len(hashes), np.int64)
        merged, own = _merged(np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]), one, one, np.zeros(len(one), bool), pairs=True)
        cuts = np.cumsum([len(at) for _, at, _ in found])[:-1]
        return [(b, at, o) for (b, at, _), o in zip(found, np.split(own, cuts) if found else [], strict=True)], merged

    def mixed(self, kinds: np.ndarray, parts: int) -> tuple[list[tuple[int, bytes]], np.ndarray]:
        """Phrases of mixed contexts by part, and their numbers in that order."""
        chosen = kinds == 2
        pieces: dict[int, tuple[bytes, int, int]] = {}
        ends = np.cumsum([len(b[3]) for b in self.blocks])
        numbers = np.flatnonzero(chosen)
        for k, run in zip(numbers.tolist(), self.some[numbers].tolist(), strict=True):
            j = int(np.searchsorted(ends, run, side="right"))
            raw, f, l, x = (self.blocks[j][i] for i in (0, 3, 4, 7))
            i = run - (ends[j - 1] if j else 0)
            pieces[k] = raw[f[i] : l[i] + self.width], int(x[i] - f[i]), int(l[i] + self.width - x[i])
        bound = _ranges(self.context[numbers], parts)
        out = []
        for p, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
            if a < b:
                some = [pieces[k] for k in numbers[a:b].tolist()]
                out.append((p, _pack(key=self.context[numbers[a:b]], left=np.array([x[1] for x in some], np.uint8), right=np.array([x[2] for x in some], np.uint8), twice=self.n[numbers[a:b]] > 1, raw=np.frombuffer(b"".join(x[0] for x in some), np.uint8))))
        return out, numbers


def _told(right: pd.DataFrame, kind: int) -> np.ndarray | None:
    """The bucket's answers of a kind, parts in order."""
    own = right[right["kind"] == kind].sort_values("part")
    return np.concatenate([_unpack(x)["answer"] for x in own["data"]]) if len(own) else None


def cut(texts: list[bytes], right: pd.DataFrame, width: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256, text) of each text, by the answers of all rounds."""
    bucket = Bucket(texts, width)
    contexts = _told(right, 1)
    kinds = bucket.kinds(contexts) if contexts is not None else np.zeros(len(bucket.n), np.uint8)
    spans: list[list[np.ndarray]] = [[] for _ in texts]

    def note(block, begin: np.ndarray, end: np.ndarray) -> None:
        ends, own = block[1], block[2]
        which = np.searchsorted(ends, begin, side="right")
        for j in np.unique(which):
            mine = which == j
            shift = own[j][1] - (ends[j - 1] if j else 0)
            spans[own[j][0]].append(np.stack((begin[mine] + shift, end[mine] + shift)))

    for b, m, _ in bucket.runs_of(kinds == 1):
        note(b, b[3][m], b[4][m] + width)
    bits, numbers = _told(right, 2), np.flatnonzero(kinds == 2)
    if bits is not None:
        rows = np.full(len(kinds), -1)
        rows[numbers] = np.arange(len(numbers))
        for b, m, phrase in bucket.runs_of(kinds == 2):
            run, place = np.nonzero(np.unpackbits(bits[rows[phrase]], axis=1))
            begin = b[3][m[run]] + place
            note(b, begin, begin + width)
    again = _told(right, 3)
    if again is not None:
        for b, at, own in bucket.strings(kinds)[0]:
            begin = at[again[own] > 0]
            note(b, begin, begin + width)
    rows = []
    for t, got in zip(texts, spans, strict=True):
        kept, n_spans = t, 0
        if got:
            begin, end = np.concatenate(got, axis=1)
            depth = np.zeros(len(t) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            n_spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
        rows.append((len(t), len(t) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return rows


MEASURES = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>"


def remove_repeats(docs: DataFrame, width: int = WIDTH, text_col: str = "text", into: str = "repeats", bucket_bytes: int = BUCKET_BYTES, part_entries: int = PART_ENTRIES, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """docs, its text without the bytes removed (code points that lost some of their bytes go with them), and a
    column `into` of MEASURES (it takes the place of a column of that name)."""
    if width < 2 * _MARGIN + _GRAM + 1 or width - _MARGIN > _DEEP:
        raise ValueError("the trigger's context needs a width of 109 to 210")
    data = text_of(text_col).cast("binary")
    size = docs.agg(F.sum(F.length(data))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    parts = max(1, size // 46 // part_entries)
    names = [c for c in docs.columns if c not in (text_col, into)]
    packed, at = scratch(docs, "packed", "bucket")

    def squeeze(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=7)
        for b in batches:
            yield b.map(press.compress)

    # rows are dealt by their number, so that copies are spread too
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_buckets))
    held = docs.select(*names, F.pandas_udf(squeeze, "binary", F.PandasUDFType.SCALAR_ITER)(data).alias(packed), number.alias(at))
    held = fixed_layout(held.repartition(min(n_buckets, MOST_PARTITIONS), at))

    def texts_of(column) -> list[bytes]:
        raw = zstandard.ZstdDecompressor()
        return [raw.decompress(z) for z in column]

    def contexts(key, d: pd.DataFrame) -> pd.DataFrame:
        return _frame(_sent(int(key[0]), parts, 0, False, Bucket(texts_of(d[packed]), width).entries))

    def others(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        answer = _told(right, 1)
        if answer is None or not len(left) or answer.max() < 2:
            return _frame([])
        bucket = Bucket(texts_of(left[packed]), width)
        kinds = bucket.kinds(answer)
        rows = [(p, int(key[0]), False, x) for p, x in bucket.mixed(kinds, parts)[0]]
        return _frame(rows + _sent(int(key[0]), 8 * parts, parts, True, bucket.strings(kinds)[1]))

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = cut(texts_of(left[packed].to_pylist()), right.to_pandas(), width)
        out = {f"c{i}": left[c] for i, c in enumerate(names)}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        out |= {f"m{i}": pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)}
        return pa.table(out)

    by, only = held.groupBy(at), held.select(at, packed).groupBy(at)
    first = _met(only.applyInPandas(contexts, _ENTRY), n_buckets, fan, hot).withColumn("kind", F.lit(1))
    sent = cut_lineage(only.cogroup(first.groupBy("child")).applyInPandas(others, _ENTRY))
    phrases = sent.where("NOT pairs").groupBy("part").applyInPandas(lambda d: _sorted_out(d, width), _ANSWER).withColumn("kind", F.lit(2))
    single = _met(sent.where("pairs"), n_buckets, fan, hot).withColumn("kind", F.lit(3))
    answers = cut_lineage(first.unionByName(phrases).unionByName(single))
    kept = docs.select(*names).schema.fields
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(f"m{i}", T.LongType() if i < 3 else T.StringType()) for i in range(5)])
    out = by.cogroup(answers.groupBy("child")).applyInArrow(finish, schema)
    measures = F.struct(*[F.col(f"m{i}").alias(n) for i, n in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256"))])
    back = {c: F.col(f"c{i}") for i, c in enumerate(names)} | {text_col: F.col("m4")}
    return out.select(*[back[c].alias(c) for c in docs.columns if c != into], measures.alias(into))


def op1_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "repeats.*")
