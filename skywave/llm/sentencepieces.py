"""SentencePiece encoding and decoding, with N-best segmentation over the piece lattice.

A text is written with a dummy space in front and U+2581 for spaces; every piece of the vocabulary is
an edge of its lattice, a character without a piece is one edge of its UTF-8 bytes' pieces. A forward
Viterbi pass gives the best score of each prefix; it is the exact rest of a backward A* search from the
end, which therefore yields segmentations in order of their score, best first.

The lattice falls apart where no piece spans two characters (before a space that follows another
character, between letters and punctuation), so segmentations of words combine: the best of a text is that of its words,
and the next ones change the words whose second segmentations cost least. The forward pass runs over all
new words of a group of texts at once, one position after the other, on arrays of edges; so does a pass
from the ends, which gives what each word's second segmentation costs. Found words are kept, from task
to task of a process. Only the few words whose second
segmentations a text needs are searched by A*.

Scores are those of the model's file; equal scores go to the piece that starts first. Defined
results: null and empty texts have no pieces, score 0 and one segmentation; repeated rows and null
ids are rows like any other; no rows give no rows; a text that holds U+2581 itself does not come back
(decoded as a space). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sliced

SPACE = "▁"
N_BEST = 4
MODEL = "piece_bpe_32k.model"
_KNOWN = 800_000  # words that are kept, some 300 bytes each
_PATHS = 50_000  # words whose segmentations are kept, some 1,000 bytes each
_LONG = 64  # longer words are cut or searched one by one
_CHARS = 1_000_000  # of texts that are encoded together
_EDGE_CHARS = 100_000  # of words whose edges are held together
_EMPTY = np.int64(-1)
_MADE: dict[str, Pieces] = {}


def pieces_of(model: str = MODEL) -> Pieces:
    """Made once in each process, so that tasks after the first have its tables and the words that it knows."""
    if model not in _MADE:
        _MADE[model] = Pieces(model)
    return _MADE[model]


class Pieces:
    """The vocabulary of a model, and what has been found for segments."""

    def __init__(self, model: str = MODEL):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.is_byte = [sp.is_byte(i) for i in range(len(self.pieces))]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(self.score.values()) - 10.0
        self.within = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.word = self._word()
        self.id_bytes = {p: np.array([i], dtype="<u4").tobytes() for p, i in self.ids.items()}
        self.root: dict = {}  # the pieces by their characters; "" has a piece's score
        for p, s in self.score.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = s
        self.known: dict[str, int] = {}  # a word's place in the lists below
        self.found_ids: list[bytes] = []
        self.found_size, self.found_score, self.found_loss = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.paths: dict[str, list] = {}
        self.text_of = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(self.pieces, self.is_byte, strict=True)]

        self._tabulate()

    def _word(self) -> re.Pattern:
        """A segment: spaces, and a run of characters that pieces join, directly or by way of others, or a single one."""
        groups: dict[str, frozenset] = {}
        for a, b in self.within:
            if SPACE not in (a, b):
                both = groups.get(a, frozenset(a)) | groups.get(b, frozenset(b))
                groups.update(dict.fromkeys(both, both))
        runs = sorted(("".join(sorted(g)) for g in set(groups.values())), key=lambda r: (-len(r), r))
        return re.compile(f"{SPACE}*(?:{''.join(f'[{re.escape(r)}]+|' for r in runs)}[^{SPACE}])|{SPACE}+")

    def _tabulate(self) -> None:
        """The tree of pieces as a hash table of steps (node, character) -> node, open addressing."""
        steps, self.node_piece, todo = [], [], [(self.root, "")]
        number = {"": 0}
        for node, prefix in todo:
            self.node_piece.append(self.ids.get(prefix, -1))
            for c, below in node.items():
                if c:
                    number[prefix + c] = len(todo)
                    steps.append((number[prefix] << 21 | ord(c), len(todo)))
                    todo.append((below, prefix + c))
        self.node_piece = np.array(self.node_piece)
        scores = np.array([self.score.get(p, 0.0) for p in self.pieces])
        self.node_score = np.where(self.node_piece >= 0, scores[self.node_piece], 0.0)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(steps))))))
        self.step_key, self.step_to = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits, np.int64)
        for key, to in steps:
            at = int(self._slot(np.array([key]))[0])
            while self.step_key[at] != _EMPTY:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.step_key[at], self.step_to[at] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node behind each node by its character, -1 where there is none."""
        key = node << 21 | char
        at = self._slot(key)
        there = self.step_key[at]
        out = np.where(there == key, self.step_to[at], -1)
        open_ = np.flatnonzero((there != key) & (there != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.step_key[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.step_to[at[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return out

    def search_many(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """search() of each word (none is empty, none over _LONG), all at once: place i of word k is node first[k] + i."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        first = np.cumsum(n + 1) - (n + 1)
        at = np.arange(len(char))  # a character's node is its place plus its word's number
        left = np.cumsum(n)[word] - at
        begin, end, piece, score = [], [], [], []
        node, alone = np.zeros(len(char), np.int64), np.ones(len(char), bool)
        live, depth = at, 0
        while len(live):
            to = self._step(node, char[live + depth])
            ok = to >= 0
            live, node, depth = live[ok], to[ok], depth + 1
            is_piece = self.node_piece[node] >= 0
            hit = live[is_piece]
            if depth == 1:
                alone[hit] = False
            begin.append(hit)
            end.append(hit + depth)
            piece.append(self.node_piece[node[is_piece]])
            score.append(self.node_score[node[is_piece]])
            more = left[live] > depth
            live, node = live[more], node[more]
        bare = np.flatnonzero(alone)
        width = 1 + (char[bare] > 0x7F) + (char[bare] > 0x7FF) + (char[bare] > 0xFFFF)
        begin, end = np.concatenate([*begin, bare]), np.concatenate([*end, bare + 1])
        piece, score = np.concatenate([*piece, np.full(len(bare), -1)]), np.concatenate([*score, self.byte_score * width])
        owner = word[begin]
        begin, end = begin + owner, end + owner
        # forward: the best of each node, edges by the place of their end
        place = end - first[owner]
        order = np.argsort((place << 48) | (end << 24) | begin)  # all differ
        begin, end, piece, score, owner, place = (x[order] for x in (begin, end, piece, score, owner, place))
        best, come = np.zeros(len(char) + len(words)), np.zeros(len(char) + len(words), np.int64)
        bound = np.searchsorted(place, np.arange(1, int(n.max()) + 2))
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            head = np.append(0, np.flatnonzero(np.diff(end[a:b])) + 1)
            value = best[begin[a:b]] + score[a:b]
            top = np.maximum.reduceat(value, head)
            best[end[a + head]] = top
            is_top = value == np.repeat(top, np.diff(np.append(head, b - a)))
            come[end[a + head]] = a + np.minimum.reduceat(np.where(is_top, np.arange(b - a), b - a), head)
        # the best paths, from the ends
        on_path = np.zeros(len(begin), bool)
        now = first + n
        while len(now):
            edge = come[now]
            on_path[edge] = True
            now = begin[edge][begin[edge] != first[owner[edge]]]
        # backward: the best rest of each node, and the best path over each edge that is not on the best one
        rest = np.full(len(best), -np.inf)
        rest[first + n] = 0.0
        start = begin - first[owner]
        order = np.argsort((-start << 24) + begin)
        bound = np.searchsorted(-start[order], np.arange(-int(n.max()) + 1, 2))
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            own = order[a:b]
            head = np.append(0, np.flatnonzero(np.diff(begin[own])) + 1)
            rest[begin[own[head]]] = np.maximum.reduceat(score[own] + rest[end[own]], head)
        second = np.full(len(words), -np.inf)
        off = np.flatnonzero(~on_path)
        np.maximum.at(second, owner[off], best[begin[off]] + score[off] + rest[end[off]])
        total = best[first + n]
        # ids of the paths in order
        used = np.flatnonzero(on_path)
        used = used[np.argsort(begin[used], kind="stable")]
        cut = np.searchsorted(owner[used], np.arange(len(words) + 1)).tolist()
        raw, odd = piece[used].astype("<u4").tobytes(), set(word[bare].tolist())
        starts = begin[used] - first[owner[used]]
        ids = [raw[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for k in odd:
            ids[k] = self.encoded(words[k], starts[cut[k] : cut[k + 1]].tolist())
        return list(zip(ids, total.tolist(), (total - second).tolist(), strict=True))

    def lattice(self, seg: str) -> tuple[list[float], list[list[tuple[int, float]]], list[int]]:
        """Best score of each prefix; by end, the edges (start, score) and the start of the best one."""
        n, root = len(seg), self.root
        best, edges, come = [0.0] + [-np.inf] * n, [[] for _ in range(n + 1)], [0] * (n + 1)
        for i in range(n):
            at, node, j = best[i], root, i
            while j < n:
                node = node.get(seg[j])
                if node is None:
                    break
                j += 1
                s = node.get("")
                if s is not None:
                    edges[j].append((i, s))
                    if at + s > best[j]:
                        best[j] = at + s
                        come[j] = i
            if seg[i] not in self.ids:
                s = self.byte_score * len(seg[i].encode("utf-8", "surrogatepass"))
                edges[i + 1].append((i, s))
                if at + s > best[i + 1]:
                    best[i + 1] = at + s
                    come[i + 1] = i
        return best, edges, come

    def n_best(self, seg: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations: (score, starts of pieces). As the scores ahead are exact, a place's n best rests come
        out first; later ones are in no result and go no further, so work is in proportion to n times the edges, ties included."""
        best, edges, _ = self.lattice(seg)
        heap, out, tie = [(-best[-1], 0, len(seg), 0.0, None)], [], 0
        taken = [0] * (len(seg) + 1)
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if taken[at] == n:
                continue
            taken[at] += 1
            if at == 0:
                starts = []
                while path is not None:
                    starts.append(path[0])
                    path = path[1]
                out.append((behind, starts))
                continue
            for i, s in edges[at]:
                if taken[i] < n:
                    tie += 1
                    heapq.heappush(heap, (-(behind + s + best[i]), tie, i, behind + s, (i, path)))
        return out

    def encoded(self, seg: str, starts: list[int]) -> bytes:
        out, id_bytes = [], self.id_bytes
        for a, b in zip(starts, [*starts[1:], len(seg)], strict=True):
            i = id_bytes.get(seg[a:b])
            out.append(i if i is not None else np.array([self.byte_ids[x] for x in seg[a:b].encode("utf-8", "surrogatepass")], dtype="<u4").tobytes())
        return b"".join(out)

    def search(self, seg: str) -> tuple[bytes, float, float]:
        """Of a segment: ids, score, what the second segmentation costs (inf: there is none)."""
        best, edges, come = self.lattice(seg)
        n = len(seg)
        on_path, at, starts = [-1] * (n + 1), n, []
        while at:
            on_path[at] = come[at]
            at = come[at]
            starts.append(at)
        starts.reverse()
        rest, second = [-np.inf] * n + [0.0], -np.inf
        for j in range(n, 0, -1):
            r, own = rest[j], on_path[j]
            for i, s in edges[j]:
                v = s + r
                if v > rest[i]:
                    rest[i] = v
                if i != own and best[i] + v > second:
                    second = best[i] + v
        return self.encoded(seg, starts), best[n], best[n] - second

    def _cut(self, word: str) -> list[str]:
        """A long word, cut where no piece spans two characters."""
        within, a, out = self.within, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in within:
                out.append(word[a:k])
                a = k
        return [*out, word[a:]]

    def learn(self, words: list[str]) -> None:
        """Finds new words and keeps them."""
        found: list[tuple[bytes, float, float]] = []
        held, size, short = [], 0, [w for w in words if len(w) <= _LONG]
        for w in short:
            held.append(w)
            size += len(w)
            if size >= _EDGE_CHARS:
                found += self.search_many(held)
                held, size = [], 0
        if held:
            found += self.search_many(held)
        long = [w for w in words if len(w) > _LONG]
        for w in long:
            parts = [self.search(part) for part in self._cut(w)]
            found.append((b"".join(f[0] for f in parts), sum(f[1] for f in parts), min(f[2] for f in parts)))
        self.known.update(zip([*short, *long], range(len(self.found_ids), len(self.found_ids) + len(words)), strict=True))
        ids, score, loss = zip(*found, strict=True)
        self.found_ids += ids
        self.found_size = np.concatenate((self.found_size, np.fromiter(map(len, ids), np.int64, len(ids))))
        self.found_score, self.found_loss = np.concatenate((self.found_score, score)), np.concatenate((self.found_loss, loss))

    def _options(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        key = (word, n)
        if key not in self.paths:
            if len(self.paths) >= _PATHS:
                self.paths.clear()
            self.paths[key] = self.n_best(word, n)
        return self.paths[key]

    def encode_many(self, texts: list[str | None], n: int = N_BEST) -> Iterator[tuple[list[tuple[float, bytes]], bytes]]:
        """Of each text: its n best segmentations (score, ids as little-endian unsigned 32-bit numbers), and
        the bytes that the best one decodes to. Texts are taken in groups of about a million characters."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHARS):
                size += len(texts[end] or "")
                end += 1
            segs = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[at:end]]
            words = set().union(*segs)
            new = words - self.known.keys()
            if len(self.known) + len(new) > _KNOWN and self.known:
                self.known, self.found_ids = {}, []
                self.found_size, self.found_score, self.found_loss = np.empty(0, np.int64), np.empty(0), np.empty(0)
                new = words
            if new:
                self.learn(list(new))
            yield from (self._segmentations(s, n) for s in segs)
            at = end

    def _segmentations(self, segs: list[str], n: int) -> tuple[list[tuple[float, bytes]], bytes]:
        if not segs:
            return [(0.0, b"")], b""
        place = list(map(self.known.__getitem__, segs))
        where = np.array(place)
        loss = self.found_loss[where]
        base = float(self.found_score[where].sum())
        some = np.argsort(loss, kind="stable")[: n - 1] if len(loss) <= 4 * n else np.argpartition(loss, n - 2)[: n - 1]
        paths: list[tuple[float, list]] = [(0.0, [])]
        for at in sorted(int(i) for i in some if np.isfinite(loss[i])):
            options = self._options(segs[at], n)
            paths = heapq.nsmallest(n, [(d + options[0][0] - s, [*p, (at, starts)]) for d, p in paths for s, starts in options], key=lambda x: x[0])
        ids, ends = b"".join(map(self.found_ids.__getitem__, place)), np.cumsum(self.found_size[where])
        out = [(base, ids)]
        for d, path in paths[1:n]:
            parts, done = [], 0
            for at, starts in path:
                parts += [ids[done : ends[at] - self.found_size[place[at]]], self.encoded(segs[at], starts)]
                done = ends[at]
            out.append((base - d, b"".join([*parts, ids[done:]])))
        return out, b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: (score, ids as little-endian unsigned 32-bit numbers)."""
        return next(self.encode_many([text], n))[0]

    def decode(self, ids) -> str:
        """Text of ids: runs of byte pieces are UTF-8, the dummy space in front goes."""
        return b"".join([self.text_of[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """(id, n_pieces, score, ids_crc32, nbest_scores, nbest_crc32, decoded_sha256, round_trip)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = pieces_of(model)
        for b in sliced(batches, 1000):
            rows = []
            for id_, text, (best, back) in zip(b["id"], b["text"], sp.encode_many(b["text"].tolist(), n), strict=True):
                rows.append((id_, len(best[0][1]) // 4, best[0][0], zlib.crc32(best[0][1]), [s for s, _ in best], [zlib.crc32(i) for _, i in best], hashlib.sha256(back).hexdigest(), back == (text or "").encode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["id", "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_crc32", "decoded_sha256", "round_trip"])
            yield out.astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
