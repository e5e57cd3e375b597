"""Periodic runs against a plain search of all lags, and the query as a whole."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from skywave.llm import periods

WHITE = " \t\n\v\f\r"


def split(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def runs_plainly(words, least=12, exponent=2):
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1 if j == i else j
    return sorted((a, p, n) for (a, n), p in found.items())


def collapsed_plainly(words, runs):
    gone = {i for a, p, n in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count, words=80):
    rng, out = random.Random(seed), []
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 3, 6]), rng.randrange(words)
        w = [rng.choice("abcdef"[:kinds]) for _ in range(n)]
        if n > 10 and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(a + p, n):
                w[i] = w[i - p]
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(w))
    return [*out, None, "", " ", "a " * 700, " x y z " * 40, "b a " * 300 + "c"]


def plain(text, least=12, exponent=2):
    words = split(text)
    runs = runs_plainly(words, least, exponent)
    return len(words), [(a, n, p) for a, p, n in runs], collapsed_plainly(words, runs)


def found(x):
    return x["n_words"], [(r["start"], r["length"], r["period"]) for r in x["runs"]], x["collapsed"]


@pytest.mark.parametrize(("least", "exponent"), [(12, 2), (1, 2), (4, 3), (30, 2)])
def test_runs_are_those_of_a_plain_search(least, exponent):
    some = texts(least * 10 + exponent, 400)
    assert [found(x) for x in periods.runs_of(pa.array(some), least, exponent).to_pylist()] == [plain(t, least, exponent) for t in some]


@pytest.mark.parametrize("lags", [7, 40, 4096])
def test_lags_of_long_documents_are_dealt_out(spark, lags):
    rows = [(i if i % 9 else None, t, t, "x") for i, t in enumerate(texts(5, 60, 200) * 2)]
    d = spark.createDataFrame(rows, "doc_id long, body string, row string, PERIODS string")
    got = periods.periodic_runs(d, "body", "runs_of", lags=lags).collect()
    assert got[0].asDict().keys() == {"doc_id", "body", "row", "PERIODS", "runs_of"}
    key = lambda r: (r[0] is None, r[0], str(r[1]), r[2])
    assert sorted(((r.doc_id, r.body, found(r.runs_of.asDict(True))) for r in got), key=key) == sorted(((i, t, plain(t)) for i, t, _, _ in rows), key=key)
    assert periods.periodic_runs(d.limit(0), "body", "runs_of", lags=lags).count() == 0


def test_work_of_equal_words_is_not_squared():
    for text in ("a " * 200_000, "a b c " * 70_000):
        (x,) = periods.runs_of(pa.array([text])).to_pylist()
        assert len(x["runs"]) == 1


def query_plainly(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_plainly(words)
    top = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    own = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    lines = "".join(f"{a},{k},{p}\n" for a, p, k in runs)
    return (doc_id, len(runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed_plainly(words, runs).encode()).hexdigest())


def test_query_as_a_whole(spark, data, tmp_path):
    some = texts(8, 300, 150)
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for folder in (str(tmp_path), data):
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("length(text) < 20000").collect() if folder == data else list(enumerate(some))
        got = {r.doc_id: tuple(r[c] for c in names) for r in periods.op11_periodic_runs(spark, folder).collect()}
        assert [got[i] for i, _ in rows] == [query_plainly(i, t) for i, t in rows]
    assert periods.op11_periodic_runs(spark, str(tmp_path)).columns[:8] == names
