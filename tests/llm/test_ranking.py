"""Ranked search against plain scores of all documents, and its max trees."""

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pytest

from skywave.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plainly(docs, queries, k):
    words = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in words]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in words for t in c)
    out = set()
    for item, text in set(queries):
        weights = {t: floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        found = []
        for (i, c), n in zip(words, sizes):
            m = 10 + 90 * n * n_docs // total if total else 0
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)}
    return out


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "OF", "Éa", "éa", "x1", "don't", "naïve", "ZZ", "b-c", "日本"] + [f"w{i}" for i in range(40)]
    weigh = [30] * 3 + [6] * 7 + [1] * 40
    text = lambda most: rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, weigh, k=rng.randrange(most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(i + n, docs[i][1]) for i in range(n // 3)]  # equal scores
    docs += [(5, "other words of the same id w1 w2"), (None, "w1 w2 the"), (None, docs[1][1]), (2**60 + 1, docs[2][1]), (7, None), (8, ""), (9, " .,"), (10, "w3 " * 3000)]
    rng.shuffle(docs)
    queries = [(i, text(12)) for i in range(40)] + [(1, "w1 w2"), (2, None), (3, ""), (4, "none of these: qqq"), (None, "w5 W5 the"), (6, "w1"), (6, "w1"), (60, " ".join(vocabulary))]
    return docs, queries


@pytest.mark.parametrize(("options"), [{}, {"block_terms": 20, "range_rows": 37}, {"range_rows": 1, "k": 3}])
def test_search_is_exact(spark, options):
    docs, queries = rows(3, 150)
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, doc_id int")
    got = ranking.ranked(d, q, **options).collect()
    assert len(got) == len({tuple(r) for r in got}) or options.get("k") != 3
    assert {tuple(r) for r in got} == plainly(docs, queries, options.get("k", 10))


def test_nothing_to_search(spark):
    docs, queries = rows(4, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text IS NULL"), q)):
        got = ranking.ranked(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_equal_bounds_are_opened_and_others_are_not():
    n = 4096
    doc, term = np.arange(n), np.zeros(n, np.int64)
    impact = np.where(doc % 1000 == 7, 500, 3)
    ids = n - doc  # the smaller ids come last
    best = []
    tree = ranking.Tree(n, doc, term, impact)
    opened = tree.search(np.array([0]), np.array([10]), ids, np.zeros(n, bool), best, 3)
    assert sorted(best, reverse=True) == [(5000, True, -(n - 4007)), (5000, True, -(n - 3007)), (5000, True, -(n - 2007))]
    assert opened == 1 + 2 + 5 + 5 or opened < 25  # of 128 leaves those of the five best, and the nodes over them
    assert tree.search(np.array([9]), np.array([10]), ids, np.zeros(n, bool), best, 3) == 0


def test_query_is_its_sql(spark, data):
    got = {tuple(r) for r in ranking.op13_ranked_search(spark, data).select("item_id", "rank", "doc_id", "score").collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    assert got == set(con.execute(ranking.ORACLE_SQL).fetchall()) and got
