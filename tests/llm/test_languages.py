"""Language identification: vectors against plain counts, centroids, held-out accuracy, rejection and awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skywave.llm import languages

WORDS = {
    "en": "the and thing other house water with from their which would there people little after".split(),
    "fr": "les une être maison avec pour dans leur quelle même après eau petite gens où ça".split(),
    "de": "der die das haus wasser mit von über welche würde menschen klein größer nach schön und".split(),
    "el": "και το σπίτι νερό με από που θα άνθρωποι μικρό μετά είναι δεν".split(),
}


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(1, 60))) + rng.choice(["", ".", "!\n", " 12 "]), lang))
    return out


def grams(text):
    words, w = [], ""
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            w += ch
        elif w:
            words.append(w)
            w = ""
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_vectors_are_those_of_plain_counts():
    texts = ["The house, the WATER.", "", None, "12 ,,", "a", "été—où?", "x" * 50, "  b  a\nb "]
    dims = 18  # so many buckets that these grams share none
    got, there = languages.counts_of(texts, dims)
    assert there.tolist() == [bool(grams(t)) for t in texts]
    for t, v in zip(texts, got):
        assert sorted(v[v > 0].tolist()) == sorted(map(float, grams(t).values()))
    idf = np.full(1 << dims, 2.0, np.float32)
    x, _ = languages.vectors_of(texts, idf, dims)
    for t, v in zip(texts, x):
        want = sorted((math.log(n) + 1) * 2 for n in grams(t).values())
        norm = math.sqrt(sum(w * w for w in want)) or 1
        assert np.allclose(sorted(v[v > 0]), [w / norm for w in want], atol=1e-6)


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"w{'abcdefg'[i % 7] * (i % 5 + 1)}" for i in range(4000))
    whole = languages.counts_of([text, "b", text], 12)[0]
    monkeypatch.setattr(languages, "CHUNK", 500)
    assert (languages.counts_of([text, "b", text], 12)[0] == whole).all()


def test_centroids_are_clusters_with_their_reach():
    rng = np.random.default_rng(3)
    middles = np.eye(6)[:3]
    x = np.concatenate([m + rng.normal(0, 0.05, (40, 6)) for m in middles])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    c, size, reach = languages.centroids_of(x, 3)
    assert sorted(size.tolist()) == [40, 40, 40] and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    own = np.argmax(x @ c.T, axis=1)
    assert np.allclose(reach, [(1 - x[own == k] @ c[k]).max() for k in range(3)], atol=1e-5)
    assert len(languages.centroids_of(np.repeat(x[:1], 9, axis=0), 4)[0]) == 1


@pytest.fixture(scope="module")
def model(spark):
    d = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in labelled()], "doc_id long, text string, lang string, id string")
    return languages.fit(d, max_rows=60, dims_log2=12)


def test_fit(model):
    df = Counter(g for _, t, _ in labelled() for g in set(grams(t)))
    assert set(model["langs"]) == set(WORDS) and len(model["langs"]) <= 4 * languages.CLUSTERS
    assert np.isclose(model["idf"].min(), math.log(401 / (1 + max(df.values()))) + 1, atol=0.02)  # all rows are counted, not the sample


def test_unseen_texts_and_rejection(spark, model):
    rows = [(i, t, lang) for i, t, lang in labelled(300, 9)]
    odd = [(900, None, "und"), (901, "", "und"), (902, "12 ,.-", "und"), (903, "日本語テキスト", None), (None, "the water", "en"), (904, "the people " * 9000, "en")]
    d = spark.createDataFrame([(i, t, w, 1) for i, t, w in rows + odd], "doc_id long, text string, lang string, score int").repartition(3)
    got = languages.identify(d, model, rejecting=False).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "score", "language"}
    right = [r.language.lang == r.lang for r in got if r.doc_id is not None and r.doc_id < 900]
    assert np.mean(right) > 0.97
    by = {r.doc_id: r.language for r in got}
    assert all(0 <= r.language.score <= 1 for r in got)
    assert [by[i].lang for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[903].lang in WORDS and by[903].far and by[None].lang == "en" and by[904].lang == "en"
    closed = {r.doc_id: r.language.lang for r in languages.identify(d, model).collect()}
    assert closed[903] == "und" and all(closed[i] == ("und" if by[i].far else by[i].lang) for i in closed)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "the", None), (2, None, None)], "doc_id long, text string, lang string")
    m = languages.fit(d, dims_log2=10)
    assert [(r.doc_id, r.language.lang, r.language.score) for r in languages.identify(d, m).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert languages.identify(d.limit(0), m).count() == 0


def test_query_on_held_out_rows(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = languages.op12_language_ids(spark, data).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
