import random

import corpus_pipeline
import pytest

from skywave.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    """Components of all pairs at a Jaccard similarity of 0.8 or more, as the least index of each."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def edited():
    """Texts with copies of one to twelve changed words, a long chain of small edits, and a large group."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    out = ["", None, "one two", "One  TWO", "one two three four five"]
    for k in range(40):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        out.append(" ".join(base))
        for changes in (1, 2, 4, 1 + k % 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            out.append(" ".join(copy))
    chain = [word() for _ in range(150)]
    for _ in range(30):
        chain[rng.randrange(len(chain))] = word()
        out.append(" ".join(chain))
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(len(copy)), 1):
            copy[at] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("group", [256, 8])
def test_near_copies_against_all_pairs(spark, group):
    texts = edited()
    want = plain_components(texts)
    rows = nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), group=group).collect()
    assert len(rows) == len(texts)
    least = {}
    for r in rows:
        least[r.component] = min(r.id, least.get(r.component, r.id))
    assert [least[c] for _, c in sorted((r.id, r.component) for r in rows)] == want
    assert max(want.count(r) for r in set(want)) > 50


def test_groups_that_fall_apart_meet_all_of_their_group(spark):
    """All nodes share a key by force, so that blocks and the second search must find each link."""
    from pyspark.sql import functions as F

    texts = [t for t in dict.fromkeys(edited()) if len(plain_set(t)) > 0][:90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = {nearcopies._node(nearcopies.shingles(t)): i for i, t in reversed(list(enumerate(texts)))}
    frame = spark.createDataFrame(list(nodes), "long").toDF("node").withColumn("keys", F.array(F.lit(7).cast("long")))
    ids = spark.createDataFrame([(i, n) for n, i in nodes.items()], "id long, node long")
    found = nearcopies.links(frame, lambda some: nearcopies.sets_of(docs, "doc_id", ids.join(some, "node", "left_semi")), 4).collect()
    root = {i: i for i in nodes.values()}
    for _ in range(len(root)):
        for r in found:
            root[nodes[r.a]] = root[nodes[r.b]] = min(root[nodes[r.a]], root[nodes[r.b]])
    want = plain_components(texts)
    assert all(root[i] == root[want[i]] for i in root if want[i] in root)
    assert len(set(root.values())) == len({want[i] for i in root})


def test_simhash_groups_are_linked_where_no_band_is(spark):
    """Without any band key what remains is SimHash: near copies within 3 bits, each verified on its set."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join(["begin", *base])]
    texts += ["", "one", "one two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.prints(docs, "doc_id").collect()
    assert {r.id: r.fp for r in rows}[60] == 0
    frame = spark.createDataFrame([(r.id, r.node, r.fp) for r in rows], "id long, node long, fp long").withColumn("keys", F.array().cast("array<long>"))
    groups = nearcopies.simhash_groups(frame)
    found = nearcopies.links(groups.select("node", "keys", "simhash"), lambda some: nearcopies.sets_of(docs, "doc_id", frame.join(some, "node", "left_semi"))).collect()
    at = {r.node: r.id for r in rows}
    pairs = {tuple(sorted((at[r.a], at[r.b]))) for r in found}
    near = [(a, b) for a in range(60) for b in range(a + 1, 60) if (rows_fp(rows, a) ^ rows_fp(rows, b)).bit_count() <= 3]
    assert len(near) >= 30 and all(a // 3 == b // 3 for a, b in pairs)
    root = {i: i for i in range(60)}
    for _ in range(3):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[a] == root[b] for a, b in near)
    # the same group by fingerprint, unlike by their sets: no link
    apart = frame.where("id in (0, 3)").withColumn("simhash", F.lit(1).cast("long"))
    assert not nearcopies.links(apart.select("node", "keys", "simhash"), lambda some: nearcopies.sets_of(docs, "doc_id", frame.join(some, "node", "left_semi"))).collect()


def test_checkpoints_of_many_partitions_have_few_files(spark):
    """Each file costs processes of the executor, whose memory was read twice where one was just being made."""
    from skywave.llm.common import in_few_files

    most = max(32, 4 * spark.sparkContext.defaultParallelism)
    df = in_few_files(spark.range(5000).repartition(most + 100))
    assert df.rdd.getNumPartitions() == most and df.count() == 5000
    assert in_few_files(spark.range(10).repartition(2)).rdd.getNumPartitions() == 2


def rows_fp(rows, i):
    return next(r.fp for r in rows if r.id == i) & (2**64 - 1)


def test_stage_keeps_one_of_a_pair_that_few_bits_do_not_link(spark, data):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    copy = list(base)
    for at in (20, 90, 150):
        copy[at] = "other"
    a, b = plain_set(" ".join(base)), plain_set(" ".join(copy))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9
    apart = " ".join(f"v{i}" for i in range(200))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([" ".join(copy), " ".join(base), apart])], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect()) == [0, 2]


def test_stage_keeps_one_row_of_a_group_where_rows_share_an_id(spark, data):
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "xyz")
    rows = [(1, one), (1, two), (0, two), (2, one), (None, three), (None, one), (None, three), (1, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (0, two), (None, three)], key=str)


def test_no_link_of_a_table_is_lost(spark):
    """All pairs of the 1,000 documents of the larger test table: recall of links and components."""
    import os
    from collections import Counter

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [plain_set(t) for _, t in rows]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.id: r.component for r in nearcopies.near_copies(docs).collect()}
    assert len(links) > 20 and sum(sets[a] != sets[b] for a, b in links) >= 3
    assert all(got[rows[a][0]] == got[rows[b][0]] for a, b in links)
    assert len(set(got.values())) == len({top(i) for i in range(len(rows))})
