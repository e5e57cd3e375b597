from skywave.llm import ann


def test_ties_go_to_smaller_ids(spark):
    """All vectors are equally far from each other."""
    rows = [(i, [float(i == j) for j in range(64)]) for i in range(64)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i.isin(1, 50), k=3, search_share=9.0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(1, 1, 0), (1, 2, 2), (1, 3, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
