import corpus_pipeline


def test_stages_on_awkward_rows(spark, data, tmp_path):
    from tests.llm.test_llm import SCHEMA, odd_rows

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and rows.where("offset + length > 2048").count() == 0
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_stages_keep_columns_of_any_name(spark, data):
    """Names that the operators use, or once used, themselves."""
    names = ["_z", "_bucket", "_kept", "_scan_id", "_scan_live", "n_bytes", "n_removed", "kept_sha256", "_toxicity", "toxicity", "repeats", "packed", "bucket", "kept_id", "kept_hash", "kept_rows", "scan_id", "scan_hash", "scan_runs", "row", "spans", "id", "c0", "m0", "score", "start", "end"]
    texts = ["password = hunter22 " + " ".join(f"w{i}" for i in range(60)), "p" * 260, "q" + "p" * 260, None, ""]
    rows = [(i, t, "en", "s", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
