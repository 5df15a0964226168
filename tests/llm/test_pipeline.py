import random

import corpus_pipeline


def test_stages_work_on_what_the_one_before_kept(spark, documents, tmp_path):
    rng = random.Random(5)
    words = [f"wort{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))), "en", f"s{i % 3}") for i in range(90)]
    rows += [(200, rows[0][1] + " extra", "en", "s0"), (201, "too short", "en", "s1"), (202, None, "en", "s2"), (203, rows[1][1] + " token=abcdef123456", "en", "s1")]
    path = f"{tmp_path}/documents.parquet"
    documents(rows).write.parquet(path)
    docs = spark.read.parquet(path)
    columns = docs.columns
    docs = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == {i for i, *_ in rows} - {201, 202} and docs.columns == columns
    docs = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == {i for i, *_ in rows} - {200, 201, 202, 203} and docs.columns == columns
    assert corpus_pipeline.secret_scan(spark, docs, str(tmp_path)).count() == 90
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mixture", "packing"]


def test_stages_with_odd_rows(spark, documents):
    """Null texts, ids and sources, repeated rows, clashing columns; then no rows at all."""
    text = " ".join(f"wort{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " more", "en", None), (2, None, None, "b"), (3, "", "en", "b"), (4, " ".join(f"xyz{i}" for i in range(50)) + " token=abcdef12345", "en", None)]
    docs = documents(rows).selectExpr("*", "1 AS _gone", "2 AS gone", "3 AS _row", "4 AS failures", "5 AS spans", "6 AS size", "7 AS doc_key", "8 AS text_2", "9 AS _copies")
    want = {"quality_rules": 4, "near_duplicates": 4, "secret_scan": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() == want.get(name, out.count()) and stage(spark, docs.limit(0), "").count() == 0, name
    packed = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, None} and sum(r["length"] for r in packed if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in packed if r["doc_id"] == 1)
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {(1, text), (2, None), (3, ""), (4, rows[-1][1])}
