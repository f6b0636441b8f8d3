"""The pipeline's stages, each against plain Python on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_line_dedup import brute as brute_lines  # noqa: E402
from test_mix_and_leaks import check_mix, leaks, words  # noqa: E402
from test_near_dedup import brute as brute_near  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"documents": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
    ids = {n: {r.doc_id: r for r in rows} for n, rows in kept.items()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    assert len(good & set(ids["quality"])) >= 0.97 * len(good) and len(ids["quality"]) < len(ids["documents"])

    lines = brute_lines([(r.doc_id, r.text) for r in kept["quality"]])
    gone = {i for i, t in lines.items() if not t.split() and ids["quality"][i].text != t}
    assert {i: r.text for i, r in ids["line_dedup"].items()} == {i: t for i, t in lines.items() if i not in gone}
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    near = brute_near([(r.doc_id, r.text) for r in kept["line_dedup"]], 5)
    assert set(ids["near_dedup"]) == {i for i, (_, c) in near.items() if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = {tuple(words(t)[k : k + 5]) for _, t in items for k in range(len(words(t)) - 4)}
    hit = [(r.doc_id, r.text) for r in kept["near_dedup"] if any(tuple(words(r.text)[k : k + 5]) in seeds for k in range(len(words(r.text)) - 4))]
    assert set(ids["decontaminate"]) == set(ids["near_dedup"]) - {i for i, _ in leaks(hit, items)}

    check_mix(kept["mix"])
    assert set(ids["mix"]) == set(ids["decontaminate"])
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id: r.taken for r in kept["mix"]}


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, extra columns with names of the stages' own, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    kind = docs.schema
    odd = spark.createDataFrame([(None, "some words of a text without an id", "en", "src1", 35), (10**6, None, None, None, None), (10**6 + 1, "", "de", "src2", 0), (10**6 + 2, "twice the same row " * 9, "en", "src1", 171), (10**6 + 2, "twice the same row " * 9, "en", "src1", 171)], kind)
    rows = docs.unionByName(odd).withColumn("kept", F.lit("k")).withColumn("component_id", F.lit(7)).withColumn("n_words", F.lit(None).cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns, name
        left = out.collect()
        assert {10**6, 10**6 + 1, None} <= {r.doc_id for r in left} and len(left) <= 65, name
        assert all(r.kept == "k" and r.component_id == 7 for r in left), name
        assert stage(spark, rows.limit(0), sf_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, rows, sf_dir).count() == 65 and last(spark, rows.limit(0), sf_dir).count() == 0
