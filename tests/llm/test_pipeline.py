"""Each stage of the pipeline on the given documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from segue.llm import secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "x", 0)], docs.schema)
    kept = {}
    at = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = at = spark.read.parquet(f"{tmp_path}/{name}")
    good = kept["quality classifier"]
    judged = labels.join(good.select("doc_id", F.lit(1).alias("stays")), "doc_id", "left").where("quality = 1")
    assert judged.where("stays is null").count() <= 0.02 * judged.count()
    assert labels.where("quality = 0").join(good, "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
    near = kept["near duplicates"]
    assert near.join(good, "doc_id", "left_anti").count() == 0
    texts = good.where("text != ''").select("text").distinct().count()
    assert near.where("text != ''").count() <= texts and near.select("doc_id").distinct().count() == near.count()
    rest = kept["suffix-array dedup"]
    windows = [t[i : i + 100] for (t,) in rest.select("text").collect() for i in range(0, max(0, len(t or "") - 99))]
    assert rest.count() <= near.count() and len(windows) - len(set(windows)) < 0.02 * len(windows)  # new neighbours may meet where a passage went
    safe = kept["secret scan"]
    assert safe.count() == rest.count()
    assert secret_scan.base_spans(safe).where("size(assign) + size(access) + size(hex) > 0").count() == 0
    pieces = kept["packing"]
    assert pieces.select("doc_id").distinct().count() == safe.count()


def test_empty_table(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        assert at.count() == 0


def test_repeated_and_long_rows_of_near_duplicates(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long + " end", "en", "b", 2), (3, other, "en", "a", 3), (3, "quite another text of seven words", "en", "a", 3), (None, other, None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((x.doc_id or 0, (x.text or "")[:5]) for x in got.collect()) == sorted([(0, ""), (0, other[:5]), (1, long[:5]), (3, other[:5]), (3, "quite")])


def test_run_leaves_only_its_result(spark, tmp_path):
    from segue.llm import common

    before = common.scratch_dir(spark).rsplit("/", 1)[0].removeprefix("file:")
    import os

    held = set(os.listdir(before)) if os.path.isdir(before) else set()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
    assert len(set(os.listdir(before)) - held) <= 1


def test_texts_that_share_an_id(spark):
    """A text found nowhere else stays in every stage, whatever ids other texts have, and so do further columns of clashing names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1, "x", 1), (2, a, "en", "s", 1, "y", 2), (2, b, "en", "s", 1, "z", 3), (2, a + " more", "de", "s", 1, "v", 4), (3, c, "en", "s", 1, "w", 5), (3, c, "en", "s", 1, "w", 5), (3, b + " tail", "en", "s", 1, "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n_removed int")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted((x.doc_id, x.text, x.spans) for x in near.collect()) in ([(1, a, "x"), (2, b, "z"), (3, c, "w")], [(1, a, "x"), (3, b + " tail", "u"), (3, c, "w")], sorted([(1, a, "x"), (3, b + " tail", "u"), (3, c, "w")]))
    rest = corpus_pipeline.repeated_text(spark, docs, SF)
    assert rest.columns == docs.columns
    assert sorted((x.doc_id, x.text, x.n_removed) for x in rest.collect() if x.spans in "xz") == [(1, a, 1), (2, b, 3)]
    safe = corpus_pipeline.secrets(spark, docs, SF)
    assert safe.columns == docs.columns and safe.count() == len(rows)
