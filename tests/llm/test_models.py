"""Licence findings on planted lines."""

from pyspark.sql import functions as F

from segue.llm import license_scan


def test_licences(spark):
    lines = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "": "The warranty and the licence of the shop were void."}
    docs = [(i, f"Some prose here.\n{line}\nMore of it.") for i, line in enumerate(lines.values())] + [(10, None), (11, ""), (12, "word " * 300 + "\n"), (13, "x " * 100 + license_scan.TEMPLATES["mit"][0] + " y" * 100)]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(corpus)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {x.doc_id: x for x in license_scan.scan(df, model).collect()}
    assert [got[i].families for i in range(5)] == list(lines)
    assert got[0].spans == f"apache:17:{17 + len(lines['apache'])}" and got[10].n_found == got[11].n_found == got[12].n_found == 0
    assert got[13].families == "mit"
    found = license_scan.scan(corpus, model).join(corpus.select("doc_id", F.regexp_count("text", F.lit("(?i)licensed under|released under the|all rights reserved")).alias("n")), "doc_id")
    assert found.where("n != n_found").count() == 0 and found.where("n > 0").count() > 5
    assert license_scan.scan(df.limit(0), license_scan.train(df.limit(0))).collect() == []
