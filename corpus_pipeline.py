"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a DataFrame; all but the
last return the columns of ``documents``, further ones included. ``run`` writes each stage's rows to the shared folder and reads them again, so a
lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.llm import mil_quality, minhash, packing, secret_scan, suffix_dedup
from segue.llm.common import removed, scratch, scratch_dir, table, written

#: No SQL: a trained classifier, MinHash and tokenizers cannot be said in it; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A row without an id is scored like any other and stays if it passes."""
    model = mil_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mil_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of equal rows one, and rows without an id all.

    Texts that share an id are documents of their own, each judged by itself.
    """
    return minhash.one_of_each(docs, width=5, percent=80)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that stand earlier go; a document of which nothing is left goes whole, one that was empty stays."""
    count = "_".join(["removed", *docs.columns])  # a name that no column has
    rest = suffix_dedup.dedup_rows(docs, count=count).where(F.col(count).isin(0) | (F.col("text") != ""))
    return sized(rest.drop(count))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    model = secret_scan.corpus_model(docs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    scanned = secret_scan.scan(docs.select("doc_id", "text", F.struct(*others).alias("others")), model, keep=("others",))
    return sized(secret_scan.masked(scanned, keep=("others",)).select("doc_id", "text", "others.*").select(*docs.columns))


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` told anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("suffix-array dedup", repeated_text), ("secret scan", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``. What a stage has written is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_dir(spark)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path, keep=True)
        if before:
            removed(spark, before)
        before = path
    return docs
