"""The corpus pipeline: low quality out, rule failures out, one of each near-duplicate group, surrogates for personal data, and
packed sequences. Each stage takes (spark, docs, sf_dir) and reads what its predecessor kept, from Parquet.

Both classifiers are fitted on the labelled ones of all documents of sf_dir, not on what an earlier stage kept: there, few or no bad
examples are left. Verdicts go with the row, whatever its doc_id.

Null text counts as empty: the first stage rejects it, as it rejects empty and blank text. Rows without doc_id, and rows that share
one, are judged, compared, replaced and packed each. Of equal or near-equal rows the one with the smallest doc_id stays, of these
with equal doc_ids the one with the smallest text; rows without doc_id come last. Texts of any length are read whole. No documents
give no rows. Extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import neardup, packing, pii, quality, rules
from codeloom.llm._shared import documents, labels, written


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, quality.fit(documents(spark, sf_dir), labels(spark, sf_dir)))


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.select(docs, rules.fit(documents(spark, sf_dir), labels(spark, sf_dir)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the dropped rows' keys meet the texts. Where doc_id is no key, rows get one for this stage."""
    names, key = docs.columns, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        key = next(k for k in (f"row{i}" for i in range(len(names) + 1)) if k not in names)
        docs = written(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = neardup.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti").select(*names)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.surrogates(docs, spans=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))[0]


STAGES = [
    ("quality classifier", by_quality),
    ("quality rules", by_rules),
    ("near duplicates", without_near_duplicates),
    ("personal data", with_surrogates),
    ("packing", packed),
]

#: Trained models, sketches and the packing plan are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
