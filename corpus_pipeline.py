"""Five steps from raw documents to packed training sequences, each written and read again as the next one's input.

1. Documents that the quality classifier rejects go. 2. Of each group of near-duplicates the document with the least id
stays. 3. Documents into which a benchmark item leaks go. 4. Secrets in the texts are replaced. 5. Texts are tokenized
and packed. All but the last return the columns of documents; n_chars follows the text where a step changes it.

Rows without an id are kept by every step but take no part in grouping. Of repeated rows of an id one stays if their texts
are near-duplicates; texts unlike each other all stay.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrain.llm import common, decontaminate, packing, quality, secrets_scan, simhash

#: Rows of whole texts that a Python worker holds at once. Workers and their executor's buffers keep what the largest batch took, all stages long.
BATCH = 1000


def in_small_batches(step):
    """The step, with Arrow batches of BATCH rows at most; as its result is lazy, the session keeps that."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, str(BATCH))
        return step(spark, docs, sf_dir)

    return run_step


@in_small_batches
def quality_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.3)


@in_small_batches
def dedup_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: operator 1 on five-word shingles, with all links of similarity 0.8 or more.

    Fingerprints within two bits link first (their documents are all but alike), the wide part finds the other pairs. Of a group
    the row with the least id stays; of repeated rows of an id only those go that are copies, texts unlike each other stay.
    """
    found = common.cut(simhash.near_duplicates(docs.where("doc_id is not null"), words=5, distance=2, similarity=0.8).select("doc_id", "fp", "kept"), "found")
    keys = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).where("n > 1 or not kept")
    touched = common.cut(common.few_files(keys.select("doc_id", "n"), found), "touched")
    single = common.without(docs, touched)
    repeated = touched.where("n > 1").select("doc_id")
    again = common.may_hold(docs, repeated, "doc_id").join(repeated, "doc_id", "left_semi").withColumn("__fp", simhash.fingerprint(F.col("text"), 5))
    stay = found.where("kept").select("doc_id", F.col("fp").alias("__fp")).join(repeated, "doc_id", "left_semi")
    again = again.join(stay.distinct(), ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"])
    return single.union(again.select(docs.columns))


@in_small_batches
def decontamination_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark"), item_key="item_id").select("doc_id")
    return common.without(docs, common.cut(leaks.distinct(), "leaks"))


@in_small_batches
def secrets_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets_scan.redact_documents(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


@in_small_batches
def packing_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_step),
    ("SimHash near-dedup", dedup_step),
    ("benchmark decontamination", decontamination_step),
    ("secret scans", secrets_step),
    ("best-fit packing", packing_step),
]

#: Trained models and tokenizers can't be put in SQL; tests/llm holds the pipeline against its steps one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for n, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.cut(docs, name.replace(" ", "-"))
    return docs
