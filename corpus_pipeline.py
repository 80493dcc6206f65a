"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. Models are learned from the table ``documents`` (and
``labels``) under ``sf_dir``, not from what earlier stages left, so a stage decides about a
document by the document alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import common, language_id, packing, quality, secrets
from graphweave.llm.ngram_join import JaccardJoin

#: A language must be this probable for a document to stay.
LEAST_LANGUAGE_SCORE = 0.5
REDACTED = "[redacted]"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below the threshold go."""
    every, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(every.where(common.learns()), labels.where(common.learns()))
    scored = quality.score(docs.withColumn("body", F.col("text")), model, text="body", keep=tuple(COLUMNS))
    return scored.where("predicted = 1").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no language, or of none that is probable enough, go."""
    model = language_id.train(common.table(spark, sf_dir, "documents").where(common.learns()))
    found = language_id.predict(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each group one row stays, that with the smallest id.

    Rows are told apart by a number of their own, so those that repeat an id, or have none, are
    rows like others; a null id comes after all others, and of rows with one id any may stay.
    Rows without words stay.
    """
    rows = common.materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows", long=True)
    groups = JaccardJoin(rows, width=5, num=80, den=100, key="row").membership().select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span that is found is replaced in the text."""
    models = secrets.train(secrets.labelled_samples(common.table(spark, sf_dir, "documents")))
    found = secrets.scan(docs, models, keep=("doc_id", "lang", "source"), redact=REDACTED)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("bigint").alias("n_chars")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document with their sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Models and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{k}", long=True)
    return docs
