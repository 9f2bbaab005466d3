"""From raw documents to packed sequences: five stages over a table of documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of ``documents``; ``run`` writes every result as Parquet in
the checkpoint folder and reads it again.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsleuth.llm import bpe, line_dedup, minhash, packing, pii, quality
from logsleuth.llm.queries import VOCABULARY
from logsleuth.operators.distribute import store


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, in tables that have it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passing(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat in others; n_chars follows."""
    index = line_dedup.LineIndex.build(docs)
    return with_length(line_dedup.drop_lines(docs, index).select(*docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; rows without an id stay."""
    judged = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = judged.filter("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows."""
    return with_length(pii.redact(docs, pii.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, encoded and packed into sequences."""
    return packing.pack(bpe.encode(docs.select("doc_id", "text"), VOCABULARY))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Weighted sampling, the random field and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
