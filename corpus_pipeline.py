"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data
is replaced, and what remains is packed into sequences.

Defined cases, for every stage: a null text counts as empty and a null doc_id is kept (null or empty texts are
copies of each other); texts of any length are taken whole; repeated rows are judged each, and near-duplicates keep
one of them; an empty table gives an empty table; columns beyond those of documents are kept, whatever their
names, up to packing, which returns pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import packing, pii, simhash, toxicity
from mnemora.llm.common import ARROW_ROWS, give_back, written


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    give_back()  # the later stages' driver is the same process
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of texts that five-word shingles of a similarity of 0.8 or more connect: that of
    the smallest doc_id (rows without one come last), of the smallest text hash among equal ids. Different
    texts of one id are rows of their own; of equal rows one stays."""
    _small_batches(spark)
    return simhash.one_of_each(docs, spark, words=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in angle brackets; n_chars follows the text."""
    _small_batches(spark)
    clean = pii.redact(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
