"""A training corpus in five stages: quality, lines, near-duplicates, mix, tokens.

Each stage reads what the one before wrote. All but the last return the columns of
``documents``; the last one returns digests of each row's tokens. The operators are imported by
the stages that use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier scores under 0.3.

    Null and empty texts are judged as empty ones, repeated rows each by its own text; an empty
    table stays empty. Columns of any name pass unchanged.
    """
    from tidewright.llm import quality_compression
    from tidewright.llm.common import table

    return quality_compression.keep_good(docs, quality_compression.train_compression(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts, n_chars following; a document that
    lost all its words goes.

    Null and empty texts, and rows without a doc_id, stay as they are; rows that repeat a doc_id
    lose the same lines, and the smallest doc_id keeps a line. Columns of any name pass unchanged.
    """
    from tidewright.llm import line_spread
    from tidewright.llm.common import WORD

    out, at = line_spread.shortened(docs)
    text, lost = F.col(at["text"]), F.col("n_removed") > 0
    if "n_chars" in at:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn(at["n_chars"], F.when(lost, F.length(text)).otherwise(F.col(at["n_chars"])).cast(kind))
    return out.where(~lost | text.rlike(WORD)).select(*at.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group with five-word shingle similarity 0.8
    or more stays. Rows without words or without a doc_id stay, and so do all rows that repeat
    the doc_id that stays. Columns of any name pass unchanged."""
    from tidewright.llm import setsketch

    return setsketch.drop_near_duplicates(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it, 0 to 3 times.

    Rows without words are never taken; a null source is a source, and rows that repeat a doc_id
    are sampled apart. Ties go by doc_id. Columns of any name pass unchanged.
    """
    from tidewright.llm import pareto_mix

    return pareto_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row for each copy. A null
    text is an empty one; other columns are not read."""
    from tidewright.llm import bpe

    return bpe.encode_decode(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: Compression, sketches and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents`` of ``sf_dir``. Each stage is written
    to a new shared folder and read again; an empty table gives no rows."""
    from tidewright.llm.common import shared_dir, table

    docs = table(spark, sf_dir, "documents")
    out = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
