"""From raw documents to token files, in five stages. Each stage works on all that the one before it kept.

The classifier judges every row by its own text. In the later stages ``doc_id`` names a document: rows of one id
(repeated rows, or different texts) stay or go together, and an id goes if the stage's rule takes out any of its rows.
Rows with a null id pass the second and third stage, as no other row can stand for them, and are not drawn by the
mixing stage. Null and empty texts do not pass the classifier. Ties: of near duplicates the smallest id stays. Extra
columns stay, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import decontam, jaccard, mixing, quality, queries, tokens
from codelake.llm.store import BROADCAST_ROWS, new_path, written

#: SQL cannot train the model or encode text; tests hold the stages against brute force.
ORACLE_SQL = None


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (``left_semi``) or without (``left_anti``) an id of ``ids`` (one column), with all their
    columns, whatever their names. Rows of one id stay or go together; a null id is none of ``ids``."""
    few = written(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), "ids")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")).join(few, F.col("id") == F.col("_id"), how)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, queries.trusted(spark, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 and more): the smallest id."""
    groups = jaccard.jaccard_components(docs, k=5, percent=80)
    return _by_id(docs, groups.where("component_id <> doc_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return _by_id(docs, found.where("contaminated"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights; each at most once, so that ids stay unique."""
    drawn = mixing.mix_sources(docs, queries.levels(), queries.WEIGHTS, share=0.6, max_epochs=1)
    return _by_id(docs, drawn, "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_output(docs, queries.tokenizer())


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token output", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
