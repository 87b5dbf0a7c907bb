"""Training corpus from documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.llm import mixing, near_dedup, packing, quality, toxicity
from drawloom.llm.common import clear_stages, stage, staged_so_far, table
from drawloom.llm.queries import WORD_TOKENIZER


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity; the classifier learns from the labels table.

    Null and empty texts stay, repeated rows stay or go together, no rows give
    no rows.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source.

    Null and empty texts do not pass; no rows give no rows.
    """
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8).

    Every row is a document, whatever its doc_id.  The one with the least doc_id
    stays (nulls last), of several the one that comes first by the hash of its
    text.  Rows without words all stay; no rows give no rows.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("_dedup_row"), *docs.columns))
    groups = stage(near_dedup.near_duplicates(rows, words=5, threshold=(80, 100), id_col="_dedup_row").select("_dedup_row", "component_id"))
    place = rows.select("_dedup_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col("_dedup_row").alias("row")).alias("place"))
    first = groups.join(place, "_dedup_row").groupBy("component_id").agg(F.min("place")["row"].alias("_dedup_row"))
    return rows.join(first.select("_dedup_row"), "_dedup_row", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; no rows give no rows."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; each repeated row is packed; no rows give no rows."""
    return packing.best_fit_packing(docs, WORD_TOKENIZER, capacity=2048)


STAGES = [("toxicity", civil), ("quality", good), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: Classifier, sketches and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage staged for itself goes once its output is written."""
    docs, begun = table(spark, sf_dir, "documents"), staged_so_far()
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
        clear_stages(spark, begun, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
