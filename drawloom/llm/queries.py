"""The queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import centroids, html_text, license_scan, mixing, near_dedup, packing, quality, secrets, token_counts, topk, toxicity, url_filter, whitening
from .common import table
from .sql import ORACLES

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=2048)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), query_every=100, k=10)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in base))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.entropy_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.train_labeller(pages))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.license_of(docs, license_scan.train(spark, docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"), components=32, scale=64, offset=1_000_000)
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = centroids.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dimensions=64, scale=1024, seed=3)
    digest = F.sha2(F.concat_ws(",", F.transform("components", lambda c: c.cast("string"))), 256)
    whole = F.sum("inertia").over(Window.partitionBy(F.lit(0)))  # eight rows
    each = found.select("cluster", F.expr("try_cast(inertia AS BIGINT)").alias("cluster_inertia"), whole.cast("decimal(38,0)").alias("whole"), digest.alias("centroid_sha256"))
    each = each.select("cluster", "cluster_inertia", F.expr("try_cast(whole AS BIGINT)").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secret_spans(table(spark, sf_dir, "documents")).select("doc_id", F.col("secret_spans").alias("found"))
    base = [r.kind for r in secrets.BASE_RULES]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    only = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(only(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(listed(only(*base)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_best_fit_packing, op4_exact_topk, op5_quality_rules, op6_source_mixing, op7_toxicity, op8_url_filter, op9_html_text, op10_license_scan, op11_whitening, op12_centroids, op13_secrets)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
