"""The registered queries of the operators: thin digests over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import codebooks, hosts, innerproduct, linededup, mixing, multiindex, oracles, packing, quality, repair, sanitise, secretscan, simhash, toxicity
from trailmark.llm.common import held_out, table


def op1_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs.select("doc_id", "text"), model, name="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != sanitise.TERM_KIND)
    counts = [sanitise.spans_of(k).alias(f"n_{k}") for k in sanitise.KINDS]
    return found.select("doc_id", *counts, F.sha2(sanitise.digest(base), 256).alias("base_sha256"), sanitise.digest(F.col("spans")).alias("spans"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"))


def op5_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), model, name="t").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "t.*")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours", "nearness", "terms")


def op6_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents"))


def op7_partial_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return innerproduct.search(table(spark, sf_dir, "embeddings"))


def op8_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampling_plan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.fit(docs))


def op11_adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return codebooks.with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest(books) if books else "").alias("codebooks_sha256")
    )


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.withColumns({"rate": F.round("rate", 6), "bound": F.round("bound", 6)})


def op13_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_discriminant": op1_discriminant,
    "op2_best_fit": op2_best_fit,
    "op3_disclosure": op3_disclosure,
    "op4_multi_index": op4_multi_index,
    "op5_nearest_labelled": op5_nearest_labelled,
    "op6_minhash_lines": op6_minhash_lines,
    "op7_partial_sums": op7_partial_sums,
    "op8_raking": op8_raking,
    "op9_simhash": op9_simhash,
    "op10_secret_field": op10_secret_field,
    "op11_adaptive_bounds": op11_adaptive_bounds,
    "op12_host_reputation": op12_host_reputation,
    "op13_checkpointed_repair": op13_checkpointed_repair,
}
ORACLES: dict[str, str] = oracles.ORACLES
