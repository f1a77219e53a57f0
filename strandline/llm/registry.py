"""Queries of this package and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import language, mixing, nearest, packing, partenum, spans, tiling, toxicity, urlrules, warc
from strandline.sources.shared import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op2_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=4)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_systematic_mixing, op3_url_filter, op4_toxicity, op5_ngram_jaccard_join, op6_decontamination, op7_language_id, op8_packed_tokens, op9_warc_segments, op10_nearest_neighbours)}
SQL = {"op2_systematic_mixing": mixing.SQL, "op3_url_filter": urlrules.SQL, "op9_warc_segments": warc.SQL}
