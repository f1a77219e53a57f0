"""From raw documents to packed token rows: one query of five stages, each written as Parquet and read by the next.

Every stage works on all that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, packing, partenum, tiling, toxicity
from strandline.sources.shared import ensure_checkpoint_dir, importable, passing


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model is learned from this stage's documents and their labels.

    Null and empty texts score as texts without hits. Where nothing is labelled, nothing is toxic.
    """
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the row with the smallest doc_id.

    Rows with one doc_id and different texts are documents of their own. Rows without id stay, as do texts without words.
    """
    return partenum.one_of_each(docs, percent=80, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Null and empty texts stay; a row goes by its own text."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source of its own, texts without words count too."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids with segment lengths and position resets; a null or empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near_duplicates", one_of_near_copies), ("decontamination", decontaminated), ("mixing", mixed), ("packing", packed)]
#: Scores, signatures and token ids are not SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder, until the driver ends."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = passing(spark, f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
