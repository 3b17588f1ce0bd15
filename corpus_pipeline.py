"""Documents to tokens: language, quality, near-duplicates, mixture, BPE. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm._common import shared_folder
from tidewell.llm.bpe import bpe_stage
from tidewell.llm.langid import language_stage
from tidewell.llm.mixing import mixing_stage
from tidewell.llm.quality import quality_stage
from tidewell.llm.simhash import dedup_stage

STAGES = [
    ("language ID", language_stage),
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: The trained stages are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are kept in the session's shared folder, a new one for each run."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
