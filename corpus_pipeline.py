"""Documents to token files: quality rules, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. What a stage has staged in the shared folder
is removed when the next one begins, so write a stage's result before you call another.
"""
from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathscreen.llm import chosen_path, curriculum, host_rules, token_files, wu_manber
from pathscreen.llm.common import table
from pathscreen.llm.queries import END_ID, vocabulary
from pathscreen.session import checkpoint_dir
from pathscreen.staging import Scope, staging

_written: list[Scope] = []


def _stage(step):
    """The step with its staged tables in a scope of their own, after those of the stage before are gone."""
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _written:
            _written.pop().remove()
        with staging(spark) as scope:
            out = step(spark, docs, sf_dir)
        _written.append(scope)
        return out
    return run_step


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return host_rules.host_quality(docs).where("_kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 similarity of five-word shingles."""
    return chosen_path.keep_one(docs, width=5, percent=80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = wu_manber.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(F.col(wu_manber.RESULT)["spans"]) == 0).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in order of training time."""
    return curriculum.in_training_order(docs).select(*docs.columns)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32 per document copy."""
    return token_files.read_tokens(spark, *token_files.write_tokens(docs, vocabulary(), END_ID))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing), ("token output", token_output)]
#: Near-duplicate links over words and ids of a tokenizer can't be stated in SQL; ``tests/llm/test_pipeline.py`` holds every stage and ``run`` to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
