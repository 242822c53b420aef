"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``:

1. language: documents whose language cannot be told go;
2. near_dedup: of each class of near-duplicates one document stays;
3. decontaminate: documents that hold a benchmark window go;
4. pii: personal data and secrets in the texts are replaced by their kind;
5. pack: the texts are tokenised and packed into sequences, token ids included.

A stage deletes the work tables that it wrote and its result does not read, and no others; ``run`` writes each result, and
deletes then what that result read and the result before it. So runs in one process do not touch each other's tables. Nulls,
empty and repeated rows mean in a stage what its operator says; empty tables give an empty result. The operators are
imported when a stage runs, so that this module can be imported without them.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from wakeline.sources import work

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(module: str) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with work.tables_written() as tables:
            out = import_module(f"wakeline.llm.{module}").stage(spark, docs, sf_dir)
        work.remove(spark, work.unread(tables, out))
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", _stage("language_id")),
    ("near_dedup", _stage("near_dedup")),
    ("decontaminate", _stage("decontaminate")),
    ("pii", _stage("pii")),
    ("pack", _stage("packing")),
]

#: SQL cannot express the trained stages; the tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with work.tables_written() as tables:
            docs = work.cut(stage(spark, docs, sf_dir), name)
        done = work.unread(tables, docs)
        work.remove(spark, [*done, *before])
        before = [t for t in tables if t not in done]
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
