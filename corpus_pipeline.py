"""A corpus pipeline of five of the operators: each stage works on what the one before it kept."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._staging import staged
from brindle.llm.decontaminate import find_leaks
from brindle.llm.line_dedup import dedup_lines
from brindle.llm.near_dedup import near_duplicates
from brindle.llm.quality import judge_quality
from brindle.llm.queries import MIX
from brindle.llm.source_mix import mix_sources


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: What the stages work on; other columns are carried along.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage for which columns other than OWN go by names of no one's, so that they clash with none of the operators'."""

    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = {c: f"_carried{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        return stage(spark, docs.withColumnsRenamed(others), sf_dir).withColumnsRenamed({v: k for k, v in others.items()})

    return run_


@_carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity threshold and without a window beyond it; those at the threshold stay.
    Null and empty texts and null languages stay as judge_quality says; repeated rows are judged each; columns stay as they are."""
    return judge_quality(docs, _read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


@_carrying
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses every word with them goes, and n_chars follows the text. Null and
    empty texts and rows with a null id stay; rows that repeat an id lose the same lines."""
    out = dedup_lines(docs).where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies. Null and empty texts and rows with a null id are no one's copies and
    stay; rows that repeat an id stay or go together."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_carrying
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null texts and ids leak nothing; rows that repeat an id go if any of them leaks."""
    gone = find_leaks(docs, _read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Null texts have size 0; a null source is one of its own, the last."""
    return mix_sources(docs, **MIX).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: The perplexity and MinHash stages can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
