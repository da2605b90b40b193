"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Scratch tables of earlier stages are deleted when a later one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from townwire.llm.common import release, scope, stored, table
from townwire.llm.line_dedup import rewrite_lines
from townwire.llm.packing import pack
from townwire.llm.registry import tokenizer_file
from townwire.llm.simhash import one_per_component
from townwire.llm.substring_dedup import remove_repeats
from townwire.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go."""
    with scope("toxicity"):
        return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest doc_id only."""
    release(spark, ["toxicity"], docs)
    with scope("line_dedup"):
        return rewrite_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays."""
    release(spark, ["toxicity", "line_dedup"], docs)
    with scope("near_dedup"):
        return one_per_component(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that start elsewhere too are removed."""
    release(spark, ["toxicity", "line_dedup", "near_dedup"], docs)
    with scope("substring_dedup"):
        return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    release(spark, ["toxicity", "line_dedup", "near_dedup", "substring_dedup"], docs)
    with scope("packing"):
        return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: Toxicity is learned and packing is a heuristic, so there is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with scope(name):
            docs = stored(out, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
