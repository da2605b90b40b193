"""Evaluation against labelled cases: confusion counts per stratum, rates, failures and the regression gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATA = ("split", "signal", "bucket")


def effective_prior(case_prior: Column, author: Column) -> Column:
    """A case's own soft-prior flag counts only where the case names an author."""
    return F.coalesce(case_prior, F.lit(False)) & author.isNotNull()


def confusion(cases: DataFrame, strata: Iterable[str] = STRATA, expected: str = "expected", got: str = "matched") -> DataFrame:
    """tp, fp, tn, fn overall and by each stratum alone: (stratum, value, counts, rates), in one pass of grouping sets."""
    strata = list(strata)
    e, g = F.col(expected), F.col(got)
    counted = cases.groupingSets([[], *([F.col(x)] for x in strata)], *strata).agg(
        *(F.grouping(x).alias(f"_townwire_{x}") for x in strata),
        F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(~e & ~g).alias("tn"), F.count_if(e & ~g).alias("fn"),
    )
    chosen = lambda value, other: F.coalesce(*(F.when(F.col(f"_townwire_{x}") == 0, value(x)) for x in strata), F.lit(other))
    return rates(counted.select(chosen(F.lit, "overall").alias("stratum"), chosen(lambda x: F.col(x).cast("string"), "").alias("value"), "tp", "fp", "tn", "fn"))


def rates(counted: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy from counts: 0.0 on an empty denominator, with a flag that says so."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return counted.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision_defined": tp + fp > 0, "recall_defined": tp + fn > 0,
    })


def failures(cases: DataFrame, expected: str = "expected", got: str = "matched") -> DataFrame:
    """Cases decided wrongly, with their kind."""
    wrong = cases.filter(F.col(expected) != F.col(got))
    return wrong.withColumn("kind", F.when(F.col(got), "FP").otherwise("FN"))


def gate(cases: DataFrame, expected: str = "expected", got: str = "matched") -> DataFrame:
    """One row: regression cases, how many fail, and whether the gate passes."""
    own = F.coalesce(F.col("regression"), F.lit(False))
    wrong = own & (F.col(expected) != F.col(got))
    return cases.agg(F.count_if(own).alias("regressions"), F.count_if(wrong).alias("failed")).withColumn("passes", F.col("failed") == 0)


def coverage(cases: DataFrame, needed: dict[str, Iterable[str]]) -> DataFrame:
    """(stratum, value, n) of strata values that must occur; n is 0 where one is missing."""
    spark = cases.sparkSession
    rows = [(s, v) for s, vs in needed.items() for v in vs]
    wanted = spark.createDataFrame(rows, "stratum string, value string")
    have = None
    for s in needed:
        part = cases.groupBy(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")).agg(F.count("*").alias("n"))
        have = part if have is None else have.unionByName(part)
    return wanted.join(have, ["stratum", "value"], "left").select("stratum", "value", F.coalesce("n", F.lit(0)).alias("n"))
