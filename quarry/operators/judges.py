"""Judges (X05, X06) as prompts to a provider and columns from its replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import dsl, metrics
from quarry.operators import evidence, providers


def ask(rows: DataFrame, template: str, make, into: str, replay: DataFrame | None = None, **values: str) -> DataFrame:
    """rows with the reply to the template filled with columns; one call per distinct prompt."""
    asked = rows.withColumn("_prompt", evidence.explain_prompt(template, **{k: F.col(c) for k, c in values.items()}))
    return providers.ask(asked, "_prompt", make, replay, into).drop("_prompt")


def rephrase(rows: DataFrame, template: str, make, info: str, into: str = "rephrased") -> DataFrame:
    return ask(rows, template, make, into, info=info)


def correctness(rows: DataFrame, template: str, make, truth: str, found: str) -> DataFrame:
    """rows with correctness: 1 for yes, 0 for another answer, null without one."""
    return ask(rows, template, make, "_judged", truth=truth, found=found).withColumn("correctness", metrics.correctness(F.col("_judged"))).drop("_judged", "_judged_error")


def plausibility(rows: DataFrame, template: str, make, found: str, keys: list[str]) -> DataFrame:
    """rows with plausibility: a struct of the judge's scores out of ten, as shares."""
    return ask(rows, template, make, "_judged", found=found).withColumn("plausibility", dsl.judge_scores(F.col("_judged"), keys)).drop("_judged", "_judged_error")
