"""Summaries of evaluated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = ("precision", "recall", "f1", "query_time", "response_length", "faithfulness", "answer_relevance", "context_relevance", "score")


def summarise(rows: DataFrame, digits: int | None = None, by: list[str] | tuple = ()) -> DataFrame:
    """One row, or one for each value of ``by``: mean, least and largest of every metric that the rows have; a missing value counts as 0."""
    cut = lambda c: F.round(c, digits) if digits is not None else c
    aggs = [cut(f(F.coalesce(F.col(m).cast("double"), F.lit(0.0)))).alias(f"{n}_{m}") for m in SPREAD if m in rows.columns for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(*aggs, F.count("*").alias("qa_pairs_evaluated"))


def context_diagnostics(rows: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col("truncated").cast("double")).alias("truncation_rate"), F.avg("context_utilization").alias("avg_context_utilization"), F.avg("chunks_used").alias("avg_chunks_used"), F.sum(F.greatest(F.lit(0), F.col("chunks_total") - F.col("chunks_used"))).alias("total_chunks_wasted"))
