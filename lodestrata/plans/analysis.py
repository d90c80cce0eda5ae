"""Analysis of run summaries: results table, groupings, pivots, rankings, report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

METRICS = ("avg_f1", "avg_dsgvo_score", "avg_precision", "avg_recall")
#: The eleven groupings of the results tables.
GROUPINGS = (
    ("llm_model",), ("chunking_type",), ("chunk_size",), ("top_k",), ("similarity_threshold",), ("chunking_type", "chunk_size"),
    ("chunking_type", "top_k"), ("top_k", "similarity_threshold"), ("llm_model", "chunking_type"), ("llm_model", "chunk_size"), ("llm_model", "top_k", "similarity_threshold"),
)
SHORT_NAMES = {"retrieval_top_k": "top_k", "retrieval_similarity_threshold": "similarity_threshold", "chunking_name": "chunking_type"}


def results_table(summaries: DataFrame) -> DataFrame:
    """Flat rows of run summaries, best score first (nulls last), then F1."""
    i = "pipeline_info."
    flat = summaries.select(
        "experiment_file", T.truthy_or(F.col(i + "llm.model"), F.col(i + "llm.name")).alias("llm_model"), F.col(i + "llm.temperature").alias("llm_temperature"), F.col(i + "llm.max_tokens").alias("llm_max_tokens"),
        T.truthy_or(F.col(i + "embedding.model"), F.col(i + "embedding.name")).alias("embedding_model"), T.chunking_type(F.col(i + "chunking.name")).alias("chunking_type"),
        T.truthy_or(F.nullif(F.col(i + "chunking.chunk_size"), F.lit("0")), F.col(i + "chunking.strategy")).alias("chunk_size"), F.col(i + "chunking.chunk_overlap").alias("chunk_overlap"),
        F.col(i + "retrieval.top_k").alias("top_k"), F.col(i + "retrieval.similarity_threshold").alias("similarity_threshold"), F.col(i + "dataset.grouping_applied").alias("grouping"), F.col(i + "pipeline.max_context_length").alias("max_context_length"),
        *(f"avg_{m}" for m in ("precision", "recall", "f1", "faithfulness", "answer_relevance", "context_relevance", "dsgvo_score", "query_time", "response_length")),
        F.col(i + "retrieval.chunks_indexed").alias("chunks_indexed"), *(f"context_optimization.{m}" for m in ("truncation_rate", "avg_context_utilization", "avg_chunks_used", "total_chunks_wasted")),
        "qa_pairs_evaluated", "total_evaluation_time", "random_seed",
    )
    return flat.orderBy(*best_first("avg_dsgvo_score", "avg_f1"))


def best_first(*metrics: str) -> list[Column]:
    """The order of a results table: the largest first, null last, by one metric after the other."""
    return [F.desc_nulls_last(m) for m in metrics]


def positions(df: DataFrame, metrics: Iterable[str], ties: Iterable[str] = ()) -> DataFrame:
    """A results table (bounded: a row for each run or group) with ``pos``, its place in that order."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*best_first(*metrics), *ties)))


def status_counts(df: DataFrame, status: str = "status", failed: str = "FAILED", without: Iterable[str] = ()) -> DataFrame:
    """(status, n, failed) of runs; those whose status is in ``without``, or null, are left out."""
    own = df.where(F.col(status).isNotNull() & ~F.col(status).isin(*without)) if without else df
    return own.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col(status) == failed).alias("failed"))


def series(df: DataFrame, x: str, metrics: Iterable[str], digits: int = 6) -> DataFrame:
    """Means of several metrics by one column, for a plot of their lines."""
    return df.groupBy(x).agg(*(F.round(F.avg(m), digits).alias(m) for m in present(df, metrics)))


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def statistics(metrics: Iterable[str], digits: int = 3) -> list[Column]:
    """Mean, sample deviation (0 for a single row) and count of the non-null values."""
    return [a for m in metrics for a in (F.bround(F.avg(m), digits).alias(f"{m}__mean"), F.bround(F.coalesce(F.stddev_samp(m), F.lit(0.0)), digits).alias(f"{m}__std"), F.count(m).cast("int").alias(f"{m}__count"))]


def grouped(df: DataFrame, by: Iterable[str], metrics: Iterable[str] = METRICS) -> DataFrame | None:
    """Statistics by the columns that exist; null is a group. None if no column or no metric exists."""
    keys, own = present(df, by), present(df, metrics)
    return df.groupBy(*keys).agg(*statistics(own)).orderBy(*keys) if keys and own else None


def all_groupings(df: DataFrame, groupings: Iterable[tuple[str, ...]], metrics: Iterable[str], digits: int = 3) -> DataFrame:
    """Every grouping in one pass; grouping_id tells them apart, with one bit for each key left out. A grouping keeps the columns that exist; one that
    is left without any is skipped, and so is one that equals an earlier one. Without a grouping or a metric there are no rows."""
    sets = list(dict.fromkeys(tuple(s) for g in groupings if (s := present(df, g))))
    keys = sorted({c for s in sets for c in s})
    if not sets or not present(df, metrics):
        return df.limit(0).select(*(F.col(k) for k in keys), F.lit(0).cast("long").alias("grouping_id"), *(F.col(m) for m in present(df, metrics)))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("grouping_id"), *statistics(present(df, metrics), digits))


def heatmap(df: DataFrame, rows: str, columns: str, metric: str, values: list | None = None) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(metric)).orderBy(rows)


def combination(df: DataFrame) -> Column:
    """Short label of a run: chunking, size, k, threshold, model, for the columns that exist."""
    own = {"chunking_type": lambda c: T.short_chunking(c), "chunk_size": lambda c: c.cast("string"), "top_k": lambda c: F.concat(F.lit("k"), c.cast("string")), "similarity_threshold": T.short_threshold, "llm_model": T.short_model}
    return F.concat_ws("-", *(f(F.col(c)) for c, f in own.items() if c in df.columns))


def top_combinations(df: DataFrame, label: Column, metric: str, n: int = 30) -> DataFrame:
    return df.groupBy(label.alias("combo")).agg(F.avg(metric).alias("mean")).orderBy(F.desc("mean"), "combo").limit(n)


def n_best(df: DataFrame, metric: str, n: int = 3, smallest: bool = False, seq: str = "seq") -> DataFrame:
    """The n rows with the largest (or smallest) value, the first of equals first."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.asc(metric) if smallest else F.desc(metric), seq).limit(n)


def best_by(df: DataFrame, metrics: Iterable[str], name: str = "name", seq: str = "seq") -> DataFrame:
    """For each metric the best row's name, the first of equals; for times, the least. Rows without a value, or with NaN, do not compete."""
    known = lambda m, place: F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")), F.struct(F.col(m), place))
    pick = [(F.min_by(name, known(m, F.col(seq))) if "time" in m else F.max_by(name, known(m, -F.col(seq)))).alias(m) for m in metrics]
    return df.agg(*pick)


def numeric_order(df: DataFrame, column: str) -> DataFrame:
    """Sorted by the column as a number, what is none last."""
    return df.orderBy(T.number_or_inf(F.col(column)), column)


def nan_max(column: str) -> Column:
    return F.max(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))


def report(df: DataFrame, metrics: tuple[str, ...] = ("avg_f1", "avg_query_time", "avg_faithfulness")) -> str:
    """Text report of a comparison: counts, the best three by each metric, failures. df: seq, name, status, metrics."""
    good = df.where("status = 'SUCCESS'")
    n = next((r["n"] for r in status_counts(df).collect() if r["status"] == "SUCCESS"), 0)
    bad = [r["name"] for r in df.where("status <> 'SUCCESS'").orderBy("seq").select("name").collect()]
    lines = [f"Successful: {n}", f"Failed: {len(bad)}"]
    for m in metrics if n > 1 else ():
        lines.append(f"By {m}:")
        lines += [f"  {r['name']}: {r[m]:.4f}" for r in n_best(good, m, smallest="time" in m).collect()]
    return "\n".join([*lines, *(f"FAILED {x}" for x in bad)])
