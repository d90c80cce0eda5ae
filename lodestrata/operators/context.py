"""Token-budgeted context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T


def budget(rows: DataFrame, most: int | Column = 4000, *, question: str = "q_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Chunks of each question that fit ``most`` tokens, a number or a column of the ``question``'s key (a token is a quarter of the characters), in rank order: kept whole while the running sum
    fits; the first that does not is cut to what remains if that is over 50 tokens. Adds tokens, kept ('full' or 'cut'), part."""
    order = Window.partitionBy(question).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tokens", T.estimated_tokens(F.col(text))).withColumn("upto", F.sum("tokens").over(order))
    left = F.lit(most) - (F.col("upto") - F.col("tokens"))
    first_over = F.col("upto") - F.col("tokens") <= most
    # a later chunk never follows the first overflow: the sum only grows, but a chunk of 0 tokens could stand at the edge
    over_before = F.coalesce(F.max((F.col("upto") > most).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.when(over_before == 1, None).when(F.col("upto") <= most, "full").when(first_over & (left > 50), "cut")
    over = (over_before == 0) & (F.col("upto") > most)
    rows = rows.withColumns({"kept": kept, "over": over})
    return rows.withColumn("part", F.when(F.col("kept") == "full", F.col(text)).when(F.col("kept") == "cut", F.concat(F.substr(F.col(text), F.lit(1), (left * 4).cast("int")), F.lit("..."))))


def assemble(rows: DataFrame, most: int | Column = 4000, *, question: str = "q_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """One row for each question: context, chunks, tokens_used, chunks_used, chunks_total, truncated, context_utilization."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct(F.col(rank).alias("r"), F.col("part").alias("p")))))
    return budget(rows, most, question=question, rank=rank, text=text).groupBy(question).agg(
        F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("p")))), lambda x: x["p"]).alias("chunks"),
        F.coalesce(F.sum(F.when(F.col("kept") == "full", F.col("tokens"))), F.lit(0)).alias("tokens_used"),
        F.count("kept").alias("chunks_used"),
        F.count("*").alias("chunks_total"),
        F.bool_or("over").alias("truncated"),
    ).withColumn("context_utilization", T.ratio(F.col("tokens_used"), F.lit(most)))


def prompt(context: Column, question: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), question)).otherwise(question)
