"""Answer metrics as column expressions, and the families an evaluation can enable."""

from __future__ import annotations

import difflib
import warnings
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestrata.functions import text as T


def word_precision(expected: Column, actual: Column) -> Column:
    a = T.word_set(actual)
    return T.ratio(T.overlap(T.word_set(expected), a), F.size(a))


def word_recall(expected: Column, actual: Column) -> Column:
    e = T.word_set(expected)
    return T.ratio(T.overlap(e, T.word_set(actual)), F.size(e))


def stem_similarity(expected: Column, actual: Column) -> Column:
    return T.jaccard(T.word_set(T.stem(expected)), T.word_set(T.stem(actual)))


@F.pandas_udf(DoubleType())
def sequence_similarity(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Matching-block ratio of the lower-cased texts; no built-in function has it."""
    return pd.Series([difflib.SequenceMatcher(None, (e or "").lower(), (a or "").lower()).ratio() for e, a in zip(expected, actual, strict=True)], dtype="float64")


def harmonic(p: Column, r: Column) -> Column:
    return T.ratio(2 * p * r, p + r)


def combined(df: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Adds word, sequence and stem measures and their weighted precision, recall and F1. An empty text on either side gives 0, with null parts."""
    e, a = F.col(expected), F.col(actual)
    blank = (F.coalesce(e, F.lit("")) == "") | (F.coalesce(a, F.lit("")) == "")
    part = {"word_precision": word_precision(e, a), "word_recall": word_recall(e, a), "sequence_similarity": sequence_similarity(e, a), "semantic_similarity": stem_similarity(e, a)}
    df = df.withColumns({k: F.when(~blank, v) for k, v in part.items()})
    mix = lambda c: F.coalesce(0.4 * F.col(c) + 0.3 * F.col("sequence_similarity") + 0.3 * F.col("semantic_similarity"), F.lit(0.0))
    df = df.withColumns({"precision": mix("word_precision"), "recall": mix("word_recall")})
    return df.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def timing(answer: Column, seconds: Column) -> dict[str, Column]:
    tokens, parts = T.estimated_tokens(answer), T.ws_tokens(answer)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, w: s + F.length(w))
    return {"response_length": F.length(answer).cast("long"), "estimated_tokens": tokens, "word_count": F.size(parts).cast("long"), "avg_word_length": T.ratio(total, F.size(parts)), "tokens_per_second": F.when(seconds > 0, tokens / seconds).otherwise(0.0)}


def faithfulness(answer: Column, context: Column) -> Column:
    a = T.word_set(answer)
    share = T.ratio(T.overlap(a, T.word_set(context)), F.size(a))
    return F.least(F.lit(1.0), F.when(F.length(answer) < 200, share * 1.2).otherwise(share))


def answer_relevance(question: Column, answer: Column) -> Column:
    share = T.jaccard(T.word_set(question), T.word_set(answer))
    return F.least(F.lit(1.0), F.when(F.length(answer) > 100, share * 1.1).otherwise(share))


def chunk_relevance(question: Column, chunk: Column) -> Column:
    """One chunk's part in context relevance, which is the mean over a question's chunks."""
    q = T.word_set(question)
    return T.ratio(T.overlap(q, T.word_set(chunk)), F.size(q))


def ragas_context_utilization(answer: Column, context: Column) -> Column:
    c = T.word_set(context)
    share = T.ratio(T.overlap(T.word_set(answer), c), F.size(c))
    return F.least(F.lit(1.0), F.when(F.length(answer) < 0.1 * F.length(context), share * 0.8).otherwise(share))


def weighted_score(faith: Column, answer: Column, context: Column) -> Column:
    return 0.5 * faith + 0.3 * answer + 0.2 * context


def grounding(df: DataFrame) -> DataFrame:
    """Adds the grounding family to rows of question, actual, context, and chunks (array of texts); 0 without chunks."""
    some = F.size("chunks") > 0
    mean = T.ratio(F.aggregate(F.transform("chunks", lambda c: chunk_relevance(F.col("question"), c)), F.lit(0.0), lambda s, x: s + x), F.size("chunks"))
    own = {"faithfulness": faithfulness(F.col("actual"), F.col("context")), "answer_relevance": answer_relevance(F.col("question"), F.col("actual")), "context_relevance": mean, "ragas_context_utilization": ragas_context_utilization(F.col("actual"), F.col("context"))}
    df = df.withColumns({k: F.when(some, v).otherwise(0.0) for k, v in own.items()})
    return df.withColumn("score", weighted_score(F.col("faithfulness"), F.col("answer_relevance"), F.col("context_relevance")))


#: What each family adds; an evaluation applies the enabled ones in this order.
FAMILIES = {"overlap": combined, "timing": lambda df: df.withColumns(timing(F.col("actual"), F.col("seconds"))), "grounding": grounding}


#: Name, purpose and columns of each family; names and columns are fixed values.
INFO = {
    "overlap": {"name": "precision-recall", "description": "Precision, recall and F1 from words, sequences and stems", "metrics": ["precision", "recall", "f1", "word_precision", "word_recall", "sequence_similarity", "semantic_similarity"]},
    "timing": {"name": "performance", "description": "Length and speed of answers", "metrics": ["response_length", "estimated_tokens", "word_count", "avg_word_length", "tokens_per_second"]},
    "grounding": {"name": "ragas", "description": "How answers rest on their context", "metrics": ["faithfulness", "answer_relevance", "context_relevance", "ragas_context_utilization", "score"]},
}


class Family(Protocol):
    """Takes answered rows (question, expected, actual, context, chunks, seconds) and adds its columns."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def register(family: str, own: Family, description: str, metrics: list[str]) -> None:
    """Make a family of metrics known under a name of its own, which settings can then enable."""
    if family in FAMILIES:
        raise ValueError(f"there is a metric family {family}")
    FAMILIES[family] = own
    INFO[family] = {"name": family, "description": description, "metrics": metrics}


def evaluation_info(enabled: list[str]) -> dict:
    own = [n for n in FAMILIES if n in enabled]
    return {"enabled_evaluators": [INFO[n]["name"] for n in own], "total_metrics": sum(len(INFO[n]["metrics"]) for n in own), "metrics": {INFO[n]["name"]: INFO[n] for n in own}}


def evaluate(df: DataFrame, enabled: list[str]) -> DataFrame:
    """Applies the enabled families. Rows with an error keep null metrics: a failed call is no answer. A family that cannot be applied, as a
    column it needs is missing, is left out with a warning, and the others still are."""
    unknown = set(enabled) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown metric families: {sorted(unknown)}")
    for name in FAMILIES:
        if name in enabled:
            before = set(df.columns)
            try:
                df = FAMILIES[name](df)
            except AnalysisException as error:
                warnings.warn(f"metrics of the family {name} are left out: {error}", stacklevel=2)
                continue
            if "error" in df.columns:
                df = df.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in df.columns if c not in before})
    return df
