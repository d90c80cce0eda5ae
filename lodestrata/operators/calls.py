"""Calls to models: each input fails alone, and a record of outcomes answers every input once.

``outcomes`` is what runs in a task: inputs go to the model in groups of ``size``, several groups at once; a group that fails is halved until the
input that fails stands alone, and that one is tried again with growing pauses. An outcome is a value or an error, never both.

``Record`` keeps outcomes as Parquet files under a folder, keyed by a digest of the model's settings and the input. Before a run the inputs that have a value
are taken out by an anti-join; equal inputs are one. The rest goes to small partitions, and the files of a partition appear when it is done (not when the job
is), so a run that is killed loses at most the ``per_task`` inputs of each partition in hand, and the next run asks for no input that is on record. Errors are
kept as well, and asked again by the next run.

A null input is not asked: value and error are null. Inputs and values of any length are whole. Rows that share an input share its outcome.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import make_folder, materialise

#: Takes inputs and gives as many values; it may raise.
Model = Callable[[list], Sequence]


@dataclass(frozen=True)
class Calls:
    """How a model is called. ``tries`` of one input, with ``backoff`` seconds before the second, twice as many before the third; ``in_flight`` calls at once in a
    task; at most ``tasks`` tasks at once (None: as the cluster has room), so ``tasks x in_flight`` bounds the calls in flight; ``per_task`` inputs of
    a partition; ``pause`` seconds after every ``pause_every`` calls of a task."""

    tries: int = 3
    backoff: float = 0.5
    in_flight: int = 4
    tasks: int | None = None
    per_task: int = 64
    pause_every: int = 0
    pause: float = 0.0

    def __post_init__(self):
        if min(self.tries, self.in_flight, self.per_task) < 1 or (self.tasks is not None and self.tasks < 1):
            raise ValueError("tries, in_flight, tasks and per_task must be at least 1")


@dataclass(frozen=True)
class Outcome:
    value: object
    error: str | None
    tries: int
    seconds: float


def attempt(model: Model, group: list, calls: Calls) -> list[Outcome]:
    """The outcomes of one group, in its order."""
    most = calls.tries if len(group) == 1 else 1
    began, error = time.monotonic(), ""
    for n in range(1, most + 1):
        try:
            values = list(model(group))
            if len(values) != len(group):
                raise ValueError(f"{len(values)} values for {len(group)} inputs")
            took = (time.monotonic() - began) / len(group)
            return [Outcome(v, None, n, took) for v in values]
        except Exception as e:  # noqa: BLE001 - a provider may raise anything
            error = str(e) or type(e).__name__
            if n < most:
                time.sleep(calls.backoff * 2 ** (n - 1))
    if len(group) == 1:
        return [Outcome(None, error, most, time.monotonic() - began)]
    half = len(group) // 2
    return attempt(model, group[:half], calls) + attempt(model, group[half:], calls)


def outcomes(model: Model, inputs: list, size: int = 1, calls: Calls | None = None) -> list[Outcome]:
    """The outcomes of all inputs, in their order; null inputs are not asked."""
    calls = calls or Calls()
    some = [x for x in inputs if x is not None]
    groups = [some[k : k + size] for k in range(0, len(some), size)]
    stretch = calls.pause_every or max(1, len(groups))
    found: list[Outcome] = []
    with ThreadPoolExecutor(calls.in_flight) as pool:
        for at in range(0, len(groups), stretch):
            if at:
                time.sleep(calls.pause)
            for own in pool.map(lambda g: attempt(model, g, calls), groups[at : at + stretch]):
                found += own
    own = iter(found)
    return [Outcome(None, None, 0, 0.0) if x is None else next(own) for x in inputs]


def called(inputs: Column, make: Callable[[], Model], kind: str, size: int = 1, calls: Calls | None = None) -> Column:
    """struct(value, error, tries, seconds) of a column, without a record. ``make`` gives the model, once in each task."""

    @F.pandas_udf(f"value {kind}, error string, tries int, seconds double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield table([None if x is None or x is pd.NA else x for x in batch.tolist()], model, size, calls)

    return run(inputs)


def table(inputs: list, model: Model, size: int, calls: Calls | None) -> pd.DataFrame:
    found = outcomes(model, inputs, size, calls)
    return pd.DataFrame({
        "value": pd.Series([o.value for o in found], dtype=object), "error": pd.Series([o.error for o in found], dtype=object),
        "tries": pd.Series([o.tries for o in found], dtype="int32"), "seconds": pd.Series([o.seconds for o in found], dtype="float64"),
    })


class Record:
    """Outcomes under ``folder``; ``kind`` is the type of a value, such as ``string`` or ``array<double>``."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string"):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        self.schema = f"key string, value {kind}, error string, tries int, seconds double, at double"
        make_folder(spark, self.folder)

    def outcomes(self) -> DataFrame:
        """Everything on record: a row for each time that an input was asked."""
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def latest(self) -> DataFrame:
        """One row for each key: a value where there is one, else the last error. ``tries`` counts all calls."""
        best = F.max_by(F.struct("value", "error", "seconds"), F.struct(F.col("error").isNull(), "at"))
        rows = self.outcomes().groupBy("key").agg(best.alias("b"), F.sum("tries").cast("int").alias("tries"))
        return rows.select("key", "b.value", "b.error", "tries", "b.seconds")

    @staticmethod
    def key(c: Column, settings: dict) -> Column:
        return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True, default=str) + "\n"), c).cast("binary"), 256)

    def missing(self, rows: DataFrame, column: str, settings: dict) -> DataFrame:
        """(key, input): the distinct inputs of ``rows`` without a value on record."""
        asked = rows.where(F.col(column).isNotNull()).select(self.key(F.col(column), settings).alias("key"), F.col(column).alias("input"))
        known = self.outcomes().where("error is null").select("key")
        # one row for each key: partial results come before the shuffle, so an input that many rows share meets in no task
        return asked.groupBy("key").agg(F.first("input").alias("input")).join(known, "key", "left_anti")

    def ask(self, rows: DataFrame, column: str, make: Callable[[], Model], settings: dict, *, size: int = 1, calls: Calls | None = None) -> int:
        """Asks for what is missing and writes it; returns how many inputs were asked."""
        calls = calls or Calls()
        todo = materialise(self.spark, self.missing(rows, column, settings), "inputs")
        n = todo.count()
        parts = -(-n // calls.per_task)
        waves = 1 if calls.tasks is None else -(-parts // calls.tasks)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                yield pd.concat([batch[["key"]].reset_index(drop=True), table(batch["input"].tolist(), model, size, calls)], axis=1).assign(at=time.time())

        for wave in range(waves if n else 0):
            own = todo if waves == 1 else todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
            own = own.repartition(min(parts, calls.tasks or parts), "key")
            # algorithm 2: a task's files appear when the task ends, and stay if the job does not
            own.mapInPandas(run, self.schema).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.folder)
        return n

    def answer(self, rows: DataFrame, column: str, make: Callable[[], Model], settings: dict, *, name: str = "reply", size: int = 1, calls: Calls | None = None) -> DataFrame:
        """``rows`` with ``name``, a struct (value, error, tries, seconds), after asking for what is missing."""
        self.ask(rows, column, make, settings, size=size, calls=calls)
        keyed = rows.withColumn("_key", self.key(F.col(column), settings))
        found = self.latest().join(keyed.select(F.col("_key").alias("key")).distinct(), "key", "left_semi")
        # written, so the join below stands on two plain shuffles, of which an input that many rows share can be split
        found = materialise(self.spark, found.select(F.col("key").alias("_key"), F.struct("value", "error", "tries", "seconds").alias(name)), "outcomes")
        return keyed.join(found, "_key", "left").drop("_key")
