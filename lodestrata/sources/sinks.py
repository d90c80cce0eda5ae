"""Sinks: JSON Lines, CSV, Markdown, Excel sheets, checkpointed progress, and a keyed table cache."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.readers import exists
from lodestrata.sources.tables import remove, rename_new


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def append_progress(df: DataFrame, path: str, batch: int) -> None:
    """One batch of results into a folder of its own number: a batch that is written again replaces itself. The whole is read from ``path``."""
    df.write.mode("overwrite").json(f"{path}/batch={batch}")


def put_text(spark: SparkSession, path: str, body: str) -> None:
    """A small text as one file, wherever Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(body.encode("utf-8")))
    finally:
        out.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def put_json(spark: SparkSession, path: str, value: object) -> None:
    put_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def stamp() -> str:
    return time.strftime("%Y%m%d_%H%M%S")


def write_dataset(qa: DataFrame, path: str, progress: str | None = None) -> dict:
    """Question pairs as JSON Lines in the folder ``path``, their summary beside it as ``<path>_summary.json``; ``progress``, the folder of the batches
    written on the way, is removed once both are there. Returns the summary."""
    from lodestrata.operators.prepare import dataset_summary

    write_jsonl(qa, path)
    summary = dataset_summary(qa).first().asDict(True)
    put_json(qa.sparkSession, f"{path.removesuffix('.jsonl')}_summary.json", summary)
    if progress:
        remove(qa.sparkSession, progress)
    return summary


def write_results(rows: DataFrame, summary: dict, folder: str, name: str, at: str | None = None) -> tuple[str, str]:
    """Details of an evaluation (a folder of JSON rows) and its summary (one file), with the time in their names; returns both paths."""
    at = at or stamp()
    details, one = f"{folder}/{name}_evaluation_results_{at}.json", f"{folder}/{name}_evaluation_summary_{at}.json"
    rows.write.mode("overwrite").json(details)
    put_json(rows.sparkSession, one, summary)
    return details, one


def read_results(spark: SparkSession, folder: str, name: str, at: str) -> DataFrame | None:
    """Details that ``write_results`` left, None where there are none."""
    path = f"{folder}/{name}_evaluation_results_{at}.json"
    return spark.read.json(path) if exists(spark, path) else None


def write_comparison(df: DataFrame, folder: str, at: str | None = None) -> str:
    """A comparison (seq, name, status, metrics) as JSON, CSV and a text report, which is returned."""
    from lodestrata.plans.analysis import report

    at = at or stamp()
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/comparison_results_{at}.json")
    write_csv(df, f"{folder}/comparison_data_{at}.csv")
    metrics = tuple(m for m in ("avg_f1", "avg_query_time", "avg_faithfulness") if m in df.columns)
    text = report(df, metrics)
    put_text(df.sparkSession, f"{folder}/comparison_report_{at}.txt", text)
    return text


def write_corpus(docs: DataFrame, path: str) -> None:
    """The grouped corpus for reading by eye: one row of JSON for each document, in order, with its metadata nested."""
    meta = [c for c in docs.columns if c not in ("id", "text")]
    docs.orderBy("doc_seq").select("id", "text", F.struct(*meta).alias("metadata")).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; raises beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def sheet_name(name: str) -> str:
    for bad in "[]:*?/\\":
        name = name.replace(bad, "_")
    return name[:31]


def sheet_names(names: Iterable[str]) -> list[str]:
    """A sheet name for each, of at most 31 characters, without the signs that sheets forbid; names that would be equal are numbered."""
    out: list[str] = []
    for name in map(sheet_name, names):
        number, own = 1, name
        while own.lower() in {x.lower() for x in out}:
            number += 1
            own = f"{name[: 30 - len(str(number))]}~{number}"
        out.append(own)
    return out


def write_excel(tables: dict[str, DataFrame], path: str, most: int = 100_000) -> None:
    """One sheet for each table; needs a writer that pandas knows. A table of more than ``most`` rows raises."""
    import pandas as pd

    frames = []
    for df in tables.values():
        frames.append(df.limit(most + 1).toPandas())  # bounded
        if len(frames[-1]) > most:
            raise ValueError(f"more than {most} rows")
    with pd.ExcelWriter(path) as book:
        for name, frame in zip(sheet_names(tables), frames, strict=True):
            frame.to_excel(book, sheet_name=name, index=False)


def preview(df: DataFrame, n: int = 3) -> list[dict]:
    return [r.asDict(True) for r in df.limit(n).collect()]


def config_hash(config: dict) -> str:
    """First eight hex digits of the digest of the sorted settings; null is written as "null"."""
    plain = {k: "null" if v is None else str(v) for k, v in config.items()}
    return hashlib.md5(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:8]


class TableCache:
    """Parquet tables under a folder, keyed by the whole configuration and a fingerprint of the input."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str, config: dict):
        path = f"{self.folder}/{name}_{config_hash(config)}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, name: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The cached table, or ``make()`` written first: beside it, then renamed, so of several writers one wins whole and the others read its table. An empty table is
        a hit as well."""
        path, _, _ = self._path(name, config)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            own = f"{self.folder}/_{uuid.uuid4().hex}"
            make().write.parquet(own)
            if not rename_new(self.spark, own, path):
                remove(self.spark, own)
        return self.spark.read.parquet(path)

    def _entries(self) -> list:
        _, hadoop, fs = self._path("x", {})
        parent = hadoop.getParent()
        return list(fs.listStatus(parent)) if fs.exists(parent) else []

    def listing(self) -> list[tuple[str, int]]:
        """(name, bytes) of everything in the folder."""
        return [(name, size) for name, size, _ in self.info()]

    def info(self) -> list[tuple[str, int, str]]:
        """(name, bytes, file or directory) of everything in the folder."""
        _, _, fs = self._path("x", {})
        return sorted((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), "directory" if s.isDirectory() else "file") for s in self._entries())

    def clear(self) -> None:
        """Removes the tables that this cache has written; what else lies in the folder stays."""
        _, _, fs = self._path("x", {})
        for s in self._entries():
            if s.isDirectory() and re.search(r"_[0-9a-f]{8}$", s.getPath().getName()):
                fs.delete(s.getPath(), True)


def fingerprint(df: DataFrame) -> str:
    """Order-free digest of a table, for cache keys: the number of rows and the sums of two independent hashes of them, so equal rows add up and do not cancel."""
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    digest = F.sha2(F.concat_ws("\n", F.lit(str(df.dtypes)), whole).cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b")).first()
    return f"{row['n']}-{row['a'] or 0}-{row['b'] or 0}"
