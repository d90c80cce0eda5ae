"""A crawl that can be stopped and goes on: every URL with its state, tries and next time; hosts asked one request at a time.

The state is a log of Parquet files under a folder: URLs that became known, and attempts with their page or error. What is due follows from it: known URLs without a page, with tries left, whose
waiting time after the last failure (``backoff`` seconds, twice as long after each) is over. A round deals what is due by host, so a host is asked by one task, at most every ``pause`` seconds; a
task with several hosts turns to the one whose time comes first. At most ``per_host`` URLs of a host belong to a round, and the files of a task appear when it ends, so a crawl that is killed loses no more than that
of each host in hand. Rounds go on until nothing is left to wait for; a URL without tries left stays as a row with its last error.

Links that ``follow`` finds in a page become known with it: every round reads the pages of the round before. Null and empty URLs are no URLs; a URL that is given often is one. A page may be empty. The host of a URL without one is the empty text.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources.tables import make_folder, materialise

KNOWN = "url string, depth int, parent string"
TRIED = "url string, host string, html string, error string, round int, at double"
Get = Callable[[str], str]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def ask_hosts(rows: list[tuple[str, str]], get: Get, pause: float) -> Iterator[tuple[str, str, str | None, str | None, float]]:
    """(url, host, html, error, at) of (url, host) pairs, one request after another: always of the host that may be asked first."""
    waiting: dict[str, deque] = {}
    for url, host in rows:
        waiting.setdefault(host, deque()).append(url)
    turns = [(0.0, host) for host in sorted(waiting)]
    heapq.heapify(turns)
    while turns:
        due, host = heapq.heappop(turns)
        if (left := due - time.time()) > 0:
            time.sleep(left)
        url, html, error = waiting[host].popleft(), None, None
        try:
            html = get(url)
            if html is None:
                error = "no page"
        except Exception as e:  # noqa: BLE001 - a client may raise anything
            error = str(e) or type(e).__name__
        now = time.time()
        yield url, host, html, error, now
        if waiting[host]:
            heapq.heappush(turns, (now + pause, host))


class Frontier:
    def __init__(self, spark: SparkSession, folder: str, get: Get, *, follow: Callable[[str], list[str]] | None = None, tries: int = 3, pause: float = 1.0, backoff: float = 1.0, per_host: int = 100, tasks: int | None = None, depth: int = 1):
        if min(tries, per_host) < 1:
            raise ValueError("tries and per_host must be at least 1")
        self.spark, self.folder, self.get, self.follow = spark, folder.rstrip("/"), get, follow
        self.tries, self.pause, self.backoff, self.per_host, self.tasks, self.depth = tries, pause, backoff, per_host, tasks, depth
        for part in ("known", "tried"):
            make_folder(spark, f"{self.folder}/{part}")

    def _append(self, rows: DataFrame, part: str) -> None:
        # algorithm 2: a task's files appear when the task ends, and stay if the job does not
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/{part}")

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(TRIED).parquet(f"{self.folder}/tried")

    def known(self) -> DataFrame:
        """(url, depth, parent): of a URL that was found often, the way of the least depth."""
        rows = self.spark.read.schema(KNOWN).parquet(f"{self.folder}/known")
        return rows.groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("w")).select("url", "w.depth", "w.parent")

    def add(self, urls: DataFrame) -> None:
        """URLs (url) to begin with; those that are known change nothing."""
        rows = urls.where("url is not null and url <> ''").select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct()
        self._append(rows.join(self.known().select("url"), "url", "left_anti"), "known")

    def state(self) -> DataFrame:
        """One row for each known URL: url, host, depth, parent, state (done, due, failed), tries, error and next_at."""
        tried = self.attempts().groupBy("url").agg(F.bool_or(F.col("error").isNull()).alias("done"), F.count("*").cast("int").alias("tries"), F.max_by("error", "at").alias("error"), F.max("at").alias("at"))
        rows = self.known().join(tried, "url", "left").withColumns({"tries": F.coalesce("tries", F.lit(0)), "done": F.coalesce("done", F.lit(False))})
        state = F.when(F.col("done"), "done").when(F.col("tries") >= self.tries, "failed").otherwise("due")
        next_at = F.when(F.col("tries") > 0, F.col("at") + F.lit(self.backoff) * F.pow(F.lit(2.0), F.col("tries") - 1)).otherwise(F.lit(0.0))
        return rows.select("url", host_of(F.col("url")).alias("host"), "depth", "parent", state.alias("state"), "tries", F.when(~F.col("done"), F.col("error")).alias("error"), F.when(state == "due", next_at).alias("next_at"))

    def pages(self) -> DataFrame:
        """(url, html): one page for each URL that has been had."""
        return self.attempts().where("error is null").groupBy("url").agg(F.max_by("html", "at").alias("html"))

    def failures(self) -> DataFrame:
        return self.state().where("state = 'failed'").select("url", "host", "tries", "error")

    def step(self, number: int, now: float) -> int:
        """One round over what is due; returns how many URLs it asked."""
        turn = F.row_number().over(Window.partitionBy("host").orderBy("next_at", "depth", "url"))
        due = self.state().where((F.col("state") == "due") & (F.col("next_at") <= now)).withColumn("turn", turn).where(F.col("turn") <= self.per_host)
        due = materialise(self.spark, due.select("url", "host", "turn"), "due")
        n = due.count()
        if not n:
            return 0
        hosts = due.select("host").distinct().count()
        get, pause = self.get, self.pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [r for batch in batches for r in zip(batch["url"], batch["host"], strict=True)]  # at most per_host URLs of each host
            for row in ask_hosts(rows, get, pause):
                url, host, html, error, at = row
                yield pd.DataFrame({"url": [url], "host": [host], "html": pd.Series([html], dtype=object), "error": pd.Series([error], dtype=object), "round": pd.Series([number], dtype="int32"), "at": [at]})

        dealt = due.repartition(min(hosts, self.tasks or hosts), "host").sortWithinPartitions("turn")
        self._append(dealt.mapInPandas(run, TRIED), "tried")
        return n

    def _find(self, number: int) -> None:
        """Links of the pages of a round become known, one deeper than the page."""
        if self.follow is None:
            return
        follow = self.follow

        @F.pandas_udf("array<string>")
        def links(pages: pd.Series) -> pd.Series:
            return pages.map(lambda p: list(dict.fromkeys(u for u in follow(p) if u)) if p else [])

        own = self.attempts().where((F.col("round") == number) & F.col("error").isNull()).join(self.known().select("url", "depth").where(F.col("depth") < self.depth), "url")
        found = own.select(F.explode(links("html")).alias("url"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent"))
        found = found.groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("w")).select("url", "w.depth", "w.parent")
        self._append(found.join(self.known().select("url"), "url", "left_anti"), "known")

    def run(self, rounds: int | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """Rounds until nothing is left to ask or to wait for, or ``rounds`` of them; returns the state. A crawl that was stopped between asking and finding finds the links
        of its last pages first."""
        last = self.attempts().agg(F.max("round")).first()[0] or 0
        if last:
            self._find(last)
        done = 0
        while rounds is None or done < rounds:
            asked = self.step(last + 1, clock())
            if asked:
                last, done = last + 1, done + 1
                self._find(last)
                continue
            nearest = self.state().where("state = 'due'").agg(F.min("next_at")).first()[0]
            if nearest is None:
                break
            sleep(max(0.01, nearest - clock()))
        return self.state()
