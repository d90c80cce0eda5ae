"""Article texts by ranges, one very large article, the act cut into parts, and its crawl."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import prepare
from lodestrata.plans import analysis, experiments
from lodestrata.sources import html, sinks

SF = "/root/testdata/sf0.001"


def test_texts_of_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 2, None]), rng.choice(["a", "b b", "", None])) for k in range(90)] + [(500, 9, None), (501, 9, None), (502, 8, "")]
    df = spark.createDataFrame(rows, "doc_seq long, artikel_nr int, text string").repartition(6)
    want = {}
    for _, key, text in rows:
        want.setdefault(key, []).append(text)
    want = {k: " ".join(t for t in own if t is not None) for k, own in want.items()}
    for size in (1, 7, 10_000):
        monkeypatch.setattr(prepare, "RANGE", size)
        assert {r["artikel_nr"]: r["article_context"] for r in prepare.article_texts(df).collect()} == want
    assert prepare.article_texts(df.where("doc_seq < 0")).count() == 0


def test_one_very_large_article(spark):
    """200 MB in one article: each text stands once in its row; the entries refer to it."""
    n, size = 20_000, 10_000
    rows = spark.range(0, n, 1, 16).select(F.col("id").alias("doc_seq"), F.lit(7).alias("artikel_nr"), F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.repeat(F.lit("x"), size - 8)).alias("text"))
    got = prepare.article_texts(rows).select("artikel_nr", F.length("article_context").alias("n"), F.substring("article_context", 1, 8).alias("first"), F.substring("article_context", -size, 8).alias("last")).collect()
    assert [tuple(r) for r in got] == [(7, n * (size + 1) - 1, "00000000", "00019999")]


def elements(rng, n):
    texts = ["KAPITEL 1", "KAPITEL III", "ABSCHNITT 2", "Artikel 5: Titel", "Artikel 6", "Der Anbieter nach Artikel 7 muss (1) handeln.", "In KAPITEL 4 steht ein langer Text.", "nach ABSCHNITT 3 gilt (b) das Folgende", "ein ganz gewöhnlicher Absatz", "kurz", "Unterabschnitt 3", "Teil 2"]
    return [(page, pos, rng.choice(["h1", "h3", "p", "p", "p"]), rng.choice(texts)) for page in (0, 1) for pos in range(n)]


@pytest.mark.parametrize("size", [1, 3, 25])
def test_act_in_parts(spark, size):
    df = spark.createDataFrame(elements(random.Random(size), 200), "doc_seq long, pos int, tag string, text string").repartition(5)
    whole, cut = (sorted(map(tuple, html.act_rows(df, n).collect())) for n in (10_000, size))
    assert whole == cut and len(whole) > 100
    own = df.withColumn("v", F.when(F.col("tag") == "h1", F.col("text")))
    for r in sorted(html.carried(own, ["v"], size).where("doc_seq = 0").collect(), key=lambda r: r["pos"]):
        if r["pos"]:
            assert r["v_before"] == last and r["v_upto"] == (r["v"] if r["v"] is not None else last)  # noqa: F821
        last = r["v_upto"]  # noqa: F841


def test_crawl_of_the_act(spark, tmp_path):
    page = "<main><h1>KAPITEL 1</h1><h2>Artikel 1: Zweck</h2><p>Ein Absatz (1) des Artikels.</p><div><p>Noch ein Absatz des Artikels.</p></div></main>"
    got = html.crawl_act(spark, "http://act/", f"{tmp_path}/f", lambda u: page, tries=1, pause=0.0)
    assert [(r["article_number"], r["section"], r["paragraph_number"]) for r in got.entries.orderBy("pos").collect()] == [("1", "KAPITEL 1", 1), ("1", "KAPITEL 1", 0)] and got.errors.count() == 0
    sinks.write_jsonl(got.entries, f"{tmp_path}/act")
    assert spark.read.json(f"{tmp_path}/act").count() == 2
    lost = html.crawl_act(spark, "http://act/", f"{tmp_path}/g", lambda u: 1 / 0, tries=1, pause=0.0)
    assert lost.entries.count() == 0 and [tuple(r)[:2] for r in lost.errors.collect()] == [("fetch", "http://act/")]


def test_small_operators(spark):
    runs = spark.createDataFrame([("SUCCESS", 0.5), ("FAILED", None), ("SUCCESS", 0.7), (None, 0.1)], "status string, m double")
    assert {r["status"]: (r["n"], r["failed"]) for r in analysis.status_counts(runs).collect()} == {"SUCCESS": (2, 0), "FAILED": (1, 1), None: (1, 0)}
    assert [r["status"] for r in analysis.status_counts(runs, without=["FAILED"]).collect()] == ["SUCCESS"]
    assert [(r["pos"], r["m"]) for r in analysis.positions(runs, ["m"]).orderBy("pos").collect()] == [(1, 0.7), (2, 0.5), (3, 0.1), (4, None)]
    assert {r["status"]: r["m"] for r in analysis.series(runs, "status", ["m", "nope"]).collect()}["SUCCESS"] == 0.6
    assert {r["k"]: r["n"] for r in prepare.type_counts(spark.createDataFrame([("a",), (None,), ("a",)], "k string"), "k").collect()} == {"a": 2, "unknown": 1}
    both = experiments.all_results(runs, spark.createDataFrame([("x", "bad")], "name string, error string"))
    assert both.count() == 5 and both.columns == ["status", "m", "name", "error"]


def test_subset_and_progress(spark, tmp_path):
    qa = spark.range(30).withColumnRenamed("id", "qa_seq")
    assert prepare.subset(qa, 7).count() == 7 and prepare.subset(qa, 99).count() == 30
    one, two = (sorted(r[0] for r in prepare.subset(qa.coalesce(1), 7, seed=3).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 7
