"""Scans, sinks and the crawl, on hand-made files and pages."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata.operators import prepare, retrieval
from lodestrata.plans import analysis
from lodestrata.sources import html, readers, sinks, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def test_numbered(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(json.dumps({"id": f"e{k}", "Text": "x" * (k % 50)}) for k in range(3000)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = readers.jsonl_entries(spark, str(path))
        assert rows.rdd.getNumPartitions() > 2
        got = sorted((r["doc_seq"], r["id"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [k for k, _ in got] == list(range(3000)) and {x for _, x in got} == {f"e{k}" for k in range(3000)}
    assert readers.jsonl_entries(spark, str(path)).where("doc_seq = 7").first()["id"] == "e7"
    (tmp_path / "none.jsonl").write_text("")
    assert readers.jsonl_entries(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_csv_falls_back_to_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.csv_table(spark, str(tmp_path / "t.csv"), "a int").collect()) == [1, 2]
    (tmp_path / "t.csv").write_text("a\n3\n")
    assert readers.csv_table(spark, str(tmp_path / "t.csv"), "a int").collect()[0]["a"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "k int, t string")
    sinks.write_jsonl(df, str(tmp_path / "j"), one_file=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    for batch in (0, 1, 1):  # a batch that is repeated replaces itself
        sinks.append_progress(df, str(tmp_path / "p"), batch)
    assert spark.read.json(str(tmp_path / "p")).count() == 4
    assert sinks.markdown(df).splitlines() == ["| k | t |", "| --- | --- |", "| 1 | ä |", "| 2 |  |"]
    with pytest.raises(ValueError):
        sinks.markdown(df, 1)
    assert sinks.preview(df, 1) == [{"k": 1, "t": "ä"}]
    assert sinks.sheet_names(["a" * 40, "a" * 35, "b/c"]) == ["a" * 31, "a" * 29 + "~2", "b_c"]
    with pytest.raises(ValueError):
        sinks.write_excel({"x": df}, str(tmp_path / "x.xlsx"), most=1)
    grouped = spark.createDataFrame([(1, "a", "t", True)], "doc_seq long, id string, text string, grouped boolean")
    sinks.write_corpus(grouped, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).first()["metadata"]["grouped"]


def test_cache(spark, tmp_path):
    cache = sinks.TableCache(spark, str(tmp_path / "cache"))
    df = spark.range(3)
    assert cache.get("t", {"k": 1}, lambda: df).count() == cache.get("t", {"k": 1}, lambda: 1 / 0).count() == 3
    (tmp_path / "cache" / "notes.txt").write_text("mine")
    assert [kind for *_, kind in cache.info()] == ["file", "directory"]
    cache.clear()
    assert [name for name, *_ in cache.info()] == ["notes.txt"]


def test_comparison_report(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "SUCCESS", 0.5, 2.0), (1, "b", "SUCCESS", 0.7, 3.0), (2, "c", "FAILED", None, None)], "seq int, name string, status string, avg_f1 double, avg_query_time double")
    text = sinks.write_comparison(df, str(tmp_path), "now")
    assert text.splitlines()[:4] == ["Successful: 2", "Failed: 1", "By avg_f1:", "  b: 0.7000"] and text.endswith("FAILED c")
    assert (tmp_path / "comparison_report_now.txt").read_text() == text and len(spark.read.json(str(tmp_path / "comparison_results_now.json")).collect()) == 3


PAGES = {
    "/all": '<div class="artikel"><a href="/no">x</a></div><div class="liste-inhaltsuebersicht dsgvo"><div class="kapitel"><span class="nummer">Kapitel 1</span><span class="titel">Eins</span></div>'
    '<div class="abschnitt"><span class="nummer">Abschnitt 2</span><span class="titel">Zwei</span></div><div class="artikel"><a href="/1">a</a></div>'
    '<div class="kapitel"><span class="nummer">Kapitel 2</span><span class="titel">Neu</span></div><div class="artikel"><a href="/2">b</a></div><div class="artikel"><a href="/gone">c</a></div></div>',
    "/1": '<header class="entry-header"><span class="dsgvo-number">Art. 1 X</span><span class="dsgvo-title">Erster</span></header><div class="entry-content"><ol><li>Vor<ol><li>a</li><li>b</li></ol></li><li><sup>1</sup>S1. <sup>2</sup>S2.</li></ol></div>',
    "/2": '<header class="entry-header"><span class="dsgvo-number">Art. 2 X</span><span class="dsgvo-title">Zweiter</span></header><div class="entry-content"><p>Text.</p><p>Seite drucken</p></div>',
}


def page(url):
    return PAGES[url]


def test_crawl(spark):
    got = sorted(tuple(r) for r in html.crawl(spark, "/all", page, tries=1, pause=0.0).select("artikel_nr", "absatz_nr", "unterabsatz_nr", "satz_nr", "text", "kapitel_nr", "abschnitt_nr", "abschnitt_name").collect())
    assert got == [(1, 1, 0, 1, "Vor", 1, 2, "Zwei"), (1, 1, 1, 1, "a", 1, 2, "Zwei"), (1, 1, 2, 1, "b", 1, 2, "Zwei"), (1, 2, 0, 1, "S1.", 1, 2, "Zwei"), (1, 2, 0, 2, "S2.", 1, 2, "Zwei"), (2, 0, 0, 1, "Text.", 2, 0, "")]
    assert html.overview_events('<div class="artikel"><a href="/x">x</a></div>') == []


def test_act_walk(spark):
    body = """<html><body><nav><p>KAPITEL 9 in navigation stays unseen</p></nav><div class="content"><h1>Act</h1><p>Before everything here.</p><h2>KAPITEL 1</h2><h3>Teil 2</h3><h3>Artikel 5: Fifth</h3>
    <div><p>(1) First paragraph (b).</p><ul><li>list item that is not visited</li></ul></div><p>See Artikel 5 again, twice.</p><p>Now Artikel 6 Sixth title</p><p>KAPITEL 1 named again here</p><p>KAPITEL II without a number</p><p>ABSCHNITT 3 of the rest</p><p>short</p></div></body></html>"""
    pages = spark.createDataFrame([(1, body)], "page_id long, html string")
    rows = html.act_rows(html.parse_pages(pages, html.act_elements, "pos int, tag string, text string")).orderBy("pos").collect()
    got = [(r["text"][:12], r["section"], r["subsection"], r["article_number"], r["article_title"], r["paragraph_number"], r["subparagraph_number"]) for r in rows]
    unknown = "Unknown"
    assert got == [
        ("Before every", unknown, unknown, unknown, unknown, 0, 0),
        ("(1) First pa", "KAPITEL 1", "Teil 2", "5", "Fifth", 1, 2),
        ("See Artikel ", "KAPITEL 1", "Teil 2", "5", "Fifth", 0, 0),
        ("Now Artikel ", "KAPITEL 1", "Teil 2", "6", "Sixth title", 0, 0),
        ("KAPITEL 1 na", "KAPITEL 1", "Teil 2", "6", "Sixth title", 0, 0),
        ("KAPITEL II w", "KAPITEL II without a number", unknown, "6", "Sixth title", 0, 0),
        ("ABSCHNITT 3 ", "KAPITEL II without a number", "ABSCHNITT 3", "6", "Sixth title", 0, 0),
    ]


def test_groupings_and_best(spark):
    df = spark.createDataFrame([(0, "a", "x", 1.0, None), (1, "b", "y", float("nan"), 2.0), (2, "c", "x", 3.0, 1.0)], "seq int, name string, llm_model string, avg_f1 double, query_time double")
    assert analysis.best_by(df, ["avg_f1", "query_time"]).first().asDict() == {"avg_f1": "c", "query_time": "c"}
    got = analysis.all_groupings(df, analysis.GROUPINGS, analysis.METRICS)
    assert sorted(r["llm_model"] for r in got.collect()) == ["x", "y"]
    assert analysis.all_groupings(df.drop("llm_model"), analysis.GROUPINGS, analysis.METRICS).count() == 0


def test_short_labels(spark):
    from lodestrata.functions import text as T

    df = spark.createDataFrame([("Recursive-v2", "mistral:7b"), ("other", "gpt-4o-mini"), ("FixedSize", "phi")], "c string, m string")
    assert [tuple(r) for r in df.select(T.short_chunking(F.col("c")), T.short_model(F.col("m"))).collect()] == [("rec", "mis7b"), ("other", "g4o-mini"), ("fs", "phi")]
    zero = spark.createDataFrame([("0", "b"), ("", "b"), (None, "b"), ("a", "b")], "a string, b string")
    assert [r[0] for r in zero.select(T.truthy_or(F.col("a"), F.col("b"))).collect()] == ["b", "b", "b", "a"]


def test_prefix_state_over_ranges(spark, monkeypatch):
    entries = spark.createDataFrame([(k, f"d{k}", "x" if k % 5 else "", k // 7, "n", k % 7 // 2, k % 3, 0, 0) for k in range(60)], "doc_seq long, id string, text string, artikel_nr int, artikel_name string, absatz_nr int, unterabsatz_nr int, kapitel_nr int, abschnitt_nr int")
    whole = {r["doc_seq"]: r["label"] for r in prepare.prefixed(entries).collect()}
    monkeypatch.setattr(prepare, "RANGE", 4)
    assert {r["doc_seq"]: r["label"] for r in prepare.prefixed(entries).collect()} == whole and len(set(whole.values())) > 5


@pytest.mark.parametrize("block", [4096, 3])
def test_top_hits(spark, block):
    vectors = [(k, [float(k % 5), float(k % 3), 1.0] if k % 11 else None) for k in range(60)]
    q = spark.createDataFrame([(f"q{k}", v) for k, v in vectors[1:9]] + [("none", None)], "q_id string, q_vec array<double>")
    c = spark.createDataFrame(vectors, "chunk_seq long, vec array<double>").repartition(5)

    def cosine(a, b):
        dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
        return round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 12) if a and b and any(a) and any(b) else 0.0

    got = {}
    for r in retrieval.top_hits(q, c, 4, threshold=0.0, block=block).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["chunk_seq"]
    for name, v in [(f"q{k}", v) for k, v in vectors[1:9]] + [("none", None)]:
        want = sorted(((-cosine(v, w), -k) for k, w in vectors))[:4]
        assert got[name] == {rank: -k for rank, (_, k) in enumerate(want, 1)}


def test_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())
    path = tables.materialise(spark, spark.range(2), "t").inputFiles()[0]
    assert "/tables/t-" in path
