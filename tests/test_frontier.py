"""The resumable crawl and the error rows of parsers, with stand-ins for hosts: failing pages, a crawl that is killed, the pace, pages that no parser can read."""

import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata.sources import html
from lodestrata.sources.frontier import Frontier, ask_hosts, host_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


class Site:
    """Pages by URL; every request leaves a file with its time. ``flaky`` fail once, ``dead`` always, ``kill`` ends the worker."""

    def __init__(self, folder, pages, flaky=(), dead=(), kill=()):
        self.folder, self.pages, self.flaky, self.dead, self.kill = str(folder), pages, flaky, dead, kill

    def __call__(self, url):
        before = [u for u, _ in requests(self.folder)].count(url)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(f"{url}\n{time.time()}")
        if url in self.kill:
            raise SystemExit(1)
        if url in self.dead or (url in self.flaky and not before):
            raise TimeoutError(f"no answer from {url}")
        return self.pages[url]


def requests(folder):
    out = []
    for n in os.listdir(folder):
        url, _, at = open(f"{folder}/{n}").read().partition("\n")
        out.append((url, float(at or 0)))
    return sorted(out, key=lambda r: r[1])


def links(page):
    return [w for w in page.split() if "://" in w]


A, B = [f"http://a.example/{k}" for k in range(6)], [f"https://user@B.example:80/{k}?x=1" for k in range(4)]
PAGES = {"http://a.example/": " ".join([*A, *B, A[0]]), **{u: f"page {u.split('/')[-1]} http://a.example/ http://deep.example/" for u in [*A, *B]}}


def made(spark, path, site, **how):
    return Frontier(spark, f"{path}/frontier", site, follow=links, **{"pause": 0.0, "backoff": 0.0, "tries": 2, **how})


def test_hosts(spark):
    rows = spark.createDataFrame([(u,) for u in [A[0], B[0], "no host", "", None, "HTTP://X/"]], "u string")
    assert [r[0] for r in rows.select(host_of(F.col("u"))).collect()] == ["a.example", "b.example:80", "", "", "", "x"]


def test_crawl_with_failing_pages(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    f = made(spark, tmp_path, Site(calls, PAGES, flaky=(A[1], B[1]), dead=(A[2],)))
    f.add(spark.createDataFrame([("http://a.example/",), ("",), (None,), ("http://a.example/",)], "url string"))
    state = {r["url"]: r for r in f.run().collect()}
    assert len(state) == 11 and {u for u, r in state.items() if r["state"] == "failed"} == {A[2]} and state[A[1]]["tries"] == 2 and state[A[1]]["error"] is None
    assert [tuple(r) for r in f.failures().collect()] == [(A[2], "a.example", 2, f"no answer from {A[2]}")]
    assert {r["url"]: r["html"] for r in f.pages().collect()} == {u: p for u, p in PAGES.items() if u != A[2]}
    assert len(requests(calls)) == 11 + 3 and f.run().count() == 11 and len(requests(calls)) == 14  # nothing is asked again
    assert state[B[0]]["parent"] == "http://a.example/" and "http://deep.example/" not in state  # links of pages at the full depth are not followed


def test_killed_crawl_goes_on(spark, tmp_path):
    calls, plain = tmp_path / "c", tmp_path / "p"
    calls.mkdir(), plain.mkdir()
    f = made(spark, tmp_path, Site(calls, PAGES, kill=(A[3],)), per_host=1)
    f.add(spark.createDataFrame([("http://a.example/",)], "url string"))
    with pytest.raises(Exception, match="."):
        f.run()
    had = {r["url"] for r in f.pages().collect()}
    assert 1 < len(had) < 11
    again = made(spark, tmp_path, Site(plain, PAGES), per_host=2)
    assert {r["state"] for r in again.run().collect()} == {"done"}
    assert not had & {u for u, _ in requests(plain)}
    assert {r["url"]: r["html"] for r in again.pages().collect()} == PAGES


def test_pace_of_each_host(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    f = Frontier(spark, f"{tmp_path}/f", Site(calls, PAGES), pause=0.2, tries=1)
    f.add(spark.createDataFrame([(u,) for u in [*A, *B]], "url string"))
    f.run(rounds=1)
    for own in (A, B):
        at = [t for u, t in requests(calls) if u in own]
        assert len(at) == len(own) and min(b - a for a, b in zip(at, at[1:], strict=False)) >= 0.19
    seen = [u for u, *_ in ask_hosts([("a1", "a"), ("a2", "a"), ("b1", "b")], lambda u: u, 0.05)]
    assert seen == ["a1", "b1", "a2"]


def test_waits_for_what_is_due(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    f = Frontier(spark, f"{tmp_path}/f", Site(calls, PAGES, flaky=(A[0],)), pause=0.0, backoff=1_000.0, tries=2)
    f.add(spark.createDataFrame([(A[0],)], "url string"))
    now, slept = [time.time()], []

    def sleep(s):
        slept.append(s)
        now[0] += s + 1

    assert f.run(clock=lambda: now[0], sleep=sleep).first()["state"] == "done" and 900 < slept[0] <= 1_010
    assert Frontier(spark, f"{tmp_path}/g", Site(calls, PAGES)).run().count() == 0


def test_error_rows_of_pages(spark):
    deep, huge = "<div>" * 5_000 + "x" + "</div>" * 5_000, "<p>" + "x" * 50_000_000 + "</p>"
    bodies = ["<p>one</p><p>two</p>", None, "", deep, huge, "<p>three"]
    pages = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").repartition(2)
    got = html.parse_checked(pages, html.elements, "pos int, tag string, text string", "elements")
    by = {r["doc_seq"]: (r["n_rows"], r["error"]) for r in got.pages.collect()}
    assert by.keys() == set(range(6)) and [by[k] for k in (0, 1, 2, 5)] == [(2, None), (0, None), (0, None), (1, None)]
    assert by[3][0] == 0 and "RecursionError" in by[3][1] and by[4] == (0, "a page of 50000007 bytes")
    assert sorted(r["text"] for r in got.rows.collect()) == ["one", "three", "two"] and got.errors.count() == 2
    assert got.pages.agg(F.sum("n_rows")).first()[0] == got.rows.count()
    assert sorted(map(tuple, html.parse_pages(pages.where("page_id <> 4"), html.elements, "pos int, tag string, text string").collect())) == sorted(map(tuple, got.rows.collect()))
    none = html.parse_checked(pages.where("page_id > 9"), html.elements, "pos int, tag string, text string", "elements")
    assert none.rows.count() == none.pages.count() == 0


def article(k):
    return f'<header class="entry-header"><span class="dsgvo-number">Art. {k}</span><span class="dsgvo-title">T{k}</span></header><div class="entry-content"><ol><li>Satz {k}.</li></ol></div>'


def test_lost_pages_of_a_crawl_are_rows(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    items = "".join(f'<div class="artikel"><a href="http://h/{k}">x</a></div>' for k in range(1, 5))
    pages = {"http://h/": f'<div class="liste-inhaltsuebersicht dsgvo"><div class="kapitel"><span class="nummer">Kapitel 1</span><span class="titel">K</span></div>{items}</div>', **{f"http://h/{k}": article(k) for k in (1, 2, 3)}, "http://h/4": "<div>" * 5_000}
    got = html.crawl_checked(spark, "http://h/", f"{tmp_path}/f", Site(calls, pages, dead=("http://h/2",)), tries=2, pause=0.0, backoff=0.0)
    assert sorted((r["artikel_nr"], r["kapitel_nr"], r["text"]) for r in got.entries.collect()) == [(1, 1, "Satz 1."), (3, 1, "Satz 3.")]
    errors = {r["key"]: (r["stage"], r["error"]) for r in got.errors.collect()}
    assert errors["http://h/2"] == ("fetch", "no answer from http://h/2") and errors["http://h/4"][0] == "article" and len(errors) == 2
