"""Pages to rows: elements, links, sentences, article entries; a retrying page source.

Parsing needs a state machine, so it runs in Python on Arrow batches; what can be said with patterns stays in the JVM.
"""

from __future__ import annotations

import re
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.sources.frontier import Frontier
from lodestrata.sources.tables import materialise, shared_dir

#: Bytes of a page that is parsed; a larger one is an error.
MOST_BYTES = 20_000_000
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


def strip_tags(html: Column) -> Column:
    return T.strip(F.regexp_replace(html, r"<[^>]+>", ""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]+)"'), 1)


def sup_sentences(html: Column) -> Column:
    """Array of (number, text): what follows each numbered <sup> up to the next; inner tags go, blanks are dropped."""
    pattern = r"(?s)<sup[^>]*>\s*(\d+)\s*</sup>(.*?)(?=<sup[^>]*>\s*\d+\s*</sup>|\z)"
    pairs = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2), lambda n, t: F.struct(n.try_cast("int").alias("nr"), strip_tags(t).alias("text")))
    return F.filter(pairs, lambda s: s["text"] != "")


def sentences(html: Column) -> Column:
    """Numbered sentences where the text holds '<sup>', else the whole as sentence 1."""
    plain = strip_tags(html)
    one = F.when(plain != "", F.array(F.struct(F.lit(1).alias("nr"), plain.alias("text")))).otherwise(F.array().cast("array<struct<nr:int,text:string>>"))
    return F.when(html.contains("<sup>"), sup_sentences(html)).otherwise(one)


def digit_sentences(text: Column) -> Column:
    """The older split: every number opens a sentence, if there is more than one; else the whole is sentence 1."""
    pattern = r"(?s)(\d+)([^0-9]+?)(?=\d+|\z)"
    numbers, texts = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    many = F.zip_with(numbers, texts, lambda n, t: F.struct(n.try_cast("int").alias("nr"), T.strip(t).alias("text")))
    return F.when(F.size(numbers) > 1, many).otherwise(F.array(F.struct(F.lit(1).alias("nr"), T.strip(text).alias("text"))))


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def all(self, *tags: str, deep: bool = True) -> list[Node]:
        found = []
        for item in self.items:
            if isinstance(item, Node):
                if item.tag in tags:
                    found.append(item)
                if deep:
                    found += item.all(*tags)
        return found

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self) -> str:
        return "".join(x.text() if isinstance(x, Node) else x for x in self.items)

    def html(self, without: tuple[str, ...] = ()) -> str:
        return "".join(x if isinstance(x, str) else "" if x.tag in without else f"<{x.tag}>{x.html(without)}</{x.tag}>" for x in self.items)


class Builder(HTMLParser):
    """A forgiving tree: an end tag closes its nearest open element, or nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(html: str | None) -> Node:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.top


SUP = re.compile(r"<sup>\s*(\d+)\s*</sup>(.*?)(?=<sup>\s*\d+\s*</sup>|\Z)", re.S)
TAGS = re.compile(r"<[^>]+>")


def split_sentences(html: str) -> list[tuple[int, str]]:
    """As ``sentences``, for one string inside a parser."""
    clean = lambda s: TAGS.sub("", s).strip()
    if "<sup>" in html:
        return [(int(n), clean(t)) for n, t in SUP.findall(html) if clean(t)]
    return [(1, clean(html))] if clean(html) else []


def navigation(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in T.NAVIGATION)


def list_entries(ol: Node) -> Iterator[tuple[int, int, int, str]]:
    """(paragraph, sub-paragraph, sentence, text): the place of an item is its paragraph; of a nested list's, its sub-paragraph, after the intro as 0."""
    for paragraph, li in enumerate(ol.all("li", deep=False), 1):
        inner = li.all("ol", deep=False)
        for number, text in split_sentences(li.html(without=("ol",))):
            yield paragraph, 0, number, text
        for nested in inner:
            for sub, item in enumerate(nested.all("li", deep=False), 1):
                for number, text in split_sentences(item.html()):
                    yield paragraph, sub, number, text


def article_entries(html: str | None) -> list[tuple[int, str, int, int, int, str]]:
    """(article, title, paragraph, sub-paragraph, sentence, text) of an article page; nothing where header or content is missing."""
    tree = parse(html)
    heads = [x for x in tree.all("header") if x.has_class("entry-header")]
    bodies = [x for x in tree.all("div") if x.has_class("entry-content")]
    if not heads or not bodies:
        return []
    spans = heads[0].all("span")
    text_of = lambda c: next((s.text().strip() for s in spans if s.has_class(c)), "")
    digits = re.search(r"\d+", text_of("dsgvo-number"))
    number, title = int(digits[0]) if digits else 0, text_of("dsgvo-title")
    lists = bodies[0].all("ol", deep=False)
    paragraphs = bodies[0].all("p", deep=False)
    if paragraphs and not lists:
        return [(number, title, 0, 0, n, t) for p in paragraphs if p.text().strip() and not navigation(p.text()) for n, t in split_sentences(p.html())]
    return [(number, title, *entry) for ol in lists for entry in list_entries(ol)]


def overview_events(html: str | None) -> list[tuple[int, str, int, str]]:
    """(pos, kind, number, name or link) of the contents list of an overview page, in document order; nothing without such a list."""
    out = []
    lists = [x for x in parse(html).all("div") if x.has_class("liste-inhaltsuebersicht") and x.has_class("dsgvo")]
    for pos, div in enumerate(lists[0].all("div") if lists else []):
        kind = next((k for c, k in (("kapitel", "chapter"), ("abschnitt", "section"), ("artikel", "article")) if div.has_class(c)), None)
        if kind == "article":
            link = next((a.attrs["href"] for a in div.all("a") if a.attrs.get("href")), None)
            if link:
                out.append((pos, kind, 0, link))
        elif kind:
            get = lambda c, div=div: next((s.text().strip() for s in div.all("span") if s.has_class(c)), None)
            if get("nummer") is not None and get("titel") is not None:
                digits = re.search(r"\d+", get("nummer"))
                out.append((pos, kind, int(digits[0]) if digits else 0, get("titel")))
    return out


def article_urls(html: str | None) -> list[tuple[str]]:
    """Links of the articles of an overview page."""
    return [(link,) for _, kind, _, link in overview_events(html) if kind == "article"]


def act_elements(html: str | None) -> list[tuple[int, str, str]]:
    """(pos, tag, text) of the headings and paragraphs of an act's page that its walk visits: those that stand in the content area, or in div and article
    elements nested in it, in document order."""
    tree = parse(html)
    divs = tree.all("div")
    roots = [x for x in divs if x.has_class("content")] or [x for x in divs if x.attrs.get("id") == "content"] or tree.all("main") or tree.all("body") or [tree]
    out: list[tuple[int, str, str]] = []

    def walk(node: Node) -> None:
        for x in node.all("h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", deep=False):
            if x.tag in ("div", "article"):
                walk(x)
            elif x.text().strip():
                out.append((len(out), x.tag, x.text().strip()))

    walk(roots[0])
    return out


def elements(html: str | None) -> list[tuple[int, str, str]]:
    """(pos, tag, text) of headings, paragraphs and list items, in document order, blanks dropped."""
    found = parse(html).all("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
    return [(k, x.tag, x.text().strip()) for k, x in enumerate(found) if x.text().strip()]


def parse_pages(pages: DataFrame, parser: Callable[[str | None], list[tuple]], columns: str, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of ``parser`` for every page, with the page's key. A page that cannot be parsed gives no rows."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, body in zip(batch["_key"], batch["_html"], strict=True):
                try:
                    rows += [(own, *r) for r in parser(body)]
                except (ValueError, AssertionError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_seq", *names])

    return pages.select(F.col(key).cast("long").alias("_key"), F.col(html).alias("_html")).mapInPandas(run, f"doc_seq bigint, {columns}")


class Parsed(NamedTuple):
    """What parsing gave: the rows of all pages; and for each page its key, stage, number of rows and error, which is null where there is none."""

    rows: DataFrame
    pages: DataFrame

    @property
    def errors(self) -> DataFrame:
        return self.pages.where("error is not null")


def parse_checked(pages: DataFrame, parser: Callable[[str | None], list[tuple]], columns: str, stage: str, *, key: str = "page_id", html: str = "html", most: int = MOST_BYTES) -> Parsed:
    """Rows of ``parser`` for every page, and a row for every page itself, from one pass that is written. A page that the parser cannot read, or of more than ``most`` bytes, has an
    error and no rows, so pages in and pages out agree; pages too large are not sent to Python. A null page has no rows and no error."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    empty = (None,) * len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, body, size in zip(batch["_key"], batch["_html"], batch["_size"], strict=True):
                found, error = [], None
                if size > most:
                    error = f"a page of {int(size)} bytes"
                else:
                    try:
                        found = parser(body)
                    except Exception as e:  # noqa: BLE001 - whatever a page does to a parser is an error of that page
                        error = f"{type(e).__name__}: {e}"[:500]
                out += [(own, False, None, None, *r) for r in found]
                out.append((own, True, len(found), error, *empty))
            frame = pd.DataFrame(out, columns=["doc_seq", "_page", "_n", "_error", *names], dtype=object)
            yield frame.astype({"_page": bool})

    size = F.coalesce(F.octet_length(html), F.lit(0)).cast("long")
    sent = pages.select(F.col(key).cast("long").alias("_key"), F.when(size <= most, F.col(html)).alias("_html"), size.alias("_size"))
    found = sent.mapInPandas(run, f"doc_seq bigint, _page boolean, _n bigint, _error string, {columns}")
    found = materialise(pages.sparkSession, found, "parsed")
    return Parsed(found.where("not _page").select("doc_seq", *names), found.where("_page").select("doc_seq", F.lit(stage).alias("stage"), F.col("_n").alias("n_rows"), F.col("_error").alias("error")))


def carried(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """For each column c the last value that is not null: ``c_upto`` a row and ``c_before`` it, in the order of pos on each page. A page is cut into independent parts of ``size`` places; a part begins
    with what the parts before it leave, of which there is one row each, so a page of any length is followed by many tasks."""
    cut = rows.withColumn("_part", F.floor(F.col("pos") / size))
    ends = cut.groupBy("doc_seq", "_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in columns))
    earlier = Window.partitionBy("doc_seq").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select("doc_seq", "_part", *(F.last(f"_{c}", True).over(earlier).alias(f"_{c}") for c in columns))
    own = Window.partitionBy("doc_seq", "_part").orderBy("pos")
    upto, before = (own.rowsBetween(Window.unboundedPreceding, at) for at in (0, -1))
    found = cut.join(left, ["doc_seq", "_part"]).withColumns({f"{c}_{n}": F.coalesce(F.last(c, True).over(w), F.col(f"_{c}")) for c in columns for n, w in (("upto", upto), ("before", before))})
    return found.drop("_part", *(f"_{c}" for c in columns))


def act_rows(parts: DataFrame, size: int = 10_000) -> DataFrame:
    """Structural walk of the act: elements (doc_seq, pos, tag, text) to paragraphs with section, subsection and article carried forward, over parts of ``size`` places.

    Headings set the article, else the section (which empties the subsection), else the subsection. A paragraph of more than ten characters
    may switch them too: 'Artikel n' the article and, only if it is another one, its title; 'KAPITEL n', or a text with KAPITEL and no number, the section, and only
    if it is another one that empties the subsection; 'ABSCHNITT n' the subsection. What is not known is 'Unknown'.
    """
    text, heading = F.col("text"), F.col("tag").rlike("^h[1-6]$")
    body = ~heading & (F.length(text) > 10)
    found = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    article = heading & T.is_article_header(text)
    section = heading & ~T.is_article_header(text) & T.is_section_header(text)
    subsection = heading & ~T.is_article_header(text) & ~T.is_section_header(text) & T.is_subsection_header(text)
    # number and title of an article header that has none of the stated shapes stay as they were
    number = F.when(article, T.article_number(text)).when(body, found(r"(?i)Artikel\s+(\d+)"))
    chapter = found(r"(?i)KAPITEL\s+(\d+)")
    named = F.when(section, text).when(body & text.contains("KAPITEL") & ~text.rlike(r"KAPITEL\s+\d+"), text).when(body & chapter.isNotNull(), F.concat(F.lit("KAPITEL "), chapter))
    part = found(r"(?i)ABSCHNITT\s+(\d+)")
    rows = carried(parts.withColumns({"number": number, "named": named}), ["number", "named"], size)
    other = F.col("number").isNotNull() & ~F.col("number_before").eqNullSafe(F.col("number"))
    title = F.when(article & F.col("number").isNotNull(), F.coalesce(T.article_title(text), F.lit(""))).when(body & other, T.strip(F.regexp_extract(text, r"(?i)Artikel\s+\d+[:\s]+(.+)", 1)))
    emptied = section | (body & F.col("named").isNotNull() & ~F.col("named_before").eqNullSafe(F.col("named")))
    under = F.when(subsection, text).when(body & part.isNotNull(), F.concat(F.lit("ABSCHNITT "), part)).when(emptied, F.lit(""))
    rows = carried(rows.withColumns({"title": title, "under": under}), ["title", "under"], size)
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    kept = rows.where(body & ~T.any_of(text, T.NAVIGATION_ACT))
    return kept.select("doc_seq", "pos", known("named_upto").alias("section"), known("under_upto").alias("subsection"), known("number_upto").alias("article_number"), known("title_upto").alias("article_title"), T.paragraph_number(text).alias("paragraph_number"), T.letter_number(text).alias("subparagraph_number"), "text")


def http_get(url: str, timeout: float = 10.0) -> str:
    """A page's text, by its stated encoding."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lodestrata"}), timeout=timeout) as reply:
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


class Crawl(NamedTuple):
    """Entries with the chapter and section of their article; and a row (stage, key, error) for every page that could not be had or read."""

    entries: DataFrame
    errors: DataFrame


def crawl(spark: SparkSession, overview_url: str, get: Callable[[str], str] = http_get, *, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """Entries of all articles of an overview page, with the chapter and section carried to each: overview, article links, article pages."""
    return crawl_checked(spark, overview_url, f"{shared_dir(spark)}/tables/crawl-{uuid.uuid4().hex}", get, tries=tries, pause=pause).entries


def crawl_checked(spark: SparkSession, overview_url: str, folder: str, get: Callable[[str], str] = http_get, **how) -> Crawl:
    """The same over a frontier in ``folder``, from which a crawl that was stopped goes on; lost pages are rows. ``how``: tries, pause, backoff, per_host, tasks."""
    from lodestrata.operators.prepare import carried_context

    frontier = Frontier(spark, folder, get, follow=lambda page: [u for (u,) in article_urls(page)], **how)
    frontier.add(spark.createDataFrame([(overview_url,)], "url string"))
    frontier.run()
    pages = materialise(spark, frontier.pages(), "pages")
    overview = parse_checked(pages.where(F.col("url") == overview_url).withColumn("page_id", F.lit(0)), overview_events, "pos int, kind string, nr int, name string", "overview")
    articles = carried_context(overview.rows).select(F.col("pos").cast("long").alias("page_id"), F.col("name").alias("url"), "kapitel_nr", "kapitel_name", "abschnitt_nr", "abschnitt_name")
    articles = materialise(spark, articles, "articles")
    found = parse_checked(articles.join(pages, "url"), article_entries, "artikel_nr int, artikel_name string, absatz_nr int, unterabsatz_nr int, satz_nr int, text string", "article")
    entries = articles.withColumnRenamed("page_id", "doc_seq").join(found.rows, "doc_seq")
    lost = frontier.failures().select(F.lit("fetch").alias("stage"), F.col("url").alias("key"), "error")
    unread = overview.errors.select("stage", F.lit(overview_url).alias("key"), "error").unionByName(found.errors.join(articles, found.errors["doc_seq"] == articles["page_id"]).select("stage", F.col("url").alias("key"), "error"))
    return Crawl(entries, lost.unionByName(unread))


def crawl_act(spark: SparkSession, url: str, folder: str, get: Callable[[str], str] = http_get, *, size: int = 10_000, **how) -> Crawl:
    """The act's page, from request to rows: a page that cannot be had or read is a row of the errors. Write the entries with ``sinks.write_jsonl``."""
    frontier = Frontier(spark, folder, get, **how)
    frontier.add(spark.createDataFrame([(url,)], "url string"))
    frontier.run()
    found = parse_checked(frontier.pages().where(F.col("url") == url).withColumn("page_id", F.lit(0)), act_elements, "pos int, tag string, text string", "act")
    lost = frontier.failures().select(F.lit("fetch").alias("stage"), F.col("url").alias("key"), "error")
    return Crawl(act_rows(found.rows, size), lost.unionByName(found.errors.select("stage", F.lit(url).alias("key"), "error")))


def fetch(urls: DataFrame, get: Callable[[str], str] = http_get, *, tries: int = 3, pause: float = 1.0, column: str = "url") -> DataFrame:
    """Pages by a client function, with a pause after each and a doubling wait after failures; html is null after the last try.
    The number of partitions bounds how many requests run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for url in batch[column]:
                body = None
                for attempt in range(tries):
                    try:
                        body = get(url)
                        break
                    except Exception:  # noqa: BLE001 - any client error is retried
                        time.sleep(pause * 2**attempt)
                bodies.append(body)
                time.sleep(pause)
            yield pd.DataFrame({"url": batch[column], "html": bodies})

    return urls.select(column).mapInPandas(run, "url string, html string")
