"""The registered queries of the retrieval and analysis engine, each beside its SQL twin where SQL can express it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics as M
from lodestrata.functions import text as T
from lodestrata.functions import vectors as V
from lodestrata.operators import chunking, context, generate, prepare
from lodestrata.operators import retrieval as R
from lodestrata.operators.calls import Calls, Record
from lodestrata.operators.clusters import ClusterIndex
from lodestrata.plans import analysis, experiments, summary
from lodestrata.plans.grid import Setting, grid_contexts
from lodestrata.sources import html as H
from lodestrata.sources.readers import entries_of_documents
from lodestrata.sources.tables import remove, shared_dir
from lodestrata.sources.versions import VersionedIndex

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

WORDS = "list_distinct(regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1))"
TOKENS = "list_filter(regexp_split_to_array({}, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')"


def w(c: str) -> str:
    return WORDS.format(c)


def ws(c: str) -> str:
    return TOKENS.format(c)


def sqlist(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "doc_seq")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries_of_documents(table(spark, sf, "documents"))


ENTRIES = """entries AS (SELECT doc_id AS doc_seq, 'doc_' || doc_id AS id, text, coalesce(try_cast(regexp_extract(source, '(\\d+)', 1) AS INTEGER), 0) AS kapitel_nr, 'Kapitel ' || source AS kapitel_name,
    CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 0 END AS abschnitt_nr, CAST(doc_id // 7 AS INTEGER) AS artikel_nr, 'Titel ' || (doc_id // 7) AS artikel_name,
    CAST((doc_id % 7) // 2 AS INTEGER) AS absatz_nr, CAST(doc_id % 3 AS INTEGER) AS unterabsatz_nr, 1 AS satz_nr FROM documents)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's next turn; the document of the conversation's number is the expected answer and the context."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("expected"), F.col("text").alias("context"))
    return user.join(reply, ["conv_id", "turn"]).join(d, "conv_id", "left").fillna("", ["expected", "context"])


ANSWERS = """qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS actual, coalesce(d.text, '') AS expected, coalesce(d.text, '') AS context
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' LEFT JOIN documents d ON d.doc_id = u.conv_id WHERE u.role = 'user')"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as experiment rows: flag and status as kinds, quantities as metrics."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("llm_model"), F.when(F.col("l_linestatus") == "O", "fixedsize").otherwise("recursive").alias("chunking_type"), F.col("l_linenumber").alias("top_k"), F.round(F.col("l_tax"), 2).alias("similarity_threshold"), (F.col("l_partkey") % 5 * 500).alias("chunk_size"), F.col("l_discount").alias("avg_f1"), (F.col("l_quantity") / 50).alias("avg_dsgvo_score"))


OUTCOMES = """runs AS (SELECT l_returnflag AS llm_model, CASE WHEN l_linestatus = 'O' THEN 'fixedsize' ELSE 'recursive' END AS chunking_type, l_linenumber AS top_k, round(l_tax, 2) AS similarity_threshold,
    l_partkey % 5 * 500 AS chunk_size, l_discount AS avg_f1, l_quantity / 50 AS avg_dsgvo_score FROM lineitem)"""
#: Means are compared after rounding to six places: sums of doubles depend on their order.
STATS = ", ".join(f"round(avg({m}), 6) AS {m}__mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}__std, CAST(count({m}) AS INTEGER) AS {m}__count" for m in ("avg_f1", "avg_dsgvo_score"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# scans and projections


@query("jsonl_document_scan", f"WITH {ENTRIES} SELECT doc_seq, id, kapitel_nr, kapitel_name, abschnitt_nr, artikel_nr, artikel_name, absatz_nr, unterabsatz_nr, satz_nr, length(text) AS n FROM entries")
def _(spark, sf):
    return entries(spark, sf).withColumn("n", F.length("text").cast("long")).drop("text")


@query("grouped_scan", f"WITH {ENTRIES} SELECT artikel_nr, count(*) AS n_entries, min(doc_seq) AS first_seq FROM entries GROUP BY artikel_nr")
def _(spark, sf):
    return prepare.article_counts(entries(spark, sf))


@query("entry_ids", f"WITH {ENTRIES} SELECT doc_seq, 'law_art_' || artikel_nr || '_abs_' || absatz_nr || CASE WHEN unterabsatz_nr > 0 THEN '(' || unterabsatz_nr || ')' ELSE '' END || '_satz_' || satz_nr AS entry_id FROM entries")
def _(spark, sf):
    return entries(spark, sf).select("doc_seq", T.entry_id("law", F.col("artikel_nr"), F.col("absatz_nr"), F.col("unterabsatz_nr"), F.col("satz_nr")).alias("entry_id"))


@query("nested_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(nullif(json_extract_string(props, '$.missing.x'), ''), event_type) AS fallback FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), T.truthy_or(F.get_json_object("props", "$.missing.x"), F.col("event_type")).alias("fallback"))


@query("short_labels", """SELECT DISTINCT p_type, CASE WHEN contains(lower(p_type), 'semantic') THEN 'semantic' WHEN contains(lower(p_type), 'recursive') THEN 'recursive' WHEN contains(lower(p_type), 'fixed') THEN 'fixedsize' ELSE p_type END AS kind,
    CASE WHEN contains(p_name, 'MiniLM') THEN 'st-mini' WHEN contains(p_name, 'mpnet') THEN 'mpnet' ELSE 'emb' END AS abbr, 's' || lpad(CAST(p_size % 10 * 10 AS VARCHAR), 2, '0') AS thr FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_type", T.chunking_type(F.col("p_type")).alias("kind"), T.model_abbreviation(F.col("p_name"), "emb").alias("abbr"), T.short_threshold((F.col("p_size") % 10) / 10).alias("thr")).distinct()


@query("rename_and_label", f"WITH {OUTCOMES} SELECT DISTINCT concat_ws('-', CASE chunking_type WHEN 'fixedsize' THEN 'fs' ELSE 'rec' END, chunk_size, 'k' || top_k, 's' || lpad(CAST(CAST(round_even(similarity_threshold * 100, 0) AS INTEGER) AS VARCHAR), 2, '0'), llm_model) AS combo FROM runs")
def _(spark, sf):
    df = outcomes(spark, sf).withColumnsRenamed({"top_k": "retrieval_top_k", "chunking_type": "chunking_name"}).withColumnsRenamed(analysis.SHORT_NAMES)
    return df.select(analysis.combination(df).alias("combo")).distinct()


@query("status_filter", "SELECT o_orderstatus AS status, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS failed FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(spark, sf):
    return analysis.status_counts(table(spark, sf, "orders"), "o_orderstatus", failed="F", without=["P"])


@query("length_filter", f"WITH {ENTRIES} SELECT doc_seq FROM entries WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100")
def _(spark, sf):
    return entries(spark, sf).where(F.length(T.strip(F.col("text"))) >= 100).select("doc_seq")


@query("nav_filter", f"SELECT page_id, list_bool_or(list_transform({sqlist(T.NAVIGATION)}, lambda k: contains(lower(html), k))) AS nav, list_bool_or(list_transform({sqlist(T.NAVIGATION_ACT)}, lambda k: contains(lower(html), k))) AS nav_act FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.any_of(F.col("html"), T.NAVIGATION).alias("nav"), T.any_of(F.col("html"), T.NAVIGATION_ACT).alias("nav_act"))


@query("topic_extract", f"SELECT doc_id, array_to_string(list_filter({sqlist(T.TOPICS)}, lambda k: contains(lower(text || ' Verarbeitung der Rechte und ' || source), lower(k)))[1:3], '|') AS topics FROM documents")
def _(spark, sf):
    text = F.concat("text", F.lit(" Verarbeitung der Rechte und "), "source")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.topics(text), "|").alias("topics"))


@query("first_paragraph", "SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10))[1] AS para, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS cut FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.first_paragraph(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("para"), T.ellipsis(F.col("text")).alias("cut"))


@query("number_extract", """SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '(\\d+)', 1), '') AS INTEGER), 0) AS n, coalesce(try_cast(nullif(regexp_extract(h, '\\((\\d+)\\)', 1), '') AS INTEGER), 0) AS para,
    CASE WHEN regexp_extract(h, '(?i)\\(([a-z])\\)', 1) <> '' THEN ascii(lower(regexp_extract(h, '(?i)\\(([a-z])\\)', 1))) - 96 ELSE 0 END AS letter FROM (SELECT *, '(' || page_id || ') (' || chr(CAST(97 + page_id % 26 AS INTEGER)) || ') x' AS h FROM pages)""")
def _(spark, sf):
    h = F.concat(F.lit("("), F.col("page_id").cast("string"), F.lit(") ("), F.char(97 + F.col("page_id") % 26), F.lit(") x"))
    return table(spark, sf, "pages").select("page_id", T.first_number(F.col("url")).alias("n"), T.paragraph_number(h).alias("para"), T.letter_number(h).alias("letter"))


_HEADERS = ["Artikel {}: Titel {}", "Art. {}", "KAPITEL {}", "Section {} x", "Teil {}", "Art {} Name {}", "Article {}", "im Artikel {}"]
_HEADER_SQL = "replace(" + sqlist(_HEADERS) + "[CAST(page_id % 8 + 1 AS INTEGER)], '{}', CAST(page_id AS VARCHAR))"


@query("header_classifiers", f"""SELECT page_id, regexp_matches(h, '(?i)^(artikel\\s+\\d+|article\\s+\\d+|art\\.\\s*\\d+|art\\s+\\d+)') AS article, regexp_matches(h, '(?i)^(kapitel|chapter|abschnitt|section)\\s+\\d+') AS section, regexp_matches(h, '(?i)^(unterabschnitt|subsection|teil|part)\\s+\\d+') AS subsection,
    nullif(regexp_extract(h, '(?i)^(?:artikel\\s+|article\\s+|art\\.\\s*|art\\s+)(\\d+)(?:[:\\s]+.+|\\s*$)', 1), '') AS number, trim(regexp_extract(h, '(?i)^(?:artikel\\s+|article\\s+|art\\.\\s*|art\\s+)\\d+[:\\s]+(.+)', 1)) AS title FROM (SELECT page_id, {_HEADER_SQL} AS h FROM pages)""")
def _(spark, sf):
    h = F.replace(F.get(F.array(*map(F.lit, _HEADERS)), (F.col("page_id") % 8).cast("int")), F.lit("{}"), F.col("page_id").cast("string"))
    p = table(spark, sf, "pages").select("page_id", h.alias("h"))
    c = F.col("h")
    return p.select("page_id", T.is_article_header(c).alias("article"), T.is_section_header(c).alias("section"), T.is_subsection_header(c).alias("subsection"), T.article_number(c).alias("number"), T.article_title(c).alias("title"))


@query("html_strip", "SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.strip_tags(F.col("html")).alias("text"))


@query("html_links", "SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1) AS l FROM pages)")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.links(F.col("html")).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query("html_elements")
def _(spark, sf):
    return H.parse_pages(table(spark, sf, "pages"), H.elements, "pos int, tag string, text string")


#: White space off both ends, as Unicode knows it.
BLANK = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


def article_html(spark, sf):
    """The documents as article pages: by their ids, paragraphs alone, a list of numbered sentences, or nested lists; a line is a paragraph."""
    head = F.concat(F.lit('<header class="entry-header"><span class="dsgvo-number">Art. '), F.col("doc_id").cast("string"), F.lit(' X</span><span class="dsgvo-title"> '), F.coalesce("source", F.lit("")), F.lit('</span></header><div class="entry-content">'))
    lines = F.split(F.translate("text", "<>&", "   "), "\n")
    wrap = lambda before, after: F.array_join(F.transform(lines, lambda t: F.concat(F.lit(before), t, F.lit(after))), "")
    plain, marked, nested = wrap("<p>", "</p>"), wrap("<li><sup>1</sup>", " <sup>2</sup>Ende.</li>"), wrap("<li>", "<ol><li>a</li><li> <b>b</b></li></ol></li>")
    body = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<ol>"), marked, F.lit("</ol>"))).otherwise(F.concat(F.lit("<ol>"), nested, F.lit("</ol>")))
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.concat(head, body, F.lit("</div>")).alias("html"))


@query("article_pages", f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, string_split(translate(text, '<>&', '   '), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, source, CAST(doc_id % 3 AS INTEGER) AS kind, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS k FROM d), t AS (SELECT *, {stripped('raw')} AS text FROM x),
    r AS (SELECT doc_id, source, CASE kind WHEN 0 THEN 0 ELSE k END AS p, 0 AS u, 1 AS s, text FROM t WHERE text <> '' AND NOT (kind = 0 AND list_bool_or(list_transform({sqlist(T.NAVIGATION)}, lambda n: contains(lower(text), n))))
    UNION ALL SELECT doc_id, source, k, 0, 2, 'Ende.' FROM t WHERE kind = 1 UNION ALL SELECT doc_id, source, k, 1, 1, 'a' FROM t WHERE kind = 2 UNION ALL SELECT doc_id, source, k, 2, 1, 'b' FROM t WHERE kind = 2)
    SELECT doc_id AS doc_seq, CAST(doc_id AS INTEGER) AS artikel_nr, {stripped('source')} AS artikel_name, CAST(p AS INTEGER) AS absatz_nr, CAST(u AS INTEGER) AS unterabsatz_nr, CAST(s AS INTEGER) AS satz_nr, text FROM r""")
def _(spark, sf):
    return H.parse_pages(article_html(spark, sf), H.article_entries, "artikel_nr int, artikel_name string, absatz_nr int, unterabsatz_nr int, satz_nr int, text string")


def overview_html(spark, sf):
    """Fifty documents of neighbouring ids as an overview page: every tenth a chapter, half-way a section, the others articles; and a link outside the list."""
    d = table(spark, sf, "documents")
    number, titled = F.col("doc_id").cast("string"), F.concat(F.lit('</span><span class="titel">'), F.coalesce("source", F.lit("")), F.lit("</span></div>"))
    kind = lambda c, word: F.concat(F.lit(f'<div class="x {c}"><span class="nummer">{word} '), number, titled)
    part = F.when(F.col("doc_id") % 10 == 0, kind("kapitel", "Kapitel")).when(F.col("doc_id") % 10 == 5, kind("abschnitt", "Abschnitt")).otherwise(F.concat(F.lit('<div class="artikel"><a href="/art-'), number, F.lit('">x</a></div>')))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("part")))), lambda x: x["part"]), "\n")
    html = F.concat(F.lit('<div class="artikel"><a href="/elsewhere">x</a></div><div class="liste-inhaltsuebersicht dsgvo">'), parts, F.lit("</div>"))
    return d.groupBy(F.floor(F.col("doc_id") / 50).alias("page_id")).agg(html.alias("html"))


@query("overview_walk", f"""WITH e AS (SELECT doc_id // 50 AS g, doc_id, {stripped("coalesce(source, '')")} AS name, CASE doc_id % 10 WHEN 0 THEN 'k' WHEN 5 THEN 's' ELSE 'a' END AS kind FROM documents),
    c AS (SELECT *, last_value(CASE WHEN kind = 'k' THEN doc_id END IGNORE NULLS) OVER o AS k, last_value(CASE WHEN kind = 'k' THEN name END IGNORE NULLS) OVER o AS kn,
    last_value(CASE kind WHEN 'k' THEN 0 WHEN 's' THEN doc_id END IGNORE NULLS) OVER o AS s, last_value(CASE kind WHEN 'k' THEN '' WHEN 's' THEN name END IGNORE NULLS) OVER o AS sn FROM e WINDOW o AS (PARTITION BY g ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
    SELECT g AS doc_seq, '/art-' || doc_id AS url, CAST(coalesce(k, 0) AS INTEGER) AS kapitel_nr, coalesce(kn, '') AS kapitel_name, CAST(coalesce(s, 0) AS INTEGER) AS abschnitt_nr, coalesce(sn, '') AS abschnitt_name FROM c WHERE kind = 'a'""")
def _(spark, sf):
    events = H.parse_pages(overview_html(spark, sf), H.overview_events, "pos int, kind string, nr int, name string")
    return prepare.carried_context(events).select("doc_seq", F.col("name").alias("url"), "kapitel_nr", "kapitel_name", "abschnitt_nr", "abschnitt_name")


@query("overview_links", "SELECT doc_id // 50 AS doc_seq, '/art-' || doc_id AS url FROM documents WHERE doc_id % 5 <> 0")
def _(spark, sf):
    return H.parse_pages(overview_html(spark, sf), H.article_urls, "url string")


@query("sup_sentences", """WITH m AS (SELECT page_id, replace(html, '<li>', '<sup>1</sup>') AS h FROM pages),
    s AS (SELECT page_id, h, regexp_extract_all(h, '<sup[^>]*>\\s*(\\d+)\\s*</sup>', 1) AS n, regexp_split_to_array(h, '<sup[^>]*>\\s*\\d+\\s*</sup>')[2:] AS t FROM m),
    p AS (SELECT page_id, CASE WHEN contains(h, '<sup>') THEN list_transform(list_zip(n, t), lambda x: {'nr': TRY_CAST(x[1] AS INTEGER), 'text': x[2]}) ELSE [{'nr': 1, 'text': h}] END AS l FROM s),
    c AS (SELECT page_id, list_filter(list_transform(l, lambda x: {'nr': x.nr, 'text': regexp_replace(regexp_replace(x.text, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')}), lambda x: x.text <> '') AS l FROM p)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, l[pos + 1].nr AS nr, l[pos + 1].text AS text FROM (SELECT page_id, l, unnest(range(len(l))) AS pos FROM c)""")
def _(spark, sf):
    marked = F.regexp_replace("html", "<li>", "<sup>1</sup>")
    return table(spark, sf, "pages").select("page_id", F.posexplode(H.sentences(marked)).alias("pos", "s")).select("page_id", "pos", "s.nr", "s.text")


@query("digit_sentences", """WITH m AS (SELECT doc_id AS doc_seq, text, regexp_extract_all(text, '([0-9]+)[^0-9]+', 1) AS n, regexp_extract_all(text, '[0-9]+([^0-9]+)', 1) AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_seq, CASE WHEN len(n) > 1 THEN list_transform(list_zip(n, t), lambda x: {'nr': TRY_CAST(x[1] AS INTEGER), 'text': x[2]}) ELSE [{'nr': 1, 'text': text}] END AS l FROM m)
    SELECT doc_seq, CAST(pos AS INTEGER) AS pos, l[pos + 1].nr AS nr, regexp_replace(l[pos + 1].text, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_seq, l, unnest(range(len(l))) AS pos FROM p)""")
def _(spark, sf):
    return docs(spark, sf).select("doc_seq", F.posexplode(H.digit_sentences(F.col("text"))).alias("pos", "s")).select("doc_seq", "pos", "s.nr", "s.text")


@query("act_walk")
def _(spark, sf):
    return H.act_rows(H.parse_pages(table(spark, sf, "pages"), H.act_elements, "pos int, tag string, text string"))


@query("carry_forward", """WITH e AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' ELSE 'article' END AS kind, CAST(event_id % 97 AS INTEGER) AS nr FROM events),
    c AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN nr END IGNORE NULLS) OVER o AS k, last_value(CASE WHEN kind = 'chapter' THEN 0 WHEN kind = 'section' THEN nr END IGNORE NULLS) OVER o AS s FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id AS doc_seq, event_id AS pos, nr, coalesce(k, 0) AS kapitel_nr, coalesce(s, 0) AS abschnitt_nr FROM c WHERE kind = 'article'""")
def _(spark, sf):
    kind = F.when(F.col("event_id") % 5 == 0, "chapter").when(F.col("event_id") % 5 == 1, "section").otherwise("article")
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_seq"), F.col("event_id").alias("pos"), kind.alias("kind"), (F.col("event_id") % 97).cast("int").alias("nr"), F.lit("x").alias("name"))
    return prepare.carried_context(e).select("doc_seq", "pos", "nr", "kapitel_nr", "abschnitt_nr")


@query("crawl_statistics", f"WITH {ENTRIES} SELECT count(*) AS total, count(DISTINCT artikel_nr) AS articles, count(DISTINCT kapitel_nr) AS chapters, count(DISTINCT kapitel_name) FILTER (kapitel_name <> 'Unknown') AS sections FROM entries")
def _(spark, sf):
    return prepare.crawl_statistics(entries(spark, sf))


# chunking


@query("fixed_chunks", "SELECT doc_id AS doc_seq, CAST(s // 800 AS INTEGER) AS chunk_seq, substring(text, s + 1, 1000) AS text, CAST(s AS INTEGER) AS start_pos, CAST(s + 1000 AS INTEGER) AS end_pos, CASE WHEN s = 0 THEN 0 ELSE 200 END AS overlap FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents)")
def _(spark, sf):
    return chunking.fixed_size(docs(spark, sf), 1000, 200)


@query("chunk_ids", "SELECT doc_id AS doc_seq, s // 800 AS chunk_seq, 'chunk_' || (row_number() OVER (ORDER BY doc_id, s) - 1) AS chunk_id FROM (SELECT doc_id, unnest(range(0, length(text), 800)) AS s FROM documents)")
def _(spark, sf):
    return chunking.with_global_ids(chunking.fixed_size(docs(spark, sf), 1000, 200)).select("doc_seq", F.col("chunk_seq").cast("long").alias("chunk_seq"), "chunk_id")


@query("chunk_stats", "SELECT lang, count(*) AS n, min(len) AS lo, max(len) AS hi, round(avg(len), 6) AS mean FROM (SELECT lang, length(substring(text, s + 1, 1500)) AS len FROM (SELECT lang, text, unnest(range(0, length(text), 1275)) AS s FROM documents)) GROUP BY lang")
def _(spark, sf):
    d = docs(spark, sf)
    c = chunking.fixed_size(d, 1500, 225).withColumn("n", F.length("text").cast("long"))
    return c.join(d.select("doc_seq", "lang"), "doc_seq").groupBy("lang").agg(F.count("*").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 6).alias("mean"))


@query("semantic_chunks")
def _(spark, sf):
    return chunking.semantic(docs(spark, sf), 500, 1500, "\n")


@query("recursive_chunks")
def _(spark, sf):
    return chunking.recursive(docs(spark, sf), 1000, 150)


# vectors and retrieval


def q_and_c(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), e.select(F.col("vec_id").alias("chunk_seq"), F.col("embedding").alias("vec"))


VECTORS = "q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS chunk_seq, CAST(embedding AS DOUBLE[]) AS cv FROM embeddings)"


def top_sql(threshold: float, k: int) -> str:
    return f"WITH {VECTORS}, s AS (SELECT q_id, chunk_seq, round(list_cosine_similarity(qv, cv), 6) AS score FROM q, c), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_seq DESC) AS INTEGER) AS rank FROM s WHERE score >= {threshold}) SELECT * FROM r WHERE rank <= {k}"


@query("dim_check", "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return V.dimension_histogram(table(spark, sf, "embeddings"), "embedding").withColumn("dims", F.col("dims").cast("long"))


@query("index_info", "SELECT count(*) AS chunks_indexed, max(len(embedding)) AS embedding_dims, 5 AS top_k, CAST(0.1 AS DOUBLE) AS similarity_threshold FROM embeddings")
def _(spark, sf):
    return R.index_info(q_and_c(spark, sf)[1], 5, 0.1).withColumn("embedding_dims", F.col("embedding_dims").cast("long"))


@query("vector_topk", top_sql(-2, 5))
def _(spark, sf):
    return R.top_hits(*q_and_c(spark, sf), 5, threshold=-2.0, digits=6)


@query("vector_topk_threshold", top_sql(0.3, 7))
def _(spark, sf):
    return R.top_hits(*q_and_c(spark, sf), 7, threshold=0.3, digits=6)


@query("clustered_topk", top_sql(-2, 5))
def _(spark, sf):
    """The rows of a full pass, from an index in clusters that is read in part."""
    q, c = q_and_c(spark, sf)
    folder = f"{shared_dir(spark)}/tables/clusters-{uuid.uuid4().hex}"
    remove(spark, folder, later=True)
    return ClusterIndex.build(c, folder).top_hits(q, 5, threshold=-2.0, digits=6)[0]


@query("md5_query_vector", "SELECT item_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, round(v[16], 6) AS last, len(v) AS dims FROM (SELECT item_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= 16 THEN CAST(('0x' || substr(md5(text), 2 * i - 1, 2)) AS INTEGER) / 255.0 ELSE 0 END) AS v FROM benchmark)")
def _(spark, sf):
    v = table(spark, sf, "benchmark").select("item_id", V.md5_vector(F.col("text"), 64).alias("v"))
    return v.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"), F.size("v").cast("long").alias("dims"))


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


@query("keyword_jaccard_topk", f"WITH q AS (SELECT item_id AS q_id, list_distinct({ws('lower(text)')}) AS qt FROM benchmark), c AS (SELECT doc_id AS chunk_seq, list_distinct({ws('lower(text)')}) AS ct FROM documents), s AS (SELECT q_id, chunk_seq, len(list_intersect(qt, ct)) AS b, len(qt) AS n, len(ct) AS m FROM q, c), r AS (SELECT q_id, chunk_seq, round(b / (n + m - b), 9) AS keyword_score FROM s WHERE b > 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY keyword_score DESC, chunk_seq DESC) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 5")
def _(spark, sf):
    return R.keyword_top_k(asked(spark, sf), docs(spark, sf).select(F.col("doc_seq").alias("chunk_seq"), "text"), 5, 9)


@query("hybrid_topk", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT item_id AS q_id, list_distinct({ws('lower(text)')}) AS qt, list_transform(range(1, 65), lambda i: CASE WHEN i <= 16 THEN CAST(('0x' || substr(md5(text), 2 * i - 1, 2)) AS INTEGER) / CAST(255 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS qv FROM benchmark),
    c AS (SELECT doc_id AS chunk_seq, list_distinct({ws('lower(text)')}) AS ct, e AS cv FROM documents JOIN v ON vec_id = doc_id),
    s AS (SELECT q_id, chunk_seq, list_cosine_similarity(qv, cv) AS vs, len(list_intersect(qt, ct)) AS b, len(qt) AS n, len(ct) AS m FROM q, c),
    r AS (SELECT q_id, chunk_seq, round(CAST(0.7 AS DOUBLE) * vs + (1 - CAST(0.7 AS DOUBLE)) * (CASE WHEN n = 0 OR m = 0 THEN 0 ELSE CAST(b AS DOUBLE) / (n + m - b) END), 6) AS combined_score FROM s), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY combined_score DESC, chunk_seq DESC) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 5""")
def _(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_seq").alias("chunk_seq"), "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_seq"), F.col("embedding").alias("vec")), "chunk_seq")
    return R.hybrid_top_k(R.query_vectors(asked(spark, sf), 64), chunks, 5, digits=6).select("q_id", "chunk_seq", "combined_score", "rank")


@query("random_fallback")
def _(spark, sf):
    q, c = q_and_c(spark, sf)
    return R.random_chunks(q.select("q_id"), c.select("chunk_seq"), 3)


# context and answers


def ranked_chunks(spark, sf):
    """The document's chunks of 1000 characters as hits of the question of the same number."""
    c = chunking.fixed_size(docs(spark, sf), 1000, 0)
    return c.select(F.col("doc_seq").alias("q_id"), (F.col("chunk_seq") + 1).alias("rank"), "text")


BUDGET = """c AS (SELECT doc_id AS q_id, s // 1000 + 1 AS rank, substring(text, s + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents)), t AS (SELECT *, length(text) // 4 AS tok FROM c), u AS (SELECT *, sum(tok) OVER (PARTITION BY q_id ORDER BY rank) AS upto FROM t),
    o AS (SELECT *, coalesce(max(CASE WHEN upto > 1100 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ob FROM u),
    k AS (SELECT *, CASE WHEN ob = 1 THEN NULL WHEN upto <= 1100 THEN 'full' WHEN 1100 - (upto - tok) > 50 THEN 'cut' END AS kept FROM o)"""


@query("context_budget", f"""WITH {BUDGET} SELECT q_id, coalesce(string_agg(CASE kept WHEN 'full' THEN text ELSE left(text, CAST((1100 - (upto - tok)) * 4 AS BIGINT)) || '...' END, chr(10) || chr(10) ORDER BY rank) FILTER (kept IS NOT NULL), '') AS context,
    CAST(coalesce(sum(tok) FILTER (kept = 'full'), 0) AS BIGINT) AS tokens_used, count(kept) AS chunks_used, count(*) AS chunks_total, bool_or(ob = 0 AND upto > 1100) AS truncated, round(coalesce(sum(tok) FILTER (kept = 'full'), 0) / 1100, 9) AS context_utilization FROM k GROUP BY q_id""")
def _(spark, sf):
    return context.assemble(ranked_chunks(spark, sf), 1100).drop("chunks").withColumn("context_utilization", F.round("context_utilization", 9))


@query("context_diagnostics", f"WITH {BUDGET}, a AS (SELECT q_id, coalesce(sum(tok) FILTER (kept = 'full'), 0) / 1100 AS u, count(kept) AS used, count(*) AS total, bool_or(ob = 0 AND upto > 1100) AS t FROM k GROUP BY q_id) SELECT round(avg(CAST(t AS DOUBLE)), 6) AS truncation_rate, round(avg(u), 6) AS avg_context_utilization, round(avg(used), 6) AS avg_chunks_used, CAST(sum(greatest(0, total - used)) AS BIGINT) AS total_chunks_wasted FROM a")
def _(spark, sf):
    return rounded(summary.context_diagnostics(context.assemble(ranked_chunks(spark, sf), 1100)))


@query("prompt_assembly", f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN context <> '' THEN context || chr(10) || chr(10) || question ELSE question END AS prompt FROM qa")
def _(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", context.prompt(F.col("context"), F.col("question")).alias("prompt"))


#: Settings of one grid: number, k, threshold, budget, as in _GRID_SETTINGS below.
GRID_SETTINGS = [Setting(n, k, t, b) for n, (k, t, b) in enumerate(((1, 0.0, 4000), (3, 0.0, 500), (5, 0.0, 1100), (5, 0.05, 1100), (7, 0.1, 300), (7, 0.9, 4000)))]
_GRID_SETTINGS = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({s.number}, {s.k}, CAST({s.threshold} AS DOUBLE), {s.budget})" for s in GRID_SETTINGS) + ") AS x(setting, k, threshold, budget))"


@query("grid_retrieval", f"""WITH {_GRID_SETTINGS}, q AS (SELECT item_id AS q_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= 16 THEN CAST(('0x' || substr(md5(text), 2 * i - 1, 2)) AS INTEGER) / CAST(255 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS qv FROM benchmark),
    c AS (SELECT doc_id AS chunk_seq, text, CAST(embedding AS DOUBLE[]) AS cv FROM documents JOIN embeddings ON vec_id = doc_id),
    s AS (SELECT q_id, chunk_seq, text, round(list_cosine_similarity(qv, cv), 6) AS score FROM q, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_seq DESC) AS rank FROM s WHERE score >= 0),
    h AS (SELECT *, length(text) // 4 AS tok FROM r JOIN g ON rank <= k AND score >= threshold),
    u AS (SELECT *, sum(tok) OVER (PARTITION BY q_id, setting ORDER BY rank) AS upto FROM h),
    o AS (SELECT *, coalesce(max(CASE WHEN upto > budget THEN 1 ELSE 0 END) OVER (PARTITION BY q_id, setting ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ob FROM u),
    n AS (SELECT *, CASE WHEN ob = 1 THEN NULL WHEN upto <= budget THEN 'full' WHEN budget - (upto - tok) > 50 THEN 'cut' END AS kept FROM o),
    a AS (SELECT q_id, setting, CAST(coalesce(sum(tok) FILTER (kept = 'full'), 0) AS BIGINT) AS tokens_used, count(kept) AS chunks_used, count(*) AS chunks_total, bool_or(ob = 0 AND upto > budget) AS truncated,
        md5(coalesce(string_agg(CASE kept WHEN 'full' THEN text ELSE left(text, CAST((budget - (upto - tok)) * 4 AS BIGINT)) || '...' END, chr(10) || chr(10) ORDER BY rank) FILTER (kept IS NOT NULL), '')) AS context FROM n GROUP BY q_id, setting)
    SELECT q.q_id, g.setting, tokens_used, chunks_used, chunks_total, truncated, round(tokens_used / budget, 9) AS context_utilization, coalesce(context, md5('')) AS context_md5
    FROM q CROSS JOIN g LEFT JOIN a ON a.q_id = q.q_id AND a.setting = g.setting""")
def _(spark, sf):
    """Contexts of every question under every setting of a grid, from one scoring pass."""
    chunks = docs(spark, sf).select(F.col("doc_seq").alias("chunk_seq"), "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_seq"), F.col("embedding").alias("vec")), "chunk_seq")
    found = grid_contexts(R.query_vectors(asked(spark, sf), 64), chunks, GRID_SETTINGS, digits=6)
    return found.select("q_id", "setting", "tokens_used", "chunks_used", "chunks_total", "truncated", F.round("context_utilization", 9).alias("context_utilization"), F.md5("context").alias("context_md5"))


@query("rag_pipeline")
def _(spark, sf):
    chunks = generate.index(docs(spark, sf), lambda d: chunking.fixed_size(d, 1500, 225))
    q = asked(spark, sf).withColumn("q_vec", V.hashing_embedding(F.col("question")))
    return generate.answer(q, chunks, k=5, budget=1000).select("q_id", "question", "actual", "context", "tokens_used", "chunks_used", "truncated", "context_utilization")


def first_sentence(prompts: list[str]) -> list[str]:
    """Stands in for a service: the prompt's first sentence; a prompt without one is refused."""
    for p in prompts:
        if "." not in p:
            raise ValueError("no sentence")
    return [p.partition(".")[0] for p in prompts]


@query("answers_on_record", """WITH p AS (SELECT doc_id, text, md5(text) AS k FROM documents WHERE text IS NOT NULL), late AS (SELECT k, bool_or(doc_id % 2 = 0) AS early FROM p GROUP BY k)
    SELECT doc_id, CASE WHEN contains(text, '.') THEN string_split(text, '.')[1] END AS answer, CASE WHEN NOT contains(text, '.') THEN 'no sentence' END AS error, CASE WHEN contains(text, '.') THEN 1 WHEN early THEN 4 ELSE 2 END AS tries FROM p JOIN late USING (k)
    UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL""")
def _(spark, sf):
    """Every document's text as a prompt, in two runs over one record: half of the documents, then all. What has an answer is not asked again, what failed is."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    record = Record(spark, f"{shared_dir(spark)}/tables/record-{uuid.uuid4().hex}")
    remove(spark, record.folder, later=True)
    calls = Calls(tries=2, backoff=0.0, per_task=2_000)
    record.ask(rows.where("doc_id % 2 = 0"), "text", lambda: first_sentence, {"model": "first sentence"}, calls=calls)
    found = record.answer(rows, "text", lambda: first_sentence, {"model": "first sentence"}, calls=calls)
    return found.select("doc_id", F.col("reply.value").alias("answer"), "reply.error", "reply.tries")


# indexes that change


@query("versioned_index", "SELECT doc_id * 1048576 + s // 800 AS chunk_seq, 'chunk_' || doc_id || '_' || (s // 800) AS chunk_id, doc_id AS doc_seq, s // 800 AS place, substring(text, s + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents)")
def _(spark, sf):
    """An older state of the documents (a third with other texts, a seventh missing, some since deleted) is indexed, then today's: the index is that of a fresh build."""
    now = docs(spark, sf).select("doc_seq", "text")
    old = now.where("doc_seq % 7 <> 0").withColumn("text", F.when(F.col("doc_seq") % 3 == 0, F.reverse("text")).otherwise(F.col("text")))
    old = old.unionByName(now.where("doc_seq % 5 = 0").withColumn("doc_seq", -1 - F.col("doc_seq")))
    index = VersionedIndex(spark, f"{shared_dir(spark)}/tables/index-{uuid.uuid4().hex}", lambda d: chunking.fixed_size(d, 1000, 200))
    remove(spark, index.folder, later=True)
    index.write(old)
    index.write(now, whole=True)
    return index.chunks()


@query("index_changes", """SELECT doc_id AS doc_seq, CASE WHEN doc_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 3 = 0 AND text <> reverse(text))
    UNION ALL SELECT -1 - doc_id, 'removed' FROM documents WHERE doc_id % 5 = 0""")
def _(spark, sf):
    now = docs(spark, sf).select("doc_seq", "text")
    old = now.where("doc_seq % 7 <> 0").withColumn("text", F.when(F.col("doc_seq") % 3 == 0, F.reverse("text")).otherwise(F.col("text")))
    gone = now.where("doc_seq % 5 = 0").withColumn("doc_seq", -1 - F.col("doc_seq"))
    index = VersionedIndex(spark, f"{shared_dir(spark)}/tables/index-{uuid.uuid4().hex}", lambda d: chunking.fixed_size(d, 1000, 200))
    remove(spark, index.folder, later=True)
    index.write(old.unionByName(gone))
    index.write(now.where("doc_seq % 7 = 0 or doc_seq % 3 = 0"), gone.select("doc_seq"))
    return index.changes(1, 2)


# preparation


PREFIX = f"""{ENTRIES}, p AS (SELECT * REPLACE (string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10))[1] AS text) FROM entries), n AS (SELECT *, lag(artikel_nr, 1, 0) OVER o AS a0, lag(absatz_nr, 1, 0) OVER o AS p0, lag(unterabsatz_nr, 1, 0) OVER o AS u0 FROM p WHERE text <> '' WINDOW o AS (ORDER BY doc_seq)),
    x AS (SELECT *, CASE WHEN artikel_nr > a0 THEN 'Art. ' || artikel_nr || ' ' || artikel_name || ':' || chr(10) || chr(10) ELSE '' END || CASE WHEN unterabsatz_nr > (CASE WHEN artikel_nr > a0 THEN 0 ELSE u0 END) THEN '(' || chr(96 + unterabsatz_nr) || ') ' WHEN absatz_nr > (CASE WHEN artikel_nr > a0 THEN 0 ELSE p0 END) THEN 'Abs. ' || absatz_nr || ' ' ELSE '' END AS label FROM n)"""


@query("prefix_state", f"WITH {PREFIX} SELECT doc_seq, label FROM x")
def _(spark, sf):
    return prepare.prefixed(entries(spark, sf)).select("doc_seq", "label")


@query("group_by_article", f"WITH {PREFIX} SELECT 'kap_' || kapitel_nr || '_abs_' || abschnitt_nr || '_art_' || artikel_nr AS id, min(doc_seq) AS doc_seq, string_agg(label || text, chr(10) || chr(10) ORDER BY doc_seq) AS text, arg_min(artikel_name, doc_seq) AS artikel_name, count(*) AS n_rows, true AS grouped FROM x GROUP BY 1")
def _(spark, sf):
    return prepare.by_article(entries(spark, sf))


@query("qa_templates", f"""WITH {ENTRIES}, t AS (SELECT *, list_filter({sqlist(T.TOPICS)}, lambda k: contains(lower(text), lower(k)))[1:2] AS tp FROM entries), a AS (SELECT doc_seq, id, unnest(list_concat(['Was besagt DSGVO Artikel ' || artikel_nr || '?'], list_transform(tp, lambda k: 'Was sagt DSGVO Artikel ' || artikel_nr || ' über ' || k || '?'), ['Was sind die wichtigsten Anforderungen in DSGVO Kapitel ' || kapitel_nr || '?'])) AS question, unnest(range(len(tp) + 2)) AS pos FROM t),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_seq, pos) - 1 AS qa_seq FROM a) SELECT qa_seq, id || '_qa_' || qa_seq AS id, question, id AS document_id FROM n""")
def _(spark, sf):
    return prepare.template_questions(entries(spark, sf)).select("qa_seq", "id", "question", "document_id")


@query("article_context", f"WITH {ENTRIES}, c AS (SELECT artikel_nr, string_agg(text, ' ' ORDER BY doc_seq) AS article_context FROM entries GROUP BY 1) SELECT doc_seq, artikel_nr, md5(article_context) AS context_md5 FROM entries JOIN c USING (artikel_nr)")
def _(spark, sf):
    e = entries(spark, sf)
    return e.select("doc_seq", "artikel_nr").join(prepare.article_texts(e).select("artikel_nr", F.md5("article_context").alias("context_md5")), "artikel_nr", "left")


@query("qa_summary", f"WITH {ENTRIES} SELECT count(*) AS total_qa_pairs, count(DISTINCT artikel_nr) AS articles_covered, array_to_string(list_sort(list(DISTINCT artikel_nr)), ',') AS articles, round(avg(length(text)), 6) AS avg_answer_length, CAST(1 AS DOUBLE) AS context_coverage FROM entries")
def _(spark, sf):
    qa = prepare.article_context(entries(spark, sf)).withColumnRenamed("text", "ground_truth")
    return rounded(prepare.dataset_summary(qa).withColumn("articles", F.array_join("articles_list", ",")).drop("articles_list"))


@query("question_types", "SELECT coalesce(role, 'unknown') AS question_type, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, sf):
    return prepare.type_counts(table(spark, sf, "conversations").withColumnRenamed("role", "question_type"))


@query("answerable", f"WITH {ENTRIES} SELECT doc_seq FROM entries WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10")
def _(spark, sf):
    return prepare.answerable(entries(spark, sf)).select("doc_seq")


@query("validated", "SELECT event_id FROM events WHERE regexp_matches(CASE WHEN event_id % 3 = 0 THEN 'INVALID' WHEN event_id % 3 = 1 THEN 'valid.' ELSE 'VALID' END, '(?i)\\bVALID\\b')")
def _(spark, sf):
    verdict = F.when(F.col("event_id") % 3 == 0, "INVALID").when(F.col("event_id") % 3 == 1, "valid.").otherwise("VALID")
    return prepare.validated(table(spark, sf, "events").select("event_id", verdict.alias("verdict"))).select("event_id")


class RuleWriter:
    """Stand-in for a model that writes questions: the article's number decides. One reply in eleven is no JSON."""

    def __call__(self, prompts: list[str]) -> list[str]:
        numbers = [int(re.search(r"article (\d+) \(", p)[1]) for p in prompts]
        reply = lambda n: json.dumps({"question": f"Frage {n}?", "question_type": prepare.QUESTION_TYPES[n % 7], "difficulty": prepare.DIFFICULTIES[n % 3], "is_answerable": n % 4 != 0, "reasoning": "x"})
        return ["none" if n % 11 == 0 else reply(n) for n in numbers]


@query("model_questions", f"""WITH {ENTRIES}, a AS (SELECT * FROM entries WHERE length({stripped('text')}) >= 10 AND artikel_nr % 11 <> 0 AND artikel_nr % 4 <> 0), n AS (SELECT *, row_number() OVER (ORDER BY doc_seq) - 1 AS qa_seq FROM a)
    SELECT qa_seq, 'dsgvo_llm_' || qa_seq AS id, 'Frage ' || artikel_nr || '?' AS question, {sqlist(list(prepare.QUESTION_TYPES))}[CAST(artikel_nr % 7 + 1 AS INTEGER)] AS question_type, {sqlist(list(prepare.DIFFICULTIES))}[CAST(artikel_nr % 3 + 1 AS INTEGER)] AS difficulty, id AS document_id FROM n""")
def _(spark, sf):
    return prepare.model_questions(entries(spark, sf), RuleWriter).select("qa_seq", "id", "question", "question_type", "difficulty", "document_id")


class RuleJudge:
    """Stand-in for a model that checks pairs: questions on chapters are valid."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return ["VALID, it fits." if "Kapitel" in re.search(r'Question: "(.*?)"\n', p)[1] else "INVALID" for p in prompts]


@query("checked_questions", f"""WITH {ENTRIES}, t AS (SELECT *, list_filter({sqlist(T.TOPICS)}, lambda k: contains(lower(text), lower(k)))[1:2] AS tp FROM entries), s AS (SELECT doc_seq, id, kapitel_nr, len(tp) + 2 AS n FROM t),
    n AS (SELECT *, sum(n) OVER (ORDER BY doc_seq) - 1 AS qa_seq FROM s) SELECT CAST(qa_seq AS BIGINT) AS qa_seq, 'Was sind die wichtigsten Anforderungen in DSGVO Kapitel ' || kapitel_nr || '?' AS question FROM n""")
def _(spark, sf):
    return prepare.checked_questions(prepare.template_questions(entries(spark, sf)).withColumn("article_context", F.lit("")), RuleJudge).select("qa_seq", "question")


@query("sample_qa")
def _(spark, sf):
    return prepare.seeded_sample(prepare.template_questions(entries(spark, sf)), 100).select("place", "qa_seq", "id", "question")


# metrics


@query("word_overlap", f"WITH {ANSWERS}, s AS (SELECT conv_id, turn, {w('expected')} AS e, {w('actual')} AS a FROM qa) SELECT conv_id, turn, round(coalesce(len(list_intersect(e, a)) / nullif(len(a), 0), 0), 9) AS word_precision, round(coalesce(len(list_intersect(e, a)) / nullif(len(e), 0), 0), 9) AS word_recall FROM s")
def _(spark, sf):
    return rounded(answers(spark, sf).select("conv_id", "turn", M.word_precision(F.col("expected"), F.col("actual")).alias("word_precision"), M.word_recall(F.col("expected"), F.col("actual")).alias("word_recall")), 9)


_STEMS = "list_distinct(regexp_extract_all(array_to_string(list_transform({}, lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, '(ing|ed|er|est|ly|s)$', '') ELSE x END), ' '), '([\\p{{L}}\\p{{N}}_]+)', 1))"


@query("stem_jaccard", f"WITH {ANSWERS}, s AS (SELECT conv_id, turn, {_STEMS.format(ws('lower(expected)'))} AS e, {_STEMS.format(ws('lower(actual)'))} AS a FROM qa) SELECT conv_id, turn, round(CASE WHEN len(e) = 0 OR len(a) = 0 THEN 0 ELSE len(list_intersect(e, a)) / (len(e) + len(a) - len(list_intersect(e, a))) END, 9) AS semantic_similarity FROM s")
def _(spark, sf):
    return rounded(answers(spark, sf).select("conv_id", "turn", M.stem_similarity(F.col("expected"), F.col("actual")).alias("semantic_similarity")), 9)


@query("sequence_similarity")
def _(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", M.sequence_similarity("expected", "actual").alias("sequence_similarity"))


@query("combined_prf")
def _(spark, sf):
    return M.combined(answers(spark, sf)).select("conv_id", "turn", "precision", "recall", "f1")


@query("timing_metrics", f"WITH {ANSWERS}, s AS (SELECT conv_id, turn, actual, {ws('actual')} AS t, CAST(turn % 4 AS DOUBLE) AS sec FROM qa) SELECT conv_id, turn, length(actual) AS response_length, length(actual) // 4 AS estimated_tokens, len(t) AS word_count, round(coalesce(list_sum(list_transform(t, lambda x: length(x))) / nullif(len(t), 0), 0), 9) AS avg_word_length, round(CASE WHEN sec > 0 THEN (length(actual) // 4) / sec ELSE 0 END, 9) AS tokens_per_second FROM s")
def _(spark, sf):
    a = answers(spark, sf)
    return rounded(a.select("conv_id", "turn", *(c.alias(n) for n, c in M.timing(F.col("actual"), (F.col("turn") % 4).cast("double")).items())), 9)


GROUND = f"""{ANSWERS}, s AS (SELECT *, {w('question')} AS q, {w('actual')} AS a, {w('context')} AS c, list_transform(range(0, length(context), 1000), lambda i: substring(context, i + 1, 1000)) AS ch FROM qa),
    g AS (SELECT conv_id, turn, len(ch) AS n, least(1, coalesce(len(list_intersect(a, c)) / nullif(len(a), 0), 0) * CASE WHEN length(actual) < 200 THEN CAST(1.2 AS DOUBLE) ELSE 1 END) AS f,
    least(1, CASE WHEN len(q) = 0 OR len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / (len(q) + len(a) - len(list_intersect(q, a))) END * CASE WHEN length(actual) > 100 THEN CAST(1.1 AS DOUBLE) ELSE 1 END) AS r,
    coalesce(list_sum(list_transform(ch, lambda x: len(list_intersect(q, list_distinct(regexp_extract_all(lower(x), '([\\p{{L}}\\p{{N}}_]+)', 1)))) / len(q))) / nullif(len(ch), 0), 0) AS x,
    least(1, coalesce(len(list_intersect(a, c)) / nullif(len(c), 0), 0) * CASE WHEN length(actual) < CAST(0.1 AS DOUBLE) * length(context) THEN CAST(0.8 AS DOUBLE) ELSE 1 END) AS u FROM s)"""


def grounded(spark, sf):
    a = answers(spark, sf)
    starts = F.when(F.length("context") > 0, F.sequence(F.lit(0), F.length("context") - 1, F.lit(1000))).otherwise(F.array().cast("array<int>"))
    return M.grounding(a.withColumn("chunks", F.transform(starts, lambda i: F.substr("context", i + 1, F.lit(1000)))))


for _name, _column, _short in (("faithfulness", "faithfulness", "f"), ("answer_relevance", "answer_relevance", "r"), ("context_relevance", "context_relevance", "x"), ("context_utilization", "ragas_context_utilization", "u")):
    query(_name, f"WITH {GROUND} SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE {_short} END, 6) AS {_column} FROM g")(lambda spark, sf, c=_column: rounded(grounded(spark, sf).select("conv_id", "turn", c)))


@query("rag_score", f"WITH {GROUND} SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE CAST(0.5 AS DOUBLE) * f + CAST(0.3 AS DOUBLE) * r + CAST(0.2 AS DOUBLE) * x END, 6) AS score FROM g")
def _(spark, sf):
    return rounded(grounded(spark, sf).select("conv_id", "turn", "score"))


@query("eval_summary", f"WITH {GROUND}, z AS (SELECT CASE WHEN n = 0 THEN 0 ELSE f END AS f, CASE WHEN n = 0 THEN 0 ELSE r END AS r, CASE WHEN n = 0 THEN 0 ELSE x END AS x FROM g) SELECT round(avg(f), 6) AS avg_faithfulness, round(min(f), 6) AS min_faithfulness, round(max(f), 6) AS max_faithfulness, round(avg(r), 6) AS avg_answer_relevance, round(min(r), 6) AS min_answer_relevance, round(max(r), 6) AS max_answer_relevance, round(avg(x), 6) AS avg_context_relevance, round(min(x), 6) AS min_context_relevance, round(max(x), 6) AS max_context_relevance, count(*) AS qa_pairs_evaluated FROM z")
def _(spark, sf):
    return summary.summarise(grounded(spark, sf).drop("score"), 6)


# aggregations, pivots, rankings


@query("grouped_stats", f"WITH {OUTCOMES} SELECT chunking_type, top_k, {STATS} FROM runs GROUP BY ALL")
def _(spark, sf):
    return outcomes(spark, sf).groupBy("chunking_type", "top_k").agg(*analysis.statistics(["avg_f1", "avg_dsgvo_score"], 6))


@query("grouping_sets", f"WITH {OUTCOMES} SELECT llm_model, chunking_type, chunk_size, top_k, similarity_threshold, CAST(grouping_id(chunk_size, chunking_type, llm_model, similarity_threshold, top_k) AS BIGINT) AS grouping_id, {STATS} FROM runs GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(g) + ')' for g in analysis.GROUPINGS)})")
def _(spark, sf):
    return analysis.all_groupings(outcomes(spark, sf), analysis.GROUPINGS, analysis.METRICS, 6)


@query("pivot_heatmap", f"WITH {OUTCOMES} SELECT top_k, round(avg(avg_f1) FILTER (llm_model = 'A'), 6) AS A, round(avg(avg_f1) FILTER (llm_model = 'N'), 6) AS N, round(avg(avg_f1) FILTER (llm_model = 'R'), 6) AS R FROM runs GROUP BY 1")
def _(spark, sf):
    return rounded(analysis.heatmap(outcomes(spark, sf), "top_k", "llm_model", "avg_f1", ["A", "N", "R"]))


@query("combo_topn", f"WITH {OUTCOMES} SELECT concat_ws('-', CASE chunking_type WHEN 'fixedsize' THEN 'fs' ELSE 'rec' END, chunk_size, 'k' || top_k, 's' || lpad(CAST(CAST(round_even(similarity_threshold * 100, 0) AS INTEGER) AS VARCHAR), 2, '0'), llm_model) AS combo, round(avg(avg_f1), 6) AS mean FROM runs GROUP BY 1 ORDER BY avg(avg_f1) DESC, combo LIMIT 30")
def _(spark, sf):
    df = outcomes(spark, sf)
    return rounded(analysis.top_combinations(df, analysis.combination(df), "avg_f1", 30))


@query("nlargest_rank", "SELECT o_orderkey AS seq, o_totalprice AS m FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3)")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("m"))
    return analysis.n_best(o, "m").unionByName(analysis.n_best(o, "m", smallest=True))


@query("best_by_metric", "SELECT (SELECT l_shipmode FROM (SELECT l_orderkey * 10 + l_linenumber AS l_shipmode, l_discount, l_orderkey, l_linenumber FROM lineitem) ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber LIMIT 1) AS avg_f1, (SELECT l_orderkey * 10 + l_linenumber FROM lineitem ORDER BY l_quantity, l_orderkey * 10 + l_linenumber LIMIT 1) AS query_time")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), F.col("l_discount").alias("avg_f1"), F.col("l_quantity").alias("query_time"))
    return analysis.best_by(li.withColumn("seq", F.col("name")), ["avg_f1", "query_time"])


@query("table_sort", f"WITH {OUTCOMES}, g AS (SELECT llm_model, top_k, round(avg(avg_dsgvo_score), 6) AS score FROM runs GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, llm_model, top_k) AS INTEGER) AS pos FROM g")
def _(spark, sf):
    g = outcomes(spark, sf).groupBy("llm_model", "top_k").agg(F.round(F.avg("avg_dsgvo_score"), 6).alias("score"))
    return analysis.positions(g, ["score"], ["llm_model", "top_k"])


@query("numeric_order", "SELECT p_size, coalesce(try_cast(CASE WHEN p_size % 7 = 0 THEN 'variable' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE), CAST('inf' AS DOUBLE)) AS sort_key, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    size = F.when(F.col("p_size") % 7 == 0, "variable").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").groupBy("p_size", T.number_or_inf(size).alias("sort_key")).agg(F.count("*").alias("n"))


@query("nan_max", "SELECT max(CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal END) AS top FROM supplier")
def _(spark, sf):
    v = F.when(F.col("s_suppkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return table(spark, sf, "supplier").select(v.alias("v")).agg(analysis.nan_max("v").alias("top"))


@query("two_metric_series", f"WITH {OUTCOMES} SELECT top_k, round(avg(avg_f1), 6) AS avg_f1, round(avg(avg_dsgvo_score), 6) AS avg_dsgvo_score FROM runs GROUP BY 1")
def _(spark, sf):
    return analysis.series(outcomes(spark, sf), "top_k", ["avg_f1", "avg_dsgvo_score"])


@query("union_rows", "SELECT n_name AS name, n_nationkey AS k, NULL::VARCHAR AS error FROM nation UNION ALL SELECT r_name, NULL, 'failed' FROM region")
def _(spark, sf):
    good = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    return experiments.all_results(good, table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("failed").alias("error")))


_GRID = "g AS (SELECT t AS chunking_type, s AS chunk_size, k AS top_k, h AS similarity_threshold, least(s - 1, CAST(round_even(s * 0.15, 0) AS INTEGER)) AS chunk_overlap FROM (SELECT t, s FROM (SELECT unnest(['fixedsize', 'recursive']) AS t), (SELECT unnest([1200, 1800, 2000]) AS s) UNION ALL SELECT 'semantic', NULL), (SELECT unnest([3, 5, 7]) AS k), (SELECT unnest([CAST(0 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS h))"


def grid(spark):
    return experiments.grid_frame(spark, ["fixedsize", "recursive", "semantic"], [1200, 1800, 2000], [3, 5, 7], [0.0, 0.1])


@query("param_grid", f"WITH {_GRID} SELECT * FROM g")
def _(spark, sf):
    return grid(spark)


@query("skip_existing_antijoin", f"WITH {_GRID}, n AS (SELECT chunking_type || '_' || top_k AS run_name, chunk_size FROM g) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'recursive_' || n_regionkey AS d FROM nation) WHERE d = run_name)")
def _(spark, sf):
    g = grid(spark).select(F.concat_ws("_", "chunking_type", F.col("top_k").cast("string")).alias("run_name"), "chunk_size")
    return experiments.still_to_run(g, table(spark, sf, "nation").select(F.concat(F.lit("recursive_"), F.col("n_regionkey").cast("string")).alias("run_name")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
