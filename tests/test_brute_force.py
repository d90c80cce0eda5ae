"""Registered queries without a SQL twin against plain Python over the same small tables."""

import html as entities
import random
import re
import zlib

import numpy as np
import pytest

from lodestrata import catalog
from lodestrata.functions import text as T
from lodestrata.operators import chunking

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    found = catalog.queries()[name](spark, SF)
    return sorted(tuple(r) for r in found.select(*(columns or found.columns)).collect())


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def opened(html):
    """(tag, tags around it, text) of every element, in the order of their start tags. An end tag closes the nearest open element of its name."""
    html = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>", "", html, flags=re.S)
    html = re.sub(r"<(script|style)\b.*?</\1>", "", html, flags=re.S)
    out, stack = [], []
    for part in re.split(r"(<[^>]+>)", html):
        tag = re.match(r"<(/?)(\w+)", part)
        if not tag:
            for k in stack:
                out[k][2].append(entities.unescape(part))
        elif tag[1]:
            names = [out[k][0] for k in stack]
            if tag[2] in names:
                del stack[len(names) - 1 - names[::-1].index(tag[2]) :]
        else:
            out.append((tag[2], tuple(out[k][0] for k in stack), []))
            if tag[2] not in ("br", "meta", "img", "hr", "link"):
                stack.append(len(out) - 1)
    return [(tag, around, "".join(text).strip()) for tag, around, text in out]


def test_html_elements(spark, pages):
    want = []
    for page, html in pages.items():
        found = [(tag, text) for tag, _, text in opened(html) if re.fullmatch(r"h[1-6]|p|li", tag)]
        want += [(page, k, tag, text) for k, (tag, text) in enumerate(found) if text]
    got = rows(spark, "html_elements", "doc_seq", "pos", "tag", "text")
    assert got == sorted(want) and len(got) > 100


def test_act_walk(spark, pages):
    """The state machine, row by row."""
    want = []
    for page, html in pages.items():
        section = subsection = article = title = ""
        # the walk goes through div and article elements only
        own = [(tag, text) for tag, around, text in opened(html) if re.fullmatch(r"h[1-6]|p", tag) and text and "body" in around and {"div", "article"}.issuperset(around[around.index("body") + 1 :])]
        for pos, (tag, text) in enumerate(own):
            if tag != "p":
                if re.match(r"(artikel\s+\d+|article\s+\d+|art\.\s*\d+|art\s+\d+)", text, re.I):
                    known = re.match(r"(?:artikel\s+|article\s+|art\.\s*|art\s+)(\d+)(?:[:\s]+(.+)|\s*$)", text, re.I)
                    article, title = (known[1], known[2] or "") if known else (article, title)
                elif re.match(r"(kapitel|chapter|abschnitt|section)\s+\d+", text, re.I):
                    section, subsection = text, ""
                elif re.match(r"(unterabschnitt|subsection|teil|part)\s+\d+", text, re.I):
                    subsection = text
            elif len(text) > 10:
                if (a := re.search(r"Artikel\s+(\d+)", text, re.I)) and a[1] != article:
                    named = re.search(r"Artikel\s+\d+[:\s]+(.+)", text, re.I)
                    article, title = a[1], named[1].strip() if named else ""
                chapter = re.search(r"KAPITEL\s+(\d+)", text, re.I)
                new = text if "KAPITEL" in text and not re.search(r"KAPITEL\s+\d+", text) else f"KAPITEL {chapter[1]}" if chapter else section
                if new != section:
                    section, subsection = new, ""
                if part := re.search(r"ABSCHNITT\s+(\d+)", text, re.I):
                    subsection = f"ABSCHNITT {part[1]}"
                if not any(k in text.lower() for k in T.NAVIGATION_ACT):
                    number, letter = re.search(r"\((\d+)\)", text), re.search(r"\(([a-z])\)", text, re.I)
                    want.append((page, pos, *((x or "Unknown") for x in (section, subsection, article, title)), int(number[1]) if number else 0, ord(letter[1].lower()) - 96 if letter else 0, text))
    assert rows(spark, "act_walk") == sorted(want) and want


def test_sup_sentences(spark, pages):
    want = []
    for page, html in pages.items():
        marked = html.replace("<li>", "<sup>1</sup>")
        if "<sup>" in marked:
            found = [(int(n), re.sub(r"<[^>]+>", "", t).strip()) for n, t in re.findall(r"<sup[^>]*>\s*(\d+)\s*</sup>(.*?)(?=<sup[^>]*>\s*\d+\s*</sup>|\Z)", marked, re.S)]
        else:
            found = [(1, re.sub(r"<[^>]+>", "", marked).strip())]
        want += [(page, k, n, t) for k, (n, t) in enumerate(x for x in found if x[1])]
    assert rows(spark, "sup_sentences", "page_id", "pos", "nr", "text") == sorted(want)


def test_digit_sentences(spark, texts):
    want = []
    for doc, text in texts.items():
        found = re.findall(r"([0-9]+)([^0-9]+?)(?=[0-9]+|\Z)", text, re.S)
        found = [(n, t.strip()) for n, t in found] if len(found) > 1 else [("1", text.strip())]
        want += [(doc, k, int(n) if int(n) < 2**31 else None, t) for k, (n, t) in enumerate(found)]
    got = rows(spark, "digit_sentences", "doc_seq", "pos", "nr", "text")
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_semantic_chunks(spark, texts):
    want = []
    for doc, text in texts.items():
        held, out = "", []
        for part in filter(None, (p.strip() for p in text.split("\n"))):
            if held and len(held) + len(part) > 1500:
                out += [held] * (len(held) >= 500)
                held = part
            else:
                held = f"{held}\n\n{part}" if held else part
        out += [held] * (len(held) >= 500)
        want += [(doc, k, t) for k, t in enumerate(out)]
    assert rows(spark, "semantic_chunks", "doc_seq", "chunk_seq", "text") == sorted(want) and want


def test_recursive_chunks(spark, texts):
    got = rows(spark, "recursive_chunks", "doc_seq", "chunk_seq", "text", "chunk_size")
    want = [(doc, k, c.strip(), len(c)) for doc, text in texts.items() for k, c in enumerate(c for c in chunking.split_recursive(text, 1000, 150) if c.strip())]
    assert got == sorted(want)
    assert all(t == t.strip() and t for *_, t, _ in got)
    # nothing is lost: every word of a document is in one of its chunks
    for doc, text in texts.items():
        held = set(" ".join(t for d, _, t, _ in got if d == doc).split())
        assert all(w in held or len(w) > 500 for w in text.split())


def test_random_fallback(spark):
    asked = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["vec_id"] % 20 == 0]
    got = rows(spark, "random_fallback", "q_id", "chunk_seq", "score")
    few = {c for _, c, _ in got}
    assert len(few) == 3 and got == sorted((q, c, 0.0) for q in asked for c in few)


def test_sample_qa(spark):
    from lodestrata.operators import prepare

    every = {r["qa_seq"]: r["id"] for r in prepare.template_questions(catalog.entries(spark, SF)).collect()}
    want = [(place, seq, every[seq]) for place, seq in enumerate(random.Random(42).sample(range(len(every)), 100))]
    assert rows(spark, "sample_qa", "place", "qa_seq", "id") == want


def test_rag_pipeline(spark, texts):
    chunks = [text[k : k + 1500] for _, text in sorted(texts.items()) for k in range(0, len(text), 1275)]

    def vector(text):
        v = np.bincount([zlib.crc32(w.encode()) % 64 for w in re.findall(r"\w+", text.lower())], minlength=64).astype(float)
        return v / np.sqrt(v @ v) if v.any() else v

    table = np.array([vector(c) for c in chunks])
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r["q_id"]: r for r in catalog.queries()["rag_pipeline"](spark, SF).collect()}
    assert got.keys() == asked.keys()
    for q, text in asked.items():
        score = np.round(table @ vector(text), 12)
        best = [int(k) for k in np.lexsort((-np.arange(len(chunks)), -score))[:5] if score[k] >= 0]
        context, used, whole, cut = [], 0, 0, False
        for k in best:
            tokens = len(chunks[k]) // 4
            if used + tokens <= 1000:
                context.append(chunks[k])
                used, whole = used + tokens, whole + 1
            else:
                if 1000 - used > 50:
                    context.append(chunks[k][: (1000 - used) * 4] + "...")
                    whole += 1
                cut = True
                break
        r = got[q]
        assert (r["question"], r["actual"], r["context"]) == (text, chunks[best[0]], "\n\n".join(context))
        assert (r["tokens_used"], r["chunks_used"], r["truncated"]) == (used, whole, cut)
