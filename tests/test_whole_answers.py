"""The answer metrics take the whole document as the expected answer."""

import difflib
import re

import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {}
    for (conv, turn), r in turns.items():
        reply = turns.get((conv, turn + 1))
        if r["role"] == "user" and reply and reply["role"] == "assistant":
            found[conv, turn] = (texts.get(conv) or "", reply["text"])
    assert any(len(e) > 400 for e, _ in found.values())
    return found


def rows(spark, name):
    return {(r["conv_id"], r["turn"]): r for r in catalog.queries()[name](spark, SF).collect()}


def stems(text):
    return re.findall(r"\w+", " ".join(re.sub(r"(ing|ed|er|est|ly|s)$", "", w) if len(w) > 3 else w for w in text.lower().split()))


def test_word_measures(spark, pairs):
    overlap, jaccard = rows(spark, "word_overlap"), rows(spark, "stem_jaccard")
    assert overlap.keys() == jaccard.keys() == pairs.keys()
    for key, (expected, actual) in pairs.items():
        e, a = set(re.findall(r"\w+", expected.lower())), set(re.findall(r"\w+", actual.lower()))
        assert overlap[key]["word_precision"] == pytest.approx(len(e & a) / len(a) if a else 0, abs=1e-8)
        assert overlap[key]["word_recall"] == pytest.approx(len(e & a) / len(e) if e else 0, abs=1e-8)
        e, a = set(stems(expected)), set(stems(actual))
        assert jaccard[key]["semantic_similarity"] == pytest.approx(len(e & a) / len(e | a) if e and a else 0, abs=1e-8)


def test_sequence_and_combined(spark, pairs):
    sequence, combined, overlap, jaccard = (rows(spark, n) for n in ("sequence_similarity", "combined_prf", "word_overlap", "stem_jaccard"))
    assert sequence.keys() == combined.keys() == pairs.keys()
    for key, (expected, actual) in pairs.items():
        ratio = difflib.SequenceMatcher(None, expected.lower(), actual.lower()).ratio()
        assert sequence[key]["sequence_similarity"] == pytest.approx(ratio)
        rest = 0.3 * ratio + 0.3 * jaccard[key]["semantic_similarity"] if expected and actual else 0
        assert combined[key]["recall"] == pytest.approx(0.4 * overlap[key]["word_recall"] + rest, abs=1e-7)
