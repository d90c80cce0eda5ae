"""Operators against their methods: planted random strings, a real compiled character map, repeated query ids, offsets in the text as it is, the toxicity score by hand."""

import hashlib
import math
import random
import re
import string

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import exact_search, pieces, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def prose(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}


def test_planted_random_strings(prose):
    """Precision and recall on random strings of several alphabets among prose, compounds, identifiers and digests."""
    tokens = secret_scan.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, found, total, wrong = random.Random(3), {}, {}, 0
    kinds = {"letters": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digits and letters": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    clean = ["donaudampfschifffahrtsgesellschaft", "internationalization", "getElementByIdentifierName", "section-twelve-of-the-agreement", "550e8400-e29b-41d4-a716-446655440000", hashlib.sha1(b"x").hexdigest().upper(), "2024-01-31_12-00-00-000", "AntidisestablishmentarianismIsAWord", "build/release_candidate/configuration=default"]
    for text in sorted(prose.values(), key=len)[100:400]:
        for kind, letters in kinds.items():
            word = "".join(rng.choices(letters, k=rng.randrange(24, 41)))
            whole = f"{text} {word} {rng.choice(clean)} "
            spans = [s for s in secret_scan.scan(whole, tokens) if s[2] == "random"]
            total[kind] = total.get(kind, 0) + 1
            hit = any(a <= len(text) + 1 and b >= len(text) + 1 + len(word) for a, b, _ in spans)
            found[kind] = found.get(kind, 0) + hit
            wrong += len(spans) - hit
    recall = {k: found[k] / total[k] for k in kinds}
    assert all(r > 0.94 for r in recall.values()) and recall["digits and letters"] > 0.99, recall
    assert sum(found.values()) / (sum(found.values()) + wrong) > 0.99, wrong
    judge = lambda s: secret_scan.looks_random(s, tokens)
    assert judge("qZxVbNmKjHgFdSaPoIuYtReWqLk") and judge("prefix-qZxVbNmKjHgFdSaPoIuYtReWqLk-suffix") and judge("key=mzqwpxkvjtbrhgnfdlsycu")
    assert not any(map(judge, clean))


def test_random_spans_of_documents(prose):
    """Prose has no random spans of letters; what is reported there has digits, or is no word."""
    tokens = secret_scan.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = [t[a:b] for t in prose.values() for a, b, k in secret_scan.scan(t, tokens) if k == "random" and t[a:b].isalpha()]
    assert len(letters) <= 0.001 * len(prose), letters[:5]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_walk_through_a_compiled_map(rule):
    """The longest-prefix walk over the library's own compiled maps gives the library's normalisation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=False)
    spec = proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    assert len(spec.precompiled_charsmap) > 100_000
    charmap, rng = pieces.CharMap(spec.precompiled_charsmap), random.Random(2)
    letters = "aZ é é ﬁ ① Å ㎏ ｱﾞ カ゛ ㍿ ΐ 　  ½ Ⅷ ß İ 한 각 ​﻿ 😀 \t\n ẛ̣ ﷺ"
    for _ in range(400):
        text = "".join(rng.choice(letters) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(1, 30)))
        got, places = pieces.normalise(text, charmap, dummy_prefix=False, drop_extra_spaces=False)
        assert got == library.normalize(text), text
        assert len(places) == len(got) + 1 and (np.diff(places) >= 0).all() and places[-1] <= len(text.encode())
    # every character of "ﬁ" comes from the bytes of "ﬁ"
    got, places = pieces.normalise("xﬁy", charmap, dummy_prefix=True, drop_extra_spaces=False)
    assert got == "▁xfiy" and places.tolist() == [0, 0, 1, 1, 4, 5]


def test_piece_spans(spark):
    texts = ["", None, "hello wörld", "  two  spaces\nline", "日本 😀 x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    lists = {r["doc_id"]: r for r in pieces.encode(docs, path).collect()}
    for r in pieces.encode_digests(docs, path).collect():
        own = lists[r["doc_id"]]
        spans = np.array([own["begins"], own["ends"]]).T.astype("<i4")
        assert r["spans_sha256"] == hashlib.sha256(spans.tobytes()).hexdigest()
        data = (texts[r["doc_id"]] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(own["begins"], own["ends"], strict=True)) == data


def test_query_ids_with_several_vectors(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 120, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(260)] + [(50, [0.5, 0.5, 0.5, 0.5])] * 2 + [(100, None), (None, [1.0, 1.0, 1.0, 1.0]), (0, [float("nan"), 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "query": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select query_id, rank, vec_id, score from ({queries.oracle_sql()['op6_exact_top_k']})").fetchall()
    got = queries.queries()["op6_exact_top_k"](spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)
    n = sum(r[0] == 50 for r in want)
    assert n == 5 * 3  # two vectors, and the repeated one once
    cut = exact_search.top_k(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), F.col("vec_id") % 50 == 0, block=2)
    assert sorted(map(tuple, cut.collect())) == sorted(want)


def by_hand(text, model):
    """Forward-backward over the words of one text in plain Python, and the document's score."""
    words = toxicity.words_of(text.lower())
    e = [model.potential(w) for w in words]
    forward, backward = [], [(1.0, 1.0)] * len(e)
    for k, x in enumerate(e):
        a = (model.start[0], model.start[1] * x) if k == 0 else tuple(sum(forward[-1][i] * model.move[i][j] for i in (0, 1)) * (x if j else 1.0) for j in (0, 1))
        forward.append((a[0] / sum(a), a[1] / sum(a)))
    for k in range(len(e) - 2, -1, -1):
        b = tuple(sum(model.move[i][j] * (e[k + 1] if j else 1.0) * backward[k + 1][j] for j in (0, 1)) for i in (0, 1))
        backward[k] = (b[0] / sum(b), b[1] / sum(b))
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
    some = 1 - math.exp(sum(math.log1p(-min(x, 1 - 1e-9)) for x in p))
    x = [1.0, some, math.log1p(sum(p)), math.sqrt(sum(p) / max(1, len(p)))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.logistic, strict=True)))))), p


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def test_toxicity_score_by_hand(spark, prose, fitted):
    own = dict(sorted(prose.items(), key=lambda x: len(x[1]))[:250])
    rows = spark.createDataFrame([*own.items(), (-1, ""), (-2, None)], "doc_id long, text string")
    for r in toxicity.score(rows, fitted).collect():
        text = own.get(r["doc_id"], "")
        want, p = by_hand(text, fitted)
        assert r["score"] == pytest.approx(want, abs=1e-6)
        places = list(toxicity.places_of(text.lower()))
        hot = [places[k] for k, x in enumerate(p) if x >= toxicity.SPAN + 1e-6]
        assert set(hot) <= set(zip(r["starts"], r["ends"], strict=True))


def test_toxicity_offsets_in_the_text_as_it_is(spark, fitted):
    word = max((w for w in fitted.words if re.fullmatch(r"[a-z]{4,}", w)), key=fitted.words.get)
    text = f"İİ İstanbul {word.upper()} İ {word} {word}. İ"
    r = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), fitted).first()
    spans = [text[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)]
    assert [s for s in spans if s.lower() == word] == [word.upper(), word, word]
    row = queries.queries()["op10_toxicity"](spark, "/root/testdata/sf0.001").where("n_spans > 0").limit(5).collect()
    assert all(len(x["spans"].split(",")) == x["n_spans"] for x in row)
