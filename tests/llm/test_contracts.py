"""The registered queries against their contracts, and awkward rows: empty tables, clashing names, repeated and null ids, several blocks."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import decontaminate, exact_search, langid, language_model, near_dedup, pieces, queries, secret_scan, sharding, token_counts, toxicity
from lodestrata.llm.common import id_bucket

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Name and type of the contract's columns.
CONTRACT = {
    "op3_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op4_sentencepiece": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op5_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op6_exact_top_k": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op7_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op8_secret_scans": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op9_language_model": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op10_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def found():
    return queries.queries()


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def rows(spark, found):
    """Rows of a registered query by document, run once."""
    kept = {}

    def get(name):
        if name not in kept:
            df = found[name](spark, SF)
            assert [f"{c}:{t}" for c, t in df.dtypes][: len(CONTRACT[name].split())] == CONTRACT[name].split()
            kept[name] = df.collect()
        return kept[name]

    return get


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_decontamination_query(spark, rows, texts):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in rows("op3_decontamination")}
    assert got.keys() == texts.keys()
    for key in sorted(texts, key=lambda k: len(texts[k] or ""))[:60]:
        n, hit, own = decontaminate.brute_force(texts[key], items)
        assert tuple(got[key])[:6] == (key, n, hit, len(own), sha(",".join(own)), hit > 0 and 20 * hit >= n)


def test_piece_and_token_queries(rows, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library, fast = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows("op4_sentencepiece"):
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    for r in rows("op7_token_counts"):
        text = texts[r["doc_id"]] or ""
        n = len(fast.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_secret_query(rows, texts):
    for r in rows("op8_secret_scans"):
        text = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]
        assert r["base_sha256"] == sha(",".join(base)) and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r["spans"].split(",")) | {""} or not base


def test_language_query(spark, rows, texts):
    """Labels by plain counting and the full recursion, without any of the operator's short cuts."""
    labelled = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["lang"] is not None and crc(r["doc_id"], 5)]
    langs = sorted({r["lang"] for r in labelled})
    model = langid.fit(langid.training_rows(spark.read.parquet(f"{SF}/documents.parquet"), id_bucket("doc_id", 5)))
    assert model.langs == langs
    seen = Counter()
    for r in labelled:
        for w in langid.WORD.findall(r["text"].lower()):
            if any(c.isalpha() for c in w):
                parts = [w[k : k + langid.PIECE] for k in range(0, len(w), langid.PIECE)]
                seen.update((r["lang"], int(b)) for p in parts for b in langid.trigrams([p])[0])
    total = {x: sum(n for (y, _), n in seen.items() if y == x) + langid.SMOOTH * langid.BUCKETS for x in langs}
    log = lambda x, b: math.log((seen[x, b] + langid.SMOOTH) / total[x])
    got = {r["doc_id"]: r for r in rows("op5_language_id")}
    assert all(r["held_out"] == (crc(k, 5) == 0) and 0 <= r["score"] <= 1 and r["lang_pred"] in [*langs, "und"] for k, r in got.items())
    for key in sorted((k for k, t in texts.items() if t), key=lambda k: len(texts[k]))[:40]:
        words = [w for w in langid.WORD.findall(texts[key].lower()) if any(c.isalpha() for c in w)]
        if not words:
            assert got[key]["lang_pred"] == "und"
            continue
        scores = []
        for w in words:
            own = [sum(log(x, int(b)) for p in [w[k : k + langid.PIECE] for k in range(0, len(w), langid.PIECE)] for b in langid.trigrams([p])[0]) for x in langs]
            allowed = model.allowed[langid.word_script(w)]
            own = [s if ok else min(own) - langid.SWITCH for s, ok in zip(own, allowed, strict=True)]
            scores.append([s - max(own) for s in own])
        value, back = [0.0] * len(langs), []
        for s in scores:
            step = [max((v - (langid.SWITCH if j != k else 0), -j) for j, v in enumerate(value)) for k in range(len(langs))]
            back.append([-j for _, j in step])
            value = [v + x for (v, _), x in zip(step, s, strict=True)]
        at, path = max(range(len(langs)), key=lambda k: value[k]), []
        for b in reversed(back):
            path.append(at)
            at = b[at]
        letters = Counter()
        for w, k in zip(words, reversed(path), strict=True):
            letters[langs[k]] += len(w)
        assert letters[got[key]["lang_pred"]] == max(letters.values())


def test_top_k_query_against_sql(spark, rows):
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    want = con.execute(f"select query_id, rank, vec_id, score from ({queries.oracle_sql()['op6_exact_top_k']})").fetchall()
    assert sorted(tuple(r)[:4] for r in rows("op6_exact_top_k")) == sorted(want)
    placed = sorted(tuple(r) for r in queries.op1_sharding(spark, SF).select("doc_id", "slot", "shard").collect())
    assert placed == sorted(con.execute(f"select doc_id, slot, shard from ({queries.oracle_sql()['op1_sharding']})").fetchall())


def test_language_model_query(rows, texts):
    """Counts and base score by plain counting; the network must beat the base by one part in a hundred on the held-out documents."""
    tokens = {k: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None] for k, t in texts.items()}
    seen = Counter(w for k, own in tokens.items() if crc(k, 10) for w in own)
    total = sum(seen.values())
    mass = total + 0.1 * (len(seen) + 1)
    got = rows("op9_language_model")
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 10) == 0, len(own), sum(seen[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / mass) for w in own), rel=1e-9)
    held = [r for r in got if r["held_out"]]
    score, base = sum(r["score"] for r in held), sum(r["base_score"] for r in held)
    assert base < 0 and score < 0 and score > 0.995 * base


def test_score_by_hand():
    """A document's log-likelihood, one word at a time, in plain floats."""
    rng = np.random.default_rng(3)
    net = language_model.Network((rng.normal(size=language_model.Network.size()) * 0.3).astype(np.float32))
    w, n = {k: v.astype(float) for k, v in net.w.items()}, language_model.HIDDEN
    docs = [rng.integers(0, 4096, size).astype(np.int32) for size in (1, 5, 70, 2, 33)]
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    want = []
    for doc in docs:
        h, total = np.zeros(n), 0.0
        for x, y in zip([1, *doc[:-1]], doc, strict=True):
            xw, hw = w["E"][x] @ w["Wx"] + w["b"], h @ w["Wh"]
            z, r = sig(xw[:n] + hw[:n]), sig(xw[n : 2 * n] + hw[n : 2 * n])
            c = np.tanh(xw[2 * n :] + r * hw[2 * n :])
            h = z * h + (1 - z) * c
            own, place = divmod(int(y), language_model.CLASSES)
            total += math.log10(soft(h @ w["Wc"] + w["bc"])[own]) + math.log10(soft(h @ w["Wo"][own] + w["bo"][own])[place])
        want.append(total)
    assert np.allclose(language_model.score_shard(net, docs), want, rtol=1e-4)
    net.w["bc"][:] *= 500  # large outputs take another way
    w["bc"] = w["bc"] * 500
    assert np.isfinite(language_model.score_shard(net, docs)).all()


def test_toxicity_query(spark, found):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in found["op10_toxicity"](spark, sf).collect()}
    assert [f"{c}:{t}" for c, t in found["op10_toxicity"](spark, sf).dtypes][:4] == CONTRACT["op10_toxicity"].split()
    assert all(r["held_out"] == (crc(k, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for k, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    for kind, least in ((0, 0.95), (1, 0.45)):
        own = [r for r in labels if r["toxic"] == kind]
        assert sum(got[r["doc_id"]]["predicted"] == kind for r in own) >= least * len(own) > 0


def test_toxicity_of_long_runs(spark):
    """Words of 200 characters, and runs without spaces: what stands after the fortieth character counts."""
    rng = random.Random(8)
    run = lambda n: "".join(rng.choice("あいうえおかきくけこ") for _ in range(n))
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        text = run(60) + ("毒毒汚物" if bad else "") + run(60) if k % 2 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(20)) + " " + "q" * 150 + ("scumbag" if bad else "") + "q" * 40
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels, id_bucket("doc_id", 3) != 1)).collect()}
    for odd in (0, 1):
        held = [(k % 3 == 0, got[k]["score"]) for k in range(600) if crc(k, 3) == 1 and k % 2 == odd]
        assert min(s for bad, s in held if bad) > max(s for bad, s in held if not bad)
    word = "x" * 55 + "scumbag" + "x" * 100
    parts = toxicity.words_of(f"a {word} b")
    assert [a for a in parts if "scumbag" in a] and parts[0] == "a" and parts[-1] == "b" and max(map(len, parts)) == toxicity.PIECE
    assert [f"a {word} b"[s:e] for s, e in toxicity.places_of(f"a {word} b")] == parts
    for n in range(36, 140):
        own = toxicity.words_of("".join(chr(0x3041 + k % 80) for k in range(n)))
        text = "".join(chr(0x3041 + k % 80) for k in range(n))
        assert all(any(text[k : k + 6] in p for p in own) for k in range(n - 5))


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "bad word " * 20 if k % 2 else "good word " * 20) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), max_rows=10, max_chars=500)
    assert model.logistic is not None


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    model = language_model.fit(language_model.training_rows(docs))
    frames = [
        sharding.place(docs, "doc_id", ["a", "b"], 7), near_dedup.classes(docs), near_dedup.keep_firsts(docs), pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model")),
        langid.identify(docs, langid.fit(docs)), token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), secret_scan.find_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        language_model.score(docs, *model), toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))),
        exact_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0),
    ]
    assert [df.count() for df in frames] == [0] * len(frames)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sharding_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", 9), (None, "c", "d", 8)], "doc_id long, Slot string, shard string, other int")
    got = sharding.place(df, "doc_id", ["x", "y"], 7)
    assert sorted(got.columns) == ["doc_id", "other", "shard", "slot"] and got.where("shard in (0, 1) and slot between 0 and 6").count() == 2
    by_key = sharding.place(df, "shard", ["x", "y"], 7)
    assert by_key.dtypes.count(("shard", "int")) == 1 and by_key.count() == 2


@pytest.mark.parametrize("block", [exact_search.BLOCK, 8])
def test_top_k_blocks(spark, block):
    """Three or more blocks of queries, ties, repeated candidates and a repeated query."""
    rng = random.Random(1)
    rows = [(k, [float(rng.randint(-1, 1)) for _ in range(3)]) for k in range(200)] + [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (50, [1.0, 0.0, 0.0])]
    rows = [r for r in rows if r[0] != 50 or r == (50, [1.0, 0.0, 0.0])] + [(50, [1.0, 0.0, 0.0])]
    got = {}
    for r in exact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 10 == 0, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(k, [math.floor(256 * x) for x in v]) for k, v in rows]
    for q, v in {k: v for k, v in whole if k % 10 == 0}.items():
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in whole if k != q)[:5]
        assert sorted(got[q]) == [(rank, k, -s) for rank, (s, k) in enumerate(want, 1)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [3e9, 1.0]), (50, [2e9, 5.0])]
    got = sorted(tuple(r) for r in exact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    for q in (0, 50):
        held = lambda s: max(-exact_search.SCORES, min(exact_search.SCORES, s))
        want = sorted((-held(sum(a * b for a, b in zip(whole[q], w, strict=True))), k) for k, w in whole.items() if k != q)
        assert [r for r in got if r[0] == q] == [(q, rank, k, -s) for rank, (s, k) in enumerate(want, 1)]


def test_near_dedup_large_shuffle_and_plain(spark, monkeypatch):
    """Texts that come to the ids instead of ids that go to the texts; and a pair that only plain Jaccard links: a text that repeats lines often."""
    words = [f"w{k}" for k in range(104)]
    text, repeated = " ".join(words), " ".join([*words, *(words[:24] * 20)])
    docs = spark.createDataFrame([(1, text), (2, repeated), (3, "something else entirely here now"), (4, text), (None, text)], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "MAX_IDS", 0)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    kept = near_dedup.keep_firsts(docs.withColumn("row", F.lit(5)))
    assert sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(1, 5), (3, 5)]


def test_pipeline_judges_rows_apart(spark, tmp_path, texts):
    """Rows that share an id, or have none, go by their own text: their secrets are masked, their copies leave, their languages count."""
    good = [t for t in texts.values() if t and 600 < len(t) < 1500 and "secret" not in t.lower() and "key" not in t.lower()][:4]
    secret = "password=abcdefghijklmnop"
    rows = [(1, f"{good[0]} {secret} end", "en", "s", 0), (1, f"{secret} start {good[1]}", "en", "s", 0), (None, f"{good[2]} {secret}", "en", "s", 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0), (2, f"{good[3]} {good[0]} {good[1]}", "en", "s", 0)]
    extra = spark.createDataFrame(rows, DOC)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(extra).withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == names
        own = now.where("doc_id is null or doc_id < 1000")
        if name == "language id":
            assert own.count() == 4 and own.where("text is null or text = ''").count() == 0
    left = [(r["doc_id"], r["text"], r["n_chars"]) for r in own.collect()]
    assert left and all(secret not in t for _, t, _ in left)
    assert all(n == len(t) for _, t, n in left if "[ASSIGN]" in t) and {(d, "[ASSIGN]" in t) for d, t, _ in left} <= {(1, True), (None, True), (2, False)}
    assert sum("[ASSIGN]" in t for _, t, _ in left) >= 2


def test_mixed_document_stays(spark, texts):
    """A clean text in three languages, none with half of the letters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 500 and 2000").orderBy("doc_id").collect()}
    mixed = "\n".join(by[x][:450] for x in sorted(by)[:4])
    frame = spark.createDataFrame([(1, mixed), (2, "..."), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.keep_identified(frame, model, 0.5).collect()] == [1]
    assert langid.word_script("abcдежз") == "cyrillic" and langid.word_script("éа") == "latin"


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 4])
def test_remove_contaminated(spark, max_words):
    bench = spark.createDataFrame([(1, "red fox runs home"), (2, "blue whale dives deep"), (None, "green frog sits still")], "item_id int, text string")
    rows = [(7, "red fox runs home"), (7, "a clean text"), (None, "nothing here"), (None, "a green frog sits still"), (None, None), (9, "red fox runs home " + "x " * 200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("row", F.lit("kept"))
    got = decontaminate.remove_contaminated(docs, bench, max_words=max_words)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["row"]) for r in got.collect()), key=str) == sorted(((d, t, "kept") for d, t in (rows[1], rows[2], rows[4], rows[5])), key=str)
