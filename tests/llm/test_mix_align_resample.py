"""Mixing, alignment and resampling against SQL, the tokenizers' libraries and plain Python, on awkward rows as well."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import alignment, importance, mixing, queries
from lodestrata.llm.order import distinct_rows, running, spread

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def odd_rows():
    rng = random.Random(5)
    words = ["the", "Ärger", "x1", "data.", "of", "été", "😀", " ", "a b"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, some(rng.randrange(1, 90)), "en", rng.choice(["s", "S", "z", None, "é"]), 1) for k in range(60)]
    rows += [(100, None, None, "s", 0), (101, "", None, "none but empty", 0), (102, " \n\t ", None, None, 0), (103, "x" * 5000 + " " + some(6000), "en", "s", 1)]
    rows += [(104, "same text of a copy " * 9, "en", "S", 1)] * 7 + [(None, "no id " * 30, "en", "z", 1)] * 3 + [(None, None, None, None, 0), (None, "another text without an id " * 8, "en", "z", 1)]
    rows += [(105, some(40), "en", "s", 1), (105, some(50), "en", "é", 1), (106, "a▁b and\u0000 nul", "en", "s", 1), (107, "<|endoftext|> <s> </s> <0x41>", "en", "s", 1), (108, "  two  spaces \n and ends ", "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward documents with columns named like outputs, and a benchmark with a null text."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"size": F.lit(3), "part": F.lit(0), "rank": F.lit(1), "n_a": F.lit(1), "taken": F.lit("x")}).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "data. of the Data"), (2, None), (3, "x1 the of the")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_mixing", "op13_importance_resampling"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert len(want) == len(odd_rows())


@pytest.mark.parametrize("name", ["op11_mixing", "op12_alignment", "op13_importance_resampling"])
def test_empty_table(spark, tmp_path, name):
    for table, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(50), rng.randrange(9)) for _ in range(200)]
    df = distinct_rows(spark.createDataFrame(rows, "g string, c int, o int, v int")).withColumn("vc", F.col("v") * F.col("copies"))
    got = sorted((r["g"], r["c"], r["o"], r["v"], r["before"] + r["copy"] * r["v"]) for r in spread(running(df, ["g"], "c", ["o", "v"], "vc", "before")).collect())
    want, total = [], Counter()
    for g, c, o, v in sorted(rows):
        want.append((g, c, o, v, total[g]))
        total[g] += v
    assert got == sorted(want)
    assert spread(spark.createDataFrame([(1, 200_000)], "k int, copies long")).agg(F.count("*"), F.max("copy"), F.count_distinct("copy")).first() == (200_000, 199_999, 200_000)


def filled(sizes, weights):
    """Targets by sharing and sharing again."""
    want, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        heavy = sum(weights[s] for s in free)
        for s in free:
            want[s] += left * weights[s] / heavy
        left = sum(max(0.0, want[s] - 2 * sizes[s]) for s in free)
        over = {s for s in free if want[s] >= 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return want


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 10, rng.randrange(1, 100_000)]) for k in range(n)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = filled(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes))})
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.Mixture(docs, block=64)
    stream = mix.stream().collect()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    sources = {r["source"]: r for r in mix.sources.collect()}
    taken, slots = Counter(), defaultdict(set)
    for r in stream:
        assert 0 <= r["from_word"] < r["from_word"] + r["n_words"] <= sizes[r["doc_id"]]
        taken[r["source"]] += r["n_words"]
        slots[r["time"]].add((r["source"], r["round"]))
    assert all(len(x) == 1 for x in slots.values())
    assert all(s["target"] - 1 < taken[name] <= s["target"] for name, s in sources.items())
    # every stretch of the schedule holds the sources in proportion
    order = [next(iter(slots[t]))[0] for t in sorted(slots)]
    total = Counter(order)
    for n in range(50, len(order), 50):
        assert all(abs(k - n * total[s] / len(order)) < 2 + math.log2(len(order)) for s, k in Counter(order[:n]).items())
    # no word is taken twice in a round
    seen = set()
    for r in stream:
        own = {(r["source"], r["round"], r["begin"] + r["from_word"] + k) for k in range(r["n_words"])}
        assert not own & seen
        seen |= own
    again = {(r["doc_id"], r["taken"]) for r in mixing.Mixture(docs.repartition(5), block=64).taken().collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in mix.taken().collect()}


def test_mixing_is_native(spark):
    plan = mixing.Mixture(spark.read.parquet(f"{SF}/documents.parquet")).taken()._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_words(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", " \n", "a", " a\x0bb\x1f c\u00a0d ", "x\r\ny")], "t string")
    assert [r[0] for r in rows.select(mixing.words(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 2]


# ---- alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in enumerate(alignment.byte_letters())}

    def encode(text):
        """Tokens of both sides as (id, bytes), none where they are not the text's bytes."""
        if not text:
            return [], []
        own = a.encode(" " + text, add_special_tokens=False)
        left = [(k, bytes(back[c] for c in a.id_to_token(k))) for k in own.ids]
        right = [(k, bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
        data = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == data == b"".join(x for _, x in right) else ([], [])

    return encode


def sweep_by_hand(texts, encode):
    """Links by comparing all ranges of a group, one text at a time; counts over all texts."""
    found, count = [], Counter()
    for text in texts:
        left, right = encode(text)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() if side else [] for side in (left, right)]
        common, groups, links = sorted(set(ends[0]) & set(ends[1])), [], []
        i = j = 0
        for stop in common:
            i2, j2 = ends[0].index(stop) + 1, ends[1].index(stop) + 1
            groups.append(",".join(str(k) for k, _ in left[i:i2]) + "|" + ",".join(str(k) for k, _ in right[j:j2]))
            for x in range(i, i2):
                for y in range(j, j2):
                    if ends[0][x] - len(left[x][1]) < ends[1][y] and ends[1][y] - len(right[y][1]) < ends[0][x]:
                        links.append((left[x][0], right[y][0]))
            i, j = i2, j2
        count.update(set(links))
        found.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest) for na, nb, ng, links, digest in found], count


def test_alignment_by_hand(spark, folder, libraries):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    want, count = sweep_by_hand([t for _, t in texts], libraries)
    got = queries.op12_alignment(spark, folder)
    assert got.dtypes == alignment.ALIGNED
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, *w)) for (k, _), w in zip(texts, want, strict=True))
    cut = alignment.align(rows, A, B, window=7)  # many rows for each text
    assert sorted(map(str, map(tuple, cut.collect()))) == sorted(map(str, map(tuple, got.collect())))
    pairs = {(r["a"], r["b"]): r["count"] for r in alignment.counted_pairs(rows, A, B).collect()}
    assert pairs == dict(count)


def test_alignment_of_documents(spark, libraries):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, _ = sweep_by_hand(list(texts.values()), libraries)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_alignment(spark, SF).collect()}
    assert got == dict(zip(texts, want, strict=True))
    assert sum(w[3] for w in want) > 100_000 and sum(w[0] == 0 for w in want) < len(want) / 2


def test_machine_keeps_only_the_open_group(monkeypatch, libraries):
    """A text in small windows, worked on after every few tokens, gives what the whole text gives."""
    monkeypatch.setattr(alignment, "ROUND", 10)
    text = "Donaudampfschifffahrt 12345678 naïve ééé \n\n x " * 40
    left, right = libraries(text)
    pack, events = pa.Codec("zstd", 1), []
    for side, own in enumerate((left, right)):
        ids, ends = np.array([k for k, _ in own], np.uint16), np.concatenate([[0], np.cumsum([len(x) for _, x in own])])
        for at in range(0, len(ids), 5):
            part = ids[at : at + 5].tobytes()
            events.append((1, int(ends[at]), side, len(part).to_bytes(4, "little") + pack.compress(part, asbytes=True)))
    machine, most, done = alignment.Machine(alignment.tokenizers(A, B).sizes), 0, []
    for row, _, side, packed in sorted(events, key=lambda e: e[:3]):
        done += machine.read(row, side, 9, packed)
        most = max(most, sum(len(x) for w in machine.open[-1].wait for x in w))
    done += machine.step(last=True)
    want, _ = sweep_by_hand([text], libraries)
    (d,) = done
    assert (*d.n.tolist(), d.digest.hexdigest()) == (*want[0][:4], want[0][6]) and most < 120 < len(left)
    assert int(d.merge()[1].sum()) == want[0][3]


# ---- resampling


def grams(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("block", [1, 40, 300, 10_000])
def test_features_in_blocks(block):
    rng = random.Random(block)
    texts = [r[1] for r in odd_rows()] + ["x" * 700 + " y " + "é" * 300 + "  ", "..." * 300 + "a", "b" + "." * 500, "A1 a1"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"]).slice(1)
    words, got = Counter(), defaultdict(Counter)
    for _, found, rows in importance.features(iter([batch]), 10_000, block):
        for k, n in enumerate(found.words.tolist()):
            words[int(rows[k])] += n
        for b, k in zip(found.bucket.tolist(), found.owner.tolist(), strict=True):
            got[int(rows[k])][b] += 1
    for k, text in enumerate(texts[1:]):
        own, all_grams = grams(text)
        assert words[k] == len(own) and got[k] == Counter(zlib.crc32(g.encode()) % 10_000 for g in all_grams), (k, text and text[:40])
    assert rng is not None


def test_resampling_by_hand(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = Counter(zlib.crc32(g.encode()) % 10_000 for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for g in grams(r["text"])[1])
    source = Counter(zlib.crc32(g.encode()) % 10_000 for _, t in docs for g in grams(t)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    want = []
    for key, text in docs:
        words, own = grams(text)
        gain = sum(math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in (zlib.crc32(g.encode()) % 10_000 for g in own))
        weight = gain // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], -1 if w[0] is None else w[0], w[1], w[2]))
    draw = 25 * len(able) // 100
    expected = [(*w[:4], k + 1 if k < draw else None) for k, w in enumerate(able)] + [(*w[:4], None) for w in want if w[4] < 20]
    got = importance.resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(map(str, expected)) == sorted(map(str, map(tuple, got.collect())))
    with pytest.raises(ValueError):
        importance.resample(got, got, buckets=0)
