"""Calls that fail alone, the record of outcomes, and what rests on it: prompts, questions, checks, vectors, indexes."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata.operators import chunking, generate, models, prepare
from lodestrata.operators.calls import Calls, Record, outcomes
from lodestrata.sources import sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
FAST = Calls(tries=2, backoff=0.0)


class Counting:
    """Answers in capitals, leaving a file for each input it is asked; some inputs fail, or end the worker."""

    def __init__(self, folder, dead=()):
        self.folder, self.dead = str(folder), dead

    def __call__(self, prompts):
        for p in prompts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(p)
        if any(p in self.dead for p in prompts):
            raise SystemExit(1)
        if any("fail" in p for p in prompts):
            raise TimeoutError("no answer")
        return [p.upper() for p in prompts]


def asked(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_outcomes():
    seen = []

    def model(group):
        seen.append(list(group))
        if "x" in group:
            raise ValueError("bad x")
        return [len(g) for g in group]

    got = outcomes(model, ["a", None, "bb", "x", "ccc", "d", "e"], size=4, calls=Calls(tries=2, backoff=0.0, in_flight=1))
    assert [(o.value, o.error, o.tries) for o in got] == [(1, None, 1), (None, None, 0), (2, None, 1), (None, "bad x", 2), (3, None, 1), (1, None, 1), (1, None, 1)]
    assert seen == [["a", "bb", "x", "ccc"], ["a", "bb"], ["x", "ccc"], ["x"], ["x"], ["ccc"], ["d", "e"]]
    assert outcomes(lambda g: [], ["a"], calls=FAST)[0].error == "0 values for 1 inputs" and outcomes(model, []) == []
    with pytest.raises(ValueError):
        Calls(tries=0)


def test_pauses_and_backoff(monkeypatch):
    from lodestrata.operators import calls as module

    slept = []
    monkeypatch.setattr(module.time, "sleep", slept.append)
    outcomes(lambda g: g, list("abcdefg"), calls=Calls(pause_every=3, pause=2.0))
    assert slept == [2.0, 2.0]
    outcomes(lambda g: 1 / 0, ["a"], calls=Calls(tries=4, backoff=0.5))
    assert slept[2:] == [0.5, 1.0, 2.0]


def test_one_failing_prompt_of_a_batch(spark, tmp_path):
    rows = spark.range(100).coalesce(1).select("id", F.concat(F.lit("prompt "), F.col("id").cast("string"), F.when(F.col("id") == 37, " fail").otherwise("")).alias("p"))
    got = rows.select("id", generate.generate(F.col("p"), lambda: Counting(tmp_path), FAST).alias("r")).collect()
    assert sum(r["r"]["error"] is None and r["r"]["answer"] == f"PROMPT {r['id']}" for r in got) == 99
    bad = next(r["r"] for r in got if r["id"] == 37)
    assert (bad["answer"], bad["error"], bad["tries"]) == (None, "no answer", 2)


def test_checked_pairs_fail_alone(spark):
    pairs = spark.range(50).coalesce(1).selectExpr("id as qa_seq", "'q' as question", "if(id = 7, 'will fail', 'wrong') as ground_truth", "'' as article_context")
    judge = lambda: lambda prompts: ["INVALID"] * len(prompts) if "fail" not in prompts[0] else 1 / 0
    assert [r["qa_seq"] for r in prepare.checked_questions(pairs, judge, calls=FAST).collect()] == [7]


def test_record_is_resumed(spark, tmp_path):
    first, second, folder = tmp_path / "a", tmp_path / "b", f"{tmp_path}/record"
    first.mkdir(), second.mkdir()
    rows = spark.range(40).select("id", F.concat(F.lit("p"), (F.col("id") % 30).cast("string"), F.when(F.col("id") == 4, " fail").otherwise("")).alias("p"))
    record = Record(spark, folder)
    with pytest.raises(Exception, match="."):  # the worker ends half-way
        record.ask(rows, "p", lambda: Counting(first, dead=("p11",)), {"m": 1}, calls=Calls(tries=1, per_task=1))
    done = {r["value"].lower() for r in record.outcomes().where("error is null").collect()}
    assert 0 < len(done) < 30
    got = record.answer(rows, "p", lambda: Counting(second), {"m": 1}, calls=FAST).collect()
    assert not done & set(asked(second)) and len(set(asked(second)) | done) == 31  # 30 prompts and a failing one
    assert len(got) == 40 and all(r["reply"]["value"] == r["p"].upper() for r in got if "fail" not in r["p"])
    assert [r["reply"]["error"] for r in got if "fail" in r["p"]] == ["no answer"]
    # nothing is missing but what failed, which is asked again; other settings are another question
    assert [r["input"] for r in record.missing(rows, "p", {"m": 1}).collect()] == ["p4 fail"]
    assert record.missing(rows, "p", {"m": 2}).count() == 31
    assert record.ask(rows.where("id = 3"), "p", lambda: Counting(second), {"m": 1}) == 0


def test_record_of_awkward_rows(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "x" * 300_000, None), (4, "é\n\u0000", "k"), (4, "é\n\u0000", "k")], "id int, p string, key string")
    got = Record(spark, f"{tmp_path}/r").answer(rows, "p", lambda: Counting(calls), {}, calls=Calls(tasks=2, per_task=1)).collect()
    assert sorted((r["id"], r["key"], r["reply"]["value"] if r["reply"] else None) for r in got if r["id"] != 3) == [(1, "k", None), (2, "k", ""), (4, "k", "É\n\u0000"), (4, "k", "É\n\u0000")]
    assert next(r["reply"]["value"] for r in got if r["id"] == 3) == "X" * 300_000 and len(asked(calls)) == 3
    assert Record(spark, f"{tmp_path}/r2").answer(rows.where("id > 9"), "p", lambda: Counting(calls), {}).count() == 0


def test_answers_and_questions_on_record(spark, tmp_path):
    calls = tmp_path / "c"
    calls.mkdir()
    chunks = spark.createDataFrame([(0, "alpha text", [1.0, 0.0]), (1, "beta text", [0.0, 1.0])], "chunk_seq long, text string, vec array<double>")
    questions = spark.createDataFrame([(k, f"question {k % 3}", [1.0, float(k % 3)]) for k in range(9)], "q_id long, question string, q_vec array<double>")
    record = Record(spark, f"{tmp_path}/r")
    for _ in range(2):
        got = generate.answer(questions, chunks, k=1, make=lambda: Counting(calls), record=record).collect()
        assert len(got) == 9 and all(r["actual"] == r["prompt"].upper() for r in got)
    assert len(asked(calls)) == 3
    entries = spark.createDataFrame([(k, f"d{k}", f"a long sentence {k}", k, "n", 1) for k in range(4)], "doc_seq long, id string, text string, artikel_nr int, artikel_name string, kapitel_nr int")
    assert prepare.model_questions(entries, lambda: Counting(calls), record=record).count() == 0  # no JSON, so no question, but on record
    assert record.outcomes().count() == 7


class Counted(models.HashingEmbedding):
    """The offline model, leaving a file for each text."""

    def __call__(self, texts):
        for t in texts:
            with open(f"{os.environ['COUNTED']}/{uuid.uuid4().hex}", "w") as file:
                file.write(t)
        if any("poison" in t for t in texts):
            raise TimeoutError("no vector today")
        return super().__call__(texts)


def test_vectors_on_record(spark, tmp_path, monkeypatch):
    calls = tmp_path / "c"
    calls.mkdir()
    docs = spark.createDataFrame([(k, f"sentence number {k % 4} of a text. " * 30) for k in range(12)], "doc_seq long, text string")
    record, own = Record(spark, f"{tmp_path}/v", "array<double>"), str(calls)

    class Model(Counted):
        def __call__(self, texts):
            os.environ["COUNTED"] = own
            return super().__call__(texts)

    plain = {}
    for size in (200, 300, 400):
        made = generate.index(docs, lambda d, n=size: chunking.fixed_size(d, n, 20), embedder=Model(16), vectors=record)
        plain[size] = generate.index(docs, lambda d, n=size: chunking.fixed_size(d, n, 20), 16)
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain[size].collect()))
    texts = {r["text"] for df in plain.values() for r in df.collect()}
    assert len(asked(calls)) == len(texts) == len(set(asked(calls)))  # each distinct text once
    bad = spark.createDataFrame([(0, "good"), (1, "poison")], "k int, t string")
    got = {r["k"]: (r["vec"], r["vec_error"]) for r in models.embedded(bad, "t", Model(16), record, FAST).collect()}
    assert got[1] == (None, "no vector today") and len(got[0][0]) == 16 and got[0][1] is None
    cache = sinks.TableCache(spark, f"{tmp_path}/cache")
    broken = spark.createDataFrame([(0, "good"), (1, "poison")], "doc_seq long, text string")
    for given in ({"vectors": record}, {}):
        with pytest.raises(Exception, match="no vector"):
            generate.index(broken, lambda d: chunking.fixed_size(d, 50, 0), embedder=Model(16), cache=cache, **given)
    assert not [n for n, _ in cache.listing() if n.startswith("index")]


def test_fingerprint_and_cache(spark, tmp_path):
    two = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    assert sinks.fingerprint(two("a", "a")) != sinks.fingerprint(two("b", "b")) != sinks.fingerprint(two("b", "a"))
    assert sinks.fingerprint(two("a", "b")) == sinks.fingerprint(two("b", "a").repartition(3)) and sinks.fingerprint(two("a", None)) != sinks.fingerprint(two("a", ""))
    assert sinks.fingerprint(spark.createDataFrame([], "t string")).startswith("0-")
    cache = sinks.TableCache(spark, str(tmp_path))

    def slow():
        # another writer is done first
        assert cache.get("x", {"a": 1}, lambda: two("first")).count() == 1
        return two("second", "second")

    assert [r["t"] for r in cache.get("x", {"a": 1}, slow).collect()] == ["first"]
    assert [n for n, _ in cache.listing()] == [f"x_{sinks.config_hash({'a': 1})}"]
