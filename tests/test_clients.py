"""Model clients, question writing and checking, command lines: with stand-ins for the services, failing ones among them."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.operators import generate, models, prepare
from lodestrata.operators.calls import Calls
from lodestrata.plans import config, experiments
from lodestrata.plans.config import Chunking, Experiment
from lodestrata.sources import sinks
from lodestrata.sources.readers import Dataset

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
FAST = Calls(tries=2, backoff=0.0)
DOCS = [(0, "Die Person hat Rechte. " * 30), (1, "Der Schutz der Daten. " * 30)]
PAIRS = [(0, "Welche Rechte hat die Person?", "Die Person hat Rechte."), (1, "Schutz der Daten?", "Der Schutz.")]
ENTRIES = "doc_seq long, id string, text string, artikel_nr int, artikel_name string, kapitel_nr int"


def post(url, body, headers, timeout):
    """What the services would answer; a prompt that says so fails."""
    assert timeout > 0
    if url.endswith("/embeddings"):
        assert len(body["input"]) <= 2
        if any("fail" in t for t in body["input"]):
            raise TimeoutError("no answer")
        return {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(body["input"])))]}
    prompt = body["prompt"] if "prompt" in body else body["messages"][1]["content"]
    if "fail" in prompt:
        raise TimeoutError("no answer")
    reply = f"{body['model']}: {prompt} "
    return {"response": reply} if "prompt" in body else {"choices": [{"message": {"content": f"{reply}{'json' if 'response_format' in body else ''}"}}]}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_seq long, text string")


@pytest.fixture
def qa(spark):
    return spark.createDataFrame(PAIRS, "qa_seq long, question string, ground_truth string")


def test_services(spark, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert models.bearer(None) == {"Authorization": "Bearer k"} and models.bearer("own") == {"Authorization": "Bearer own"}
    assert models.ChatService("m", post=post)(["a"]) == ["m: a"]
    assert models.ChatService("m", schema={"type": "object"}, post=post)(["a"]) == ["m: a json"]
    assert models.LocalService("l", post=post)(["a", "b"]) == ["l: a", "l: b"]
    rows = spark.createDataFrame([(1, "a"), (2, "please fail")], "k int, p string").repartition(2, "k")
    got = {r["k"]: r["r"] for r in rows.select("k", generate.generate(F.col("p"), lambda: models.LocalService("l", post=post)).alias("r")).collect()}
    assert got[1]["answer"] == "l: a" and got[1]["error"] is None and got[2]["answer"] is None and got[2]["error"] == "no answer"


def test_embedding_service(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "fail", None, "ccc"])], "k int, t string").coalesce(1)
    model = models.EmbeddingService("e", dimensions=2, batch=2, post=post)
    got = {r["k"]: r["v"] for r in rows.select("k", models.embed(F.col("t"), model, compat=True).alias("v")).collect()}
    # a text that fails has the zeros, the texts of its call have not
    assert got == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 1.0], 4: [3.0, 1.0]}
    with pytest.raises(Exception, match="no answer"):
        rows.select(models.embed(F.col("t"), model)).collect()
    assert len(models.HashingEmbedding(8)(["a b"])[0]) == 8


def test_factories():
    assert models.llm({"type": "local", "model_name": "x"}) == models.LocalService("x")
    assert models.llm({"model": "y", "temperature": 0.5, "abbr": "z"}) == models.ChatService("y", 0.5)
    assert models.embedder({"type": "sentence-transformers", "model_name": "m", "device": "cuda"}) == models.LocalEmbedding("m", device="cuda", batch=128)
    assert models.llm({}).info()["provider"] == "openai" and models.embedder({}).info()["dimensions"] == 1536
    for make in (models.llm, models.embedder):
        with pytest.raises(ValueError):
            make({"type": "nope"})
    assert "api_key" not in models.settings_of(models.ChatService(api_key="s")) and "post" not in models.settings_of(models.ChatService())


def test_environment(tmp_path, monkeypatch):
    path = tmp_path / ".env"
    path.write_text("# note\nA='one'\nexport B=two\n\nC=three=3\n")
    monkeypatch.setenv("B", "outer")
    found = models.environment(str(path))
    assert (found["A"], found["B"], found["C"]) == ("one", "outer", "three=3") and models.environment("/nowhere")["B"] == "outer"


class Writer:
    def __call__(self, prompts):
        if any("fail" in p for p in prompts):
            raise TimeoutError("no answer")
        base = {"question": "Was?", "question_type": "rights", "difficulty": "easy", "is_answerable": True, "reasoning": "r"}
        out = []
        for p in prompts:
            if "Reply VALID" in p:
                out.append("INVALID" if "wrong" in p else "VALID")
            elif "odd" in p:
                out.append(json.dumps(base | {"question_type": "unknown"}))
            elif "silent" in p:
                out.append("no json")
            else:
                out.append(json.dumps(base | {"is_answerable": "cannot" not in p}))
        return out


def test_question_writing(spark):
    texts = ["a good long sentence", "it cannot be answered", "an odd type of it", "silent and long enough", "short", "this will fail surely", "another good sentence"]
    entries = spark.createDataFrame([(k, f"d{k}", t, k, "n", 1) for k, t in enumerate(texts)], ENTRIES).coalesce(1)
    qa = prepare.model_questions(entries, Writer, calls=FAST)
    rows = qa.orderBy("qa_seq").collect()
    assert [(r["id"], r["document_id"], r["question"], r["ground_truth"]) for r in rows] == [("dsgvo_llm_0", "d0", "Was?", texts[0]), ("dsgvo_llm_1", "d6", "Was?", texts[6])]
    assert prepare.model_questions(entries, Writer, limit=2, calls=FAST).count() == 1
    pairs = spark.createDataFrame([(0, "q", "right", ""), (1, "q", "wrong", ""), (2, "q", "will fail", "")], "qa_seq long, question string, ground_truth string, article_context string").coalesce(1)
    assert sorted(r["qa_seq"] for r in prepare.checked_questions(pairs, Writer, calls=FAST).collect()) == [0, 2]
    assert prepare.checked_questions(pairs, Writer, compat=True, calls=FAST).count() == 3
    one = prepare.dataset_summary(qa.withColumn("difficulty", F.lit("easy"))).first()
    assert one["question_types"] == {"rights": 2} and one["difficulties"] == {"easy": 2} and one["total_qa_pairs"] == 2


def test_cached_index_and_grid(spark, docs, qa, tmp_path):
    base = Experiment(chunking=Chunking("fixedsize", 200, 30), metrics=("overlap", "timing", "grounding"))
    folder, calls = str(tmp_path / "runs"), models.HashingEmbedding(16)
    two = [base.with_(name="one"), base.with_(name="two")]
    assert experiments.run_missing(docs, qa, two, folder, embedder=calls) == ["one", "two"]
    assert experiments.run_missing(docs, qa, [*two, base.with_(name="three", metrics=("nope",))], folder, embedder=calls) == []
    names = sinks.names_in(spark, folder)
    assert "three_failed.txt" in names and sum("_summary_" in n for n in names) == 2 and len(sinks.names_in(spark, f"{folder}/cache")) == 1
    summary = json.loads((tmp_path / "runs" / next(n for n in names if "one_evaluation_summary" in n)).read_text())
    assert summary["pipeline_info"]["embedding"]["dimensions"] == 16 and summary["pipeline_info"]["dataset"] == {"documents_processed": 2, "grouping_applied": False}
    assert summary["qa_pairs_evaluated"] == 2 and summary["evaluation_info"]["total_metrics"] == 17 and summary["random_seed"] == 42
    at = next(n for n in names if "one_evaluation_results" in n).removeprefix("one_evaluation_results_").removesuffix(".json")
    assert sinks.read_results(spark, folder, "one", at).count() == 2 and sinks.read_results(spark, folder, "one", "never") is None


def test_failing_family_is_left_out(spark):
    from lodestrata.functions import metrics as M

    df = spark.createDataFrame([("a b", "a c")], "expected string, actual string")
    with pytest.warns(UserWarning, match="grounding"):
        got = M.evaluate(df, ["overlap", "grounding"])
    assert "f1" in got.columns and "faithfulness" not in got.columns


def test_family_that_fails_in_a_task_is_left_out(spark, monkeypatch):
    from lodestrata.functions import metrics as M

    broken = lambda df: df.withColumn("bad", F.raise_error(F.concat(F.lit("broken on "), "actual")))
    monkeypatch.setitem(M.FAMILIES, "timing", broken)
    df = spark.createDataFrame([("a b", "a c", 1.0)], "expected string, actual string, seconds double")
    with pytest.warns(UserWarning, match="timing are left out"):
        got = experiments.measured(df, ("timing", "overlap"))
    assert "bad" not in got.columns and got.first()["word_precision"] == 0.5
    with pytest.raises(Exception, match="no rows today"):  # what the metrics stand on is not theirs to leave out
        experiments.measured(df.withColumn("x", F.raise_error(F.lit("no rows today"))), ("overlap",))


def jsonl(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_command_lines(spark, tmp_path, monkeypatch, capsys):
    docs = jsonl(tmp_path / "docs.jsonl", [{"id": f"e{k}", "Text": t * 3, "Artikel_nr": k, "Artikel_Name": "n", "Kapitel_Nr": 1} for k, (_, t) in enumerate(DOCS)])
    settings = tmp_path / "base.json"
    settings.write_text(json.dumps({"chunking": {"type": "fixedsize", "chunk_size": 200, "chunk_overlap": 30}, "evaluation": {"enabled_metrics": ["precision-recall", "ragas"]}}))
    assert config.load(str(settings)).metrics == ("overlap", "grounding")
    monkeypatch.setattr(cli, "build", lambda: spark)
    out = str(tmp_path / "out")
    cli.main(["evaluate", "-c", str(settings), "-d", docs, "-n", "3", "-o", out, "--offline", "--verbose"])
    assert len(sinks.names_in(spark, out)) == 2 and '"qa_pairs_evaluated": 3' in capsys.readouterr().out
    cli.main(["evaluate", "-c", str(settings), "-d", docs, "--offline", "--no-save"])
    cli.main(["compare", "--configs", str(settings), "-d", docs, "-n", "2", "-o", str(tmp_path / "cmp"), "--offline"])
    assert "Successful: 1" in capsys.readouterr().out and len(sinks.names_in(spark, str(tmp_path / "cmp"))) == 3
    cli.main(["compare", "--configs", str(settings), str(settings), "-d", docs, "-n", "2", "-o", str(tmp_path / "grid"), "--offline", "--grid"])
    assert "Successful: 2" in capsys.readouterr().out
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(SystemExit):
        cli.main(["questions", "-d", docs, "-o", out, "--env", "/nowhere"])
    args = cli.parser().parse_args(["questions", "-d", docs, "-o", f"{out}/pairs.jsonl", "--check", "--record", str(tmp_path / "record")])
    assert cli.questions(spark, args, Writer())["total_qa_pairs"] == 2
    assert json.loads((tmp_path / "out" / "pairs_summary.json").read_text())["question_types"] == {"rights": 2}
    own = Dataset(spark, docs, f"{out}/pairs.jsonl")
    assert own.get_documents().count() == 2 and own.get_qa_pairs().count() == 2
    assert Dataset(spark, docs, f"{out}/none.jsonl", grouping=True).get_qa_pairs().count() == 6
