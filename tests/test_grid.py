"""A grid as columns against separate runs, and the settings files that name its experiments."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import context, models
from lodestrata.operators import retrieval as R
from lodestrata.operators.calls import Calls, Record
from lodestrata.plans import config, experiments, grid
from lodestrata.plans.config import Chunking, Experiment, Retrieval
from lodestrata.plans.grid import Setting


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["Recht", "Daten", "Person", "Schutz", "Artikel", "Pflicht"]
    docs = spark.createDataFrame([(k, " ".join(words[(k * j) % 6] for j in range(1, 120))) for k in range(12)], "doc_seq long, text string").cache()
    qa = spark.createDataFrame([(k, f"{words[k % 6]} {words[(k + 1) % 6]}?", f"Die {words[k % 6]} hat {words[k % 5]}") for k in range(8)] + [(8, "?", "nichts")], "qa_seq long, question string, ground_truth string").cache()
    return docs, qa


def experiment(name, k, threshold, budget=4000, **more):
    return Experiment(name, chunking=Chunking("fixedsize", 150, 20), retrieval=Retrieval("vector-similarity", k, threshold), max_context_length=budget, **more)


ALL = [experiment("a", 1, 0.0), experiment("b", 3, 0.2, 60), experiment("c", 5, 0.6, 200), experiment("again", 5, 0.6, 200), experiment("d", 5, 2.0), experiment("bare", 3, 0.0, include_context=False)]


def plain(row, skip=("seq", "total_evaluation_time", "error")):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items() if k not in skip}


def test_grid_equals_separate_runs(spark, corpus):
    got = {r["name"]: plain(r) for r in grid.run_grid(*corpus, ALL).collect()}
    for e in ALL:
        assert got[e.name] == plain(experiments.run(*corpus, e).first())
    assert got["a"] != got["b"] != got["c"] and {k: v for k, v in got["again"].items() if k != "name"} == {k: v for k, v in got["c"].items() if k != "name"}


def test_hybrid_grid_equals_separate_runs(spark, corpus):
    own = [Experiment(f"h{k}{w}", chunking=Chunking("fixedsize", 150, 20), retrieval=Retrieval("hybrid", k, vector_weight=w, keyword_weight=0.5)) for k in (1, 4) for w in (0.5, 0.0)]
    got = {r["name"]: plain(r) for r in grid.run_grid(*corpus, own).collect()}
    for e in own:
        assert got[e.name] == plain(experiments.run(*corpus, e).first())


def test_one_scoring_pass(spark, corpus):
    chunks = spark.createDataFrame([(k, f"chunk {k} " * 9, [1.0, k / 9]) for k in range(30)], "chunk_seq long, text string, vec array<double>")
    questions = spark.createDataFrame([(k, "q", [1.0, float(k)]) for k in range(3)] + [(9, "none", None)], "q_id long, question string, q_vec array<double>")
    settings = [Setting(0, 3, 0.9, 30), Setting(1, 5, None, 100), Setting(2, 1, 0.99, 4), Setting(3, 20, 0.5, 1000)]
    rows = grid.grid_contexts(questions, chunks, settings)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r["q_id"], r["setting"]): r for r in rows.collect()}
    assert len(got) == 16
    for s in settings:
        alone = {r["q_id"]: r for r in context.assemble(R.vector_top_k(questions, chunks, s.k, s.threshold), s.budget).collect()}
        for q in (0, 1, 2, 9):
            own = got[q, s.number]
            if q in alone:
                assert all(own[c] == alone[q][c] for c in ("context", "chunks", "tokens_used", "chunks_used", "chunks_total", "truncated", "context_utilization"))
            else:
                assert (own["context"], own["chunks"], own["chunks_total"], own["truncated"]) == ("", [], None, None)
    for bad in ([], [Setting(0, 1, 0.0, 1)] * 10_001):
        with pytest.raises(ValueError):
            grid.settings_column(bad)


def test_groups_fail_alone_and_share_calls(spark, corpus, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    folder = str(asked)

    def model(prompts):
        import uuid

        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(p)
        return [p[:50] for p in prompts]

    record, vectors = Record(spark, f"{tmp_path}/answers"), Record(spark, f"{tmp_path}/vectors", "array<double>")
    broken = experiment("broken", 3, 0.0, metrics=("nope",))
    rows = grid.run_grid(*corpus, [*ALL, broken], lambda e: lambda: model, embedder=lambda e: models.HashingEmbedding(16), vectors=vectors, record=record, calls=Calls(tries=1)).collect()
    status = {r["name"]: (r["status"], r["error"]) for r in rows}
    assert status.pop("broken")[0] == "FAILED" and set(status.values()) == {("SUCCESS", None)}
    prompts = [open(p).read() for p in asked.iterdir()]
    assert len(prompts) == len(set(prompts)) < len(ALL) * corpus[1].count()  # equal prompts of several settings are asked once
    again = grid.run_grid(*corpus, ALL, lambda e: lambda: model, embedder=lambda e: models.HashingEmbedding(16), vectors=vectors, record=record)
    assert again.count() == len(ALL) and len(list(asked.iterdir())) == len(prompts)


SETTINGS = """
llm: {type: local, model_name: "qwen3:8b", abbr: q8, temperature: 0.2, max_tokens: 500, endpoint: "http://host:1", api_type: ollama}
embedding:
  type: sentence-transformers
  model_name: all-mpnet-base-v2   # a note
  abbr: mp
  device: cuda
  batch_size: 64
chunking: {type: semantic, separator: "\\n", min_chunk_size: 300, max_chunk_size: 900}
retrieval: {type: hybrid, top_k: 7, similarity_threshold: 0.1, vector_weight: 0.6, keyword_weight: 0.4}
evaluation: {enabled_metrics: [precision-recall, timing, ragas]}
dataset: {path: data/docs.jsonl, evaluation_subset_size: 3, save_qa_pairs: true, grouping: {enabled: true}}
pipeline: {include_context: false, max_context_length: 3500}
"""


def test_every_setting_is_used(tmp_path, monkeypatch):
    from dataclasses import asdict

    path = tmp_path / "lm_own.yaml"
    path.write_text(SETTINGS)
    e = config.load(str(path))
    assert e.name == "lm_own" and e.metrics == ("overlap", "timing", "grounding") and (e.dataset, e.save_qa_pairs, e.include_context, e.max_context_length, e.subset, e.grouping) == ("data/docs.jsonl", True, False, 3500, 3, True)
    assert models.llm(asdict(e.llm)) == models.LocalService("qwen3:8b", 0.2, 500, "http://host:1")
    assert models.embedder(asdict(e.embedding)) == models.LocalEmbedding("all-mpnet-base-v2", 768, "cuda", 64)
    assert (e.retrieval.vector_weight, e.retrieval.keyword_weight, e.chunking.max_chunk_size) == (0.6, 0.4, 900)
    monkeypatch.setenv("OWN_KEY", "secret")
    assert config.from_dict({"llm": {"api_key": "${OWN_KEY}", "timeout": 5, "endpoint": "http://x"}}).llm == config.Model("openai", "unknown", api_key="secret", timeout=5, endpoint="http://x")
    own = models.llm({"model": "m", "api_key": "k", "timeout": 5.0, "endpoint": "e"})
    assert (own.api_key, own.timeout, own.endpoint) == ("k", 5.0, "e") and "k" not in models.settings_of(own).values()
    for bad in ({"llm": {"modle": "x"}}, {"extra": {}}, {"retrieval": {"weights": 1}}, {"dataset": {"grouping": {"on": True}}}, {"llm": {"api_type": "other"}}, {"embedding": {"batch_size": 0}}, {"retrieval": {"type": "hybrid", "vector_weight": -1}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)


def test_own_chunking_retrieval_and_metrics(spark, corpus):
    from lodestrata.functions import metrics as M
    from lodestrata.operators import chunking

    chunking.register("words", lambda docs, size, overlap: docs.select("doc_seq", F.posexplode(F.slice(F.split("text", " "), 1, size)).alias("chunk_seq", "text")))
    R.register("first", lambda q, c, k: c.where(F.col("chunk_seq") < k).crossJoin(q.drop("q_vec")).withColumns({"score": F.lit(1.0), "rank": (F.col("chunk_seq") + 1).cast("int")}).drop("vec"))
    M.register("length", lambda df: df.withColumn("f1", F.length("actual").cast("double")), "Length of the answer", ["f1"])
    try:
        e = Experiment("own", chunking=Chunking("words", 3, 0), retrieval=Retrieval("first", 2), metrics=("length",))
        one, many = experiments.run(*corpus, e).first(), grid.run_grid(*corpus, [e]).first()
        assert one["avg_f1"] == many["avg_f1"] == 5.0 and one["avg_chunks_used"] == 2.0  # the first word of all is "Recht"
        assert M.evaluation_info(["length"])["total_metrics"] == 1
        for again in (lambda: chunking.register("words", None), lambda: R.register("first", None), lambda: M.register("length", None, "", [])):
            with pytest.raises(ValueError):
                again()
    finally:
        chunking.CHUNKERS.pop("words"), R.METHODS.pop("first"), M.FAMILIES.pop("length"), M.INFO.pop("length")


def test_intermediate_tables_go_with_a_run(spark, corpus):
    from lodestrata.sources.sinks import names_in
    from lodestrata.sources.tables import materialise, scope, shared_dir

    folder = f"{shared_dir(spark)}/tables"
    materialise(spark, corpus[1], "stays")
    before = names_in(spark, folder)
    experiments.run(*corpus, ALL[0])
    assert grid.run_grid(*corpus, ALL[:2]).count() == 2
    with pytest.raises(ValueError, match="own"), scope(spark):
        materialise(spark, corpus[1], "goes")
        raise ValueError("own")
    assert names_in(spark, folder) == before and any(n.startswith("stays") for n in before)


def test_local_service_is_reachable():
    s = models.LocalService(endpoint="http://h")
    asked = []
    assert s.reachable(lambda url, t: asked.append((url, t)) or 200) and asked == [("http://h/api/tags", 5.0)] and not s.reachable(lambda u, t: 500)
    assert not models.LocalService(endpoint="http://127.0.0.1:9").reachable()


def test_vectors_of_any_length():
    call = lambda name, *v: models.vectors_of(type("M", (), {"model": name, "__call__": lambda self, t: list(v)})())(["x"] * len(v))
    assert call("own", [1, 2], [3, 4]) == [[1.0, 2.0], [3.0, 4.0]] and call("all-MiniLM-L6-v2", [1] * 384) == [[1.0] * 384]
    for name, v in (("all-MiniLM-L6-v2", ([1],)), ("own", ([1], [1, 2])), ("own", ([float("nan")],))):
        with pytest.raises(ValueError):
            call(name, *v)


def test_grid_names(corpus):
    own = experiments.llm_grid(ALL[0], ["m:1", "n/2"], [0.0, 0.5])
    assert [(e.name, e.llm.model, e.llm.temperature) for e in own] == [("a_m-1_t00", "m:1", 0.0), ("a_m-1_t50", "m:1", 0.5), ("a_n-2_t00", "n/2", 0.0), ("a_n-2_t50", "n/2", 0.5)]
    assert len({grid.shared(e) for e in ALL}) == 1 and len({grid.shared(e) for e in own}) == 4
    assert F.lit(1) is not None
