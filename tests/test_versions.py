"""The versioned index against fresh builds, two writers, a stream of changes, and awkward documents."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import chunking
from lodestrata.sources import versions
from lodestrata.sources.sinks import names_in
from lodestrata.sources.versions import PLACES, Conflict, VersionedIndex
from lodestrata.streaming.ingest import follow

DOC = "doc_seq long, text string"


def made(spark, folder, embed=True, **settings):
    return VersionedIndex(spark, str(folder), lambda d: chunking.fixed_size(d, 20, 5), (lambda r: r.withColumn("vec", V.hashing_embedding(F.col("text"), 8))) if embed else None, settings)


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), DOC)


def rows(df):
    return sorted((r["chunk_seq"], r["chunk_id"], r["doc_seq"], r["place"], r["text"], tuple(r["vec"])) for r in df.collect())


def fresh(spark, docs):
    c = chunking.fixed_size(frame(spark, docs), 20, 5).withColumn("vec", V.hashing_embedding(F.col("text"), 8))
    return sorted((r["doc_seq"] * PLACES + r["chunk_seq"], f"chunk_{r['doc_seq']}_{r['chunk_seq']}", r["doc_seq"], r["chunk_seq"], r["text"], tuple(r["vec"])) for r in c.collect())


def test_versions_equal_fresh_builds(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ", "one two three four five six seven " * rng.randrange(1, 4), "same text in many documents, long enough to cut"])
    docs, index, states = {}, made(spark, tmp_path), []
    for step in range(4):
        change = {rng.randrange(12): text() for _ in range(5)}
        gone = [k for k in list(docs) if k not in change and rng.random() < 0.3]
        new = {k: v for k, v in {**docs, **change}.items() if k not in gone}
        if step % 2:
            index.write(frame(spark, change), spark.createDataFrame([(k,) for k in [*gone, 99]], "doc_seq long"))
        else:
            index.write(frame(spark, new), whole=True)
        docs = new
        states.append((index.manifest()["version"], dict(docs)))
    for version, held in states:
        assert rows(index.chunks(version)) == fresh(spark, held)
        assert sorted(r["doc_seq"] for r in index.documents(version).collect()) == sorted(held)
    last = index.manifest()["version"]
    assert index.write(frame(spark, docs), whole=True)["version"] == last  # nothing changed
    before = rows(index.chunks())
    index.compact()
    assert rows(index.chunks()) == before and len(index.manifest()["segments"]) == 1
    assert len(index.vacuum()) >= 3 and rows(index.chunks()) == before and index.versions() == [last + 1]
    assert rows(index.chunks(0)) == []
    with pytest.raises(ValueError):
        index.chunks(1)


def test_only_changes_are_embedded(spark, tmp_path):
    seen = []

    def embed(r):
        seen.append(r.select("doc_seq").distinct().count())
        return r.withColumn("vec", V.hashing_embedding(F.col("text"), 8))

    index = VersionedIndex(spark, str(tmp_path), lambda d: chunking.fixed_size(d, 20, 5), embed)
    docs = {k: f"document {k}" for k in range(10)}
    index.write(frame(spark, docs))
    index.write(frame(spark, docs | {3: "changed", 11: "new"}))
    assert seen == [10, 2]
    got = {r["doc_seq"]: r["change"] for r in index.changes(1, 2).collect()}
    assert got == {3: "changed", 11: "added"} and {r["change"] for r in index.changes(2, 0).collect()} == {"removed"}


def test_equal_texts_and_digests(spark, tmp_path):
    index = made(spark, tmp_path)
    index.write(frame(spark, {1: "equal text", 2: "equal text", 3: None, 4: ""}))
    index.write(frame(spark, {3: "", 4: None}), spark.createDataFrame([(1,)], "doc_seq long"))
    assert rows(index.chunks()) == fresh(spark, {2: "equal text", 3: "", 4: None})
    assert {r["doc_seq"] for r in index.changes(1, 2).collect()} == {1, 3, 4}
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            index.write(spark.createDataFrame(bad, DOC))
    # deleted and given in one change: given
    index.write(frame(spark, {2: "other"}), spark.createDataFrame([(2,)], "doc_seq long"))
    assert rows(index.chunks()) == fresh(spark, {2: "other", 3: "", 4: None})


def test_settings_and_too_many_chunks(spark, tmp_path, monkeypatch):
    made(spark, tmp_path, model="a").write(frame(spark, {1: "x"}))
    with pytest.raises(ValueError, match="was made with"):
        made(spark, tmp_path, model="b").write(frame(spark, {1: "x"}))
    monkeypatch.setattr(versions, "PLACES", 2)
    with pytest.raises(Exception, match="more than 2 chunks"):
        made(spark, tmp_path / "b").write(frame(spark, {1: "word " * 50}))
    assert made(spark, tmp_path / "b").manifest()["version"] == 0


def test_two_writers(spark, tmp_path):
    one, two = made(spark, tmp_path), made(spark, tmp_path)
    one.write(frame(spark, {1: "first", 2: "second"}))
    state = two.manifest()
    one.write(frame(spark, {1: "changed by one"}))
    given = frame(spark, {2: "changed by two"}).withColumn("digest", F.lit("d"))
    assert two._attempt(state, given, given.drop("text"), None, False, {}, f"{tmp_path}/drafts/own") is None  # the version is taken: nothing of it stays
    assert rows(one.chunks()) == fresh(spark, {1: "changed by one", 2: "second"})
    assert len(names_in(spark, f"{tmp_path}/segments")) == 2 and names_in(spark, f"{tmp_path}/drafts") == ["own"]
    two._attempt = lambda *a: None
    with pytest.raises(Conflict):
        two.write(frame(spark, {2: "x"}), tries=2)
    errors = []

    def work(k):
        try:
            made(spark, tmp_path).write(frame(spark, {10 + k: f"writer {k}"}), tries=6)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and rows(one.chunks()) == fresh(spark, {1: "changed by one", 2: "second", 10: "writer 0", 11: "writer 1", 12: "writer 2"})


def test_stream_of_changes(spark, tmp_path):
    schema, source = "seq long, doc_seq long, text string, deleted boolean", str(tmp_path / "in")
    index = made(spark, tmp_path / "index")
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(source)
    put((1, 1, "a", None), (2, 2, "b", False), (3, 1, "a again", None), (4, 3, "c", None))
    follow(index, source, str(tmp_path / "check")).awaitTermination()
    put((5, 2, None, True), (6, 3, "c changed", None), (7, 9, None, True))
    follow(index, source, str(tmp_path / "check")).awaitTermination()
    assert rows(index.chunks()) == fresh(spark, {1: "a again", 3: "c changed"}) and index.manifest()["stamps"] == {"stream": 1}
    # a batch that comes again, as after a failure, is known by its number
    again = index.write(frame(spark, {1: "never"}), stamps={"stream": 1})
    assert again["version"] == 2 and rows(index.chunks()) == fresh(spark, {1: "a again", 3: "c changed"})
