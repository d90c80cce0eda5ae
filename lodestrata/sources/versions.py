"""A chunk index that follows its documents: versions, updates and deletions.

The index is a folder of immutable segments and of manifests ``manifest/00000001.json``, each the whole state of one version. A change writes one segment: the chunks of new
and changed documents with their vectors, the documents that it adds (id and content digest), and the ids that it removes. It becomes a version by one rename of its
manifest to the next free number, which fails if another writer was first; a segment without a manifest belongs to no version and is never read. So a
reader sees a version whole, and a writer that loses either starts again from the new version or raises ``Conflict``.

A chunk counts if no later segment removes its document. Only changed documents are chunked and embedded; the others are not read again. Chunks keep their numbers: the document's number
times ``PLACES``, plus the place in it, so ids stay the same over versions and run in the order of the documents, as numbers of a fresh build do.

Document numbers are unique and not null; a table that repeats one raises. A null text has the digest of no text and no chunks, which is not that of the empty text. Equal texts of different documents
are documents of their own. Further columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.sinks import names_in, put_json
from lodestrata.sources.tables import make_folder, remove, rename_new

#: Chunks that a document may have.
PLACES = 1 << 20
DOCS = "doc_seq bigint, digest string"


class Conflict(RuntimeError):
    """Another writer made the version first."""


class VersionedIndex:
    """``chunk`` takes (doc_seq, text) and gives (doc_seq, chunk_seq, text); ``embed`` adds ``vec`` to rows with a text. ``settings`` name what both depend on: an
    index that was made with others is refused."""

    def __init__(self, spark: SparkSession, folder: str, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None, settings: dict | None = None):
        self.spark, self.folder, self.chunk, self.embed = spark, folder.rstrip("/"), chunk, embed
        self.settings = json.loads(json.dumps(settings or {}, default=str))
        make_folder(spark, f"{self.folder}/manifest")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.folder}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The state of a version, of the newest if none is named; version 0 is empty."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if version == 0:
            return {"version": 0, "segments": [], "settings": self.settings, "stamps": {}}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifest/{version:08d}.json", wholetext=True).collect()))
        if found["settings"] != self.settings:
            raise ValueError(f"the index was made with {found['settings']}, not {self.settings}")
        return found

    def _read(self, state: dict, part: str, schema: str) -> DataFrame:
        """One part of all segments of a version, with the number of its segment."""
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for number, name in state["segments"]:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{name}/{part}").withColumn("segment", F.lit(number)))
        return out

    def _live(self, state: dict, rows: DataFrame) -> DataFrame:
        """The rows whose document no later segment removes. Those of the last segment all count, and are not joined."""
        if len(state["segments"]) < 2:
            return rows
        last = state["segments"][-1][0]
        gone = self._read(state, "removed", "doc_seq bigint").groupBy("doc_seq").agg(F.max("segment").alias("_gone"))
        older = rows.where(F.col("segment") < last).join(gone, "doc_seq", "left").where("_gone is null or _gone <= segment").drop("_gone")
        return older.unionByName(rows.where(F.col("segment") == last))

    def documents(self, version: int | None = None) -> DataFrame:
        """(doc_seq, digest) of a version."""
        state = self.manifest(version)
        return self._live(state, self._read(state, "docs", DOCS)).drop("segment")

    def chunks(self, version: int | None = None) -> DataFrame:
        """(chunk_seq, chunk_id, doc_seq, place, text, vec) of a version."""
        state = self.manifest(version)
        schema = "chunk_seq bigint, chunk_id string, doc_seq bigint, place bigint, text string" + (", vec array<double>" if self.embed else "")
        return self._live(state, self._read(state, "chunks", schema)).drop("segment")

    def _made(self, docs: DataFrame) -> DataFrame:
        rows = self.chunk(docs).select("doc_seq", F.col("chunk_seq").cast("long").alias("place"), "text")
        too_many = F.raise_error(F.lit(f"a document of more than {PLACES} chunks")).cast("bigint")
        rows = rows.withColumn("chunk_seq", F.when(F.col("place") < PLACES, F.col("doc_seq") * PLACES + F.col("place")).otherwise(too_many))
        rows = rows.withColumn("chunk_id", F.concat_ws("_", F.lit("chunk"), "doc_seq", "place"))
        return rows if self.embed is None else self.embed(rows)

    def write(self, docs: DataFrame, deleted: DataFrame | None = None, *, whole: bool = False, stamps: dict | None = None, tries: int = 1) -> dict:
        """Take in ``docs`` (doc_seq, text): new ones are added, those with another content replaced, and equal ones left alone. ``deleted`` (doc_seq) go; with ``whole``
        ``docs`` is the whole collection, and what it does not hold goes. Returns the new manifest; the old one if nothing changes. If another writer makes the version
        first, starts again up to ``tries`` times, then raises ``Conflict``."""
        digest = F.sha2(F.concat_ws(":", F.when(F.col("text").isNull(), "null").otherwise("text"), "text").cast("binary"), 256)
        docs = docs.select(F.col("doc_seq").cast("long").alias("doc_seq"), "text", digest.alias("digest"))
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        try:
            return self._write(docs, self._keys(docs.select("doc_seq", "digest"), f"{draft}/given"), deleted, whole, stamps or {}, tries, draft)
        finally:
            remove(self.spark, draft)

    def _keys(self, rows: DataFrame, path: str) -> DataFrame:
        """Numbers and digests, written: texts are only read again where they have to be cut."""
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write(self, docs: DataFrame, given: DataFrame, deleted: DataFrame | None, whole: bool, stamps: dict, tries: int, draft: str) -> dict:
        seen = given.agg(F.count("*").alias("n"), F.count("doc_seq").alias("some"), F.count_distinct("doc_seq").alias("own")).first()
        if not seen["n"] == seen["some"] == seen["own"]:
            raise ValueError("document numbers must be unique and not null")
        for _ in range(tries):
            state = self.manifest()
            if stamps and all(state["stamps"].get(k) == v for k, v in stamps.items()):
                return state
            done = self._attempt(state, docs, given, deleted, whole, stamps, draft)
            if done is not None:
                return done
        raise Conflict(f"version {state['version'] + 1} is another writer's")

    def _attempt(self, state: dict, docs: DataFrame, given: DataFrame, deleted: DataFrame | None, whole: bool, stamps: dict, draft: str) -> dict | None:
        held = self.documents(state["version"]).select("doc_seq", F.col("digest").alias("old"))
        fresh = self._keys(given.join(held, "doc_seq", "left").where("old is null or old <> digest"), f"{draft}/fresh")
        gone = fresh.where("old is not null").select("doc_seq")
        if whole:
            gone = gone.unionByName(held.select("doc_seq").join(given.select("doc_seq"), "doc_seq", "left_anti"))
        if deleted is not None:
            leave = deleted.select(F.col("doc_seq").cast("long").alias("doc_seq")).distinct().join(given.select("doc_seq"), "doc_seq", "left_anti")
            gone = gone.unionByName(held.select("doc_seq").join(leave, "doc_seq", "left_semi"))
        gone = self._keys(gone.distinct(), f"{draft}/gone")
        if fresh.isEmpty() and gone.isEmpty() and not stamps:
            return state
        # by the digest as well, so a document that has changed since it was first read is not taken for what it was
        texts = docs.join(fresh.select("doc_seq", "digest"), ["doc_seq", "digest"], "left_semi").select("doc_seq", "text")
        parts = {"docs": fresh.select("doc_seq", "digest"), "removed": gone, "chunks": self._made(texts)}
        return self._commit(state, state["segments"], parts, stamps)

    def _commit(self, state: dict, kept: list, parts: dict[str, DataFrame], stamps: dict) -> dict | None:
        number, name = state["version"] + 1, uuid.uuid4().hex
        for part, rows in parts.items():
            rows.write.parquet(f"{self.folder}/segments/{name}/{part}")
        new = {"version": number, "segments": [*kept, [number, name]], "settings": self.settings, "stamps": {**state["stamps"], **stamps}}
        draft = f"{self.folder}/drafts/{name}.json"
        put_json(self.spark, draft, new)
        if rename_new(self.spark, draft, f"{self.folder}/manifest/{number:08d}.json"):
            return new
        for left in (draft, f"{self.folder}/segments/{name}"):
            remove(self.spark, left)
        return None

    def compact(self) -> dict:
        """A version of one segment with the chunks that count; vectors are copied, not made again. Older versions stay readable until ``vacuum``."""
        state = self.manifest()
        none = self.spark.createDataFrame([], "doc_seq bigint")
        done = self._commit(state, [], {"docs": self.documents(state["version"]), "removed": none, "chunks": self.chunks(state["version"])}, {})
        if done is None:
            raise Conflict(f"version {state['version'] + 1} is another writer's")
        return done

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all versions but the last ``keep``, then the segments that none of those has. Not beside a writer, whose segment has no manifest yet."""
        known = sorted(self.versions())
        stay = {name for v in known[-keep:] for _, name in self.manifest(v)["segments"]}
        for v in known[:-keep]:
            remove(self.spark, f"{self.folder}/manifest/{v:08d}.json")
        gone = [n for n in names_in(self.spark, f"{self.folder}/segments") if n not in stay]
        for name in gone:
            remove(self.spark, f"{self.folder}/segments/{name}")
        return gone

    def changes(self, old: int, new: int) -> DataFrame:
        """(doc_seq, change): added, changed or removed between two versions."""
        a, b = self.documents(old).withColumnRenamed("digest", "a"), self.documents(new).withColumnRenamed("digest", "b")
        kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        return a.join(b, "doc_seq", "full").select("doc_seq", kind.alias("change")).where("change is not null")
