"""Document preparation: article grouping, question templates, samples, article context, summaries.

Entries carry doc_seq (the order of the source), id, kapitel_nr, kapitel_name, abschnitt_nr, artikel_nr, artikel_name, absatz_nr, unterabsatz_nr, satz_nr, text.
"""

from __future__ import annotations

import random

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators.chunking import with_global_ids
from lodestrata.operators.calls import Calls, Model, Record
from lodestrata.operators.generate import replies
from lodestrata.sources.tables import materialise

#: Places of the source that are followed in one task.
RANGE = 10_000
#: Kinds and difficulties of questions, the shape of an answer, and the wording of template questions, which results must equal.
QUESTION_TYPES = ("rights", "obligations", "purpose", "scope", "definition", "principles", "general")
DIFFICULTIES = ("easy", "medium", "hard")
#: What a model that writes questions must answer with.
QUESTION = "question string, question_type string, difficulty string, is_answerable boolean, reasoning string"
QUESTION_SCHEMA = {
    "type": "object",
    "properties": {"question": {"type": "string"}, "question_type": {"type": "string", "enum": list(QUESTION_TYPES)}, "difficulty": {"type": "string", "enum": list(DIFFICULTIES)}, "is_answerable": {"type": "boolean"}, "reasoning": {"type": "string"}},
    "required": ["question", "question_type", "difficulty", "is_answerable", "reasoning"],
    "additionalProperties": False,
}


def prefixed(entries: DataFrame) -> DataFrame:
    """Non-empty rows with the label that a change of article, sub-paragraph or paragraph puts before the text.

    The state is the row before, in the order of the source, over the whole corpus, not of a group. Rows are followed in ranges of ``RANGE`` places;
    a range begins with the last row of the one before it, of which there is one for each range.
    """
    rows = entries.withColumn("text", T.first_paragraph(F.col("text"))).where("text <> ''").withColumn("range", F.floor(F.col("doc_seq") / RANGE))
    kept = F.struct("artikel_nr", "absatz_nr", "unterabsatz_nr")
    lasts = rows.groupBy("range").agg(F.max_by(kept, "doc_seq").alias("last"))
    carried = lasts.select("range", F.lag("last").over(Window.orderBy("range")).alias("carried"))  # one row for each range
    rows = rows.join(carried, "range", "left")
    order = Window.partitionBy("range").orderBy("doc_seq")
    before = F.coalesce(F.lag(kept).over(order), F.col("carried"))
    state = rows.select("doc_seq", "artikel_nr", "artikel_name", "absatz_nr", "unterabsatz_nr", before.alias("before"))
    part = lambda c: F.coalesce(F.col(f"before.{c}"), F.lit(0))
    state = state.withColumns({"a0": part("artikel_nr"), "p0": part("absatz_nr"), "u0": part("unterabsatz_nr")})
    fresh = F.col("artikel_nr") > F.col("a0")
    last_u, last_p = F.when(fresh, 0).otherwise(F.col("u0")), F.when(fresh, 0).otherwise(F.col("p0"))
    head = F.when(fresh, F.concat(F.lit("Art. "), F.col("artikel_nr").cast("string"), F.lit(" "), F.col("artikel_name"), F.lit(":\n\n"))).otherwise("")
    mark = F.when(F.col("unterabsatz_nr") > last_u, F.concat(F.lit("("), F.char(96 + F.col("unterabsatz_nr")), F.lit(") "))).when(F.col("absatz_nr") > last_p, F.concat(F.lit("Abs. "), F.col("absatz_nr").cast("string"), F.lit(" "))).otherwise("")
    labels = state.select("doc_seq", F.concat(head, mark).alias("label"))
    return rows.drop("range", "carried").join(labels, "doc_seq").withColumn("text", F.concat("label", "text"))


def by_article(entries: DataFrame, compat: bool = False) -> DataFrame:
    """One document for each chapter, section and article, in first-seen order, texts joined by blank lines. ``compat`` sets the section to 0."""
    rows = prefixed(entries.withColumn("abschnitt_nr", F.lit(0)) if compat else entries)
    key = F.concat(F.lit("kap_"), F.col("kapitel_nr").cast("string"), F.lit("_abs_"), F.col("abschnitt_nr").cast("string"), F.lit("_art_"), F.col("artikel_nr").cast("string"))
    more = {"doc_seq": (F.min("doc_seq"), F.min), "artikel_name": (F.min_by("artikel_name", "doc_seq"), lambda c: F.min_by(c, "_range")), "n_rows": (F.count("*"), F.sum)}
    return joined_texts(rows.withColumn("id", key), "id", "\n\n", more).select("id", "doc_seq", "text", "artikel_name", "n_rows").withColumn("grouped", F.lit(True))


def joined_texts(rows: DataFrame, key: str, separator: str, more: dict[str, tuple] | None = None) -> DataFrame:
    """(key, text and ``more``): the texts of each key in the order of doc_seq. First within ranges of ``RANGE`` places, in as many tasks as there are, then the ranges in their order: what a task
    sorts is a range, and a key's rows are one for each range when they meet, with its text once. Null texts are left out. ``more`` gives by name an aggregate of the rows and one of the
    ranges' values."""
    inner = lambda a, b: F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: x[b])
    ranged = rows.withColumn("_range", F.floor(F.col("doc_seq") / RANGE))
    parts = ranged.groupBy(key, "_range").agg(F.when(F.count("text") > 0, F.array_join(inner("doc_seq", "text"), separator)).alias("_part"), *(f.alias(n) for n, (f, _) in (more or {}).items()))
    return parts.groupBy(key).agg(F.array_join(inner("_range", "_part"), separator).alias("text"), *(f(n).alias(n) for n, (_, f) in (more or {}).items()))


def article_counts(entries: DataFrame) -> DataFrame:
    """(artikel_nr, n_entries, first_seq): the groups of a grouped scan."""
    return entries.groupBy("artikel_nr").agg(F.count("*").alias("n_entries"), F.min("doc_seq").alias("first_seq"))


def grouped_if(entries: DataFrame, enabled: bool, compat: bool = False) -> DataFrame:
    return by_article(entries, compat) if enabled else entries


def template_questions(entries: DataFrame, law: str = "DSGVO") -> DataFrame:
    """Up to four questions a document: on its article, on its first two topics, on its chapter; ids run over all of them. Their wording is fixed."""
    article, chapter = F.col("artikel_nr").cast("string"), F.col("kapitel_nr").cast("string")
    asked = F.concat(
        F.array(F.concat(F.lit(f"Was besagt {law} Artikel "), article, F.lit("?"))),
        F.transform(T.topics(F.col("text"), 2), lambda t: F.concat(F.lit(f"Was sagt {law} Artikel "), article, F.lit(" über "), t, F.lit("?"))),
        F.array(F.concat(F.lit(f"Was sind die wichtigsten Anforderungen in {law} Kapitel "), chapter, F.lit("?"))),
    )
    rows = entries.select("doc_seq", F.col("id").alias("document_id"), F.col("text").alias("ground_truth"), F.posexplode(asked).alias("place", "question"))
    numbered = with_global_ids(rows.withColumnRenamed("place", "chunk_seq")).withColumnRenamed("chunk_no", "qa_seq")
    return numbered.select("qa_seq", F.concat("document_id", F.lit("_qa_"), F.col("qa_seq").cast("string")).alias("id"), "question", "ground_truth", "document_id", "doc_seq")


def article_texts(entries: DataFrame) -> DataFrame:
    """(artikel_nr, article_context): all texts of each article, joined by a space. Entries refer to it by artikel_nr, so its bytes are those of the entries."""
    return joined_texts(entries.select("artikel_nr", "doc_seq", "text"), "artikel_nr", " ").withColumnRenamed("text", "article_context")


def article_context(entries: DataFrame) -> DataFrame:
    """Each entry with all texts of its article: for prompts, which hold them. The bytes grow with the square of an article; ``article_texts`` has each once."""
    return entries.join(article_texts(entries), "artikel_nr", "left")


def type_counts(qa: DataFrame, column: str = "question_type", unknown: str = "unknown") -> DataFrame:
    """(column, n): how often each kind stands, null as ``unknown``."""
    return qa.groupBy(F.coalesce(column, F.lit(unknown)).alias(column)).agg(F.count("*").alias("n"))


def answerable(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries worth asking about: ten characters or more after stripping; the first ``limit`` in source order."""
    rows = entries.where(F.length(T.strip(F.col("text"))) >= 10)
    return rows if limit is None else rows.orderBy("doc_seq").limit(limit)


def question_prompt(law: str = "DSGVO") -> Column:
    """Prompt over an entry and its article's context."""
    parts = ("Write one natural, specific question that the sentence below answers. ", F.lit(f"It stands in {law} article "), F.col("artikel_nr").cast("string"), " (", F.col("artikel_name"), ').\n\nSentence: "', F.col("text"), '"\n\nArticle: "', F.col("article_context"), '"\n\nThe question must be about this sentence, not the article as a whole. ')
    kinds = f"Name its type ({', '.join(QUESTION_TYPES)}) and difficulty ({', '.join(DIFFICULTIES)}), and say whether the sentence alone answers it. Answer in JSON."
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(kinds))


def model_questions(entries: DataFrame, make: Callable[[], Model], law: str = "DSGVO", limit: int | None = None, *, record: Record | None = None, settings: dict | None = None, calls: Calls | None = None) -> DataFrame:
    """Questions that a model writes on entries, with their ids; one for each answerable entry. Replies that are no JSON of the
    stated shape, failed calls, and questions that the model itself calls unanswerable are left out. With a ``record`` a run that was stopped goes on where it was, and
    failed calls are made again by the next run."""
    rows = answerable(article_context(entries), limit)
    if limit is not None:
        # written, as otherwise every partition would call the model for so many rows
        rows = materialise(entries.sparkSession, rows, "entries")
    rows = replies(rows, question_prompt(law), make, record, settings, calls)
    rows = rows.withColumn("q", F.from_json("reply.answer", QUESTION)).where("q.is_answerable and trim(q.question) <> ''")
    rows = rows.where(F.col("q.question_type").isin(*QUESTION_TYPES) & F.col("q.difficulty").isin(*DIFFICULTIES))
    # model calls are not repeatable: the replies are written before anything reads them twice
    rows = materialise(entries.sparkSession, rows.withColumn("chunk_seq", F.lit(0)), "questions")
    rows = with_global_ids(rows).withColumnRenamed("chunk_no", "qa_seq")
    return rows.select("qa_seq", F.concat(F.lit(f"{law.lower()}_llm_"), F.col("qa_seq").cast("string")).alias("id"), "q.question", F.col("text").alias("ground_truth"), F.col("id").alias("document_id"), "q.question_type", "q.difficulty", "q.reasoning", "article_context", "artikel_nr", "doc_seq")


def checked_questions(qa: DataFrame, make: Callable[[], Model], compat: bool = False, *, record: Record | None = None, settings: dict | None = None, calls: Calls | None = None) -> DataFrame:
    """The pairs that a model calls VALID; a pair whose own call failed is accepted. ``compat``: INVALID counts as well, as it holds the word."""
    prompt = F.concat(F.lit('Does the answer fit the question, wholly and from the context?\n\nQuestion: "'), "question", F.lit('"\nAnswer: "'), "ground_truth", F.lit('"\nContext: "'), F.coalesce("article_context", F.lit("")), F.lit('"\n\nReply VALID or INVALID, and why.'))
    rows = replies(qa, prompt, make, record, settings, calls).withColumn("verdict", F.when(F.col("reply.error").isNotNull(), "VALID").otherwise(F.col("reply.answer"))).drop("reply")
    return (rows.where(F.upper("verdict").contains("VALID")) if compat else validated(rows)).drop("verdict")


def validated(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows whose verdict says VALID as a word of its own; INVALID does not."""
    return rows.where(F.col(verdict).rlike(r"(?i)\bVALID\b"))


def seeded_sample(qa: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The pairs that random.Random(seed).sample picks, with their place; all, in order, if there are no more than k."""
    n = qa.count()
    if k >= n:
        return qa.withColumn("place", F.col("qa_seq"))
    places = qa.sparkSession.createDataFrame(list(enumerate(random.Random(seed).sample(range(n), k))), "place long, qa_seq long")  # the stated k pairs
    return qa.join(F.broadcast(places) if k <= 1_000_000 else places, "qa_seq")


def subset(qa: DataFrame, n: int = 50, seed: int | None = None) -> DataFrame:
    return qa.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def dataset_summary(qa: DataFrame) -> DataFrame:
    """One row over pairs (artikel_nr, ground_truth, article_context, and question_type and difficulty if they have them, as counts)."""
    found = qa.agg(
        F.count("*").alias("total_qa_pairs"), F.count_distinct("artikel_nr").alias("articles_covered"), F.sort_array(F.collect_set("artikel_nr")).alias("articles_list"),
        F.avg(F.length("ground_truth")).alias("avg_answer_length"), T.ratio(F.count_if(F.coalesce("article_context", F.lit("")) != ""), F.count("*")).alias("context_coverage"),
    )
    for column, name in (("question_type", "question_types"), ("difficulty", "difficulties")):
        if column in qa.columns:
            counts = type_counts(qa, column).withColumnRenamed(column, "k")
            found = found.crossJoin(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)))  # one row each, an entry for each kind
    return found


def carried_context(events: DataFrame) -> DataFrame:
    """Articles of an overview with the chapter and section above them. events (doc_seq, pos, kind, nr, name); a chapter resets the section.
    Keyed by doc_seq, the page: pages are independent."""
    order = Window.partitionBy("doc_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.when(F.col("kind") == "chapter", F.struct("nr", "name"))
    section = F.when(F.col("kind") == "section", F.struct("nr", "name")).when(F.col("kind") == "chapter", F.struct(F.lit(0).alias("nr"), F.lit("").alias("name")))
    rows = events.withColumns({"c": F.last(chapter, True).over(order), "s": F.last(section, True).over(order)}).where("kind = 'article'")
    field = lambda c, f, d: F.coalesce(F.col(f"{c}.{f}"), F.lit(d))
    return rows.select("doc_seq", "pos", "nr", "name", field("c", "nr", 0).alias("kapitel_nr"), field("c", "name", "").alias("kapitel_name"), field("s", "nr", 0).alias("abschnitt_nr"), field("s", "name", "").alias("abschnitt_name"))


def crawl_statistics(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_distinct("artikel_nr").alias("articles"), F.count_distinct("kapitel_nr").alias("chapters"), F.count_distinct(F.when(F.col("kapitel_name") != "Unknown", F.col("kapitel_name"))).alias("sections"))


def empty_entries(spark: SparkSession) -> DataFrame:
    from lodestrata.sources.readers import ENTRY

    return spark.createDataFrame([], ENTRY)
