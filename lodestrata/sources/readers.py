"""Scans: JSON Lines, CSV, directories of run summaries, and the tables as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, Kapitel_Nr int, Kapitel_Name string, Abschnitt_Nr int, Abschnitt_Name string, Artikel_nr int, Artikel_Name string, Absatz_nr int, Unterabsatz_nr int, Satz_nr int, Text string"
ACT_ENTRY = "title string, article_number string, article_title string, section string, subsection string, paragraph_number int, subparagraph_number int, text string, url string, timestamp timestamp"
QA = "id string, question string, ground_truth string, document_id string, question_type string, difficulty string, context string, article_context string, metadata struct<kapitel_nr:int,kapitel_name:string,artikel_nr:int,artikel_name:string,absatz_nr:int,unterabsatz_nr:int,satz_nr:int>"
_MEASURES = ("precision", "recall", "f1", "query_time", "response_length", "faithfulness", "answer_relevance", "context_relevance", "dsgvo_score")
SUMMARY = (
    ", ".join(f"{k}_{m} double" for m in _MEASURES for k in ("avg", "min", "max"))
    + ", pipeline_info struct<llm:struct<model:string,name:string,temperature:double,max_tokens:bigint>,embedding:struct<model:string,name:string,abbr:string>,"
    "chunking:struct<name:string,strategy:string,chunk_size:string,chunk_overlap:double>,retrieval:struct<top_k:bigint,similarity_threshold:double,chunks_indexed:bigint>,"
    "pipeline:struct<max_context_length:bigint>,dataset:struct<grouping_applied:boolean>>"
    ", context_optimization struct<truncation_rate:double,avg_context_utilization:double,avg_chunks_used:double,total_chunks_wasted:bigint>"
    ", evaluation_info struct<enabled_evaluators:array<string>,total_metrics:bigint>, total_evaluation_time double, qa_pairs_evaluated bigint, random_seed bigint"
)


def numbered(df: DataFrame, name: str = "doc_seq") -> DataFrame:
    """Rows with their place in the files. A row's number is its place in its partition, which the engine gives, plus the rows of the partitions
    before: one count for each partition is collected. ``df`` must be a scan, whose partitions are the same each time."""
    own = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("int")
    # a column is read in both passes: a scan of none may count lines that hold no row
    sizes = sorted((r[0], r[1]) for r in own.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max(F.col(f"`{df.columns[0]}`").cast("string"))).collect())
    starts, total = {}, 0
    for k, n in sizes:
        starts[k], total = total, total + n
    first = F.get(F.lit([starts.get(k, 0) for k in range(max(starts, default=-1) + 1)] or [0]), part).cast("long")
    return own.select((first + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *(F.col(f"`{c}`") for c in df.columns))


def jsonl_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries with the names that preparation uses, defaults for what is missing, in file order. The section is carried as well."""
    raw = numbered(spark.read.schema(ENTRY).json(path))
    number = lambda c, d=0: F.coalesce(c, F.lit(d)).alias(c.lower())
    return raw.select(
        "doc_seq", F.coalesce("id", F.lit("unknown")).alias("id"), F.coalesce("Text", F.lit("")).alias("text"), number("Kapitel_Nr"), F.coalesce("Kapitel_Name", F.lit("")).alias("kapitel_name"),
        number("Abschnitt_Nr"), number("Artikel_nr"), F.coalesce("Artikel_Name", F.lit("")).alias("artikel_name"), number("Absatz_nr"), number("Unterabsatz_nr"), number("Satz_nr"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def jsonl_qa(spark: SparkSession, path: str, otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The pairs of a file; where there is none, what ``otherwise`` generates."""
    if otherwise is not None and not exists(spark, path):
        return otherwise()
    return numbered(spark.read.schema(QA).json(path), "qa_seq")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table; where there is no such file, the JSON table of the same name."""
    if not exists(spark, path):
        return spark.read.schema(schema).json(f"{path.removesuffix('.csv')}.json")
    return spark.read.csv(path, schema=schema, header=True)


class Dataset:
    """Documents and question pairs of a collection: the file of pairs if there is one, else template questions on the documents."""

    def __init__(self, spark: SparkSession, documents: str, pairs: str | None = None, grouping: bool = False):
        from lodestrata.operators import prepare

        self.documents = prepare.grouped_if(jsonl_entries(spark, documents), grouping)
        make = lambda: prepare.template_questions(jsonl_entries(spark, documents))
        self.pairs = jsonl_qa(spark, pairs, make) if pairs else make()

    def get_documents(self) -> DataFrame:
        return self.documents

    def get_qa_pairs(self) -> DataFrame:
        return self.pairs


def run_summaries(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """All run summaries of a folder, with their file's name."""
    reader = spark.read.schema(SUMMARY).option("multiLine", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*_evaluation_summary_*.json")
    return reader.json(folder).withColumn("experiment_file", F.col("_metadata.file_name"))


def entries_of_documents(docs: DataFrame) -> DataFrame:
    """The documents table as legal entries: source number as chapter, language as section, a running article every seven ids."""
    chapter = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0))
    return docs.select(
        F.col("doc_id").alias("doc_seq"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("text"), chapter.alias("kapitel_nr"), F.concat(F.lit("Kapitel "), F.col("source")).alias("kapitel_name"),
        F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).otherwise(0).alias("abschnitt_nr"), F.floor(F.col("doc_id") / 7).cast("int").alias("artikel_nr"), F.concat(F.lit("Titel "), F.floor(F.col("doc_id") / 7).cast("string")).alias("artikel_name"),
        F.floor((F.col("doc_id") % 7) / 2).cast("int").alias("absatz_nr"), (F.col("doc_id") % 3).cast("int").alias("unterabsatz_nr"), F.lit(1).alias("satz_nr"),
    )
