"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Sources are weighed in the order of their code points, null last, by ``weights`` that repeat, and share ``share`` times all words; a target stops at
``most`` times its source's words, and what is over goes to the others by weight until none is above: the targets are the levels
``min(most x words, level x weight)`` of one common level, found by going through the sources in the order of ``words / weight``.

Every source's documents are put in a fixed random order, end to end, and cut into blocks of ``block`` words. A source needs as many slots as its target
has blocks: whole rounds over all its blocks, then a last round up to the target, whose last block is cut short. All slots together are the cells of a grid, dealt
to the sources by cumulative weight, as many cells each as it needs slots. The van der Corput sequence goes through the grid: the time of a cell is its
number with the bits reversed, so every stretch of the schedule holds the sources in proportion. The n-th slot of a source takes its n-th block.

DataFrame functions only. One row for each source goes through one task and is broadcast: there may be ``MAX_SOURCES``, more raise. Running sums over documents
and slots are taken within ranges of their order, then over the ranges, so a source that holds most rows is spread like any other.

A null text has no words, and with all texts without a word it is taken 0 times. Equal rows (id, text and source) share their place and follow one another.
Null ids and repeated ids are ordinary: every row is one document. The schedule depends on the rows only, not on their layout. Only the three columns named are
read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise
from lodestrata.llm.order import distinct_rows, running, spread

WEIGHTS = (5, 2, 1)
BLOCK = 1_024
MAX_SOURCES = 100_000
#: Hex digits of a document's place that make its range; slots of a range of the schedule.
DIGITS, STRETCH = 3, 65_536
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D: each, with the spaces after it, is replaced by one letter."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.coalesce(F.length(F.regexp_replace(inner, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def measured(docs: DataFrame, seed: int, doc: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, place): the words of every document and its place in the random order."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), place.alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) with part (the source's number), weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("part", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("part") % len(weights) + 1))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "part")
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        "left": F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)),
        "heavy": F.sum("weight").over(rest),
    })
    full = F.lit(most) * F.col("source_size") * F.col("heavy") <= F.col("weight") * F.col("left")
    first = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("weight"), "part", "left", "heavy"))).over(Window.partitionBy())
    level = F.when(full, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("weight") * first["left"] / first["heavy"])
    return rows.select("source", "source_size", "part", "weight", level.alias("target"))


def plan(sizes: DataFrame, block: int, **how) -> DataFrame:
    """The targets with what the schedule needs: blocks of the source, whole rounds, words of the last round, slots, and the first cell of the grid."""
    rows = targets(sizes, **how).withColumn("blocks", F.ceil(F.col("source_size") / block))
    rows = rows.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    rows = rows.withColumn("last", F.floor("target") - F.col("rounds") * F.col("source_size"))
    rows = rows.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("last") / block))
    cells = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bits = F.greatest(F.lit(1), F.length(F.bin(F.sum("slots").over(Window.partitionBy()) - 1)))
    return rows.withColumns({"cell": F.coalesce(F.sum("slots").over(cells), F.lit(0)), "bits": bits})


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(part, time, round, block, words): which block of which source is taken when, and how many of its words. Times leave gaps."""
    steps = sources.where("slots > 0").select("part", "cell", "slots", "bits", "blocks", "rounds", "last", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(STRETCH).cast("long"))).alias("_from"))
    steps = steps.repartition("part", "_from")  # a source with very many slots is made by many tasks
    slots = steps.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + STRETCH, F.col("slots")) - 1)))
    time = F.conv(F.reverse(F.lpad(F.bin(F.col("cell") + F.col("_nth")), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    slots = slots.withColumn("time", time).withColumns({"_stretch": F.floor(F.col("time") / STRETCH), "_one": F.lit(1)})
    slots = running(slots, ["part"], "_stretch", ["time"], "_one", "rank")
    slots = slots.withColumns({"round": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    upto = F.when(F.col("round") < F.col("rounds"), F.col("source_size")).otherwise(F.col("last"))
    return slots.select("part", "time", "round", "block", F.least(F.lit(block), upto - F.col("block") * block).alias("words"))


class Mixture:
    """The plan of one mixture and its parts as tables: ``sources``, ``placed`` (documents with the place of their first word in their source) and ``empty``
    (those without words), and ``stream``, the mixture itself."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, *, block: int = BLOCK, seed: int = 7, doc: str = "doc_id", text: str = "text", source: str = "source"):
        spark, self.block = docs.sparkSession, block
        rows = materialise(spark, measured(docs, seed, doc, text, source), "mix-sizes")
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = materialise(spark, plan(sizes, block, weights=weights, share=share, most=most), "mix-sources")
        if self.sources.count() > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        known = F.broadcast(self.sources.select(F.col("source").alias("_s"), "part", "source_size", "target"))  # at most MAX_SOURCES rows
        rows = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        self.empty = rows.where("size = 0")
        own = distinct_rows(rows.where("size > 0")).withColumns({"_range": F.substring("place", 1, DIGITS), "_words": F.col("size") * F.col("copies")})
        own = running(own, ["part"], "_range", ["place", F.col("doc_id").asc_nulls_first(), "size"], "_words", "_begin").drop("_range", "_words", "place")
        self.placed = materialise(spark, spread(own).withColumn("begin", F.col("_begin") + F.col("copy") * F.col("size")).drop("_begin", "copy"), "mix-placed")

    def stream(self) -> DataFrame:
        """(time, source, doc_id, round, from_word, n_words, begin, part, size): the words of each document that each slot takes, in the order of ``time``, then
        ``begin``. Slots meet the documents of their block; a block holds at most ``block`` of them."""
        n, end = self.block, F.col("begin") + F.col("size")
        pieces = self.placed.select("*", F.explode(F.sequence(F.floor(F.col("begin") / n), F.floor((end - 1) / n))).alias("block"))
        start = F.greatest(F.col("begin"), F.col("block") * n)
        upto = F.least(end, F.col("block") * n + F.col("words"))
        taken = pieces.join(schedule(self.sources, n), ["part", "block"]).withColumns({"from_word": start - F.col("begin"), "n_words": upto - start})
        return taken.where("n_words > 0").select("time", "source", "doc_id", "round", "from_word", "n_words", "begin", "part", "size")

    def taken(self) -> DataFrame:
        """One row for each document: doc_id, source, size, source_size, target, taken."""
        used = self.stream().groupBy("part", "begin").agg(F.sum("n_words").alias("taken"))
        rows = self.placed.join(used, ["part", "begin"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        out = ["doc_id", "source", "size", "source_size", "target", "taken"]
        return rows.select(out).unionByName(self.empty.withColumn("taken", F.lit(0).cast("long")).select(out))
