"""Column expressions over text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters; Java's own ``\w`` is ASCII only.
WORD = r"([\p{L}\p{N}_]+)"
#: Topic keywords, in the order in which they are reported.
TOPICS = ["personenbezogene Daten", "Verarbeitung", "Einwilligung", "Rechte", "Verantwortlicher", "Auftragsverarbeiter", "Aufsichtsbehörde", "Datenschutz", "Grundrechte", "Freiheiten", "Schutz", "Sicherheit"]
#: Words that mark navigation text on the two kinds of pages.
NAVIGATION = ["feedback", "bewertung", "drucken", "teilen", "weitere artikel", "siehe auch", "navigation"]
NAVIGATION_ACT = ["navigation", "menu", "breadcrumb", "footer", "header", "copyright", "legal notice", "privacy policy", "terms of use", "back to top", "previous", "next", "home"]


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 1)


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def ws_tokens(c: Column) -> Column:
    """White-space tokens without empties."""
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda t: t != "")


def ws_set(c: Column) -> Column:
    return F.array_distinct(ws_tokens(F.lower(c)))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(ratio(overlap(a, b), F.size(F.array_union(a, b))))


def stem_tokens(c: Column) -> Column:
    """White-space tokens, lower-cased, words over three letters without the first suffix of ing, ed, er, est, ly, s that fits."""
    return F.transform(ws_tokens(F.lower(c)), lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, r"(ing|ed|er|est|ly|s)\z", "")).otherwise(w))


def stem(c: Column) -> Column:
    return F.array_join(stem_tokens(c), " ")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def first_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0))


def any_of(c: Column, needles: list[str]) -> Column:
    """Whether the lower-cased text holds any of the needles."""
    low = F.lower(c)
    return F.coalesce(F.exists(F.array(*map(F.lit, needles)), lambda n: low.contains(F.lower(n))), F.lit(False))


def topics(c: Column, most: int = 3) -> Column:
    low = F.lower(c)
    return F.slice(F.filter(F.array(*map(F.lit, TOPICS)), lambda k: low.contains(F.lower(k))), 1, most)


def first_paragraph(c: Column) -> Column:
    return F.substring_index(strip(c), "\n\n", 1)


def ellipsis(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def truthy_or(a: Column, b: Column) -> Column:
    """``a`` unless it is null, empty, or the text of zero or false."""
    return F.when(a.cast("string").isNull() | a.cast("string").isin("", "0", "0.0", "false"), b).otherwise(a)


def chunking_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("semantic"), "semantic").when(low.contains("recursive"), "recursive").when(low.contains("fixed"), "fixedsize").otherwise(c)


def model_abbreviation(c: Column, fallback: str | None = None) -> Column:
    return F.when(c.contains("MiniLM"), "st-mini").when(c.contains("mpnet"), "mpnet").otherwise(F.lit(fallback))


def short_threshold(c: Column) -> Column:
    """s10 for 0.1; what is no number passes as it is."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNotNull(), F.concat(F.lit("s"), F.lpad(F.bround(n * 100, 0).cast("int").cast("string"), 2, "0"))).otherwise(c.cast("string"))


def short_chunking(c: Column) -> Column:
    """fs, rec or sem by a part of the name; other names in lower case."""
    low = F.lower(c.cast("string"))
    return F.when(low.contains("fixed"), "fs").when(low.contains("rec"), "rec").when(low.contains("sem"), "sem").otherwise(low)


#: Part of a model's name, and its short label.
MODELS = {"mistral": "mis7b", "gpt-4o-mini": "g4o-mini", "qwen": "qwen", "llama": "llama"}


def short_model(c: Column) -> Column:
    low, out = F.lower(c.cast("string")), c.cast("string")
    for part, label in reversed(MODELS.items()):
        out = F.when(low.contains(part), label).otherwise(out)
    return out


def number_or_inf(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("inf")))


def is_article_header(c: Column) -> Column:
    return c.rlike(r"(?i)^(artikel\s+\d+|article\s+\d+|art\.\s*\d+|art\s+\d+)")


def is_section_header(c: Column) -> Column:
    return c.rlike(r"(?i)^(kapitel|chapter|abschnitt|section)\s+\d+")


def is_subsection_header(c: Column) -> Column:
    return c.rlike(r"(?i)^(unterabschnitt|subsection|teil|part)\s+\d+")


def article_number(c: Column) -> Column:
    """Number of an article header, null for other text: a separator and a title, or nothing, must follow."""
    return F.nullif(F.regexp_extract(c, r"(?i)^(?:artikel\s+|article\s+|art\.\s*|art\s+)(\d+)(?:[:\s]+.+|\s*$)", 1), F.lit(""))


def article_title(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?i)^(?:artikel\s+|article\s+|art\.\s*|art\s+)\d+[:\s]+(.+)", 1))


def paragraph_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"\((\d+)\)", 1).try_cast("int"), F.lit(0))


def letter_number(c: Column) -> Column:
    """(a) is 1, (b) is 2; 0 without a letter in brackets."""
    hit = F.lower(F.regexp_extract(c, r"(?i)\(([a-z])\)", 1))
    return F.when(hit != "", F.ascii(hit) - 96).otherwise(F.lit(0))


def entry_id(law: str, article: Column, paragraph: Column, sub: Column, sentence: Column) -> Column:
    middle = F.when(sub > 0, F.concat(F.lit("("), sub.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit(f"{law}_art_"), article.cast("string"), F.lit("_abs_"), paragraph.cast("string"), middle, F.lit("_satz_"), sentence.cast("string"))
