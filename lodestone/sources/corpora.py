"""Question answering corpora as tables: sectioned papers as HTML pages, and their questions with evidence.

Rows of a corpus (JSON lines of papers, as public corpora of this kind have them): title, full_text with section_name and
paragraphs (a list a section), qas with question and answers (a list a question, of answers with unanswerable and evidence).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.tables import escaped

ROW = (
    "id string, title string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, "
    "qas struct<question:array<string>,answers:array<struct<answer:array<struct<unanswerable:boolean,evidence:array<string>>>>>>"
)
FLOAT = "FLOAT SELECTED"  #: begins evidence that is a figure or a table
LEAST_WORDS = 5  #: words of usable evidence


def read(spark: SparkSession, path: str) -> DataFrame:
    """Papers from files of JSON lines."""
    return spark.read.schema(ROW).json(path)


def _tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.replace(escaped(F.trim(c)), F.lit("'"), F.lit("&#x27;")), F.lit(f"</{name}>"))


def pages(papers: DataFrame) -> DataFrame:
    """(id, html): the title as h1, each named section as h2, each paragraph as p; blank ones are left out."""
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    empty = F.array().cast("array<string>")
    sections = F.arrays_zip(F.coalesce("full_text.section_name", empty).alias("name"), F.coalesce("full_text.paragraphs", F.array().cast("array<array<string>>")).alias("texts"))

    def section(s: Column) -> Column:
        head = F.when(said(s["name"]), F.array(_tag("h2", s["name"]))).otherwise(empty)
        return F.concat(head, F.transform(F.filter(F.coalesce(s["texts"], empty), said), lambda p: _tag("p", p)))

    rows = papers.select("id", F.coalesce("title", F.lit("")).alias("t"), sections.alias("s"))
    first = F.concat(F.lit("<!doctype html><html><head>"), _tag("title", F.col("t")), F.lit("</head><body>"))
    lines = F.concat(F.array(first, _tag("h1", F.col("t"))), F.flatten(F.transform("s", section)), F.array(F.lit("</body></html>")))
    return rows.select("id", F.array_join(lines, "\n").alias("html"))


def questions(papers: DataFrame) -> DataFrame:
    """(id, number, question, evidences): questions that have an answer with evidence in text, without repeats; figures, tables and
    passages of a few words are none."""
    pairs = papers.select("id", F.posexplode(F.arrays_zip(F.col("qas.question").alias("q"), F.col("qas.answers").alias("a"))).alias("number", "x"))
    answers = F.filter(F.coalesce("x.a.answer", F.array().cast("array<struct<unanswerable:boolean,evidence:array<string>>>")), lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)))
    every = F.flatten(F.transform(answers, lambda a: F.coalesce(a["evidence"], F.array().cast("array<string>"))))
    usable = F.filter(every, lambda e: e.isNotNull() & ~e.contains(FLOAT) & (F.size(F.filter(F.split(e, r"\s+"), lambda w: w != "")) >= LEAST_WORDS))
    rows = pairs.select("id", "number", F.trim("x.q").alias("question"), F.array_distinct(F.transform(usable, lambda e: F.trim(e))).alias("evidences"))
    return rows.where((F.coalesce("question", F.lit("")) != "") & (F.size("evidences") > 0))


def answerable(papers: DataFrame) -> DataFrame:
    """The papers with a question that counts."""
    return papers.join(questions(papers).select("id").distinct(), "id", "left_semi")
