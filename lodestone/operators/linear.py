"""Whole documents as Markdown or HTML, from their blocks: captions in their tables and figures, list items as lists, page furniture out."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import tables
from lodestone.operators.passages import FIGURE, LEVELS, with_captions


def _blank(c: Column | str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _level() -> Column:
    return F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))


def _prose() -> Column:
    """A figure's caption and own text."""
    return F.nullif(F.concat_ws(" ", _blank("caption"), _blank("text")), F.lit(""))


def _markdown_part() -> Column:
    kind, text = F.col("block_type"), _blank("text")
    wrap = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    grid = F.concat_ws("\n", wrap("*", _blank("caption"), "*"), tables.markdown("cells", F.coalesce("has_header", F.lit(False))))
    figure = F.concat_ws("\n\n", wrap("*", _prose(), "*"), _blank("figure.description"), _blank("figure.ocr_text"), tables.markdown(F.col("figure.data")))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), _level()), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "table", grid)
        .when(kind == "figure", figure)
        .when(kind == "caption", wrap("*", text, "*"))
        .when(kind == "code", wrap("```\n", F.when(text.isNotNull(), F.col("text")), "\n```"))
        .when(kind == "formula", wrap("$$\n", text, "\n$$"))
        .otherwise(text)
    )


def _html_part() -> Column:
    kind, text = F.col("block_type"), F.when(_blank("text").isNotNull(), tables.escaped(F.trim("text")))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    said = lambda c: F.when(_blank(c).isNotNull(), tables.escaped(F.trim(c)))
    emphasis = lambda c: tag("p", tag("em", said(c)))
    level = F.concat(F.lit("h"), _level().cast("string"))
    body = F.concat_ws("", tag("p", said("figure.description")), tag("p", said("figure.ocr_text")), tables.html(F.col("figure.data")), tag("figcaption", said(_prose())))
    return (
        F.when(kind == "heading", F.concat(F.lit("<"), level, F.lit(">"), text, F.lit("</"), level, F.lit(">")))
        .when(kind == "list_item", tag("li", text))
        .when(kind == "table", F.coalesce(tables.html("cells", F.coalesce("has_header", F.lit(False)), F.coalesce("caption", F.lit(""))), emphasis("caption")))
        .when(kind == "figure", tag("figure", F.nullif(body, F.lit(""))))
        .when(kind == "caption", emphasis("text"))
        .when(kind == "code", tag("pre", tag("code", F.when(text.isNotNull(), tables.escaped(F.col("text"))))))
        .when(kind == "formula", tag("p", text))
        .otherwise(tag("p", text))
    )


def _linear(blocks: DataFrame, part: Column, name: str, between: str, item: str, begin: str, end: str) -> DataFrame:
    rows = blocks
    for column, kind in (("cells", tables.GRID), ("has_header", "boolean"), ("figure", FIGURE)):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    rows = with_captions(rows).where((F.col("block_type") != "header_footer") & ~F.col("consumed"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    # neighbours in a list are told before empty parts are left out
    is_item = F.col("block_type") == "list_item"
    rows = rows.select("doc_id", "ord", part.alias("part"), is_item.alias("item"), F.sum(F.when(is_item, 0).otherwise(1)).over(w).alias("list"))
    rows = rows.where(F.coalesce("part", F.lit("")) != "")
    segment = F.when(F.col("item"), F.col("list")).otherwise(-F.col("ord") - 1)
    rows = rows.groupBy("doc_id", segment.alias("segment"), "item").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), item)
    rows = rows.select("doc_id", "ord", F.when(F.col("item"), F.concat(F.lit(begin), text, F.lit(end))).otherwise(text).alias("text"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), between).alias(name))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown) of every document that has something to show."""
    return _linear(blocks, _markdown_part(), "markdown", "\n\n", "\n", "", "")


def to_html(blocks: DataFrame) -> DataFrame:
    """(doc_id, html): the body of every document that has something to show."""
    return _linear(blocks, _html_part(), "html", "\n", "", "<ul>", "</ul>")


def html_page(rows: DataFrame, title: str = "title", language: str = "language") -> DataFrame:
    """rows with html as a whole page that names its character set, language and title."""
    lang = F.when(F.coalesce(_blank(language), F.lit("")) != "", F.concat(F.lit(' lang="'), tables.escaped(F.col(language)), F.lit('"'))).otherwise("")
    name = tables.escaped(F.coalesce(_blank(title), F.lit("Document")))
    return rows.withColumn("html", F.concat(F.lit("<!DOCTYPE html>\n<html"), lang, F.lit('>\n<head>\n<meta charset="utf-8">\n<title>'), name, F.lit("</title>\n</head>\n<body>\n"), F.col("html"), F.lit("\n</body>\n</html>")))
