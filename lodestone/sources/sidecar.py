"""Parser answers (JSON of pages with labelled blocks) as blocks: labels mapped, heading levels, formulas, tables as grids, boxes."""

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import normalize_box
from lodestone.operators import tables
from lodestone.operators.passages import FIGURE

RAW = "label string, bbox array<double>, text string, html string, latex string, reading_order double"
PAYLOAD = f"n_pages int, pages array<struct<page_index:int,image_width:double,image_height:double,blocks:array<struct<{', '.join(c.replace(' ', ':', 1) for c in RAW.split(', '))}>>>>"


@dataclass(frozen=True)
class Labels:
    """A parser's labels in lower case and the block types they stand for (others are skipped), and levels of heading labels."""

    types: dict[str, str]
    levels: dict[str, int] = field(default_factory=dict)
    level: int = 2  #: of a heading whose label has none


LABELS = Labels(
    {
        "title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list": "list_item", "list_item": "list_item", "table": "table", "figure": "figure", "picture": "figure",
        "caption": "caption", "formula": "formula", "code": "code", "header": "header_footer", "footer": "header_footer", "footnote": "footnote",
    },
    {"title": 1},
)


def _tables(html: pd.Series) -> pd.DataFrame:
    found = [tables.first_table(x) for x in html]
    return pd.DataFrame({"cells": [x[0] for x in found], "has_header": [x[1] for x in found]})


def document_blocks(answers: DataFrame, key: str, payload: str, labels: Labels = LABELS) -> DataFrame:
    """(doc_id, ord, block_id, block_type, level, page, box, text, cells, has_header, figure) of the answers, one a row.

    Pages come in their order, blocks of a page by reading_order (0 if it has none) and then as they stand. A formula's text is
    its latex, else its text; only headings have levels, only tables cells. A malformed or null answer has no blocks."""
    pages = answers.select(F.col(key).alias("doc_id"), F.posexplode(F.from_json(payload, PAYLOAD)["pages"]).alias("nth", "p"))
    raw = pages.select("doc_id", "nth", F.coalesce("p.page_index", F.lit(0)).alias("page"), F.coalesce("p.image_width", F.lit(0.0)).alias("w"), F.coalesce("p.image_height", F.lit(0.0)).alias("h"), F.posexplode("p.blocks").alias("place", "b"))
    label = F.lower(F.trim("b.label"))
    kind = F.coalesce(*[F.when(label == k, t) for k, t in labels.types.items()])
    level = F.coalesce(*[F.when(label == k, n) for k, n in labels.levels.items()], F.lit(labels.level))
    rows = raw.withColumns({"block_type": kind, "level": F.when(kind == "heading", level).cast("int")}).where("block_type IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("nth", F.coalesce("b.reading_order", F.lit(0.0)), "place")
    rows = rows.withColumn("ord", (F.row_number().over(order) - 1).cast("int"))
    is_ = lambda name: F.col("block_type") == name
    said = F.nullif(F.col("b.text"), F.lit(""))
    text = F.when(is_("formula"), F.coalesce(F.nullif(F.col("b.latex"), F.lit("")), said)).when(~F.col("block_type").isin("table", "figure"), said)
    empty = F.lit(None).cast("string")
    figure = F.when(is_("figure"), F.struct(empty.alias("description"), empty.alias("ocr_text"), F.lit(None).cast(tables.GRID).alias("data"))).cast(FIGURE)
    read = F.pandas_udf(_tables, f"cells {tables.GRID}, has_header boolean")
    rows = rows.withColumn("t", read(F.when(is_("table"), F.col("b.html"))))
    block_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.concat(F.lit("p"), "page"), F.concat(F.lit("b"), "ord"))
    return rows.select("doc_id", "ord", block_id.alias("block_id"), "block_type", "level", "page", normalize_box(F.col("b.bbox"), "w", "h").alias("box"), text.alias("text"), "t.cells", F.when(F.col("t.cells").isNotNull(), F.col("t.has_header")).alias("has_header"), figure.alias("figure"))


# Labels of layout items and the block types they stand for.
ITEMS = {
    "title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "table": "table", "picture": "figure", "figure": "figure", "chart": "figure",
    "caption": "caption", "code": "code", "formula": "formula", "page_header": "header_footer", "page_footer": "header_footer",
}
ITEM = "label:string,level:int,text:string,page_no:int,bbox:struct<l:double,t:double,r:double,b:double,origin:string>"


def item_blocks(answers: DataFrame, key: str, payload: str) -> DataFrame:
    """(doc_id, ord, block_type, level, page, box, text) of layout items (JSON with pages by number and items in reading order).

    A title is level 1, a section header one more than its own level. Pages count from 0. A box from the lower left corner is
    turned over; without a page size its numbers are shares already; a box that is not finite, or none, is the whole page."""
    shape = f"pages map<string,struct<width:double,height:double>>, items array<struct<{ITEM}>>"
    rows = answers.select(F.col(key).alias("doc_id"), F.from_json(payload, shape).alias("a")).select("doc_id", "a.pages", F.posexplode("a.items").alias("place", "x"))
    label = F.lower(F.trim("x.label"))
    kind = F.coalesce(*[F.when(label == k, t) for k, t in ITEMS.items()])
    rows = rows.withColumn("block_type", kind).where("block_type IS NOT NULL")
    size = F.try_element_at("pages", F.col("x.page_no").cast("string"))
    side = lambda c: F.when(size[c] > 0, size[c]).otherwise(1.0)
    upside = F.upper(F.coalesce("x.bbox.origin", F.lit("BOTTOMLEFT"))).contains("BOTTOM")
    y = lambda c: F.when(upside, side("height") - F.col(f"x.bbox.{c}")).otherwise(F.col(f"x.bbox.{c}"))
    box = normalize_box(F.array(F.col("x.bbox.l"), y("t"), F.col("x.bbox.r"), y("b")), side("width"), side("height"))
    level = F.when(F.col("block_type") == "heading", F.coalesce(F.col("x.level") + 1, F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("place")
    return rows.select("doc_id", (F.row_number().over(order) - 1).cast("int").alias("ord"), "block_type", level.cast("int").alias("level"), F.greatest(F.coalesce("x.page_no", F.lit(1)) - 1, F.lit(0)).alias("page"), box.alias("box"), F.nullif(F.col("x.text"), F.lit("")).alias("text"))
