"""Passages: what every chunker starts from. A block with its section, its role, and what belongs to it.

blocks: doc_id, ord (reading order), block_type, level, page, text; cells and has_header of tables and figure (description,
ocr_text, data) of figures may be there. All steps work over one shuffle by doc_id: sections, captions and roles are windows
over a document's blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import count_tokens, normalize
from lodestone.operators import blocks as furniture
from lodestone.operators import tables

LEVELS = 6
FIGURE = "struct<description:string,ocr_text:string,data:array<array<string>>>"
UNITS = ("figure", "table")


def with_sections(blocks: DataFrame) -> DataFrame:
    """blocks with heading_path (the texts of the open headings, top down) and section_key (their ords). A heading belongs to
    its own section. A heading closes all of its level and below, so the open one of a level is the last that no higher one
    follows; levels beyond LEVELS count as LEVELS, no level as 1."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("block_type") == "heading"
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    heading = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))
    rows, open_ = blocks, []
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"__at{k}", F.max(F.when(head & (level == k), heading)).over(w))
        higher = [F.col(f"__at{j}.ord") for j in range(1, k)]
        closed = F.greatest(*higher, F.lit(-1), F.lit(-1)) if higher else F.lit(-1)
        open_.append(F.when(F.col(f"__at{k}.ord") > closed, F.col(f"__at{k}")))
    path = F.array_compact(F.array(*open_))
    rows = rows.withColumn("__path", path)
    out = rows.withColumns({"heading_path": F.transform("__path", lambda h: h["text"]), "section_key": F.transform("__path", lambda h: h["ord"])})
    return out.drop("__path", *[f"__at{k}" for k in range(1, LEVELS + 1)])


def with_captions(blocks: DataFrame) -> DataFrame:
    """blocks with caption (text) and caption_ord for each figure or table that has one, and consumed for each caption that one has.

    A caption goes to the figure or table right after it, else to the one right before it unless that has a caption. The one
    before can have one already only from the caption before that, whose next it is; so two places each way decide."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    caption = (F.col("block_type") == "caption") & (F.trim("text") != "")
    rows = blocks.withColumns({"__c": F.coalesce(caption, F.lit(False)), "__u": F.col("block_type").isin(*UNITS)})
    near = lambda c, n: F.coalesce(F.lead(c, n).over(w) if n > 0 else F.lag(c, -n).over(w), F.lit(False))
    above = F.col("__u") & near("__c", -1)
    below = F.col("__u") & ~near("__c", -1) & near("__c", 1) & ~near("__u", 2)
    pick = lambda c: F.when(above, F.lag(c).over(w)).when(below, F.lead(c).over(w))
    consumed = F.col("__c") & (near("__u", 1) | (near("__u", -1) & ~near("__c", -2)))
    return rows.withColumns({"caption": F.trim(pick("text")), "caption_ord": pick("ord"), "caption_page": pick("page"), "consumed": consumed}).drop("__c", "__u")


def with_roles(blocks: DataFrame, pages: int = 3, run: int = 3) -> DataFrame:
    """blocks (with heading_path) with role: header_footer, then toc (any open heading is a title of contents), then text that
    stands on several pages or chrome as boilerplate, then body. A heading is no chrome."""
    role = (
        F.when(F.col("block_type") == "header_footer", "header_footer")
        .when(F.exists("heading_path", lambda h: F.lower(F.trim(h)).isin(*furniture.TOC_TITLES)), "toc")
        .when(F.col("repeated") | F.col("chrome") | F.col("in_run"), "boilerplate")
        .otherwise("body")
    )
    return furniture.with_signals(blocks, pages, run).withColumn("role", role).drop("repeated", "chrome", "in_run")


def figure_text(figure: str = "figure", caption: str = "caption", text: str = "text") -> Column:
    """A figure's caption and own text, description, text read from it and data, each part that says something on lines of its
    own; null if none does."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = F.nullif(F.concat_ws(" ", blank(F.col(caption)), blank(F.col(text))), F.lit(""))
    read = F.concat(F.lit("[OCR] "), blank(F.col(f"{figure}.ocr_text")))
    data = F.concat(F.lit("[Data]\n"), tables.markdown(F.col(f"{figure}.data")))
    return F.nullif(F.concat_ws("\n", head, blank(F.col(f"{figure}.description")), read, data), F.lit(""))


def passages(blocks: DataFrame, keep_tables: bool = True, keep_figures: bool = True) -> DataFrame:
    """(doc_id, ord, text, block_ords, heading_path, section_key, atomic, tokens, role, heading_only, page_start, page_end).

    Tables (as Markdown) and figures are atomic and take in their captions; one that says nothing leaves its caption as text.
    Blocks without text are left out; page furniture stays, with its role."""
    rows = blocks
    for name, kind in (("cells", tables.GRID), ("has_header", "boolean"), ("figure", FIGURE)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = with_roles(with_captions(with_sections(rows)))
    table = F.when(F.lit(keep_tables), tables.markdown("cells", F.coalesce("has_header", F.lit(False))))
    table = F.when(table.isNotNull(), F.concat_ws("\n", "caption", table))
    figure = F.when(F.lit(keep_figures) & F.col("figure").isNotNull(), figure_text())
    unit = F.when(F.col("block_type") == "table", table).when(F.col("block_type") == "figure", figure)
    is_unit = F.col("block_type").isin(*UNITS)
    text = F.when(is_unit, F.coalesce(unit, "caption")).otherwise(F.nullif(F.trim("text"), F.lit("")))
    rows = rows.where(~F.col("consumed")).withColumns({"__text": text, "__atomic": is_unit & unit.isNotNull()}).where("__text IS NOT NULL")
    return rows.select(
        "doc_id", "ord", F.col("__text").alias("text"), F.array_sort(F.array_compact(F.array("caption_ord", "ord"))).alias("block_ords"),
        "heading_path", "section_key", F.col("__atomic").alias("atomic"), count_tokens("__text").alias("tokens"), "role",
        (F.col("block_type") == "heading").alias("heading_only"),
        F.least("page", "caption_page").alias("page_start"), F.greatest("page", "caption_page").alias("page_end"),
    )


def absorb_headings(rows: DataFrame) -> DataFrame:
    """Body passages without bare headings. A heading whose section has other content gives only its block to the next passage:
    the heading path says its text. Any other goes, as text, before the next passage (unless that begins with it), several of them
    line by line without repeats; after the last passage, behind it. A document of bare headings is one passage."""
    doc = Window.partitionBy("doc_id")
    rows = rows.where("role = 'body'")
    content = ~F.col("heading_only")
    # a section has content if a passage under its heading comes before the section's end
    own = F.get("section_key", F.size("section_key") - 1)
    owners = F.array_distinct(F.flatten(F.collect_set(F.when(content, F.col("section_key"))).over(doc)))
    rows = rows.withColumn("__owned", ~content & F.array_contains(owners, own))
    here = F.when(content, F.col("ord"))
    # from the end, since a frame up to the end is added up anew for each row
    ahead = F.min(here).over(Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(here).over(doc)
    rows = rows.withColumns({"__into": F.coalesce(ahead, last, F.min("ord").over(doc)), "__last": last})
    part = F.struct("ord", "text", "heading_only", F.col("__owned").alias("owned"), "block_ords", "page_start", "page_end")
    main = F.struct("text", "heading_path", "section_key", "atomic", "role", "page_start", "page_end", "block_ords", "heading_only")
    parts = rows.groupBy("doc_id", F.col("__into").alias("ord")).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min_by(main, F.struct("heading_only", "ord")).alias("main"))

    orphan = lambda p: p["heading_only"] & ~p["owned"]
    here = F.col("ord")
    out = parts.withColumns({
        "before": _folded(F.filter("parts", lambda p: orphan(p) & (p["ord"] < here))), "after": _folded(F.filter("parts", lambda p: orphan(p) & (p["ord"] > here))),
        "every": _folded(F.filter("parts", lambda p: p["heading_only"])), "carried": F.flatten(F.transform(F.filter("parts", lambda p: p["owned"]), lambda p: p["block_ords"])),
    })
    text, alone = F.col("main.text"), F.col("main.heading_only")
    begins = normalize(F.col("before.text")) == normalize(F.substring_index(text, "\n", 1))
    head = F.when((F.col("before.text") == "") | begins, text).otherwise(F.concat("before.text", F.lit("\n\n"), text))
    out = out.withColumn("text", F.when(alone, F.col("every.text")).when(F.col("after.text") == "", head).otherwise(F.concat(head, F.lit("\n\n"), "after.text")))
    joined = F.filter("parts", lambda p: orphan(p) | ~p["heading_only"])
    return out.select(
        "doc_id", "ord", "text", F.when(alone, F.col("every.ords")).otherwise(F.concat("carried", "before.ords", "main.block_ords", "after.ords")).alias("block_ords"),
        "main.heading_path", "main.section_key", "main.atomic", count_tokens("text").alias("tokens"), "main.role", F.lit(False).alias("heading_only"),
        F.array_min(F.transform(joined, lambda p: p["page_start"])).alias("page_start"), F.array_max(F.transform(joined, lambda p: p["page_end"])).alias("page_end"),
    )


def _folded(headings: Column) -> Column:
    """Headings as one text, a line each, with their blocks; one that repeats all that came before it is left out."""

    def step(acc: Column, p: Column) -> Column:
        more = F.concat_ws("\n", F.nullif(acc["text"], F.lit("")), p["text"])
        return F.when((acc["text"] != "") & (normalize(acc["text"]) == normalize(p["text"])), acc).otherwise(F.struct(more.alias("text"), F.concat(acc["ords"], p["block_ords"]).alias("ords")))

    return F.aggregate(headings, F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("ords")), step)


def common_depth(keys: Column) -> Column:
    """How many leading headings all section keys (array<array<int>>) share."""
    first = F.get(keys, F.lit(0))
    shared = F.filter(F.sequence(F.lit(1), F.size(first)), lambda n: F.forall(keys, lambda k: F.slice(k, F.lit(1), n) == F.slice(first, F.lit(1), n)))
    return F.when(F.size(first) > 0, F.coalesce(F.array_max(shared), F.lit(0))).otherwise(0)


def assembled(items: Column, depth: Column) -> Column:
    """The items' texts, each with the trail of headings below the common depth before it where its section changes."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        rest = F.slice(x["heading_path"], depth + 1, F.greatest(F.size(x["heading_path"]) - depth, F.lit(0)))
        label = F.array_join(F.filter(rest, lambda h: F.trim(h) != ""), " › ")
        says = ~acc["key"].eqNullSafe(x["section_key"]) & (label != "")
        return F.struct(F.concat(acc["parts"], F.when(says, F.array(label)).otherwise(empty), F.array(x["text"])).alias("parts"), x["section_key"].alias("key"))

    start = F.struct(empty.alias("parts"), F.lit(None).cast("array<int>").alias("key"))
    return F.aggregate(items, start, step, lambda acc: F.array_join(acc["parts"], "\n\n"))
