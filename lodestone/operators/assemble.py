"""Putting content together: page ranges, orphan headings, anchors, scopes, views, payloads, reranking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import normalize_box
from lodestone.operators.tables import markdown as markdown_grid  # noqa: F401  its former place


def page_numbers(selector: str, pages: int) -> list[int]:
    """The pages (from 1) that a selector such as `5,7-9` names; ValueError says what is wrong with it."""
    out: set[int] = set()
    for part in selector.split(","):
        low, _, high = (x.strip() for x in part.partition("-"))
        if not low.isdigit() or "-" in part and not high.isdigit():
            raise ValueError(f"{part.strip()!r} is neither a page nor a range")
        first, last = int(low), int(high or low)
        if not 1 <= first <= last <= pages:
            raise ValueError(f"{part.strip()} is not within 1 to {pages}")
        out |= {*range(first, last + 1)}
    return sorted(out)


def absorb_headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of body blocks, with the headings right before each joined to it; headings that end a document join
    its last body block, and a document of headings only is one block."""
    body = F.col("block_type") != "heading"
    w = Window.partitionBy("doc_id").orderBy("ord")
    own = F.when(body, F.col("ord"))
    ahead = F.min(own).over(w.rowsBetween(0, Window.unboundedFollowing))
    last, first = F.max(own).over(Window.partitionBy("doc_id")), F.min("ord").over(Window.partitionBy("doc_id"))
    rows = blocks.select("doc_id", "ord", "text", F.coalesce(ahead, last, first).alias("into"))
    parts = rows.groupBy("doc_id", F.col("into").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return parts.select("doc_id", "ord", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def anchored(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """chunks with context: the document's anchor (doc_id, anchor), unless it is the chunk's own first line."""
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    anchor = F.when(F.trim("anchor") != first, F.trim("anchor"))
    return chunks.join(anchors, "doc_id", "left").withColumn("context", F.coalesce(anchor, F.lit(""))).drop("anchor")


def document_anchors(documents: DataFrame, chunks: DataFrame, headings: DataFrame | None = None, title: str = "title", fall_back: bool = True) -> DataFrame:
    """(doc_id, anchor): the declared title, else the first heading of the first chunk's path, else the document's first heading
    (doc_id, title); null if there is none. Blank titles do not count."""
    rows = documents.select("doc_id", F.nullif(F.trim(title), F.lit("")).alias("declared"))
    if not fall_back:
        return rows.select("doc_id", F.col("declared").alias("anchor"))
    first = chunks.groupBy("doc_id").agg(F.min_by(F.get("heading_path", F.lit(0)), "chunk").alias("__path"))
    rows = rows.join(first, "doc_id", "left")
    if headings is None:
        return rows.select("doc_id", F.coalesce("declared", F.nullif(F.trim("__path"), F.lit(""))).alias("anchor"))
    rows = rows.join(headings.select("doc_id", F.col("title").alias("__first")), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("declared", F.nullif(F.trim("__path"), F.lit("")), "__first").alias("anchor"))


def _capped(text: Column, words: int) -> Column:
    """A text of at most so many words as it is, else its first words."""
    ws = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.when(F.size(ws) <= words, text).otherwise(F.array_join(F.slice(ws, F.lit(1), F.lit(words)), " "))


def scoped(chunks: DataFrame, scope: str, reach: int = 2, words: int = 4000) -> DataFrame:
    """chunks with scope, the text that a model reads to place a chunk: the whole document (full), the chunks of the same section
    (section; those without one take the window), or the chunks at most `reach` places away (window); `words` words at most."""
    if scope not in ("full", "section", "window"):
        raise ValueError("the scope is full, section or window")
    near = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(-reach, reach)
    window = F.array_join(F.collect_list("text").over(near), "\n\n")
    if scope == "window":
        return chunks.withColumn("scope", _capped(window, words))
    # one text for all chunks that share it, made once and joined back
    own = ["doc_id"] if scope == "full" else ["doc_id", "heading_path"]
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    whole = chunks.groupBy(*own).agg(_capped(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), words).alias("scope"))
    if scope == "full":
        return chunks.join(whole, "doc_id")
    rows = chunks.withColumn("__window", F.when(F.coalesce(F.size("heading_path"), F.lit(0)) == 0, _capped(window, words)))
    rows = rows.join(whole.where(F.size("heading_path") > 0), own, "left")
    return rows.withColumn("scope", F.coalesce("__window", "scope")).drop("__window")


def window_scope(chunks: DataFrame, reach: int) -> DataFrame:
    """chunks with scope: the texts of the chunks at most `reach` places away, in order."""
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(-reach, reach)
    return chunks.withColumn("scope", F.array_join(F.collect_list("text").over(w), "\n\n"))


def zipped(chunks: DataFrame, completions: DataFrame) -> DataFrame:
    """chunks with what came back for each by place; an empty or missing completion leaves the raw text."""
    rows = chunks.join(completions, ["doc_id", "chunk"], "left")
    return rows.withColumn("text", F.coalesce(F.nullif(F.trim("completion"), F.lit("")), F.col("text"))).drop("completion")


def head_and_tail(c: Column | str, head: int, tail: int) -> Column:
    """The first and the last words of a text, with a mark between them where words are left out."""
    ws = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    cut = F.concat_ws(" ", F.array_join(F.slice(ws, F.lit(1), F.lit(head)), " "), F.lit("…"), F.array_join(F.slice(ws, F.size(ws) - tail + 1, F.lit(tail)), " "))
    return F.when(F.size(ws) <= head + tail, F.array_join(ws, " ")).otherwise(cut)


def has_content(c: Column | str) -> Column:
    """Whether a text says more than bare image marks."""
    return F.trim(F.regexp_replace(c, r"(?m)^\s*\[Image: [^\]\n]*\]\s*$", "")) != ""


def field_values(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of each field that has a value; lists are joined by commas."""
    kinds = dict(rows.dtypes)
    text = lambda f: F.array_join(f, ", ") if kinds[f].startswith("array") else F.col(f).cast("string")
    pairs = F.array(*[F.struct(F.lit(f"meta_{f}").alias("field"), text(f).alias("value")) for f in fields])
    return rows.select(key, F.inline(pairs)).where(F.coalesce(F.trim("value"), F.lit("")) != "")


PAYLOAD = "page int, width double, height double, blocks array<struct<label:string,bbox:array<double>,text:string>>"
#: Labels of a sidecar parser and the block types they stand for; blocks of any other label are skipped.
LABELS = {"text": "paragraph", "paragraph": "paragraph", "title": "heading", "section_header": "heading", "list": "list_item", "table": "table", "figure": "figure", "header": "header_footer", "footer": "header_footer"}


def sidecar_blocks(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ord, page, block_type, box, text) of JSON payloads, a page a row; boxes as shares of the page."""
    page = payloads.select(key, F.from_json(payload, PAYLOAD).alias("p")).where("p IS NOT NULL")
    rows = page.select(key, "p.page", "p.width", "p.height", F.posexplode("p.blocks").alias("ord", "b"))
    kind = F.coalesce(*[F.when(F.lower("b.label") == k, F.lit(v)) for k, v in LABELS.items()])
    return rows.where(kind.isNotNull()).select(key, "page", "ord", kind.alias("block_type"), normalize_box(F.col("b.bbox"), "width", "height").alias("box"), "b.text")


def natural_key(c: Column | str) -> Column:
    """Sorts a path with its numbers by value: every run of digits is padded to twenty places."""
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def source_kind(scanned: Column, pages: Column) -> Column:
    """What a document was made from, by its scanned pages."""
    return F.when(scanned == 0, "digital_born").when(scanned == pages, "scanned").otherwise("mixed")


def point_id(namespace: str, name: Column | str) -> Column:
    """The UUID (version 5) of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def reranked(hits: DataFrame, score: Column, top_k: int, least: int = 50) -> DataFrame:
    """The max(least, top_k) best hits of each query by fusion, ranked anew: score becomes fusion_score, the new score is
    `score`; where it is null (the scorer failed) a query keeps its fusion order. hits: query_id, doc_id, score, rank."""
    some = hits.where(F.col("rank") <= max(least, top_k)).withColumnRenamed("score", "fusion_score").withColumn("score", score)
    whole = Window.partitionBy("query_id")
    failed = F.max(F.col("score").isNull()).over(whole)
    rows = some.withColumn("score", F.when(failed, F.col("fusion_score")).otherwise(F.col("score")))
    order = whole.orderBy(F.desc("score"), "rank")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)


def stale_points(old: DataFrame, new: DataFrame, document: str, key: str) -> DataFrame:
    """Points of the re-indexed documents that the new run no longer has."""
    return old.join(new.select(document).distinct(), document, "left_semi").join(new.select(document, key), [document, key], "left_anti")
