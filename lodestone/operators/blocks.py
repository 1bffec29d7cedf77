"""Blocks of documents: headings, roles of furniture, runs of page chrome, captions, outline, linear forms.

blocks: doc_id, ord (reading order), block_type, level, page, text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalize

# The titles of tables of contents, and the texts of page chrome.
TOC_TITLES = ("contents", "table of contents", "toc", "sommaire", "table des matières", "índice")
CHROME_PHRASES = (
    "no results", "no result", "no results found", "no matching results", "il n'y a pas de résultat", "il n'y a pas de résultats", "aucun résultat",
    "aucun resultat", "faire une recherche complète", "recherche complète", "search", "rechercher", "menu", "navigation", "skip to content",
    "aller au contenu", "back to top", "haut de page",
)
CHROME_PREFIXES = ("rechercher ", "faire une recherche", "search for", "aller au ", "retour au ", "back to ", "skip to ")
SEPARATORS = "[·•|›»∙‧・\\t\\n]+"
EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_']+$"


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A paragraph block for each non-blank line; ten lines make a page."""
    lines = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("ord", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", "ord", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"), (F.col("ord") / 10).cast("int").alias("page"), "text")


def repeated_texts(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """(doc_id, norm): normal forms that stand on at least so many pages of one document."""
    return blocks.select("doc_id", "page", normalize("text").alias("norm")).groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)


def _words(norm: Column) -> Column:
    return F.size(F.split(norm, " "))


def is_chrome(text: str, norm: Column | None = None) -> Column:
    """One block of page chrome: a known phrase and nothing else, a search widget or link in few words, or a row of short labels
    between separators (of which a slash is none: dates and paths have it). norm: the normal form, if it is there already."""
    norm = normalize(text) if norm is None else norm
    key = F.regexp_replace(norm, EDGES, "")
    begins = key.startswith(CHROME_PREFIXES[0])
    for prefix in CHROME_PREFIXES[1:]:
        begins = begins | key.startswith(prefix)
    parts = F.filter(F.transform(F.split(text, SEPARATORS), normalize), lambda x: x != "")
    short = F.filter(parts, lambda x: (_words(x) <= 4) | F.regexp_replace(x, EDGES, "").isin(*CHROME_PHRASES))
    labels = F.col(text).rlike(SEPARATORS) & (_words(norm) <= 40) & (F.size(parts) >= 4) & (F.size(short) >= 0.75 * F.size(parts))
    return key.isin(*CHROME_PHRASES) | (begins & (_words(key) <= 6)) | labels


def is_short(norm: Column) -> Column:
    """A normal form of one to four words."""
    return (norm != "") & (_words(norm) <= 4)


def label_like(text: str) -> Column:
    """What menus are made of: a few words, or chrome by itself."""
    return is_short(normalize(text)) | is_chrome(text)


def chrome_runs(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, ord) of runs of at least so many consecutive label-like blocks; a heading or other text breaks a run."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    marked = blocks.withColumn("label", label_like("text") & F.col("block_type").isin("paragraph", "list_item", "code"))
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("ord"))
    runs = marked.withColumn("island", island).where("label")
    return runs.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "island"))).where(F.col("n") >= least).select("doc_id", "ord")


def with_signals(blocks: DataFrame, pages: int = 3, run: int = 3) -> DataFrame:
    """blocks with what tells furniture: repeated (its normal form, not blank, stands on so many pages of the document), chrome (by itself
    and no heading) and in_run (of so many label-like blocks in a row). All of it is windows over one shuffle by document."""
    candidate = F.col("block_type").isin("paragraph", "list_item", "code")
    rows = blocks.repartition("doc_id")  # the windows' own shuffle, before the work on texts instead of after it
    rows = rows.withColumn("__norm", F.coalesce(normalize("text"), F.lit("")))
    rows = rows.withColumn("__chrome", F.coalesce(is_chrome("text", F.col("__norm")), F.lit(False)))
    rows = rows.withColumn("__label", (F.col("__chrome") | is_short(F.col("__norm"))) & candidate)
    order, own = Window.partitionBy("doc_id").orderBy("ord"), Window.partitionBy("doc_id", "__label").orderBy("ord")
    rows = rows.withColumn("__island", F.row_number().over(order) - F.row_number().over(own))
    in_run = F.col("__label") & (F.count("*").over(Window.partitionBy("doc_id", "__label", "__island")) >= run)
    stands = F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "__norm")))
    rows = rows.withColumns({"in_run": in_run, "repeated": (F.col("__norm") != "") & (stands >= pages), "chrome": F.col("__chrome") & (F.col("block_type") != "heading")})
    return rows.drop("__norm", "__chrome", "__label", "__island")


def roles(blocks: DataFrame) -> DataFrame:
    """blocks with role: header_footer, then a heading of contents as toc, then repeated text, then chrome, then body; a heading is no chrome.
    passages.with_roles takes in all that stands below a heading of contents."""
    contents = (F.col("block_type") == "heading") & F.lower(F.trim("text")).isin(*TOC_TITLES)
    role = (
        F.when(F.col("block_type") == "header_footer", "header_footer")
        .when(contents, "toc")
        .when(F.col("repeated") | F.col("chrome") | F.col("in_run"), "boilerplate")
        .otherwise("body")
    )
    return with_signals(blocks).withColumn("role", role).drop("repeated", "chrome", "in_run")


def enabled(override: str, role: str) -> Column:
    return F.coalesce(F.col(override), F.col(role) == "body")


def quality(blocks: DataFrame) -> DataFrame:
    """(doc_id, score): share of blocks with text."""
    return blocks.groupBy("doc_id").agg(F.round(F.avg(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)).cast("double")), 6).alias("score"))


def first_heading(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first level-1 heading, else the first heading; blank ones and those of contents do not count."""
    h = blocks.where((F.col("block_type") == "heading") & (F.trim("text") != "") & ~F.lower(F.trim("text")).isin(*TOC_TITLES))
    return h.groupBy("doc_id").agg(F.min_by(F.trim("text"), F.struct(F.when(F.col("level") == 1, 0).otherwise(1), "ord")).alias("title"))


def heading_tree(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """blocks with parent: the ord of the nearest earlier heading of a lower level that no heading in between closes.

    A heading at level l closes all deeper ones, so the open heading of level k is the last at k unless a later heading
    has a level below k.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("level", F.lit(1))
    head = F.col("block_type") == "heading"
    rows, candidates = blocks, []
    for k in range(1, levels + 1):
        at = F.max(F.when(head & (level == k), F.col("ord"))).over(w)
        closed = F.max(F.when(head & (level < k), F.col("ord"))).over(w)
        rows = rows.withColumns({f"__at{k}": at, f"__closed{k}": closed})
        open_ = F.col(f"__at{k}").isNotNull() & (F.col(f"__closed{k}").isNull() | (F.col(f"__closed{k}") < F.col(f"__at{k}")))
        candidates.append(F.when(open_ & (~head | (F.lit(k) < level)), F.col(f"__at{k}")))
    return rows.withColumn("parent", F.coalesce(*candidates[::-1])).drop(*[f"__{x}{k}" for k in range(1, levels + 1) for x in ("at", "closed")])


def outline(headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, ord, text, chunk): each heading with the first chunk that reaches it (a forward as-of join).

    The next chunk at or after a place is the least last_ord from there on, so one window over both replaces the range join.
    """
    h = headings.select("doc_id", "ord", "text", F.lit(None).cast("long").alias("chunk"), F.lit(0).alias("kind"))
    c = chunks.select("doc_id", F.col("last_ord").alias("ord"), F.lit(None).cast("string").alias("text"), F.col("chunk").cast("long"), F.lit(1).alias("kind"))
    ahead = Window.partitionBy("doc_id").orderBy("ord", "kind").rowsBetween(0, Window.unboundedFollowing)
    return h.unionByName(c).withColumn("reach", F.min("chunk").over(ahead)).where("kind = 0").select("doc_id", "ord", "text", F.col("reach").alias("chunk"))


def chunk_window(chunks: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """(doc_id, target, chunk): up to so many enabled neighbours on each side of a target, skipping disabled ones."""
    on = chunks.where("enabled").select("doc_id", "chunk")
    near = on.join(targets.select("doc_id", F.col("chunk").alias("target")), "doc_id")
    side = F.signum(F.col("chunk") - F.col("target"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "target", side).orderBy(F.abs(F.col("chunk") - F.col("target"))))
    return near.withColumns({"side": side, "nth": nth}).where(((F.col("side") < 0) & (F.col("nth") <= before)) | ((F.col("side") > 0) & (F.col("nth") <= after)) | (F.col("side") == 0)).select("doc_id", "target", "chunk")


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings of level 1 to 6, list items, code fences; page furniture is left out."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    part = (
        F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("text")))
        .when(F.col("block_type") == "list_item", F.concat(F.lit("- "), F.trim("text")))
        .when(F.col("block_type") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.trim("text"))
    )
    rows = blocks.where("block_type <> 'header_footer'").select("doc_id", F.struct("ord", part.alias("part"), (F.col("block_type") == "list_item").alias("item")).alias("b"))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # one document's blocks
    joined = F.aggregate("bs", F.lit(""), lambda acc, b: F.concat(acc, F.when(acc == "", "").when(b["item"] & acc.rlike(r"(^|\n)- [^\n]*$"), "\n").otherwise("\n\n"), b["part"]))
    return parts.select("doc_id", joined.alias("markdown"))


def to_html(blocks: DataFrame) -> DataFrame:
    """(doc_id, html): escaped blocks in their elements."""
    escaped = F.replace(F.replace(F.replace(F.trim("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("block_type") == "heading", F.concat(F.lit("h"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string"))).when(F.col("block_type") == "list_item", "li").when(F.col("block_type") == "code", "pre").otherwise("p")
    part = F.concat(F.lit("<"), tag, F.lit(">"), escaped, F.lit("</"), tag, F.lit(">"))
    rows = blocks.where("block_type <> 'header_footer'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("bs"))
    return rows.select("doc_id", F.concat(F.lit("<article>"), F.array_join(F.transform("bs", lambda b: b["part"]), ""), F.lit("</article>")).alias("html"))
