"""Figures: what is to be read of them, their kinds by geometry and by answers, where each kind goes, and what comes back.

blocks: doc_id, ord, block_type, figure; crop (PNG bytes), box (shares of the page) and language may be there.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import clamp

# Kinds of figures, the family of readers that each goes to, and what a classifier is told of it.
ROUTES = {
    "photo": ("vlm", "a photograph or natural illustration"),
    "scanned_text": ("ocr", "an image that is mostly printed or handwritten TEXT (a scanned page/region)"),
    "chart": ("vlm", "a data visualisation (bar/line/pie chart, plot)"),
    "diagram": ("vlm", "a schematic (architecture, flowchart, circuit, map)"),
    "decorative": (None, "a logo, separator, banner or ornament with no informative content"),
}
FULL_PAGE, LEAST_SIDE = 0.85, 48  #: share of the page from which a crop is a scan; pixels under which it is an ornament
SURE, GUESSED = 0.9, 0.3  #: scores of what geometry says, and of what no answer said


def png_size(image: Column | str) -> Column:
    """struct<width, height> of a PNG by its header; null if it is none."""
    c = F.col(image) if isinstance(image, str) else image
    side = lambda at: F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("long")
    png = (F.length(c) >= 24) & (F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A")
    return F.when(png, F.struct(side(17).alias("width"), side(21).alias("height")))


def figure_items(blocks: DataFrame, default_language: str = "") -> DataFrame:
    """(doc_id, ord, crop, coverage, language) of the figures that have a crop; coverage is the box's share of the page."""
    side = lambda a, b: F.abs(F.get("box", F.lit(b)) - F.get("box", F.lit(a)))
    rows = blocks.where((F.col("block_type") == "figure") & F.col("crop").isNotNull())
    return rows.select("doc_id", "ord", "crop", clamp(F.coalesce(side(0, 2) * side(1, 3), F.lit(0.0))).alias("coverage"), F.coalesce("language", F.lit(default_language)).alias("language"))


def kind_of_answer(answer: Column | str) -> Column:
    """The first kind whose name stands in an answer; null if none does."""
    said = F.lower(answer)
    return F.coalesce(*[F.when(said.contains(k), k) for k in ROUTES])


def classify(items: DataFrame, answer: Callable[[DataFrame], DataFrame] | None = None, full_page: float = FULL_PAGE, least_side: int = LEAST_SIDE) -> DataFrame:
    """items with kind and kind_score: a crop of most of the page is scanned text, a very small one decorative. The others go to
    `answer`, which adds a column of that name (a model's word); without a usable word they are photos with a low score."""
    size = png_size("crop")
    sure = F.when(F.col("coverage") >= full_page, "scanned_text").when(F.least(size["width"], size["height"]) < least_side, "decorative")
    rows = items.withColumn("__sure", sure)
    known, open_ = rows.where("__sure IS NOT NULL"), rows.where("__sure IS NULL")
    open_ = answer(open_) if answer else open_.withColumn("answer", F.lit(None).cast("string"))
    every = known.withColumn("answer", F.lit(None).cast("string")).unionByName(open_.select(*rows.columns, "answer"))
    said = kind_of_answer("answer")
    kind = F.coalesce("__sure", said, F.lit("photo"))
    score = F.when(F.col("__sure").isNotNull(), SURE).when(said.isNotNull(), 1.0).otherwise(GUESSED)
    return every.withColumns({"kind": kind, "kind_score": score}).drop("__sure", "answer")


def routed(items: DataFrame) -> DataFrame:
    """items with family, which readers get them: ocr, vlm, or null for those that are skipped."""
    family = F.coalesce(*[F.when(F.col("kind") == k, f) for k, (f, _) in ROUTES.items() if f])
    return items.withColumn("family", family)


def entries(items: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, ord, kind, ocr_text, description, data): each branch closed with what its readers gave. read adds ocr_text to the
    items of the ocr family; describe adds description and data to those of the vlm family; skipped ones have their kind only."""
    rows = routed(items)
    text, grid = F.lit(None).cast("string"), F.lit(None).cast("array<array<string>>")
    ocr, vlm, none = (rows.where(c) for c in (F.col("family") == "ocr", F.col("family") == "vlm", F.col("family").isNull()))
    ocr = read(ocr) if read else ocr.withColumn("ocr_text", text)
    vlm = describe(vlm) if describe else vlm.withColumns({"description": text, "data": grid})
    key = ["doc_id", "ord", "kind"]
    out = ocr.select(*key, "ocr_text", text.alias("description"), grid.alias("data"))
    out = out.unionByName(vlm.select(*key, text.alias("ocr_text"), "description", "data"))
    return out.unionByName(none.select(*key, text.alias("ocr_text"), text.alias("description"), grid.alias("data")))


def apply_entries(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks with kind and figure of each entry's block; blocks without an entry, and entries without a figure, change nothing."""
    e = found.select("doc_id", "ord", F.col("kind").alias("__kind"), F.struct("description", "ocr_text", "data").alias("__figure"))
    rows = blocks if "kind" in blocks.columns else blocks.withColumn("kind", F.lit(None).cast("string"))
    takes = (F.col("block_type") == "figure") & F.col("figure").isNotNull() & F.col("__figure").isNotNull()
    known = F.col("__kind").isin(*ROUTES)
    out = rows.join(e, ["doc_id", "ord"], "left")
    out = out.withColumns({"kind": F.when(takes & known, F.col("__kind")).otherwise(F.col("kind")), "figure": F.when(takes, F.col("__figure")).otherwise(F.col("figure"))})
    return out.select(*rows.columns)


def classifier_prompt() -> str:
    """What a vision model is asked."""
    return "Classify this image into EXACTLY ONE of these classes and answer with that single word:\n" + "\n".join(f"- {k}: {said}" for k, (_, said) in ROUTES.items())
