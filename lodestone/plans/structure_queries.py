"""Registered queries on tables, captions, sections, passages and the chunks made of them.

The pages given have neither tables nor figures, so blocks of all kinds are made of the conversations: a user's first line is a
heading, any other line is a caption, table, figure, list item or paragraph by its length.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import blocks as furniture
from lodestone.operators import assemble, chunks, figures, linear, passages, tables
from lodestone.plans.content_queries import PAGE_ROLES
from lodestone.plans.registry import query
from lodestone.sources import sidecar
from lodestone.sources.pages import parse_html
from lodestone.sources.tables import table


def conversation_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.trim("line") != "")
    n = F.length("line")
    kind = F.when((F.col("role") == "user") & (F.col("i") == 0), "heading")
    for k, name in enumerate(("caption", "table", "figure", "list_item")):
        kind = kind.when(n % 7 == k, name)
    words = F.split("line", " ", -1)
    cells = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 3).cast("int")), lambda k: F.slice(words, k * 3 + 1, F.lit(3)))
    figure = F.struct(
        F.when(n % 3 == 0, F.substring("line", 1, 30)).alias("description"), F.when(n % 5 < 2, F.substring("line", 5, 20)).alias("ocr_text"), F.when(n % 4 == 0, cells).alias("data")
    )
    rows = lines.withColumns({"block_type": kind.otherwise("paragraph"), "ord": F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "i")) - 1})
    is_ = lambda name: F.col("block_type") == name
    text = F.when(is_("heading"), F.substring("line", 1, 40)).when(~F.col("block_type").isin("table", "figure"), F.col("line"))
    return rows.select(
        "doc_id", "ord", "block_type", F.when(is_("heading"), 1 + F.floor(F.col("turn") / 2) % 3).cast("int").alias("level"), F.floor(F.col("ord") / 10).cast("int").alias("page"),
        text.alias("text"), F.when(is_("table"), cells).alias("cells"), F.when(is_("table"), n % 2 == 0).alias("has_header"), F.when(is_("figure"), figure).alias("figure"),
    )


def _grid(words: str, headed: str) -> str:
    """SQL of the Markdown table of a list of words, three a row."""
    clean = f"list_transform({words}, lambda x: replace(replace(x, '\\', '\\\\'), '|', '\\|'))"
    wide = f"least(3, len({words}))"
    line = f"'| ' || array_to_string(list_transform(range(1, {wide} + 1), lambda j: coalesce({clean}[3 * k + j], '')), ' | ') || ' |'"
    lines = f"list_transform(range(0, (len({words}) + 2) // 3), lambda k: {line})"
    rule = f"'|' || repeat(' --- |', {wide})"
    return f"array_to_string(CASE WHEN {headed} THEN list_concat({lines}[1:1], [{rule}], {lines}[2:]) ELSE {lines} END, chr(10))"


BLOCKS = """src AS (SELECT conv_id AS doc_id, turn, role AS who, i - 1 AS i, l AS line, length(l) AS n, string_split(l, ' ') AS ws FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE trim(l) <> ''),
 b0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) - 1 AS ord, CASE WHEN who = 'user' AND i = 0 THEN 'heading' WHEN n % 7 = 0 THEN 'caption' WHEN n % 7 = 1 THEN 'table' WHEN n % 7 = 2 THEN 'figure' WHEN n % 7 = 3 THEN 'list_item' ELSE 'paragraph' END AS kind FROM src),
 b AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'heading' THEN 1 + (turn // 2) % 3 END AS level, ord // 10 AS page, n, ws, line, CASE WHEN kind = 'heading' THEN substr(line, 1, 40) WHEN kind NOT IN ('table', 'figure') THEN line END AS text FROM b0)"""
# a caption's owner: the unit after it; else the one before it, unless the caption before that has it
CAPTIONS = """near AS (SELECT *, kind = 'caption' AS c, kind IN ('table', 'figure') AS u, lag(kind, 1, '') OVER w AS p1, lag(kind, 2, '') OVER w AS p2, lead(kind, 1, '') OVER w AS n1 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 owned AS (SELECT doc_id, ord AS caption_ord, CASE WHEN n1 IN ('table', 'figure') THEN ord + 1 WHEN p1 IN ('table', 'figure') AND p2 <> 'caption' THEN ord - 1 END AS ord, trim(text) AS caption, page AS caption_page FROM near WHERE c),
 full_blocks AS (SELECT b.*, o.caption, o.caption_ord, o.caption_page FROM b LEFT JOIN owned o ON o.doc_id = b.doc_id AND o.ord = b.ord WHERE (b.doc_id, b.ord) NOT IN (SELECT doc_id, caption_ord FROM owned WHERE ord IS NOT NULL))"""
FIGURE = f"nullif(concat_ws(chr(10), nullif(caption, ''), nullif(trim(CASE WHEN n % 3 = 0 THEN substr(line, 1, 30) END), ''), '[OCR] ' || nullif(trim(CASE WHEN n % 5 < 2 THEN substr(line, 5, 20) END), ''), '[Data]' || chr(10) || CASE WHEN n % 4 = 0 THEN {_grid('ws', 'true')} END), '')"
SECTIONS = """heads AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER w AS h1, max(CASE WHEN level = 2 THEN ord END) OVER w AS h2, max(CASE WHEN level = 3 THEN ord END) OVER w AS h3 FROM full_blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 keyed AS (SELECT *, list_filter([h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END, CASE WHEN h3 > greatest(coalesce(h1, -1), coalesce(h2, -1)) THEN h3 END], lambda x: x IS NOT NULL) AS key FROM heads)"""


@query("caption_links", f"WITH {BLOCKS}, {CAPTIONS} SELECT doc_id, ord::INTEGER AS ord, caption_ord::INTEGER AS caption_ord, md5(caption) AS caption FROM owned WHERE ord IS NOT NULL")
def caption_links(spark, sf_dir):
    """Captions and the tables or figures that they belong to."""
    rows = passages.with_captions(conversation_blocks(spark, sf_dir)).where("caption_ord IS NOT NULL")
    return rows.select("doc_id", "ord", "caption_ord", F.md5("caption").alias("caption"))


PASSAGES = f"""{BLOCKS}, {CAPTIONS}, {SECTIONS},
 said AS (SELECT *, CASE kind WHEN 'table' THEN concat_ws(chr(10), nullif(caption, ''), {_grid('ws', 'n % 2 = 0')}) WHEN 'figure' THEN {FIGURE} ELSE nullif(trim(text), '') END AS passage FROM keyed),
 passages AS (SELECT *, kind = 'heading' AS heading_only FROM said WHERE passage IS NOT NULL)"""


@query("passages", f"""WITH {PASSAGES} SELECT doc_id, ord::INTEGER AS ord, md5(passage) AS text, CASE WHEN caption_ord IS NULL THEN ord::VARCHAR ELSE least(ord, caption_ord) || ',' || greatest(ord, caption_ord) END AS block_ords,
 array_to_string(key, ',') AS section_key, kind IN ('table', 'figure') AS atomic, len(regexp_extract_all(passage, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))::INTEGER AS tokens, heading_only,
 least(page, caption_page)::INTEGER AS page_start, greatest(page, caption_page)::INTEGER AS page_end FROM passages""")
def passages_query(spark, sf_dir):
    """Passages of all conversations: sections, captions, tables and figures taken in."""
    p = passages.passages(conversation_blocks(spark, sf_dir))
    return p.select("doc_id", "ord", F.md5("text").alias("text"), F.array_join("block_ords", ",").alias("block_ords"), F.array_join("section_key", ",").alias("section_key"), "atomic", "tokens", "heading_only", "page_start", "page_end")


@query("section_paths", f"""WITH {BLOCKS}, {CAPTIONS}, {SECTIONS}, path AS (SELECT k.doc_id, k.ord, k.place, h.text FROM (SELECT doc_id, ord, unnest(key) AS place FROM keyed) k JOIN b h ON h.doc_id = k.doc_id AND h.ord = k.place)
 SELECT doc_id, ord::INTEGER AS ord, count(*)::INTEGER AS depth, md5(string_agg(text, ' › ' ORDER BY place)) AS path FROM path GROUP BY 1, 2""")
def section_paths(spark, sf_dir):
    """The open headings of every block that has one, top down (captions within units left out)."""
    rows = passages.with_captions(passages.with_sections(conversation_blocks(spark, sf_dir))).where(~F.col("consumed") & (F.size("section_key") > 0))
    return rows.select("doc_id", "ord", F.size("section_key").alias("depth"), F.md5(F.array_join("heading_path", " › ")).alias("path"))


@query("parse_quality", f"WITH {BLOCKS} SELECT doc_id, round(avg((coalesce(trim(text), '') <> '')::INT), 6) AS score FROM b GROUP BY 1")
def parse_quality(spark, sf_dir):
    """Share of blocks with text (tables and figures have none of their own)."""
    return furniture.quality(conversation_blocks(spark, sf_dir))


@query("passage_roles", f"""WITH {PAGE_ROLES}, h AS (SELECT *, max(CASE WHEN block_type = 'heading' AND level = 1 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS at FROM roles)
 SELECT h.doc_id, h.ord, CASE WHEN h.block_type <> 'header_footer' AND lower(trim(t.text)) IN ('contents', 'table of contents', 'toc', 'sommaire', 'table des matières', 'índice') THEN 'toc' ELSE h.role END AS role, coalesce(t.text, '') AS section,
  len(regexp_extract_all(h.text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))::INTEGER AS tokens FROM h LEFT JOIN roles t ON t.doc_id = h.doc_id AND t.ord = h.at""".replace(" AS at ", " AS place ").replace("h.at", "h.place"))
def passage_roles(spark, sf_dir):
    """Roles of the passages of all pages."""
    return passages.passages(parse_html(table(spark, sf_dir, "pages"))).select("doc_id", "ord", "role", F.array_join("heading_path", " › ").alias("section"), "tokens")


@query("absorbed_passages")
def absorbed_passages(spark, sf_dir):
    """Body passages of all conversations with bare headings taken in."""
    return passages.absorb_headings(passages.passages(conversation_blocks(spark, sf_dir)))


@query("section_chunks")
def section_chunks(spark, sf_dir):
    """Chunks of all conversations along their sections, with the heading trail as context."""
    rows = chunks.by_section(passages.passages(conversation_blocks(spark, sf_dir)), 120, 240, 24, 24)
    rows = rows.withColumn("context", chunks.breadcrumb("heading_path", 3))
    return rows.withColumn("enriched", chunks.enriched("text", "context"))


@query("chunks_semantic")
def chunks_semantic(spark, sf_dir):
    """Chunks of all documents where the subject changes, by hashed terms."""
    p = passages.passages(furniture.paragraphs(table(spark, sf_dir, "documents")))
    return chunks.semantic(p, least=32, most=256)


def table_pages(spark, sf_dir):
    """A page for each conversation: a table of its turns whose first column spans three rows, with cells missing."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    turns = turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    first = F.when(F.col("r") % 3 == 0, F.concat(F.lit('<td rowspan="'), F.least(F.lit(3), F.col("n") - F.col("r")).cast("string"), F.lit('">'), "role", F.lit("</td>"))).otherwise("")
    last = F.when(F.length("text") % 2 == 0, F.concat(F.lit("<td>"), tables.escaped(F.substring("text", 1, 20)), F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), first, F.lit("<td>"), F.col("turn").cast("string"), F.lit("</td>"), last, F.lit("</tr>"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", row.alias("row")))).alias("rows"))
    return rows.select("conv_id", F.concat(F.lit("<p>x</p><table><tr><th colspan=2>turns</th><th>text</th></tr>"), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))


_TURNS = "t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, CASE WHEN length(text) % 2 = 0 THEN trim(regexp_replace(substr(text, 1, 20), '\\s+', ' ', 'g')) ELSE '' END AS said FROM conversations)"
_CELL = "replace(replace({}, '\\', '\\\\'), '|', '\\|')"
_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("page_tables", f"""WITH {_TURNS} SELECT conv_id, 0 AS "table", count(*)::INTEGER + 1 AS n_rows, 3 AS n_cols, true AS has_header,
 md5('| turns |  | text |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || CASE WHEN r % 3 = 0 THEN role ELSE '' END || ' | ' || turn || ' | ' || {_CELL.format('said')} || ' |', chr(10) ORDER BY r)) AS markdown,
 md5('<table><thead><tr><th>turns</th><th></th><th>text</th></tr></thead><tbody>' || string_agg('<tr><td>' || CASE WHEN r % 3 = 0 THEN role ELSE '' END || '</td><td>' || turn || '</td><td>' || {_ESCAPED.format('said')} || '</td></tr>', '' ORDER BY r) || '</tbody></table>') AS html FROM t GROUP BY 1""")
def page_tables(spark, sf_dir):
    """Tables of pages as grids, spans filled."""
    rows = tables.page_tables(table_pages(spark, sf_dir), "conv_id")
    return rows.select("conv_id", "table", "n_rows", "n_cols", "has_header", F.md5(tables.markdown("cells", F.col("has_header"))).alias("markdown"), F.md5(tables.html("cells", F.col("has_header"))).alias("html"))


_PARTS = f"""{BLOCKS}, {CAPTIONS}, prose AS (SELECT *, nullif(caption, '') AS cap, CASE WHEN kind = 'figure' AND n % 3 = 0 THEN nullif(trim(substr(line, 1, 30)), '') END AS description,
  CASE WHEN kind = 'figure' AND n % 5 < 2 THEN nullif(trim(substr(line, 5, 20)), '') END AS ocr FROM full_blocks),
 part AS (SELECT doc_id, ord, kind, CASE kind WHEN 'heading' THEN repeat('#', level::INTEGER) || ' ' || nullif(trim(text), '') WHEN 'list_item' THEN '- ' || trim(text) WHEN 'caption' THEN '*' || trim(text) || '*'
  WHEN 'table' THEN concat_ws(chr(10), '*' || cap || '*', {_grid('ws', 'n % 2 = 0')})
  WHEN 'figure' THEN concat_ws(chr(10) || chr(10), '*' || cap || '*', description, ocr, CASE WHEN n % 4 = 0 THEN {_grid('ws', 'true')} END) ELSE trim(text) END AS part FROM prose),
 lists AS (SELECT *, sum(CASE WHEN kind = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS l FROM part)"""


@query("document_markdown", f"""WITH {_PARTS}, segments AS (SELECT doc_id, min(ord) AS ord, string_agg(part, chr(10) ORDER BY ord) AS text FROM lists WHERE part <> '' GROUP BY doc_id, kind = 'list_item', CASE WHEN kind = 'list_item' THEN l ELSE -ord - 1 END)
 SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS markdown FROM segments GROUP BY 1""")
def document_markdown(spark, sf_dir):
    return linear.to_markdown(conversation_blocks(spark, sf_dir)).withColumn("markdown", F.md5("markdown"))


def _html_grid(words: str, headed: str, caption: str = "''") -> str:
    """SQL of the HTML table of a list of words, three a row."""
    wide = f"least(3, len({words}))"
    row = lambda k, tag: f"'<tr>' || array_to_string(list_transform(range(1, {wide} + 1), lambda j: '<{tag}>' || {_ESCAPED.format(f'coalesce({words}[3 * {k} + j], chr(0))')} || '</{tag}>'), '') || '</tr>'"
    rows = lambda first: f"array_to_string(list_transform(range({first}, (len({words}) + 2) // 3), lambda k: {row('k', 'td')}), '')"
    grid = f"CASE WHEN {headed} THEN '<thead>' || {row('0', 'th')} || '</thead><tbody>' || {rows(1)} ELSE '<tbody>' || {rows(0)} END"
    return f"replace('<table>' || {caption} || {grid} || '</tbody></table>', chr(0), '')"


_SAID = "nullif(trim({}), '')"
_HTML = f"""{BLOCKS}, {CAPTIONS}, prose AS (SELECT *, nullif(caption, '') AS cap, CASE WHEN kind = 'figure' AND n % 3 = 0 THEN {_SAID.format('substr(line, 1, 30)')} END AS description, CASE WHEN kind = 'figure' AND n % 5 < 2 THEN {_SAID.format('substr(line, 5, 20)')} END AS ocr FROM full_blocks),
 part AS (SELECT doc_id, ord, kind, CASE kind WHEN 'heading' THEN '<h' || level || '>' || {_ESCAPED.format('trim(text)')} || '</h' || level || '>' WHEN 'list_item' THEN '<li>' || {_ESCAPED.format('trim(text)')} || '</li>' WHEN 'caption' THEN '<p><em>' || {_ESCAPED.format('trim(text)')} || '</em></p>'
  WHEN 'table' THEN {_html_grid('ws', 'n % 2 = 0', f"coalesce('<caption>' || {_ESCAPED.format('cap')} || '</caption>', '')")}
  WHEN 'figure' THEN '<figure>' || nullif(concat_ws('', '<p>' || {_ESCAPED.format('description')} || '</p>', '<p>' || {_ESCAPED.format('ocr')} || '</p>', CASE WHEN n % 4 = 0 THEN {_html_grid('ws', 'true')} END, '<figcaption>' || {_ESCAPED.format('cap')} || '</figcaption>'), '') || '</figure>'
  ELSE '<p>' || {_ESCAPED.format('trim(text)')} || '</p>' END AS part FROM prose),
 lists AS (SELECT *, sum(CASE WHEN kind = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS l FROM part),
 segments AS (SELECT doc_id, min(ord) AS ord, CASE WHEN kind = 'list_item' THEN '<ul>' || string_agg(part, '' ORDER BY ord) || '</ul>' ELSE min(part) END AS text FROM lists WHERE part <> '' GROUP BY doc_id, kind = 'list_item', CASE WHEN kind = 'list_item' THEN l ELSE -ord - 1 END, kind)"""


@query("document_html", f"""WITH {_HTML} SELECT doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Conversation ' || doc_id || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(text, chr(10) ORDER BY ord) || chr(10) || '</body>' || chr(10) || '</html>') AS html FROM segments GROUP BY 1""")
def document_html(spark, sf_dir):
    rows = linear.to_html(conversation_blocks(spark, sf_dir))
    return linear.html_page(rows.withColumns({"title": F.concat(F.lit("Conversation "), F.col("doc_id").cast("string")), "language": F.lit("en")})).select("doc_id", F.md5("html").alias("html"))


# figures ------------------------------------------------------------------------------------------------------------------------


def conversation_figures(spark, sf_dir):
    """Figure blocks of the conversations with crops (headers of PNG files) and boxes by the length of their lines."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    n = F.length("line")
    pixels = lambda k: F.lpad(F.hex((n * k) % 400), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), pixels(3), pixels(7)))
    crop = F.when(n % 9 == 0, F.encode("line", "UTF-8")).when(n % 9 < 8, png)
    ordinal = (F.col("turn") * 1000 + F.col("i")).cast("int").alias("ord")
    box = F.array(F.lit(0.0), F.lit(1.0), (n % 11) / 10, F.lit(0.0))
    return lines.select("doc_id", ordinal, F.lit("figure").alias("block_type"), crop.alias("crop"), box.alias("box"), F.when(n % 2 == 0, "fr").alias("language"), "line", F.lit(None).cast(passages.FIGURE).alias("none"))


@query("figure_kinds", """WITH l AS (SELECT conv_id AS doc_id, turn * 1000 + i - 1 AS ord, l, length(l) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
 s AS (SELECT *, CASE WHEN (n % 11) / 10e0 >= 0.85 THEN 'scanned_text' WHEN n % 9 <> 0 AND least((n * 3) % 400, (n * 7) % 400) < 48 THEN 'decorative' END AS sure, CASE n % 4 WHEN 0 THEN 'chart' WHEN 1 THEN 'diagram' END AS said FROM l WHERE n % 9 <> 8)
 SELECT doc_id, ord::INTEGER AS ord, coalesce(sure, said, 'photo') AS kind, CASE WHEN sure IS NOT NULL THEN 0.9 WHEN said IS NOT NULL THEN 1.0 ELSE 0.3 END::DOUBLE AS kind_score, CASE coalesce(sure, said, 'photo') WHEN 'scanned_text' THEN 'ocr' WHEN 'decorative' THEN NULL ELSE 'vlm' END AS family, CASE WHEN n % 2 = 0 THEN 'fr' ELSE 'en' END AS language FROM s""")
def figure_kinds(spark, sf_dir):
    """Kinds of all figures with a crop: by geometry, else by a word that their lines stand for."""
    items = figures.figure_items(conversation_figures(spark, sf_dir), "en")
    lines = conversation_figures(spark, sf_dir).select("doc_id", "ord", F.length("line").alias("n"))
    word = F.when(F.col("n") % 4 == 0, "A Chart.").when(F.col("n") % 4 == 1, "diagram").otherwise("no idea")
    kinds = figures.classify(items, lambda rows: rows.join(lines, ["doc_id", "ord"]).withColumn("answer", word).drop("n"))
    return figures.routed(kinds).select("doc_id", "ord", "kind", "kind_score", "family", "language")


@query("enriched_figures", """WITH l AS (SELECT conv_id AS doc_id, turn * 1000 + i - 1 AS ord, length(l) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
 k AS (SELECT *, CASE WHEN n % 9 = 8 THEN NULL WHEN (n % 11) / 10e0 >= 0.85 THEN 'scanned_text' WHEN n % 9 <> 0 AND least((n * 3) % 400, (n * 7) % 400) < 48 THEN 'decorative' ELSE 'photo' END AS kind FROM l)
 SELECT doc_id, ord::INTEGER AS ord, kind, CASE WHEN kind IS NULL THEN 'old' WHEN kind = 'scanned_text' THEN '[OCR] read ' || ord WHEN kind = 'photo' THEN 'shows photo' || chr(10) || '[Data]' || chr(10) || '| k | ' || ord || ' |' || chr(10) || '| --- | --- |' END AS shown FROM k""")
def enriched_figures(spark, sf_dir):
    """Figures after their branches: text read from scans, descriptions of others, as passages show them."""
    source = conversation_figures(spark, sf_dir).withColumn("figure", F.struct(F.lit("old").alias("description"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast(tables.GRID).alias("data")))
    items = figures.classify(figures.figure_items(source))
    found = figures.entries(
        items, lambda rows: rows.withColumn("ocr_text", F.concat(F.lit("read "), F.col("ord").cast("string"))),
        lambda rows: rows.withColumns({"description": F.concat(F.lit("shows "), "kind"), "data": F.array(F.array(F.lit("k"), F.col("ord").cast("string")))}),
    )
    rows = figures.apply_entries(source.select("doc_id", "ord", "block_type", "figure"), found)
    text = passages.figure_text("figure", "caption", "text")
    return rows.withColumns({"caption": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).select("doc_id", "ord", "kind", text.alias("shown"))


# parser answers -----------------------------------------------------------------------------------------------------------------


def parser_answers(spark, sf_dir):
    """An answer for each conversation: a page a turn, its lines as blocks in reverse reading order, labels by their place."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n", -1).alias("l"))

    def block(x, i):
        names = F.array(*map(F.lit, ("Title", "section_header", "text", "formula", "table", "watermark", "list")))
        kind = F.element_at(names, (i % 7 + 1).cast("int"))
        html = F.when(kind == "table", F.concat(F.lit("<table><tr><td colspan=2>"), tables.escaped(F.substring(x, 1, 10)), F.lit("</td></tr><tr><td>1</td></tr></table>")))
        return F.struct(kind.alias("label"), F.array(F.lit(10.0), F.lit(20.0), F.lit(50.0), (i + 30).cast("double")).alias("bbox"), x.alias("text"), html.alias("html"), F.when((kind == "formula") & (F.length(x) % 2 == 0), F.lit("x^2")).alias("latex"), (-i).cast("double").alias("reading_order"))

    page = F.struct(F.col("turn").cast("int").alias("page_index"), F.lit(100.0).alias("image_width"), F.lit(1000.0).alias("image_height"), F.transform("l", block).alias("blocks"))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("pages"))
    return pages.select("conv_id", F.to_json(F.struct(F.transform("pages", lambda x: x["p"]).alias("pages"))).alias("answer"))


@query("parser_blocks", """WITH l AS (SELECT conv_id, turn, i - 1 AS i, l FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
 k AS (SELECT *, CASE i % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'formula' WHEN 4 THEN 'table' WHEN 6 THEN 'list_item' END AS kind FROM l)
 SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i DESC) - 1)::INTEGER AS ord, kind AS block_type, CASE i % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS level, turn::INTEGER AS page, round((i + 30) / 1000e0, 6) AS bottom,
  CASE kind WHEN 'table' THEN '' WHEN 'formula' THEN CASE WHEN length(l) % 2 = 0 THEN 'x^2' ELSE coalesce(nullif(l, ''), '') END ELSE l END AS text, CASE WHEN kind = 'table' THEN trim(regexp_replace(substr(l, 1, 10), '\\s+', ' ', 'g')) || '||1|' ELSE '' END AS cells FROM k WHERE kind IS NOT NULL""")
def parser_blocks(spark, sf_dir):
    """Blocks of all parser answers: labels that stand for nothing skipped, levels, formulas, tables as grids."""
    rows = sidecar.document_blocks(parser_answers(spark, sf_dir), "conv_id", "answer")
    grid = F.coalesce(F.array_join(F.flatten("cells"), "|"), F.lit(""))
    return rows.select("doc_id", "ord", "block_type", "level", "page", F.round(F.get("box", F.lit(3)), 6).alias("bottom"), F.coalesce("text", F.lit("")).alias("text"), grid.alias("cells"))


# context ------------------------------------------------------------------------------------------------------------------------


@query("document_anchors")
def document_anchors(spark, sf_dir):
    """Anchors of all conversations: a declared title for every third, else their first headings."""
    blocks = conversation_blocks(spark, sf_dir)
    cut = chunks.by_section(passages.passages(blocks), 120, 240, 24, 24)
    docs = blocks.select("doc_id").distinct().withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Title "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, " "))
    anchors = assemble.document_anchors(docs, cut, furniture.first_heading(blocks))
    return assemble.anchored(cut.select("doc_id", "chunk", "text"), anchors)


@query("section_scopes")
def section_scopes(spark, sf_dir):
    """What a model would read to place each chunk of the conversations."""
    cut = chunks.by_section(passages.passages(conversation_blocks(spark, sf_dir)), 60, 120, 12, 12).where("role = 'body'").select("doc_id", "chunk", "text", "heading_path")
    return assemble.scoped(cut, "section", 1, 200)
