"""Registered queries on content: intake, blocks, chunks, context, evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.functions.text import LANGUAGE_WORDS, detect_language, normalize
from lodestone.operators import blocks, chunks, grid
from lodestone.plans.registry import query
from lodestone.sources.pages import admission_errors, parse_html, parse_text, probe_format
from lodestone.sources.tables import table


@query("content_address", "SELECT doc_id, sha256(text) AS source_hash FROM documents")
def content_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))


@query("exact_dedup", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup(spark, sf_dir):
    """One document of each digest, the smallest id; the digest is aggregated before the shuffle, so a group of any size is one row a task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("blob_register", "SELECT DISTINCT sha256(text) AS content_hash, length(text)::INTEGER AS size FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id < 50)")
def blob_register(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").alias("size"))
    known = docs.where("doc_id < 50")
    return grid.unreferenced(docs.groupBy("content_hash").agg(F.first("size").alias("size")), "content_hash", [known])


@query("admission", """SELECT doc_id, concat_ws('; ', CASE WHEN length(text) = 0 THEN 'empty file' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'unsupported format ' || lang END, CASE WHEN octet_length(encode(text)) > 4000 THEN 'file too large' END) AS errors FROM documents""")
def admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(admission_errors(F.encode("text", "UTF-8"), F.col("lang"), ["en", "fr"], 4000), "; ").alias("errors"))


@query("format_probe", "SELECT page_id, CASE WHEN regexp_matches(lower(html), '^\\s*(<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'txt' END AS format FROM pages")
def format_probe(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", probe_format(F.encode("html", "UTF-8"), F.lit("page.bin")).alias("format"))


def _language_sql() -> str:
    hits = {k: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in v)})))" for k, v in LANGUAGE_WORDS.items()}
    cols = ", ".join(f"{v} AS {k}" for k, v in hits.items())
    top = f"greatest({', '.join(hits)})"
    tie = " + ".join(f"({k} = {top})::INT" for k in hits)
    case = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in hits)
    return f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 12800)), '[\\p{{L}}]+')[1:400] AS ws FROM documents), h AS (SELECT doc_id, len(ws) AS n, {cols} FROM w) SELECT doc_id, CASE WHEN {top} = 0 OR {tie} > 1 OR {top} < 0.05 * n THEN '' ELSE CASE {case} END END AS language FROM h"


@query("language_detect", _language_sql())
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect_language("text").alias("language"))


LINES = "lines AS (SELECT doc_id, (i - 1)::INTEGER AS ord, ((i - 1) // 10)::INTEGER AS page, l AS text, trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> '')"
# The texts of page chrome, as the operators have them.
_PHRASES = """('no results', 'no result', 'no results found', 'no matching results', 'il n''y a pas de résultat', 'il n''y a pas de résultats', 'aucun résultat', 'aucun resultat', 'faire une recherche complète', 'recherche complète', 'search', 'rechercher', 'menu', 'navigation', 'skip to content', 'aller au contenu', 'back to top', 'haut de page')"""
_PREFIX = "^(rechercher |faire une recherche|search for|aller au |retour au |back to |skip to )"
_EDGES = "^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_'']+$"
_PARTS = "list_filter(list_transform(regexp_split_to_array(text, '[·•|›»∙‧・\\t\\n]+'), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), lambda x: x <> '')"
_COUNT = "len(string_split({}, ' '))"
_KEY = f"regexp_replace({{}}, '{_EDGES}', '', 'g')".replace("p{L}", "p{{L}}").replace("p{N}", "p{{N}}")
_CHROME = f"""({_KEY.format('norm')} IN {_PHRASES} OR ({_COUNT.format(_KEY.format('norm'))} <= 6 AND regexp_matches({_KEY.format('norm')}, '{_PREFIX}'))
 OR (len({_PARTS}) >= 4 AND {_COUNT.format('norm')} <= 40 AND len(list_filter({_PARTS}, lambda x: {_COUNT.format('x')} <= 4 OR {_KEY.format('x')} IN {_PHRASES})) >= 0.75 * len({_PARTS})))"""
_LABEL = f"((norm <> '' AND {_COUNT.format('norm')} <= 4) OR {_CHROME})"
RUNS = f"""marked AS (SELECT doc_id, ord, {_LABEL} AS label FROM lines), isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS island FROM marked),
 runs AS (SELECT doc_id, ord FROM isl WHERE label QUALIFY count(*) OVER (PARTITION BY doc_id, island) >= 3)"""


@query("repeated_boilerplate", f"WITH {LINES} SELECT doc_id, norm, count(DISTINCT page) AS pages FROM lines GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3")
def repeated_boilerplate(spark, sf_dir):
    return blocks.repeated_texts(blocks.paragraphs(table(spark, sf_dir, "documents")))


@query("chrome_runs", f"WITH {LINES}, {RUNS} SELECT * FROM runs")
def chrome_runs(spark, sf_dir):
    return blocks.chrome_runs(blocks.paragraphs(table(spark, sf_dir, "documents")))


@query("block_roles", f"""WITH {LINES}, {RUNS}, rep AS (SELECT doc_id, norm FROM lines GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)
 SELECT role, count(*) AS n FROM (SELECT CASE WHEN (doc_id, norm) IN (SELECT * FROM rep) OR (doc_id, ord) IN (SELECT * FROM runs) OR {_CHROME} THEN 'boilerplate' ELSE 'body' END AS role FROM lines) GROUP BY 1""")
def block_roles(spark, sf_dir):
    return blocks.roles(blocks.paragraphs(table(spark, sf_dir, "documents"))).groupBy("role").agg(F.count("*").alias("n"))


@query("chunk_enablement", f"WITH {LINES}, {RUNS} SELECT doc_id, ord, coalesce(CASE WHEN ord % 11 = 0 THEN false END, (doc_id, ord) NOT IN (SELECT * FROM runs)) AS enabled FROM lines")
def chunk_enablement(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents"))
    rows = b.join(blocks.chrome_runs(b).withColumn("role", F.lit("boilerplate")), ["doc_id", "ord"], "left")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("body")), "override": F.when(F.col("ord") % 11 == 0, False)})
    return rows.select("doc_id", "ord", blocks.enabled("override", "role").alias("enabled"))


def _unescaped(c: str) -> str:
    """The named characters of the given pages, also without a semicolon, as HTML reads these names; & last, so that none is read twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


# blocks of the given pages: tags cut the text; the last tag and the open furniture say what a piece is
PAGE_BLOCKS = f"""raw AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '<!--(.|\\n)*?-->', '', 'g'), '(?s)<(script|style|template|noscript|title)[^>]*>.*?</(script|style|template|noscript|title)>', '', 'g') AS h FROM pages),
 tok AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS t FROM (SELECT doc_id, regexp_extract_all(h, '(?s)<[^>]+>|[^<]+') AS t FROM raw)),
 tag AS (SELECT *, lower(regexp_extract(t, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM tok),
 mark AS (SELECT *, ltrim(name, '/') IN ('nav', 'header', 'footer', 'aside') AS fur, ltrim(name, '/') IN ('p', 'li', 'pre', 'figcaption', 'td', 'th', 'div', 'article', 'blockquote', 'br', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') AS blk FROM tag),
 state AS (SELECT *, sum((fur OR blk)::INT) OVER w AS seg, sum(CASE WHEN fur THEN CASE WHEN name LIKE '/%' THEN -1 ELSE 1 END ELSE 0 END) OVER w AS depth,
  last_value(CASE WHEN blk AND name NOT LIKE '/%' THEN CASE WHEN name = 'br' THEN 'p' ELSE name END WHEN name LIKE '/%' AND (blk OR fur) THEN 'p' END IGNORE NULLS) OVER w AS cur FROM mark WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 said AS (SELECT doc_id, seg, max(depth) AS depth, max(coalesce(cur, 'p')) AS cur, trim(regexp_replace({_unescaped("string_agg(t, '' ORDER BY i)")}, '\\s+', ' ', 'g')) AS text FROM state WHERE name = '' AND t NOT LIKE '<%' GROUP BY 1, 2),
 pblocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1)::INTEGER AS ord, CASE WHEN depth > 0 THEN 'header_footer' WHEN cur LIKE 'h_' THEN 'heading' WHEN cur = 'li' THEN 'list_item' WHEN cur = 'pre' THEN 'code' WHEN cur = 'figcaption' THEN 'caption' ELSE 'paragraph' END AS block_type,
  CASE WHEN cur LIKE 'h_' THEN right(cur, 1)::INTEGER END AS level, 0 AS page, text FROM said WHERE text <> '')"""
PAGE_ROLES = f"""{PAGE_BLOCKS}, n AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM pblocks), m AS (SELECT *, {_CHROME} AS chrome FROM n), l AS (SELECT *, block_type IN ('paragraph', 'list_item', 'code') AND (chrome OR {_COUNT.format('norm')} <= 4) AS label FROM m),
 isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS island FROM l),
 roles AS (SELECT doc_id, ord, block_type, level, page, text, CASE WHEN block_type = 'header_footer' THEN 'header_footer' WHEN block_type = 'heading' AND lower(trim(text)) IN ('contents', 'table of contents', 'toc', 'sommaire', 'table des matières', 'índice') THEN 'toc'
  WHEN (label AND count(*) OVER (PARTITION BY doc_id, label, island) >= 3) OR (chrome AND block_type <> 'heading') THEN 'boilerplate' ELSE 'body' END AS role FROM isl)"""


@query("page_blocks", f"WITH {PAGE_ROLES} SELECT * FROM roles")
def page_blocks(spark, sf_dir):
    """Blocks of all pages, with roles."""
    return blocks.roles(parse_html(table(spark, sf_dir, "pages")))


@query("page_titles", f"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS t FROM pages WHERE html LIKE '%<h1>%')
 SELECT page_id AS doc_id, md5(trim(regexp_replace({_unescaped('t')}, '\\s+', ' ', 'g'))) AS title FROM t""")
def page_titles(spark, sf_dir):
    return blocks.first_heading(parse_html(table(spark, sf_dir, "pages"))).select("doc_id", F.md5("title").alias("title"))


_TREE = ", ".join(f"max(CASE WHEN level = {k} AND block_type = 'heading' THEN ord END) OVER w AS at{k}, max(CASE WHEN level < {k} AND block_type = 'heading' THEN ord END) OVER w AS over{k}" for k in range(1, 7))
_PARENT = ", ".join(f"CASE WHEN at{k} > coalesce(over{k}, -1) AND (block_type <> 'heading' OR {k} < level) THEN at{k} END" for k in range(6, 0, -1))


@query("page_heading_tree", f"WITH {PAGE_BLOCKS}, t AS (SELECT *, {_TREE} FROM pblocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, ord, block_type, level, coalesce({_PARENT}) AS parent FROM t")
def page_heading_tree(spark, sf_dir):
    return blocks.heading_tree(parse_html(table(spark, sf_dir, "pages"))).select("doc_id", "ord", "block_type", "level", "parent")


@query("page_markdown", f"""WITH {PAGE_BLOCKS}, p AS (SELECT *, CASE block_type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS part,
  CASE WHEN block_type = 'list_item' AND lag(block_type) OVER (PARTITION BY doc_id ORDER BY ord) = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM pblocks WHERE block_type <> 'header_footer')
 SELECT doc_id, substr(string_agg(sep || part, '' ORDER BY ord), 3) AS markdown FROM p GROUP BY 1""")
def page_markdown(spark, sf_dir):
    return blocks.to_markdown(parse_html(table(spark, sf_dir, "pages")))


@query("page_html", f"""WITH {PAGE_BLOCKS}, p AS (SELECT doc_id, ord, CASE block_type WHEN 'heading' THEN 'h' || level WHEN 'list_item' THEN 'li' WHEN 'code' THEN 'pre' ELSE 'p' END AS tag, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM pblocks WHERE block_type <> 'header_footer')
 SELECT doc_id, '<article>' || string_agg('<' || tag || '>' || t || '</' || tag || '>', '' ORDER BY ord) || '</article>' AS html FROM p GROUP BY 1""")
def page_html(spark, sf_dir):
    return blocks.to_html(parse_html(table(spark, sf_dir, "pages")))


@query("text_blocks", """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || '## ') WHEN 1 THEN replace(text, chr(10), chr(10) || ' - ') ELSE text END AS text FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
 k AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\s*[-*]\\s') THEN 'list_item' ELSE 'paragraph' END AS block_type, line FROM l WHERE trim(line) <> '')
 SELECT doc_id, block_type, count(*) AS n, sum(CASE WHEN block_type = 'heading' THEN 2 END)::BIGINT AS levels FROM k GROUP BY 1, 2""")
def text_blocks(spark, sf_dir):
    """Blocks by kind of texts a third of which has headings, and another list items."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n## "))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\n - "))).otherwise(F.col("text"))
    rows = parse_text(table(spark, sf_dir, "documents").withColumn("text", marked))
    return rows.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.sum("level").alias("levels"))


WINDOWS = """ws AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
 starts AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 96) + 1, 96)) AS a FROM ws),
 chunk AS (SELECT doc_id, a // 96 AS chunk, array_to_string(w[a + 1 : a + 128], ' ') AS text, len(w[a + 1 : a + 128]) AS tokens FROM starts)"""


@query("word_windows", f"WITH {WINDOWS} SELECT doc_id, chunk, tokens, md5(text) AS digest FROM chunk")
def word_windows(spark, sf_dir):
    return chunks.word_windows(table(spark, sf_dir, "documents"), 128, 96).select("doc_id", "chunk", "tokens", F.md5("text").alias("digest"))


@query("sliding_context", f"""WITH {WINDOWS}, n AS (SELECT *, lag(string_split(text, ' ')) OVER w AS p, lead(string_split(text, ' ')) OVER w AS x FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY chunk))
 SELECT doc_id, chunk, md5(concat_ws(chr(10), CASE WHEN p IS NOT NULL THEN '… ' || array_to_string(p[greatest(1, len(p) - 39):], ' ') END, CASE WHEN x IS NOT NULL THEN array_to_string(x[1:10], ' ') || ' …' END)) AS context FROM n""")
def sliding_context(spark, sf_dir):
    c = chunks.word_windows(table(spark, sf_dir, "documents"), 128, 96)
    return chunks.sliding_context(c, 40, 10).select("doc_id", "chunk", F.md5("context").alias("context"))


@query("chunk_window", f"WITH {WINDOWS}, e AS (SELECT doc_id, chunk FROM chunk WHERE chunk % 3 <> 1), near AS (SELECT doc_id, chunk, 4 AS target FROM e) SELECT doc_id, target::BIGINT AS target, chunk FROM near QUALIFY chunk = 4 OR row_number() OVER (PARTITION BY doc_id, sign(chunk - target) ORDER BY abs(chunk - target)) <= 2")
def chunk_window(spark, sf_dir):
    c = chunks.word_windows(table(spark, sf_dir, "documents"), 128, 96).select("doc_id", "chunk", (F.col("chunk") % 3 != 1).alias("enabled"))
    targets = c.select("doc_id").distinct().withColumn("chunk", F.lit(4).cast("long"))
    return blocks.chunk_window(c, targets, 2, 2)


@query("outline_asof", f"""WITH {LINES}, h AS (SELECT doc_id, ord, text FROM lines WHERE ord % 5 = 0), c AS (SELECT doc_id, ord // 3 AS chunk, max(ord) AS last_ord FROM lines GROUP BY 1, 2)
 SELECT h.doc_id, h.ord, md5(h.text) AS heading, min(chunk)::BIGINT AS chunk FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND last_ord >= h.ord GROUP BY 1, 2, 3""")
def outline_asof(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents"))
    c = b.groupBy("doc_id", F.expr("ord DIV 3").alias("chunk")).agg(F.max("ord").alias("last_ord"))
    return blocks.outline(b.where("ord % 5 = 0"), c).select("doc_id", "ord", F.md5("text").alias("heading"), "chunk")


@query("chunk_index", f"WITH {LINES} SELECT d.doc_id, count(ord) AS n_blocks, max(ord) AS last_ord FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id AND length(l.text) > 200 GROUP BY 1")
def chunk_index(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents")).where("length(text) > 200").select("doc_id", "ord")
    return table(spark, sf_dir, "documents").select("doc_id").join(b, "doc_id", "left").groupBy("doc_id").agg(F.count("ord").alias("n_blocks"), F.max("ord").alias("last_ord"))


def passages(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents"))
    return b.select("doc_id", "ord", "text", F.col("page").cast("string").alias("section"), F.lit(False).alias("atomic"))


_TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))"


def _pieces_sql(most: int) -> str:
    """A document's pieces as lists: a long text's sentences, and a long sentence's words; up[i + 1] are the tokens before piece i."""
    return f"""{LINES},
 cut AS (SELECT doc_id, ord, page, CASE WHEN length(text) > {most} AND {_TOKENS.format('text')} > {most} THEN string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9À-Ü])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [text] END AS s FROM lines),
 sentence AS (SELECT doc_id, ord, page, generate_subscripts(s, 1) AS p, unnest(s) AS text FROM cut),
 hard AS (SELECT doc_id, ord, page, p, CASE WHEN {_TOKENS.format('text')} > {most} THEN list_transform(range(0, (len(regexp_split_to_array(trim(text), '\\s+')) + {most - 1}) // {most}), lambda k: array_to_string(regexp_split_to_array(trim(text), '\\s+')[{most} * k + 1 : {most} * k + {most}], ' ')) ELSE [text] END AS h FROM sentence),
 piece AS (SELECT doc_id, ord, page, p, generate_subscripts(h, 1) AS q, unnest(h) AS text FROM hard),
 items AS (SELECT doc_id, list(ord ORDER BY ord, p, q) AS od, list(page ORDER BY ord, p, q) AS pg, list(text ORDER BY ord, p, q) AS tx, list({_TOKENS.format('text')} ORDER BY ord, p, q) AS tk FROM piece WHERE trim(text) <> '' GROUP BY 1),
 sums AS (SELECT *, list_transform(range(0, len(tk) + 1), lambda i: coalesce(list_sum(tk[1:i]), 0)) AS up FROM items)"""


def _spans_sql(size: int, overlap: int, sections: bool) -> str:
    """Ranges [a, b) of a document's pieces, numbered from 0, one after the other; with sections they end with each page as well."""
    same = "list_aggregate(pg[{0} + 1 : e], 'min') = list_aggregate(pg[{0} + 1 : e], 'max')" if sections else "true"
    end = lambda a: f"list_max(list_filter(range({a} + 1, len(tk) + 1), lambda e: e = {a} + 1 OR (up[e + 1] - up[{a} + 1] <= {size} AND {same.format(a)})))"
    turn = "t.pg[b + 1] <> t.pg[b]" if sections else "false"
    return f"""spans AS (SELECT doc_id, 0 AS chunk, 0::BIGINT AS a, {end('0')} AS b FROM sums
  UNION ALL SELECT doc_id, chunk + 1, c, {end('c')} FROM (
   SELECT s.*, t.tk, t.up, t.pg, CASE WHEN {turn} THEN b WHEN t.up[b + 2] - t.up[tail + 1] <= {size} THEN tail ELSE b END AS c FROM (SELECT spans.*, list_min(list_filter(range(a + 1, b + 1), lambda j: up[b + 1] - up[j + 1] <= {overlap})) AS tail FROM spans JOIN sums USING (doc_id)) s JOIN sums t USING (doc_id) WHERE b < len(t.tk)))"""


_CHUNK = "doc_id, {}::BIGINT AS chunk, array_to_string(tx[a + 1 : b], chr(10) || chr(10)) AS text, od[a + 1] AS first_ord, od[b] AS last_ord, (up[b + 1] - up[a + 1])::INTEGER AS tokens"
FIXED = f"WITH RECURSIVE {_pieces_sql(256)}, {_spans_sql(256, 32, False)} SELECT {_CHUNK.format('chunk')} FROM spans JOIN sums USING (doc_id)"
# small neighbours join: g numbers the joined ranges
STRUCTURED = f"""WITH RECURSIVE {_pieces_sql(512)}, {_spans_sql(256, 32, True)},
 merged AS (SELECT doc_id, 0 AS k, 0 AS g, a, b FROM spans WHERE chunk = 0
  UNION ALL SELECT doc_id, k + 1, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN a ELSE sa END, sb FROM (
   SELECT m.*, s.a AS sa, s.b AS sb, (up[s.b + 1] - up[s.a + 1] < 32 OR up[m.b + 1] - up[m.a + 1] < 32) AND up[s.b + 1] - up[m.a + 1] <= 256 AS j FROM merged m JOIN spans s ON s.doc_id = m.doc_id AND s.chunk = m.k + 1 JOIN sums t ON t.doc_id = m.doc_id))
 SELECT {_CHUNK.format('g')} FROM (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY k DESC) = 1) JOIN sums USING (doc_id)"""


@query("chunks_fixed_size", FIXED)
def chunks_fixed_size(spark, sf_dir):
    return chunks.fixed_size(passages(spark, sf_dir), 256, 32)


@query("chunks_structure_aware", STRUCTURED)
def chunks_structure_aware(spark, sf_dir):
    return chunks.structure_aware(passages(spark, sf_dir), 256, 512, 32, 32)


@query("semantic_cuts", """WITH e AS (SELECT label AS doc_id, vec_id AS ord, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT doc_id, ord, 1 - list_dot_product(v, lead(v) OVER w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(lead(v) OVER w, lead(v) OVER w)) AS x FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 h AS (SELECT doc_id, quantile_cont(x, 0.9) AS high FROM d GROUP BY 1) SELECT doc_id, ord, coalesce(sum(CASE WHEN x > high THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "group" FROM d JOIN h USING (doc_id)""")
def semantic_cuts(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(w))
    d = e.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), F.when(F.col("next").isNotNull(), vectors.cosine_distance("embedding", "next")).alias("distance"))
    return chunks.semantic_cuts(d).select("doc_id", "ord", F.col("group").cast("long").alias("group"))


@query("overlap_seed", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS tail FROM conversations QUALIFY tail <= 600")
def overlap_seed(spark, sf_dir):
    """The trailing turns of a conversation that fit a budget."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return chunks.tail_within(turns, ["conv_id"], ["turn"], "size", 600).select("conv_id", "turn", "tail")


@query("furniture_groups", f"WITH {LINES}, {RUNS} SELECT doc_id, page, count(*) AS n, string_agg(md5(text), ',' ORDER BY ord) AS texts FROM lines WHERE (doc_id, ord) IN (SELECT * FROM runs) GROUP BY 1, 2")
def furniture_groups(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents"))
    rows = b.join(blocks.chrome_runs(b), ["doc_id", "ord"], "left_semi").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", F.md5("text").alias("t")))).alias("b"))
    return rows.select("doc_id", "page", F.size("b").cast("long").alias("n"), F.array_join(F.transform("b", lambda x: x["t"]), ",").alias("texts"))


@query("normalized_texts", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalized_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize("text")).alias("digest"))


# evaluation: each benchmark item's first sentence asks, its text is the evidence ------------------------------------------------

_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


COVERAGE = f"""WITH ev AS (SELECT item_id, len(ws) AS n, unnest(ws) AS t FROM (SELECT item_id, {_W.format('text')} AS ws FROM benchmark)), tokens AS (SELECT item_id, n, t, count(*) AS k FROM ev GROUP BY ALL),
 d AS (SELECT doc_id, unnest(list_distinct({_W.format('text')})) AS t FROM documents),
 x AS (SELECT item_id, doc_id, sum(k)::DOUBLE / n AS share FROM d JOIN tokens USING (t) GROUP BY item_id, doc_id, n)
 SELECT item_id, count(*) FILTER (share >= 0.6) AS covering, coalesce(round(max(share), 6), 0e0) AS best FROM benchmark LEFT JOIN x USING (item_id) GROUP BY 1"""


@query("evidence_coverage", COVERAGE)
@query("evidence_coverage_all", COVERAGE)
def evidence_coverage(spark, sf_dir):
    """How many documents cover at least 0.6 of each evidence's tokens."""
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def coverage(documents, items):
    """(item_id, covering, best): a join on tokens, counted per pair. No hint is given: Spark broadcasts few items' tokens, and of a shuffle
    join splits the documents of a frequent token; each task sums what it has of a pair before the next shuffle."""
    ev = items.select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("ev"))
    tokens = ev.select("item_id", F.size("ev").alias("n"), F.explode("ev").alias("t")).groupBy("item_id", "n", "t").agg(F.count("*").alias("k"))
    docs = documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("t"))
    share = docs.join(tokens, "t").groupBy("item_id", "doc_id", "n").agg((F.sum("k") / F.col("n")).alias("share"))
    got = share.groupBy("item_id").agg(F.count_if(F.col("share") >= 0.6).alias("covering"), F.round(F.max("share"), 6).alias("best"))
    return items.select("item_id").join(got, "item_id", "left").select("item_id", F.coalesce("covering", F.lit(0)).alias("covering"), F.coalesce("best", F.lit(0.0)).alias("best"))


@query("retrieval_metrics", """WITH r AS (SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings), h AS (SELECT query_id, min(rank) FILTER (vec_id % 7 = 0) AS first_hit FROM r GROUP BY 1)
 SELECT round(avg((coalesce(first_hit, 1000) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(first_hit, 1000) <= 5)::INT), 6) AS hit_5, round(avg((coalesce(first_hit, 1000) <= 10)::INT), 6) AS hit_10, round(avg(coalesce(1e0 / first_hit, 0)), 6) AS mrr FROM h""")
def retrieval_metrics(spark, sf_dir):
    """hit@k and mean reciprocal rank of ranked results with relevance marks."""
    w = Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id")
    r = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("rank"))
    first = r.groupBy("label").agg(F.min(F.when(F.col("vec_id") % 7 == 0, F.col("rank"))).alias("first"))
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(1000)) <= k).cast("int")), 6).alias(f"hit_{k}")
    return first.agg(hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
