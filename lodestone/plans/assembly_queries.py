"""Registered queries on contracts, assembly and reranking."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import assemble, blocks, retrieval, schema, tables
from lodestone.plans.content_queries import LINES
from lodestone.plans.registry import query
from lodestone.plans.retrieval_queries import RANK, RRF, branches
from lodestone.sources.tables import table

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  #: the public namespace of URLs


@query("metadata_errors", """SELECT doc_id, concat_ws('; ', CASE WHEN quality IS NULL AND doc_id % 7 <> 0 THEN 'quality is required' END, CASE WHEN doc_id % 2 = 0 THEN 'source is unknown' END,
  CASE WHEN doc_id % 7 = 0 THEN 'quality is no int' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang is none of its values' END) AS errors FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.when(F.col("doc_id") % 7 == 0, "good").otherwise(F.col("quality").cast("string"))
    values = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("quality"), quality)
    values = F.map_filter(values, lambda k, _: (k != "source") | (F.col("doc_id") % 2 == 0))
    errors = schema.metadata_errors("values", ["quality"], {"quality": "int"}, {"lang": ["en", "fr"]})
    return docs.withColumn("values", values).select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query("enum_spellings", "SELECT CASE WHEN upper(source) IN ('SRC0', 'SRC1', 'SRC2', 'SRC3') THEN 'Src' || substr(source, 4) END AS spelling, count(*) AS n FROM documents GROUP BY 1")
def enum_spellings(spark, sf_dir):
    c = schema.canonical(F.upper("source"), ["Src0", "Src1", "Src2", "Src3"])
    return table(spark, sf_dir, "documents").groupBy(c.alias("spelling")).agg(F.count("*").alias("n"))


_SCHEMAS = """d AS (SELECT *, doc_id < (SELECT max(doc_id) FROM documents) / 2 AS early FROM documents),
 a AS (SELECT source || '_' || lang AS field, CASE WHEN avg(n_chars) > 1500 THEN 'text' ELSE 'keyword' END AS type, count(*) % 2 = 0 AS searchable FROM d WHERE early AND lang <> 'fr' GROUP BY 1),
 b AS (SELECT source || '_' || lang AS field, CASE WHEN avg(n_chars) > 1500 THEN 'text' ELSE 'keyword' END AS type, count(*) % 2 = 0 AS searchable FROM d WHERE NOT early AND lang <> 'de' GROUP BY 1),
 diff AS (SELECT field, CASE WHEN a.field IS NULL THEN 'added' WHEN b.field IS NULL THEN 'removed' WHEN a.type <> b.type OR a.searchable <> b.searchable THEN 'modified' END AS change,
  CASE WHEN a.field IS NULL OR b.field IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.type <> b.type THEN 'type' END, CASE WHEN a.searchable <> b.searchable THEN 'searchable' END) END AS changed,
  coalesce(a.searchable, false) OR coalesce(b.searchable, false) AS searchable FROM a FULL JOIN b USING (field))"""


def _schemas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("field", F.concat_ws("_", "source", "lang"))
    half = docs.agg((F.max("doc_id") / 2).alias("half"))
    docs = docs.crossJoin(F.broadcast(half))  # one row
    of = lambda rows: rows.groupBy("field").agg(F.when(F.avg("n_chars") > 1500, "text").otherwise("keyword").alias("type"), (F.count("*") % 2 == 0).alias("searchable"))
    return docs, of(docs.where("doc_id < half AND lang <> 'fr'")), of(docs.where("doc_id >= half AND lang <> 'de'"))


@query("schema_diff", f"WITH {_SCHEMAS} SELECT field, change, changed FROM diff WHERE change IS NOT NULL")
def schema_diff(spark, sf_dir):
    _, before, after = _schemas(spark, sf_dir)
    return schema.schema_diff(before, after).select("field", "change", "changed")


@query("schema_effects", f"""WITH {_SCHEMAS}, n AS (SELECT source || '_' || lang AS field, count(*) AS n FROM documents GROUP BY 1)
 SELECT field, change, changed, CASE WHEN change = 'removed' THEN coalesce(n, 0) ELSE 0 END AS values_lost, searchable AND change <> 'removed' AS reindex FROM diff LEFT JOIN n USING (field) WHERE change IS NOT NULL""")
def schema_effects(spark, sf_dir):
    docs, before, after = _schemas(spark, sf_dir)
    return schema.schema_effects(schema.schema_diff(before, after), docs).select("field", "change", "changed", "values_lost", "reindex")


_RUNS = """r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[{at}] DESC, vec_id) AS rank FROM embeddings),
 q AS (SELECT label, count(*) FILTER (rank <= 10 AND vec_id % 7 = 0)::DOUBLE / count(*) FILTER (vec_id % 7 = 0) AS recall, coalesce(max((rank <= 5)::INT) FILTER (vec_id % 7 = 0), 0) AS hit FROM r GROUP BY 1)"""


def _quality(spark, sf_dir, at):
    """(label, recall at 10, hit at 5) of a ranking by one component."""
    w = Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(at))), "vec_id")
    r = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("rank"))
    good = F.col("vec_id") % 7 == 0
    recall = F.try_divide(F.count_if(good & (F.col("rank") <= 10)), F.count_if(good))
    return r.groupBy("label").agg(recall.alias("recall"), F.coalesce(F.max(F.when(good, (F.col("rank") <= 5).cast("int"))), F.lit(0)).alias("hit"))


@query("recall_at_k", f"WITH {_RUNS.format(at=1)} SELECT label, round(recall, 6) AS recall FROM q")
def recall_at_k(spark, sf_dir):
    return _quality(spark, sf_dir, 0).select("label", F.round("recall", 6).alias("recall"))


@query("regression_gate", f"""WITH m AS (SELECT * FROM (WITH {_RUNS.format(at=2)} SELECT 'hit_5' AS metric, avg(hit) AS current FROM q UNION ALL SELECT 'recall_10', avg(recall) FROM q)),
 n AS (SELECT * FROM (WITH {_RUNS.format(at=1)} SELECT 'hit_5' AS metric, avg(hit) AS baseline FROM q UNION ALL SELECT 'recall_10', avg(recall) FROM q))
 SELECT metric, round(current, 6) AS current, round(baseline, 6) AS baseline, round(round(baseline, 6) - round(current, 6), 6) AS "drop", metric = 'hit_5' AS gated, metric = 'hit_5' AND round(baseline, 6) - round(current, 6) > 0.05 + 1e-9 AS failed FROM m JOIN n USING (metric)""")
def regression_gate(spark, sf_dir):
    def metrics(at):
        q = _quality(spark, sf_dir, at).agg(F.avg("hit").alias("hit_5"), F.avg("recall").alias("recall_10"))
        return q.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in ("hit_5", "recall_10")])))

    return schema.regression_gate(metrics(1), metrics(0), ["hit_5"])


@query("usage_cost", """SELECT conv_id, sum(len(string_split(text, ' '))) ::BIGINT AS tokens, round(sum(CASE role WHEN 'assistant' THEN len(string_split(text, ' ')) * 0.002e0 END), 6) AS cost FROM conversations GROUP BY 1""")
def usage_cost(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("kind"), F.size(F.split("text", " ")).cast("long").alias("tokens"))
    return schema.usage_cost(turns, "conv_id", spark.createDataFrame([("assistant", 0.002)], "kind string, rate double"))


@query("latest_values", "SELECT conv_id, role, arg_max(md5(text), turn) AS value FROM conversations GROUP BY 1, 2")
def latest_values(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.md5("text").alias("value"))
    return schema.latest_values(rows, ["conv_id", "role"], "value", "turn")


@query("markdown_grid", """WITH r AS (SELECT conv_id, turn, '| ' || turn || ' | ' || replace(replace(role, '\\', '\\\\'), '|', '\\|') || ' | ' ||
  translate(replace(replace(substr(text, 1, 40), '\\', '\\\\'), '|', '\\|'), chr(10) || chr(13), '  ') || ' |' AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
 SELECT conv_id, md5(string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY turn)) AS grid FROM r GROUP BY 1""")
def markdown_grid(spark, sf_dir):
    cell = F.array(F.col("turn").cast("string"), "role", F.substring("text", 1, 40))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))).alias("r"))
    return rows.select("conv_id", F.md5(tables.markdown(F.transform("r", lambda x: x["c"]))).alias("grid"))


@query("page_selector", f"WITH {LINES} SELECT doc_id, page + 1 AS page, count(*) AS n FROM lines WHERE page + 1 IN (1, 3, 4, 5) GROUP BY 1, 2")
def page_selector(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents")).withColumn("page", F.col("page") + 1)
    return b.where(F.col("page").isin(*assemble.page_numbers("1, 3-5", 1000))).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("absorbed_headings", f"""WITH {LINES}, b AS (SELECT doc_id, ord, text, length(text) < 60 AS head FROM lines),
 t AS (SELECT *, coalesce(min(CASE WHEN NOT head THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(CASE WHEN NOT head THEN ord END) OVER (PARTITION BY doc_id), min(ord) OVER (PARTITION BY doc_id)) AS goal FROM b)
 SELECT doc_id, goal AS ord, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM t GROUP BY 1, 2""")
def absorbed_headings(spark, sf_dir):
    b = blocks.paragraphs(table(spark, sf_dir, "documents")).withColumn("block_type", F.when(F.length("text") < 60, "heading").otherwise("paragraph"))
    return assemble.absorb_headings(b).select("doc_id", "ord", F.md5("text").alias("digest"))


_WINDOWS = "w AS (SELECT doc_id, turn AS chunk, text FROM (SELECT conv_id AS doc_id, turn, text FROM conversations))"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")


@query("anchored_chunks", f"""WITH {_WINDOWS}, a AS (SELECT doc_id, trim(string_split(arg_min(text, chunk), chr(10))[1]) AS anchor FROM w GROUP BY 1)
 SELECT doc_id, chunk, coalesce(CASE WHEN anchor <> trim(string_split(text, chr(10))[1]) THEN anchor END, '') AS context FROM w JOIN a USING (doc_id)""")
def anchored_chunks(spark, sf_dir):
    c = _turns(spark, sf_dir)
    anchors = c.groupBy("doc_id").agg(F.trim(F.element_at(F.split(F.min_by("text", "chunk"), "\n"), 1)).alias("anchor"))
    return assemble.anchored(c, anchors).select("doc_id", "chunk", "context")


@query("window_scope", f"WITH {_WINDOWS} SELECT doc_id, chunk, md5(array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10) || chr(10))) AS scope FROM w")
def window_scope(spark, sf_dir):
    return assemble.window_scope(_turns(spark, sf_dir), 1).select("doc_id", "chunk", F.md5("scope").alias("scope"))


@query("zipped_completions", f"WITH {_WINDOWS} SELECT doc_id, chunk, md5(CASE WHEN chunk % 3 = 0 THEN replace(trim(text), 'e', 'E') ELSE text END) AS text FROM w")
def zipped_completions(spark, sf_dir):
    """Every third chunk has a completion, every other third an empty one."""
    c = _turns(spark, sf_dir)
    done = c.where("chunk % 3 < 2").select("doc_id", "chunk", F.when(F.col("chunk") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(" ").alias("completion"))
    return assemble.zipped(c, done).select("doc_id", "chunk", F.md5("text").alias("text"))


@query("document_view", """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)
 SELECT doc_id, md5(CASE WHEN len(w) <= 90 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:60], ' ') || ' … ' || array_to_string(w[-30:], ' ') END) AS view FROM w""")
def document_view(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(assemble.head_and_tail("text", 60, 30)).alias("view"))


@query("embed_eligible", "SELECT conv_id, turn FROM conversations WHERE role <> 'user' AND trim(text) <> '' AND turn % 5 <> 4")
def embed_eligible(spark, sf_dir):
    """Turns of a role that is on, whose text (every fifth is a bare image mark here) has content."""
    rows = table(spark, sf_dir, "conversations").withColumn("shown", F.when(F.col("turn") % 5 == 4, F.concat(F.lit("[Image: "), F.regexp_replace("role", "]", ""), F.lit("]\n"))).otherwise(F.col("text")))
    return rows.where((F.col("role") != "user") & assemble.has_content("shown")).select("conv_id", "turn")


@query("field_values", """SELECT doc_id, 'meta_lang' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'meta_tags', lang || ', ' || source FROM documents
 UNION ALL SELECT doc_id, 'meta_quality', quality::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def field_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("tags", F.array("lang", "source"))
    return assemble.field_values(docs, "doc_id", ["lang", "tags", "quality"])


@query("sidecar_blocks", f"""WITH {LINES} SELECT doc_id, page, n AS ord, CASE WHEN length(text) < 60 THEN 'heading' ELSE 'paragraph' END AS block_type, round(least(1e0, length(text) / 400e0), 6) AS x1, round(least(1e0, (ord % 10) / 10e0), 6) AS y0, md5(text) AS text
 FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INTEGER AS n FROM lines) WHERE length(text) % 5 <> 0""")
def sidecar_blocks(spark, sf_dir):
    """Pages written as a sidecar's JSON and read back as blocks with boxes."""
    b = blocks.paragraphs(table(spark, sf_dir, "documents"))
    box = F.array(F.lit(0.0), (F.col("ord") % 10) * 80.0, F.length("text").cast("double"), F.lit(800.0))
    one = F.struct("ord", F.struct(F.when(F.length("text") % 5 == 0, "watermark").when(F.length("text") < 60, "Section_Header").otherwise("text").alias("label"), box.alias("bbox"), "text").alias("b"))
    pages = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    payload = F.to_json(F.struct("page", F.lit(400.0).alias("width"), F.lit(800.0).alias("height"), F.transform("blocks", lambda x: x["b"]).alias("blocks")))
    rows = assemble.sidecar_blocks(pages.select("doc_id", payload.alias("payload")), "doc_id", "payload")
    at = lambda i: F.round(F.get("box", F.lit(i)), 6)
    return rows.select("doc_id", "page", "ord", "block_type", at(2).alias("x1"), at(1).alias("y0"), F.md5("text").alias("text"))


@query("natural_sort", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def natural_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("/", "source", F.concat(F.lit("stage"), F.col("doc_id").cast("string")), F.lit("out")).alias("path"))
    w = Window.partitionBy("source").orderBy(assemble.natural_key("path"))
    return docs.select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("source_kinds", f"""WITH {LINES}, p AS (SELECT doc_id, page, sum(length(text)) < 1500 AS scanned FROM lines GROUP BY 1, 2)
 SELECT doc_id, CASE WHEN count(*) FILTER (scanned) = 0 THEN 'digital_born' WHEN count(*) FILTER (scanned) = count(*) THEN 'scanned' ELSE 'mixed' END AS kind FROM p GROUP BY 1""")
def source_kinds(spark, sf_dir):
    """A page with little text counts as scanned."""
    pages = blocks.paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg((F.sum(F.length("text")) < 1500).alias("scanned"))
    return pages.groupBy("doc_id").agg(assemble.source_kind(F.count_if("scanned"), F.count("*")).alias("kind"))


@query("point_ids", f"""WITH d AS (SELECT doc_id, sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode(doc_id || ':' || (n_chars % 7))) AS h FROM documents)
 SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM d""")
def point_ids(spark, sf_dir):
    name = F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("n_chars") % 7).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", assemble.point_id(NAMESPACE, name).alias("id"))


@query("element_counts", "SELECT value, count(*) AS n FROM (SELECT unnest([lang, source, lang || '-' || (n_chars % 3)]) AS value FROM documents) GROUP BY 1")
def element_counts(spark, sf_dir):
    """How often each element stands in a JSON list."""
    lists = F.to_json(F.array("lang", "source", F.concat_ws("-", "lang", (F.col("n_chars") % 3).cast("string"))))
    return table(spark, sf_dir, "documents").select(F.explode(F.from_json(lists, "array<string>")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("title_contains", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), source)), 'the ')")
def title_contains(spark, sf_dir):
    """Filters by the title that is shown: the first line, else the source."""
    title = F.coalesce(F.nullif(F.trim(F.element_at(F.split("text", "\n"), 1)), F.lit("")), F.col("source"))
    return table(spark, sf_dir, "documents").where(F.lower(title).contains("the ")).select("doc_id")


@query("carriers", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE lang = 'fr')")
def carriers(spark, sf_dir):
    """Documents that carry a semantic field from either side."""
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return labels.union(table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")).distinct()


@query("stale_points", "SELECT label, vec_id FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 0")
def stale_points(spark, sf_dir):
    """Documents (labels) with even numbers are indexed anew without every third point."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return assemble.stale_points(e, e.where("label % 2 = 0 AND vec_id % 3 <> 0"), "label", "vec_id")


@query("score_kinds", f"WITH {RRF} SELECT query_id, count(*) AS hits, 'rrf_fusion' AS score_kind FROM (SELECT query_id, {RANK} AS rank FROM fused QUALIFY rank <= 10) GROUP BY 1")
def score_kinds(spark, sf_dir):
    parts = branches(spark, sf_dir)
    hits = retrieval.ranked(retrieval.fuse_ranks(parts, "doc_id"), "doc_id", 10)
    return hits.groupBy("query_id").agg(F.count("*").alias("hits")).withColumn("score_kind", F.lit(retrieval.score_kind(["dense", "sparse"], "rrf")))


_W = "list_distinct(regexp_extract_all(lower({}.text), '[\\p{{L}}]+'))"


@query("reranked_hits", f"""WITH {RRF}, top AS (SELECT query_id, doc_id, score AS fusion_score, {RANK} AS r FROM fused QUALIFY r <= 50),
 s AS (SELECT query_id, top.doc_id, fusion_score, r, round(len(list_intersect({_W.format('q')}, {_W.format('d')}))::DOUBLE / len({_W.format('q')}), 6) AS score FROM top JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = top.doc_id),
 f AS (SELECT query_id, doc_id, fusion_score, r, CASE WHEN max((score IS NULL)::INT) OVER (PARTITION BY query_id) = 1 THEN fusion_score ELSE score END AS score FROM s)
 SELECT query_id, doc_id, fusion_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM f QUALIFY rank <= 10""")
def reranked_hits(spark, sf_dir):
    """The scorer is the share of the asking document's words that a hit has."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    hits = retrieval.ranked(retrieval.fuse_ranks(branches(spark, sf_dir), "doc_id"), "doc_id", 50)
    hits = hits.join(docs.select("doc_id", words.alias("words")), "doc_id").join(docs.select(F.col("doc_id").alias("query_id"), words.alias("asked")), "query_id")
    score = F.round(F.try_divide(F.size(F.array_intersect("asked", "words")), F.size("asked")), 6)
    return assemble.reranked(hits, score, 10).select("query_id", "doc_id", "fusion_score", "score", "rank")
