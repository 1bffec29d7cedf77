"""Registered queries on trees, typed answers, committed runs and similar values."""

from pyspark.sql import functions as F

from lodestone.functions.vectors import dot
from lodestone.operators import accounts, conditions, grid, hints, trees
from lodestone.operators.conditions import Condition
from lodestone.plans.registry import query
from lodestone.sources import corpora, runs
from lodestone.sources.tables import table
from lodestone.streaming.streams import shared_folder


def _settings(spark, sf_dir):
    """A tree of settings for each conversation, before and after: turns by id under a pipeline, some gone, new or changed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    node = lambda n, key: F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.struct("role", n.alias("size")).alias("config"), key.alias("api_key"))
    before = node(F.col("n"), F.lit("k1"))
    after = node(F.when(F.col("turn") % 2 == 1, F.col("n") + 1).otherwise(F.col("n")), F.when(F.col("turn") % 3 == 1, "k2").otherwise("k1"))
    rows = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("turn") % 5 != 4, before))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("turn") % 4 != 3, after))).alias("a"), F.count("*").alias("turns"),
    )
    odd = F.col("conv_id") % 2 == 1
    tree = lambda nodes, k: F.to_json(F.struct(F.struct(F.col(nodes).alias("nodes"), F.array(F.lit(1), F.lit(k)).alias("order")).alias("pipeline"), F.struct(F.when(odd, F.lit(k)).alias("a/b")).alias("search")))
    return rows.select("conv_id", tree("b", 1).alias("before"), tree("a", 2).alias("after"))


CHANGES = """WITH t AS (SELECT conv_id, turn, length(text) AS n, turn % 5 <> 4 AS inb, turn % 4 <> 3 AS ina, role FROM conversations), s AS (SELECT DISTINCT conv_id FROM conversations),
 any_both AS (SELECT conv_id, count(*) FILTER (inb) AS nb, count(*) FILTER (ina) AS na FROM t GROUP BY 1),
 c AS (SELECT conv_id, '/pipeline/nodes/t' || turn AS path, CASE WHEN inb THEN 'removed' ELSE 'added' END AS change FROM t WHERE inb <> ina
  UNION ALL SELECT conv_id, '/pipeline/nodes/t' || turn || '/config/size', 'changed' FROM t WHERE inb AND ina AND turn % 2 = 1
  UNION ALL SELECT conv_id, '/pipeline/nodes/t' || turn || '/api_key', 'changed' FROM t WHERE inb AND ina AND turn % 3 = 1
  UNION ALL SELECT conv_id, '/pipeline/order', 'changed' FROM s UNION ALL SELECT conv_id, '/search/a~1b', 'changed' FROM s WHERE conv_id % 2 = 1)
"""


@query("config_tree_diff", f"{CHANGES} SELECT conv_id, path, change FROM c JOIN any_both USING (conv_id) WHERE nb > 0 AND na > 0")
def config_tree_diff(spark, sf_dir):
    """Paths in which the settings of every conversation differ."""
    return trees.json_changes(_settings(spark, sf_dir), "conv_id", "before", "after").select("conv_id", "path", "change")


@query("config_change_labels", f"""{CHANGES}, l AS (SELECT conv_id, path, change, CASE WHEN path LIKE '/pipeline/nodes/%' THEN 'pipeline:' || split_part(path, '/', 4) WHEN path LIKE '/pipeline/%' THEN 'pipeline:(graph)' ELSE split_part(path, '/', 2) END AS label FROM c JOIN any_both USING (conv_id) WHERE nb > 0 AND na > 0)
 SELECT conv_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, count(*) FILTER (path LIKE '%/api_key') AS masked FROM l GROUP BY 1""")
def config_change_labels(spark, sf_dir):
    """What areas changed, and how the masked secrets show."""
    changes = trees.json_changes(_settings(spark, sf_dir), "conv_id", "before", "after")
    shown = changes.groupBy("conv_id").agg(F.count_if(F.col("before") == trees.MASK).alias("masked"))
    return trees.change_labels(changes, "conv_id").join(shown, "conv_id").withColumn("labels", F.array_join("labels", ","))


FIELDS = [
    trees.Field("size", "integer", required=True), trees.Field("share", "float"), trees.Field("even", "bool"), trees.Field("kind", "enum", ("View", "Click", "Purchase")), trees.Field("at", "datetime"), trees.Field("tags", "keyword_list"),
    trees.Field("numbers", "integer_list"),
]


@query("coerced_answers", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS size, CASE WHEN event_id % 4 <> 0 THEN value END AS share, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS even,
  CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase' END AS kind, len(CASE WHEN event_id % 6 <> 0 THEN [1] ELSE [] END)::INTEGER AS tags,
  CASE WHEN event_id % 7 = 0 THEN event_id::VARCHAR || ',' || (event_id + 1)::VARCHAR END AS numbers, (event_id % 3 = 0)::INTEGER + (event_id % 4 = 0)::INTEGER + (event_id % 5 = 0)::INTEGER + (event_type NOT IN ('view', 'click', 'purchase'))::INTEGER + (event_id % 6 = 0)::INTEGER + (event_id % 7 <> 0)::INTEGER AS errors FROM events""")
def coerced_answers(spark, sf_dir):
    """Answers with strings for numbers, fractions for integers, unknown labels and mixed lists, coerced to their fields."""
    i = F.col("event_id")
    answer = F.to_json(F.struct(
        F.when(i % 3 == 0, F.lit("3.7")).otherwise(F.col("user_id").cast("string")).alias("size"), F.when(i % 4 == 0, F.lit("much")).otherwise(F.col("value").cast("string")).alias("share"),
        F.when(i % 5 == 0, F.lit("maybe")).when(i % 2 == 0, "Yes").otherwise("false").alias("even"), F.upper("event_type").alias("kind"), F.array(F.when(i % 6 != 0, F.lit(" a ")), F.lit(" ")).alias("tags"),
        F.when(i % 7 == 0, F.array(i.cast("string"), F.lit("x"), (i + 1).cast("string"))).otherwise(F.array(F.lit("x"))).alias("numbers"),
    ))
    rows = trees.coerced(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), "answer", FIELDS, ("v", "e"))
    return rows.select("event_id", "v.size", "v.share", "v.even", "v.kind", F.coalesce(F.size("v.tags"), F.lit(0)).alias("tags"), F.array_join(F.col("v.numbers").cast("array<string>"), ",").alias("numbers"), F.size("e").alias("errors"))


@query("published_runs", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS text FROM documents), two AS (SELECT doc_id, ord, text FROM l WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, ord, '* ' || text FROM l WHERE doc_id % 3 = 0 AND ord % 2 = 0)
 SELECT doc_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY ord)) AS text, doc_id % 3 = 0 AS anew FROM two GROUP BY doc_id""")
def published_runs(spark, sf_dir):
    """Two runs over documents and their lines: the second brings a third of the documents anew, and coming again changes nothing."""
    root, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    runs.write_run(spark, root, 1, {"lines": lines, "documents": docs.select("doc_id", F.lit(False).alias("anew"))}, "doc_id")
    for _ in range(2):
        again = lines.where("doc_id % 3 = 0 AND ord % 2 = 0").withColumn("text", F.concat(F.lit("* "), "text"))
        runs.write_run(spark, root, 2, {"lines": again, "documents": docs.where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("anew"))}, "doc_id")
    kept = runs.read(spark, root, "lines").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    out = kept.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("text"))
    return out.join(runs.read(spark, root, "documents"), "doc_id")


@query("vector_backfill", "SELECT vec_id, len(embedding)::INTEGER AS n, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_backfill(spark, sf_dir):
    """The table of vectors rewritten with their norms, part by part, and swapped in when all parts are there."""
    root = shared_folder(spark)
    runs.write_run(spark, root, 1, {"vectors": table(spark, sf_dir, "embeddings").select("vec_id", "embedding")})
    runs.backfill(spark, root, "vectors", "vec_id", lambda rows: rows.withColumn("norm", F.sqrt(dot("embedding", "embedding"))), version=2, parts=4)
    return runs.read(spark, root, "vectors").select("vec_id", F.size("embedding").alias("n"), F.round("norm", 5).alias("norm"))


_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("values_similar_pairs", f"""WITH v AS (SELECT value, count(*) AS n FROM (SELECT unnest({_WORDS}) AS value FROM conversations) GROUP BY 1), needles AS (SELECT DISTINCT {_WORDS}[1] AS needle FROM benchmark),
 r AS (SELECT needle, value, n, round(1 - levenshtein(value, needle)::DOUBLE / greatest(length(value), length(needle)), 6) AS ratio FROM needles, v) SELECT * FROM r WHERE ratio >= 0.6""")
def values_similar_pairs(spark, sf_dir):
    """For the first word of every benchmark item, all like words of the conversations."""
    words = lambda name: table(spark, sf_dir, name).select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    counts = words("conversations").select(F.explode("w").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return grid.similar_pairs(words("benchmark").select(F.get("w", F.lit(0)).alias("needle")), counts)


# metadata, usage, storage -------------------------------------------------------------------------------------------------------

TYPES = {"tags": "keyword_list", "numbers": "integer_list", "size": "integer", "lang": "enum", "seen": "datetime"}


def _values(spark, sf_dir):
    """Metadata of all documents as JSON values."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    seen = F.date_format(F.timestamp_seconds(1_700_000_000 + i * 86_400), "yyyy-MM-dd'T'HH:mm:ss")
    pairs = {"tags": F.array(F.col("lang"), F.concat(F.lit("g"), (i % 5).cast("string"))), "numbers": F.array(i % 7, i % 11), "size": F.col("n_chars"), "lang": F.col("lang"), "seen": seen}
    json = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    each = F.array(*[F.struct(F.lit(k).alias("field"), json(c).alias("value")) for k, c in pairs.items()])
    return docs.select("doc_id", F.inline(each))


@query("metadata_conditions", """SELECT doc_id FROM documents WHERE (lang IN ('en', 'fr') OR doc_id % 5 = 3) AND (doc_id % 7 IN (2, 5) OR doc_id % 11 IN (2, 5)) AND n_chars >= 300 AND lang <> 'de' AND contains(lang, 'e') AND to_timestamp(1700000000 + doc_id * 86400)::TIMESTAMP <= TIMESTAMP '2024-05-01 00:00:00'""")
def metadata_conditions(spark, sf_dir):
    """Documents by conditions on lists of texts and of numbers, sizes, labels and times."""
    asked = [Condition("tags", "in", ["en", "fr", "g3"]), Condition("numbers", "in", [2, 5]), Condition("size", "gte", 300), Condition("lang", "contains", "E"), Condition("lang", "in", ["en", "es", "fr"]), Condition("seen", "lte", "2024-05-01T00:00:00")]
    return conditions.meeting(table(spark, sf_dir, "documents").select("doc_id"), _values(spark, sf_dir), "doc_id", asked, TYPES)


@query("usage_tree", """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'small' WHEN 'assistant' THEN 'large' ELSE 'none' END AS model, length(text) AS p, turn + 1 AS c, CASE WHEN turn % 4 = 3 THEN 2 ELSE 0 END AS pages FROM conversations)
 SELECT conv_id, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(CASE WHEN model = 'none' THEN NULL WHEN pages > 0 THEN pages * CASE model WHEN 'large' THEN 0.25e0 ELSE NULL END WHEN model = 'small' THEN (p * 2e0 + c * 4e0) / 1e6 ELSE (p * 10e0 + c * 30e0) / 1e6 END), 6) AS cost, count(*) AS leaves FROM t GROUP BY 1""")
def usage_tree(spark, sf_dir):
    """Usage of every conversation as a tree of records: even turns hold the odd ones that follow them."""
    turns = table(spark, sf_dir, "conversations")
    model = F.when(F.col("role") == "user", "small").when(F.col("role") == "assistant", "large").otherwise("none")
    usage = F.struct(model.alias("model"), F.length("text").alias("prompt_tokens"), (F.col("turn") + 1).alias("completion_tokens"), F.when(F.col("turn") % 4 == 3, 2).otherwise(0).alias("pages"))
    record = turns.select("conv_id", "turn", usage.alias("usage"))
    leaf = record.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("turn", "usage"))).alias("r"))
    pair = leaf.select("conv_id", F.struct(F.get("r", F.lit(0))["usage"].alias("usage"), F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: F.struct(x["usage"].alias("usage"))).alias("children")).alias("node"))
    runs_ = pair.groupBy("conv_id").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list("node").alias("children"))).alias("children"))).alias("record"))
    rates = spark.createDataFrame([("small", 2.0, 4.0, None), ("large", 10.0, 30.0, 0.25)], "model string, per_prompt double, per_completion double, per_page double")
    return accounts.usage_totals(accounts.usage_leaves(runs_, "conv_id", "record"), "conv_id", rates)


@query("storage_rollup", """WITH docs AS (SELECT doc_id, 'documents' AS bucket, 16 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) AS b FROM documents),
 lines AS (SELECT doc_id, 'blocks' AS bucket, 16 + octet_length(encode(l)) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
 words AS (SELECT doc_id, 'chunks' AS bucket, 24 AS b FROM (SELECT doc_id, unnest(range(0, greatest(0, len(string_split(text, ' ')) - 96) + 1, 96)) FROM documents)),
 labels_ AS (SELECT doc_id, 'metadata' AS bucket, 8 + CASE WHEN quality IS NULL THEN 0 ELSE 8 END + CASE WHEN toxic IS NULL THEN 0 ELSE 8 END AS b FROM labels),
 jobs AS (SELECT user_id AS doc_id, 'observability' AS bucket, 24 + octet_length(encode(event_type)) AS b FROM events)
 SELECT doc_id, bucket, count(*) AS rows, sum(b)::BIGINT AS bytes FROM (SELECT * FROM docs UNION ALL SELECT * FROM lines UNION ALL SELECT * FROM words UNION ALL SELECT * FROM labels_ UNION ALL SELECT * FROM jobs) GROUP BY 1, 2""")
def storage_rollup(spark, sf_dir):
    """Bytes of every document in its row, lines, chunks, labels and jobs (an event's user stands for its document)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(F.split("text", " ", -1)) - F.lit(96)), F.lit(96))
    cut = docs.select("doc_id", F.posexplode(starts).alias("chunk", "start"))
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "ts", "event_type")
    return accounts.footprint([("documents", docs), ("blocks", lines), ("chunks", cut), ("metadata", table(spark, sf_dir, "labels")), ("observability", jobs)], "doc_id")


# corpora ------------------------------------------------------------------------------------------------------------------------


def benchmark_papers(spark, sf_dir):
    """Papers of the benchmark's items: a section a line, its paragraphs a sentence each; the first words ask, every other line answers."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "\n", -1).alias("l"), "text")
    answer = lambda x, i: F.struct((i % 3 == 2).alias("unanswerable"), F.array(x, F.concat(F.lit("FLOAT SELECTED: "), x), x).alias("evidence"))
    return items.select(
        F.col("item_id").cast("string").alias("id"), F.substring_index("text", " ", 3).alias("title"),
        F.struct(F.transform("l", lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("Part "), i.cast("string"))).otherwise(" ")).alias("section_name"), F.transform("l", lambda x: F.split(x, r"\. ", -1)).alias("paragraphs")).alias("full_text"),
        F.struct(F.array(F.lit("What?"), F.lit(" ")).alias("question"), F.array(F.struct(F.transform("l", answer).alias("answer")), F.struct(F.transform("l", answer).alias("answer"))).alias("answers")).alias("qas"),
    )


@query("corpus_pages", """WITH l AS (SELECT item_id, text, string_split(text, chr(10)) AS ls FROM benchmark), s AS (SELECT item_id, text, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM l),
 p AS (SELECT item_id, text, i, generate_subscripts(string_split(line, '. '), 1) AS j, unnest(string_split(line, '. ')) AS p FROM s),
 e AS (SELECT item_id, text, i, j, '<p>' || replace(replace(replace(replace(replace(trim(p), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>' AS h FROM p WHERE trim(p) <> '' UNION ALL SELECT item_id, text, i, 0, '<h2>Part ' || i || '</h2>' FROM s WHERE i % 2 = 0),
 t AS (SELECT item_id, replace(replace(replace(replace(replace(trim(array_to_string(string_split(text, ' ')[1:3], ' ')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM benchmark)
 SELECT item_id::VARCHAR AS id, md5('<!doctype html><html><head><title>' || min(t) || '</title></head><body>' || chr(10) || '<h1>' || min(t) || '</h1>' || chr(10) || string_agg(h, chr(10) ORDER BY i, j) || chr(10) || '</body></html>') AS html FROM e JOIN t USING (item_id) GROUP BY item_id""")
def corpus_pages(spark, sf_dir):
    return corpora.pages(benchmark_papers(spark, sf_dir)).withColumn("html", F.md5("html"))


@query("corpus_questions", """WITH l AS (SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM benchmark),
 u AS (SELECT item_id, trim(line) AS e, min(i) AS i FROM l WHERE i % 3 <> 2 AND len(regexp_extract_all(line, '\\S+')) >= 5 GROUP BY 1, 2)
 SELECT item_id::VARCHAR AS id, 0 AS number, 'What?' AS question, md5(string_agg(e, chr(10) ORDER BY i)) AS evidences, count(*)::INTEGER AS n FROM u GROUP BY 1""")
def corpus_questions(spark, sf_dir):
    rows = corpora.questions(benchmark_papers(spark, sf_dir))
    return rows.select("id", "number", "question", F.md5(F.array_join("evidences", "\n")).alias("evidences"), F.size("evidences").alias("n"))


@query("filter_hints", """WITH s AS (SELECT 'source' AS field, source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents), d AS (SELECT DISTINCT field, value FROM s),
 asked AS (SELECT DISTINCT field, upper(value) AS value, false AS excluded FROM d UNION SELECT field, value || 'x', true FROM d UNION SELECT field, 'qqqqqqqq', false FROM d),
 o AS (SELECT * FROM asked WHERE (field, lower(value)) NOT IN (SELECT field, lower(value) FROM d)),
 r AS (SELECT o.field, o.value, o.excluded, d.value AS other, round(1 - levenshtein(lower(d.value), lower(o.value))::DOUBLE / greatest(length(d.value), length(o.value)), 6) AS ratio FROM o JOIN d USING (field)),
 t AS (SELECT field, value, excluded, string_agg(other, ', ' ORDER BY ratio DESC, other) AS s FROM (SELECT * FROM r WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY field, value, excluded ORDER BY ratio DESC, other) <= 3) GROUP BY ALL)
 SELECT o.field, o.value, o.excluded, 'No document has ' || o.field || ' = "' || o.value || '"' || CASE WHEN o.excluded THEN ', so this exclusion removes nothing.' ELSE '.' END || coalesce(' Closest stored values: ' || s || '.', ' No stored value of this field is close to it.') AS message FROM o LEFT JOIN t USING (field, value, excluded)""")
def filter_hints(spark, sf_dir):
    """What is said of asked values of documents that are not there: all stored ones with a letter more, and one like none."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("source", "lang")])))
    stored = each.groupBy("field", "value").agg(F.count("*").alias("n"))
    known = stored.select("field", "value")
    no, yes = F.lit(False).alias("excluded"), F.lit(True).alias("excluded")
    asked = known.select("field", F.upper("value").alias("value"), no).union(known.select("field", F.concat("value", F.lit("x")), yes)).union(known.select("field", F.lit("qqqqqqqq"), no)).distinct()
    return hints.unmatched(asked, stored).drop("suggestions")
