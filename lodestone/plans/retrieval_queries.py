"""Registered retrieval queries over documents, embeddings and benchmark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import stems
from lodestone.functions.text import FOLD, LIGATURES, STOP_WORDS, surface
from lodestone.operators import filters, retrieval
from lodestone.plans.registry import query
from lodestone.sources import postings as stored
from lodestone.sources.tables import dealt, table
from lodestone.streaming.streams import shared_folder

ASKED = "The Apache license of worthless things and the great token"
FILTER = {"lang": ["en", "fr"], "n_chars": {"gte": 300}}
KINDS = {"lang": "keyword", "n_chars": "integer", "source": "keyword", "text": "text", "doc_id": "integer"}


def _fold_sql(c: str) -> str:
    out = f"lower({c})"
    for k, v in LIGATURES.items():
        out = f"replace({out}, '{k}', '{v}')"
    return f"translate({out}, '{''.join(FOLD)}', '{''.join(v * len(k) for k, v in FOLD.items())}')"


def terms_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all({_fold_sql(c)}, '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({stop}))"


POSTINGS = f"""words AS (SELECT doc_id, t, len(t) AS length FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)),
 tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM words) GROUP BY ALL),
 posts AS (SELECT doc_id, term, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / 256e0)) AS weight FROM tf)"""
LEXICAL = f"""{POSTINGS},
 asked AS (SELECT DISTINCT 0::BIGINT AS query_id, unnest({terms_sql(f"'{ASKED}'")}) AS term),
 n AS (SELECT count(*) AS total FROM documents),
 weights AS (SELECT term, ln(1 + (total - count(DISTINCT doc_id) + 0.5e0) / (count(DISTINCT doc_id) + 0.5e0)) AS idf FROM posts, n GROUP BY term, total),
 lexical AS (SELECT query_id, doc_id, round(sum(weight * idf), 6) AS score FROM asked JOIN posts USING (term) JOIN weights USING (term) GROUP BY ALL)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def lexical(spark: SparkSession, sf_dir: str, text: str = ASKED, analyzer=surface) -> DataFrame:
    """Scores of one stated query; postings of its terms only."""
    docs, words = dealt(spark, sf_dir, "documents"), list(dict.fromkeys(analyzer(text)[0]))
    asked = spark.createDataFrame([(0, w) for w in words], "query_id long, term string")
    return retrieval.lexical_scores(retrieval.postings(docs, "doc_id", analyzer=analyzer, only=words), asked, "doc_id", docs.count())


@query("bm25_postings", f"WITH {POSTINGS} SELECT term, count(*) AS documents, round(sum(weight), 4) AS weight FROM posts GROUP BY term")
def bm25_postings(spark, sf_dir):
    posts = retrieval.postings(dealt(spark, sf_dir, "documents"), "doc_id")
    return posts.groupBy("term").agg(F.count("*").alias("documents"), F.round(F.sum("weight"), 4).alias("weight"))


@query("bm25_search", f"""WITH {LEXICAL} SELECT doc_id, score, {RANK} AS rank FROM lexical JOIN documents USING (doc_id)
 WHERE lang IN ('en', 'fr') AND n_chars >= 300 QUALIFY rank <= 10""")
def bm25_search(spark, sf_dir):
    """Filter before the ranking window, never after; idf over the whole store."""
    fits = table(spark, sf_dir, "documents").where(filters.build(FILTER, KINDS)).select("doc_id")
    return retrieval.ranked(lexical(spark, sf_dir).join(fits, "doc_id", "left_semi"), "doc_id", 10).select("doc_id", "score", "rank")


DENSE_ALL = """dense AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings a, embeddings b)"""
DENSE = DENSE_ALL[:-1] + " WHERE a.vec_id % 100 = 0)"


EVERY = 100  #: the queries are the rows whose id it divides, so they grow with the table; of hybrid_rrf_all and hybrid_weighted_all, all rows


def asking(rows: DataFrame, id_column: str, every: int) -> DataFrame:
    return rows if every == 1 else rows.where(F.col(id_column) % every == 0)


def dense(spark: SparkSession, sf_dir: str, most: int, every: int = EVERY) -> DataFrame:
    """The `most` best of each query, ranked, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    asked = asking(e, "vec_id", every).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_top(e, asked, "vec_id", most).withColumnRenamed("vec_id", "doc_id")


DENSE_SEARCH = f"WITH {DENSE} SELECT query_id, doc_id, score, {RANK} AS rank FROM dense QUALIFY rank <= 10"


@query("dense_search", DENSE_SEARCH)
@query("dense_search_all", DENSE_SEARCH)
def dense_search(spark, sf_dir):
    return dense(spark, sf_dir, 10)


# a lexical branch for the same queries: the documents whose ids are the vectors' ids
def branches_sql(dense: str, asked: str) -> str:
    return f"""{POSTINGS},
 asked AS (SELECT DISTINCT doc_id AS query_id, term FROM posts{asked}),
 n AS (SELECT count(*) AS total FROM documents),
 weights AS (SELECT term, ln(1 + (total - count(DISTINCT doc_id) + 0.5e0) / (count(DISTINCT doc_id) + 0.5e0)) AS idf FROM posts, n GROUP BY term, total),
 lexical AS (SELECT query_id, doc_id, round(sum(weight * idf), 6) AS score FROM asked JOIN posts USING (term) JOIN weights USING (term) GROUP BY ALL),
 {dense},
 b1 AS (SELECT *, {RANK} AS rank FROM dense QUALIFY rank <= 100),
 b2 AS (SELECT *, {RANK} AS rank FROM lexical QUALIFY rank <= 100)"""


BRANCHES, BRANCHES_ALL = branches_sql(DENSE, " WHERE doc_id % 100 = 0"), branches_sql(DENSE_ALL, "")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they are made once."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.options(**retrieval.PART).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def branches(spark: SparkSession, sf_dir: str, every: int = EVERY) -> list[DataFrame]:
    docs = dealt(spark, sf_dir, "documents")
    slices = kept(retrieval.term_slices(docs, "doc_id"), "term_slices")
    bags = retrieval.term_bags(asking(table(spark, sf_dir, "documents") if every > 1 else docs, "doc_id", every), "doc_id")
    found = retrieval.bags_top(slices, bags.select(F.col("doc_id").alias("query_id"), "terms"), "doc_id", retrieval.depth(10))
    return [dense(spark, sf_dir, retrieval.depth(10), every), found]


def rrf_sql(branches: str) -> str:
    return f"""{branches}, fused AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 1e0 / (1 + rank) AS s FROM b1 UNION ALL SELECT query_id, doc_id, 1e0 / (1 + rank) FROM b2) GROUP BY ALL)"""


RRF, HYBRID_RRF = rrf_sql(BRANCHES), f" SELECT query_id, doc_id, score, {RANK} AS rank FROM fused QUALIFY rank <= 10"


@query("hybrid_rrf", f"WITH {RRF}{HYBRID_RRF}")
def hybrid_rrf(spark, sf_dir, every=EVERY):
    return retrieval.ranked(retrieval.fuse_ranks(branches(spark, sf_dir, every), "doc_id"), "doc_id", 10)


@query("hybrid_rrf_all", f"WITH {rrf_sql(BRANCHES_ALL)}{HYBRID_RRF}")
def hybrid_rrf_all(spark, sf_dir):
    """Every row asks."""
    return hybrid_rrf(spark, sf_dir, 1)


_DBSF = "CASE WHEN stddev_samp(score) OVER w > 0 THEN (score - (avg(score) OVER w - 3 * stddev_samp(score) OVER w)) / (6 * stddev_samp(score) OVER w) ELSE 0.5e0 END"


HYBRID_DBSF_SQL = f"""WITH {BRANCHES}, fused AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (
  SELECT query_id, doc_id, {_DBSF} AS s FROM b1 WINDOW w AS (PARTITION BY query_id) UNION ALL
  SELECT query_id, doc_id, {_DBSF} FROM b2 WINDOW w AS (PARTITION BY query_id)) GROUP BY ALL)
 SELECT query_id, doc_id, score, {RANK} AS rank FROM fused QUALIFY rank <= 10"""


@query("hybrid_dbsf", HYBRID_DBSF_SQL)
@query("hybrid_dbsf_all", HYBRID_DBSF_SQL)
def hybrid_dbsf(spark, sf_dir):
    return retrieval.ranked(retrieval.fuse_distributions(branches(spark, sf_dir), "doc_id"), "doc_id", 10)


def weighted_sql(branches: str) -> str:
    return f"""WITH {branches}, fused AS (SELECT query_id, doc_id, round(sum(s), 8) AS score FROM (
  SELECT query_id, doc_id, score * 0.7e0 AS s FROM b1 UNION ALL SELECT query_id, doc_id, score * 0.01e0 FROM b2) GROUP BY ALL)
 SELECT query_id, doc_id, score, {RANK} AS rank FROM fused QUALIFY rank <= 10"""


@query("hybrid_weighted", weighted_sql(BRANCHES))
def hybrid_weighted(spark, sf_dir, every=EVERY):
    a, b = branches(spark, sf_dir, every)
    return retrieval.ranked(retrieval.weighted_sum([(a, 0.7), (b, 0.01)], "doc_id"), "doc_id", 10)


@query("hybrid_weighted_all", weighted_sql(BRANCHES_ALL))
def hybrid_weighted_all(spark, sf_dir):
    """Every row asks."""
    return hybrid_weighted(spark, sf_dir, 1)


BRANCH_CONTRIBUTION_SQL = f"""WITH {BRANCHES} SELECT query_id, count(*) FILTER (b1.doc_id IS NOT NULL AND b2.doc_id IS NOT NULL) AS n_both,
 count(*) FILTER (b2.doc_id IS NULL) AS n_dense, count(*) FILTER (b1.doc_id IS NULL) AS n_lexical FROM b1 FULL JOIN b2 USING (query_id, doc_id) GROUP BY query_id"""


@query("branch_contribution", BRANCH_CONTRIBUTION_SQL)
@query("branch_contribution_all", BRANCH_CONTRIBUTION_SQL)
def branch_contribution(spark, sf_dir):
    return retrieval.contribution(*branches(spark, sf_dir), "doc_id")


@query("grouped_hits", f"""WITH {LEXICAL}, hits AS (SELECT query_id, source, doc_id, score, {RANK} AS r FROM lexical JOIN documents USING (doc_id)),
 kept AS (SELECT * FROM hits WHERE r <= 40 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY r) <= 2)
 SELECT query_id, source, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM kept QUALIFY rank <= 10""")
def grouped_hits(spark, sf_dir):
    """At most two hits of a source among the first forty."""
    hits = retrieval.ranked(lexical(spark, sf_dir), "doc_id", retrieval.fetch_depth(10, 2))
    named = hits.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.cap_per_document(named, "source", 10, 2).select("query_id", "source", "doc_id", "score", "rank")


@query("min_score_report", f"WITH {LEXICAL} SELECT count(*) AS n_dropped, max(score) AS top_dropped FROM lexical WHERE score < 5")
def min_score_report(spark, sf_dir):
    return retrieval.dropped_by_score(lexical(spark, sf_dir), 5.0)


@query("min_score_hits", f"WITH {LEXICAL} SELECT query_id, doc_id, score FROM lexical WHERE score >= 3")
def min_score_hits(spark, sf_dir):
    return retrieval.min_score(lexical(spark, sf_dir), 3.0)


@query("hydrated_hits", f"""WITH {LEXICAL}, top AS (SELECT doc_id, score, {RANK} AS rank FROM lexical QUALIFY rank <= 20)
 SELECT rank, doc_id, score, source, lang, substr(text, 1, 80) AS snippet, coalesce(quality, -1) AS quality FROM top JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def hydrated_hits(spark, sf_dir):
    """The cut set alone is joined to its rows; what has vanished drops out."""
    top = retrieval.ranked(lexical(spark, sf_dir), "doc_id", 20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.substring("text", 1, 80).alias("snippet"))
    rows = docs.join(F.broadcast(top), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("rank", "doc_id", "score", "source", "lang", "snippet", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("disabled_excluded", f"WITH {LEXICAL} SELECT doc_id, score, {RANK} AS rank FROM lexical WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) QUALIFY rank <= 10")
def disabled_excluded(spark, sf_dir):
    off = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return retrieval.ranked(lexical(spark, sf_dir).join(off, "doc_id", "left_anti"), "doc_id", 10).select("doc_id", "score", "rank")


@query("keyset_browse", "SELECT source, doc_id, n_chars FROM documents WHERE (source, doc_id) > ('src3', 500) ORDER BY source, doc_id LIMIT 26")
def keyset_browse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return retrieval.keyset_page(docs, ["source", "doc_id"], 25, ("src3", 500))


@query("facet_counts", "SELECT source, count(*) AS points FROM documents WHERE lower(lang) = 'en' AND n_chars > 1000 GROUP BY source")
def facet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(filters.build({"lang": "EN", "n_chars": {"gt": 1000}}, KINDS))
    return rows.groupBy("source").agg(F.count("*").alias("points"))


def _filter_query(name: str, spec: dict, sql: str) -> None:
    @query(f"filter_{name}", f"WITH d AS (SELECT documents.*, quality, CASE WHEN toxic = 1 THEN 'Toxic' END AS flag, list_filter(string_split(lang || ',' || source, ','), lambda x: x <> 'src1') AS tags FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id FROM d WHERE {sql}")
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
        tags = F.filter(F.split(F.concat_ws(",", "lang", "source"), ","), lambda x: x != "src1")
        rows = docs.withColumns({"flag": F.when(F.col("toxic") == 1, "Toxic"), "tags": tags})
        return rows.where(filters.build(spec, KINDS | {"quality": "integer", "flag": "keyword", "tags": "keyword_list"})).select("doc_id")


_filter_query("equal", {"flag": "toxic"}, "lower(flag) = 'toxic'")
_filter_query("any_of", {"quality": [0, 2]}, "quality IN (0, 2)")
_filter_query("negated", {"flag": {"not": "TOXIC"}}, "NOT coalesce(lower(flag) = 'toxic', false)")
_filter_query("none_of", {"tags": {"not_in": ["FR", "src2"]}}, "NOT coalesce(list_has_any(tags, ['fr', 'src2']), false)")
_filter_query("exists", {"quality": {"exists": False}}, "quality IS NULL")
_filter_query("list_equal", {"tags": "EN", "n_chars": {"lt": 2000}}, "list_contains(tags, 'en') AND n_chars < 2000")
_filter_query("contains", {"source": {"contains": "C1"}}, "contains(lower(source), 'c1')")
_filter_query("prefix", {"tags": {"prefix": "SRC1"}}, "len(list_filter(tags, lambda x: starts_with(lower(x), 'src1'))) > 0")
_filter_query("full_text", {"text": {"contains": "license MIT"}}, f"list_has_all(regexp_extract_all({_fold_sql('text')}, '[\\p{{L}}\\p{{N}}]+'), ['license', 'mit'])")
_filter_query("range", {"n_chars": {"gte": 500, "lt": 900}, "doc_id": {"lte": 700}}, "n_chars >= 500 AND n_chars < 900 AND doc_id <= 700")


STEMMED = "Les marchés publics et la nation des réseaux thionly tokens licensed under the inner tions"


@query("stem_postings")
def stem_postings(spark, sf_dir):
    """Documents and weight of every stem."""
    posts = retrieval.postings(dealt(spark, sf_dir, "documents"), "doc_id", analyzer=stems.analyze)
    return posts.groupBy("term").agg(F.count("*").alias("documents"), F.round(F.sum("weight"), 4).alias("weight"))


@query("stem_search")
def stem_search(spark, sf_dir):
    """The ten best documents by stems, over a stored index of which the asked terms are read."""
    docs, path = dealt(spark, sf_dir, "documents"), f"{shared_folder(spark)}/stems"
    stored.store(retrieval.postings(docs, "doc_id", analyzer=stems.analyze), path)
    words = list(dict.fromkeys(stems.analyze(STEMMED)[0]))
    asked = spark.createDataFrame([(0, w) for w in words], "query_id long, term string")
    return retrieval.ranked(retrieval.lexical_scores(stored.load(spark, path, words), asked, "doc_id", docs.count()), "doc_id", 10).select("doc_id", "score", "rank")
