"""Filter interaction audit: what each of five filters removes, at every step of every order in which they can be applied.

One pass gives each document a mask of the filters it fails. Documents are counted into cells (part, mask); a recursive common
table expression then extends prefixes of filters by each letter that is not in them yet, joins the part's cells at every level
and carries the bits applied so far, so that a level emits the metrics of its step. The recursion reads cells only: at most 32 a
part, however many documents there are.

Defined cases: a null text is empty, and equal to an empty one; a null lang is part ''. A document without words passes B. Rows that
repeat a doc_id are counted each; of equal texts those with the smallest doc_id pass E, and a null doc_id passes E
and has no labels. A doc_id that labels repeat counts as good (toxic) if any of its rows says so. Extra columns are ignored; an
empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_broadcast, read, written

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABEL_ROWS = 4_000_000  #: at most so many labelled ids are broadcast; beyond, the join shuffles
PARTS_A_RUN = 1000  #: parts that one recursion walks; a part takes 326 of the million rows that Spark allows it


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is 1, B is 2, and so on)."""
    words = F.array_remove(F.split(text, SPACE), "")

    def bits(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
        fails = [n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(words), bits), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = written(marks.where("good = 1 OR toxic = 1"), "marks")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_failures(text).alias("fails"))
    rows = rows.join(bounded_broadcast(marks, marks.count(), LABEL_ROWS), "doc_id", "left")
    kind = ["part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # of the rows of one text and kind, all but those with the smallest doc_id of the whole text fail E
    kinds = rows.groupBy("h", *kind, "doc_id").count().groupBy("h", "part", "fails", "good", "toxic").agg(
        F.sum("count").alias("n"), F.min("doc_id").alias("least"), F.min_by("count", F.col("doc_id")).alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("count")).otherwise(0)).alias("unknown"),
    )
    kinds = kinds.withColumn("first", F.min("least").over(Window.partitionBy("h")))  # one text has a few kinds
    passing = F.col("unknown") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = kinds.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails").alias("mask"), passing.alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    both = both.select("part", F.col("c.mask").alias("mask"), F.col("c.n").alias("n"), "good", "toxic").where("n > 0")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _steps(packed: DataFrame) -> DataFrame:
    """(part, prefix, step, metrics): one row for each non-empty prefix of distinct letters, by recursion over the cells."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    total = lambda value, when: f"aggregate(c.cells, 0L, (acc, x) -> acc + IF({when}, x.{value}, 0L))"
    here = "x.mask & l.bit <> 0 AND x.mask & s.applied = 0"
    sql = f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
        steps(part, prefix, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{packed}}
            UNION ALL
            SELECT s.part, s.prefix || l.letter, s.step + 1, s.applied | l.bit,
                   {total('n', 'x.mask & (s.applied | l.bit) = 0')}, {total('n', here)}, {total('n', 'x.mask & l.bit <> 0 AND x.mask & s.applied <> 0')},
                   {total('n', 'x.mask = l.bit')}, {total('good', here)}, {total('toxic', here)}
            FROM steps s JOIN letters l ON s.applied & l.bit = 0 JOIN {{packed}} c ON c.part = s.part
            WHERE s.step < {len(FILTERS)}
        )
        SELECT * FROM steps WHERE step > 0"""
    return packed.sparkSession.sql(sql, packed=packed)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    counted = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    packed = written(counted.repartition(1), "cells")  # at most 32 cells a part
    runs = -(-packed.count() // PARTS_A_RUN) or 1
    steps = [_steps(packed if runs == 1 else packed.where(F.pmod(F.xxhash64("part"), F.lit(runs)) == i)) for i in range(runs)]
    rows = steps[0]
    for other in steps[1:]:
        rows = rows.unionByName(other)
    rows = written(rows, "steps")
    orders = rows.where(F.col("step") == len(FILTERS)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    each = orders.join(rows.drop("step", "applied"), ["part", "prefix"])
    letter = F.expr("substr(filter_order, step, 1)")
    shapley = each.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    out = each.withColumn("letter", letter).join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents, by lang."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_FLAGS = """words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
 marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
 flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id))"""

ORACLE = f"""WITH RECURSIVE {_FLAGS},
 letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 orders(o, applied) AS (SELECT '', 0 UNION ALL SELECT o || letter, applied | bit FROM orders JOIN letters ON applied & bit = 0),
 places AS (SELECT o AS filter_order, k AS step, bit, (SELECT coalesce(sum(b.bit), 0) FROM letters b WHERE contains(substr(o, 1, k - 1), b.letter))::INT AS before FROM orders, range(1, 6) r(k), letters WHERE length(o) = 5 AND letter = substr(o, k, 1)),
 cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
 m AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM places, cells GROUP BY ALL)
 SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM m"""
