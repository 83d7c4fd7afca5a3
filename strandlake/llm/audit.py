"""Filter interaction audit: what each filter of a chain removes, in every order, by long-form windows.

A document fails each of five filters or not: a mask of five bits. Documents are counted by
part and mask, at most 32 cells a part, and only cells are unpivoted against the steps of all
120 orders. In an order the running bit-or of a cell's failures up to the step before says
whether the cell is still there; conditional sums over the cells give the figures of a step,
and a window of each part and filter its total over all orders.

A repeated text fails the last filter unless its doc_id is the smallest. Equal texts have equal
other bits and meet as digests, added up by part and label before they are shuffled; so a text
that a third of all documents share is a few rows a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import table

NAMES = "ABCDE"
#: Fewest words, least per cent of distinct words, most per cent of capitals, and the signs that a text must not hold.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 2, "#$%&*|"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sha, mask) of docs(doc_id, text, source): bits 0 to 3 of the mask for the filters A to D that the text fails, sha for the text itself."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = (n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * F.length("text"), F.col("text").rlike(f"[{SIGNS}]"))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good and toxic, by part and the filters A to E that they fail."""
    each = failures(docs).groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # documents without an id have no label; their keys are spread, and never met
    keyed = each.withColumn("id", F.coalesce("doc_id", F.xxhash64("sha", "part"))).withColumn("named", F.col("doc_id").isNotNull())
    labelled = keyed.join(known.withColumn("named", F.lit(True)), ["id", "named"], "left")
    bit = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # of a text: documents by part and label, and how many rows have the smallest id
    texts = labelled.groupBy("sha", "part", "mask", bit("good"), bit("toxic")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("sha")), F.col("of_least")).otherwise(0)
    told = texts.withColumn("copies", F.col("named") - first)
    copies = F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), F.col("copies").alias("n"))
    others = F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n"))
    split = told.select("part", "good", "toxic", F.inline(F.array(others, copies))).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame, names: str = NAMES) -> DataFrame:
    """The audit of cells(part, mask, n, good, toxic), bit k of the mask for failing the filter names[k]: a row for each part, order of the filters and step."""
    # 600 steps for five filters, whatever the data
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(names))), " ")
    long = counted.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    filter_ = F.substr("filter_order", F.col("step"), F.lit(1))
    long = long.withColumn("bit", F.element_at(F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(1 << k))]), filter_))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    judged = long.withColumn("earlier", F.coalesce(F.bit_or(fails).over(before), F.lit(0))).withColumn("fails", fails != 0)
    here, gone = F.col("fails") & (F.col("earlier") == 0), F.col("earlier") != 0

    def total(column: str, when: F.Column, name: str) -> F.Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0)).alias(name)

    figures = judged.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~F.col("fails") & ~gone, "kept"),
        total("n", here, "removed"),
        total("n", F.col("fails") & gone, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", here, "good_lost"),
        total("toxic", here, "toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of docs(doc_id, text, source) and labels(doc_id, quality, toxic).

    Null texts count as empty ones, null sources as the empty part. A null doc_id is never a
    copy and has no label; repeated rows count each, and share their doc_id's rank, so that
    rows of the smallest doc_id are no copies of each other. If labels repeat, one that is 1
    counts. Other columns are left out, whatever their names; no documents give no rows.
    """
    return interactions(cells(docs, labels))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle_sql() -> str:
    return f"""WITH said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
 docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 cells AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < {LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(w)) < {DISTINCT} * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {CAPITALS} * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[{SIGNS}]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM docs LEFT JOIN said USING (doc_id)),
 f AS (SELECT substr('{NAMES}', CAST(k AS INT) + 1, 1) AS name, CAST(1 << k AS INT) AS bit FROM range({len(NAMES)}) r(k)),
 orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
 steps AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(list_sum(bits[1:k - 1]) AS INT) AS earlier FROM orders, range(1, 6) r(k)),
 counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM cells GROUP BY part, mask),
 figures AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM counted, steps GROUP BY ALL)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM figures"""
