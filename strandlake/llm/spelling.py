"""Spelling variant grouping by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Two words that differ by
one inserted, deleted or replaced letter share exactly one of them: the shorter word itself, or what is
left when the place where they differ is taken out. An equi-join of the keys thus finds all
near words, and what only shares a key (two letters exchanged) fails the check of the exact
distance. At most one word for each letter and place is left as one key, so no key has many words,
however large the vocabulary. A word's form is its commonest near word, if that is much commoner;
forms are followed to their ends by joins that double the distance each round.

Words of more than LONG letters, which would emit their square in bytes, emit 64-bit hashes of
their deletions, all from one running sum, and travel as numbers; their texts meet only in
pairs that share a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import checkpointed, table, tidy

LETTERS, UPPER = r"A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fewest letters and occurrences of a word, how much commoner a form must be, and of how many runs of letters one loses a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, LOSES = 7, 2, 10, 31
#: Letters up to which keys are texts.
LONG = 64
#: Odd numbers, of which one makes each letter's hash and the other is the base of the running sum.
_MIX, _BASE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH, loses: int = LOSES) -> DataFrame:
    """(word) for each run of letters of docs(doc_id, text) that has at least `least` of them: A-Z lower-cased, and one letter taken out where the checksum of `doc_id:run` says so."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).select("doc", run.alias("run"))
    # letters of one byte only have a faster way
    plain = F.octet_length("run") == F.length("run")
    low = runs.select("doc", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    return low.withColumn("h", h).select(F.when(F.col("h") % loses == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def deletions(word: F.Column) -> F.Column:
    """The distinct results of taking one letter out: of equal letters in a row, the last."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)) != F.substr(word, i + 1, F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))


def hashed_deletions(word: str) -> np.ndarray:
    """Hashes of the word and of its distinct single deletions: sums of a letter's hash times a power of the base for its place; of a deletion, what follows moves up by one power."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = np.full(len(letters), _BASE, np.uint64)
    base[:1] = 1
    upto = np.r_[np.uint64(0), np.cumsum((letters + np.uint64(1)) * np.uint64(_MIX) * np.multiply.accumulate(base))]
    without = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(pow(_BASE, -1, 1 << 64))
    return np.r_[upto[-1], without[np.r_[letters[:-1] != letters[1:], True]]].view(np.int64)


def _hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, word in zip(b.column("id").to_pylist(), b.column("word"), strict=True):
            keys = hashed_deletions(word.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int64)), pa.array(keys)], names=["id", "key"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for both orders of each pair of words(word, n, distinct) that differ by exactly one inserted, deleted or replaced letter."""
    distance = F.levenshtein("word", "other", 1)
    keyed = words.where(F.length("word") <= LONG).select("word", "n", F.explode(F.concat(F.array("word"), deletions(F.col("word")))).alias("key"))
    short = keyed.join(keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key").where((F.col("word") != F.col("other")) & (distance == 1))
    # words of LONG letters meet longer ones as well
    texts = checkpointed(words.where(F.length("word") >= LONG).withColumn("id", F.monotonically_increasing_id()))
    hashed = texts.select("id", "word").mapInArrow(tidy(_hash_keys), "id long, key long")
    met = hashed.join(hashed.select("key", F.col("id").alias("other_id")), "key").where("id != other_id").select("id", "other_id").distinct()
    long = met.join(texts, "id").join(texts.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n")), "other_id")
    long = long.where((F.greatest(F.length("word"), F.length("other")) > LONG) & (distance == 1))
    columns = ["word", "n", "other", "other_n"]
    return short.select(columns).unionByName(long.select(columns))


def ends(links: DataFrame) -> DataFrame:
    """(word, root) of links(word, form) without rings: what following links leads to. Each round doubles the steps."""
    reached = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = checkpointed(reached.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return reached
        reached = moved.drop("moved")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, loses: int = LOSES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs(doc_id, text) with at least `least` letters and `count` occurrences.

    form is the near word with the largest n (of equals the first in code-point order), if
    form_n, its n, is at least ratio times the word's; root is where forms lead, the word itself
    where it has none. Null and empty texts have no words; a null doc_id is written as an empty
    text; repeated rows count each; other columns are left out, whatever their names; an empty
    table gives an empty one. No text or word is too long.
    """
    words = checkpointed(occurrences(docs, least, loses).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = checkpointed(near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")))
    common = -F.col("best.less") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    roots = ends(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same rows in DuckDB; the checksum's table follows from its polynomial."""
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 runs AS (SELECT doc, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
 coded AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM runs),
 summed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM coded, crc),
 words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
 keyed AS MATERIALIZED (SELECT word, n, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS key FROM words),
 pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keyed a JOIN keyed b ON a.key = b.key AND a.word <> b.word WHERE CASE length(a.word) - length(b.word) WHEN 0 THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1 WHEN 1 THEN a.key = b.word WHEN -1 THEN a.key = a.word ELSE false END),
 near AS MATERIALIZED (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS best FROM pairs GROUP BY word),
 forms AS MATERIALIZED (SELECT word, best.form AS form, -best.less AS form_n FROM near WHERE -best.less >= {RATIO} * n),
 steps AS (SELECT word, form AS root, 1 AS k FROM forms UNION ALL SELECT s.word, f.form, s.k + 1 FROM steps s JOIN forms f ON f.word = s.root),
 roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
 SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(m.n_near, 0) AS n_near, f.form_n FROM words w LEFT JOIN near m USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)"""
