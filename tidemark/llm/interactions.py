"""Operator 12: how filters interact, by direct relational replay of every order of them.

Each document carries one bit per filter that it fails. These rows are crossed with the broadcast orders (120 for five
filters: a fixed number, whatever the input), the first failure in each order is found by its steps' bits, the
steps are exploded, and counts per (part, order, step) are aggregated with map-side combining, so that what is
shuffled is a row per part, order, step and task. A filter's total over all orders and steps is a sum over those counts.

Copies are found by the text's SHA-256: only the smallest key of each text is no copy. The digests are combined before
they are shuffled and joined back by key and digest, so a text that a third of all rows share is no hot task.

A null text is empty, and equal to other empty ones. A null part is the empty string. A row with a null key is no copy
and nobody's original. Rows that repeat a key with the same text are not copies of each other. A document with several
label rows is good or toxic if any row says so; null labels say nothing. Texts without words are below the least
number of words and have no share of distinct words to fail by. Empty tables give an empty result. Other columns are
not read, so their names do not matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import written

SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails the filters A to D: too few words, too few different words, too many
    capitals, marks."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and mask (bit k: fails the k-th of the filters A to E) of every document."""
    conditions = failures(F.col(text))
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())), F.lit(0))
    found = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        bits.cast("int").alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
    )
    found = written(found, "flags")
    first = found.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    found = found.join(first, ["id", "digest"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return found.select("id", "part", (F.col("mask") + F.when(copy, F.lit(1 << len(conditions))).otherwise(F.lit(0))).alias("mask"))


def orders(spark, letters: str) -> DataFrame:
    """All orders of the letters: filter_order and steps, an array of (step, letter, bit)."""
    rows = [("".join(o), [(i + 1, c, 1 << letters.index(c)) for i, c in enumerate(o)]) for o in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, letter: string, bit: int>>")


def replay(judged: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """judged: part, mask, good, toxic, a row per document. One row per part, filter_order and step with kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley."""
    if len(letters) > 6:
        raise ValueError("more than six filters have more orders than a broadcast should hold")
    # Rows are few bytes but 600 times their work: as many tasks as a shuffle has, not as few as the bytes would need.
    spread = judged.repartition(int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crossed = spread.crossJoin(F.broadcast(orders(judged.sparkSession, letters)))
    first = F.lit(len(letters) + 1)
    for k in reversed(range(len(letters))):
        first = F.when(F.col("mask").bitwiseAND(F.col("steps")[k]["bit"]) != 0, F.lit(k + 1)).otherwise(first)
    steps = crossed.select("part", "mask", "good", "toxic", "filter_order", first.alias("first"), F.explode("steps").alias("s"))
    step, fails, gone = F.col("s.step"), F.col("mask").bitwiseAND(F.col("s.bit")) != 0, F.col("first") == F.col("s.step")
    counted = steps.groupBy("part", "filter_order", step.alias("step"), F.col("s.letter").alias("letter")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(gone).alias("removed"),
        F.count_if(fails & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("mask") == F.col("s.bit")).alias("unique_fails"),
        F.count_if(gone & F.col("good")).alias("good_lost"),
        F.count_if(gone & F.col("toxic")).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The replay of filters A to E over docs, with what labels (key, quality, toxic) say is lost."""
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.coalesce(F.max(F.col(quality) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(toxic) == 1), F.lit(False)).alias("toxic")
    )
    judged = flags(docs, key, text, part).join(said, "id", "left")
    return replay(judged.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def op12_filter_interactions(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return filter_interactions(docs, labels)


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), f AS (
  SELECT doc_id, part, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), x AS (
  SELECT unnest(range(1, 6)) AS k
), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), r AS (
  SELECT part, fails, good, toxic, ks, coalesce(list_position(list_transform(ks, lambda k: fails[k]), true), 6) AS first FROM d, o
), s AS (
  SELECT part, fails, good, toxic, ks, first, unnest(range(1, 6)) AS step FROM r
), g AS (
  SELECT part, array_to_string(list_transform(ks, lambda k: chr((64 + k)::INT)), '') AS filter_order, step, ks[step] AS k,
         count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (fails[ks[step]] AND first < step) AS redundant,
         count(*) FILTER (fails[ks[step]] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, ks, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM g
"""
