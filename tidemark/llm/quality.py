"""Operator 6: quality rules with verdicts on whole hosts, in DataFrame functions only.

Base rules judge each text alone. The method then looks at hosts (here the documents' source): failures
are summed by host, each host's failure rate is shrunk towards the corpus by an empirical beta prior, and a
host is rejected with all its documents when its rate is surely above `factor` times the corpus's, or above
`limit` (see `host_verdicts`). A host with few documents is hardly judged by them alone.

Sums by host are pre-aggregated, and the join back can be split or broadcast by Spark as the size of the
host table turns out, so a host with a third of all rows is no hot task.

A null text has no words and fails. A null host is a host of its own. Repeated rows count each. An empty
table gives an empty result. With one host, or hosts that differ by no more than chance, the prior has the
weight of `MOST` documents and no host is rejected unless the corpus as a whole is that bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Greatest weight of the prior, in documents, where hosts do not differ.
MOST = 1e6


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows (by their hashes, in order) that occur twice or more."""

    def positions(s):
        twin = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["x"] == s[k]["x"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["x"] == s[k]["x"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: s[k]["i"]))

    def total(p):
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - p[k])).otherwise(WINDOW))

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return _let(_let(ordered, positions), total)


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_windows", F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.col("_words")[i + k] for k in range(WINDOW)]))))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_windows").isNull() | (F.size(F.array_distinct("_windows")) == F.size("_windows")), F.lit(0).cast("long")).otherwise(_covered(F.col("_windows"))),
    })
    return df.drop("_words", "_lines", "_windows").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "host", factor: float = 3.0, limit: float = 0.5, sure: float = 2.0) -> DataFrame:
    """host, n, failed, rate (posterior mean), low (`sure` posterior deviations below it), rejected for each host of
    `judged` (host, base_failed).

    The prior is a beta distribution with the corpus's failure rate m and the between-host share g of the variance,
    from the moments of all hosts weighted by their documents, without what sampling within hosts adds. A host is
    rejected when even `low` exceeds `factor` times the corpus's rate, or `limit` where that is less.
    """
    hosts = written(judged.groupBy(host).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")), "hosts")
    c = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("f2")).first()
    m, strength = 0.0, MOST
    if c.h:
        m = c.f / c.n
        spread, room = c.f2 - c.f * m - m * (1 - m) * (c.h - 1), m * (1 - m) * (c.n - c.n2 / c.n - (c.h - 1))
        strength = min(MOST, max(1.0, room / spread - 1)) if spread > 0 and room > 0 else MOST
    a, t = F.col("failed") + m * strength, F.col("n") + strength
    rate = a / t
    low = rate - sure * F.sqrt(rate * (1 - rate) / (t + 1))
    return hosts.withColumn("rate", rate).withColumn("low", low).withColumn("rejected", F.col("low") > min(factor * m, limit))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", factor: float = 3.0, limit: float = 0.5) -> DataFrame:
    """One row per document: the key, host, measures, base_failed, host_rejected and kept."""
    measured = text_measures(docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))).drop("text")
    measured = written(measured, "measures")
    hosts = written(host_verdicts(measured, factor=factor, limit=limit), "verdicts").select(F.col("host").alias("h"), "rejected")
    out = measured.join(hosts, measured["host"].eqNullSafe(hosts["h"]), "left").drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).withColumnsRenamed({"key": key, "rejected": "host_rejected"})


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source, text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, words[i : i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM j GROUP BY source
), p AS (
  SELECT count(*) AS h, sum(n) AS n, sum(failed) AS f, sum(n * n) AS n2, sum(failed * failed / n) AS f2, sum(failed) / sum(n) AS m FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(failed AS DOUBLE) AS failed FROM h)
), q AS (
  SELECT m, f2 - f * m - m * (1 - m) * (h - 1) AS spread, m * (1 - m) * (n - n2 / n - (h - 1)) AS room FROM p
), v AS (
  SELECT source, rate - 2.0 * sqrt(rate * (1 - rate) / (n + s + 1)) > least(3.0 * m, 0.5) AS rejected
  FROM (SELECT h.source, h.n, m, s, (failed + m * s) / (n + s) AS rate
        FROM h, (SELECT m, CASE WHEN spread > 0 AND room > 0 THEN least(1e6, greatest(1.0, room / spread - 1)) ELSE 1e6 END AS s FROM q))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM j JOIN v ON v.source IS NOT DISTINCT FROM j.source
"""
