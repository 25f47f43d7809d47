"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document draws the key E = -ln(u) / w, with u a hash of its id and w its quality weight. A source whose budget is
several times its size takes every document that often (complete epochs); what is left is filled by its documents in the
order of their keys, by prefix sum, and the document that crosses the budget is taken in part, so a source's total is its
rounded target exactly.

A source may hold a third of all rows: keys are cut into buckets of some ``BUCKET_ROWS`` documents, the buckets' sums are
prefix-summed (one row per bucket), and only then rows within each bucket. No task ever sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint, n_words

#: Mean rows of a bucket of keys, the unit that one task sorts.
BUCKET_ROWS = 4_000
#: A source's rows meet its (single) target row in so many shares.
SALTS = 16


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """Deterministic number in (0, 1) from 52 bits of a digest of the id; of the text for rows without one, which may be many."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit(""))))), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, shares: tuple[int, ...], cap: int) -> DataFrame:
    """From (src, source_size, n_docs), a row per source, the words that each is to give.

    Water-filling in closed form: with sources ordered by the level at which they reach ``cap`` times their size, the level of
    the first source that stays below it is the common one. The windows span one row per source, not documents.
    """
    ranked = Window.orderBy(F.col("src.none"), F.col("src.name"))
    weight = F.element_at(F.array(*map(F.lit, shares)), (F.row_number().over(ranked) - 1) % len(shares) + 1)
    s = sizes.withColumn("rank", F.row_number().over(ranked)).withColumn("weight", weight.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * cap).withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    by = Window.orderBy("full_at", "rank")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(by))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    return s.select("src", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, shares: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 9) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, source, text).

    ``weights`` (doc_id, weight > 0) gives quality weights; a missing or null one is 1. Null text has size 0; null source is a
    source of its own, last in order; rows with a null or a repeated doc_id are rows like any other (equal ids, equal keys; rows
    without an id draw by their text; ties by size). A document of size 0 takes nothing. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    base = docs.select(F.col("doc_id"), src.alias("src"), n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if weights is not None:
        w = weights.select(F.col("doc_id").alias("w_id"), F.col("weight").cast("double").alias("weight"))
        base = base.join(w, F.col("doc_id") == F.col("w_id"), "left").drop("w_id")
    else:
        base = base.withColumn("weight", F.lit(None).cast("double"))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    base = checkpoint(base.select("doc_id", "src", "size", (-F.ln("u") / weight).alias("key")))

    sizes = base.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(sizes, shares, cap).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    # 1 - exp(-E) spreads the keys over [0, 1) in their order
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    bucket = F.least(n_buckets - 1, F.floor((1 - F.exp(-F.col("key"))) * n_buckets))
    rows = salted.join(goal, ["src", "salt"]).drop("salt").withColumn("bucket", bucket)

    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    running = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("offset"))
    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["src", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    name = F.when(~F.col("src.none"), F.col("src.name"))
    return rows.select("doc_id", name.alias("source"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weight 0.5 + the mean quality label of a document, for those that have one."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg((F.avg("quality") + 0.5).alias("weight"))


SQL = r"""
WITH lab AS (SELECT doc_id, avg(quality) + 0.5 AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null ' || md5(coalesce(d.text, ''))) || ':9'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS k
  FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM r),
f AS (SELECT *, cap::DOUBLE / w AS full_at FROM c),
l AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (ORDER BY full_at, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM f WINDOW o AS (ORDER BY full_at, rk)),
g AS (SELECT arg_min(level, place) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least(cap::DOUBLE, g.level * w) AS target FROM f, g),
b AS (
  SELECT base.doc_id, base.source, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY k, base.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
