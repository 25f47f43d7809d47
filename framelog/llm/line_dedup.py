"""Line dedup over a whole corpus. DataFrame functions only.

Hashes of the long lines (128 bits) are range-partitioned and sorted by document and position within a hash, the largest document first. Rows
stream by in that order: where the document changes is a first occurrence, the first one of all is the holder, and the last row of a
group has the counts. A line that a third of all documents have is dealt by document into shares; one row a share says what all
of them need to know. What a document loses comes back as a bitmap: 63 positions in each long word, words without a dropped line
left out. Texts never travel with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelog.llm.common import BLANKS, ascii_lower, checkpoint

#: Lines in one word of a bitmap.
WORD_BITS = 63
#: Shares of the documents of one line.
SHARES = 256
_KEY = ("h1", "h2", "share")


def _version() -> Column:
    """Tells apart the different texts of one doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, version, words map<long word number, long bits>) of the lines that documents lose; documents that lose none are absent.

    Bit p mod 63 of word p div 63 is set when the line at position p goes. Rows with a null doc_id take no part.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    line = docs.where("doc_id is not null").select("doc_id", _version().alias("version"), F.posexplode(lines).alias("pos", "line"))
    line = line.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int")
    # texts are split and hashed once; what follows samples, sorts and joins these few bytes a line
    line = checkpoint(line.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(min_chars), key).alias("h2"), share.alias("share"), "doc_id", "version", "pos"))
    dealt = line.repartitionByRange(*_KEY)

    # the order within range partitions serves these windows: no exchange, and frames that end at the row, so that nothing is held
    order = Window.partitionBy(*_KEY).orderBy(F.desc("doc_id"), "version", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("before", F.lag("doc_id").over(order)).withColumn("last", F.lead("doc_id").over(order).isNull())
    first = F.coalesce((F.col("before") != F.col("doc_id")).cast("long"), F.lit(1).cast("long"))
    seen = seen.withColumn("n", F.sum(first).over(so_far)).withColumn("top", F.first("doc_id").over(so_far)).where("last").select(*_KEY, "n", "top")
    whole = Window.partitionBy("h1", "h2")  # a row for each share
    verdict = seen.withColumn("n_docs", F.sum("n").over(whole)).withColumn("holder", F.max("top").over(whole)).where(F.col("n_docs") >= min_docs)
    gone = line.join(verdict.select(*_KEY, "holder"), [*_KEY]).where("doc_id <> holder")

    word = F.expr(f"cast(pos div {WORD_BITS} as bigint)")
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast(pos % {WORD_BITS} as int))")
    # one exchange serves both aggregates and the join with the documents
    words = gone.select("doc_id", "version", word.alias("word"), bit.alias("bit")).repartition("doc_id", "version")
    words = words.groupBy("doc_id", "version", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every column of ``docs`` with ``text`` rid of repeated lines, and n_lines, n_dropped (replacing columns of those names).

    A line's key is the line stripped of ASCII white space and lower-cased A-Z. Keys of ``min_chars`` code points or more that
    ``min_docs`` documents hold lose all their lines except those in the largest doc_id that holds them. Null and empty texts are
    one empty line and come back empty. Rows with a null doc_id keep all lines and do not count as holders; rows that repeat a
    doc_id count as one document, and each loses its own lines only. An empty table gives no rows.
    """
    maps = keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("words").alias("__words"))
    joined = docs.drop("n_lines", "n_dropped", "__id", "__version", "__words")
    joined = joined.join(maps.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (_version() == F.col("__version")), "left").drop("__id", "__version")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # the words as a dense array, for constant-time access by line
    dense = F.expr("transform(sequence(0L, array_max(map_keys(__words))), k -> coalesce(try_element_at(__words, k), 0L))")
    joined = joined.withColumn("__lines", lines).withColumn("__dense", F.when(F.col("__words").isNotNull(), dense))
    kept = F.expr(
        f"filter(__lines, (l, i) -> coalesce(shiftright(get(__dense, cast(i div {WORD_BITS} as int)), i % {WORD_BITS}) & 1L, 0L) = 0L)"
    )
    text = F.when(F.col("__words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    dropped = F.coalesce(F.expr("aggregate(map_values(__words), 0L, (n, b) -> n + bit_count(b))"), F.lit(0)).cast("long")
    out = joined.withColumn("text", text).withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", dropped)
    return out.drop("__lines", "__dense", "__words")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
v AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (v.key IS NOT NULL AND k.doc_id <> v.holder) AS gone FROM k LEFT JOIN v ON k.key = v.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
