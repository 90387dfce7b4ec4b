"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import LOWER, UPPER, fold_case, fresh, spread_join, table

# The characters that are stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _digest(col: Column) -> Column:
    """128 bits of the SHA-256."""
    return F.substring(F.unhex(F.sha2(col, 256)), 1, 16)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more go, but for those of the largest id that holds it.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Lines are exploded with their places and hashed; (hash, id) pairs are counted
    once each, then per hash, both with partial sums before the shuffle. A frequent hash meets its lines dealt by hash and row, so a line of a third of
    all documents is spread. Only digests and places are shuffled for that; then every text meets the places it loses, in one shuffle of the texts.

    Returns one row per input row: ``doc_id, text, n_lines, n_dropped``, text being the lines that stay, in their order, joined by a line feed.
    A null or empty text has one empty line. A document is an id: rows that repeat an id count once for a line, and all of them keep the lines of the
    largest; rows without an id are one document, smaller than all. Long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    row = fresh(docs, "_row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(" "), text)
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _digest(named).alias(row))
    exploded = d.select("doc_id", row, F.posexplode(F.split(fold_case(F.col("text")), "\n", -1)).alias("pos", "line")).where(F.octet_length("line") >= min_chars)
    keyed = exploded.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length("key") >= min_chars)
    lines = keyed.select(_digest(F.col("key")).alias("h"), "doc_id", row, "pos")
    holders = lines.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
    frequent = holders.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).select("h", "keep")
    lost = spread_join(lines, frequent, ["h"], [row]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lost = lost.groupBy(row).agg(F.collect_set("pos").alias("lost"))  # rows that agree in id and text lose the same places
    joined = d.join(lost.hint("shuffle_hash"), row, "left").withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLES = {
    "op13_line_dedup": rf"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
        k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, line, pos, coalesce(k.doc_id <> keep, false) AS lost FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM j GROUP BY doc_id"""
}
