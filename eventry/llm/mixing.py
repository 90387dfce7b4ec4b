"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventry.llm._shared import cut, table

# The weights of the sources in code-point order, repeating; the share of all sizes; the most a source repeats.
WEIGHTS, SHARE, REPEAT = (3.0, 1.0, 2.0), 1.5, 2.0
# Sampling weight of a document by its quality label; without a label it is 1.
QUALITY = {1: 2.0, 0: 0.5}
# Documents that one prefix-sum bucket is meant to hold, and buckets whose sums are summed first.
BUCKET_ROWS, RUN_OF_BUCKETS = 512, 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """Targets of the sources: shares of ``share`` times all sizes by weight, at most ``repeat`` times a source's own size.

    ``sizes`` has one row per source (source, source_size). With the water level L, a source takes min(cap, weight * L). Sorted by cap / weight the
    capped sources are a prefix, so L is found with running sums instead of rounds of resharing.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # one row per source
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    full = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    s = s.withColumns({
        "total": F.sum("source_size").over(all_) * F.lit(float(share)),
        "capped": F.coalesce(F.sum("cap").over(full), F.lit(0.0)),
        "open_w": F.sum("w").over(all_) - F.coalesce(F.sum("w").over(full), F.lit(0.0)),
        "place": F.row_number().over(by_level),
    })
    # The level if the sources before this one are capped and it is not; the first in the order that bears this out is the true one.
    level = (F.col("total") - F.col("capped")) / F.col("open_w")
    first = F.min(F.when(level <= F.col("cap") / F.col("w"), F.struct("place", level.alias("level")))).over(all_)
    s = s.withColumn("level", first["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """How many words of each document a mix takes.

    Each source is repeated as often as whole epochs fit its target; the rest is drawn without replacement: documents in the
    order of the keys -ln(u) / weight, u a uniform hash of id and text (many rows may have no id, or the same), as long as their sizes fit what is left (the document
    at the edge is taken if that comes nearer). Prefix sums go over stretches of key buckets first, then over buckets, and within a bucket last, so the
    largest source is spread over many tasks, and everything is a function of the rows: reruns agree.

    ``weights`` has one row per id (``doc_id, weight``, positive); ids without one have 1. Texts are measured before they
    meet the weights, so no text is shuffled. Returns one row per input row:
    ``doc_id, source, size, source_size, target, epochs, taken, key``. Null and empty texts have size 0 and are never taken; long texts count whole; a null
    source is a source of its own, the last; repeated rows and null ids are ordered by id and size, and rows that agree in both by nothing
    that matters. An empty table gives no rows; other columns are ignored.
    """
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 1.0) / float(16**13 + 1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), u.alias("_u"))
    w = F.lit(1.0)
    if weights is not None:
        d = d.join(weights.select(F.col("doc_id").alias("_id"), "weight"), F.col("doc_id") == F.col("_id"), "left")
        w = F.coalesce(F.col("weight").cast("double"), w)
    d = cut(d.select("doc_id", "source", "size", (-F.log("_u") / w).alias("key")))
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(by_source.select("source", "source_size"))
    largest = by_source.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    buckets = max(16, -(-largest // BUCKET_ROWS))
    # 1 - exp(-key) spreads the keys over (0, 1) in their order.
    d = d.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * buckets).cast("long"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("stretch", F.floor(F.col("bucket") / RUN_OF_BUCKETS))
    # Two levels: a task sees the buckets of one stretch, or one row per stretch of its source.
    before = lambda value, *keys, by: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = sums.groupBy("source", "stretch").agg(F.sum("in_bucket").alias("in_stretch"))
    stretches = stretches.select("source", "stretch", before("in_stretch", "source", by="stretch").alias("ahead"))
    inside = sums.withColumn("offset", before("in_bucket", "source", "stretch", by="bucket")).alias("i")
    offsets = inside.join(stretches.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source")) & (F.col("i.stretch") == F.col("s.stretch"))).select(
        "i.source", "bucket", (F.col("offset") + F.col("ahead")).alias("offset")
    )
    t = targets.alias("t").join(offsets.alias("o"), F.col("t.source").eqNullSafe(F.col("o.source"))).select(
        F.col("o.source").alias("source"), "bucket", "offset", "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long").alias("epochs"),
    )
    local = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(local))
    joined = d.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.bucket") == F.col("t.bucket")))
    upto = F.col("upto") + F.col("offset")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    drawn = (upto <= left) | ((upto - F.col("size") < left) & (upto - left <= left - (upto - F.col("size"))))
    return joined.select(
        "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + F.when(drawn, F.col("size")).otherwise(0)).cast("long").alias("taken"), "key",
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights that quality labels give (the largest label of an id, if it has several)."""
    q = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return q.select("doc_id", F.coalesce(*[F.when(F.col("_q") == k, F.lit(v)) for k, v in QUALITY.items()], F.lit(1.0)).alias("weight"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, weights=quality_weights(table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"), sf_dir).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {
    "op9_mixing": rf"""
        WITH q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
        d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                     -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 13) AS BIGINT) + 1.0) / {16**13 + 1}.0)
                       / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
              FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        c AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS place, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
                     coalesce(sum(2.0 * source_size) OVER b, 0) AS capped, coalesce(sum(w) OVER b, 0) AS capped_w
              FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min((total - capped) / (all_w - capped_w), place) AS level FROM c WHERE (total - capped) / (all_w - capped_w) <= cap / w),
        t AS (SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target FROM c, l),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
        r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
                     sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size)) THEN size ELSE 0 END AS BIGINT) AS taken
        FROM r"""
}
