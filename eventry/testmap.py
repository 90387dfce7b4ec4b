"""The driver's tables in the shapes that the operators expect, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What the event types stand for; 2024-01-01 in microseconds; a week; the gap that ends a sequence, in seconds.
TYPES = {"purchase": "goal", "click": "shot", "view": "pass", "signup": "faceoff", "error": "whistle"}
ORIGIN_US, WEEK_US, GAP = 1_704_067_200_000_000, 604_800_000_000, 43_200.0
# The horizon that fits this table, where rows are hours apart.
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, period, t, id, type, team, player, x, y, seq, outcome, value."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ORIGIN_US)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in TYPES.items()], F.col("event_type"))
    d = e.select(
        F.col("user_id").cast("string").alias("game"),
        (F.floor(us / WEEK_US) + 1).cast("int").alias("period"),
        (us % WEEK_US / 1e6).alias("t"),
        F.col("event_id").alias("id"),
        kind.alias("type"),
        F.when(kind != "whistle", F.concat(F.lit("T"), (F.col("event_id") % 2).cast("string"))).alias("team"),
        F.when(k % 7 != 0, F.concat(F.lit("P"), (k % 40).cast("string"))).alias("player"),
        (k * 2.0 - 100.0).alias("x"),
        ((F.col("event_id") * 37 % 85) - 42.0).alias("y"),
        F.when(F.col("event_id") % 3 == 0, "failed").otherwise("successful").alias("outcome"),
        "value",
        (us / 1e6).alias("clock"),
    )
    w = Window.partitionBy("game").orderBy("clock", "id")
    d = d.withColumn("_gap", F.coalesce((F.col("clock") - F.lag("clock").over(w) > GAP).cast("int"), F.lit(0)))
    return d.withColumn("seq", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap", "clock")


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE event_type END"
EV = f"""
    e0 AS (SELECT *, epoch_us(ts) - {ORIGIN_US} AS us, CAST(json_extract_string(props, '$.k') AS INT) AS k, {_KIND} AS kind FROM events),
    e1 AS (SELECT CAST(user_id AS VARCHAR) AS game, CAST(us // {WEEK_US} + 1 AS INT) AS period, us % {WEEK_US} / 1e6 AS t, event_id AS id, kind AS type,
                  CASE WHEN kind <> 'whistle' THEN 'T' || CAST(event_id % 2 AS VARCHAR) END AS team,
                  CASE WHEN k % 7 <> 0 THEN 'P' || CAST(k % 40 AS VARCHAR) END AS player, k * 2.0 - 100.0 AS x, CAST(event_id * 37 % 85 - 42 AS DOUBLE) AS y,
                  CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'successful' END AS outcome, value, us / 1e6 AS clock FROM e0),
    ev AS (SELECT game, period, t, id, type, team, player, CAST(x AS DOUBLE) AS x, y, outcome, value,
                  CAST(sum(gap) OVER (PARTITION BY game ORDER BY clock, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq
           FROM (SELECT *, CASE WHEN clock - lag(clock) OVER (PARTITION BY game ORDER BY clock, id) > {GAP} THEN 1 ELSE 0 END AS gap FROM e1))
"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sequences: game, period, t, id, seq, type, team, and two made probabilities."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("game"), F.lit(1).alias("period"), F.col("turn").cast("double").alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit(0).cast("long").alias("seq"), F.when(F.col("turn") % 4 == 3, "whistle").otherwise("turn").alias("type"), F.col("role").alias("team"),
        (F.length("text") % 100 / 100.0).alias("p_for"), (F.length("text") % 37 / 100.0).alias("p_against"),
    )


DIALOGUE = """
    dia AS (SELECT CAST(conv_id AS VARCHAR) AS game, 1 AS period, CAST(turn AS DOUBLE) AS t, conv_id * 1000 + turn AS id, CAST(0 AS BIGINT) AS seq,
                   CASE WHEN turn % 4 = 3 THEN 'whistle' ELSE 'turn' END AS type, role AS team, length(text) % 100 / 100.0 AS p_for, length(text) % 37 / 100.0 AS p_against
            FROM conversations)
"""


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tracked members of an order: event, node (1..), side, member, distance and place."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("event"), F.row_number().over(w).alias("node"), F.when(F.col("l_suppkey") % 2 == 0, "mate").otherwise("opp").alias("side"),
        F.col("l_partkey").alias("member"), F.col("l_extendedprice").alias("distance"), (F.col("l_partkey") % 200 - 100.0).alias("tx"), (F.col("l_suppkey") % 85 - 42.0).alias("ty"), F.col("l_quantity").alias("v"),
    )


TRACKING = """
    trk AS (SELECT l_orderkey AS event, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS INT) AS node,
                   CASE WHEN l_suppkey % 2 = 0 THEN 'mate' ELSE 'opp' END AS side, l_partkey AS member, l_extendedprice AS distance,
                   CAST(l_partkey % 200 - 100 AS DOUBLE) AS tx, CAST(l_suppkey % 85 - 42 AS DOUBLE) AS ty, l_quantity AS v FROM lineitem)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a three-class label and probabilities from their length."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    d = labels.join(docs, "doc_id")
    a = (F.col("n_chars") % 97 + 1.0) / 200.0
    b = (F.col("n_chars") % 53 + 1.0) / 200.0
    return d.select("doc_id", "lang", "source", "n_chars", (F.col("quality") + F.col("toxic")).alias("label"), F.col("quality"), a.alias("p0"), b.alias("p1"), (1.0 - a - b).alias("p2"))


SCORED = """
    sc0 AS (SELECT doc_id, lang, source, n_chars, quality + toxic AS label, quality, (n_chars % 97 + 1.0) / 200.0 AS a, (n_chars % 53 + 1.0) / 200.0 AS b
            FROM labels JOIN documents USING (doc_id)),
    sc AS (SELECT doc_id, lang, source, n_chars, label, quality, CAST(a AS DOUBLE) AS p0, CAST(b AS DOUBLE) AS p1, 1.0 - CAST(a AS DOUBLE) - CAST(b AS DOUBLE) AS p2 FROM sc0)
"""
