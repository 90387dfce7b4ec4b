"""Helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The ASCII letters that the text contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    Only where ``spark.checkpoint.dir`` is unset (single-machine tests) a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name in df.columns:
        name += "_"
    return name


def keep_rows(docs: DataFrame, id_col: str, mark: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each pair of id and mark in ``kept``, with all its columns.

    Texts are shuffled once, by one key for id and mark. Rows that agree in it become one before the shuffle, so none is hot.
    """
    name = fresh(docs, "_row")
    key = lambda i, m: F.sha2(F.concat(F.coalesce(F.concat(F.lit("id "), i.cast("string")), F.lit("none")), F.lit(" "), m.cast("string")), 256)
    marked = docs.withColumn(name, key(F.col(id_col), mark)).dropDuplicates([name])
    wanted = kept.select(key(*(F.col(c) for c in kept.columns)).alias(name))
    return marked.join(wanted, name, "left_semi").drop(name)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", parts: int = 64) -> DataFrame:
    """Join rows with at most one row per key, dealt by the key and a hash of ``by``: a hot key is spread over ``parts`` tasks.

    The one row goes down to each part of its key first. Null keys meet nothing.
    """
    part = fresh(many, "_part")
    dealt = many.withColumn(part, F.pmod(F.xxhash64(*by), F.lit(parts)))
    down = dealt.select(part, *keys).distinct().join(one, keys)
    return dealt.join(down, [part, *keys], how).drop(part)


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[Callable, Column]]) -> DataFrame:
    """Running values over the rows of each group, each row included, and ``<name>_all``, the whole group's.

    ``values`` names an aggregate that is ``F.sum`` or ``F.bit_xor`` and its column. Rows are dealt by ranges of group and order, and what a group has
    in earlier ranges is added, so a group may be larger than any task. ``group`` columns hold no nulls.
    """
    dealt = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    per = dealt.groupBy("_range", *group).agg(*[f(c).alias(f"_t_{n}") for n, (f, c) in values.items()])
    whole = Window.partitionBy(*group)  # one row per range
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = per.select(
        "_range", *group,
        *[F.coalesce(f(f"_t_{n}").over(before), zero).alias(f"_e_{n}") for n, (f, _) in values.items()],
        *[f(f"_t_{n}").over(whole).alias(f"{n}_all") for n, (f, _) in values.items()],
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumns({n: f(c).over(inside) for n, (f, c) in values.items()}).join(per, ["_range", *group])
    put = {n: F.col(n).bitwiseXOR(F.col(f"_e_{n}")) if f is F.bit_xor else F.col(n) + F.col(f"_e_{n}") for n, (f, _) in values.items()}
    return joined.withColumns(put).drop("_range", *[f"_e_{n}" for n in values])


def fold_case(col: Column) -> Column:
    """Lower-case A-Z and nothing else. A text of as many bytes as characters is ASCII, where ``lower`` does just that, and faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def held_out(id_col: str) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def binary_rows(array: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as an (n, width) matrix."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat = b"".join(array.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(-1, width)


def small_batches(batch: pa.RecordBatch, text_at: int, limit: int = 8 << 20):
    """Slices of a batch whose texts hold about ``limit`` bytes, so that temporary arrays stay bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= limit:
            ends.append((start, i + 1))
            start, total = i + 1, 0
    if start < len(sizes):
        ends.append((start, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (u, v)`` by alternating large-star and small-star rounds: ``node, root``.

    Every round takes minima per node (pre-aggregated before the shuffle), and they go back down to each part of a node's edges, so no
    neighbourhood is ever held by a task: a star of any size is spread over many. Rounds are checkpointed; they end when a round leaves the edges as they were.
    """
    edges = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(down, low, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
