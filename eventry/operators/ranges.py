"""Running values over whole tables and hot groups without a task that sees all of it."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """Materialise in the folder that the cluster names; only where ``spark.checkpoint.dir`` is unset (single machines) in a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def cumulate(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums, each row included, in a total order. Rows are dealt by ranges of the order; the sums of the ranges before a range are added."""
    dealt = reliable(df.withColumns(sums).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    per = per.select(F.col("_range"), *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumns({c: F.sum(c).over(inside) for c in sums}).join(F.broadcast(per), "_range")  # as many rows as partitions
    return joined.withColumns({c: F.col(c) + F.col(f"_s_{c}") for c in sums}).drop("_range", *[f"_s_{c}" for c in sums])


def number_rows(df: DataFrame, order: list[str | Column], out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, from ``start``."""
    return cumulate(df, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1 + start)


def quantiles(values: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """Linear quantiles of ``value`` by ``key``: columns ``q0``, ``q1``, ... in the order of ``qs``. Nulls are left out.

    Equal values are counted first, so what is ordered is one row per distinct value, dealt by ranges.
    """
    counts = values.where("value IS NOT NULL").groupBy("key", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    at = cumulate(counts, ["key", "value"], {"upto": F.col("n")})
    totals = at.groupBy("key").agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("before"))
    j = at.join(totals, "key").withColumn("upto", F.col("upto") - F.col("before"))
    rank = lambda q: F.lit(float(q)) * (F.col("all") - 1)
    ends = {f"{e}{i}": F.min(F.when(F.col("upto") > f(rank(q)), F.col("value"))) for i, q in enumerate(qs) for e, f in (("l", F.floor), ("h", F.ceil))}
    found = j.groupBy("key").agg(F.first("all").alias("all"), *[c.alias(k) for k, c in ends.items()])
    return found.select("key", *[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (rank(q) - F.floor(rank(q)))).alias(f"q{i}") for i, q in enumerate(qs)])


# Rows up to which a group is one task's work anyway; ranges that a hot group is cut into; sources too small to make a hot group.
HOT_ROWS, RANGES, SMALL_BYTES = 1_000_000, 256, 32 << 20
_COMBINE = {"last": F.last, "sum": F.sum, "min": F.min}


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which null keys match; the keys come from the left side."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def _source_bytes(df: DataFrame) -> int:
    """The size of what the table is made from, as Spark knows it; very large where it knows nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def deal(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Cut hot groups into ranges of the order: the column ``_cell`` is 0 for ordinary groups, and grows along the order in hot ones.

    A group is hot if it has more than ``HOT_ROWS`` rows and more than four times a partition's share of all. So at most a quarter as many groups are hot
    as there are partitions, and what is broadcast about them has that bound: ``RANGES`` boundaries each, taken from a sample by hash of their rows.
    The boundaries only say where a group is cut; results do not depend on them. Rows that tie on the whole order stay together.
    """
    if _source_bytes(df) < SMALL_BYTES:
        return df.withColumn("_cell", F.lit(0))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_all"))
    hot = counts.join(F.broadcast(total)).where(F.col("_rows") > F.greatest(F.lit(HOT_ROWS), F.col("_all") * 4 / parts)).drop("_all")  # one row
    at = F.struct(*order)
    rows = null_safe_join(df.select(*dict.fromkeys([*by, *order])), F.broadcast(hot), by, "inner")
    sample = rows.where(F.pmod(F.xxhash64(*order), F.greatest(F.lit(1), F.floor(F.col("_rows") / (16 * RANGES)))) == 0)
    sorted_ = sample.groupBy(*by).agg(F.sort_array(F.collect_list(at)).alias("_s"))
    cut_at = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / RANGES).cast("int")))
    bounds = sorted_.select(*by, F.array_distinct(cut_at).alias("_bounds"))
    joined = null_safe_join(df, F.broadcast(bounds), by)
    cell = F.when(F.col("_bounds").isNull(), 0).otherwise(1 + F.size(F.filter("_bounds", lambda b: b <= at)))
    return joined.withColumn("_cell", cell).drop("_bounds")


def scan(dealt: DataFrame, by: list[str], order: list[str], takes: dict[str, tuple[str, Column, bool]], descending: bool = False) -> DataFrame:
    """Running values over the groups of a ``deal``: each is (``last`` non-null value, ``sum`` or ``min``; its column; whether the row itself counts).

    A segmented scan: windows run inside (group, cell), and what a hot group's earlier cells hold is composed once per cell (at most ``RANGES`` rows a
    hot group, so the broadcast is bounded) and carried into it. ``order`` is a total order of the rows; ``descending`` walks it from its end.
    """
    at = F.struct(*order)
    w = Window.partitionBy(*by, "_cell").orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
    frame = lambda own: w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    over = lambda kind, c, win: (F.last(c, ignorenulls=True) if kind == "last" else _COMBINE[kind](c)).over(win)
    inside = dealt.withColumns({n: over(kind, c, frame(own)) for n, (kind, c, own) in takes.items()})
    end = F.min_by if descending else F.max_by
    whole = {n: end(c, F.when(c.isNotNull(), at)) if kind == "last" else _COMBINE[kind](c) for n, (kind, c, _) in takes.items()}
    cells = dealt.where("_cell > 0").groupBy(*by, "_cell").agg(*[c.alias(f"_in_{n}") for n, c in whole.items()])
    before = Window.partitionBy(*by).orderBy(F.col("_cell").desc() if descending else F.col("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*by, "_cell", *[over(kind, F.col(f"_in_{n}"), before).alias(f"_in_{n}") for n, (kind, _, _) in takes.items()])
    joined = null_safe_join(inside, F.broadcast(carried), [*by, "_cell"])
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    put = {"last": lambda n: F.coalesce(F.col(n), F.col(f"_in_{n}")), "sum": lambda n: zero(n) + zero(f"_in_{n}"), "min": lambda n: F.least(F.col(n), F.col(f"_in_{n}"))}
    return joined.withColumns({n: put[kind](n) for n, (kind, _, _) in takes.items()}).drop(*[f"_in_{n}" for n in takes])
