"""Quality gates and audits (V01-V15). Each gives rows ``check, passed, n``; a gate's counts come from one pass where they can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from eventry.functions.scalars import FORBIDDEN, has_leak
from eventry.operators.joins import in_buckets, key_match_rate, next_payload, unequal_buckets
from eventry.operators.project import yes
from eventry.schema import DEFAULT, EventSchema

# The metrics of a tracking slot in the wide table.
SLOT_METRICS = ("X", "Y", "Vel_X", "Vel_Y", "is_present", "is_primary_actor", "is_possessing_team", "is_consistent", "is_new_to_stint", "is_tracking_imputed", "slot_vacant")


def _report(df: DataFrame, checks: dict[str, Column], limits: dict[str, float] | None = None) -> DataFrame:
    """One row per check with the number of rows against it; a check passes at or below its limit (0)."""
    one = df.agg(*[F.coalesce(F.sum(yes(c).cast("long")), F.lit(0)).alias(k) for k, c in checks.items()])
    rows = [F.struct(F.lit(k).alias("check"), (F.col(k) <= (limits or {}).get(k, 0)).alias("passed"), F.col(k).alias("n")) for k in checks]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _row(df: DataFrame, check: str, n: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), (n <= 0).alias("passed"), n.cast("long").alias("n"))


def wide_columns(sides: tuple[str, ...] = ("Home", "Away"), slots: int = 6, metrics: tuple[str, ...] = SLOT_METRICS) -> list[str]:
    """The columns of a wide tracking table: 132 by default."""
    return [f"{a}_Track_{k}_{m}" for a in sides for k in range(slots) for m in metrics]


def _columns(df: DataFrame, check: str, required: list[str]) -> DataFrame:
    missing = len([c for c in required if c not in df.columns])
    return df.sparkSession.range(1).select(F.lit(check).alias("check"), F.lit(missing == 0).alias("passed"), F.lit(missing).cast("long").alias("n"))


def _coverage(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """A row per column: passed if the share of rows that have it is at least its limit; n are the rows that lack it."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in least])
    rows = [F.struct(F.lit(f"coverage_{c}").alias("check"), (F.col(c) >= F.lit(v) * F.col("_rows")).alias("passed"), (F.col("_rows") - F.col(c)).alias("n")) for c, v in least.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    extra = df.groupBy(*keys).agg((F.count("*") - 1).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("e"))
    return _row(extra, "unique_key", F.col("e"))


def check_schema(df: DataFrame, required: list[str], keys: list[str], domain: dict[str, list]) -> DataFrame:
    """Required columns, unique keys, values of a domain."""
    outside = {f"domain_{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in domain.items() if c in df.columns}
    return _columns(df, "required_columns", required).union(duplicate_keys(df, keys)).union(_report(df, outside))


def gate_clean(df: DataFrame, required_types: list[str], banned_types: list[str], cutoff: float = 300.0, s: EventSchema = DEFAULT) -> DataFrame:
    """Disorder, missing types, left-over types, times past the end."""
    d = df.withColumn("_dt", F.col(s.time) - F.lag(s.time).over(Window.partitionBy(s.group, s.sequence).orderBy(s.id)))
    flags = _report(d, {"disorder": F.col("_dt") < -1, "leftover_types": F.col(s.type).isin(*banned_types), "time_boundary": (F.col(s.period) == 4) & (F.col(s.time) > cutoff)})
    absent = df.agg(*[F.max((F.col(s.type) == t).cast("int")).alias(f"t{i}") for i, t in enumerate(required_types)])
    n = reduce(lambda a, b: a + b, [F.lit(1) - F.coalesce(f"t{i}", F.lit(0)) for i in range(len(required_types))])
    return flags.union(_row(absent, "missing_types", n))


def gate_events(
    df: DataFrame, text: str, s: EventSchema = DEFAULT, sources=("shot", "deflection"), synthetic: str = "is_synthetic",
    place: dict[str, float] | None = None, coverage: dict[str, float] | None = None, forbidden: tuple[str, ...] = FORBIDDEN,
) -> DataFrame:
    """Leaks and forbidden terms; made rows that do not follow a source, that are not at their ``place`` (columns and values, such as
    the net at x -89, y 0), or that are not there at all; null keys; and how many rows have the columns of ``coverage`` (goalies: 0.05)."""
    d = df.withColumn("_prev", F.lag(s.type).over(s.window()))
    made = yes(F.col(synthetic) == 1)
    checks = {
        "leaks": has_leak(F.col(text)), "forbidden_terms": reduce(lambda a, b: a | b, [yes(F.col(text).contains(t)) for t in forbidden]),
        "synthetic_placement": made & ~yes(F.col("_prev").isin(*sources)), "null_keys": F.col(s.group).isNull() | F.col(s.id).isNull(),
    }
    if place:
        checks["off_place"] = made & ~reduce(lambda a, b: a & b, [yes(F.col(c) == v) for c, v in place.items()])
    absent = d.agg((1 - F.coalesce(F.max(made.cast("int")), F.lit(0))).alias("n"))
    out = _report(d, checks).union(_row(absent, "synthetic_absent", F.col("n")))
    return out.union(_coverage(df, coverage)) if coverage else out


def gate_relative(df: DataFrame, keys: list[str], imputed: str, share: float = 0.6) -> DataFrame:
    """Unique keys, and at most a share of imputed actors."""
    rate = df.agg(F.coalesce(F.avg(F.col(imputed).cast("double")), F.lit(0.0)).alias("r"), F.coalesce(F.sum(F.col(imputed).cast("long")), F.lit(0)).alias("n"))
    return duplicate_keys(df, keys).union(rate.select(F.lit("imputation").alias("check"), (F.col("r") <= share).alias("passed"), "n"))


def gate_absolute(df: DataFrame, xs: list[str], ys: list[str], bounds: tuple[float, float] = (120.0, 80.0), required: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Places within the bounds, the ``required`` columns (``wide_columns()``), and unique keys."""
    out = lambda cols, b: reduce(lambda a, c: a | c, [yes(F.abs(F.col(c)) > b) for c in cols])
    rows = _report(df, {"x_bounds": out(xs, bounds[0]), "y_bounds": out(ys, bounds[1])})
    rows = rows.union(_columns(df, "wide_columns", required)) if required else rows
    return rows.union(duplicate_keys(df, keys)) if keys else rows


def gate_labels(
    df: DataFrame, n_vectors: int, index: str, label: str, horizon: float = 20.0, s: EventSchema = DEFAULT, goal: str = "goal",
    end: str | None = None, mask: str | None = None, masked: tuple[str, ...] = ("shot", "deflection", "defensive_deflection"), penalties: tuple[str, ...] = ("penalty", "penaltydrawn"),
) -> DataFrame:
    """Indices within the vectors, labels that have a goal within the horizon, labels of the domain.

    ``end`` is a stored end of the horizon, which must not lie beyond it (for ``penalties`` counted on their own, too); ``mask`` is an outcome
    id that must be 0 on rows of the ``masked`` types.
    """
    d = next_payload(df, [goal], [s.group, s.period], s.time, [], tie=s.id, type_col=s.type)
    late = F.col(label).isin(0, 1) & (F.col(f"_next.{s.time}") - F.col(s.time) > horizon + 1e-6)
    checks = {}
    if end:
        beyond = F.col(end) - F.col(s.time) > horizon + 1e-6
        checks = {"stored_horizon": beyond, "penalty_horizon": beyond & F.lower(s.type).isin(*penalties)}
    if mask:
        checks["outcome_mask"] = F.lower(s.type).isin(*masked) & ~yes(F.col(mask) == 0)
    return _report(d, checks | {"index_bounds": F.col(index).isNull() | (F.col(index) < 0) | (F.col(index) >= n_vectors), "horizon": late | (F.col(label).isin(0, 1) & F.col("_next").isNull()), "label_domain": ~F.col(label).isin(0, 1, 2)})


def combine_gates(*reports: DataFrame, warn: tuple[str, ...] = ()) -> DataFrame:
    """The worst of all checks: fail > warn > pass."""
    level = F.when(F.col("passed"), 0).when(F.col("check").isin(*warn) if warn else F.lit(False), 1).otherwise(2)
    worst = reduce(DataFrame.union, reports).agg(F.coalesce(F.max(level), F.lit(0)).alias("l"), F.count("*").alias("n_checks"))
    return worst.select(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("l") + 1).alias("status"), "n_checks")


def gate_scores(reconciled: DataFrame, allocated: str = "allocated", group: str = "game") -> DataFrame:
    """Teams whose counted score is not the official one."""
    return _report(reconciled, {"score_mismatch": F.col("score") != F.col("counted") + F.col("extra") + F.col(allocated)})


def check_conservation(base: DataFrame, inverse: DataFrame, keys: list[str], kept: str, net: str, id_col: str = "id", tolerance: float = 1e-9) -> DataFrame:
    """A kept row and the sum of its inverse rows cancel out; links without a kept row are left out."""
    return _report(conservation_residuals(base, inverse, keys, kept, net, id_col), {"conservation": F.abs("residual") > tolerance})


def conservation_residuals(base: DataFrame, inverse: DataFrame, keys: list[str], kept: str, net: str, id_col: str = "id") -> DataFrame:
    """Per link with a kept row what that row and its inverse rows sum to: the keys, ``kept`` and ``residual``; the largest is the audit's figure."""
    b = base.groupBy(*keys, F.col(id_col).alias(kept)).agg(F.min(net).alias("_base")).where("_base IS NOT NULL")
    sums = inverse.groupBy(*keys, kept).agg(F.coalesce(F.sum(net), F.lit(0.0)).alias("_sum"))
    return sums.join(b, [*keys, kept]).select(*keys, kept, (F.col("_base") + F.col("_sum")).alias("residual"))


def check_immutable(raw: DataFrame, adjusted: DataFrame, keys: list[str], cols: list[str], tolerance: float = 1e-12, exempt: Column | None = None) -> DataFrame:
    """No key of ``raw`` may be gone or have fewer rows in ``adjusted``, and the mean values of a key must be the same, but for keys with
    an exempt row of ``raw``. ``adjusted`` is given without rows that were added on purpose. Digests of key buckets are compared first; only rows of unequal buckets
    are grouped and joined."""
    differ = unequal_buckets(raw, adjusted, keys, cols)
    raw, adjusted = in_buckets(raw, keys, differ), in_buckets(adjusted, keys, differ)
    a = raw.groupBy(*keys).agg(F.count("*").alias("_na"), F.max((yes(exempt) if exempt is not None else F.lit(False)).cast("int")).alias("_free"), *[F.avg(c).alias(f"_a_{c}") for c in cols])
    b = adjusted.groupBy(*keys).agg(F.count("*").alias("_nb"), *[F.avg(c).alias(f"_b_{c}") for c in cols])
    pairs = [a[k].eqNullSafe(b[k]) for k in keys]
    j = a.join(b, reduce(lambda x, y: x & y, pairs), "left").drop(*[b[k] for k in keys])
    moved = reduce(lambda x, y: x | y, [~(F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) | yes(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance)) for c in cols])
    return _report(j, {"changed": moved & F.col("_nb").isNotNull() & (F.col("_free") == 0), "lone_keys": F.col("_nb").isNull(), "fewer_rows": F.col("_nb") < F.col("_na")})


def check_ledger(df: DataFrame, tolerance: float = 1e-9, penalty: str | None = None) -> DataFrame:
    """Net is for minus against; penalties lie in [0, 1]."""
    checks = {"net_identity": F.abs(F.col("credit_net") - (F.col("credit_for") - F.col("credit_against"))) > tolerance}
    if penalty:
        checks["penalty_range"] = ~F.col(penalty).between(0, 1)
    return _report(df, checks)


def gate_training(df: DataFrame, keys: list[str], label: str, fold: str, features: list[str], n_classes: int, s: EventSchema = DEFAULT) -> DataFrame:
    """Null and doubled keys, time inversions, folds that lack a class, values that are not finite."""
    d = df.withColumn("_dt", F.col(s.time) - F.lag(s.time).over(Window.partitionBy(s.group, s.period).orderBy(*s.order)))
    bad = reduce(lambda a, b: a | b, [F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in features])
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rows = _report(d, {"null_keys": null, "inversions": F.col("_dt") < 0, "not_finite": bad})
    support = df.groupBy(fold).agg(F.count_distinct(F.col(label)).alias("c")).agg(F.coalesce(F.sum((F.col("c") < n_classes).cast("long")), F.lit(0)).alias("e"))
    return rows.union(duplicate_keys(df, keys)).union(_row(support, "class_support", F.col("e")))


def check_zero_padding(df: DataFrame, cols: list[str], sources: tuple[str, ...] = ("pass",), s: EventSchema = DEFAULT) -> DataFrame:
    """Destination columns are 0 on rows that are no source."""
    other = ~yes(F.col(s.type).isin(*sources))
    return _report(df, {f"zero_{c}": other & (F.coalesce(c, F.lit(0.0)) != 0) for c in cols})


def step_counts(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame], None], start: str = "raw") -> DataFrame:
    """Rows after each step, before it, and what it removed, counted in the pass that writes the result with ``sink``; nothing is read twice.

    Steps are meant to be filters and projections. What is counted before a shuffle would be counted again if Spark had to run its stage again.
    """
    seen = [(start, Observation())]
    out = df.observe(seen[0][1], F.count(F.lit(1)).alias("n"))
    for name, step in steps.items():
        seen.append((name, Observation()))
        out = step(out).observe(seen[-1][1], F.count(F.lit(1)).alias("n"))
    sink(out)
    n = [(k, o.get["n"]) for k, o in seen]
    rows = [(i, k, after, n[i - 1][1] if i else None, n[i - 1][1] - after if i else 0) for i, (k, after) in enumerate(n)]  # one row per step
    return df.sparkSession.createDataFrame(rows, "step_no int, step string, rows_after long, rows_before long, removed long")


def gate_inputs(
    df: DataFrame, ref: DataFrame, required: list[str], aliases: dict[str, str], keys: list[str], least: float = 0.95, index: tuple[str, int] | None = None, coverage: dict[str, float] | None = None
) -> DataFrame:
    """Columns (or their aliases), how much of a reference's keys the table has, indices (column, number of vectors) that are numbers in
    range, and how many rows have the columns of ``coverage``."""
    cols = _columns(df, "columns", [aliases.get(c, c) if c not in df.columns else c for c in required])
    if index:
        at = F.col(index[0]).try_cast("double")
        cols = cols.union(_report(df, {"index_range": at.isNull() | (at < 0) | (at >= index[1])}))
    if coverage:
        cols = cols.union(_coverage(df, coverage))
    rate = key_match_rate(ref, df, keys).select(F.lit("key_match").alias("check"), (F.col("rate") >= least).alias("passed"), (F.col("n") - F.col("n_matched")).alias("n"))
    return cols.union(rate)
