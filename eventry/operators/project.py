"""Projections and filters (F01-F21), sorts and limits (O01-O04), set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventry.functions.scalars import flip_if
from eventry.operators.ranges import quantiles

# Ids that stand for no id; classes of the vocabulary's reserved entries; the goal line; penalty adjustments.
NO_IDS = ("", "<NA>", "nan", "None")
PAD, UNK = 0, 1
NET_X = 89.0
TAKER_FOR, TAKER_AGAINST = 0.02, 0.2


def yes(cond: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(cond, F.lit(False))


def filter_time_boundary(df: DataFrame, period: str = "period", time: str = "t", last: int = 4, cutoff: float = 300.0) -> DataFrame:
    """periods up to ``last``, the last one only before ``cutoff``; unknown times go."""
    return df.where(yes((F.col(period) <= last) & ((F.col(period) < last) | (F.col(time) < cutoff))))


def split_noise(df: DataFrame, noise: Column, keep: Column) -> tuple[DataFrame, DataFrame]:
    """the rows without noise, and those noise rows that are kept aside."""
    flagged = df.withColumn("_noise", yes(noise))
    return flagged.where(~F.col("_noise")).drop("_noise"), flagged.where(F.col("_noise") & yes(keep)).drop("_noise")


def drop_types(df: DataFrame, types: list[str], type_col: str = "type") -> DataFrame:
    """null types stay."""
    return df.where(~yes(F.col(type_col).isin(*types)))


def drop_types_without_actor(df: DataFrame, types: list[str], actor: str = "player", type_col: str = "type") -> DataFrame:
    """F04."""
    return df.where(~(yes(F.col(type_col).isin(*types)) & F.col(actor).isNull()))


def drop_leak_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """the rows without any leak, and one row with how many rows each reason (they overlap) took."""
    flagged = df.withColumns({f"_leak_{k}": yes(c) for k, c in rules.items()})
    names = [f"_leak_{k}" for k in rules]
    counts = flagged.agg(*[F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).alias(n.removeprefix("_leak_")) for n in names])
    return flagged.where(~reduce(lambda a, b: a | b, map(F.col, names))).drop(*names), counts


def drop_null_entities(df: DataFrame, id_col: str) -> DataFrame:
    """F06."""
    return df.where(F.col(id_col).isNotNull() & (F.col(id_col) != "None"))


def drop_eos(df: DataFrame, eos: str = "is_eos") -> DataFrame:
    """F07."""
    return df.where(F.coalesce(F.col(eos), F.lit(0)) == 0)


def filter_valid_ids(df: DataFrame, id_col: str) -> DataFrame:
    """F08."""
    return df.where(yes(~F.trim(F.col(id_col).cast("string")).isin(*NO_IDS)))


def project_contract(df: DataFrame, cols: list[str]) -> DataFrame:
    """exactly these columns; missing and doubled ones are errors."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if doubled := sorted({c for c in cols if df.columns.count(c) > 1 or cols.count(c) > 1}):
        raise ValueError(f"columns are doubled: {doubled}")
    return df.select(*cols)


def alias_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """old names to new ones where the new one is not there yet."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns and new not in df.columns})


def coordinate_columns(df: DataFrame, variant: str = "adjusted") -> DataFrame:
    """raw or adjusted coordinates as ``x`` and ``y``."""
    tail = "_adj" if variant == "adjusted" else "_raw"
    return df.withColumns({c: F.col(f"{c}{tail}") for c in ("x", "y")})


def mask_outcome(df: DataFrame, mask_types: list[str], outcome: str = "outcome", type_col: str = "type", vocab_col: str = "outcome_id") -> DataFrame:
    """the outcome of some types hidden (null, id 0); other ids UNK where the vocabulary has none."""
    hidden = yes(F.col(type_col).isin(*mask_types))
    return df.withColumns({outcome: F.when(~hidden, F.col(outcome)), vocab_col: F.when(hidden, PAD).otherwise(F.coalesce(F.col(vocab_col), F.lit(UNK)))})


def sanitize_numeric(df: DataFrame, cols: list[str], strategy: str = "zero") -> DataFrame:
    """numbers out of anything; NaN and infinities become null and are filled with 0 or the column's median (of distinct values, counted and dealt by ranges)."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    clean = df.withColumns({c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")), number(c)) for c in cols})
    if strategy == "zero":
        return clean.fillna(0.0, cols)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in cols]))
    found = quantiles(clean.select(pairs.alias("_p")).select("_p.*"), (0.5,))
    wide = found.agg(*[F.max(F.when(F.col("key") == c, F.col("q0"))).alias(f"_m_{c}") for c in cols])
    joined = clean.join(F.broadcast(wide))  # one row
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def possession_relative(df: DataFrame, home_team: str, pairs: dict[str, tuple[str, str]], team: str = "team", period: str = "period", time: str = "t") -> DataFrame:
    """of each (home, away) pair the actor's side as ``{name}_own`` and the other as ``{name}_opp``, and the time that remains."""
    at_home = yes(F.col(team) == F.col(home_team))
    own = {f"{k}_own": F.when(at_home, F.col(h)).otherwise(F.col(a)) for k, (h, a) in pairs.items()}
    opp = {f"{k}_opp": F.when(at_home, F.col(a)).otherwise(F.col(h)) for k, (h, a) in pairs.items()}
    left = F.when(F.col(period) >= 4, 300.0).otherwise(1200.0) - F.col(time)
    return df.withColumns(own | opp | {"time_remaining": F.greatest(F.least(left, F.lit(1200.0)), F.lit(0.0))})


def direction_anchors(df: DataFrame, games: DataFrame, group: str = "game", team: str = "team", period: str = "period", home_team: str = "home_team", start: str = "home_start_net") -> DataFrame:
    """the sign of attack of the actor's team and the x of the net it attacks; an unknown start counts as -1. Sides change every period."""
    text = F.lower(F.trim(F.col(start).cast("string")))
    sign = F.when(text.isin("pos_x", "1", "+1"), 1).otherwise(-1)
    g = games.select(F.col(group), F.col(home_team).alias("_home"), sign.alias("_sign"))
    d = df.join(g, group, "left")
    # The home team starts at its own net and attacks the other one.
    attack = -F.coalesce("_sign", F.lit(-1)) * F.when(F.col(period) % 2 == 1, 1).otherwise(-1) * F.when(yes(F.col(team) == F.col("_home")), 1).otherwise(-1)
    return d.withColumn("attack_direction", attack).withColumn("target_net_x", F.col("attack_direction") * NET_X).drop("_home", "_sign")


def override_goal_probs(df: DataFrame, probs: tuple[str, str, str], type_col: str = "type", goal: str = "goal") -> DataFrame:
    """F16: a goal is certain: (1, 0, 0)."""
    is_goal = yes(F.col(type_col) == goal)
    return df.withColumns({c: F.when(is_goal, F.lit(v)).otherwise(F.col(c)) for c, v in zip(probs, (1.0, 0.0, 0.0), strict=True)})


def adjust_penalty_taker(df: DataFrame, f: float = TAKER_FOR, a: float = TAKER_AGAINST, type_col: str = "type", penalty: str = "penalty", delta_for: str = "delta_for", delta_against: str = "delta_against") -> DataFrame:
    """fixed additions on penalties (a missing delta is 0 there), from the untouched columns, so that doing it twice changes nothing more."""
    hit = yes(F.col(type_col) == penalty)
    added = lambda c, v: F.when(hit, F.coalesce(F.col(c), F.lit(0.0)) + v).otherwise(F.col(c))
    out = df.withColumns({"adj_for": added(delta_for, f), "adj_against": added(delta_against, a)})
    return out.withColumns({"adj_net": F.col("adj_for") - F.col("adj_against"), "adj_source": F.when(hit, "penalty_static").otherwise("model")})


def impute_actor(df: DataFrame, x: str = "track_x", y: str = "track_y", mode: str = "present") -> DataFrame:
    """a missing actor stands at (0, 0) and is marked as imputed, and as present or absent by ``mode``."""
    missing = F.col(x).isNull() | F.col(y).isNull()
    return df.withColumns({"is_imputed": missing.cast("int"), "is_present": F.when(missing, 1 if mode == "present" else 0).otherwise(1), x: F.when(missing, 0.0).otherwise(F.col(x)), y: F.when(missing, 0.0).otherwise(F.col(y))})


def player_ledger(df: DataFrame, keys: list[str], player: str = "player", skip: tuple[str, ...] = ("save", "whistle", "goal"), type_col: str = "type") -> DataFrame:
    """the credit rows of players: for, against and net from the adjusted columns, null as 0."""
    rows = filter_valid_ids(drop_types(df, list(skip), type_col), player)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select(*keys, player, type_col, zero("adj_for").alias("credit_for"), zero("adj_against").alias("credit_against"), (zero("adj_for") - zero("adj_against")).alias("credit_net"))


def goalie_as_player_ledger(df: DataFrame, keys: list[str], goalie: str = "goalie", credit: str = "save_credit") -> DataFrame:
    """goalie credits in the player ledger's columns."""
    gain = F.coalesce(F.col(credit), F.lit(0.0))
    return df.select(*keys, F.col(goalie).alias("player"), F.lit("save").alias("type"), gain.alias("credit_for"), F.lit(0.0).alias("credit_against"), gain.alias("credit_net"))


def inspect_baselines(df: DataFrame, cols: list[str], types: tuple[str, ...] = ("whistle", "faceoff"), type_col: str = "type") -> DataFrame:
    """F21."""
    return df.where(F.col(type_col).isin(*types)).select(*cols)


def flip_coordinates(df: DataFrame, cond: Column, cols: list[str]) -> DataFrame:
    """C11 on a table."""
    return df.withColumns(flip_if(cond, *cols))


def sort_total(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """(column, ascending) keys, nulls last; end in a unique column."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first k rows of each group, or of the table. Spark keeps only k rows a group and task before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def sample_rows(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """N rows in the order of a seeded MD5 of the key; the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), key).limit(n)


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group as a minimum, which is taken before the shuffle."""
    row = F.min(F.struct(*order, F.struct(*[c for c in df.columns if c not in by]).alias("_row"))).alias("_first")
    return df.groupBy(*by).agg(row).select(*by, "_first._row.*")


def union_aligned(*dfs: DataFrame) -> DataFrame:
    """Columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unpivot_sides(df: DataFrame, keys: list[str], sides: dict[str, dict[str, str]]) -> DataFrame:
    """One row per key and side; ``sides`` maps a side to its {target: source} columns."""
    each = [F.struct(F.lit(side).alias("side"), *[F.col(src).alias(dst) for dst, src in cols.items()]) for side, cols in sides.items()]
    return df.select(*keys, F.explode(F.array(*each)).alias("_s")).select(*keys, "_s.*")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def distinct_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct rows, or distinct keys."""
    return df.select(*keys).distinct() if keys else df.distinct()
