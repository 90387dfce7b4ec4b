"""Joins (J01-J28). As-of joins are a tagged union, one sort and one running ``last``: one shuffle, no inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventry.operators.project import yes
from eventry.operators.ranges import deal, null_safe_join, scan


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], direction: str = "backward", strict: bool = False, tolerance: float | None = None, tie: str | None = None) -> DataFrame:
    """The nearest right row on one side of each left row, as the struct ``match`` (``{right_on}`` and the payload), or null.

    ``tie`` orders right rows at the same place (a unique column; the first wins when looking forward, the last when looking backward).
    Null keys of ``by`` match each other. Looking forward walks the order from its end, so that both directions use a running frame. A hot group is cut
    into ranges of the order, and each range is handed the last match of those before it.
    """
    back = direction == "backward"
    cols = [F.col(c) for c in by]
    keep = [c for c in left.columns if c not in by]
    tie_col = F.col(tie) if tie else F.lit(0)
    ls = left.select(*cols, F.col(left_on).cast("double").alias("_at"), F.struct(*keep).alias("_left"), F.lit(None).alias("_match"), F.lit(None).alias("_tie"))
    rs = right.select(*cols, F.col(right_on).cast("double").alias("_at"), F.lit(None).alias("_left"), F.struct(F.col(right_on), *payload).alias("_match"), tie_col.alias("_tie"))
    # At the same place the right row is met first if it may match, else the left row is.
    is_left = F.col("_left").isNotNull().cast("int")
    both = ls.unionByName(rs).withColumn("_side", is_left if back != strict else -is_left)
    order = ["_at", "_side", "_tie"]
    found = scan(deal(both, by, order), by, order, {"match": ("last", F.col("_match"), True)}, descending=not back).where("_left IS NOT NULL")
    if tolerance is not None:
        found = found.withColumn("match", F.when(F.abs(F.col("_at") - F.col(f"match.{right_on}").cast("double")) <= tolerance, F.col("match")))
    return found.select(*by, "_left.*", "match")


def asof_backward(left, right, by, left_on, right_on, payload, tolerance=None, strict=False, tie=None) -> DataFrame:
    """J01 and J02 are this with the pass as the right side; the tolerance counts what the order counts."""
    return asof(left, right, by, left_on, right_on, payload, "backward", strict, tolerance, tie)


def attach_destination(df: DataFrame, by: list[str], order: list[str], sources: list[str], targets: list[str], value_cols: list[str], tolerance_rows: int | None = 3, pick: str = "first", text_col: str | None = None, id_col: str = "id", type_col: str = "type") -> DataFrame:
    """Each target row back to the nearest source row before it in its group, at most some rows away.

    Of several targets of a source the first (or last) wins. Sources get ``dest_{col}`` (their own values without a target), other
    rows 0; target rows are dropped. With ``text_col`` the texts of source and target are joined.
    """
    is_source, is_target = yes(F.col(type_col).isin(*sources)), yes(F.col(type_col).isin(*targets))
    d = scan(deal(df, by, order), by, order, {"_n": ("sum", F.lit(1), True)})
    source = F.when(is_source, F.struct(F.col("_n").alias("n"), F.col(id_col).alias("id")))
    d = scan(d, by, order, {"_src": ("last", source, False)})
    d = d.withColumn("_src", F.when(is_target, F.col("_src")))
    near = F.col("_src").isNotNull() if tolerance_rows is None else (F.col("_n") - F.col("_src.n") <= tolerance_rows)
    best = (F.min if pick == "first" else F.max)(F.struct("_n", *value_cols, *([text_col] if text_col else []))).alias("_best")
    hits = d.where(yes(near)).groupBy(*by, F.col("_src.id").alias(id_col)).agg(best)
    joined = null_safe_join(d.where(~is_target), hits, [*by, id_col])
    out = [F.col(c) for c in df.columns if c != text_col]
    out += [F.when(is_source, F.coalesce(F.col(f"_best.{c}"), F.col(c))).otherwise(F.lit(0.0)).alias(f"dest_{c}") for c in value_cols]
    if text_col:
        out.append(F.when(F.col("_best").isNotNull(), F.concat_ws(" | ", F.col(text_col), F.col(f"_best.{text_col}"))).otherwise(F.col(text_col)).alias(text_col))
    return joined.select(*out)


def asof_nearest(left, right, by, left_on, right_on, payload, tie=None) -> DataFrame:
    """The nearer of the two sides; of equal distances the backward one. Null keys are a group."""
    back = asof(left, right, by, left_on, right_on, payload, "backward", tie=tie).withColumnRenamed("match", "_back")
    both = asof(back, right, by, left_on, right_on, payload, "forward", tie=tie)
    gap = lambda m: F.abs(F.col(f"{m}.{right_on}").cast("double") - F.col(left_on).cast("double"))
    nearer = F.when(F.col("_back").isNull() | (gap("match") < gap("_back")), F.coalesce("match", "_back")).otherwise(F.col("_back"))
    return both.withColumn("match", nearer).drop("_back")


def next_time(df: DataFrame, types: list[str], by: list[str], time: str = "t", out: str = "next_time", type_col: str = "type") -> DataFrame:
    """The first time of some types strictly after each row."""
    return next_payload(df, types, by, time, [], type_col=type_col).withColumn(out, F.col(f"_next.{time}")).drop("_next")


def next_payload(df: DataFrame, types: list[str], by: list[str], time: str, payload: list[str], tie: str = "id", type_col: str = "type") -> DataFrame:
    """Time and payload of the first such row strictly after each row, as the struct ``_next``; of rows at one time the least ``tie``.

    Times are taken once each, so that rows at the same time never see one another.
    """
    hit = F.when(yes(F.col(type_col).isin(*types)), F.struct(time, tie, *payload))
    times = df.groupBy(*by, time).agg(F.min(hit).alias("_hit"))
    times = scan(deal(times, by, [time]), by, [time], {"_next": ("last", F.col("_hit"), False)}, descending=True)
    return null_safe_join(df, times.select(*by, time, "_next"), [*by, time])


def first_in_range(left: DataFrame, right: DataFrame, by: list[str], at: str, low: float, high: float, payload: list[str], tie: str = "id") -> DataFrame:
    """The first right row within [at + low, at + high] of each left row, as the struct ``match``.

    The first row at or after at + low is the only candidate, so this is a forward as-of join and a check of the upper bound.
    """
    shifted = left.withColumn("_from", F.col(at) + F.lit(float(low)))
    r = right.withColumn("_time", F.col(at))
    found = asof(shifted, r, by, "_from", "_time", payload, "forward", tie=tie)
    return found.withColumn("match", F.when(F.col("match._time") <= F.col(at) + F.lit(float(high)), F.col("match"))).drop("_from")


def join_context(df: DataFrame, ctx: DataFrame, keys: list[str], dedupe_order: list[str]) -> DataFrame:
    """A left join with at most one context row per key: the first in the order."""
    one = ctx.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*dedupe_order))).where("_r = 1").drop("_r")
    return df.join(one, keys, "left")


def role_on_ice(df: DataFrame, roster: DataFrame, ids: DataFrame, keys: list[str], side: str = "side", member: str = "player", order: str = "player", sides: tuple[str, str] = ("home", "away")) -> DataFrame:
    """Per key and side the first roster member that has the role (``ids``), as ``{side}_{member}``."""
    with_role = roster.join(ids.select(member).distinct(), member, "left_semi")
    first = with_role.groupBy(*keys).agg(*[F.min_by(member, F.when(F.col(side) == s, F.col(order))).alias(f"{s}_{member}") for s in sides])
    return df.join(first, keys, "left")


def opposing_value(df: DataFrame, team: str, home_team: str, home: str, away: str, out: str) -> DataFrame:
    """The away value for the home team's rows, the home value for the others; null without a team."""
    return df.withColumn(out, F.when(F.col(team) == F.col(home_team), F.col(away)).when(F.col(team).isNotNull(), F.col(home)))


def restrict_to_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs; no key is doubled by it."""
    return df.join(keys_df.select(*keys), keys, "left_semi")


def roster_filter(df: DataFrame, roster: DataFrame, keys: list[str], exclude: DataFrame, member: str = "player") -> DataFrame:
    """Rows whose member is on the roster and not excluded."""
    return df.join(roster.select(*keys, member), [*keys, member], "left_semi").join(exclude.select(member), member, "left_anti")


def join_event_context(tracking: DataFrame, events: DataFrame, keys: list[str], context: list[str]) -> DataFrame:
    """J12."""
    return tracking.join(events.select(*keys, *context), keys, "left")


def enrich_spine(spine: DataFrame, preds: DataFrame, extra: DataFrame, keys: list[str], coalesce_cols: list[str]) -> DataFrame:
    """Predictions and extra columns to the spine's rows; of shared columns the spine's value counts if it has one."""
    out = spine
    for other in (preds, extra):
        shared = [c for c in other.columns if c not in keys and c in out.columns]
        joined = out.join(other.withColumnsRenamed({c: f"_n_{c}" for c in shared}), keys, "left")
        out = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_n_{c}")) if c in coalesce_cols else F.col(c) for c in shared}).drop(*[f"_n_{c}" for c in shared])
    return out


def overlay_on_spine(preds: DataFrame, spine: DataFrame, keys: list[str], coalesce_cols: list[str]) -> DataFrame:
    """Every row of the spine, the predictions' values laid over it."""
    p = preds.withColumnsRenamed({c: f"_p_{c}" for c in coalesce_cols})
    joined = p.join(spine, keys, "right")
    return joined.withColumns({c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) if c in spine.columns else F.col(f"_p_{c}") for c in coalesce_cols}).drop(*[f"_p_{c}" for c in coalesce_cols])


# Key buckets whose digests are compared before rows are.
BUCKETS = 4096


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def unequal_buckets(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The key buckets (``_bucket``, ``BUCKETS`` at most) in which two tables differ in rows, keys or columns, by digests that are summed before the shuffle."""
    digest = lambda df, n: df.groupBy(_bucket(keys).alias("_bucket")).agg(*[F.struct(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), *keys, *cols).cast("decimal(38,0)")) for seed in (1, 2)]).alias(n)])
    both = digest(a, "_a").join(digest(b, "_b"), "_bucket", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket")


def in_buckets(df: DataFrame, keys: list[str], buckets: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows in some key buckets, where they lie (with ``left_anti`` the others)."""
    return df.withColumn("_bucket", _bucket(keys)).join(F.broadcast(buckets), "_bucket", how).drop("_bucket")  # BUCKETS rows at most


def key_parity(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per group how many distinct keys are on both sides, or on one only.

    Digests of key buckets are compared first. Only rows of unequal buckets are joined; of equal ones the keys of one side are counted. ``by`` is one of the keys.
    """
    ks = list(dict.fromkeys([*keys, by]))
    a, b = a.select(*ks), b.select(*ks)
    differ = unequal_buckets(a, b, ks, [])
    flag = lambda df, n: in_buckets(df, ks, differ).distinct().withColumn(n, F.lit(1))
    both = null_safe_full(flag(a, "_a"), flag(b, "_b"), ks)
    count = lambda c: F.sum(c.cast("long"))
    la, lb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    apart = both.groupBy(by).agg(count(la & lb).alias("n_both"), count(la & ~lb).alias("n_left_only"), count(~la & lb).alias("n_right_only"))
    zero = F.lit(0).cast("long")
    alike = in_buckets(a, ks, differ, "left_anti").distinct().groupBy(by).agg(F.count("*").alias("n_both")).select(by, "n_both", zero.alias("n_left_only"), zero.alias("n_right_only"))
    return apart.union(alike).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n_both", "n_left_only", "n_right_only")])


def null_safe_full(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of two tables of distinct keys, with the other columns of both; null keys match."""
    return a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(c).alias(c) for c in dict.fromkeys([*a.columns, *b.columns]) if c not in keys])


def _once(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """The table as it is; the query fails where a key comes a second time. The check is part of the plan and uses the join's own distribution."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return df.withColumn("_nth", nth).where(F.when(F.col("_nth") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)).drop("_nth")


def _found(joined: DataFrame, mark: str, message: str) -> DataFrame:
    """The rows of an outer join; the query fails where the other side is missing."""
    return joined.where(F.when(F.col(mark).isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)).drop(mark)


def align_keys(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """df's rows for the target's keys; a missing or doubled key fails the query that reads them. No job runs before that."""
    one = _once(df, keys, "a key is doubled").withColumn("_here", F.lit(1))
    return _found(target.select(*keys).join(one, keys, "left"), "_here", "a key is missing")


def map_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default=1, out: str | None = None) -> DataFrame:
    """A value per key, the default where there is none. The mapping's size decides the join: Spark broadcasts a small one."""
    m = mapping.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(m, df[key] == m["_k"], "left").withColumn(out or value, F.coalesce(F.col("_v"), F.lit(default))).drop("_k", "_v")


def opponent_map(df: DataFrame, group: str = "game", team: str = "team") -> DataFrame:
    """Team and opponent of the groups with exactly two teams. Distinct pairs first, so a group's array has its few teams."""
    teams = df.where(F.col(team).isNotNull()).select(group, team).distinct().groupBy(group).agg(F.array_sort(F.collect_list(team)).alias("_t")).where(F.size("_t") == 2)
    pair = lambda i: F.struct(F.col("_t")[i].alias(team), F.col("_t")[1 - i].alias("opponent"))
    return teams.select(group, F.explode(F.array(pair(0), pair(1))).alias("_p")).select(group, "_p.*")


def inverse_rows(base: DataFrame, sidecar: DataFrame, keys: list[str], kept: str, net: str, source: str, id_col: str = "id", base_type: str | None = None, type_col: str = "type", order: list[str] | None = None) -> DataFrame:
    """A row per sidecar entry that is linked to a row with a net, with the negated net: ``adj_for`` if it is a gain, ``adj_against`` if a loss.

    Entries whose row is missing or has no net give none. A doubled row of the base counts once: the first in ``order`` (without one, the least net).
    """
    b = base.where(F.col(type_col) == base_type) if base_type else base
    one = F.min_by(F.struct(F.col(net).alias("v")), F.struct(*order))["v"] if order else F.min(net)
    b = b.groupBy(*keys, F.col(id_col).alias(kept)).agg(one.alias("_net")).where("_net IS NOT NULL")
    gain = F.lit(0.0) - F.col("_net")
    return sidecar.join(b, [*keys, kept]).withColumns({
        net: gain,
        "adj_for": F.when(gain >= 0, gain).otherwise(0.0),
        "adj_against": F.when(gain < 0, F.col("_net")).otherwise(0.0),
        "credit_source": F.lit(source),
    }).drop("_net")


def drop_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """J21."""
    return df.join(keys_df.select(*keys), keys, "left_anti")


def attach_source(preds: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Many predictions to one source row; doubled source keys and orphans fail the query that reads them. No job runs before that."""
    one = _once(source, keys, "source keys are doubled").withColumn("_here", F.lit(1))
    return _found(preds.join(one, keys, "left"), "_here", "a prediction has no source row")


def reconcile(official: DataFrame, counted: DataFrame, extra: DataFrame, unassigned: DataFrame, group: str = "game", team: str = "team") -> DataFrame:
    """Official scores with what was counted, with extras and with what no team has; ``deficit`` is what is missing."""
    out = official.join(counted, [group, team], "left").join(extra, [group, team], "left").join(unassigned, group, "left").fillna(0, ["counted", "extra", "unassigned"])
    return out.withColumn("deficit", F.col("score") - F.col("counted") - F.col("extra"))


def backfill(df: DataFrame, other: DataFrame, keys: list[str], cols: list[str], order: str) -> DataFrame:
    """Missing values from the last row of another table with the same key."""
    last = other.groupBy(*keys).agg(*[F.max_by(c, order).alias(f"_b_{c}") for c in cols])
    return df.join(last, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in cols}).drop(*[f"_b_{c}" for c in cols])


def pair_rows(df: DataFrame, type_a: str, type_b: str, keys: list[str], value: str, type_col: str = "type") -> DataFrame:
    """Rows of two types with the same keys, side by side."""
    side = lambda t, n: df.where(F.col(type_col) == t).select(*keys, F.col(value).alias(n))
    return side(type_a, "value_a").join(side(type_b, "value_b"), keys)


def link_chain(goals: DataFrame, links: DataFrame, rows: DataFrame, keys: list[str], id_col: str = "id", link: str = "source_id", prev: str = "prev_id", payload: tuple[str, ...] = ("value",)) -> DataFrame:
    """Each goal with its source (inner) and the row before it (left); of doubled goals the last id stays."""
    src = links.select(*keys, F.col(id_col), F.col(link), F.col(prev))
    before = rows.select(*keys, F.col(id_col).alias(prev), *[F.col(p).alias(f"prev_{p}") for p in payload])
    chain = goals.join(src, [*keys, id_col]).join(before, [*keys, prev], "left")
    return chain.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, link).orderBy(F.col(id_col).desc()))).where("_r = 1").drop("_r")


def knn_edges(df: DataFrame, event_key: list[str], node: str, x: str, y: str, k: int = 3) -> DataFrame:
    """Edges between each node and its k nearest in the same event, both ways, each once.

    An event's nodes are few by nature (a fixed number of slots); they are packed into one array and compared in place, so only one shuffle is needed.
    """
    packed = df.groupBy(*event_key).agg(F.collect_list(F.struct(F.col(node).alias("n"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("_all"))
    def nearest(a: Column) -> Column:
        others = F.filter("_all", lambda b: b["n"] != a["n"])
        ranked = F.array_sort(F.transform(others, lambda b: F.struct(F.hypot(a["x"] - b["x"], a["y"] - b["y"]).alias("d"), b["n"].alias("n"))))
        return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(a["n"].alias("u"), r["n"].alias("v")))
    directed = F.flatten(F.transform("_all", nearest))
    both = F.array_distinct(F.concat(directed, F.transform(directed, lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v")))))
    return packed.select(*event_key, F.explode(both).alias("_e")).select(*event_key, "_e.u", "_e.v")


def key_match_rate(ref: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """How many reference rows the spine has."""
    s = spine.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return ref.join(s, keys, "left").agg(F.count("*").alias("n"), F.count("_hit").alias("n_matched"), (F.count("_hit") / F.count("*")).alias("rate"))
