"""Ordered-row operators (W01-W45). Every window is partitioned by group at least; look-aheads are descending running frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventry.functions.scalars import wrap_angle
from eventry.operators.joins import next_payload
from eventry.operators.project import union_aligned, yes
from eventry.operators.ranges import deal, null_safe_join, scan
from eventry.schema import DEFAULT, EventSchema

# Types that end a sequence, that shots count as, and the caps on transitions; net, zones and period lengths.
TERMINATORS = ("whistle", "goal")
SHOT_LIKE = ("shot", "deflection")
ATTEMPTS = ("shot", "deflection", "defensive_deflection")
RESETS = ("faceoff", "whistle", "stoppage", "goal", "end_of_period", "period_end", "period_start", "start_of_period")
SAVE_REASONS = ("save_with_freeze_credit", "save_with_whistle_no_baseline", "save_play_continued")
CAPS = {"distance": 200.0, "speed": 120.0}
NET = (89.0, 0.0)
ZONE_EDGE, ZONE_EPS = 25.5, 0.25
PERIOD_SECONDS = 1200.0
SLOT_FLAGS = ("slot", "is_consistent", "is_new_to_stint")

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _is(types, s: EventSchema) -> Column:
    return yes(F.col(s.type).isin(*types))


def _neighbour(df: DataFrame, by: list[str], order: list[str], out: str, fields: dict[str, str], after: bool = False) -> DataFrame:
    """The fields of the row before (or after) in its group, as one struct; a hot group is walked range by range."""
    row = F.struct(*[F.col(c).alias(k) for k, c in fields.items()])
    return scan(deal(df, by, order), by, order, {out: ("last", row, False)}, descending=after).drop("_cell")


def transition_features(df: DataFrame, s: EventSchema = DEFAULT, caps=CAPS, no_speed: tuple[str, ...] = ("save",)) -> DataFrame:
    """Time, distance, speed and angle from the event before in the period."""
    d = _neighbour(df, [s.group, s.period], list(s.order), "_at", {"t": s.time, "x": s.x, "y": s.y})
    out = d.withColumns({"dt": F.greatest(F.col(s.time) - F.col("_at.t"), F.lit(0.0)), "_dx": F.col(s.x) - F.col("_at.x"), "_dy": F.col(s.y) - F.col("_at.y")}).drop("_at")
    distance = F.least(F.hypot("_dx", "_dy"), F.lit(caps["distance"]))
    speed = F.when((F.col("dt") > 0) & ~_is(no_speed, s), F.least(distance / F.col("dt"), F.lit(caps["speed"])))
    return out.withColumns({"distance": F.when(F.col("_dx").isNotNull(), distance), "speed": F.when(F.col("_dx").isNotNull(), speed), "angle": F.atan2("_dy", "_dx")}).drop("_dx", "_dy")


def angle_change(df: DataFrame, s: EventSchema = DEFAULT, shots=ATTEMPTS, reception: str = "reception", source: str = "pass", lookback: tuple[int, ...] = (2, 3, 4), net=NET, dest=("dest_x", "dest_y")) -> DataFrame:
    """How far the angle to the net turned on a shot, since the row before it in its sequence.

    After a reception the origin is that of the nearest pass 2-4 rows back: its destination, or its own place if it has none. Without such a pass it is the reception's.
    """
    w = s.window(s.period, s.sequence)
    angle = lambda x, y: F.atan2(F.lit(net[1]) - y, F.lit(net[0]) - x)
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    to = [F.col(c) for c in dest]
    aimed = F.when(to[0].isNotNull() & to[1].isNotNull(), place(*to)).otherwise(place(F.col(s.x), F.col(s.y)))
    d = df.withColumn("_to", aimed)
    from_pass = F.coalesce(*[F.when(F.lag(s.type, n).over(w) == source, F.lag("_to", n).over(w)) for n in lookback])
    before = place(F.lag(s.x).over(w), F.lag(s.y).over(w))
    origin = F.when(yes(F.lag(s.type).over(w) == reception), F.coalesce(from_pass, before)).otherwise(before)
    d = d.withColumn("_o", origin)
    turned = F.abs(wrap_angle(angle(F.col(s.x), F.col(s.y)) - angle(F.col("_o.x"), F.col("_o.y"))))
    return d.withColumn("angle_change", F.when(_is(shots, s), turned)).drop("_o", "_to")


def disorder_count(df: DataFrame, s: EventSchema = DEFAULT, threshold: float = -1.0) -> DataFrame:
    """How often time falls by more than the threshold in a sequence."""
    d = _neighbour(df.select(s.group, s.sequence, s.id, s.time), [s.group, s.sequence], [s.id], "_at", {"t": s.time})
    return d.select((F.col(s.time) - F.col("_at.t")).alias("dt")).agg(F.coalesce(F.sum((F.col("dt") < threshold).cast("long")), F.lit(0)).alias("n_disorder"))


def canonical_order(df: DataFrame, ingest: str, s: EventSchema = DEFAULT, threshold: float = -1.0) -> DataFrame:
    """Numbers in sequence and game. If time falls anywhere in a sequence, everything is sorted by time; else the order at ingest holds."""
    seq = Window.partitionBy(s.group, s.sequence).orderBy(ingest)
    falls = F.coalesce(F.col(s.time) - F.lag(s.time).over(seq) < threshold, F.lit(False))
    flag = df.select(falls.alias("f")).agg(F.coalesce(F.bool_or("f"), F.lit(False)).alias("_resort"))
    d = df.join(F.broadcast(flag))  # one row
    keys = [F.when(F.col("_resort"), F.col(s.period)), F.when(F.col("_resort"), F.col(s.time)), F.col(ingest)]
    game = Window.partitionBy(s.group).orderBy(*keys)
    sequence = Window.partitionBy(s.group, s.sequence).orderBy(*keys)
    return d.withColumns({"sequence_event_id": F.row_number().over(sequence), "game_event_id": F.row_number().over(game)}).drop("_resort")


def elapsed_clock(df: DataFrame, s: EventSchema = DEFAULT, order: str = "id", length: float = PERIOD_SECONDS) -> DataFrame:
    """Clocks that mostly count down are turned round, per game and period; then one clock for the whole game."""
    w = Window.partitionBy(s.group, s.period).orderBy(order)
    d = df.withColumn("_d", F.signum(F.col(s.time) - F.lag(s.time).over(w)))
    down = F.coalesce(F.sum("_d").over(Window.partitionBy(s.group, s.period)), F.lit(0)) < 0
    d = d.withColumn("elapsed", F.when(down, F.lit(length) - F.col(s.time)).otherwise(F.col(s.time)))
    return d.withColumn("game_time", (F.col(s.period) - 1) * length + F.col("elapsed")).drop("_d")


def cut_after_terminator(df: DataFrame, s: EventSchema = DEFAULT, terminators=TERMINATORS, keep: Column | None = None) -> DataFrame:
    """Nothing after the first terminator of a sequence, but for rows to keep."""
    by, order = [s.group, s.sequence], list(s.order)
    d = scan(deal(df, by, order), by, order, {"_over": ("last", F.when(_is(terminators, s), True), False)})
    return d.where(F.col("_over").isNull() | (yes(keep) if keep is not None else F.lit(False))).drop("_over", "_cell")


def cut_after_types(df: DataFrame, rules: dict[str, Column | None], s: EventSchema = DEFAULT) -> DataFrame:
    """Each type ends a sequence in its own way: after it only the rows that its rule keeps (None: none) stay."""
    by, order = [s.group, s.sequence], list(s.order)
    d = scan(deal(df, by, order), by, order, {f"_after_{t}": ("last", F.when(_is((t,), s), True), False) for t in rules})
    for t, keep in rules.items():
        d = d.where(F.col(f"_after_{t}").isNull() | (yes(keep) if keep is not None else F.lit(False)))
    return d.drop("_cell", *[f"_after_{t}" for t in rules])


def drop_false_starts(df: DataFrame, s: EventSchema = DEFAULT, start: str = "faceoff", inert=("faceoff", "whistle")) -> DataFrame:
    """Sequences with a start and nothing but inert rows go."""
    keys = [s.group, s.sequence]
    seen = df.groupBy(*keys).agg(F.bool_or(_is((start,), s)).alias("_start"), F.bool_or(~_is(inert, s)).alias("_live"))
    return null_safe_join(df, seen.where("_start AND NOT _live").select(*keys), keys, "left_anti")


def cut_after_first(df: DataFrame, type_: str, s: EventSchema = DEFAULT) -> DataFrame:
    """The first such row of a game is its last row."""
    by, order = [s.group], list(s.order)
    d = scan(deal(df, by, order), by, order, {"_seen": ("last", F.when(_is((type_,), s), True), False)})
    return d.where("_seen IS NULL").drop("_seen", "_cell")


def drop_windows(df: DataFrame, start: str, stop: str, s: EventSchema = DEFAULT) -> DataFrame:
    """From each start up to, not including, the next stop of another sequence."""
    by, order = [s.group], list(s.order)
    at = F.when(_is((start,), s), F.struct(F.col(s.sequence).alias("q"), F.struct(*order).alias("at")))
    d = scan(deal(df, by, order), by, order, {"_open": ("last", at, True)})
    closing = _is((stop,), s) & yes(F.col(s.sequence) != F.col("_open.q"))
    d = scan(d, by, order, {"_closed": ("last", F.when(closing, F.col("_open.at")), True)})
    # The last stop counts if it belongs to the start that is open.
    return d.where(F.col("_open").isNull() | yes(F.col("_closed") == F.col("_open.at"))).drop("_open", "_closed", "_cell")


def keep_best_duplicate(df: DataFrame, type_: str = "goal", sources=ATTEMPTS, s: EventSchema = DEFAULT) -> DataFrame:
    """Of a team's rows of a type in a sequence of a period the one closest after a source row of the same team stays, then the earliest.

    Places count all rows of the sequence. Rows of the type without a team, sequence or period are no duplicates.
    """
    keys = [s.group, s.period, s.sequence, s.team]
    d = df.withColumn("_n", F.row_number().over(s.window(s.period, s.sequence)))
    own = s.window(s.period, s.sequence, s.team).rowsBetween(*BEFORE)
    d = d.withColumn("_src", F.last(F.when(_is(sources, s), F.col("_n")), ignorenulls=True).over(own))
    gap = F.coalesce(F.col("_n") - F.col("_src"), F.lit(1 << 30))
    rank = F.row_number().over(Window.partitionBy(*keys, _is((type_,), s)).orderBy(gap, "_n"))
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    return d.withColumn("_rank", rank).where(~_is((type_,), s) | ~known | (F.col("_rank") == 1)).drop("_n", "_src", "_rank")


def drop_adjacent_duplicates(df: DataFrame, type_: str, s: EventSchema = DEFAULT) -> DataFrame:
    """Of two neighbouring rows of a type in a sequence the one with a player stays; of equals the first."""
    w = s.in_sequence()
    is_t = _is((type_,), s)
    after_twin, before_twin = is_t & yes(F.lag(s.type).over(w) == type_), is_t & yes(F.lead(s.type).over(w) == type_)
    d = df.withColumns({"_a": after_twin, "_b": before_twin, "_pp": F.lag(s.player).over(w), "_np": F.lead(s.player).over(w)})
    lose = (F.col("_a") & (F.col("_pp").isNotNull() | F.col(s.player).isNull())) | (F.col("_b") & F.col(s.player).isNull() & F.col("_np").isNotNull())
    return d.where(~lose).drop("_a", "_b", "_pp", "_np")


def eos_flag(df: DataFrame, s: EventSchema = DEFAULT, types=TERMINATORS, mode: str = "last_terminator") -> DataFrame:
    """The last row of a sequence if it is a terminator (or ``any_terminator``: every terminator; ``last``: every last row)."""
    last = F.row_number().over(s.in_sequence(descending=True)) == 1
    flag = {"last_terminator": last & _is(types, s), "any_terminator": _is(types, s), "last": last}[mode]
    return df.withColumn("is_eos", flag.cast("int"))


def link_latest(df: DataFrame, sources, sinks, s: EventSchema = DEFAULT) -> DataFrame:
    """Each sink with the latest source of its sequence that no sink before it has taken, as ``source_id``.

    A walk goes up at sources and down at sinks, and stays at 0 at its lowest. A sink that leaves level d takes the latest source that reached d. The walk is
    a scan of brackets: a stretch of rows counts by its sum (sources less sinks) and its lowest point (sinks that it leaves open), and these compose, so the ranges
    of a hot sequence are walked apart; so are the pairs inside a hot level. No loop is needed.
    """
    by, order = [s.group, s.sequence], list(s.order)
    d = df.withColumn("_step", F.when(_is(sources, s), 1).when(_is(sinks, s), -1).otherwise(0))
    d = scan(deal(d, by, order), by, order, {"_sum": ("sum", F.col("_step"), True)})
    d = scan(d, by, order, {"_low": ("min", F.col("_sum"), True)})
    d = d.withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.col("_low")))
    # A sink at level 0 with nothing to take keeps level 0 before it, too.
    d = scan(d, by, order, {"_was": ("last", F.col("_level"), False)}).drop("_cell")
    takes = (F.col("_step") == -1) & (F.coalesce("_was", F.lit(0)) > 0)
    d = d.withColumn("_depth", F.when(F.col("_step") == 1, F.col("_level")).when(takes, F.col("_level") + 1))
    # On a level sources and sinks take turns, so the last source before a sink is the row before it.
    at = [*by, "_depth"]
    d = scan(deal(d, at, order), at, order, {"source_id": ("last", F.when(F.col("_step") == 1, F.col(s.id)), False)})
    return d.withColumn("source_id", F.when(takes, F.col("source_id"))).drop("_step", "_sum", "_low", "_level", "_was", "_depth", "_cell")


def derive_flag(df: DataFrame, s: EventSchema = DEFAULT, goal: str = "goal", sources=SHOT_LIKE, tag: Column | None = None) -> DataFrame:
    """A goal, a shot whose next row in the game is its team's goal in the same sequence, or a tagged row."""
    d = _neighbour(df, [s.group], list(s.order), "_next", {"type": s.type, "sequence": s.sequence, "team": s.team}, after=True)
    same = lambda k, c: yes(F.col(f"_next.{k}") == F.col(c))
    scored = _is(sources, s) & yes(F.col("_next.type") == goal) & same("sequence", s.sequence) & same("team", s.team)
    return d.withColumn("is_goal", _is((goal,), s) | scored | (yes(tag) if tag is not None else F.lit(False))).drop("_next")


def inject_after(df: DataFrame, mask: Column, values: dict[str, Column], s: EventSchema = DEFAULT, id_step: float = 0.5, time_step: float = 0.1) -> DataFrame:
    """A made row after each row of the mask (which may look at its window), with new ids; ``is_synthetic`` marks it.

    Ids are decimals, so half steps are exact. A clash of ids is found by :func:`eventry.operators.gates.duplicate_keys`.
    """
    d = df.withColumn(s.id, F.col(s.id).cast("decimal(18,6)")).withColumn("is_synthetic", F.lit(0))
    hit = d.withColumn("_hit", yes(mask)).where("_hit").drop("_hit")
    made = hit.withColumns({s.id: (F.col(s.id) + F.lit(str(id_step)).cast("decimal(18,6)")).cast("decimal(18,6)"), s.time: F.col(s.time) + F.lit(time_step), "is_synthetic": F.lit(1)} | values)
    return d.unionByName(made)


def reclassify(df: DataFrame, target: str, new: str, prior=("shot",), n: int = 3, resets=RESETS, s: EventSchema = DEFAULT) -> DataFrame:
    """A target row becomes ``new`` if the nearest prior row among the n rows before it in its sequence is another team's.

    The search stops at the nearest prior row, whose team decides (a missing team on either side: no), and at a reset.
    """
    w = s.in_sequence()
    state = F.lit(False)
    for k in range(n, 0, -1):  # the nearest row decides last
        kind, team = F.lag(s.type, k).over(w), F.lag(s.team, k).over(w)
        state = F.when(yes(kind.isin(*resets)), False).when(yes(kind.isin(*prior)), yes(team != F.col(s.team))).otherwise(state)
    d = df.withColumn("_other", state)
    return d.withColumn(s.type, F.when(_is((target,), s) & F.col("_other"), new).otherwise(F.col(s.type))).drop("_other")


def demote_before_anchor(df: DataFrame, movers, before: str, anchors, n: int = 5, s: EventSchema = DEFAULT) -> DataFrame:
    """A mover directly before a ``before`` row goes ahead of the earliest anchor of the n rows before it and takes its time."""
    w = s.in_sequence()
    d = df.withColumns({"_n": F.row_number().over(w).cast("double"), "_nt": F.lead(s.type).over(w)})
    earliest = F.coalesce(*[F.when(yes(F.lag(s.type, k).over(w).isin(*anchors)), F.struct(F.lag("_n", k).over(w).alias("n"), F.lag(s.time, k).over(w).alias("t"))) for k in range(n, 0, -1)])
    d = d.withColumn("_a", F.when(_is(movers, s) & yes(F.col("_nt") == before), earliest))
    d = d.withColumns({"_n": F.coalesce(F.col("_a.n") - 0.5, F.col("_n")), s.time: F.coalesce(F.col("_a.t"), F.col(s.time))})
    new = Window.partitionBy(s.group, s.sequence).orderBy("_n", s.id)
    return d.withColumn("sequence_event_id", F.row_number().over(new)).drop("_n", "_nt", "_a")


def lookahead_label(df: DataFrame, s: EventSchema = DEFAULT, shots=SHOT_LIKE, goal: str = "goal", block: str = "block", outcome: str = "outcome") -> DataFrame:
    """A shot whose next row is a goal, or a failed block and then a goal."""
    w = s.in_sequence()
    direct = yes(F.lead(s.type).over(w) == goal)
    through = yes(F.lead(s.type).over(w) == block) & yes(F.lead(outcome).over(w) == "failed") & yes(F.lead(s.type, 2).over(w) == goal)
    return df.withColumn("target_xg", (_is(shots, s) & (direct | through)).cast("int"))


def horizon_label(df: DataFrame, s: EventSchema = DEFAULT, horizon: float = 20.0, cap: float | None = PERIOD_SECONDS, goal: str = "goal", extended: tuple[str, str, float] | None = None) -> DataFrame:
    """What follows within the horizon: 0 the own team's goal, 1 another's (or one without a team), 2 none; never beyond the period.

    Rows without a team have 2: nobody acts in them.
    ``extended`` = (type, until, seconds): rows of the type look until the next ``until`` row and the seconds after it.
    """
    d = next_payload(df, [goal], [s.group, s.period], s.time, [s.team], tie=s.id, type_col=s.type).withColumnRenamed("_next", "_goal")
    ends = df.groupBy(s.group, s.period).agg(F.max(s.time).alias("_end"))
    d = null_safe_join(d, ends, [s.group, s.period])
    end = F.col("_end") if cap is None else F.least(F.col("_end"), F.lit(cap))
    limit = F.col(s.time) + F.lit(horizon)
    if extended:
        d = next_payload(d, [extended[1]], [s.group, s.period], s.time, [], tie=s.id, type_col=s.type).withColumnRenamed("_next", "_until")
        limit = F.when(_is((extended[0],), s) & F.col("_until").isNotNull(), F.col(f"_until.{s.time}") + extended[2]).otherwise(limit)
    inside = yes(F.col(f"_goal.{s.time}") <= F.least(limit, end)) & F.col(s.team).isNotNull()
    own = yes(F.col(f"_goal.{s.team}") == F.col(s.team))
    return d.withColumn("target", F.when(inside & own, 0).when(inside, 1).otherwise(2)).drop("_goal", "_until", "_end")


def continuation_audit(df: DataFrame, type_: str, allowed, s: EventSchema = DEFAULT) -> DataFrame:
    """What comes after a type in its game, and whether it may."""
    d = df.withColumn("next_type", F.lead(s.type).over(s.window())).where(_is((type_,), s))
    return d.groupBy("next_type").agg(F.count("*").alias("n")).withColumn("allowed", F.col("next_type").isNull() | yes(F.col("next_type").isin(*allowed)))


def flag_offsetting(df: DataFrame, type_: str, gap: float = 4, s: EventSchema = DEFAULT) -> DataFrame:
    """Rows of a type with one of another team at most so many ids before or after, among the rows of that type. A missing team is a team of its own."""
    w = Window.partitionBy(s.group).orderBy(s.id)
    t = df.where(_is((type_,), s))
    near = lambda f: yes((F.abs(F.col(s.id) - f(s.id).over(w)) <= gap) & ~f(s.team).over(w).eqNullSafe(F.col(s.team)))
    return t.withColumn("is_offsetting", near(F.lag) | near(F.lead))


def rank_slots(df: DataFrame, key: list[str], role_col: str, slots: dict[str, int], order: list[str], metrics: list[str]) -> DataFrame:
    """The nearest members of each role as columns ``{role}{slot}_{metric}``. One aggregation; only ranked rows reach it."""
    ranked = df.withColumn("_slot", F.row_number().over(Window.partitionBy(*key, role_col).orderBy(*order)))
    cols = [F.max(F.when((F.col(role_col) == r) & (F.col("_slot") == k), F.col(m))).alias(f"{r}{k}_{m}") for r, n in slots.items() for k in range(1, n + 1) for m in metrics]
    return ranked.groupBy(*key).agg(*cols)


def persistent_slots(roster: DataFrame, keys: list[str], step: str, member: str, distance: str, n: int = 6) -> DataFrame:
    """Slots of a line over its steps: who stays keeps the slot, newcomers take free slots in the order of their distance (unknown ones last, then by name).

    Per row of the roster, doubled members once: ``slot`` (-1 without one), ``is_consistent`` (on the roster of the step before, too), ``is_new_to_stint``.
    The slots of a step depend on those before, so a group is walked in order. Rows stream through the walk sorted by group and step; what is held
    is one step's members and the slots, whatever the length of a group, and is carried from batch to batch.
    """
    names = [*keys, step, member]

    def assign(slots: dict, before: set, here: list) -> list[tuple[int, int, int]]:
        now = {*here}
        for m in [m for m in slots if m not in now]:
            del slots[m]
        free = iter(sorted({*range(n)} - {*slots.values()}))
        for m in here:
            if m not in slots and (k := next(free, None)) is not None:
                slots[m] = k
        return [(slots.get(m, -1), int(m in before), int(m not in before)) for m in here]

    def walk(batches):
        group = at = None
        slots: dict = {}
        before: set = set()
        here: dict = {}  # members of the step, in the order of their distance

        def flush():
            return [(*group, at, m, *found) for m, found in zip(here, assign(slots, before, [*here]), strict=True)]

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names] + [pa.int32()] * 3
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if here and (row[:-2] != group or row[-2] != at):
                    out += flush()
                    before, here = {*here}, {}
                if row[:-2] != group:
                    group, slots, before = row[:-2], {}, set()
                at = row[-2]
                here[row[-1]] = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, *SLOT_FLAGS])
        if here:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flush(), strict=True), kinds, strict=True)], names=[*names, *SLOT_FLAGS])

    kinds = dict(roster.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} int" for c in SLOT_FLAGS])
    rows = roster.select(*names, distance).repartition(*keys).sortWithinPartitions(*keys, step, F.col(distance).asc_nulls_last(), member)
    return rows.mapInArrow(walk, schema)


def changed_flag(df: DataFrame, col: str, s: EventSchema = DEFAULT) -> DataFrame:
    """Whether a value differs from that of the event before; the first has 0."""
    before = F.lag(F.struct(col)).over(s.window())
    return df.withColumn(f"{col}_changed", F.when(before.isNull(), 0).otherwise((~before[col].eqNullSafe(F.col(col))).cast("int")))


def slots_to_wide(df: DataFrame, keys: list[str], side: str, slot: str, sides: tuple[str, ...], n: int, metrics: dict[str, float]) -> DataFrame:
    """One row per event with ``{side}_{slot}_{metric}``; empty slots have the metric's default and ``slot_vacant`` 1."""
    at = lambda a, k: (F.col(side) == a) & (F.col(slot) == k)
    cols = [F.coalesce(F.max(F.when(at(a, k), F.col(m))), F.lit(v)).alias(f"{a}_{k}_{m}") for a in sides for k in range(n) for m, v in metrics.items()]
    vacant = [(1 - F.max(F.when(at(a, k), 1).otherwise(0))).alias(f"{a}_{k}_slot_vacant") for a in sides for k in range(n)]
    return df.groupBy(*keys).agg(*cols, *vacant)


def relative_delta(df: DataFrame, p_for: str, p_against: str, s: EventSchema = DEFAULT, zero_types=("goal", "whistle")) -> DataFrame:
    """How the two probabilities changed, seen by the acting team: the row before is swapped when the team changed.

    Rows without a team act for the last known one; while none is known, every row is a change. Missing probabilities are 0, and so is what stands before the
    first row. Zero types have no change.
    """
    w = s.window()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = df.withColumn("_team", F.last(s.team, ignorenulls=True).over(w.rowsBetween(*UP_TO)))
    d = d.withColumn("_prev", F.lag(F.struct(F.col("_team").alias("t"), F.col(p_for).alias("f"), F.col(p_against).alias("a"))).over(w))
    same = yes(F.col("_prev.t") == F.col("_team"))
    pf = F.when(same, F.col("_prev.f")).otherwise(F.col("_prev.a"))
    pa_ = F.when(same, F.col("_prev.a")).otherwise(F.col("_prev.f"))
    none = _is(zero_types, s)
    return d.withColumns({
        "delta_for": F.when(none, 0.0).otherwise(zero(F.col(p_for)) - zero(pf)),
        "delta_against": F.when(none, 0.0).otherwise(zero(F.col(p_against)) - zero(pa_)),
    }).drop("_team", "_prev")


def next_except(df: DataFrame, payload: list[str], s: EventSchema = DEFAULT, only: tuple[str, ...] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """W33 (and the lookup of W29): the payload of the next row of some types, or of any but some, as the struct ``next_row``."""
    good = _is(only, s) if only else ~_is(skip, s)
    w = s.window(descending=True).rowsBetween(*BEFORE)
    return df.withColumn("next_row", F.last(F.when(good, F.struct(*payload)), ignorenulls=True).over(w))


def inject_with_next(df: DataFrame, after: str, next_type: str, made_type: str, copy: dict[str, str], s: EventSchema = DEFAULT, step: float = 0.1) -> DataFrame:
    """A made row after each row of a type, with values of the next row of another type."""
    d = next_except(df, list(copy.values()), s, only=(next_type,))
    values = {s.type: F.lit(made_type)} | {c: F.col(f"next_row.{src}") for c, src in copy.items()}
    return inject_after(d, F.col(s.type) == after, values, s, step, step).drop("next_row")


def zone(x: Column, raw: Column | None = None, edge: float = ZONE_EDGE, eps: float = ZONE_EPS) -> Column:
    """Oz, dz or nz (no place: nz); within the band around an edge the sign of the raw value decides, if it has one."""
    plain = F.when(x > edge, "oz").when(x < -edge, "dz").otherwise("nz")
    if raw is None:
        return plain
    near = F.abs(F.abs(x) - edge) <= eps
    return F.when(near & (raw > 0), "oz").when(near & (raw < 0), "dz").otherwise(plain)


def stamp_next_zone(df: DataFrame, baselines: DataFrame, s: EventSchema = DEFAULT, at: str = "whistle", next_type: str = "faceoff", raw: str | None = None, probs: tuple[str, str, str] | None = None, edge: float = ZONE_EDGE, eps: float = ZONE_EPS) -> DataFrame:
    """On each ``at`` row the baselines (zone, base_for, base_against) of the next faceoff's zone; without one those of nz.

    ``raw`` names the place that decides at a zone's edge. ``probs`` (for, against, none) take the baselines on these rows, so that later steps see them as the row's state.
    """
    place = zone(F.col(s.x), F.col(raw) if raw else None, edge, eps)
    d = next_except(df.withColumn("_zone", place), ["_zone"], s, only=(next_type,))
    d = d.withColumn("zone", F.when(_is((at,), s), F.coalesce("next_row._zone", F.lit("nz")))).drop("next_row", "_zone")
    d = d.join(F.broadcast(baselines), "zone", "left")  # three rows
    if probs is None:
        return d
    none = F.greatest(F.least(1.0 - F.col("base_for") - F.col("base_against"), F.lit(1.0)), F.lit(0.0))
    new = zip(probs, (F.col("base_for"), F.col("base_against"), none), strict=True)
    return d.withColumns({c: F.when(_is((at,), s), v).otherwise(F.col(c)) for c, v in new})


def save_credit(df: DataFrame, delta: str, p_opp: str, baseline: str, s: EventSchema = DEFAULT, save: str = "save", whistle: str = "whistle") -> DataFrame:
    """A save's own delta, and if play stops right after it what the stop took from the other team's chance; ``save_reason`` says which applies."""
    w = s.window()
    frozen, base = yes(F.lead(s.type).over(w) == whistle), F.lead(baseline).over(w)
    freeze = F.when(frozen & base.isNotNull(), F.greatest(F.lit(0.0), F.coalesce(F.col(p_opp), F.lit(0.0)) - base)).otherwise(0.0)
    with_base, without, live = SAVE_REASONS
    d = df.withColumns({"freeze_credit": freeze, "save_reason": F.when(frozen & base.isNotNull(), with_base).when(frozen, without).otherwise(live)})
    return d.where(_is((save,), s)).withColumn("save_credit", F.coalesce(F.col(delta), F.lit(0.0)) + F.col("freeze_credit"))


def goal_allowed(df: DataFrame, p_for: str, p_against: str, s: EventSchema = DEFAULT, empty_net: str | None = None, goal: str = "goal") -> DataFrame:
    """What a goal costs the goalie: 1 minus the larger chance on the row before; nothing with an empty net."""
    w = s.window()
    chance = F.greatest(F.coalesce(F.lag(p_for).over(w), F.lit(0.0)), F.coalesce(F.lag(p_against).over(w), F.lit(0.0)))
    cost = F.lit(1.0) - chance
    if empty_net:
        cost = F.when(yes(F.col(empty_net)), 0.0).otherwise(cost)
    return df.withColumn("goal_penalty", cost).where(_is((goal,), s))


def reset_baseline(df: DataFrame, value: str, base: str, s: EventSchema = DEFAULT, resets=("faceoff",), terminals=TERMINATORS) -> DataFrame:
    """The value that an event is compared with: the baseline at a reset (first row, after a terminal, a faceoff, a new sequence), else the row before's."""
    w = s.window()
    prev = F.lag(F.struct(s.type, s.sequence, value)).over(w)
    d = df.withColumn("_p", prev)
    reset = F.col("_p").isNull() | yes(F.col(f"_p.{s.type}").isin(*terminals)) | _is(resets, s) | yes(F.col(f"_p.{s.sequence}") != F.col(s.sequence))
    return d.withColumns({"is_reset": reset.cast("int"), "baseline": F.when(reset, F.col(base)).otherwise(F.col(f"_p.{value}"))}).drop("_p")


def inject_and_stamp(df: DataFrame, after: str, made_type: str, neutral: dict[str, float], s: EventSchema = DEFAULT, step: float = 0.1) -> DataFrame:
    """A made row after each row of a type with neutral values, and on every row the type of the next one."""
    made = inject_after(df, F.col(s.type) == after, {s.type: F.lit(made_type)} | {c: F.lit(v) for c, v in neutral.items()}, s, step, step)
    return made.withColumn("next_type", F.lead(s.type).over(s.window()))


def predecessor_audit(df: DataFrame, type_: str, expected, s: EventSchema = DEFAULT) -> DataFrame:
    """Which types come before a type, and whether they are expected."""
    d = df.withColumn("prev_type", F.lag(s.type).over(s.window())).where(_is((type_,), s))
    return d.groupBy("prev_type").agg(F.count("*").alias("n")).withColumn("expected", yes(F.col("prev_type").isin(*expected)))


def gap_segments(df: DataFrame, s: EventSchema = DEFAULT, max_gap: float = 10.0, trim: bool = True) -> DataFrame:
    """Segments without a gap beyond the maximum; if the first break comes before the third row, the first two rows go."""
    w = s.window()
    d = df.withColumns({"_gap": yes(F.col(s.time) - F.lag(s.time).over(w) > max_gap).cast("int"), "_n": F.row_number().over(w)})
    d = d.withColumns({"segment": F.sum("_gap").over(w.rowsBetween(*UP_TO)), "_first": F.min(F.when(F.col("_gap") == 1, F.col("_n"))).over(Window.partitionBy(s.group))})
    if trim:
        d = d.where(~(yes(F.col("_first") == 3) & (F.col("_n") <= 2)))
    return d.drop("_gap", "_n", "_first")


def sliding_windows(df: DataFrame, by: list[str], order: list[str], size: int = 128, stride: int = 64, min_rows: int = 10) -> DataFrame:
    """Rows in overlapping chunks: ``chunk``, ``pos`` in it, and ``drop_prefix``: how many of its rows the chunk before has scored."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"_p": F.row_number().over(w.orderBy(*order)) - 1, "_len": F.count("*").over(w)}).where(F.col("_len") >= min_rows)
    last = F.ceil(F.greatest(F.col("_len") - size + stride, F.lit(1)) / stride) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - (size - 1)) / stride))
    high = F.least(F.floor(F.col("_p") / stride), last)
    d = d.withColumn("chunk", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return d.withColumns({"pos": F.col("_p") - F.col("chunk") * stride, "drop_prefix": F.when(F.col("chunk") > 0, size - stride).otherwise(0)}).drop("_p", "_len")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the last row in the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def strict_dedupe(df: DataFrame, s: EventSchema = DEFAULT, order: list[str] | None = None) -> DataFrame:
    """One row per normalised key (id to 6 places, time in milliseconds): the first."""
    key = [F.col(s.group), F.bround(F.col(s.id).cast("decimal(24,9)"), 6), F.bround(F.col(s.time) * 1000)]
    w = Window.partitionBy(*key).orderBy(*(order or s.order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def winner_and_sidecar(df: DataFrame, type_: str = "faceoff", s: EventSchema = DEFAULT, outcome: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """Of the faceoffs of a sequence the winner (successful, with a player, lowest id) stays; the others go to a sidecar with its id."""
    w = Window.partitionBy(s.group, s.period, s.sequence)
    won = yes(F.col(outcome) == "successful").cast("int").desc()
    order = [won, F.col(s.player).isNotNull().cast("int").desc(), F.col(s.id).asc()]
    f = df.where(_is((type_,), s)).withColumns({"_r": F.row_number().over(w.orderBy(*order)), "kept_id": F.first(s.id).over(w.orderBy(*order))})
    sidecar = f.where("_r > 1").drop("_r")
    kept = df.where(~_is((type_,), s)).unionByName(f.where("_r = 1").drop("_r", "kept_id"))
    return kept, sidecar


def insert_terminal_rows(df: DataFrame, s: EventSchema = DEFAULT, types=TERMINATORS, boundary: float = PERIOD_SECONDS, near: float = 1.0, made: tuple[str, str] = ("whistle", "end_of_period")) -> DataFrame:
    """An end row after the last row of each sequence that lacks one: end_of_period near the boundary, else a whistle."""
    last = df.withColumn("_r", F.row_number().over(s.in_sequence(descending=True))).where("_r = 1").drop("_r").where(~_is(types, s))
    kind = F.when(F.col(s.time) >= boundary - near, made[1]).otherwise(made[0])
    new = last.withColumns({s.type: kind, s.id: (F.col(s.id) + F.lit("0.1").cast("decimal(18,6)")).cast("decimal(18,6)"), s.team: F.lit(None).cast("string"), s.player: F.lit(None).cast("string")})
    return union_aligned(df.withColumn(s.id, F.col(s.id).cast("decimal(18,6)")), new)


def prior_type(df: DataFrame, s: EventSchema = DEFAULT, pad: str = "PAD") -> DataFrame:
    """The type before in the period; the first row of a period has the pad."""
    return df.withColumn("prior_type", F.coalesce(F.lag(s.type).over(s.in_period()), F.lit(pad)))


def normalise_boundary(df: DataFrame, s: EventSchema = DEFAULT, boundary: str = "end_of_period", to: str = "whistle") -> DataFrame:
    """W44."""
    return df.withColumn("is_boundary", _is((boundary,), s).cast("int")).withColumn(s.type, F.when(_is((boundary,), s), to).otherwise(F.col(s.type)))


def near_before(df: DataFrame, target: str, types, n: int = 4, s: EventSchema = DEFAULT) -> DataFrame:
    """Whether one of the n rows before a target row in its sequence is of the types."""
    seen = F.max(_is(types, s).cast("int")).over(s.in_sequence().rowsBetween(-n, -1))
    return df.withColumn("near", F.coalesce(seen, F.lit(0))).where(_is((target,), s))


