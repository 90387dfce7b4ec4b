"""Event operators against plain loops written from the rules, on random rows with missing teams and numbers, several sequences and hot groups."""

from __future__ import annotations

import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventry.operators import aggregates as A
from eventry.operators import gates as V
from eventry.operators import joins as J
from eventry.operators import learn as M
from eventry.operators import project as P
from eventry.operators import ranges as R
from eventry.operators import windows as W
from eventry.sources import tables as S

SCHEMA = "game string, period int, t double, id long, type string, team string, player string, x double, y double, raw double, dest_x double, dest_y double, seq long, pf double, pa double, base double"
KINDS = ["shot", "shot", "deflection", "deflection", "deflection", "defensive_deflection", "pass", "pass", "goal", "goal", "faceoff", "whistle", "reception", "reception", "penalty", "save", "stoppage", "period_start", None]


class Row(dict):
    __getattr__ = dict.__getitem__


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def random_events(seed, n=500):
    rng = random.Random(seed)
    maybe = lambda v: v if rng.random() < 0.8 else None
    rows, clock = [], 0.0
    for i in range(n):
        clock += rng.choice([0.0, 1.0, 3.0, 12.0])
        x = rng.choice([25.3, 25.5, 25.7, -25.4, -25.6, 0.0, 60.0, -70.0])
        rows.append(Row(zip(NAMES, (
            f"g{i % 3}", 1 + i // 250, clock, i, rng.choice(KINDS), rng.choice(["A", "B", "A", "B", None]), maybe("p"), x, float(rng.randint(-40, 40)), maybe(float(rng.randint(-3, 3))),
            maybe(float(rng.randint(-90, 90))), maybe(float(rng.randint(-40, 40))), (i // 30) if rng.random() < 0.95 else None, maybe(rng.randint(0, 9) / 10), maybe(rng.randint(0, 9) / 10), maybe(rng.randint(0, 9) / 10),
        ), strict=True)))
    return rows


@pytest.fixture(params=[11, 12])
def rows(request):
    return random_events(request.param)


@pytest.fixture()
def ev(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)


@pytest.fixture()
def hot(spark, monkeypatch):
    """A group of more than 20 rows and a tenth of all counts as hot and is cut into ranges."""
    monkeypatch.setattr(R, "SMALL_BYTES", 0)
    monkeypatch.setattr(R, "HOT_ROWS", 20)
    monkeypatch.setattr(R, "RANGES", 8)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def groups(rows, *keys):
    out = {}
    for r in sorted(rows, key=lambda r: (r.period, r.t, r.id)):
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def test_horizon_labels(ev, rows):
    want = {}
    for g in groups(rows, "game", "period").values():
        cap = min(max(r.t for r in g), 1200.0)
        for r in g:
            goals = [q for q in g if q.type == "goal" and q.t > r.t]
            nxt = min(goals, key=lambda q: (q.t, q.id), default=None)
            inside = nxt is not None and nxt.t <= min(r.t + 20.0, cap)
            want[r.id] = 2 if not inside or r.team is None else 0 if nxt.team == r.team else 1
    assert {r.id: r.target for r in W.horizon_label(ev).collect()} == want
    assert {*want.values()} == {0, 1, 2}


def test_reclassified_deflections(ev, rows):
    want, changed = {}, 0
    for g in groups(rows, "game", "seq").values():
        for k, r in enumerate(g):
            want[r.id] = r.type
            if r.type != "deflection":
                continue
            for q in reversed(g[max(0, k - 3) : k]):
                if q.type in W.RESETS:
                    break
                if q.type == "shot":
                    if None not in (q.team, r.team) and q.team != r.team:
                        want[r.id], changed = "defensive_deflection", changed + 1
                    break
    assert {r.id: r.type for r in W.reclassify(ev, "deflection", "defensive_deflection").collect()} == want and changed


def test_a_nearer_own_shot_stops_the_search_and_sequences_are_apart(spark):
    cols = "game string, seq long, period int, t double, id long, type string, team string"
    run = lambda rows: [r.type for r in W.reclassify(spark.createDataFrame(rows, cols), "deflection", "new").orderBy("id").collect()]
    assert run([("g", 1, 1, 1.0, 1, "shot", "B"), ("g", 1, 1, 2.0, 2, "shot", "A"), ("g", 1, 1, 3.0, 3, "deflection", "A")])[2] == "deflection"
    assert run([("g", 1, 1, 1.0, 1, "shot", "B"), ("g", 2, 1, 2.0, 2, "deflection", "A")])[1] == "deflection"
    assert run([("g", 1, 1, 1.0, 1, "shot", "B"), ("g", 1, 1, 2.0, 2, "pass", "A"), ("g", 1, 1, 3.0, 3, "deflection", "A")])[2] == "new"


def test_goal_flags(ev, rows):
    want = {}
    for g in groups(rows, "game").values():
        for r, q in zip(g, [*g[1:], None], strict=True):
            scored = q is not None and r.type in ("shot", "deflection") and q.type == "goal" and r.seq is not None and r.seq == q.seq and r.team is not None and r.team == q.team
            want[r.id] = r.type == "goal" or scored
    assert {r.id: r.is_goal for r in W.derive_flag(ev).collect()} == want


def test_duplicate_goals(ev, rows):
    gone = set()
    for (_, _, seq), g in groups(rows, "game", "period", "seq").items():
        for team in ("A", "B"):
            found = []
            for k, r in enumerate(g):
                if r.type == "goal" and r.team == team and seq is not None:
                    sources = [j for j in range(k) if g[j].team == team and g[j].type in ("shot", "deflection", "defensive_deflection")]
                    found.append((k - sources[-1] if sources else math.inf, k, r.id))
            gone |= {i for *_, i in sorted(found)[1:]}
    assert {r.id for r in W.keep_best_duplicate(ev).collect()} == {r.id for r in rows} - gone and gone


def test_only_sources_of_the_own_team_count_for_duplicate_goals(spark):
    rows = [("shot", "A"), ("pass", "A"), ("goal", "A"), ("shot", "B"), ("goal", "A")]
    df = spark.createDataFrame([("g", 1, 1, float(i), i, k, t) for i, (k, t) in enumerate(rows)], "game string, seq long, period int, t double, id long, type string, team string")
    assert sorted(r.id for r in W.keep_best_duplicate(df).collect()) == [0, 1, 2, 3]


def test_angles(ev, rows):
    want, aimed = {}, 0
    for g in groups(rows, "game", "period", "seq").values():
        for k, r in enumerate(g):
            if r.type not in ("shot", "deflection", "defensive_deflection") or k == 0:
                want[r.id] = None
                continue
            at = (g[k - 1].x, g[k - 1].y)
            if g[k - 1].type == "reception":
                for j in (k - 2, k - 3, k - 4):
                    if j >= 0 and g[j].type == "pass":
                        q = g[j]
                        at, aimed = ((q.dest_x, q.dest_y) if None not in (q.dest_x, q.dest_y) else (q.x, q.y)), aimed + 1
                        break
            turn = math.atan2(r.y, 89 - r.x) - math.atan2(at[1], 89 - at[0])
            want[r.id] = abs(math.atan2(math.sin(turn), math.cos(turn)))
    got = {r.id: r.angle_change for r in W.angle_change(ev).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items()) and aimed


def test_deltas(ev, rows):
    want = {}
    for g in groups(rows, "game").values():
        team = last = None
        for k, r in enumerate(g):
            now = r.team or team
            same = k > 0 and team is not None and now == team
            before = (0.0, 0.0) if last is None else (last.pf, last.pa) if same else (last.pa, last.pf)
            zero = r.type in ("goal", "whistle")
            want[r.id] = tuple(0.0 if zero else (a or 0.0) - (b or 0.0) for a, b in zip((r.pf, r.pa), before, strict=True))
            team, last = now, r
    got = {r.id: (r.delta_for, r.delta_against) for r in W.relative_delta(ev, "pf", "pa").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def plain_zone(x, raw):
    near = abs(abs(x) - 25.5) <= 0.25
    return "oz" if near and raw is not None and raw > 0 else "dz" if near and raw is not None and raw < 0 else "oz" if x > 25.5 else "dz" if x < -25.5 else "nz"


def test_next_zones_and_their_baselines(spark, ev, rows):
    base = {"oz": (0.5, 0.25), "dz": (0.25, 0.5), "nz": (0.125, 0.125)}
    b = spark.createDataFrame([(z, *v) for z, v in base.items()], "zone string, base_for double, base_against double")
    got = {r.id: (r.zone, r.pf, r.pa, r.base) for r in W.stamp_next_zone(ev, b, raw="raw", probs=("pf", "pa", "base")).collect()}
    for g in groups(rows, "game").values():
        for k, r in enumerate(g):
            nxt = next((q for q in g[k + 1 :] if q.type == "faceoff"), None)
            zone = plain_zone(nxt.x, nxt.raw) if nxt else "nz"
            if r.type == "whistle":
                f, a = base[zone]
                assert got[r.id] == (zone, f, a, 1.0 - f - a)
            else:
                assert got[r.id] == (None, r.pf, r.pa, r.base)


def test_saves(ev, rows):
    got = {r.id: (r.save_reason, r.save_credit) for r in W.save_credit(ev, "pf", "pa", "base").collect()}
    want = {}
    for g in groups(rows, "game").values():
        for r, q in zip(g, [*g[1:], None], strict=True):
            if r.type == "save":
                whistle = q is not None and q.type == "whistle"
                known = whistle and q.base is not None
                want[r.id] = ("save_with_freeze_credit" if known else "save_with_whistle_no_baseline" if whistle else "save_play_continued", (r.pf or 0.0) + (max(0.0, (r.pa or 0.0) - q.base) if known else 0.0))
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1]) for k, v in want.items())


def test_offsetting(ev, rows):
    want = {}
    for game in ("g0", "g1", "g2"):
        g = sorted((r for r in rows if r.game == game and r.type == "goal"), key=lambda r: r.id)
        for k, r in enumerate(g):
            want[r.id] = any(0 <= j < len(g) and abs(g[j].id - r.id) <= 30 and g[j].team != r.team for j in (k - 1, k + 1))
    assert {r.id: r.is_offsetting for r in W.flag_offsetting(ev, "goal", 30).collect()} == want and {*want.values()} == {True, False}


def test_penalty_takers(ev, rows):
    e = ev.withColumnsRenamed({"pf": "delta_for", "pa": "delta_against"})
    got = {r.id: (r.adj_for, r.adj_against, r.adj_net) for r in P.adjust_penalty_taker(e).collect()}
    for r in rows:
        f, a = (r.pf or 0.0) + 0.02 if r.type == "penalty" else r.pf, (r.pa or 0.0) + 0.2 if r.type == "penalty" else r.pa
        net = None if None in (f, a) else f - a
        assert all((x is None) == (y is None) and (y is None or x == pytest.approx(y)) for x, y in zip(got[r.id], (f, a, net), strict=True))


def test_inverse_rows(spark):
    base = spark.createDataFrame([("g", 1, 0.5, 1, "penalty"), ("g", 1, 9.0, 2, "penalty"), ("g", 2, -0.25, 1, "penalty"), ("g", 3, None, 1, "penalty"), ("g", 4, 0.0, 1, "penalty"), ("g", 5, 1.0, 1, "pass")], "game string, id long, net double, n int, type string")
    side = spark.createDataFrame([("g", 10, 1), ("g", 11, 2), ("g", 12, 3), ("g", 13, 4), ("g", 14, 99), ("g", 15, 1), ("h", 16, 1), ("g", 17, None), ("g", 18, 5)], "game string, id long, kept long")
    got = {r.id: (r.net, r.adj_for, r.adj_against) for r in J.inverse_rows(base, side, ["game"], "kept", "net", "s", base_type="penalty", order=["n"]).collect()}
    assert got == {10: (-0.5, 0.0, 0.5), 15: (-0.5, 0.0, 0.5), 11: (0.25, 0.25, 0.0), 13: (0.0, 0.0, 0.0)}


# ---- hot groups

def test_hot_groups_are_cut_into_even_ranges(spark, hot):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else f"g{rng.randrange(40)}", float(rng.randrange(10_000)), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, t double, id long")
    got = R.deal(df, ["g"], ["t", "id"]).groupBy("g", "_cell").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
    cells = sorted((r for r in got if r.g == "hot"), key=lambda r: r._cell)
    assert len(cells) == 8 and all(a.b <= b.a for a, b in zip(cells, cells[1:], strict=False))
    assert max(r.n for r in cells) <= 2 * statistics.median(r.n for r in cells)
    assert {r._cell for r in got if r.g != "hot"} == {0}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_joins_of_a_hot_group_equal_a_loop(spark, hot, direction, strict):
    rng = random.Random(7)
    key = lambda: rng.choice([None, "a", "b"]) if rng.random() < 0.1 else "hot"
    left = [(key(), float(rng.randrange(900)), i) for i in range(500)]
    right = [(key(), float(rng.randrange(900)) if rng.random() < 0.95 else 3.0, i) for i in range(150)]
    ls, rs = spark.createDataFrame(left, "g string, t double, id long"), spark.createDataFrame(right, "g string, t double, rid long")
    got = {r.id: r.match and (r.match.t, r.match.rid) for r in J.asof(ls, rs, ["g"], "t", "t", ["rid"], direction, strict, tie="rid").collect()}
    for g, t, i in left:
        ok = (lambda q: q < t if strict else q <= t) if direction == "backward" else (lambda q: q > t if strict else q >= t)
        near = [(q, k) for h, q, k in right if h == g and ok(q)]
        assert got[i] == ((max(near) if direction == "backward" else min(near)) if near else None)


def test_other_asof_operators_of_hot_groups_equal_the_plain_plan(spark, monkeypatch):
    ev = spark.createDataFrame([tuple(r.values()) for r in random_events(21, 300)], SCHEMA).repartition(5)
    right = ev.where("type = 'faceoff'").select("game", "t", F.col("id").alias("rid"))
    goals = ev.where("type = 'goal'").select("game", "t", "id")

    def runs():
        return [
            J.asof_nearest(goals, right, ["game"], "t", "t", ["rid"], tie="rid"), J.next_payload(ev, ["goal"], ["game", "period"], "t", ["team"]),
            J.attach_destination(ev, ["game"], ["period", "t", "id"], ["pass"], ["reception"], ["x", "y"]), J.attach_destination(ev, ["game"], ["period", "t", "id"], ["pass"], ["reception"], ["x"], None, "last", "player"),
            J.first_in_range(goals, right, ["game"], "t", 0, 9, ["rid"], tie="rid"), W.horizon_label(ev), W.link_latest(ev, ["shot"], ["goal"]),
            W.transition_features(ev), W.disorder_count(ev), W.cut_after_terminator(ev, keep=F.col("type") == "faceoff"), W.cut_after_types(ev, {"goal": None, "whistle": F.col("type") == "goal"}),
            W.cut_after_first(ev.where("type <> 'goal' OR id % 4 = 0"), "goal"), W.drop_windows(ev, "faceoff", "whistle"), W.drop_false_starts(ev), W.derive_flag(ev),
        ]

    plain = [sorted(map(repr, df.collect())) for df in runs()]
    monkeypatch.setattr(R, "SMALL_BYTES", 0)
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    monkeypatch.setattr(R, "RANGES", 6)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert R.deal(ev, ["game"], ["t", "id"]).select("_cell").distinct().count() == 6
        assert [sorted(map(repr, df.collect())) for df in runs()] == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_links_of_one_sequence_over_many_ranges_equal_a_loop(spark, hot):
    rng = random.Random(8)
    rows = [("g", 1, 1, float(i // 2), i, rng.choice(["shot", "shot", "goal", "goal", "pass"])) for i in range(900)]
    df = spark.createDataFrame(rows, "game string, seq long, period int, t double, id long, type string")
    assert R.deal(df, ["game", "seq"], ["period", "t", "id"]).select("_cell").distinct().count() == 8
    open_, want = [], {}
    for r in rows:
        if r[5] == "shot":
            open_.append(r[4])
        want[r[4]] = open_.pop() if r[5] == "goal" and open_ else None
    assert {r.id: r.source_id for r in W.link_latest(df, ["shot"], ["goal"]).collect()} == want


# ---- slots, contracts, counts, allocation, order, clustered tables

def test_slots_stream_across_batches(spark):
    rng = random.Random(9)
    rows = [(g, s, f"m{rng.randint(0, 11)}", rng.choice([None, *map(float, range(5))])) for g in ("x", "y", None) for s in range(25) for _ in range(rng.randint(0, 9))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = W.persistent_slots(spark.createDataFrame(rows, "g string, step int, m string, d double"), ["g"], "step", "m", "d", 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.g, r.step, r.m): (r.slot, r.is_consistent, r.is_new_to_stint) for r in out}
    want = {}
    for g in ("x", "y", None):
        slots, before = [None] * 4, set()
        for s in sorted({r[1] for r in rows if r[0] == g}):
            near = {}
            for gg, ss, m, d in rows:
                if (gg, ss) == (g, s):
                    near[m] = min(near.get(m, math.inf), math.inf if d is None else d)
            slots = [m if m in near else None for m in slots]
            free = [k for k, m in enumerate(slots) if m is None]
            for m, k in zip(sorted((m for m in near if m not in slots), key=lambda m: (near[m], m)), free, strict=False):
                slots[k] = m
            for m in near:
                want[g, s, m] = (slots.index(m) if m in slots else -1, int(m in before), int(m not in before))
            before = {*near}
    assert len(out) == len(got) and got == want


def test_contracts_are_part_of_the_plan(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    twice, t = a.union(a.where("k = 2")), spark.createDataFrame([(1,), (2,)], "k long")
    assert sorted(map(tuple, J.align_keys(a, t, ["k"]).collect())) == [(1, "x"), (2, "y")]
    assert J.attach_source(t.union(t), a, ["k"]).count() == 4
    lazy = [J.align_keys(twice, t, ["k"]), J.align_keys(a, t.union(spark.createDataFrame([(9,)], "k long")), ["k"]), J.attach_source(t, twice, ["k"]), J.attach_source(t.union(spark.createDataFrame([(9,)], "k long")), a, ["k"])]
    for df, why in zip(lazy, ("a key is doubled", "a key is missing", "source keys are doubled", "a prediction has no source row"), strict=True):
        for act in (df.collect, df.count):
            with pytest.raises(Exception, match=why):
                act()


def test_steps_are_counted_in_one_pass(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")
    plans = []

    def sink(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(f"{tmp_path}/out")

    got = V.step_counts(spark.read.parquet(f"{tmp_path}/in"), {"even": lambda df: df.where("id % 2 = 0"), "few": lambda df: df.where("id < 10")}, sink)
    assert sorted(map(tuple, got.collect())) == [(0, "raw", 100, None, 0), (1, "even", 50, 100, 50), (2, "few", 5, 50, 45)]
    assert plans[0].count("FileScan") == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_allocation_makes_no_row_per_unit(spark, hot):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(60):
        sides = {f"s{k:02}": rng.randint(-2, 6) for k in range(rng.randint(1, 9) if g else 60)}
        units = rng.randint(0, 25 if g else 150)
        left, given = dict(sides), dict.fromkeys(sides, 0)
        for _ in range(units):
            s = max(sorted(left), key=lambda k: left[k])
            if left[s] <= 0:
                break
            left[s] -= 1
            given[s] += 1
        rows += [(str(g), s, d, units) for s, d in sides.items()]
        want |= {(str(g), s): n for s, n in given.items()}
    df = spark.createDataFrame(rows, "game string, team string, deficit int, units int")
    assert {(r.game, r.team): r.allocated for r in A.allocate_units(df, "game", "deficit", "units", "team").collect()} == want
    big = spark.createDataFrame([("g", "a", 3 * 10**9, 5 * 10**9 + 1), ("g", "b", 4 * 10**9, 5 * 10**9 + 1), (None, "c", 7, None)], "game string, team string, deficit long, units long")
    assert {r.team: r.allocated for r in A.allocate_units(big, "game", "deficit", "units", "team").collect()} == {"a": 2 * 10**9 + 1, "b": 3 * 10**9, "c": 0}


def test_ingest_order_does_not_depend_on_the_split(spark, tmp_path):
    for k in range(3):
        spark.range(k * 4000, (k + 1) * 4000).coalesce(1).selectExpr("id", "id * 7 % 13 AS v").write.option("parquet.block.size", 8192).mode("append").parquet(f"{tmp_path}/e")
    def order():
        return [r.id for r in S.scan_events(spark, f"{tmp_path}/e", ["id"]).orderBy("ingest_order").select("id").collect()]

    whole = order()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert S.scan_events(spark, f"{tmp_path}/e", ["id"]).rdd.getNumPartitions() > 3 and order() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(whole) == list(range(12_000)) and sum(b != a + 1 for a, b in zip(whole, whole[1:], strict=False)) <= 2


def test_windows_over_a_clustered_table_need_no_exchange(spark, ev, tmp_path):
    t = S.sink_clustered(ev, "clustered_events", f"{tmp_path}/t", ["game"], ["period", "t", "id"], 4)
    out = W.eos_flag(W.changed_flag(t, "player"))
    assert out.count() == ev.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Window") >= 2
    cols = ["id", "player_changed", "is_eos"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, W.eos_flag(W.changed_flag(ev, "player")).select(*cols).collect()))
    spark.sql("DROP TABLE clustered_events")


def test_medians_and_top_shares(spark):
    rng = random.Random(2)
    values = [rng.choice([None, float("nan"), float("inf"), *map(float, range(9))]) for _ in range(201)]
    known = statistics.median(v for v in values if v is not None and math.isfinite(v))
    got = P.sanitize_numeric(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], "median").collect()
    assert sorted(r.v for r in got) == sorted(v if v is not None and math.isfinite(v) else known for v in values)
    df = spark.createDataFrame([(i, i / 1000, int(i % 3 == 0)) for i in range(1000)], "id long, s double, y int")
    for share, k in ((0.0125, 13), (0.0005, 1), (0.001, 1), (0.3, 300)):
        r = A.top_share_pr(df, F.col("y"), "s", "id", share).first()
        assert r.k == k and r.hits == sum(i % 3 == 0 for i in range(1000 - k, 1000))
    assert A.top_share_pr(df.limit(0), F.col("y"), "s", "id").first().k == 0


def plain_fit(x, y, c):
    """Weights of a multinomial ridge fit, by Newton steps on one table."""
    k, w = int(y.max()) + 1, x.shape[1]
    beta, hot, keep = np.zeros((k, w)), np.eye(k)[y], np.ones((k, w))
    keep[:, 0] = 0
    for _ in range(200):
        e = np.exp(x @ beta.T - (x @ beta.T).max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        grad = c * (p - hot).T @ x + keep * beta
        hess = np.diag(keep.ravel() + 1e-12)
        for i in range(k):
            for j in range(k):
                hess[i * w : (i + 1) * w, j * w : (j + 1) * w] += c * x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
        beta = beta - 0.5 * np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(k, w)
    return beta


def test_all_folds_equal_a_plain_fit_of_each(spark):
    rng = np.random.default_rng(3)
    n = 240
    a, b, cat, fold = rng.normal(3, 5, n), rng.normal(0, 1, n), rng.choice(["u", "v", "only-in-0", "NA"], n), rng.integers(0, 3, n)
    cat = np.where((cat == "only-in-0") & (fold != 0), "u", cat)
    y = np.clip(np.round(0.2 * (a - 3) + b + (cat == "u") + rng.normal(0, 0.7, n) + 0.7), 0, 2).astype(int)
    miss = rng.random(n) < 0.1
    rows = [(i, None if miss[i] else float(a[i]), float(b[i]), 4.0, None if cat[i] == "NA" else str(cat[i]), int(y[i]), int(fold[i])) for i in range(n)]
    cols = "id long, a double, b double, same double, c string, y int, fold int"
    df = spark.createDataFrame([*rows, (900, 1.0, 1.0, 4.0, "u", None, 1), (901, 1.0, 1.0, 4.0, "u", 1, None)], cols).repartition(5)
    got = {r.id: r.p for r in M.fit_oof(df, ["a", "b", "same"], ["c"], "y", "fold", ["id"], 0.7, 3).collect()}
    assert {*got} == {*range(n), 900}
    raw = np.column_stack([np.where(miss, 0.0, a), b, np.full(n, 4.0)])
    for f in range(3):
        train, test = fold != f, fold == f
        mean, sd = raw[train].mean(axis=0), raw[train].std(axis=0)
        levels = sorted({*cat[train]})
        x = np.hstack([np.ones((n, 1)), (raw - mean) / np.where(sd > 0, sd, 1), np.array(levels) == cat[:, None]])
        beta = plain_fit(x[train], y[train], 0.7)
        e = np.exp(x[test] @ beta.T)
        want = e / e.sum(axis=1, keepdims=True)
        assert np.abs(np.array([got[i] for i in np.flatnonzero(test)]) - want).max() < 1e-6


def test_sketches_of_parts_merge_to_the_whole(spark):
    rng = random.Random(4)
    rows = [(i % 5, rng.gauss(0, 1), rng.randrange(4000)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "part int, v double, k long")
    whole = A.quantile_sketches(df, ["part"], ["v"])
    for q in (0.1, 0.5, 0.99):
        x = A.merged_quantiles(whole, ["v"], q).first().v
        assert abs(sum(v <= x for _, v, _ in rows) / len(rows) - q) < 0.03
    halves = A.distinct_sketches(df.where("part < 2"), ["part"], ["k"]).union(A.distinct_sketches(df.where("part >= 2"), ["part"], ["k"]))
    exact = len({k for *_, k in rows})
    assert abs(A.merged_distinct(halves, ["k"]).first().n_k - exact) <= 0.03 * exact


def test_frequent_words_and_their_summaries(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60))) for _ in range(400)]
    counts: dict = {}
    for w in " ".join(texts).split():
        counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " \n "]], "t string").repartition(6)
    assert {r.word: r.n for r in A.frequent_words(df, F.col("t"), 0.05).collect()} == {w: n for w, n in counts.items() if n >= 0.05 * total}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        one, other = df.where("t < 'the'"), df.where("t >= 'the'")
        both = A.word_summary(one, F.col("t"), 40).union(A.word_summary(other, F.col("t"), 40)).groupBy("word").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {r.word: r.n for r in both}
    off = found.pop(None)
    assert 0 < off <= total / 40 and all(counts[w] - off <= n <= counts[w] for w, n in found.items()) and {"the", "of", "a"} <= {*found}
    assert A.frequent_words(df.limit(0), F.col("t")).count() == 0


def test_frequent_words_read_the_texts_twice_and_count_in_tasks(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "of", "zo\u00eb\u00a0x", "a\u2028b\x1cc"]) if rng.random() < 0.3 else f"w{rng.randrange(10**9)}" for _ in range(400)) for _ in range(1500)]
    texts += ["\t of\x0bthe\fthe\r\n ", "", None, "long " * 850_000]  # the last one is over 4 MB
    counts: dict = {}
    for w in re.split(r"[ \t\n\x0b\f\r]+", " ".join(t or "" for t in texts)):
        if w:
            counts[w] = counts.get(w, 0) + 1
    total, read = sum(counts.values()), spark.sparkContext.accumulator(0)
    assert len(counts) > 400_000  # more than a task holds

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2).mapInArrow(seen, "t string")
    assert {r.word: r.n for r in A.frequent_words(df, F.col("t"), 0.02).collect()} == {w: n for w, n in counts.items() if n >= 0.02 * total}
    assert read.value == 2 * len(texts)


def test_parity_by_digests_equals_the_full_join(spark):
    rng = random.Random(1)
    a = [(rng.choice(["g", "h", None]), rng.randrange(400)) for _ in range(500)]
    b = [r for r in a if rng.random() < 0.95] + [("g", 1000 + i) for i in range(9)]
    df = lambda rows: spark.createDataFrame(rows, "game string, id long")
    got = {r.game: (r.n_both, r.n_left_only, r.n_right_only) for r in J.key_parity(df(a), df(b), ["game", "id"], "game").collect()}
    of = lambda keys, g: sum(k[0] == g for k in keys)
    assert got == {g: (of({*a} & {*b}, g), of({*a} - {*b}, g), of({*b} - {*a}, g)) for g in ("g", "h", None)}
    assert J.unequal_buckets(df(a), df(a).repartition(3), ["game", "id"], []).count() == 0
    raw = spark.createDataFrame([(i, float(i)) for i in range(300)], "id long, p double")
    changed = raw.withColumn("p", F.when(F.col("id").isin(7, 8), 0.5).otherwise(F.col("p"))).where("id <> 9")
    assert {r.check: r.n for r in V.check_immutable(raw, changed, ["id"], ["p"]).collect()} == {"changed": 2, "lone_keys": 1, "fewer_rows": 0}
    assert all(r.passed for r in V.check_immutable(raw, raw, ["id"], ["p"]).collect())
