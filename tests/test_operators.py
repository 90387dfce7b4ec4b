"""Operators against plain loops on random sequences, and the odd inputs that SQL over the given tables doesn't have."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventry.functions import scalars as C
from eventry.operators import aggregates as A
from eventry.operators import gates as V
from eventry.operators import joins as J
from eventry.operators import learn as M
from eventry.operators import project as P
from eventry.operators import ranges as R
from eventry.operators import windows as W
from eventry.sources import tables as S

EVENTS = "game string, period int, t double, id long, type string, team string, player string, x double, y double, seq long, outcome string"
TYPES = ["shot", "pass", "goal", "faceoff", "whistle", "reception"]


def sequence(seed, n=120):
    rng = random.Random(seed)
    rows, clock = [], 0.0
    for i in range(n):
        clock += rng.choice([0.0, 1.0, 3.0, 12.0])
        rows.append((f"g{i % 3}", 1 + i // 60, clock, i, rng.choice(TYPES), rng.choice(["A", "B", None]), rng.choice(["p1", "p2", None]), float(rng.randint(-90, 90)), float(rng.randint(-40, 40)), i // 12, rng.choice(["failed", "successful"])))
    return rows


@pytest.fixture(params=[1, 2])
def rows(request):
    return sequence(request.param)


@pytest.fixture()
def ev(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def by_game(rows, *extra):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        out.setdefault((r[0], *(r[k] for k in extra)), []).append(r)
    return out


def test_lifo_links_equal_a_loop(ev, rows):
    want = {}
    for g in by_game(rows, 9).values():
        open_ = []
        for r in g:
            if r[4] == "shot":
                open_.append(r[3])
            elif r[4] == "goal":
                want[r[3]] = open_.pop() if open_ else None
    got = {r.id: r.source_id for r in W.link_latest(ev, ["shot"], ["goal"]).where("type = 'goal'").collect()}
    assert got == want


def test_next_payload_equals_a_loop(ev, rows):
    got = {r.id: r._next and (r._next.t, r._next.id) for r in J.next_payload(ev, ["goal"], ["game", "period"], "t", ["team"]).collect()}
    for g in by_game(rows, 1).values():
        for r in g:
            later = [(q[2], q[3]) for q in g if q[4] == "goal" and q[2] > r[2]]
            assert got[r[3]] == min(later, default=None)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_a_loop(ev, rows, direction, strict):
    right = ev.where("type = 'faceoff'").select("game", "t", F.col("id").alias("rid"))
    got = J.asof(ev.where("type = 'goal'").select("game", "t", "id"), right, ["game"], "t", "t", ["rid"], direction, strict, tie="rid").collect()
    for r in got:
        ok = (lambda q: q < r.t if strict else q <= r.t) if direction == "backward" else (lambda q: q > r.t if strict else q >= r.t)
        near = [(q[2], q[3]) for q in rows if q[0] == r.game and q[4] == "faceoff" and ok(q[2])]
        want = (max(near) if direction == "backward" else min(near)) if near else None
        assert (r.match and (r.match.t, r.match.rid)) == want


def test_asof_nearest_prefers_backward_on_ties_and_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 5.0, 1), ("a", 5.0, 2), ("b", 1.0, 3)], "g string, t double, id long")
    right = spark.createDataFrame([(None, 4.0, 10), ("a", 4.0, 11), ("a", 6.0, 12)], "g string, t double, rid long")
    got = {r.id: r.match and r.match.rid for r in J.asof_nearest(left, right, ["g"], "t", "t", ["rid"], tie="rid").collect()}
    assert got == {1: 10, 2: 11, 3: None}


def test_allocation_equals_the_greedy_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(40):
        deficits, units = {t: rng.randint(-1, 4) for t in ("home", "visitor")}, rng.randint(0, 9)
        rows += [(str(g), t, d, units) for t, d in deficits.items()]
        left, given = dict(deficits), dict.fromkeys(deficits, 0)
        for _ in range(units):
            t = max(sorted(left), key=lambda k: left[k])
            if left[t] <= 0:
                break
            left[t] -= 1
            given[t] += 1
        want |= {(str(g), t): n for t, n in given.items()}
    df = spark.createDataFrame(rows, "game string, team string, deficit int, units int")
    assert {(r.game, r.team): r.allocated for r in A.allocate_units(df, "game", "deficit", "units", "team").collect()} == want


@pytest.mark.parametrize("n", [0, 1, 9, 10, 32, 33, 100])
def test_windows_score_every_row_once(spark, n):
    df = spark.createDataFrame([("g", i) for i in range(n)], "game string, id long")
    got = W.sliding_windows(df, ["game"], ["id"], 32, 16, 10).collect()
    chunks = {}
    for r in got:
        chunks.setdefault(r.chunk, []).append(r)
    starts = list(range(0, max(n - 32 + 16, 1), 16)) if n >= 10 else []
    assert sorted(chunks) == list(range(len(starts)))
    for k, s in enumerate(starts):
        assert sorted(r.id for r in chunks[k]) == list(range(s, min(s + 32, n)))
    assert sorted(r.id for r in got if r.pos >= r.drop_prefix) == (list(range(n)) if n >= 10 else [])


def test_penalty_windows_equal_a_loop(ev, rows):
    want = set()
    for g in by_game(rows).values():
        open_ = None
        for r in g:
            if r[4] == "goal":
                open_ = r[9]
            elif open_ is not None and r[4] == "faceoff" and r[9] != open_:
                open_ = None
            if open_ is None:
                want.add(r[3])
    assert {r.id for r in W.drop_windows(ev, "goal", "faceoff").collect()} == want


def test_slots_persist(spark):
    rows = [("g", "t", 1, m, d) for m, d in (("a", 3.0), ("b", 1.0), ("c", 2.0))] + [("g", "t", 2, m, d) for m, d in (("b", 9.0), ("d", 1.0), ("a", 5.0))] + [("g", "t", 3, m, 1.0) for m in "abcde"]
    df = spark.createDataFrame(rows, "game string, team string, step int, player string, dist double")
    got = {(r.step, r.player): r.slot for r in W.persistent_slots(df, ["game", "team"], "step", "player", "dist", n=3).collect()}
    assert [got[1, p] for p in "bca"] == [0, 1, 2]
    assert (got[2, "b"], got[2, "d"], got[2, "a"]) == (0, 1, 2)
    assert (got[3, "a"], got[3, "b"], got[3, "d"]) == (2, 0, 1) and got[3, "c"] == got[3, "e"] == -1


def test_gap_segments_trim_the_first_two_rows(spark):
    df = spark.createDataFrame([("g", 1, t, i) for i, t in enumerate([0.0, 1.0, 30.0, 31.0, 60.0])], "game string, period int, t double, id long")
    assert [(r.id, r.segment) for r in W.gap_segments(df).orderBy("id").collect()] == [(2, 1), (3, 1), (4, 2)]


def test_canonical_order_depends_on_any_disorder(spark):
    ordered = [("g", 1, 1.0, 0, 0), ("g", 1, 2.0, 1, 0), ("h", 1, 5.0, 2, 0), ("h", 1, 4.5, 3, 0)]
    cols = "game string, period int, t double, id long, seq long"
    n = lambda rows: {r.id: r.game_event_id for r in W.canonical_order(spark.createDataFrame(rows, cols), "id").collect()}
    assert n(ordered) == {0: 1, 1: 2, 2: 1, 3: 2}
    assert n([*ordered, ("k", 1, 9.0, 4, 0), ("k", 1, 2.0, 5, 0)])[3] == 1


def test_ids_of_injected_rows_are_exact_and_clashes_are_found(ev):
    made = W.inject_after(ev, F.col("type") == "shot", {"type": F.lit("save")})
    ids = {r.id for r in made.where("is_synthetic = 1").collect()}
    assert all(i % 1 == Decimal("0.5") for i in ids)
    assert V.duplicate_keys(made, ["game", "id"]).first().passed
    twice = W.inject_after(made.drop("is_synthetic"), F.col("type") == "shot", {"type": F.lit("save")})
    assert not V.duplicate_keys(twice, ["game", "id"]).first().passed


def test_conservation_and_ledger(spark, ev):
    base = ev.withColumn("net", F.col("x") / 100)
    side = base.where("type = 'pass'").select("game", F.col("id").alias("kept"), (F.col("id") + 1000).alias("id"))
    inverse = J.inverse_rows(base, side, ["game"], "kept", "net", "loser")
    assert V.check_conservation(base, inverse, ["game"], "kept", "net").first().passed
    assert not V.check_conservation(base, inverse.withColumn("net", F.col("net") + 0.1), ["game"], "kept", "net").first().passed
    e = ev.withColumns({"delta_for": F.col("x"), "delta_against": F.col("y")})
    once = P.adjust_penalty_taker(e, penalty="goal")
    again = P.adjust_penalty_taker(once, penalty="goal")
    assert once.exceptAll(again).count() == 0
    assert V.check_ledger(P.player_ledger(once, ["game", "id"])).first().passed


def test_null_types_and_times(spark):
    df = spark.createDataFrame([("g", 4, None, None), ("g", 4, 299.0, "shot"), ("g", 4, 300.0, "shot"), ("g", 3, 900.0, None), (None, None, 1.0, "x")], "game string, period int, t double, type string")
    assert P.filter_time_boundary(df).count() == 2
    assert P.drop_types(df, ["shot"]).count() == 3
    kept, extra = P.split_noise(df, F.col("type") == "shot", F.col("t") > 299)
    assert (kept.count(), extra.count()) == (3, 1)


def test_numbers_are_sanitised(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("NaN",), ("Infinity",), ("3",)], "v string")
    assert sorted(r.v for r in P.sanitize_numeric(df, ["v"], "median").collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]
    assert sorted(r.v for r in P.sanitize_numeric(df, ["v"]).collect()) == [0.0, 0.0, 0.0, 0.0, 1.0, 3.0]


def test_texts(spark):
    df = spark.createDataFrame([("[Shot Flags: A-b]; a b | with goal / x*",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(C.filter_tokens(C.tokenize_flags(F.col("v")))).collect()]
    assert got == ["a b", None, None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.rewrite_text(F.lit("lpr in dz missed pass"))) == "loose puck recovery in defensive zone   pass"
    assert one(C.strip_leaks(F.lit("shot On Net  with goal"))) == "shot"
    assert one(C.join_texts(F.lit(None).cast("string"), F.lit("b"))) == "b" and one(C.join_texts(F.lit(""), F.lit(None).cast("string"))) is None
    assert [one(C.to_seconds(F.lit(v))) for v in ("12:34", "7.5", "x", "1:2:3")] == [754.0, 7.5, None, None]
    assert [one(C.classify_text(F.lit(v))) for v in ("Double Minor", "game misconduct", "minor", "")] == ["double_minor", "misconduct", "minor", "other"]
    assert one(C.parse_bool(F.lit("no"), F.lit(" YES "))) is True and one(C.match_role(F.lit("g"))) is True and one(C.match_role(F.lit("RW"))) is False
    assert [one(C.band(F.lit(v))) for v in (-4.0, 20.0, 80.0)] == ["center", "near", "far"]
    assert one(F.array(*C.normalize_probs([F.lit(0.0), F.lit(None).cast("double")]))) == [0.5, 0.5]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "id long, k string, v array<double>")
    S.sink_parquet(df, f"{tmp_path}/p", ["k"])
    assert S.scan_parquet(spark, f"{tmp_path}/p", ["id"]).count() == 2
    S.sink_csv(df.select("id", "k"), f"{tmp_path}/c")
    assert S.scan_csv(spark, f"{tmp_path}/c", "id long, k string").where("k = 'b'").first().id == 2
    S.sink_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    S.sink_vectors(df, ["id"], "v", f"{tmp_path}/v")
    assert dict(spark.read.parquet(f"{tmp_path}/v").dtypes)["v"] == "array<float>"
    for _ in range(2):
        S.append_manifest(df, "one", f"{tmp_path}/p", f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
    with pytest.raises(ValueError):
        S.scan_events(spark, f"{tmp_path}/p", ["absent"])


def test_contracts_raise(spark, ev):
    with pytest.raises(ValueError):
        P.project_contract(ev, ["game", "absent"])
    with pytest.raises(ValueError):
        P.project_contract(ev, ["game", "game"])


def test_folds_are_balanced_and_models_predict(spark):
    groups = spark.createDataFrame([(str(i), "a" if i % 4 else "b") for i in range(40)], "game string, stratum string")
    got = M.stratified_group_folds(groups, "game", "stratum").toPandas()
    assert got.groupby(["stratum", "fold"]).size().groupby("stratum").agg(lambda s: s.max() - s.min()).max() <= 1
    df = spark.createDataFrame([(i, float(i % 2) + (i % 7) / 50, "u" if i % 3 else None, i % 2, i % 3) for i in range(90)], "id long, v double, c string, y int, fold int")
    p = M.fit_oof(df, ["v"], ["c"], "y", "fold", ["id"], folds=3).toPandas()
    assert len(p) == 90 and (p.p.str[1].gt(0.5) == (p.y == 1)).mean() > 0.95


def test_average_precision_of_ties_and_no_positives(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (None, 1)], "s double, y int")
    assert A.average_precision(df, F.col("y"), "s").first().average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert A.average_precision(df.withColumn("y", F.lit(0)), F.col("y"), "s").first().average_precision is None


def test_registered_queries_have_sql_or_tests():
    import __spark_entry__ as entry
    from eventry.plans import queries

    assert {*queries.ORACLES} <= {*queries.QUERIES} <= {*entry.queries()}
    assert {*queries.QUERIES} - {*queries.ORACLES} == {"w25_persistent_slots", "m11_fit_oof"}


def test_running_sums_and_numbers_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50), "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, k string").repartition(7)
    got = {r.id: r.no for r in R.number_rows(df, [F.desc("v"), "id"], "no", 5).collect()}
    assert got == {r[0]: i + 5 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    sums = {r.id: r.s for r in R.cumulate(df, ["v", "id"], {"s": F.col("v")}).collect()}
    total = 0
    for i, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        assert sums[i] == total
    q = {r.key: (r.q0, r.q1) for r in R.quantiles(df.selectExpr("k AS key", "CASE WHEN v < 45 THEN v END AS value"), (0.5, 0.9)).collect()}
    for k in "ab":
        assert q[k] == pytest.approx(tuple(np.quantile([v for _, v, x in rows if x == k and v < 45], [0.5, 0.9])))
    assert R.number_rows(df.limit(0), ["id"], "no").count() == 0 and R.quantiles(df.limit(0).selectExpr("k AS key", "v AS value"), (0.5,)).count() == 0
    assert A.fill_stats(df.limit(0), ["v"]).first().v is None


def test_slots_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(g, s, f"m{rng.randint(0, 9)}", float(rng.randint(0, 5))) for g in ("x", "y") for s in range(12) for _ in range(rng.randint(0, 9))]
    got = {(r.g, r.step, r.m): r.slot for r in W.persistent_slots(spark.createDataFrame(rows, "g string, step int, m string, d double"), ["g"], "step", "m", "d", 4).collect()}
    want = {}
    for g in ("x", "y"):
        slots = {}
        for s in sorted({r[1] for r in rows if r[0] == g}):
            here = list(dict.fromkeys(m for _, m in sorted((d, m) for gg, ss, m, d in rows if (gg, ss) == (g, s))))
            slots = {m: k for m, k in slots.items() if m in here}
            for m in here:
                free = [k for k in range(4) if k not in slots.values()]
                if m not in slots and free:
                    slots[m] = free[0]
                want[g, s, m] = slots.get(m, -1)
    assert got == want


def test_gates_tell_sums_counts_and_columns(spark, ev):
    base = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 0.5), ("g", 3, None)], "game string, id long, net double")
    inverse = spark.createDataFrame([("g", 1, -0.4), ("g", 1, -0.6), ("g", 2, -0.5), ("g", 2, -0.5), ("g", 3, 1.0), ("g", 9, 1.0)], "game string, kept long, net double")
    assert [(r.passed, r.n) for r in V.check_conservation(base, inverse, ["game"], "kept", "net").collect()] == [(False, 1)]
    assert V.conservation_residuals(base, inverse, ["game"], "kept", "net").count() == 2
    raw = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("c", None), (None, 2.0)], "k string, p double")
    same = {r.check: r.n for r in V.check_immutable(raw, raw.union(raw.where("k = 'b'")), ["k"], ["p"]).collect()}
    assert same == {"changed": 0, "lone_keys": 0, "fewer_rows": 0}
    less = spark.createDataFrame([("a", 2.0), ("b", 1.5), ("c", None)], "k string, p double")
    assert {r.check: r.n for r in V.check_immutable(raw, less, ["k"], ["p"]).collect()} == {"changed": 1, "lone_keys": 1, "fewer_rows": 1}
    assert len(V.wide_columns()) == 132
    empty = {r.check: (r.passed, r.n) for r in V.gate_events(ev.limit(0).withColumn("made", F.lit(0)), "type", synthetic="made", coverage={"player": 0.5}).collect()}
    assert empty["synthetic_absent"] == (False, 1) and empty["coverage_player"] == (True, 0)


def test_default_texts(spark):
    clean = lambda t: spark.range(1).select(C.clean_description(F.lit(t))).first()[0]
    assert clean("F/Off won in DZ+rec") == "faceoff won in defensive zone reception" and clean("Shot on net with goal") == "shot" and clean("GOAL") is None and clean("") is None
