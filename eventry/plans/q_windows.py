"""Queries of the ordered-row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventry.operators import windows as O
from eventry.operators.aggregates import zone_baselines
from eventry.plans.registry import Registry
from eventry.schema import DEFAULT as S
from eventry.testmap import DAY, DIALOGUE, EV, TRACKING, dialogue, events, tracking

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
G = "PARTITION BY game ORDER BY period, t, id"
Q = "PARTITION BY game, seq ORDER BY period, t, id"
P = "PARTITION BY game, period ORDER BY period, t, id"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_UP = "ROWS UNBOUNDED PRECEDING"


@R.add(f"""WITH {EV}, l AS (SELECT *, greatest(t - lag(t) OVER w, 0) AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ev WINDOW w AS ({P}))
           SELECT id, dt, least(sqrt(dx * dx + dy * dy), 200) AS distance, CASE WHEN dt > 0 AND type <> 'whistle' THEN least(least(sqrt(dx * dx + dy * dy), 200) / dt, 120) END AS speed, atan2(dy, dx) AS angle FROM l WHERE dx IS NOT NULL""")
def w01_transition_features(spark, d):
    return O.transition_features(events(spark, d), no_speed=("whistle",)).where("distance IS NOT NULL").select("id", "dt", "distance", "speed", "angle")


_ANGLE = "atan2({y}, 89.0 - {x})"
_PASS = ", ".join(f"CASE WHEN lag(type, {k}) OVER w = 'pass' THEN lag(aim, {k}) OVER w END" for k in (2, 3, 4))
_IN_PERIOD = "PARTITION BY game, period, seq ORDER BY period, t, id"


# Passes of every third id have no destination, of every fifth only one half of it.
@R.add(f"""WITH {EV}, e AS (SELECT *, CASE WHEN id % 3 > 0 THEN y END AS dx, CASE WHEN id % 5 > 0 THEN x END AS dy FROM ev),
           a AS (SELECT *, CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN [dx, dy] ELSE [x, y] END AS aim FROM e),
           o AS (SELECT *, CASE WHEN coalesce(lag(type) OVER w = 'faceoff', false) THEN coalesce({_PASS}, [lag(x) OVER w, lag(y) OVER w]) ELSE [lag(x) OVER w, lag(y) OVER w] END AS o
                 FROM a WINDOW w AS ({_IN_PERIOD})),
           r AS (SELECT id, {_ANGLE.format(x='x', y='y')} - {_ANGLE.format(x='o[1]', y='o[2]')} AS a FROM o WHERE type IN ('shot', 'goal'))
           SELECT id, round(abs(atan2(sin(a), cos(a))), 6) AS angle_change FROM r""")
def w02_angle_change(spark, d):
    e = events(spark, d).withColumns({"dest_x": F.when(F.col("id") % 3 > 0, F.col("y")), "dest_y": F.when(F.col("id") % 5 > 0, F.col("x"))})
    out = O.angle_change(e, reception="faceoff", shots=("shot", "goal"))
    return out.where("type IN ('shot', 'goal')").select("id", F.round("angle_change", 6).alias("angle_change"))


@R.add(f"WITH {EV}, l AS (SELECT t - lag(t) OVER (PARTITION BY game, seq ORDER BY id) AS dt FROM ev) SELECT count(*) FILTER (WHERE dt < -1) AS n_disorder FROM l")
def w03_disorder_count(spark, d):
    return O.disorder_count(events(spark, d))


@R.add(f"""WITH {EV}, l AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY game, seq ORDER BY id) < -1, false) AS f FROM ev), m AS (SELECT bool_or(f) AS r FROM l),
           k AS (SELECT ev.*, CASE WHEN r THEN period END AS a, CASE WHEN r THEN t END AS b FROM ev, m)
           SELECT id, row_number() OVER (PARTITION BY game, seq ORDER BY a, b, id) AS sequence_event_id, row_number() OVER (PARTITION BY game ORDER BY a, b, id) AS game_event_id FROM k""")
def w04_canonical_order(spark, d):
    return O.canonical_order(events(spark, d), "id").select("id", F.col("sequence_event_id").cast("long"), F.col("game_event_id").cast("long"))


@R.add(f"""WITH {EV}, e AS (SELECT * REPLACE (CASE WHEN CAST(game AS INT) % 2 = 0 THEN 604800 - t ELSE t END AS t) FROM ev), l AS (SELECT *, sign(t - lag(t) OVER (PARTITION BY game, period ORDER BY id)) AS s FROM e),
           m AS (SELECT *, CASE WHEN coalesce(sum(s) OVER (PARTITION BY game, period), 0) < 0 THEN 604800 - t ELSE t END AS elapsed FROM l) SELECT id, elapsed, (period - 1) * 604800 + elapsed AS game_time FROM m""")
def w05_elapsed_clock(spark, d):
    e = events(spark, d).withColumn("t", F.when(F.col("game").cast("int") % 2 == 0, 604800 - F.col("t")).otherwise(F.col("t")))
    return O.elapsed_clock(e, length=604800.0).select("id", "elapsed", "game_time")


@R.add(f"WITH {EV}, l AS (SELECT *, coalesce(max(CASE WHEN type IN ('whistle', 'goal') THEN 1 ELSE 0 END) OVER ({Q} {_BEFORE}), 0) AS o FROM ev) SELECT id FROM l WHERE o = 0 OR (type = 'faceoff' AND player IS NOT NULL)")
def w06_cut_after_terminator(spark, d):
    return O.cut_after_terminator(events(spark, d), keep=(F.col("type") == "faceoff") & F.col("player").isNotNull()).select("id")


@R.add(f"""WITH {EV}, l AS (SELECT *, coalesce(max(CASE WHEN type = 'goal' THEN 1 ELSE 0 END) OVER ({Q} {_BEFORE}), 0) AS g, coalesce(max(CASE WHEN type = 'whistle' THEN 1 ELSE 0 END) OVER ({Q} {_BEFORE}), 0) AS w FROM ev)
           SELECT id FROM l WHERE g = 0 AND (w = 0 OR type = 'goal' OR player = 'P2')""")
def w07_cut_after_types(spark, d):
    return O.cut_after_types(events(spark, d), {"goal": None, "whistle": (F.col("type") == "goal") | (F.col("player") == "P2")}).select("id")


@R.add(f"WITH {EV} SELECT id FROM ev QUALIFY max(CASE WHEN type = 'faceoff' THEN 1 ELSE 0 END) OVER (PARTITION BY game, seq) = 0 OR max(CASE WHEN type NOT IN ('faceoff', 'whistle') THEN 1 ELSE 0 END) OVER (PARTITION BY game, seq) = 1")
def w08_drop_false_starts(spark, d):
    return O.drop_false_starts(events(spark, d)).select("id")


@R.add(f"WITH {EV}, e AS (SELECT *, CASE WHEN type = 'goal' AND id % 20 = 0 THEN 1 ELSE 0 END AS h FROM ev) SELECT id FROM e QUALIFY coalesce(max(h) OVER ({G} {_BEFORE}), 0) = 0")
def w09_cut_after_first(spark, d):
    e = events(spark, d).withColumn("type", F.when((F.col("type") == "goal") & (F.col("id") % 20 == 0), "end").otherwise(F.col("type")))
    return O.cut_after_first(e, "end").select("id")


@R.add(f"""WITH {EV}, o AS (SELECT *, row_number() OVER ({G}) AS n, max(CASE WHEN type = 'goal' THEN row_number END) OVER ({G} {_UP}) AS sn FROM (SELECT *, row_number() OVER ({G}) AS row_number FROM ev)),
           j AS (SELECT o.*, s.seq AS sseq FROM o LEFT JOIN (SELECT game, n AS m, seq FROM o) s ON o.game = s.game AND o.sn = s.m),
           c AS (SELECT *, sum(CASE WHEN type = 'faceoff' AND seq <> sseq THEN 1 ELSE 0 END) OVER (PARTITION BY game, sn ORDER BY n {_UP}) AS c FROM j) SELECT id FROM c WHERE sn IS NULL OR c > 0""")
def w10_drop_windows(spark, d):
    return O.drop_windows(events(spark, d), "goal", "faceoff").select("id")


# The nearest own-team source before each goal, by a join; goals without a team are never duplicates.
@R.add(f"""WITH {EV}, o AS (SELECT *, row_number() OVER ({_IN_PERIOD}) AS n FROM ev), goals AS (SELECT * FROM o WHERE type = 'goal' AND team IS NOT NULL),
           s AS (SELECT g.id, min(g.n - b.n) AS gap FROM goals g JOIN o b ON g.game = b.game AND g.period = b.period AND g.seq = b.seq AND g.team = b.team AND b.type = 'shot' AND b.n < g.n GROUP BY g.id),
           r AS (SELECT goals.id, row_number() OVER (PARTITION BY game, period, seq, team ORDER BY gap NULLS LAST, n) AS r FROM goals LEFT JOIN s USING (id))
           SELECT id FROM ev WHERE id NOT IN (SELECT id FROM r WHERE r > 1)""")
def w11_keep_best_duplicate(spark, d):
    return O.keep_best_duplicate(events(spark, d), "goal", ["shot"]).select("id")


@R.add(f"""WITH {EV}, l AS (SELECT *, type = 'pass' AND coalesce(lag(type) OVER w = 'pass', false) AS a, type = 'pass' AND coalesce(lead(type) OVER w = 'pass', false) AS b, lag(player) OVER w AS pp, lead(player) OVER w AS np FROM ev WINDOW w AS ({Q}))
           SELECT id FROM l WHERE NOT ((a AND (pp IS NOT NULL OR player IS NULL)) OR (b AND player IS NULL AND np IS NOT NULL))""")
def w12_drop_adjacent_duplicates(spark, d):
    return O.drop_adjacent_duplicates(events(spark, d), "pass").select("id")


@R.add(f"WITH {EV} SELECT id, CASE WHEN type IN ('whistle', 'goal') AND lead(id) OVER ({Q}) IS NULL THEN 1 ELSE 0 END AS is_eos FROM ev")
def w13_eos_flag(spark, d):
    return O.eos_flag(events(spark, d)).select("id", "is_eos")


@R.add(f"""WITH {EV}, a AS (SELECT *, CASE type WHEN 'shot' THEN 1 WHEN 'goal' THEN -1 ELSE 0 END AS step FROM ev), b AS (SELECT *, sum(step) OVER ({Q} {_UP}) AS s FROM a),
           c AS (SELECT *, s - least(0, min(s) OVER ({Q} {_UP})) AS lv FROM b), e AS (SELECT *, coalesce(lag(lv) OVER ({Q}), 0) AS was FROM c),
           f AS (SELECT *, CASE WHEN step = 1 THEN lv WHEN step = -1 AND was > 0 THEN lv + 1 END AS at_level FROM e)
           SELECT id, CASE WHEN step = -1 AND at_level IS NOT NULL THEN lag(CASE WHEN step = 1 THEN id END) OVER (PARTITION BY game, seq, at_level ORDER BY period, t, id) END AS source_id FROM f""")
def w14_link_latest(spark, d):
    return O.link_latest(events(spark, d), ["shot"], ["goal"]).select("id", "source_id")


@R.add(f"""WITH {EV} SELECT id, type = 'goal' OR (type = 'shot' AND coalesce(lead(type) OVER w = 'goal' AND lead(seq) OVER w = seq AND lead(team) OVER w = team, false)) AS is_goal
           FROM ev WINDOW w AS ({G})""")
def w15_derive_flag(spark, d):
    return O.derive_flag(events(spark, d)).select("id", "is_goal")


@R.add(f"""WITH {EV}, n AS (SELECT *, lead(type) OVER ({G}) AS nt FROM ev) SELECT CAST(id AS DOUBLE) AS id, t, type, 0 AS is_synthetic FROM ev
           UNION ALL SELECT CAST(id + 0.5 AS DOUBLE), t + 0.1, 'save', 1 FROM n WHERE type = 'shot' AND coalesce(nt <> 'goal', true)""")
def w16_inject_after(spark, d):
    nxt = F.lead("type").over(S.window())
    return O.inject_after(events(spark, d), (F.col("type") == "shot") & F.coalesce(nxt != "goal", F.lit(True)), {"type": F.lit("save")}).select(F.col("id").cast("double").alias("id"), "t", "type", "is_synthetic")


# The nearest of the three rows before that is a shot or a reset decides.
@R.add(f"""WITH {EV}, o AS (SELECT *, row_number() OVER ({Q}) AS n FROM ev), p AS (SELECT * FROM o WHERE type = 'pass'),
           m AS (SELECT p.id, p.team, arg_max(b.type, b.n) AS kind, arg_max(coalesce(b.team, ''), b.n) AS other FROM p JOIN o b ON p.game = b.game AND p.seq = b.seq AND b.n BETWEEN p.n - 3 AND p.n - 1
                 WHERE b.type IN ('shot', 'faceoff', 'whistle', 'goal') GROUP BY p.id, p.team)
           SELECT ev.id, CASE WHEN m.kind = 'shot' AND m.other <> '' AND m.other <> m.team THEN 'defensive' ELSE type END AS type FROM ev LEFT JOIN m ON ev.id = m.id""")
def w17_reclassify(spark, d):
    return O.reclassify(events(spark, d), "pass", "defensive").select("id", "type")


_ANCHOR = ", ".join(f"CASE WHEN lag(type, {k}) OVER w = 'shot' THEN lag(n, {k}) OVER w END" for k in range(5, 0, -1))
_ANCHOR_T = ", ".join(f"CASE WHEN lag(type, {k}) OVER w = 'shot' THEN lag(t, {k}) OVER w END" for k in range(5, 0, -1))


@R.add(f"""WITH {EV}, o AS (SELECT *, row_number() OVER ({Q}) AS n FROM ev), l AS (SELECT *, lead(type) OVER w AS nt, coalesce({_ANCHOR}) AS an, coalesce({_ANCHOR_T}) AS anchor_t FROM o WINDOW w AS ({Q})),
           m AS (SELECT id, game, seq, CASE WHEN type = 'faceoff' AND nt = 'goal' AND an IS NOT NULL THEN an - 0.5 ELSE n END AS k, CASE WHEN type = 'faceoff' AND nt = 'goal' AND an IS NOT NULL THEN anchor_t ELSE t END AS t FROM l)
           SELECT id, t, row_number() OVER (PARTITION BY game, seq ORDER BY k, id) AS sequence_event_id FROM m""")
def w18_demote_before_anchor(spark, d):
    return O.demote_before_anchor(events(spark, d), ["faceoff"], "goal", ["shot"]).select("id", "t", F.col("sequence_event_id").cast("long"))


@R.add(f"""WITH {EV} SELECT id, CASE WHEN type = 'shot' AND (coalesce(lead(type) OVER w = 'goal', false) OR coalesce(lead(type) OVER w = 'pass' AND lead(outcome) OVER w = 'failed' AND lead(type, 2) OVER w = 'goal', false)) THEN 1 ELSE 0 END AS target_xg FROM ev WINDOW w AS ({Q})""")
def w19_lookahead_label(spark, d):
    return O.lookahead_label(events(spark, d), shots=("shot",), block="pass").select("id", "target_xg")


_HORIZON = f"""g AS (SELECT game, period, t AS gt, team AS g FROM ev WHERE type = 'goal'), c AS (SELECT *, least(max(t) OVER (PARTITION BY game, period), 604800.0) AS cap FROM ev),
    j AS (SELECT c.*, gt, g FROM c ASOF LEFT JOIN g ON c.game = g.game AND c.period = g.period AND c.t < g.gt)"""


@R.add(f"""WITH {EV}, {_HORIZON}, y AS (SELECT type, CASE WHEN team IS NULL OR gt IS NULL OR gt > least(t + {DAY}, cap) THEN 2 WHEN g = team THEN 0 ELSE 1 END AS target FROM j)
           SELECT type, target, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY type) AS share FROM y GROUP BY type, target""")
def w20_horizon_label(spark, d):
    from eventry.operators.aggregates import class_distribution

    return class_distribution(O.horizon_label(events(spark, d), horizon=DAY, cap=604800.0), "target", "type")


@R.add(f"""WITH {EV}, {_HORIZON}, u AS (SELECT game, period, t AS ut FROM ev WHERE type = 'faceoff'), k AS (SELECT j.*, ut FROM j ASOF LEFT JOIN u ON j.game = u.game AND j.period = u.period AND j.t < u.ut),
           m AS (SELECT *, least(CASE WHEN type = 'pass' AND ut IS NOT NULL THEN ut + 7200 ELSE t + {DAY} END, cap) AS lim FROM k)
           SELECT id, CASE WHEN team IS NULL OR gt IS NULL OR gt > lim THEN 2 WHEN g = team THEN 0 ELSE 1 END AS target FROM m""")
def w21_extended_horizon(spark, d):
    return O.horizon_label(events(spark, d), horizon=DAY, cap=604800.0, extended=("pass", "faceoff", 7200.0)).select("id", "target")


@R.add(f"WITH {EV}, l AS (SELECT type, lead(type) OVER ({G}) AS next_type FROM ev) SELECT next_type, count(*) AS n, next_type IS NULL OR next_type IN ('faceoff', 'goal') AS allowed FROM l WHERE type = 'whistle' GROUP BY next_type")
def w22_continuation_audit(spark, d):
    return O.continuation_audit(events(spark, d), "whistle", ["faceoff", "goal"])


# Every fourth goal has no team: it counts as a team of its own.
@R.add(f"""WITH {EV}, p AS (SELECT game, id, CASE WHEN id % 4 > 0 THEN team ELSE 'none' END AS team FROM ev WHERE type = 'goal'),
           n AS (SELECT *, lag(id) OVER w AS before, lag(team) OVER w AS before_team, lead(id) OVER w AS after, lead(team) OVER w AS after_team FROM p WINDOW w AS (PARTITION BY game ORDER BY id))
           SELECT id, (before IS NOT NULL AND id - before <= 400 AND before_team <> team) OR (after IS NOT NULL AND after - id <= 400 AND after_team <> team) AS is_offsetting FROM n""")
def w23_flag_offsetting(spark, d):
    e = events(spark, d).withColumn("team", F.when(F.col("id") % 4 > 0, F.col("team")))
    return O.flag_offsetting(e, "goal", 400).select("id", "is_offsetting")


@R.add(f"""WITH {TRACKING}, r AS (SELECT *, row_number() OVER (PARTITION BY event, side ORDER BY distance, member, node) AS s FROM trk)
           SELECT event, {', '.join(f"max(CASE WHEN side = '{a}' AND s = {k} THEN {m} END) AS {a}{k}_{m}" for a, n in (('mate', 2), ('opp', 3)) for k in range(1, n + 1) for m in ('distance', 'v'))} FROM r GROUP BY event""")
def w24_rank_slots(spark, d):
    return O.rank_slots(tracking(spark, d), ["event"], "side", {"mate": 2, "opp": 3}, ["distance", "member", "node"], ["distance", "v"])


@R.add()
def w25_persistent_slots(spark, d):
    e = events(spark, d).where("player IS NOT NULL AND team IS NOT NULL")
    roster = e.groupBy("game", "team", F.col("period").cast("int").alias("period"), "player").agg(F.min("y").alias("dist"))
    return O.persistent_slots(roster, ["game", "team"], "period", "player", "dist")


@R.add(f"WITH {EV} SELECT id, CASE WHEN lag(id) OVER ({G}) IS NULL THEN 0 WHEN lag(player) OVER ({G}) IS DISTINCT FROM player THEN 1 ELSE 0 END AS player_changed FROM ev")
def w26_changed_flag(spark, d):
    return O.changed_flag(events(spark, d), "player").select("id", "player_changed")


@R.add(f"""WITH {TRACKING}, s AS (SELECT *, (row_number() OVER (PARTITION BY event, side ORDER BY node)) - 1 AS s FROM trk) SELECT event,
           {', '.join(f"coalesce(max(CASE WHEN side = '{a}' AND s = {k} THEN tx END), 0.0) AS {a}_{k}_tx, coalesce(max(CASE WHEN side = '{a}' AND s = {k} THEN distance END), 200.0) AS {a}_{k}_distance, 1 - max(CASE WHEN side = '{a}' AND s = {k} THEN 1 ELSE 0 END) AS {a}_{k}_slot_vacant" for a in ('mate', 'opp') for k in (0, 1))} FROM s GROUP BY event""")
def w27_slots_to_wide(spark, d):
    from pyspark.sql import Window

    t = tracking(spark, d)
    t = t.withColumn("slot", F.row_number().over(Window.partitionBy("event", "side").orderBy("node")) - 1)
    return O.slots_to_wide(t, ["event"], "side", "slot", ("mate", "opp"), 2, {"tx": 0.0, "distance": 200.0})


# First turns and every fifth one have no team, some probabilities are missing.
@R.add(f"""WITH {DIALOGUE}, v AS (SELECT *, CASE WHEN id % 1000 > 1 AND id % 5 > 0 THEN team END AS who, nullif(p_for, 0.5) AS pf, CASE WHEN id % 7 > 0 THEN p_against END AS pa FROM dia),
           k AS (SELECT *, last_value(who IGNORE NULLS) OVER ({G} {_UP}) AS acting FROM v),
           l AS (SELECT *, coalesce(lag(acting) OVER w = acting, false) AS same, lag(pf) OVER w AS before_f, lag(pa) OVER w AS before_a FROM k WINDOW w AS ({G}))
           SELECT id, CASE WHEN type IN ('goal', 'whistle') THEN 0 ELSE coalesce(pf, 0) - coalesce(CASE WHEN same THEN before_f ELSE before_a END, 0) END AS delta_for,
                  CASE WHEN type IN ('goal', 'whistle') THEN 0 ELSE coalesce(pa, 0) - coalesce(CASE WHEN same THEN before_a ELSE before_f END, 0) END AS delta_against FROM l""")
def w28_relative_delta(spark, d):
    e = dialogue(spark, d).withColumns({
        "team": F.when((F.col("id") % 1000 > 1) & (F.col("id") % 5 > 0), F.col("team")),
        "p_for": F.when(F.col("p_for") != 0.5, F.col("p_for")),
        "p_against": F.when(F.col("id") % 7 > 0, F.col("p_against")),
    })
    return O.relative_delta(e, "p_for", "p_against").select("id", "delta_for", "delta_against")


@R.add(f"""WITH {EV}, n AS (SELECT *, last_value(CASE WHEN type = 'faceoff' THEN id END IGNORE NULLS) OVER (PARTITION BY game ORDER BY period DESC, t DESC, id DESC {_BEFORE}) AS nf FROM ev)
           SELECT CAST(id AS DOUBLE) AS id, t, type, team, x FROM ev UNION ALL SELECT CAST(n.id + 0.1 AS DOUBLE), n.t + 0.1, 'whistle', f.team, f.x FROM n LEFT JOIN ev f ON n.nf = f.id WHERE n.type = 'goal'""")
def w29_inject_with_next(spark, d):
    return O.inject_with_next(events(spark, d), "goal", "faceoff", "whistle", {"team": "team", "x": "x"}).select(F.col("id").cast("double").alias("id"), "t", "type", "team", "x")


_ZONE = """CASE WHEN abs(abs(x) - 25.5) <= 0.5 AND y > 0 THEN 'oz' WHEN abs(abs(x) - 25.5) <= 0.5 AND y < 0 THEN 'dz' WHEN x > 25.5 THEN 'oz' WHEN x < -25.5 THEN 'dz' ELSE 'nz' END"""


# Places end in .5 beside the edge, where y (as the raw place) decides; baselines come from the faceoffs of each zone.
@R.add(f"""WITH {EV}, h AS (SELECT * REPLACE (x + 1.5 * (CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) AS x) FROM ev), f AS (SELECT *, {_ZONE} AS z FROM h),
           m AS (SELECT coalesce(avg(y) FILTER (WHERE z = 'oz'), 0) AS oz_f, coalesce(avg(value) FILTER (WHERE z = 'oz'), 0) AS oz_a, coalesce(avg(y) FILTER (WHERE z = 'dz'), 0) AS dz_f,
                        coalesce(avg(value) FILTER (WHERE z = 'dz'), 0) AS dz_a, coalesce(avg(y) FILTER (WHERE z = 'nz'), 0) AS nz_f, coalesce(avg(value) FILTER (WHERE z = 'nz'), 0) AS nz_a FROM f WHERE type = 'faceoff'),
           b AS (SELECT 'oz' AS z, (oz_f + dz_a) / 2 AS bf, (oz_a + dz_f) / 2 AS ba FROM m UNION ALL SELECT 'dz', (dz_f + oz_a) / 2, (dz_a + oz_f) / 2 FROM m UNION ALL SELECT 'nz', (nz_f + nz_a) / 2, (nz_a + nz_f) / 2 FROM m),
           n AS (SELECT *, last_value(CASE WHEN type = 'faceoff' THEN z END IGNORE NULLS) OVER (PARTITION BY game ORDER BY period DESC, t DESC, id DESC {_BEFORE}) AS nz FROM f),
           w AS (SELECT *, CASE WHEN type = 'whistle' THEN coalesce(nz, 'nz') END AS zone FROM n)
           SELECT id, zone, CASE WHEN zone IS NULL THEN 0.25 ELSE bf END AS p_for, CASE WHEN zone IS NULL THEN 0.5 ELSE ba END AS p_against, CASE WHEN zone IS NULL THEN 0.25 ELSE greatest(least(1 - bf - ba, 1), 0) END AS p_none
           FROM w LEFT JOIN b ON w.zone = b.z""")
def w30_stamp_next_zone(spark, d):
    e = events(spark, d).withColumn("x", F.col("x") + 1.5 * F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    e = e.withColumns({"p_for": F.lit(0.25), "p_against": F.lit(0.5), "p_none": F.lit(0.25), "raw": F.col("y")})
    at_faceoffs = e.where("type = 'faceoff'").withColumn("zone", O.zone(F.col("x"), F.col("raw"), eps=0.5))
    out = O.stamp_next_zone(e, zone_baselines(at_faceoffs, "zone", "y", "value"), raw="raw", probs=("p_for", "p_against", "p_none"), eps=0.5)
    return out.select("id", "zone", "p_for", "p_against", "p_none")


# Every third whistle has no baseline.
@R.add(f"""WITH {DIALOGUE}, v AS (SELECT *, CASE WHEN id % 3 > 0 THEN p_for END AS base, CASE WHEN id % 7 > 0 THEN p_against END AS opp FROM dia),
           l AS (SELECT *, coalesce(lead(type) OVER w = 'whistle', false) AS f, lead(base) OVER w AS b FROM v WINDOW w AS ({G}))
           SELECT id, CASE WHEN f AND b IS NOT NULL THEN 'save_with_freeze_credit' WHEN f THEN 'save_with_whistle_no_baseline' ELSE 'save_play_continued' END AS save_reason,
                  p_for + CASE WHEN f AND b IS NOT NULL THEN greatest(0, coalesce(opp, 0) - b) ELSE 0 END AS save_credit FROM l WHERE type = 'turn'""")
def w31_save_credit(spark, d):
    e = dialogue(spark, d).withColumns({"base": F.when(F.col("id") % 3 > 0, F.col("p_for")), "opp": F.when(F.col("id") % 7 > 0, F.col("p_against"))})
    return O.save_credit(e, "p_for", "opp", "base", save="turn").select("id", "save_reason", "save_credit")


@R.add(f"WITH {DIALOGUE}, l AS (SELECT *, 1 - greatest(coalesce(lag(p_for) OVER ({G}), 0), coalesce(lag(p_against) OVER ({G}), 0)) AS goal_penalty FROM dia) SELECT id, goal_penalty FROM l WHERE type = 'whistle'")
def w32_goal_allowed(spark, d):
    return O.goal_allowed(dialogue(spark, d), "p_for", "p_against", goal="whistle").select("id", "goal_penalty")


@R.add(f"WITH {EV} SELECT id, last_value(CASE WHEN type <> 'whistle' THEN id END IGNORE NULLS) OVER (PARTITION BY game ORDER BY period DESC, t DESC, id DESC {_BEFORE}) AS next_id FROM ev")
def w33_next_except(spark, d):
    return O.next_except(events(spark, d), ["id"], skip=("whistle",)).select("id", F.col("next_row.id").alias("next_id"))


@R.add(f"""WITH {EV}, l AS (SELECT *, lag(id) OVER w AS pid, lag(type) OVER w AS pt, lag(seq) OVER w AS ps, lag(value) OVER w AS pv FROM ev WINDOW w AS ({G})), r AS (SELECT *, pid IS NULL OR pt IN ('whistle', 'goal') OR type = 'faceoff' OR ps <> seq AS r FROM l)
           SELECT id, CAST(r AS INT) AS is_reset, CASE WHEN r THEN x ELSE pv END AS baseline FROM r""")
def w34_reset_baseline(spark, d):
    return O.reset_baseline(events(spark, d), "value", "x").select("id", "is_reset", "baseline")


@R.add(f"""WITH {EV}, u AS (SELECT game, period, CAST(id AS DOUBLE) AS id, t, type, x FROM ev UNION ALL SELECT game, period, CAST(id + 0.1 AS DOUBLE), t + 0.1, 'whistle', 0.5 FROM ev WHERE type = 'goal')
           SELECT id, type, x, lead(type) OVER ({G}) AS next_type FROM u""")
def w35_inject_and_stamp(spark, d):
    return O.inject_and_stamp(events(spark, d), "goal", "whistle", {"x": 0.5}).select(F.col("id").cast("double").alias("id"), "type", "x", "next_type")


@R.add(f"WITH {EV}, l AS (SELECT type, lag(type) OVER ({G}) AS prev_type FROM ev) SELECT prev_type, count(*) AS n, coalesce(prev_type = 'shot', false) AS expected FROM l WHERE type = 'goal' GROUP BY prev_type")
def w36_predecessor_audit(spark, d):
    return O.predecessor_audit(events(spark, d), "goal", ["shot"])


@R.add(f"""WITH {EV}, l AS (SELECT *, CASE WHEN t - lag(t) OVER w > 20000 THEN 1 ELSE 0 END AS g, row_number() OVER w AS n FROM ev WINDOW w AS ({G})),
           s AS (SELECT *, sum(g) OVER ({G} {_UP}) AS segment, min(CASE WHEN g = 1 THEN n END) OVER (PARTITION BY game) AS f FROM l) SELECT id, CAST(segment AS BIGINT) AS segment FROM s WHERE NOT (coalesce(f = 3, false) AND n <= 2)""")
def w37_gap_segments(spark, d):
    return O.gap_segments(events(spark, d), max_gap=20_000.0).select("id", "segment")


_CHUNKS = f"""p AS (SELECT *, row_number() OVER ({G}) - 1 AS p, count(*) OVER (PARTITION BY game) AS len FROM ev), q AS (SELECT * FROM p WHERE len >= 10),
    k AS (SELECT *, unnest(range(CAST(greatest(0, ceil((p - 31) / 16.0)) AS BIGINT), CAST(least(floor(p / 16.0), ceil(greatest(len - 32 + 16, 1) / 16.0) - 1) AS BIGINT) + 1)) AS chunk FROM q)"""


@R.add(f"WITH {EV}, {_CHUNKS} SELECT id, CAST(chunk AS INT) AS chunk, p - chunk * 16 AS pos, CASE WHEN chunk > 0 THEN 16 ELSE 0 END AS drop_prefix FROM k")
def w38_sliding_windows(spark, d):
    return O.sliding_windows(events(spark, d), ["game"], list(S.order), 32, 16, 10).select("id", "chunk", F.col("pos").cast("long"), "drop_prefix")


@R.add(f"WITH {EV}, {_CHUNKS} SELECT id, CAST(max(chunk) AS INT) AS chunk FROM k GROUP BY id")
def w39_keep_last(spark, d):
    w = O.sliding_windows(events(spark, d), ["game"], list(S.order), 32, 16, 10)
    return O.keep_last(w, ["game", "id"], ["chunk"]).select("id", "chunk")


@R.add(f"WITH {EV}, u AS (SELECT *, 0 AS c FROM ev UNION ALL SELECT *, 1 FROM ev WHERE id % 3 = 0) SELECT id, min(c) AS copy FROM u GROUP BY id")
def w40_strict_dedupe(spark, d):
    e = events(spark, d)
    both = e.withColumn("copy", F.lit(0)).union(e.where("id % 3 = 0").withColumn("copy", F.lit(1)))
    return O.strict_dedupe(both, order=["copy"]).select("id", "copy")


@R.add(f"""WITH {EV}, f AS (SELECT *, row_number() OVER w AS r, first(id) OVER w AS k FROM ev WHERE type = 'faceoff' WINDOW w AS (PARTITION BY game, period, seq ORDER BY CASE WHEN outcome = 'successful' THEN 0 ELSE 1 END, CASE WHEN player IS NOT NULL THEN 0 ELSE 1 END, id))
           SELECT id, k AS kept_id FROM f WHERE r > 1 UNION ALL SELECT id, NULL FROM f WHERE r = 1 UNION ALL SELECT id, NULL FROM ev WHERE type <> 'faceoff'""")
def w41_winner_and_sidecar(spark, d):
    kept, side = O.winner_and_sidecar(events(spark, d))
    return kept.select("id", F.lit(None).cast("long").alias("kept_id")).union(side.select("id", "kept_id"))


@R.add(f"""WITH {EV}, l AS (SELECT * FROM ev QUALIFY lead(id) OVER ({Q}) IS NULL) SELECT CAST(id AS DOUBLE) AS id, type FROM ev
           UNION ALL SELECT CAST(id + 0.1 AS DOUBLE), CASE WHEN t >= 499999 THEN 'end_of_period' ELSE 'whistle' END FROM l WHERE type NOT IN ('whistle', 'goal')""")
def w42_insert_terminal_rows(spark, d):
    return O.insert_terminal_rows(events(spark, d), boundary=500_000.0).select(F.col("id").cast("double").alias("id"), "type")


@R.add(f"WITH {EV} SELECT id, coalesce(lag(type) OVER ({P}), 'PAD') AS prior_type FROM ev")
def w43_prior_type(spark, d):
    return O.prior_type(events(spark, d)).select("id", "prior_type")


@R.add(f"WITH {EV} SELECT id, CASE WHEN type = 'faceoff' THEN 1 ELSE 0 END AS is_boundary, CASE WHEN type = 'faceoff' THEN 'whistle' ELSE type END AS type FROM ev")
def w44_normalise_boundary(spark, d):
    return O.normalise_boundary(events(spark, d), boundary="faceoff").select("id", "is_boundary", "type")


@R.add(f"WITH {EV}, l AS (SELECT *, coalesce(max(CASE WHEN type = 'faceoff' THEN 1 ELSE 0 END) OVER ({Q} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS near FROM ev) SELECT id, near FROM l WHERE type = 'goal'")
def w45_near_before(spark, d):
    return O.near_before(events(spark, d), "goal", ["faceoff"]).select("id", "near")
