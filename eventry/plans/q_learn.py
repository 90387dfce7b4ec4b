"""Queries of vocabularies, features, models and gates."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from eventry.operators import gates as V
from eventry.operators import learn as M
from eventry.operators import windows as O
from eventry.operators.aggregates import max_present, strata, window_label_counts
from eventry.operators.joins import inverse_rows, knn_edges
from eventry.plans.q_windows import _CHUNKS
from eventry.plans.registry import Registry, folder
from eventry.schema import DEFAULT as S
from eventry.testmap import DAY, EV, SCORED, TRACKING, events, scored, table, tracking

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
G = "PARTITION BY game ORDER BY period, t, id"


@R.add("SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT p_type AS token FROM part UNION SELECT '<mask>')")
def m01_build_vocab(spark, d):
    return M.build_vocab(table(spark, d, "part"), "p_type", ("<mask>",)).select("token", F.col("token_id").cast("long"))


@R.add("SELECT o_orderkey, token_id FROM orders JOIN (SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT o_orderpriority AS token FROM orders)) ON token = o_orderpriority")
def m02_apply_vocab(spark, d):
    from eventry.operators.joins import map_lookup

    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "token")
    return map_lookup(o, M.build_vocab(o, "token", start=1), "token", "token_id", 0).select("o_orderkey", F.col("token_id").cast("long"))


@R.add("SELECT doc_id, text_id FROM documents JOIN (SELECT text, row_number() OVER (ORDER BY f, sha256(text)) - 1 AS text_id FROM (SELECT text, min(doc_id) AS f FROM documents GROUP BY text)) USING (text)")
def m03_text_dictionary(spark, d):
    return M.text_dictionary(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")[0].select("doc_id", F.col("text_id").cast("long"))


@R.add(f"""WITH {EV} SELECT id, CASE WHEN player IS NULL THEN 0 ELSE sqrt(value * value + 1) END AS speed, CASE WHEN player IS NULL THEN 200.0 ELSE sqrt((89 - x) * (89 - x) + y * y) END AS distance, CASE WHEN player IS NULL THEN 1.0 ELSE 0.0 END AS missing, CASE WHEN player IS NULL THEN 200.0 ELSE abs(x) END AS slot FROM ev""")
def m04_threat_vector(spark, d):
    known = F.col("player").isNotNull()
    e = events(spark, d).select("id", F.when(known, F.col("x")).alias("ax"), F.when(known, F.col("y")).alias("ay"), F.when(known, F.col("value")).alias("vx"), F.when(known, F.lit(1.0)).alias("vy"), F.when(known, F.abs("x")).alias("tm1_distance"))
    t = M.threat_vector(e, ("ax", "ay", "vx", "vy"), ["tm1"], ["distance"])
    return t.select("id", *[F.col("threat")[i].alias(n) for i, n in ((0, "speed"), (1, "distance"), (3, "missing"), (4, "slot"))])


@R.add(f"WITH {TRACKING} SELECT event, " + ", ".join(f"coalesce(max(CASE WHEN node = {k + 1} THEN tx END), 0.0) AS tx{k}, max(CASE WHEN node = {k + 1} THEN 1 ELSE 0 END) AS p{k}" for k in range(4)) + " FROM trk WHERE node <= 4 GROUP BY event")
def m05_node_features(spark, d):
    t = tracking(spark, d).withColumn("node", F.col("node") - 1)
    n = M.node_features(t, ["event"], "node", ["tx", "ty"], 4)
    return n.select("event", *[c for k in range(4) for c in (F.col("nodes")[k]["tx"].alias(f"tx{k}"), F.col("present")[k].alias(f"p{k}"))])


@R.add(f"""WITH {TRACKING}, p AS (SELECT a.event, a.node AS u, b.node AS v, row_number() OVER (PARTITION BY a.event, a.node ORDER BY sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty)), b.node) AS r
           FROM trk a JOIN trk b ON a.event = b.event AND a.node <> b.node), k AS (SELECT event, u, v FROM p WHERE r <= 3), e AS (SELECT event, u, v FROM k UNION SELECT event, v, u FROM k),
           a AS (SELECT event, node FROM trk WHERE v > 10) SELECT event, u, v, 1.0 / count(*) OVER (PARTITION BY event, u) AS weight FROM e WHERE (event, u) IN (SELECT event, node FROM a) AND (event, v) IN (SELECT event, node FROM a)""")
def m06_normalise_edges(spark, d):
    t = tracking(spark, d)
    return M.normalise_edges(knn_edges(t, ["event"], "node", "tx", "ty"), t.where("v > 10"), ["event"], "node")


_ANCHORS = "an AS (SELECT event, arg_min(node, CASE WHEN member % 7 = 0 THEN 0 WHEN side = 'mate' THEN 1 ELSE 2 END * 1000 + node) AS anchor FROM trk GROUP BY event)"


def _anchors(spark, d):
    t = tracking(spark, d).withColumns({"actor": (F.col("member") % 7 == 0).cast("int"), "possess": (F.col("side") == "mate").cast("int")})
    return t, M.choose_anchor(t, ["event"], "node", "actor", "possess")


@R.add(f"WITH {TRACKING}, {_ANCHORS} SELECT event, anchor FROM an")
def m07_choose_anchor(spark, d):
    return _anchors(spark, d)[1]


@R.add(f"WITH {TRACKING}, {_ANCHORS} SELECT t.event, t.node, t.tx - a.tx AS tx, t.ty - a.ty AS ty FROM trk t JOIN an USING (event) JOIN trk a ON a.event = t.event AND a.node = anchor")
def m08_anchor_relative(spark, d):
    t, a = _anchors(spark, d)
    return M.anchor_relative(t, a, ["event"], "node", ["tx", "ty"]).select("event", "node", "tx", "ty")


@R.add(f"WITH {TRACKING} SELECT event, node, sqrt(tx * tx + ty * ty) AS dist, sqrt((89 - tx) * (89 - tx) + ty * ty) AS to_net, (v * (89 - tx) + (0 - ty)) / sqrt((89 - tx) * (89 - tx) + ty * ty) AS facing FROM trk WHERE tx <> 89 OR ty <> 0")
def m09_context_features(spark, d):
    c = M.context_features(F.col("tx"), F.col("ty"), F.col("v"), F.lit(1.0), F.lit(1))
    return tracking(spark, d).where("tx <> 89 OR ty <> 0").select("event", "node", c[4].alias("dist"), c[7].alias("to_net"), c[9].alias("facing"))


@R.add(f"""WITH {EV}, c AS (SELECT game, count(*) FILTER (WHERE type = 'goal') AS n FROM ev GROUP BY game), s AS (SELECT *, CASE WHEN n <= 3 THEN 'low' WHEN n <= 6 THEN 'mid' ELSE 'high' END AS stratum FROM c)
           SELECT *, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5(game || ':7'), game) - 1) % 5 AS INT) AS fold FROM s""")
def m10_stratified_group_folds(spark, d):
    return M.stratified_group_folds(strata(events(spark, d), F.col("type") == "goal"), "game", "stratum")


@R.add()
def m11_fit_oof(spark, d):
    s = scored(spark, d).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    return M.fit_oof(s, ["n_chars"], ["lang"], "quality", "fold", ["doc_id"], folds=3).select("doc_id", "fold", "quality", F.round(F.col("p")[1], 4).alias("p1"))


@R.add(f"""WITH {SCORED}, q AS (SELECT label, count(*) / sum(count(*)) OVER () AS q FROM sc GROUP BY label), s AS (SELECT doc_id % 3 AS fold, -ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS l, -ln(q) AS b FROM sc JOIN q USING (label))
           SELECT CASE WHEN grouping(fold) = 1 THEN 'mean' ELSE CAST(fold AS VARCHAR) END AS fold, count(*) AS n, avg(l) AS log_loss, avg(b) AS naive_loss, 100 * (1 - avg(l) / avg(b)) AS skill_pct FROM s GROUP BY ROLLUP (fold)""")
def m12_fold_metrics(spark, d):
    s = scored(spark, d).withColumns({"fold": F.col("doc_id") % 3, "p": F.array("p0", "p1", "p2")})
    return M.fold_metrics(s, "label", "fold")


@R.add(f"""WITH {EV}, {_CHUNKS} SELECT game, CAST(chunk AS INT) AS chunk, sum(x) AS total, count(*) AS n, count(*) FILTER (WHERE NOT (chunk > 0 AND p - chunk * 16 < 16)) AS n_labelled FROM k GROUP BY game, chunk""")
def m13_padded_windows(spark, d):
    e = events(spark, d).withColumn("y", F.lit(1))
    w = M.padded_windows(e, ["game"], list(S.order), ["x"], "y", 32, 16, 10)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return w.select("game", "chunk", add("x").alias("total"), F.size(F.filter("mask", lambda m: m == 1)).cast("long").alias("n"), F.size(F.filter("labels", lambda y: y == 1)).cast("long").alias("n_labelled"))


@R.add(f"WITH {EV}, {_CHUNKS} SELECT type, count(*) AS n FROM k GROUP BY type")
def a32_window_label_counts(spark, d):
    return window_label_counts(O.sliding_windows(events(spark, d), ["game"], list(S.order), 32, 16, 10), "type")


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE l_quantity END) AS far FROM lineitem")
def a24_max_present(spark, d):
    li = table(spark, d, "lineitem").withColumns({"m1": F.lit(1), "m2": (F.col("l_linenumber") % 2 == 0).cast("int")})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", max_present(["l_quantity", "l_extendedprice"], ["m1", "m2"]).alias("far"))


@R.add(f"WITH {EV}, r AS (SELECT game, list(x ORDER BY period, t, id) AS a FROM ev GROUP BY game) SELECT game, len(a) AS n, a[1] AS first, a[-1] AS last FROM r")
def d01_apply_grouped(spark, d):
    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["period", "t", "id"])
        return pd.DataFrame({"game": [p.game.iloc[0]], "n": [len(p)], "first": [p.x.iloc[0]], "last": [p.x.iloc[-1]]})

    return M.apply_grouped(events(spark, d).select("game", "period", "t", "id", "x"), ["game"], ends, "game string, n long, first double, last double")


@R.add("SELECT text, CAST(length(text) AS DOUBLE) AS score FROM (SELECT DISTINCT text FROM benchmark)")
def d02_score_batches(spark, d):
    return M.score_batches(table(spark, d, "benchmark"), "text", lambda: lambda s: s.str.len().astype(float), "text string, score double")


def _rows(*checks: tuple[str, str, str]) -> str:
    """SQL for gate rows: (check, count over ev-like source, source)."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", n <= 0 AS passed, CAST(n AS BIGINT) AS n FROM (SELECT coalesce({e}, 0) AS n FROM {src})" for c, e, src in checks)


@R.add(f"""WITH {EV} SELECT 'required_columns' AS "check", false AS passed, CAST(1 AS BIGINT) AS n UNION ALL {_rows(('unique_key', 'sum(e)', '(SELECT count(*) - 1 AS e FROM ev GROUP BY game, type, player)'), ('domain_type', "count(*) FILTER (WHERE type NOT IN ('goal', 'shot', 'pass'))", 'ev'))}""")
def v01_check_schema(spark, d):
    return V.check_schema(events(spark, d), ["game", "id", "absent"], ["game", "type", "player"], {"type": ["goal", "shot", "pass"]})


@R.add(f"""WITH {EV}, l AS (SELECT *, t - lag(t) OVER (PARTITION BY game, seq ORDER BY id) AS dt FROM ev)
           {_rows(('disorder', 'count(*) FILTER (WHERE dt < -1)', 'l'), ('leftover_types', "count(*) FILTER (WHERE type = 'whistle')", 'l'), ('time_boundary', 'count(*) FILTER (WHERE period = 4 AND t > 300)', 'l'), ('missing_types', 'any_value(1)', 'l'))}""")
def v02_gate_clean(spark, d):
    return V.gate_clean(events(spark, d), ["goal", "shot", "absent"], ["whistle"])


@R.add(f"""WITH {EV}, n AS (SELECT *, lag(type) OVER ({G}) AS prev FROM ev)
           {_rows(('leaks', "count(*) FILTER (WHERE type = 'goal')", 'n'), ('forbidden_terms', "count(*) FILTER (WHERE outcome = 'successful')", 'n'), ('synthetic_placement', "count(*) FILTER (WHERE id % 4 = 0 AND prev IS DISTINCT FROM 'shot')", 'n'),
                  ('null_keys', "count(*) FILTER (WHERE game = '7')", 'n'), ('off_place', 'count(*) FILTER (WHERE id % 4 = 0 AND NOT id % 5 = 0)', 'n'), ('synthetic_absent', 'CASE WHEN count(*) FILTER (WHERE id % 4 = 0) = 0 THEN 1 ELSE 0 END', 'n'))}
           UNION ALL SELECT 'coverage_player', count(player) >= 0.95 * count(*), count(*) - count(player) FROM ev UNION ALL SELECT 'coverage_team', count(team) >= 0.05 * count(*), count(*) - count(team) FROM ev""")
def v03_gate_events(spark, d):
    at = F.col("id") % 5 == 0
    e = events(spark, d).withColumns({"text": F.concat_ws(" ", "type", "outcome"), "made": (F.col("id") % 4 == 0).cast("int"), "sx": F.when(at, -89.0).otherwise(1.0), "sy": F.when(at, 0.0).otherwise(F.col("y")), "game": F.nullif("game", F.lit("7"))})
    return V.gate_events(e, "text", sources=("shot",), synthetic="made", place={"sx": -89.0, "sy": 0.0}, coverage={"player": 0.95, "team": 0.05})


@R.add(f"""WITH {EV} SELECT 'unique_key' AS "check", true AS passed, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'imputation', avg(CASE WHEN player IS NULL THEN 1.0 ELSE 0 END) <= 0.1, count(*) FILTER (WHERE player IS NULL) FROM ev""")
def v04_gate_relative(spark, d):
    return V.gate_relative(events(spark, d).withColumn("imp", F.col("player").isNull()), ["id"], "imp", 0.1)


@R.add(f"""WITH {TRACKING}, w AS (SELECT event, {', '.join(f"coalesce(max(CASE WHEN side = '{a}' AND node = {k + 1} THEN t{m} END), 0.0) AS {a}_{k}_{m}" for a in ('mate', 'opp') for k in range(2) for m in 'xy')} FROM trk GROUP BY event)
           {_rows(*((f'{m}_bounds', 'count(*) FILTER (WHERE ' + ' OR '.join(f'abs({a}_{k}_{m}) > {b}' for a in ('mate', 'opp') for k in range(2)) + ')', 'w') for m, b in (('x', 90), ('y', 40))))}
           UNION ALL SELECT 'wide_columns', false, CAST(2 * 4 * 2 + 2 * 2 * 9 AS BIGINT) UNION ALL {_rows(('unique_key', 'sum(e)', '(SELECT count(*) - 1 AS e FROM w GROUP BY mate_0_x, opp_0_x)'))}""")
def v05_gate_absolute(spark, d):
    t = tracking(spark, d).withColumns({"slot": F.col("node") - 1, "X": F.col("tx"), "Y": F.col("ty")})
    wide = O.slots_to_wide(t, ["event"], "side", "slot", ("mate", "opp"), 2, {"X": 0.0, "Y": 0.0})
    wide = wide.toDF(*[c.replace("mate_", "mate_Track_").replace("opp_", "opp_Track_") for c in wide.columns]).drop(*[f"{a}_Track_{k}_slot_vacant" for a in ("mate", "opp") for k in range(2)])
    at = lambda m: [f"{a}_Track_{k}_{m}" for a in ("mate", "opp") for k in range(2)]
    required = list(dict.fromkeys(V.wide_columns(("mate", "opp"), 2) + V.wide_columns(("mate", "opp"), 6, ("X", "Y"))))
    return V.gate_absolute(wide, at("X"), at("Y"), (90.0, 40.0), required, ["mate_Track_0_X", "opp_Track_0_X"])


@R.add(f"""WITH {EV}, g AS (SELECT game, period, t AS gt FROM ev WHERE type = 'goal'), j AS (SELECT ev.*, gt, id % 4 AS label, t + id % 100000 AS stop FROM ev ASOF LEFT JOIN g ON ev.game = g.game AND ev.period = g.period AND ev.t < g.gt)
           {_rows(('stored_horizon', f'count(*) FILTER (WHERE stop - t > {DAY / 20} + 1e-6)', 'j'), ('penalty_horizon', f"count(*) FILTER (WHERE type = 'faceoff' AND stop - t > {DAY / 20} + 1e-6)", 'j'), ('outcome_mask', "count(*) FILTER (WHERE type = 'shot' AND id % 3 <> 0)", 'j'),
                  ('index_bounds', 'count(*) FILTER (WHERE id >= 5000)', 'j'), ('horizon', f'count(*) FILTER (WHERE label IN (0, 1) AND (gt IS NULL OR gt - t > {DAY / 20} + 1e-6))', 'j'), ('label_domain', 'count(*) FILTER (WHERE label NOT IN (0, 1, 2))', 'j'))}""")
def v06_gate_labels(spark, d):
    e = events(spark, d).withColumns({"label": F.col("id") % 4, "stop": F.col("t") + F.col("id") % 100_000, "mask": F.col("id") % 3})
    return V.gate_labels(e, 5000, "id", "label", DAY / 20, end="stop", mask="mask", penalties=("faceoff",))


@R.add(f"""WITH {EV}, d AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM ev GROUP BY id)), b AS (SELECT count(*) FILTER (WHERE abs(x) > 90) AS bx, count(*) FILTER (WHERE abs(y) > 40) AS byy FROM ev)
           SELECT CASE WHEN n > 0 THEN 'fail' WHEN bx + byy > 0 THEN 'warn' ELSE 'pass' END AS status, CAST((SELECT count(*) FROM (SELECT unnest([bx, byy, n]) FROM b, d)) AS BIGINT) AS n_checks FROM d, b""")
def v07_combine_gates(spark, d):
    e = events(spark, d)
    return V.combine_gates(V.gate_absolute(e, ["x"], ["y"], (90.0, 40.0)), V.duplicate_keys(e, ["id"]), warn=("x_bounds", "y_bounds"))


@R.add(f"WITH {EV} {_rows(('score_mismatch', '(SELECT count(*) FROM (SELECT game, team, count(*) AS n, count(*) FILTER (WHERE period < 4) AS c FROM ev GROUP BY game, team) WHERE n <> c)', '(SELECT 1)'))}")
def v08_gate_scores(spark, d):
    g = events(spark, d).groupBy("game", "team").agg(F.count("*").alias("score"), F.sum((F.col("period") < 4).cast("long")).alias("counted"))
    return V.gate_scores(g.withColumns({"extra": F.lit(0), "allocated": F.lit(0)}))


_LINKS = f"""{EV}, inv AS (SELECT f.game, f.id - 150 AS kept, -coalesce(k.x, 0.0) AS net FROM ev f LEFT JOIN ev k ON k.game = f.game AND k.id = f.id - 150 WHERE f.type = 'faceoff'),
    res AS (SELECT game, kept, min(k.x) + sum(net) AS residual FROM (SELECT * FROM inv UNION ALL SELECT * FROM inv WHERE kept % 10 = 0) JOIN (SELECT game, id AS kept, x FROM ev) k USING (game, kept) GROUP BY game, kept)"""


def _links(spark, d):
    """Events with a net, and inverse rows, of which some stand twice."""
    e = events(spark, d).withColumn("net", F.col("x"))
    inv = inverse_rows(e, e.where("type = 'faceoff'").select("game", "id", (F.col("id") - 150).alias("kept")), ["game"], "kept", "net", "inverse")
    return e, inv.union(inv.where("kept % 10 = 0"))


@R.add(f"WITH {_LINKS} {_rows(('conservation', 'count(*) FILTER (WHERE abs(residual) > 1e-9)', 'res'))}")
def v09_check_conservation(spark, d):
    return V.check_conservation(*_links(spark, d), ["game"], "kept", "net")


@R.add(f"WITH {_LINKS} SELECT game, kept, residual FROM res")
def v09_conservation_residuals(spark, d):
    return V.conservation_residuals(*_links(spark, d), ["game"], "kept", "net")


@R.add(f"""WITH {EV} {_rows(('changed', "count(*) FILTER (WHERE id % 7 <> 0 AND id % 10 = 0 AND type <> 'goal')", 'ev'), ('lone_keys', 'count(*) FILTER (WHERE id % 7 = 0)', 'ev'), ('fewer_rows', 'count(*) FILTER (WHERE id % 7 <> 0 AND id % 12 = 0)', 'ev'))}""")
def v10_check_immutable(spark, d):
    e = events(spark, d).select("id", "type", "x")
    twice = e.union(e.where("id % 4 = 0"))
    moved = e.where("id % 7 <> 0").select("id", (F.col("x") + F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0)).alias("x"))
    return V.check_immutable(twice, moved.union(moved.where("id % 4 = 0 AND id % 12 <> 0")), ["id"], ["x"], exempt=F.col("type") == "goal")


@R.add(f"WITH {EV} {_rows(('net_identity', 'count(*) FILTER (WHERE id % 9 = 0)', 'ev'), ('penalty_range', 'count(*) FILTER (WHERE x < 0 OR x > 1)', 'ev'))}")
def v11_check_ledger(spark, d):
    e = events(spark, d).select("x", F.col("x").alias("credit_for"), F.col("y").alias("credit_against"), (F.col("x") - F.col("y") + F.when(F.col("id") % 9 == 0, 1.0).otherwise(0.0)).alias("credit_net"))
    return V.check_ledger(e, penalty="x")


@R.add(f"""WITH {EV}, l AS (SELECT *, t - lag(t) OVER (PARTITION BY game, period ORDER BY id) AS dt FROM ev)
           {_rows(('null_keys', 'count(*) FILTER (WHERE player IS NULL)', 'ev'), ('inversions', 'count(*) FILTER (WHERE dt < 0)', 'l'), ('not_finite', 'count(*) FILTER (WHERE id % 50 = 0)', 'ev'),
                  ('unique_key', 'sum(e)', '(SELECT count(*) - 1 AS e FROM ev GROUP BY game, player)'), ('class_support', 'count(*) FILTER (WHERE c < 5)', "(SELECT count(DISTINCT type) AS c FROM ev GROUP BY CASE WHEN type = 'whistle' THEN 'w' ELSE game END)"))}""")
def v12_gate_training(spark, d):
    e = events(spark, d).withColumns({"fold": F.when(F.col("type") == "whistle", "w").otherwise(F.col("game")), "z": F.when(F.col("id") % 50 == 0, float("inf")).otherwise(F.col("x"))})
    return V.gate_training(e, ["game", "player"], "type", "fold", ["z", "y"], 5, replace(S, order=("id",)))


@R.add(f"WITH {EV} {_rows(('zero_x', 'count(*) FILTER (WHERE type <> $$pass$$ AND x <> 0)', 'ev'), ('zero_y', 'count(*) FILTER (WHERE type <> $$pass$$ AND y <> 0)', 'ev'))}")
def v13_check_zero_padding(spark, d):
    return V.check_zero_padding(events(spark, d), ["x", "y"])


@R.add(f"""WITH {EV}, c AS (SELECT 0 AS step_no, 'raw' AS step, count(*) AS rows_after FROM ev UNION ALL SELECT 1, 'typed', count(*) FROM ev WHERE type <> 'whistle' UNION ALL SELECT 2, 'acted', count(*) FROM ev WHERE type <> 'whistle' AND player IS NOT NULL)
           SELECT *, lag(rows_after) OVER (ORDER BY step_no) AS rows_before, coalesce(lag(rows_after) OVER (ORDER BY step_no) - rows_after, 0) AS removed FROM c""")
def v14_step_counts(spark, d):
    path = folder(spark)
    steps = {"typed": lambda df: df.where("type <> 'whistle'"), "acted": lambda df: df.where("player IS NOT NULL")}
    return V.step_counts(events(spark, d), steps, lambda df: df.write.parquet(path))


@R.add(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE id % 3 <> 0) SELECT 'columns' AS "check", true AS passed, CAST(0 AS BIGINT) AS n UNION ALL {_rows(('index_range', 'count(*) FILTER (WHERE player IS NULL OR CAST(substr(player, 2) AS INT) >= 30)', 'k'))}
           UNION ALL SELECT 'coverage_player', count(player) >= 0.95 * count(*), count(*) - count(player) FROM k UNION ALL SELECT 'key_match', count(*) FILTER (WHERE id % 3 = 0) <= 0.05 * count(*), count(*) FILTER (WHERE id % 3 = 0) FROM ev""")
def v15_gate_inputs(spark, d):
    e = events(spark, d).withColumn("at", F.expr("substr(player, 2)"))
    return V.gate_inputs(e.where("id % 3 <> 0"), e, ["game", "event"], {"event": "id"}, ["game", "id"], index=("at", 30), coverage={"player": 0.95})
