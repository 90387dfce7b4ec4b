"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventry.operators import joins as J
from eventry.operators.windows import BEFORE
from eventry.plans.registry import Registry
from eventry.schema import DEFAULT as S
from eventry.testmap import EV, TRACKING, events, table, tracking

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_O = "PARTITION BY game, seq ORDER BY period, t, id"


def _dest_sql(agg: str, limit: str) -> str:
    return f"""
        n AS (SELECT *, row_number() OVER ({_O}) AS n FROM ev),
        s AS (SELECT *, last_value(CASE WHEN type = 'pass' THEN n END IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sn FROM n),
        h AS (SELECT game, seq, sn, {agg}(x, n) AS dx, {agg}(y, n) AS dy, {agg}(outcome, n) AS o FROM s WHERE type = 'faceoff' AND sn IS NOT NULL{limit} GROUP BY ALL)"""


@R.add(f"""WITH {EV}, {_dest_sql('arg_min', ' AND n - sn <= 3')}
           SELECT n.id, CASE WHEN type = 'pass' THEN coalesce(dx, x) ELSE 0 END AS dest_x, CASE WHEN type = 'pass' THEN coalesce(dy, y) ELSE 0 END AS dest_y
           FROM n LEFT JOIN h ON n.game = h.game AND n.seq = h.seq AND n.n = h.sn WHERE type <> 'faceoff'""")
def j01_pass_destination(spark, d):
    return J.attach_destination(events(spark, d), ["game", "seq"], ["period", "t", "id"], ["pass"], ["faceoff"], ["x", "y"]).select("id", "dest_x", "dest_y")


@R.add(f"""WITH {EV}, {_dest_sql('arg_max', '')}
           SELECT n.id, CASE WHEN type = 'pass' THEN coalesce(dx, x) ELSE 0 END AS dest_x, CASE WHEN o IS NOT NULL THEN outcome || ' | ' || o ELSE outcome END AS outcome
           FROM n LEFT JOIN h ON n.game = h.game AND n.seq = h.seq AND n.n = h.sn WHERE type <> 'faceoff'""")
def j02_pass_destination_text(spark, d):
    return J.attach_destination(events(spark, d), ["game", "seq"], ["period", "t", "id"], ["pass"], ["faceoff"], ["x"], None, "last", "outcome").select("id", "dest_x", "outcome")


@R.add(f"""WITH {EV}, l AS (SELECT * FROM ev WHERE type = 'goal'), r AS (SELECT game, t, id AS rid FROM ev WHERE type = 'faceoff'),
           b AS (SELECT l.id, l.t, r.t AS bt, rid AS b FROM l ASOF LEFT JOIN r ON l.game = r.game AND l.t >= r.t), f AS (SELECT l.id, r.t AS ft, rid AS f FROM l ASOF LEFT JOIN r ON l.game = r.game AND l.t <= r.t)
           SELECT id, CASE WHEN b IS NULL OR ft - t < t - bt THEN coalesce(f, b) ELSE b END AS match_id FROM b JOIN f USING (id)""")
def j03_asof_nearest(spark, d):
    e = events(spark, d)
    right = e.where("type = 'faceoff'").select("game", "t", F.col("id").alias("rid"))
    left = e.where("type = 'goal'").select("game", "t", "id")
    return J.asof_nearest(left, right, ["game"], "t", "t", ["rid"], tie="rid").select("id", F.col("match.rid").alias("match_id"))


@R.add(f"WITH {EV}, s AS (SELECT game, period, t AS n FROM ev WHERE type = 'whistle') SELECT id, n AS next_time FROM ev ASOF LEFT JOIN s ON ev.game = s.game AND ev.period = s.period AND ev.t < s.n")
def j04_next_time(spark, d):
    return J.next_time(events(spark, d), ["whistle"], ["game", "period"]).select("id", "next_time")


@R.add(f"WITH {EV}, s AS (SELECT game, period, t AS n, team AS g FROM ev WHERE type = 'goal') SELECT id, n AS goal_time, g AS goal_team FROM ev ASOF LEFT JOIN s ON ev.game = s.game AND ev.period = s.period AND ev.t < s.n")
def j05_next_payload(spark, d):
    return J.next_payload(events(spark, d), ["goal"], ["game", "period"], "t", ["team"]).select("id", F.col("_next.t").alias("goal_time"), F.col("_next.team").alias("goal_team"))


@R.add(f"""WITH {EV}, p AS (SELECT * FROM ev WHERE type = 'faceoff'), g AS (SELECT game, period, t, id AS gid, team AS g FROM ev WHERE type = 'goal')
           SELECT p.id, gid, g.g AS goal_team FROM p LEFT JOIN g ON p.game = g.game AND p.period = g.period AND g.t BETWEEN p.t AND p.t + 7200
           QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY g.t, gid) = 1""")
def j06_first_in_range(spark, d):
    e = events(spark, d)
    goals = e.where("type = 'goal'").select("game", "period", "t", F.col("id").alias("gid"), F.col("team").alias("goal_team"))
    out = J.first_in_range(e.where("type = 'faceoff'").select("game", "period", "t", "id"), goals, ["game", "period"], "t", 0, 7200, ["gid", "goal_team"], tie="gid")
    return out.select("id", "match.gid", "match.goal_team")


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j07_join_context(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    ctx = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderpriority")
    return J.join_context(li, ctx.unionByName(ctx), ["k"], ["o_custkey"]).withColumnRenamed("k", "l_orderkey")


@R.add(f"""WITH {EV}, roster AS (SELECT DISTINCT game, period, team, player FROM ev WHERE player IS NOT NULL AND team IS NOT NULL), g AS (SELECT * FROM roster WHERE CAST(substr(player, 2) AS INT) < 8)
           SELECT game, period, min(CASE WHEN team = 'T0' THEN player END) AS home_player, min(CASE WHEN team = 'T1' THEN player END) AS away_player FROM (SELECT DISTINCT game, period FROM ev) LEFT JOIN g USING (game, period) GROUP BY ALL""")
def j08_role_on_ice(spark, d):
    e = events(spark, d)
    roster = e.where("player IS NOT NULL AND team IS NOT NULL").select("game", "period", "player", F.when(F.col("team") == "T0", "home").otherwise("away").alias("side")).distinct()
    ids = roster.where(F.expr("substr(player, 2)").cast("int") < 8)
    return J.role_on_ice(e.select("game", "period").distinct(), roster, ids, ["game", "period"])


@R.add(f"WITH {EV} SELECT id, CASE WHEN team = 'T0' THEN y WHEN team IS NOT NULL THEN x END AS other FROM ev")
def j09_opposing_value(spark, d):
    return J.opposing_value(events(spark, d).withColumn("home", F.lit("T0")), "team", "home", "x", "y", "other").select("id", "other")


@R.add("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY l_orderkey")
def j10_restrict_to_keys(spark, d):
    keys = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.restrict_to_keys(table(spark, d, "lineitem"), keys, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@R.add(f"""WITH {TRACKING} SELECT event, node, member FROM trk WHERE (event, member) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N') AND member NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def j11_roster_filter(spark, d):
    roster = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("member"))
    out = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("member"))
    return J.roster_filter(tracking(spark, d), roster, ["event"], out, "member").select("event", "node", "member")


@R.add(f"WITH {TRACKING} SELECT o_orderstatus, side, count(*) AS n, sum(tx) AS tx FROM trk LEFT JOIN orders ON event = o_orderkey GROUP BY ALL")
def j12_join_event_context(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), "o_orderstatus")
    return J.join_event_context(tracking(spark, d), o, ["event"], ["o_orderstatus"]).groupBy("o_orderstatus", "side").agg(F.count("*").alias("n"), F.sum("tx").alias("tx"))


_SPINE = "sp AS (SELECT id, x, CASE WHEN id % 4 <> 0 THEN y END AS y FROM ev), pr AS (SELECT id, x / 10 AS p, value AS y FROM ev WHERE id % 3 = 0)"


def _spine(spark, d):
    e = events(spark, d)
    return e.select("id", "x", F.when(F.col("id") % 4 != 0, F.col("y")).alias("y")), e.where("id % 3 = 0").select("id", (F.col("x") / 10).alias("p"), F.col("value").alias("y")), e.where("id % 5 = 0").select("id", "outcome")


@R.add(f"WITH {EV}, {_SPINE} SELECT id, sp.x, coalesce(sp.y, pr.y) AS y, p, outcome FROM sp LEFT JOIN pr USING (id) LEFT JOIN (SELECT id, outcome FROM ev WHERE id % 5 = 0) USING (id)")
def j13_enrich_spine(spark, d):
    sp, pr, ex = _spine(spark, d)
    return J.enrich_spine(sp, pr, ex, ["id"], ["y"]).select("id", "x", "y", "p", "outcome")


@R.add(f"WITH {EV}, {_SPINE} SELECT id, sp.x, coalesce(pr.y, sp.y) AS y, p FROM sp LEFT JOIN pr USING (id)")
def j14_overlay_on_spine(spark, d):
    sp, pr, _ = _spine(spark, d)
    return J.overlay_on_spine(pr, sp, ["id"], ["y", "p"]).select("id", "x", "y", "p")


@R.add(f"""WITH {EV}, a AS (SELECT DISTINCT game, id FROM ev WHERE id % 3 <> 0), b AS (SELECT DISTINCT game, id FROM ev WHERE id % 2 = 0)
           SELECT game, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.id IS NULL) AS n_left_only, count(*) FILTER (WHERE a.id IS NULL) AS n_right_only FROM a FULL JOIN b USING (game, id) GROUP BY game""")
def j15_key_parity(spark, d):
    e = events(spark, d)
    return J.key_parity(e.where("id % 3 <> 0"), e.where("id % 2 = 0"), ["game", "id"], "game")


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def j16_align_keys(spark, d):
    o = table(spark, d, "orders")
    return J.align_keys(o.select("o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'F'"), ["o_orderkey"])


@R.add("SELECT s_suppkey, coalesce(n_name, 'none') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def j17_map_lookup(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.map_lookup(table(spark, d, "supplier"), n, "s_nationkey", "n_name", "none").select("s_suppkey", "n_name")


@R.add(f"""WITH {EV}, t AS (SELECT game, list_sort(list(DISTINCT team)) AS a FROM ev WHERE team IS NOT NULL GROUP BY game)
           SELECT game, a[1] AS team, a[2] AS opponent FROM t WHERE len(a) = 2 UNION ALL SELECT game, a[2], a[1] FROM t WHERE len(a) = 2""")
def j18_opponent_map(spark, d):
    return J.opponent_map(events(spark, d))


_INVERSE = "0.0 - net AS net, greatest(0.0 - net, 0.0) AS adj_for, greatest(net, 0.0) AS adj_against"


# Kept rows come twice, the later copy with another net; links of odd ids have no row, every seventh row no net.
@R.add(f"""WITH {EV}, b AS (SELECT game, id, CASE WHEN id % 7 > 0 THEN x END AS net FROM ev), s AS (SELECT game, id, type, CASE WHEN id % 2 = 0 THEN lag(id) OVER (PARTITION BY game ORDER BY period, t, id) ELSE -5 END AS kept FROM ev)
           SELECT s.game, s.id, kept, {_INVERSE}, 'faceoff_inverse' AS credit_source FROM s JOIN b ON s.game = b.game AND s.kept = b.id WHERE net IS NOT NULL AND type = 'faceoff'""")
def j19_inverse_rows(spark, d):
    e = events(spark, d).select("game", "id", "type", F.when(F.col("id") % 7 > 0, F.col("x")).alias("net"), F.lit(1).alias("copy"))
    base = e.union(e.withColumns({"net": F.lit(7.0), "copy": F.lit(2)}))
    links = events(spark, d).withColumn("kept", F.when(F.col("id") % 2 == 0, F.lag("id").over(S.window())).otherwise(-5))
    side = links.where("type = 'faceoff'").select("game", "id", "kept")
    return J.inverse_rows(base, side, ["game"], "kept", "net", "faceoff_inverse", order=["copy"]).select("game", "id", "kept", "net", "adj_for", "adj_against", "credit_source")


@R.add(f"""WITH {EV}, b AS (SELECT game, id, y AS net FROM ev WHERE type = 'pass'), s AS (SELECT game, id, type, lag(id) OVER (PARTITION BY game ORDER BY period, t, id) AS kept FROM ev)
           SELECT s.game, s.id, kept, {_INVERSE}, 'penalty_drawer_inverse' AS credit_source FROM s JOIN b ON s.game = b.game AND s.kept = b.id WHERE s.type = 'whistle'""")
def j20_penalty_inverse_rows(spark, d):
    e = events(spark, d).withColumn("net", F.col("y"))
    side = e.withColumn("kept", F.lag("id").over(S.window())).where("type = 'whistle'").select("game", "id", "kept")
    return J.inverse_rows(e, side, ["game"], "kept", "net", "penalty_drawer_inverse", base_type="pass").select("game", "id", "kept", "net", "adj_for", "adj_against", "credit_source")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j21_drop_keys(spark, d):
    return J.drop_keys(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@R.add("SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j22_attach_source(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return J.attach_source(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), o, ["l_orderkey"])


@R.add(f"""WITH {EV}, o AS (SELECT game, team, count(*) AS score FROM ev WHERE type = 'goal' AND team IS NOT NULL GROUP BY ALL), c AS (SELECT game, team, count(*) AS counted FROM ev WHERE type = 'goal' AND period < 4 GROUP BY ALL),
           x AS (SELECT game, team, count(*) AS extra FROM ev WHERE type = 'goal' AND period = 4 GROUP BY ALL), u AS (SELECT game, count(*) AS unassigned FROM ev WHERE type = 'goal' AND period = 5 GROUP BY ALL)
           SELECT game, team, score, coalesce(counted, 0) AS counted, coalesce(extra, 0) AS extra, coalesce(unassigned, 0) AS unassigned, score - coalesce(counted, 0) - coalesce(extra, 0) AS deficit
           FROM o LEFT JOIN c USING (game, team) LEFT JOIN x USING (game, team) LEFT JOIN u USING (game)""")
def j23_reconcile(spark, d):
    g = events(spark, d).where("type = 'goal'")
    n = lambda df, keys, out: df.groupBy(*keys).agg(F.count("*").alias(out))
    k = ["game", "team"]
    return J.reconcile(n(g.where("team IS NOT NULL"), k, "score"), n(g.where("period < 4"), k, "counted"), n(g.where("period = 4"), k, "extra"), n(g.where("period = 5"), ["game"], "unassigned"))


@R.add(f"WITH {EV}, o AS (SELECT id % 500 AS k, arg_max(value, id) AS v FROM ev GROUP BY 1) SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN x END, v) AS x FROM ev LEFT JOIN o ON id % 500 = k")
def j24_backfill(spark, d):
    e = events(spark, d).withColumn("k", F.col("id") % 500)
    return J.backfill(e.withColumn("x", F.when(F.col("id") % 3 != 0, F.col("x"))), e.withColumn("x", F.col("value")).select("k", "x", "id"), ["k"], ["x"], "id").select("id", "x")


@R.add(f"WITH {EV} SELECT a.game, a.period, a.seq, a.x AS value_a, b.x AS value_b FROM ev a JOIN ev b ON a.game = b.game AND a.period = b.period AND a.seq = b.seq WHERE a.type = 'goal' AND b.type = 'faceoff'")
def j25_pair_rows(spark, d):
    return J.pair_rows(events(spark, d), "goal", "faceoff", ["game", "period", "seq"], "x")


@R.add(f"""WITH {EV}, e AS (SELECT *, lag(id) OVER w AS prev_id, lag(x) OVER w AS prev_x, last_value(CASE WHEN type = 'shot' THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_id FROM ev WINDOW w AS (PARTITION BY game ORDER BY period, t, id))
           SELECT game, id, source_id, prev_id, prev_x FROM e WHERE type = 'goal' AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game, source_id ORDER BY id DESC) = 1""")
def j26_link_chain(spark, d):
    e = events(spark, d)
    w = S.window()
    links = e.withColumns({"prev_id": F.lag("id").over(w), "source_id": F.last(F.when(F.col("type") == "shot", F.col("id")), ignorenulls=True).over(w.rowsBetween(*BEFORE))}).where("source_id IS NOT NULL")
    return J.link_chain(e.where("type = 'goal'").select("game", "id"), links, e, ["game"], payload=("x",)).select("game", "id", "source_id", "prev_id", "prev_x")


@R.add(f"""WITH {TRACKING}, p AS (SELECT a.event, a.node AS u, b.node AS v, row_number() OVER (PARTITION BY a.event, a.node ORDER BY sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty)), b.node) AS r
           FROM trk a JOIN trk b ON a.event = b.event AND a.node <> b.node), k AS (SELECT event, u, v FROM p WHERE r <= 3) SELECT event, u, v FROM k UNION SELECT event, v, u FROM k""")
def j27_knn_edges(spark, d):
    return J.knn_edges(tracking(spark, d), ["event"], "node", "tx", "ty")


@R.add(f"WITH {EV} SELECT count(*) AS n, count(*) FILTER (WHERE id % 3 = 0) AS n_matched, count(*) FILTER (WHERE id % 3 = 0) / count(*) AS rate FROM ev")
def j28_key_match_rate(spark, d):
    e = events(spark, d)
    return J.key_match_rate(e, e.where("id % 3 = 0"), ["game", "id"])
