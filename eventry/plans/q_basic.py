"""Queries of scans, projections, scalar functions, sorts, sets and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventry.functions import scalars as C
from eventry.operators import aggregates as A
from eventry.operators import project as P
from eventry.operators import windows as W
from eventry.plans.registry import Registry, folder
from eventry.sources import tables as S
from eventry.sources.tables import scan_events, scan_parquet
from eventry.testmap import EV, SCORED, TRACKING, events, scored, table, tracking

R = Registry()


QUERIES, ORACLES = R.queries, R.oracles


@R.add("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def s01_scan_parquet(spark, d):
    return scan_parquet(spark, f"{d}/events.parquet", ["event_type", "value"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@R.add("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def s07_scan_events(spark, d):
    from pyspark.sql import Window

    e = scan_events(spark, f"{d}/events.parquet", ["event_id", "user_id", "ts"], ["ts", "event_id"])
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ingest_order")).alias("place"))


# The rows lie in the order of ts and event_id.
@R.add("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def s07_ingest_order(spark, d):
    from pyspark.sql import Window

    e = scan_events(spark, f"{d}/events.parquet", ["event_id", "user_id"])
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ingest_order")).alias("place"))


@R.add(f"WITH {EV} SELECT id, period, t FROM ev WHERE period <= 4 AND (period < 4 OR t < 300000)")
def f01_filter_time_boundary(spark, d):
    return P.filter_time_boundary(events(spark, d), cutoff=300_000.0).select("id", "period", "t")


@R.add(f"WITH {EV} SELECT period = 5 OR coalesce(player = 'P3', false) AS noise, count(*) AS n FROM ev WHERE NOT (period = 5 OR coalesce(player = 'P3', false)) OR type = 'goal' GROUP BY 1")
def f02_split_noise(spark, d):
    kept, extra = P.split_noise(events(spark, d), (F.col("period") == 5) | (F.col("player") == "P3"), F.col("type") == "goal")
    n = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("noise"), "n")
    return n(kept, False).union(n(extra, True))


@R.add(f"WITH {EV} SELECT id, type FROM ev WHERE type NOT IN ('whistle', 'faceoff')")
def f03_drop_types(spark, d):
    return P.drop_types(events(spark, d), ["whistle", "faceoff"]).select("id", "type")


@R.add(f"WITH {EV} SELECT type, count(*) AS n FROM ev WHERE NOT (type IN ('goal', 'shot') AND player IS NULL) GROUP BY type")
def f04_drop_types_without_actor(spark, d):
    return P.drop_types_without_actor(events(spark, d), ["goal", "shot"]).groupBy("type").agg(F.count("*").alias("n"))


@R.add("SELECT count(*) FILTER (WHERE source = 'src1') AS source, count(*) FILTER (WHERE n_chars > 5000) AS long FROM documents")
def f05_drop_leak_rows(spark, d):
    return P.drop_leak_rows(table(spark, d, "documents"), {"source": F.col("source") == "src1", "long": F.col("n_chars") > 5000})[1]


@R.add(f"WITH {EV} SELECT player, count(*) AS n FROM ev WHERE player IS NOT NULL AND player <> 'P1' GROUP BY player")
def f08_filter_valid_ids(spark, d):
    e = events(spark, d).withColumn("player", F.when(F.col("player") == "P1", "None").otherwise(F.col("player")))
    return P.filter_valid_ids(P.drop_null_entities(e, "player"), "player").groupBy("player").agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, lang AS language, source AS origin FROM documents")
def f10_alias_columns(spark, d):
    return P.project_contract(P.alias_columns(table(spark, d, "documents"), {"lang": "language", "source": "origin", "absent": "x"}), ["doc_id", "language", "origin"])


@R.add(f"WITH {EV} SELECT id, CASE WHEN type <> 'shot' THEN outcome END AS outcome, CASE WHEN type = 'shot' THEN 0 ELSE 1 END AS outcome_id FROM ev")
def f12_mask_outcome(spark, d):
    e = events(spark, d).withColumn("outcome_id", F.lit(None).cast("int"))
    return P.mask_outcome(e, ["shot"]).select("id", "outcome", "outcome_id")


@R.add("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_tax END AS l_tax FROM lineitem")
def f13_sanitize_numeric(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"))
    return P.sanitize_numeric(li, ["l_quantity", "l_tax"])


@R.add("""WITH m AS (SELECT quantile_cont(l_tax, 0.5) FILTER (WHERE l_linenumber > 1) AS tax, quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_linenumber <> 2) AS price FROM lineitem)
          SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN tax ELSE l_tax END AS l_tax, CASE WHEN l_linenumber = 2 THEN price ELSE l_extendedprice END AS l_extendedprice FROM lineitem, m""")
def f13_median(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    return P.sanitize_numeric(li, ["l_tax", "l_extendedprice"], "median")


@R.add(f"""WITH {EV} SELECT id, CASE WHEN coalesce(team = 'T0', false) THEN x ELSE y END AS pos_own, CASE WHEN coalesce(team = 'T0', false) THEN y ELSE x END AS pos_opp,
           greatest(least(CASE WHEN period >= 4 THEN 300.0 ELSE 1200.0 END - t, 1200.0), 0.0) AS time_remaining FROM ev""")
def f14_possession_relative(spark, d):
    e = events(spark, d).withColumn("home", F.lit("T0"))
    return P.possession_relative(e, "home", {"pos": ("x", "y")}).select("id", "pos_own", "pos_opp", F.col("time_remaining").cast("double"))


@R.add(f"""WITH {EV} SELECT id, -(CASE WHEN CAST(game AS INT) % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN period % 2 = 1 THEN 1 ELSE -1 END) * (CASE WHEN coalesce(team = 'T0', false) THEN 1 ELSE -1 END) AS attack_direction,
           89.0 * -(CASE WHEN CAST(game AS INT) % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN period % 2 = 1 THEN 1 ELSE -1 END) * (CASE WHEN coalesce(team = 'T0', false) THEN 1 ELSE -1 END) AS target_net_x FROM ev""")
def f15_direction_anchors(spark, d):
    e = events(spark, d)
    games = e.select("game").distinct().select("game", F.lit("T0").alias("home_team"), F.when(F.col("game").cast("int") % 2 == 0, "pos_x").otherwise("neg_x").alias("home_start_net"))
    return P.direction_anchors(e, games).select("id", "attack_direction", "target_net_x")


@R.add(f"WITH {EV}, q AS (SELECT *, (x + 100) / 200 AS a, (y + 42) / 85 AS b FROM ev) SELECT id, CASE WHEN type = 'goal' THEN 1.0 ELSE a END AS a, CASE WHEN type = 'goal' THEN 0.0 ELSE b END AS b, CASE WHEN type = 'goal' THEN 0.0 ELSE 1 - a - b END AS c FROM q")
def f16_override_goal_probs(spark, d):
    e = events(spark, d).withColumns({"a": (F.col("x") + 100) / 200, "b": (F.col("y") + 42) / 85}).withColumn("c", 1 - F.col("a") - F.col("b"))
    return P.override_goal_probs(e, ("a", "b", "c")).select("id", "a", "b", "c")


@R.add(f"""WITH {EV}, a AS (SELECT id, game, type, player, x / 100 + CASE WHEN type = 'faceoff' THEN 0.02 ELSE 0 END AS f, y / 100 + CASE WHEN type = 'faceoff' THEN 0.2 ELSE 0 END AS g FROM ev)
           SELECT game, player, count(*) AS n, sum(f) AS credit_for, sum(g) AS credit_against, sum(f - g) AS credit_net FROM a WHERE type NOT IN ('save', 'whistle', 'goal') AND player IS NOT NULL GROUP BY game, player""")
def f19_player_ledger(spark, d):
    e = events(spark, d).withColumns({"delta_for": F.col("x") / 100, "delta_against": F.col("y") / 100})
    ledger = P.player_ledger(P.adjust_penalty_taker(e, penalty="faceoff"), ["game", "id"])
    return ledger.groupBy("game", "player").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("credit_for", "credit_against", "credit_net")])


@R.add("SELECT doc_id, trim(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[+-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS clean FROM documents")
def c01_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.normalize_text(F.col("text")).alias("clean"))


@R.add("SELECT item_id, regexp_matches(text, '\\bthe\\b|\\bof\\b', 'i') AS leak, nullif(trim(regexp_replace(regexp_replace(lower(text), '\\bthe\\b|\\bof\\b', ' ', 'g'), '\\s+', ' ', 'g')), '') AS clean FROM benchmark")
def c03_strip_leaks(spark, d):
    words = r"\bthe\b|\bof\b"
    return table(spark, d, "benchmark").select("item_id", C.has_leak(F.col("text"), words).alias("leak"), C.strip_leaks(F.col("text"), words).alias("clean"))


@R.add("""WITH t AS (SELECT item_id, [trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ,._:-') FOR x IN regexp_split_to_array(lower(text), '[,;|/]')] AS a FROM benchmark)
          SELECT item_id, array_to_string([x FOR x, i IN a IF x <> '' AND list_position(a, x) = i], ', ') AS flags FROM t""")
def c04_tokenize_flags(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(C.tokenize_flags(F.col("text")), ", ").alias("flags"))


@R.add("SELECT o_orderkey, 60.0 * (o_orderkey % 60) + o_orderkey % 7 AS clock, CAST(o_orderkey AS DOUBLE) AS plain FROM orders")
def c07_to_seconds(spark, d):
    k = F.col("o_orderkey")
    clock = F.concat_ws(":", (k % 60).cast("string"), F.lpad((k % 7).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", C.to_seconds(clock).alias("clock"), C.to_seconds(k.cast("string")).alias("plain"))


@R.add("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%double%' AND lower(p_type) LIKE '%minor%' THEN 'double_minor' WHEN contains(lower(p_type), 'e') THEN 'major' WHEN contains(lower(p_type), 'o') THEN 'minor' ELSE 'other' END AS class FROM part""")
def c08_classify_text(spark, d):
    rules = ((("double", "minor"), "double_minor"), (("e",), "major"), (("o",), "minor"))
    return table(spark, d, "part").select("p_partkey", C.classify_text(F.col("p_type"), rules).alias("class"))


@R.add(f"WITH {EV} SELECT id, sqrt((89 - x) * (89 - x) + y * y) AS distance, atan2(0 - y, 89 - x) AS angle, CASE WHEN abs(x) <= 5 THEN 'center' WHEN abs(x) <= 25 THEN 'near' ELSE 'far' END AS band, least(greatest(x, -50), 50) AS clipped FROM ev")
def c10_distance_and_angle(spark, d):
    x, y = F.col("x"), F.col("y")
    return events(spark, d).select("id", C.distance_to(x, y).alias("distance"), C.angle_to(x, y).alias("angle"), C.band(x).alias("band"), C.clip(x, -50.0, 50.0).alias("clipped"))


@R.add(f"WITH {EV} SELECT id, CASE WHEN period % 2 = 0 THEN -x ELSE x END AS x, CASE WHEN period % 2 = 0 THEN -y ELSE y END AS y FROM ev")
def c11_flip_coordinates(spark, d):
    return P.flip_coordinates(events(spark, d), F.col("period") % 2 == 0, ["x", "y"]).select("id", "x", "y")


@R.add(f"""WITH {SCORED}, c AS (SELECT doc_id, greatest(least(p0, 1), 1e-12) AS a, greatest(least(p1, 1), 1e-12) AS b, greatest(least(p2, 1), 1e-12) AS c FROM sc)
           SELECT doc_id, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM c""")
def c18_normalize_probs(spark, d):
    p = C.normalize_probs([F.col(c) for c in ("p0", "p1", "p2")])
    return scored(spark, d).select("doc_id", *[c.alias(f"p{i}") for i, c in enumerate(p)])


@R.add("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def o02_top_k(spark, d):
    return P.top_k(table(spark, d, "part"), 3, [F.desc("p_retailprice"), F.asc("p_partkey")], ["p_brand"]).select("p_brand", "p_partkey", "p_retailprice")


@R.add(f"WITH {EV} SELECT game, seq, id, type FROM ev QUALIFY row_number() OVER (PARTITION BY game, seq ORDER BY period, t, id) = 1")
def o04_first_per(spark, d):
    return P.first_per(events(spark, d), ["game", "seq"], ["period", "t", "id"]).select("game", "seq", "id", "type")


@R.add("SELECT s_suppkey AS key, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u01_union_aligned(spark, d):
    return P.union_aligned(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


@R.add("SELECT o_orderkey, 'key' AS side, CAST(o_custkey AS DOUBLE) AS v FROM orders UNION ALL SELECT o_orderkey, 'price', o_totalprice FROM orders")
def u02_unpivot_sides(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey").cast("double"))
    return P.unpivot_sides(o, ["o_orderkey"], {"key": {"v": "k"}, "price": {"v": "o_totalprice"}})


@R.add("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u03_set_difference(spark, d):
    return P.set_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@R.add("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u04_distinct_rows(spark, d):
    return P.distinct_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@R.add(f"WITH {EV} SELECT game, team, count(*) AS n FROM ev WHERE type = 'goal' GROUP BY game, team")
def a01_count_by(spark, d):
    return A.count_by(events(spark, d), "goal", ["game", "team"])


@R.add(f"""WITH {EV}, g AS (SELECT game, coalesce(team, '?') AS team, count(*) AS deficit FROM ev WHERE type = 'goal' GROUP BY ALL),
           u AS (SELECT game, count(*) // 9 AS units FROM ev GROUP BY game), j AS (SELECT * FROM g JOIN u USING (game)),
           k AS (SELECT game, team, deficit - k + 1 AS p, units, k FROM j, unnest(range(1, deficit + 1)) t(k)),
           r AS (SELECT game, team, count(*) AS a FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY p DESC, team) AS r FROM k) WHERE r <= units GROUP BY ALL)
           SELECT game, team, deficit, units, coalesce(a, 0) AS allocated FROM j LEFT JOIN r USING (game, team)""")
def a03_allocate_units(spark, d):
    e = events(spark, d)
    g = e.where("type = 'goal'").groupBy("game", F.coalesce("team", F.lit("?")).alias("team")).agg(F.count("*").alias("deficit"))
    u = e.groupBy("game").agg(F.floor(F.count("*") / 9).alias("units"))
    return A.allocate_units(g.join(u, "game"), "game", "deficit", "units", "team").select("game", "team", "deficit", "units", "allocated")


_STATS = """count(*) AS n, sum(CAST(quality AS DOUBLE)) AS quality_sum, avg(quality) AS quality_mean, coalesce(stddev_samp(quality), 0) AS quality_std, coalesce(stddev_samp(quality), 0) / sqrt(count(quality)) AS quality_sem,
            avg(quality) - 1.96 * coalesce(stddev_samp(quality), 0) / sqrt(count(quality)) AS quality_low, avg(quality) + 1.96 * coalesce(stddev_samp(quality), 0) / sqrt(count(quality)) AS quality_high"""


@R.add(f"WITH {SCORED} SELECT source, {_STATS} FROM sc GROUP BY source")
def a04_outcome_table(spark, d):
    return A.outcome_table(scored(spark, d), "source", ["quality"])


@R.add(f"WITH {SCORED} SELECT CASE WHEN grouping(source) = 1 THEN '__all__' ELSE source END AS source, {_STATS} FROM sc GROUP BY ROLLUP (source)")
def a05_with_total(spark, d):
    return A.with_total(scored(spark, d), "source", ["quality"])


_ZONED = "z AS (SELECT CASE WHEN x > 25.5 THEN 'oz' WHEN x < -25.5 THEN 'dz' ELSE 'nz' END AS zone, (value % 10) / 10 AS f, (value % 7) / 10 AS a FROM ev WHERE type = 'faceoff')"


@R.add(f"""WITH {EV}, {_ZONED}, m AS (SELECT avg(f) FILTER (WHERE zone = 'oz') AS of, avg(a) FILTER (WHERE zone = 'oz') AS oa, avg(f) FILTER (WHERE zone = 'dz') AS df, avg(a) FILTER (WHERE zone = 'dz') AS da,
           avg(f) FILTER (WHERE zone = 'nz') AS nf, avg(a) FILTER (WHERE zone = 'nz') AS na FROM z)
           SELECT 'oz' AS zone, (of + da) / 2 AS base_for, (oa + df) / 2 AS base_against FROM m UNION ALL SELECT 'dz', (oa + df) / 2, (of + da) / 2 FROM m UNION ALL SELECT 'nz', (nf + na) / 2, (nf + na) / 2 FROM m""")
def a06_zone_baselines(spark, d):
    from eventry.operators.windows import zone

    f = events(spark, d).where("type = 'faceoff'").select(zone(F.col("x")).alias("zone"), (F.col("value") % 10 / 10).alias("f"), (F.col("value") % 7 / 10).alias("a"))
    return A.zone_baselines(f, "zone", "f", "a")


@R.add(f"""WITH {EV} SELECT player, team, count(*) FILTER (WHERE type = 'shot') AS shot_n, coalesce(sum(x) FILTER (WHERE type = 'shot'), 0) AS shot_net, count(*) FILTER (WHERE type = 'pass') AS pass_n,
           coalesce(sum(x) FILTER (WHERE type = 'pass'), 0) AS pass_net, count(*) AS total_n, sum(x) AS total_net FROM ev GROUP BY player, team""")
def a07_pivot_summary(spark, d):
    return A.pivot_summary(events(spark, d), ["player", "team"], "type", "x", ["shot", "pass"])


@R.add(f"WITH {EV} SELECT period, type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY period) AS share FROM ev GROUP BY period, type")
def a08_class_distribution(spark, d):
    return A.class_distribution(events(spark, d), "type", "period")


@R.add(f"WITH {EV} SELECT id, least(max(t) OVER (PARTITION BY game, period), 500000.0) AS cap FROM ev")
def a09_capped_group_max(spark, d):
    return A.capped_group_max(events(spark, d), ["game", "period"], "t", 500_000.0).select("id", "cap")


@R.add("SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a10_duplicate_stats(spark, d):
    return A.duplicate_stats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("SELECT quantile_cont(l_quantity, 0.99) AS l_quantity, quantile_cont(l_extendedprice, 0.99) AS l_extendedprice FROM lineitem")
def a11_fill_stats(spark, d):
    return A.fill_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 0.99)


# The exact rank of a value that the merged sketches give must be near the quantile.
@R.add("SELECT 'l_quantity' AS \"column\", true AS near UNION ALL SELECT 'l_extendedprice', true")
def a11_quantile_sketches(spark, d):
    li, cols = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    found = A.merged_quantiles(A.quantile_sketches(li, ["l_returnflag", "l_linenumber"], cols), cols, 0.9).withColumnsRenamed({c: f"q_{c}" for c in cols})
    share = lambda c, op: F.avg(F.when(op(F.col(c), F.col(f"q_{c}")), 1.0).otherwise(0.0))
    one = li.join(F.broadcast(found)).agg(*[((share(c, lambda a, b: a < b) <= 0.93) & (share(c, lambda a, b: a <= b) >= 0.87)).alias(c) for c in cols])  # one row
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("near")) for c in cols])).alias("r")).select("r.*")


@R.add(f"WITH {EV}, m AS (SELECT count(*) AS n, count(*) - count(team) AS a, count(*) - count(player) AS b FROM ev) SELECT 'team' AS \"column\", a AS n_missing, a / n AS share FROM m UNION ALL SELECT 'player', b, b / n FROM m")
def a12_missing_report(spark, d):
    return A.missing_report(events(spark, d), ["team", "player"])


@R.add("SELECT count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem")
def a13_distinct_sketches(spark, d):
    li = table(spark, d, "lineitem")
    found = A.merged_distinct(A.distinct_sketches(li, ["l_returnflag", "l_linenumber"], ["l_partkey"]), ["l_partkey"])
    exact = li.agg(F.count_distinct("l_partkey").alias("exact"))
    return exact.join(F.broadcast(found)).select("exact", (F.abs(F.col("n_l_partkey") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))  # one row


@R.add(r"""WITH w AS (SELECT unnest(string_split_regex(text, '[ \t\n\v\f\r]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word)
           SELECT word, n FROM c WHERE n >= 0.002 * (SELECT sum(n) FROM c)""")
def a14_frequent_words(spark, d):
    return A.frequent_words(table(spark, d, "documents"), F.col("text"), 0.002)


@R.add("SELECT count(DISTINCT text) AS n_text, count(DISTINCT source) AS n_source FROM documents")
def a13_distinct_counts(spark, d):
    return A.distinct_counts(table(spark, d, "documents"), ["text", "source"])


@R.add("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[+-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY w")
def a14_word_frequency(spark, d):
    return A.word_frequency(table(spark, d, "benchmark"), C.normalize_text(F.col("text")))


@R.add("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity FROM lineitem)")
def a15_zscore(spark, d):
    return A.zscore(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


@R.add(f"""WITH {EV} SELECT game, seq, count(*) AS n, arg_min(type, (period, t, id)) AS first_type, arg_max(type, (period, t, id)) AS last_type, first(team ORDER BY period DESC, t DESC, id DESC) AS last_team, max(t) - min(t) AS seconds FROM ev GROUP BY game, seq""")
def a16_sequence_summary(spark, d):
    return A.sequence_summary(events(spark, d))


@R.add(f"WITH {EV} SELECT last_type, count(*) AS n FROM (SELECT arg_max(type, (period, t, id)) AS last_type FROM ev GROUP BY game, seq) GROUP BY last_type")
def a17_terminal_distribution(spark, d):
    return A.terminal_distribution(events(spark, d))


@R.add(f"""WITH {EV}, s AS (SELECT game, period, list_sort(list(DISTINCT player) FILTER (WHERE player IS NOT NULL)) AS cur FROM ev GROUP BY game, period),
           p AS (SELECT *, coalesce(lag(cur) OVER (PARTITION BY game ORDER BY period), []) AS was FROM (SELECT game, period, coalesce(cur, []) AS cur FROM s))
           SELECT game, period, array_to_string([x FOR x IN cur IF NOT list_contains(was, x)], ',') AS entered, array_to_string([x FOR x IN was IF NOT list_contains(cur, x)], ',') AS exited,
                  array_to_string([x FOR x IN cur IF list_contains(was, x)], ',') AS persisted FROM p""")
def a18_membership_changes(spark, d):
    return A.membership_changes(events(spark, d), ["game"], "period", "player")


@R.add(f"WITH {SCORED} SELECT count(*) AS n, avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss, avg(p0) AS mean_p0, avg(p1) AS mean_p1, avg(p2) AS mean_p2 FROM sc")
def a19_log_loss(spark, d):
    return A.log_loss(scored(spark, d), "label", ["p0", "p1", "p2"])


@R.add(f"""WITH {SCORED}, g AS (SELECT p0 AS s, count(*) AS n, sum(quality) AS h FROM sc GROUP BY p0), c AS (SELECT h, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY s DESC))
           SELECT CAST(sum(h) AS BIGINT) AS n_positive, sum(h * ch / cn) / sum(h) AS average_precision FROM c""")
def a20_average_precision(spark, d):
    return A.average_precision(scored(spark, d), F.col("quality"), "p0")


@R.add(f"""WITH {SCORED}, r AS (SELECT quality, row_number() OVER (ORDER BY p0 DESC, doc_id) AS r, CAST(ceil(count(*) OVER () * 5 / 100.0) AS BIGINT) AS k, sum(quality) OVER () AS total FROM sc)
           SELECT any_value(k) AS k, CAST(sum(quality) AS BIGINT) AS hits, sum(quality) / any_value(k) AS precision, sum(quality) / any_value(total) AS recall FROM r WHERE r <= k""")
def a21_top_share_pr(spark, d):
    return A.top_share_pr(scored(spark, d), F.col("quality"), "p0", "doc_id")


@R.add(f"WITH {SCORED}, c AS (SELECT label, count(*) AS n FROM sc GROUP BY label), w AS (SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS w FROM c) SELECT label, n, least(w / min(w) OVER (), 10.0) AS weight FROM w")
def a22_class_weights(spark, d):
    return A.class_weights(scored(spark, d), "label", 0.5)


@R.add(f"""WITH {SCORED}, l AS (SELECT avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss FROM sc), c AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM sc GROUP BY label),
           h AS (SELECT -sum(p * ln(p)) AS entropy FROM c) SELECT log_loss, entropy, 1 - log_loss / entropy AS skill FROM l, h""")
def a23_skill_score(spark, d):
    return A.skill_score(scored(spark, d), "label", ["p0", "p1", "p2"])


@R.add(f"WITH {EV}, r AS (SELECT avg(abs(0.9 * x + 5 - x) + abs(0.8 * y - y)) AS raw_gap, avg(abs(0.9 * x + 5 + x) + abs(0.8 * y + y)) AS adjusted_gap FROM ev) SELECT raw_gap, adjusted_gap, CASE WHEN raw_gap < adjusted_gap THEN 'raw' ELSE 'adjusted' END AS system FROM r")
def a25_coordinate_vote(spark, d):
    e = events(spark, d).withColumns({"tx": F.col("x") * 0.9 + 5, "ty": F.col("y") * 0.8, "ax": -F.col("x"), "ay": -F.col("y")})
    return A.coordinate_vote(e, ("tx", "ty"), ("x", "y"), ("ax", "ay"))


@R.add(f"""WITH {EV}, c AS (SELECT game, team, count(*) AS n FROM ev WHERE team IS NOT NULL GROUP BY game, team), r AS (SELECT *, rank() OVER (PARTITION BY game ORDER BY n DESC) AS r FROM c)
           SELECT game, min(team) AS leader, max(n) AS n FROM r WHERE r = 1 GROUP BY game HAVING count(*) = 1""")
def a26_unique_leader(spark, d):
    return A.unique_leader(events(spark, d))


@R.add(f"WITH {EV}, c AS (SELECT game, count(*) FILTER (WHERE type = 'goal') AS n FROM ev GROUP BY game) SELECT game, n, CASE WHEN n <= 3 THEN 'low' WHEN n <= 6 THEN 'mid' ELSE 'high' END AS stratum FROM c")
def a27_strata(spark, d):
    return A.strata(events(spark, d), F.col("type") == "goal")


@R.add(f"""WITH {EV}, f AS (SELECT *, coalesce(lead(type) OVER (PARTITION BY game ORDER BY period, t, id) = 'goal', false) AS f FROM ev)
           SELECT outcome, count(*) AS n, CAST(count(*) FILTER (WHERE f) AS BIGINT) AS n_followed, avg(CAST(f AS INT)) AS share, avg(value) FILTER (WHERE f) AS value_mean, median(value) FILTER (WHERE f) AS value_median, max(value) FILTER (WHERE f) AS value_max
           FROM f WHERE type = 'shot' GROUP BY outcome""")
def a28_followed_by_table(spark, d):
    return A.followed_by_table(events(spark, d), ["shot"], "goal", "outcome", "value")


@R.add(f"WITH {EV} SELECT count(*) AS n, avg(CASE WHEN player IS NOT NULL THEN 1.0 ELSE 0 END) AS player_share, avg(CASE WHEN team IS NOT NULL THEN 1.0 ELSE 0 END) AS team_share FROM ev WHERE type IN ('goal', 'whistle')")
def a29_coverage(spark, d):
    return A.coverage(events(spark, d), ["player", "team"], F.col("type").isin("goal", "whistle"))


_KEYS = (("game", "player"), ("team", "player"), ("game", "team"), ("team", "id"))


@R.add(f"WITH {EV}, c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{','.join(k)}' AS key, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k)}) AS n_null FROM ev" for i, k in enumerate(_KEYS)) + ") SELECT key, n_null FROM c ORDER BY n_null, i LIMIT 1")
def a30_best_key(spark, d):
    return A.best_key(events(spark, d), [list(k) for k in _KEYS])


@R.add(f"WITH {TRACKING}, s AS (SELECT count(*) AS n_members FROM trk GROUP BY event) SELECT n_members, count(*) AS n_events, n_members > 4 AS above_4, n_members > 8 AS above_8 FROM s GROUP BY n_members")
def a31_members_per_event(spark, d):
    return A.members_per_event(tracking(spark, d), ["event"], (4, 8))


@R.add(f"WITH {EV} SELECT type, count(*) AS n, count(*) - count(player) AS player_missing, count(*) - count(team) AS team_missing FROM ev GROUP BY type")
def a33_missing_by(spark, d):
    return A.missing_by(events(spark, d), ["player", "team"], "type")


@R.add("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s02_csv_round_trip(spark, d):
    """S04 writes what S02 reads."""
    path = folder(spark)
    S.sink_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return S.scan_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@R.add("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def s03_sink_parquet(spark, d):
    path = folder(spark)
    S.sink_parquet(table(spark, d, "nation"), path, ["n_regionkey"])
    return scan_parquet(spark, path, ["n_regionkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@R.add(f"""WITH {EV}, w AS (SELECT id, lag(player) OVER g AS before, player, lag(id) OVER g AS prev, lead(id) OVER q AS later, type FROM ev
           WINDOW g AS (PARTITION BY game ORDER BY period, t, id), q AS (PARTITION BY game, seq ORDER BY period, t, id))
           SELECT id, CASE WHEN prev IS NOT NULL AND before IS DISTINCT FROM player THEN 1 ELSE 0 END AS player_changed, CASE WHEN type IN ('whistle', 'goal') AND later IS NULL THEN 1 ELSE 0 END AS is_eos FROM w""")
def s03_clustered_windows(spark, d):
    """Two window operators over a table in buckets by game: the plan has no exchange."""
    path = folder(spark)
    t = S.sink_clustered(events(spark, d), f"clustered_{path.rsplit('/', 1)[1]}", path, ["game"], ["period", "t", "id"], 16)
    return W.eos_flag(W.changed_flag(t, "player")).select("id", "player_changed", "is_eos")


@R.add("SELECT r_regionkey, r_name FROM region")
def s05_sink_json(spark, d):
    path = folder(spark)
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    S.sink_json(r, path)
    return spark.read.schema(r.schema).json(path)


@R.add("SELECT 'orders' AS artifact, count(*) AS n_rows, 6 AS n_columns, 'pass' AS gate FROM orders UNION ALL SELECT 'part', count(*), 6, 'pass' FROM part")
def s06_append_manifest(spark, d):
    path = folder(spark)
    for name in ("orders", "part"):
        S.append_manifest(table(spark, d, name), name, f"{d}/{name}.parquet", path)
    return spark.read.parquet(path).select("artifact", "n_rows", "n_columns", "gate")


@R.add("SELECT vec_id, len(embedding) AS width, round(list_sum(embedding), 3) AS total FROM embeddings")
def s08_sink_vectors(spark, d):
    path = folder(spark)
    S.sink_vectors(table(spark, d, "embeddings"), ["vec_id"], "embedding", path)
    v = spark.read.parquet(path)
    return v.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@R.add(f"WITH {EV} SELECT id, player FROM ev WHERE player IS NOT NULL AND player <> 'P5'")
def f06_drop_null_entities(spark, d):
    e = events(spark, d).withColumn("player", F.when(F.col("player") == "P5", "None").otherwise(F.col("player")))
    return P.drop_null_entities(e, "player").select("id", "player")


@R.add(f"WITH {EV} SELECT id FROM ev QUALIFY NOT (type IN ('whistle', 'goal') AND lead(id) OVER (PARTITION BY game, seq ORDER BY period, t, id) IS NULL)")
def f07_drop_eos(spark, d):
    from eventry.operators.windows import eos_flag

    return P.drop_eos(eos_flag(events(spark, d))).select("id")


@R.add(f"WITH {EV} SELECT game, id, type FROM ev")
def f09_project_contract(spark, d):
    return P.project_contract(events(spark, d), ["game", "id", "type"])


@R.add(f"WITH {EV} SELECT id, -x AS x, y + 1 AS y FROM ev")
def f11_coordinate_columns(spark, d):
    e = events(spark, d).withColumns({"x_raw": F.col("x"), "y_raw": F.col("y"), "x_adj": -F.col("x"), "y_adj": F.col("y") + 1})
    return P.coordinate_columns(e, "adjusted").select("id", "x", "y")


# Every fifth delta is missing: on a penalty it counts as 0, elsewhere it stays missing.
@R.add(f"""WITH {EV}, a AS (SELECT id, type = 'faceoff' AS hit, CASE WHEN id % 5 > 0 THEN x / 100 END AS df, y / 100 AS da FROM ev),
           b AS (SELECT id, hit, CASE WHEN hit THEN coalesce(df, 0) + 0.02 ELSE df END AS f, CASE WHEN hit THEN coalesce(da, 0) + 0.2 ELSE da END AS g FROM a)
           SELECT id, f AS adj_for, g AS adj_against, f - g AS adj_net, CASE WHEN hit THEN 'penalty_static' ELSE 'model' END AS adj_source FROM b""")
def f17_adjust_penalty_taker(spark, d):
    e = events(spark, d).withColumns({"delta_for": F.when(F.col("id") % 5 > 0, F.col("x") / 100), "delta_against": F.col("y") / 100})
    return P.adjust_penalty_taker(e, penalty="faceoff").select("id", "adj_for", "adj_against", "adj_net", "adj_source")


@R.add(f"WITH {EV} SELECT id, CASE WHEN player IS NULL THEN 0.0 ELSE x END AS track_x, CASE WHEN player IS NULL THEN 0.0 ELSE y END AS track_y, CASE WHEN player IS NULL THEN 1 ELSE 0 END AS is_imputed, CASE WHEN player IS NULL THEN 0 ELSE 1 END AS is_present FROM ev")
def f18_impute_actor(spark, d):
    known = F.col("player").isNotNull()
    e = events(spark, d).withColumns({"track_x": F.when(known, F.col("x")), "track_y": F.when(known, F.col("y"))})
    return P.impute_actor(e, mode="absent").select("id", "track_x", "track_y", "is_imputed", "is_present")


@R.add(f"WITH {EV} SELECT game, id, player, 'save' AS type, coalesce(CASE WHEN id % 3 > 0 THEN value END, 0) AS credit_for, 0.0 AS credit_against, coalesce(CASE WHEN id % 3 > 0 THEN value END, 0) AS credit_net FROM ev WHERE type = 'whistle'")
def f20_goalie_as_player_ledger(spark, d):
    e = events(spark, d).where("type = 'whistle'").withColumns({"goalie": F.col("player"), "save_credit": F.when(F.col("id") % 3 > 0, F.col("value"))})
    return P.goalie_as_player_ledger(e, ["game", "id"])


@R.add(f"WITH {EV} SELECT game, id, type, team, x FROM ev WHERE type IN ('whistle', 'faceoff')")
def f21_inspect_baselines(spark, d):
    return P.inspect_baselines(events(spark, d), ["game", "id", "type", "team", "x"])


@R.add("SELECT p_partkey, replace(replace(replace(lower(p_type), 'a', 'x'), 'xx', 'y'), 'e', '') AS text FROM part")
def c02_rewrite_text(spark, d):
    return table(spark, d, "part").select("p_partkey", C.rewrite_text(F.lower("p_type"), (("a", "x"), ("xx", "y"), ("e", ""))).alias("text"))


@R.add("""WITH t AS (SELECT item_id, [trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ,._:-') FOR x IN regexp_split_to_array(lower(text), '[,;|/]')] AS a FROM benchmark)
          SELECT item_id, nullif(array_to_string([x FOR x, i IN a IF x <> '' AND list_position(a, x) = i AND NOT regexp_matches(x, '\\bthe\\b') AND x <> 'in'], ', '), '') AS flags FROM t""")
def c05_filter_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", C.filter_tokens(C.tokenize_flags(F.col("text")), ("in",), leaks=r"\bthe\b").alias("flags"))


@R.add("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ; ' || p_brand ELSE p_brand END AS text FROM part")
def c06_join_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", C.join_texts(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_brand")).alias("text"))


@R.add("SELECT p_partkey, regexp_matches(p_name, '1') OR regexp_matches(p_brand, '1') AS hit FROM part")
def c09_any_match(spark, d):
    return table(spark, d, "part").select("p_partkey", C.any_match([F.col("p_name"), F.col("p_brand")], "1").alias("hit"))


@R.add(f"WITH {TRACKING} SELECT event, node, tx - 5 AS dx, ty + 3 AS dy, sqrt((tx - 5) * (tx - 5) + (ty + 3) * (ty + 3)) AS distance, CASE WHEN node = 1 THEN 'actor' WHEN side = 'mate' THEN 'teammate' ELSE 'opponent' END AS role FROM trk")
def c12_relative_position(spark, d):
    t = tracking(spark, d).withColumn("rel", C.relative_position(F.col("tx"), F.col("ty"), F.lit(5.0), F.lit(-3.0)))
    return t.select("event", "node", "rel.dx", "rel.dy", "rel.distance", C.role(F.col("node"), F.col("side"), F.lit(1), F.lit("mate")).alias("role"))


@R.add(f"WITH {EV} SELECT game, CAST(id + 0.5 AS DOUBLE) AS id FROM ev")
def c13_normalize_keys(spark, d):
    e = events(spark, d).select(F.col("game").cast("int").alias("game"), (F.col("id") + 0.5).alias("id"))
    return C.normalize_keys(e, "game", "id").select("game", F.col("id").cast("double").alias("id"))


@R.add(f"WITH {EV} SELECT id, round(atan2(sin(x / 10), cos(x / 10)), 6) AS wrapped, abs(x - y) <= 1e-9 AS close FROM ev")
def c14_wrap_and_close(spark, d):
    return events(spark, d).select("id", F.round(C.wrap_angle(F.col("x") / 10), 6).alias("wrapped"), C.is_close(F.col("x"), F.col("y")).alias("close"))


@R.add("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber = 1 OR l_returnflag = 'Y' GROUP BY l_returnflag")
def c15_parse_bool(spark, d):
    return table(spark, d, "lineitem").where(C.parse_bool(F.col("l_linenumber"), F.col("l_returnflag"))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@R.add("SELECT c_mktsegment, regexp_matches(upper(c_mktsegment), 'G') AS hit, count(*) AS n FROM customer GROUP BY c_mktsegment")
def c16_match_role(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", C.match_role(F.col("c_mktsegment"), "G").alias("hit"), "n")


@R.add(f"WITH {EV} SELECT id, CASE WHEN abs(y) <= 5 THEN 'center' WHEN abs(y) <= 25 THEN 'near' ELSE 'far' END AS band FROM ev")
def c17_band(spark, d):
    return events(spark, d).select("id", C.band(F.col("y")).alias("band"))


@R.add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def o01_sort_total(spark, d):
    return P.sort_total(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", False), ("c_custkey", True)])


@R.add("SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 100")
def o03_sample_rows(spark, d):
    return P.sample_rows(table(spark, d, "customer").select("c_custkey", "c_name"), 100, F.col("c_custkey"))


@R.add(f"WITH {EV}, g AS (SELECT game, team FROM ev WHERE type = 'goal') SELECT game, team, count(*) AS n FROM g WHERE team IS NOT NULL GROUP BY ALL UNION ALL SELECT game, NULL, count(*) FROM ev WHERE type = 'whistle' GROUP BY game")
def a02_extra_counts(spark, d):
    known, unknown = A.extra_counts(events(spark, d).where("type IN ('goal', 'whistle')"))
    return known.withColumnRenamed("extra", "n").unionByName(unknown.select("game", F.lit(None).cast("string").alias("team"), F.col("unassigned").alias("n")))


@R.add(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev GROUP BY game, seq) SELECT quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.99) AS q99 FROM n")
def a16_length_quantiles(spark, d):
    return A.length_quantiles(A.sequence_summary(events(spark, d)))


# Phrases that the default rules of texts are for.
PHRASES = (
    "f/off won in dz", "face  off lost", "chk by d-zone", "rec from nz pass", "def of blue hold", "e w pass", "lpr cont reb", "opdump hipresopdump", "nofore hi press", "lpr offboards", "d2d bc sc", "ci di lprreb",
    "nzpuckprotection ozpuckprotection", "Failed Pass Trajectory Location", "offensive zone entry pass reception", "defensive deflection; original description: slot shot for onnet", "successful miss  pass", "miss shot blocked missed",
    "shot on net with goal", "goals onnet", "with shot on net whistle", "x; Original Description: anything at all", "ozdeke dzpass nz+oz", "Double Minor for tripping", "Major - fighting", "game misconduct", "match penalty", "minor", "G", "LW/G", "Goalie", "", "GG wing", "goaltender",
)


def _phrases(spark, d):
    """Every part with two of the phrases, so that all rules and their sequences occur."""
    p = table(spark, d, "part")
    pick = lambda i: F.get(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES)).cast("int"))
    k = F.col("p_partkey")
    return p.select("p_partkey", F.concat_ws(" ", "p_name", pick(k), pick(k * 7 + F.floor(k / 34))).alias("text"), pick(k).alias("phrase"))


_LIST = "[" + ", ".join(f"'{x}'" for x in PHRASES) + "]"
_PICK = f"""ph AS (SELECT p_partkey, concat_ws(' ', p_name, {_LIST}[p_partkey % {len(PHRASES)} + 1], {_LIST}[(p_partkey * 7 + p_partkey // 34) % {len(PHRASES)} + 1]) AS text, {_LIST}[p_partkey % {len(PHRASES)} + 1] AS phrase FROM part)"""


def _chain(sql: str, rules) -> str:
    for pattern, to in rules:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return sql


_NORMAL = "trim(lower(regexp_replace(regexp_replace(text, '[+-]', ' ', 'g'), '\\s+', ' ', 'g')))"
_REWRITTEN = _chain(_NORMAL, C.DEFAULT_REWRITES)


@R.add(f"WITH {_PICK} SELECT p_partkey, {_REWRITTEN} AS text FROM ph")
def c02_default_rewrites(spark, d):
    return _phrases(spark, d).select("p_partkey", C.rewrite_text(C.normalize_text(F.col("text"))).alias("text"))


@R.add(f"WITH {_PICK} SELECT p_partkey, regexp_matches(text, '(?i){C.LEAKS}') AS leak, nullif(trim(regexp_replace(regexp_replace(lower(text), '{C.LEAKS}', ' ', 'g'), '\\s+', ' ', 'g')), '') AS clean FROM ph")
def c03_default_leaks(spark, d):
    return _phrases(spark, d).select("p_partkey", C.has_leak(F.col("text")).alias("leak"), C.strip_leaks(F.col("text")).alias("clean"))


@R.add(f"WITH {_PICK}, r AS (SELECT p_partkey, {_REWRITTEN} AS text FROM ph) SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(text), '{C.LEAKS}', ' ', 'g'), '\\s+', ' ', 'g')), '') AS clean FROM r")
def c03_clean_description(spark, d):
    return _phrases(spark, d).select("p_partkey", C.clean_description(F.col("text")).alias("clean"))


_CLASS = " ".join("WHEN " + " AND ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for words, label in C.PENALTY_CLASSES)


@R.add(f"WITH {_PICK} SELECT p_partkey, CASE {_CLASS} ELSE 'other' END AS class FROM ph")
def c08_default_classes(spark, d):
    return _phrases(spark, d).select("p_partkey", C.classify_text(F.col("text")).alias("class"))


@R.add(f"WITH {_PICK} SELECT p_partkey, regexp_matches(upper(phrase), '{C.GOALIE_ROLE}') AS hit FROM ph")
def c16_default_role(spark, d):
    return _phrases(spark, d).select("p_partkey", C.match_role(F.col("phrase")).alias("hit"))
