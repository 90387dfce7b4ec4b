"""Aggregations and metrics."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventry.operators.project import yes
from eventry.operators.ranges import cumulate, deal, null_safe_join, quantiles, scan
from eventry.schema import DEFAULT, EventSchema


def count_by(df: DataFrame, type_: str, keys: list[str], type_col: str = "type", out: str = "n") -> DataFrame:
    """A01."""
    return df.where(F.col(type_col) == type_).groupBy(*keys).agg(F.count("*").alias(out))


def extra_counts(extra: DataFrame, group: str = "game", team: str = "team") -> tuple[DataFrame, DataFrame]:
    """Extras per group and team, and those without a team per group."""
    known = extra.where(F.col(team).isNotNull()).groupBy(group, team).agg(F.count("*").alias("extra"))
    return known, extra.where(F.col(team).isNull()).groupBy(group).agg(F.count("*").alias("unassigned"))


def allocate_units(df: DataFrame, group: str, deficit: str, units: str, tie: str) -> DataFrame:
    """Units go one by one to the side with the largest deficit (ties in the order of ``tie``) until none is left: ``allocated``.

    That is water over a bottom: all deficits are filled down to one level, the least at which the units suffice, and the rest of the units go to the first
    sides on it. With the k largest deficits summing to S(k), the level is the largest (S(k) - units) / k, rounded up: no row per unit is made.
    """
    d = df.withColumns({"_d": F.greatest(F.coalesce(F.col(deficit), F.lit(0)), F.lit(0)).cast("long"), "_u": F.coalesce(F.col(units), F.lit(0)).cast("long")}).withColumn("_neg", -F.col("_d"))
    by, order = [group], ["_neg", tie]
    s = scan(deal(d, by, order), by, order, {"_s": ("sum", F.col("_d"), True), "_k": ("sum", F.lit(1).cast("long"), True)})
    level = s.groupBy(*by).agg(F.greatest(F.max(F.expr("(_s - _u + _k - 1) div _k")), F.lit(0)).alias("_level"))
    filled = null_safe_join(d, level, by).withColumn("_base", F.greatest(F.col("_d") - F.col("_level"), F.lit(0)))
    used = filled.groupBy(*by).agg(F.sum("_base").alias("_used"))
    filled = null_safe_join(filled, used, by).withColumn("_next", (F.col("_level") > 0) & (F.col("_d") >= F.col("_level")))
    ranked = scan(deal(filled, by, [tie]), by, [tie], {"_rank": ("sum", F.col("_next").cast("long"), True)})
    extra = F.when(F.col("_next") & (F.col("_rank") <= F.col("_u") - F.col("_used")), 1).otherwise(0)
    return ranked.withColumn("allocated", F.col("_base") + extra).select(*df.columns, "allocated")


def _outcome_aggs(flags: list[str]) -> list[Column]:
    out = [F.count("*").alias("n")]
    for f in flags:
        v = F.col(f).cast("double")
        sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
        sem = sd / F.sqrt(F.count(v))
        out += [F.sum(v).alias(f"{f}_sum"), F.avg(v).alias(f"{f}_mean"), sd.alias(f"{f}_std"), sem.alias(f"{f}_sem"), (F.avg(v) - 1.96 * sem).alias(f"{f}_low"), (F.avg(v) + 1.96 * sem).alias(f"{f}_high")]
    return out


def outcome_table(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Count, sum, mean, sample deviation (0 for one row), standard error and 95 % interval of each flag by key."""
    return df.groupBy(key).agg(*_outcome_aggs(flags))


def with_total(df: DataFrame, key: str, flags: list[str], label: str = "__all__") -> DataFrame:
    """A04 with a total row."""
    table = df.rollup(key).agg(F.grouping(key).alias("_all"), *_outcome_aggs(flags))
    return table.withColumn(key, F.when(F.col("_all") == 1, label).otherwise(F.col(key))).drop("_all")


def zone_baselines(df: DataFrame, zone: str, p_for: str, p_against: str) -> DataFrame:
    """Mean chances after faceoffs by zone; oz and dz are mirror images, nz is its own mirror."""
    m = lambda z, c: F.coalesce(F.avg(F.when(F.col(zone) == z, F.col(c))), F.lit(0.0))
    r = df.agg(*[m(z, c).alias(f"{z}_{c}") for z in ("oz", "dz", "nz") for c in (p_for, p_against)])
    strong = (F.col(f"oz_{p_for}") + F.col(f"dz_{p_against}")) / 2
    weak = (F.col(f"oz_{p_against}") + F.col(f"dz_{p_for}")) / 2
    even = (F.col(f"nz_{p_for}") + F.col(f"nz_{p_against}")) / 2
    rows = [F.struct(F.lit(z).alias("zone"), a.alias("base_for"), b.alias("base_against")) for z, a, b in (("oz", strong, weak), ("dz", weak, strong), ("nz", even, even))]
    return r.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pivot_summary(df: DataFrame, keys: list[str], pivot: str, value: str, values: list[str]) -> DataFrame:
    """Count and net per key and type side by side, with totals. The types are given, so no pass looks for them."""
    each = [a for v in values for a in (F.count(F.when(F.col(pivot) == v, 1)).alias(f"{v}_n"), F.coalesce(F.sum(F.when(F.col(pivot) == v, F.col(value))), F.lit(0.0)).alias(f"{v}_net"))]
    return df.groupBy(*keys).agg(*each, F.count("*").alias("total_n"), F.sum(value).alias("total_net"))


def class_distribution(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Counts and shares of classes, in all or within ``by``."""
    keys = [by, label] if by else [label]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by if by else F.lit(1))))


def capped_group_max(df: DataFrame, by: list[str], col: str, cap: float, out: str = "cap") -> DataFrame:
    """A09."""
    return df.withColumn(out, F.least(F.max(col).over(Window.partitionBy(*by)), F.lit(cap)))


def duplicate_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """A10: how many keys occur more than once, and the rows they hold."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def fill_stats(df: DataFrame, cols: list[str], q: float | None = None, exact: bool = True) -> DataFrame:
    """Medians, or a linear quantile, of each column; with ``exact`` off a sketch of bounded size."""
    at = 0.5 if q is None else q
    if not exact:
        return df.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in cols])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")).select("r.*")
    return quantiles(long, (at,)).agg(*[F.max(F.when(F.col("key") == c, F.col("q0"))).alias(c) for c in cols])


def missing_report(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """Missing values per column, the most first."""
    one = df.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("n_missing")) for c in cols])).alias("r"))
    out = rows.select("r.column", "r.n_missing", F.coalesce(F.try_divide(F.col("r.n_missing"), F.col("n")), F.lit(0.0)).alias("share"))
    return out.orderBy(F.desc("n_missing"), "column").limit(k) if k else out


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """A13. Texts are counted by their SHA-256, so none is shuffled."""
    kinds = dict(df.dtypes)
    short = lambda c: F.unhex(F.sha2(c, 256)) if kinds[c] == "string" else F.col(c)
    return df.agg(*[(F.approx_count_distinct(c) if approximate else F.count_distinct(short(c))).alias(f"n_{c}") for c in cols])


def word_frequency(df: DataFrame, text: Column, k: int | None = None) -> DataFrame:
    """How often each word occurs."""
    counts = df.select(F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(k) if k else counts


def quantile_sketches(df: DataFrame, by: list[str], cols: list[str], k: int = 200) -> DataFrame:
    """A11 in parts: a KLL sketch of each column per part (a day, a file), of bounded size; sketches of parts merge to that of the whole."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in cols])


def merged_quantiles(sketches: DataFrame, cols: list[str], q: float) -> DataFrame:
    """The quantile of each column over all parts, its rank about 1.7 % off at most with the default size (99 % of the time)."""
    return sketches.agg(*[F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(c), F.lit(float(q))).alias(c) for c in cols])


def distinct_sketches(df: DataFrame, by: list[str], cols: list[str], bits: int = 14) -> DataFrame:
    """A13 in parts: a HyperLogLog sketch of each column per part."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, bits).alias(c) for c in cols])


def merged_distinct(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values of each column over all parts, within 3 % at most times with the default size."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in cols])


def _texts(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.make_valid_utf8(text.cast("string")).cast("binary").alias("text")).where("text IS NOT NULL")


def _words(batches):
    """The words of each text as bytes; white space is that of ``\\s``. A long text is not split at once."""
    for batch in batches:
        for text in batch.column(0):
            t = text.as_py()
            yield t.split() if len(t) < 1 << 22 else (m.group() for m in re.finditer(rb"\S+", t))


def _columns(held: dict[bytes | None, int]) -> list[pa.Array]:
    return [pa.array([*held], pa.binary()).cast(pa.string()), pa.array([*held.values()], pa.int64())]


def _summaries(df: DataFrame, text: Column, size: int) -> DataFrame:
    """``word_summary`` whose rows without a word have the number of all words, too: ``total``, 0 in others."""

    def run(batches):
        held, off, total = Counter(), 0, 0

        def trimmed():
            over = sorted(held.values(), reverse=True)[size]
            return Counter({w: n - over for w, n in held.items() if n > over}), off + over

        before = 0  # counts held after the last trim
        for words in _words(batches):
            held.update(words)
            if len(held) > size + max(size, 50_000):  # a trim goes over all words held, so it waits for many new ones
                total += held.total() - before
                held, off = trimmed()
                before = held.total()
        total += held.total() - before
        if len(held) > size:
            held, off = trimmed()
        yield pa.RecordBatch.from_arrays([*_columns({**held, None: off}), pa.array([*[0] * len(held), total], pa.int64())], names=["word", "n", "total"])

    return _texts(df, text).mapInArrow(run, "word string, n long, total long")


def word_summary(df: DataFrame, text: Column, size: int) -> DataFrame:
    """A14 in parts: ``word, n`` with at most ``size`` words a task, and a row without a word whose n is how far the counts may be too low.

    When a task holds more words, the count of the first one too many is taken off all. So no count is too high, and none is too low by more than all words / size.
    Summaries are merged by adding them up: by word, the row without a word included.
    """
    return _summaries(df, text, size).select("word", "n")


def frequent_words(df: DataFrame, text: Column, share: float = 0.01) -> DataFrame:
    """A14 for the words that make up at least a share of all: ``word, n``, exact, without a shuffle of all words.

    Summaries of 2 / share words are short by less than half the share, so at most 2 / share words can qualify; these are sent to the counts of tasks and added up.
    Words are counted in tasks, and the texts are read twice (three times where they were put into one partition, which leaves no shuffle to share).
    """

    def run(batches):
        held = Counter()
        for words in _words(batches):
            held.update(words)
            if len(held) > 200_000:  # what is held in a task is bounded; counts of a word are added up below
                yield pa.RecordBatch.from_arrays(_columns(held), names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays(_columns(held), names=["word", "n"])

    parts = _summaries(df, text, int(2 / share) + 1).groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # told apart by the sums, and no null in the join: conditions on the word would move below the shuffle, and the texts be summarised once for each side
    whole = parts.where("total > 0").select(F.col("n").alias("_off"), F.col("total").alias("_all"))
    likely = parts.where("total = 0").join(F.broadcast(whole)).where(F.col("n") + F.col("_off") >= share * F.col("_all")).select(F.coalesce("word", F.lit("")).alias("word"), "_all")  # one row
    counts = _texts(df, text).mapInArrow(run, "word string, n long")
    return counts.join(F.broadcast(likely), "word").groupBy("word").agg(F.sum("n").alias("n"), F.max("_all").alias("_all")).where(F.col("n") >= share * F.col("_all")).drop("_all")


def zscore(df: DataFrame, cols: list[str], eps: float = 1e-6) -> DataFrame:
    """Standardised by mean and population deviation; deviations below eps count as 1."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    joined = df.join(F.broadcast(stats))  # one row
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < eps, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return joined.withColumns(z).select(*df.columns)


def sequence_summary(df: DataFrame, s: EventSchema = DEFAULT) -> DataFrame:
    """Size, length, first and last type and last team of every sequence."""
    at = F.struct(*s.order)
    return df.groupBy(s.group, s.sequence).agg(F.count("*").alias("n"), F.min_by(s.type, at).alias("first_type"), F.max_by(s.type, at).alias("last_type"), F.max_by(s.team, at).alias("last_team"), (F.max(s.time) - F.min(s.time)).alias("seconds"))


def length_quantiles(summary: DataFrame, col: str = "n", qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Quantiles of sequence lengths."""
    found = quantiles(summary.select(F.lit("all").alias("key"), F.col(col).alias("value")), qs)
    return found.agg(*[F.max(f"q{i}").alias(f"q{int(q * 100)}") for i, q in enumerate(qs)])  # a row of nulls for no sequences


def terminal_distribution(df: DataFrame, s: EventSchema = DEFAULT) -> DataFrame:
    """How sequences end."""
    return sequence_summary(df, s).groupBy("last_type").agg(F.count("*").alias("n"))


def membership_changes(df: DataFrame, by: list[str], step: str, member: str) -> DataFrame:
    """Who entered, left and stayed at each step, as sorted joined texts. A step's members are few by nature."""
    sets = df.groupBy(*by, step).agg(F.array_sort(F.collect_set(member)).alias("_now"))
    was = F.coalesce(F.lag("_now").over(Window.partitionBy(*by).orderBy(step)), F.array().cast("array<string>"))
    d = sets.withColumn("_was", was)
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return d.select(*by, step, text(F.array_except("_now", "_was")).alias("entered"), text(F.array_except("_was", "_now")).alias("exited"), text(F.array_intersect("_now", "_was")).alias("persisted"))


def log_loss(df: DataFrame, label: str, probs: list[str], eps: float = 1e-12) -> DataFrame:
    """Mean negative log of the labelled class's probability (rows clipped and scaled first), and mean probabilities."""
    from eventry.functions.scalars import normalize_probs

    p = normalize_probs([F.col(c) for c in probs], eps)
    own = reduce(lambda acc, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(acc), enumerate(p), F.lit(None).cast("double"))
    return df.select(own.alias("_p"), *[c.alias(n) for c, n in zip(p, probs, strict=True)]).agg(F.count("_p").alias("n"), F.avg(-F.log("_p")).alias("log_loss"), *[F.avg(c).alias(f"mean_{c}") for c in probs])


def _ranked(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Rows and hits at each distinct score with running totals from the top.

    Scores are counted first and dealt by ranges, so no task sees all scores, however crowded they are.
    """
    at = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("hits"))
    return cumulate(at, [F.desc("s")], {"cum_n": F.col("n"), "cum_hits": F.col("hits")})


def average_precision(df: DataFrame, label: Column, score: str) -> DataFrame:
    """The sum of recall steps times precision."""
    return _ranked(df, label, score).agg(F.sum(F.col("hits") * F.col("cum_hits") / F.col("cum_n")).alias("_s"), F.sum("hits").alias("n_positive")).select("n_positive", F.try_divide(F.col("_s"), F.col("n_positive")).alias("average_precision"))


def top_share_pr(df: DataFrame, label: Column, score: str, key: str, share: float = 0.05) -> DataFrame:
    """Precision and recall in the top share of scores (ties by key), at least one row if there is any. A threshold score bounds what must be ranked."""
    d = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(key).alias("k"), label.cast("long").alias("y"))
    n, total = d.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    part = Fraction(str(share))  # as written: 0.0125 is 1/80
    k = max(min(n, 1), -(-n * part.numerator // part.denominator))
    edge = _ranked(d, F.col("y"), "s").where(F.col("cum_n") >= k).agg(F.max("s").alias("edge"))
    d = d.join(F.broadcast(edge))  # one row
    above = d.agg(F.count(F.when(F.col("s") > F.col("edge"), 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("s") > F.col("edge"), F.col("y"))), F.lit(0)).alias("hits"))
    n_above, hits_above = above.first()
    at_edge = d.where(F.col("s") == F.col("edge")).orderBy("k").limit(max(k - n_above, 0)).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("h"))
    hits = F.col("h") + F.lit(hits_above)
    return at_edge.select(F.lit(k).cast("long").alias("k"), hits.alias("hits"), (hits / F.lit(max(k, 1))).alias("precision"), (hits / F.lit(max(total, 1))).alias("recall"))


def class_weights(df: DataFrame, label: str, power: float = 1.0, max_ratio: float = 10.0) -> DataFrame:
    """Balanced weights to a power, the smallest 1, clipped."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))  # one row per class
    w = F.pow(F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")), F.lit(power))
    raw = counts.withColumn("_w", w)
    return raw.select(label, "n", F.least(F.col("_w") / F.min("_w").over(all_), F.lit(max_ratio)).alias("weight"))


def skill_score(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    """Entropy of the classes, and 1 - loss / entropy."""
    shares = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    h = shares.agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    return log_loss(df, label, probs).select("log_loss").join(F.broadcast(h)).select("log_loss", "entropy", (1 - F.try_divide(F.col("log_loss"), F.col("entropy"))).alias("skill"))  # one row each


def max_present(cols: list[str], masks: list[str], default: float = 200.0) -> Column:
    """The largest finite value of present slots."""
    finite = [F.when((F.col(m) == 1) & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c, m in zip(cols, masks, strict=True)]
    return F.coalesce(F.array_max(F.array(*finite)), F.lit(default))


def coordinate_vote(df: DataFrame, track: tuple[str, str], raw: tuple[str, str], adjusted: tuple[str, str]) -> DataFrame:
    """Whether tracked places are nearer to raw or to adjusted coordinates."""
    gap = lambda pair: F.avg(F.abs(F.col(track[0]) - F.col(pair[0])) + F.abs(F.col(track[1]) - F.col(pair[1])))
    return df.agg(gap(raw).alias("raw_gap"), gap(adjusted).alias("adjusted_gap")).withColumn("system", F.when(F.col("raw_gap") < F.col("adjusted_gap"), "raw").otherwise("adjusted"))


def unique_leader(df: DataFrame, group: str = "game", team: str = "team") -> DataFrame:
    """The team with the most rows of a group, if it is alone at the top."""
    counts = df.where(F.col(team).isNotNull()).groupBy(group, team).agg(F.count("*").alias("n"))
    d = counts.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(F.desc("n")))).where("_r = 1")
    return d.groupBy(group).agg(F.count("*").alias("_c"), F.min(team).alias("leader"), F.max("n").alias("n")).where("_c = 1").drop("_c")


def strata(df: DataFrame, flag: Column, group: str = "game", cuts: tuple[int, ...] = (3, 6), labels: tuple[str, ...] = ("low", "mid", "high")) -> DataFrame:
    """Groups by how many flagged rows they have; groups without one are there, too."""
    counts = df.groupBy(group).agg(F.sum(yes(flag).cast("long")).alias("n"))
    label = F.coalesce(*[F.when(F.col("n") <= c, F.lit(name)) for c, name in zip(cuts, labels, strict=False)], F.lit(labels[-1]))
    return counts.withColumn("stratum", label)


def followed_by_table(df: DataFrame, sources, nxt: str, by: str, value: str, s: EventSchema = DEFAULT) -> DataFrame:
    """By outcome, how many source rows are directly followed by ``nxt``, and the values of those rows."""
    d = df.withColumn("_f", yes(F.lead(s.type).over(s.window()) == nxt)).where(F.col(s.type).isin(*sources))
    v = F.when(F.col("_f"), F.col(value))
    table = d.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("_f").cast("long")).alias("n_followed"), F.avg(F.col("_f").cast("double")).alias("share"), F.avg(v).alias("value_mean"), F.max(v).alias("value_max"))
    median = quantiles(d.select(F.struct(by).alias("key"), v.alias("value")), (0.5,)).select("key", F.col("q0").alias("value_median"))
    return table.join(median, F.struct(table[by]).eqNullSafe(median["key"]), "left").select(by, "n", "n_followed", "share", "value_mean", "value_median", "value_max")


def coverage(df: DataFrame, cols: list[str], where: Column) -> DataFrame:
    """The share of rows that have each column."""
    return df.where(yes(where)).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_share") for c in cols])


def best_key(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """The candidate key with the fewest rows that lack a part; of equals the first."""
    lacking = lambda cols: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    one = df.agg(*[F.coalesce(F.sum(lacking(c).cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(candidates)])
    rows = F.array(*[F.struct(F.col(f"c{i}").alias("n_null"), F.lit(i).alias("i"), F.lit(",".join(c)).alias("key")) for i, c in enumerate(candidates)])
    return one.select(F.array_min(rows).alias("b")).select("b.key", "b.n_null")


def members_per_event(df: DataFrame, key: list[str], limits: tuple[int, ...] = (10, 12)) -> DataFrame:
    """How many events have so many members, and whether that is beyond the limits."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("n_members")).groupBy("n_members").agg(F.count("*").alias("n_events"))
    return sizes.withColumns({f"above_{k}": F.col("n_members") > k for k in limits})


def window_label_counts(windows: DataFrame, label: str) -> DataFrame:
    """Labels over windows; rows in an overlap count twice."""
    return windows.groupBy(label).agg(F.count("*").alias("n"))


def missing_by(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """A33."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_missing") for c in cols])
