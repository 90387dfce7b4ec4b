"""Vocabularies, features, folds and baseline models (M01-M13), grouped and batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventry.operators.ranges import number_rows, reliable
from eventry.operators.windows import sliding_windows

# Reserved ids, and the label of padding.
PAD, UNK, IGNORE = 0, 1, -100


def build_vocab(df: DataFrame, col: str, reserved: tuple[str, ...] = (), start: int = 2) -> DataFrame:
    """Values and reserved tokens, sorted as text, with ids from ``start``."""
    words = df.select(F.col(col).cast("string").alias("token")).where("token IS NOT NULL").distinct()
    if reserved:
        words = words.union(df.sparkSession.createDataFrame([(r,) for r in reserved], "token string")).distinct()
    return number_rows(words, ["token"], "token_id", start)


def text_dictionary(df: DataFrame, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """An index per distinct text, in the order of first appearance from 0 (of equal ones by SHA-256), on the rows and as a table.

    Texts are told apart by their SHA-256; only digests are grouped, numbered and joined.
    """
    keyed = df.withColumn("_key", F.sha2(text, 256))
    first = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.min(order).alias("_first"))
    ids = number_rows(first, ["_first", "_key"], "text_id").select("_key", "text_id")
    table = keyed.where(F.col(text).isNotNull()).select("_key", text).dropDuplicates(["_key"]).join(ids, "_key").select(text, "text_id")
    return keyed.join(ids, "_key", "left").drop("_key"), table


def threat_vector(df: DataFrame, actor: tuple[str, str, str, str], slots: list[str], features: list[str], net=(89.0, 0.0), far: float = 200.0) -> DataFrame:
    """Actor speed, distance and angle to the net, missing flag, and each slot's features; absent slots have zeros and the largest distance."""
    x, y, vx, vy = map(F.col, actor)
    missing = x.isNull() | y.isNull()
    head = [F.coalesce(F.hypot(vx, vy), F.lit(0.0)), F.when(missing, far).otherwise(F.hypot(F.lit(net[0]) - x, F.lit(net[1]) - y)), F.coalesce(F.atan2(F.lit(net[1]) - y, F.lit(net[0]) - x), F.lit(0.0)), missing.cast("double")]
    tail = [F.coalesce(F.col(f"{s}_{f}").cast("double"), F.lit(far if f == "distance" else 0.0)) for s in slots for f in features]
    return df.withColumn("threat", F.array(*head, *tail))


def node_features(df: DataFrame, key: list[str], node: str, metrics: list[str], n: int) -> DataFrame:
    """An event's nodes as an array of n structs in slot order, vacant ones zero, and the vacancy mask."""
    at = F.map_from_entries(F.collect_list(F.struct(F.col(node).cast("int"), F.struct(*metrics))))
    packed = df.where(F.col(node).between(0, n - 1)).groupBy(*key).agg(at.alias("_m"))
    one = lambda i: F.struct(*[F.coalesce(F.try_element_at("_m", i)[m].cast("double"), F.lit(0.0)).alias(m) for m in metrics])
    slots = F.sequence(F.lit(0), F.lit(n - 1))
    return packed.select(*key, F.transform(slots, one).alias("nodes"), F.transform(slots, lambda i: F.when(F.map_contains_key("_m", i), 1).otherwise(0)).alias("present"))


def normalise_edges(edges: DataFrame, active: DataFrame, key: list[str], node: str) -> DataFrame:
    """Edges between active nodes with a weight of one over the number of the row's edges."""
    a = active.select(*key, F.col(node).alias("u"))
    b = active.select(*key, F.col(node).alias("v"))
    kept = edges.join(a, [*key, "u"], "left_semi").join(b, [*key, "v"], "left_semi")
    return kept.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(*key, "u")))


def choose_anchor(df: DataFrame, key: list[str], node: str, actor: str, possess: str) -> DataFrame:
    """The actor, else a node in possession, else the first node."""
    priority = F.when(F.col(actor) == 1, 0).when(F.col(possess) == 1, 1).otherwise(2)
    return df.groupBy(*key).agg(F.min(F.struct(priority.alias("p"), F.col(node).alias("n"))).alias("_b")).select(*key, F.col("_b.n").alias("anchor"))


def anchor_relative(df: DataFrame, anchors: DataFrame, key: list[str], node: str, cols: list[str]) -> DataFrame:
    """Values less those of the event's anchor."""
    base = df.join(anchors, key).where(F.col(node) == F.col("anchor")).select(*key, *[F.col(c).alias(f"_a_{c}") for c in cols])
    return df.join(base, key).withColumns({c: F.col(c) - F.col(f"_a_{c}") for c in cols}).drop(*[f"_a_{c}" for c in cols])


def context_features(x: Column, y: Column, vx: Column, vy: Column, active: Column, net=(89.0, 0.0)) -> list[Column]:
    """Place, speed and the view of the net relative to an anchor; inactive nodes have zeros."""
    d = F.hypot(x, y)
    to_net = F.hypot(F.lit(net[0]) - x, F.lit(net[1]) - y)
    facing = F.try_divide(vx * (F.lit(net[0]) - x) + vy * (F.lit(net[1]) - y), to_net)
    raw = [x, y, vx, vy, d, F.hypot(vx, vy), F.atan2(y, x), to_net, F.atan2(F.lit(net[1]) - y, F.lit(net[0]) - x), facing]
    return [F.when(active == 1, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in raw]


def stratified_group_folds(groups: DataFrame, group: str, stratum: str, k: int = 5, seed: int = 7) -> DataFrame:
    """Groups dealt to folds in turn within their stratum, in the order of a seeded MD5. One row per group is ranked."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed)))), group)
    return groups.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


# Models of M11: the most categories a column may have, passes over the rows, and the gradient at which a fit has settled.
MAX_CATEGORIES, MAX_PASSES, SETTLED = 1000, 60, 1e-9


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each training fold."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for f, raw in zip(batch.column("train").to_pylist(), batch.column("v").to_pylist(), strict=True):
            v = np.frombuffer(raw)
            total[f] = total[f] + v if f in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["train", "v"])


class _Folds:
    """Design matrices and multinomial sums of all folds; what it holds is a few numbers per column and fold."""

    def __init__(self, num: list[str], levels: dict[str, list[str]], label: str, fold: str, classes: list[float], folds: int, mean: np.ndarray, scale: np.ndarray):
        self.num, self.levels, self.label, self.fold, self.classes, self.folds, self.mean, self.scale = num, levels, label, fold, classes, folds, mean, scale
        self.width = 1 + len(num) + sum(map(len, levels.values()))

    def matrices(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The numbers as they are, and ones and indicators."""
        n = batch.num_rows
        raw = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.num]) if self.num else np.zeros((n, 0))
        flags = [np.ones((n, 1))]
        for c, values in self.levels.items():
            at = pc.index_in(batch.column(c), value_set=pa.array(values, pa.string())).to_numpy(zero_copy_only=False)
            flags.append((at[:, None] == np.arange(len(values))).astype(float))
        return raw, np.hstack(flags)

    def design(self, raw: np.ndarray, flags: np.ndarray, f: int) -> np.ndarray:
        return np.hstack([flags[:, :1], (raw - self.mean[f]) / self.scale[f], flags[:, 1:]])

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, weights: dict[int, np.ndarray]):
        """Per task and training fold the loss, its gradient and its Hessian over all rows of the other folds, in one pass."""
        k, w = len(self.classes), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {f: np.zeros(1 + k * w + (k * w) ** 2) for f in weights}
            for batch in batches:
                raw, flags = self.matrices(batch)
                y = batch.column(self.label).to_numpy(zero_copy_only=False)
                own = batch.column(self.fold).to_numpy(zero_copy_only=False)
                hot = (y[:, None] == np.array(self.classes)).astype(float)
                for f, beta in weights.items():
                    rows = (own != f) & hot.any(axis=1)
                    x, t = self.design(raw[rows], flags[rows], f), hot[rows]
                    p = self.softmax(x @ beta.T)
                    hess = np.zeros((k, w, k, w))
                    for i in range(k):
                        for j in range(i + 1):
                            hess[i, :, j, :] = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
                            hess[j, :, i, :] = hess[i, :, j, :].T
                    total[f] += np.concatenate([[-np.log(np.maximum((p * t).sum(axis=1), 1e-300)).sum()], ((p - t).T @ x).ravel(), hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["train", "v"])

        return run

    def predict(self, weights: dict[int, np.ndarray], keep: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, flags = self.matrices(batch)
                own = batch.column(self.fold).to_numpy(zero_copy_only=False)
                p = np.zeros((batch.num_rows, len(self.classes)))
                for f, beta in weights.items():
                    rows = own == f
                    p[rows] = self.softmax(self.design(raw[rows], flags[rows], f) @ beta.T)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([*p], pa.list_(pa.float64()))], names=[*keep, "p"])

        return run


def fit_oof(df: DataFrame, num: list[str], cat: list[str], label: str, fold: str, keys: list[str], c: float = 1.0, folds: int = 5) -> DataFrame:
    """A multinomial ridge model per fold, learned from the other folds, and the probabilities of the fold's rows as ``p`` (an entry per class, ascending).

    Missing numbers are 0, numbers are standardised over the rows learned from, missing categories are "NA", and each category is an indicator. The loss is C times
    the log-loss plus half the squared weights, intercepts left out. All folds are fitted together by Newton steps: a pass over the rows gives every
    fold's gradient and Hessian, summed in tasks and once more per fold, so the driver sees one small vector per fold and pass. The selected columns are written once to
    the shared folder. Rows without a label are predicted only; rows without a fold (0 .. folds - 1) are left out. A category column may have ``MAX_CATEGORIES`` values.
    """
    keep = list(dict.fromkeys([*keys, fold, label]))
    d = df.where(F.col(fold).between(0, folds - 1)).select(
        *keep, F.col(fold).cast("int").alias("_f"), F.col(label).cast("double").alias("_y"),
        *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"_n_{x}") for x in num], *[F.coalesce(F.col(x).cast("string"), F.lit("NA")).alias(f"_c_{x}") for x in cat],
    )
    d = reliable(d)
    learned = d.where("_y IS NOT NULL")
    columns = [f"_n_{x}" for x in num]
    stats = [a for x in columns for a in (F.avg(x), F.var_pop(x))]
    per = {r[0]: r[1:] for r in learned.groupBy("_f").agg(F.count("*"), *stats).collect()}  # one row per fold
    distinct = [F.array_sort(F.collect_set(F.when(F.col("_at") == x, F.col("v")))) for x in ("_y", *cat)]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("_at"), b.alias("v")) for a, b in [("_y", F.col("_y").cast("string")), *[(x, F.col(f"_c_{x}")) for x in cat]]]))
    values = learned.select(pairs.alias("q")).select("q.*").distinct()
    most = values.groupBy("_at").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_CATEGORIES:
        raise ValueError(f"a column has {most} categories, more than {MAX_CATEGORIES}")
    found = values.agg(*distinct).first()
    classes, levels = sorted(map(float, found[0])), {f"_c_{x}": v for x, v in zip(cat, found[1:], strict=True)}

    mean, scale = np.zeros((folds, len(num))), np.ones((folds, len(num)))
    for f in range(folds):
        others = [per[g] for g in per if g != f]
        n = np.array([float(o[0]) for o in others])
        m = np.array([o[1::2] for o in others], float).reshape(len(others), len(num))
        v = np.array([o[2::2] for o in others], float).reshape(len(others), len(num))
        if n.sum() and num:
            mean[f] = n @ m / n.sum()
            sd = np.sqrt(n @ (v + (m - mean[f]) ** 2) / n.sum())
            scale[f] = np.where(sd > 1e-12, sd, 1.0)
    model = _Folds(columns, levels, "_y", "_f", classes, folds, mean, scale)

    k, w = len(classes), model.width
    weights = {f: np.zeros((k, w)) for f in range(folds)}
    penalty = np.ones((k, w))
    penalty[:, 0] = 0.0
    centre = np.zeros((k * w, k * w))  # intercepts are known up to a constant, which this fixes
    centre[np.ix_(np.arange(0, k * w, w), np.arange(0, k * w, w))] = 1.0
    open_, last = {*range(folds)} if k > 1 else set(), {}
    numbers = learned.select("_f", "_y", *columns, *levels)
    for _ in range(MAX_PASSES):
        if not open_:
            break
        each = numbers.mapInArrow(model.sums({f: weights[f] for f in open_}), "train int, v binary")
        merged = each.repartition(16 * folds, "train", F.spark_partition_id() % 16).mapInArrow(_added, "train int, v binary")
        for f, raw in merged.repartition(folds, "train").mapInArrow(_added, "train int, v binary").collect():  # one row per fold
            v = np.frombuffer(raw)
            loss = c * v[0] + 0.5 * (penalty * weights[f] ** 2).sum()
            if f in last and loss > last[f][0] + 1e-9 * abs(last[f][0]):  # too far: half the step
                last[f] = (last[f][0], last[f][1], last[f][2] / 2)
                weights[f] = last[f][1] + last[f][2]
                continue
            grad = c * v[1 : 1 + k * w].reshape(k, w) + penalty * weights[f]
            hess = c * v[1 + k * w :].reshape(k * w, k * w) + np.diag(penalty.ravel()) + centre
            step = -np.linalg.solve(hess, grad.ravel()).reshape(k, w)
            last[f] = (loss, weights[f], step)
            weights[f] = weights[f] + step
            if np.abs(grad).max() <= SETTLED * max(1.0, c * per_rows(per, f)):
                open_.discard(f)
    types = dict(d.dtypes)
    schema = ", ".join(f"`{x}` {types[x]}" for x in keep) + ", p array<double>"
    return d.mapInArrow(model.predict(weights, keep), schema)


def per_rows(per: dict[int, tuple], f: int) -> float:
    """Rows that a fold's model learns from."""
    return float(sum(v[0] for g, v in per.items() if g != f))


def fold_metrics(preds: DataFrame, label: str, fold: str, p: str = "p", eps: float = 1e-12) -> DataFrame:
    """Log-loss per fold, that of the class shares of all rows, the skill, and a row for all folds."""
    own = F.element_at(p, F.col(label).cast("int") + 1)
    shares = preds.groupBy(label).agg((F.count("*")).alias("_n")).withColumn("_q", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))).drop("_n")
    d = preds.join(F.broadcast(shares), label)  # one row per class
    table = d.rollup(fold).agg(F.grouping(fold).alias("_all"), F.count("*").alias("n"), F.avg(-F.log(F.greatest(own, F.lit(eps)))).alias("log_loss"), F.avg(-F.log("_q")).alias("naive_loss"))
    return table.select(F.when(F.col("_all") == 1, "mean").otherwise(F.col(fold).cast("string")).alias("fold"), "n", "log_loss", "naive_loss", (100 * (1 - F.col("log_loss") / F.col("naive_loss"))).alias("skill_pct"))


def padded_windows(df: DataFrame, by: list[str], order: list[str], cols: list[str], label: str, size: int = 128, stride: int = 64, min_rows: int = 10) -> DataFrame:
    """One row per window with arrays of ``size``: columns padded with 0, labels with -100 on padding and on the scored prefix, and a mask."""
    w = sliding_windows(df, by, order, size, stride, min_rows)
    packed = w.groupBy(*by, "chunk", "drop_prefix").agg(F.array_sort(F.collect_list(F.struct("pos", *cols, F.when(F.col("pos") < F.col("drop_prefix"), IGNORE).otherwise(F.col(label)).cast("int").alias("_y")))).alias("_r"))
    pad = lambda a, v: F.concat(a, F.array_repeat(v, F.lit(size) - F.size("_r")))
    arrays = [pad(F.col("_r")[c].cast("array<double>"), F.lit(0.0)).alias(c) for c in cols]
    return packed.select(*by, "chunk", *arrays, pad(F.col("_r")["_y"], F.lit(IGNORE)).alias("labels"), pad(F.transform("_r", lambda r: F.lit(1)), F.lit(0)).alias("mask"))


def apply_grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of one group at a time, for state that no window expresses. Groups must be bounded by nature."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def score_batches(df: DataFrame, text: str, make_scorer: Callable[[], Callable[[pd.Series], list]], schema: str) -> DataFrame:
    """A scorer over the distinct texts, made once per task and called per batch; columns ``text`` and the scorer's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            yield pdf.assign(score=scorer(pdf[text]))

    return df.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, schema)
