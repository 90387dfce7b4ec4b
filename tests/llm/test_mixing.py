import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventry.llm import mixing

DOCS = "doc_id long, text string, source string, size string"


def shares(sizes, weights=(3.0, 1.0, 2.0), share=1.5, repeat=2.0):
    """Reshare round by round until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > repeat * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        target |= {s: repeat * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 7, "c": 50, None: 10}, {"x": 5}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 3}, {f"s{i:02}": (i * 37) % 91 + 1 for i in range(20)}])
def test_targets_equal_resharing_by_rounds(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)
        assert got[s] <= 2 * sizes[s] + 1e-6


def test_takes_come_near_the_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 5}" if i % 3 else "s0", "x") for i in range(600)] + [(None, None, None, "x"), (601, "", None, "x"), (602, "a b", None, "x"), (1, "w w ", "s0", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.largest).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))


def test_weights_favour_documents(spark):
    rows = [(i, "a b c d", "stu"[i // 300], "x") for i in range(900)]
    weights = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(900)], "doc_id long, weight double")
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights).where("source = 't'").toPandas()
    assert got[got.doc_id % 2 == 1].taken.sum() > got[got.doc_id % 2 == 0].taken.sum()


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,), ("é x y",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [3, 0, 0, 2]


def test_prefix_sums_over_stretches_of_buckets_equal_a_plain_sum(spark, monkeypatch):
    """Many small buckets in stretches of two, hot source and null source, names that clash: taken follows the keys' order as one running sum."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mixing, "RUN_OF_BUCKETS", 2)
    rows = [(i, "w " * (i * 7 % 23 + 1), "hot" if i % 3 else (None if i % 2 else "cold"), i, i, "x", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket long, stretch long, offset string, ahead string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source", dropna=False):
        g = g.sort_values(["key", "doc_id"])
        left, total, want = g.target.iloc[0] - g.epochs.iloc[0] * g.source_size.iloc[0], 0, []
        for size, epochs in zip(g["size"], g.epochs, strict=True):
            total += size
            over = total - left
            drawn = over <= 0 or (total - size < left and over <= left - (total - size))
            want.append(epochs * size + (size if drawn else 0))
        assert list(g.taken) == want
