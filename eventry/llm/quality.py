"""Quality classifier: naive Bayes support vectors (n-gram indicators scaled by log-count ratios, linear hinge loss)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventry.llm._shared import cut, held_out, small_batches, table

BITS = 18
# The fit's bounds: labelled texts (half of each class) that the log-count ratios and the hinge loss are fitted on, characters of the window that a row gives.
MAX_ROWS, MAX_CHARS = 8_000, 20_000
SWEEPS, COST, SMOOTH = 8, 1.0, 1.0
# Words of an n-gram whose pattern of equal words is an indicator.
PATTERN = 6
# Words of more bytes are hashed one by one.
LONGEST = 64
CUT = 0.7


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes and its length, of strings beyond LONGEST bytes XXH64."""
    data = pc.cast(words, pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    h = (ends - starts).astype(np.uint64)
    for i in np.flatnonzero(ends - starts > LONGEST):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    alive, at = np.flatnonzero((ends > starts) & (ends - starts <= LONGEST)), 0
    while len(alive):
        h[alive] = h[alive] * np.uint64(0x100000001B3) + raw[starts[alive] + at]
        at += 1
        alive = alive[starts[alive] + at < ends[alive]]
    return _mix(h)


def _patterns(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the PATTERN words from each start the first equal one of each, as digits of one number."""
    code = np.zeros(len(starts), np.uint64)
    for i in range(PATTERN):
        first = np.full(len(starts), i, np.uint64)
        for j in reversed(range(i)):
            first[words[starts + i] == words[starts + j]] = j
        code = code * np.uint64(PATTERN) + first
    return code


def ngram_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram indicators of whole texts: row numbers and feature numbers, each pair once, sorted.

    The n-grams are the words as they stand, their shapes (letters to classes, so that case, digits and marks count without the
    word), pairs of neighbouring words and of neighbouring shapes, and the patterns of PATTERN neighbouring words (which of them are
    equal, whatever they are); words are runs of characters other than white space.
    """
    lists = pc.split_pattern_regex(pc.cast(pc.fill_null(texts, ""), pa.large_string()), r"[ \t-\r]+")
    coded = pc.dictionary_encode(lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] if len(lists) else lists.values)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    words = coded.dictionary
    codes = np.asarray(coded.indices)
    shapes = words
    for pattern, to in ((r"\p{Lu}+", "X"), (r"\p{Ll}+|\p{L}+", "x"), (r"[0-9]+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, to)
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    row, codes = row[keep], codes[keep]
    w, s = _word_hashes(words)[codes], _word_hashes(shapes)[codes]
    same = row[1:] == row[:-1]
    salt = lambda h, n: _mix(h + np.uint64(n))
    pair = lambda h: _mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[same]
    whole = np.flatnonzero(row[PATTERN - 1 :] == row[: len(row) - PATTERN + 1]) if len(row) >= PATTERN else np.zeros(0, np.int64)
    feats = np.concatenate([salt(w, 1), salt(s, 2), salt(pair(w), 3), salt(pair(s), 4), salt(_patterns(w, whole), 5)])
    rows = np.concatenate([row, row, row[1:][same], row[1:][same], row[whole]])
    both = np.unique((rows.astype(np.int64) << BITS) | (feats >> np.uint64(64 - BITS)).astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights per feature (with the ratios folded in), bias, and the slope and offset of the margin's logistic curve."""
    size = 1 << BITS
    pos, neg = (np.full(size, SMOOTH) for _ in range(2))
    for x, y in zip(rows, labels, strict=True):
        (pos if y > 0 else neg)[x] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    n_pos, n_neg = max((labels > 0).sum(), 1), max((labels <= 0).sum(), 1)
    cost = np.where(labels > 0, COST * len(labels) / (2 * n_pos), COST * len(labels) / (2 * n_neg))
    # Dual coordinate descent on max(0, 1 - y w.x) with rows of unit length; the last coordinate is the bias.
    values = []
    for x in rows:
        v = ratio[x]
        values.append((v / max(np.sqrt((v * v).sum()), 1e-9)).astype(np.float32))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(SWEEPS):
        for i in order.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            q = float((v * v).sum()) + 1.0
            gradient = y * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / q, 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
    margins = np.array([float(w[x] @ v) + bias for x, v in zip(rows, values, strict=True)])
    slope, offset = _logistic(margins, labels)
    return w, ratio, bias, slope, offset


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps with his smoothed targets; the slope stays positive."""
    n_pos, n_neg = (labels > 0).sum(), (labels <= 0).sum()
    t = np.where(labels > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    weight = np.where(labels > 0, 0.5 / max(n_pos, 1), 0.5 / max(n_neg, 1)) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def _train(batches):
    rows, labels = [], []
    for whole in batches:
        for batch in small_batches(whole, 0, 4 << 20):
            row, feature = ngram_features(batch.column(0))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            rows += [feature[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
            labels += [1.0 if y == 1 else -1.0 for y in batch.column(1).to_pylist()]
    if rows and len({*labels}) == 2:
        w, ratio, bias, slope, offset = fit(rows, np.array(labels))
    else:  # nothing to learn from, or one class: the share of label 1
        w, ratio, bias, slope = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0
        offset = 0.0 if not rows else 2.0 * labels[0]
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([ratio.astype(np.float32).tobytes()]), *(pa.array([float(x)]) for x in (bias, slope, offset))], names=["w", "ratio", "bias", "slope", "offset"])


def sample(docs: DataFrame, known: DataFrame, id_col: str = "_d", text_col: str = "_t", max_rows: int = MAX_ROWS) -> DataFrame:
    """``t, y, h``: of each class (label 1, or another) the ``max_rows / 2`` different texts with the smallest hashes, a window of each.

    ``known`` has one row per id (``_id, _y``). A text gives one window of at most MAX_CHARS characters, whose place in a longer text its hash tells. Ids and hashes
    meet the labels, not texts; equal texts count once, and a class of many copies keeps its texts, because hashes far from small go by the number of
    different ones in the class (a sketch). The chosen hashes, ``max_rows`` at most, are sent to the texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_i"), text.alias("t"), F.xxhash64(text, F.lit("window")).alias("h"))
    labelled = cut(rows.select("_i", "h").join(known, F.col("_i") == F.col("_id")).groupBy("h", F.col("_y").cast("int").alias("y")).agg(F.lit(1).alias("one")))
    labelled = labelled.select("h", "y", F.coalesce(F.col("y") == 1, F.lit(False)).alias("good"))
    each = max(1, max_rows // 2)
    sizes = labelled.groupBy("good").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # The hash as a share of its range: 64 bits, so even few of 10**15 rows are told apart.
    few = labelled.join(F.broadcast(sizes), "good").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") < 2 * each)  # two rows
    first = F.row_number().over(Window.partitionBy("good").orderBy("h", "y"))
    chosen = few.withColumn("_r", first).where(F.col("_r") <= each).select(F.col("h").alias("_h"), "y")
    at = F.pmod(F.col("h"), F.greatest(F.ceil(F.length("t") / MAX_CHARS), F.lit(1))) * MAX_CHARS + 1
    windows = rows.join(F.broadcast(chosen), F.col("h") == F.col("_h")).select(F.substring("t", at.cast("int"), F.lit(MAX_CHARS)).alias("t"), "y", "h")
    return windows.groupBy("h", "y").agg(F.min("t").alias("t")).select("t", "y", "h")


def train(docs: DataFrame, known: DataFrame, id_col: str = "_d", text_col: str = "_t", max_rows: int = MAX_ROWS):
    """A model from the ``sample`` of the labelled rows, fitted in one task: one row, of 2 MB whatever the input. Equal inputs give equal models."""
    one = sample(docs, known, id_col, text_col, max_rows).repartition(1).sortWithinPartitions("h", "t", "y")
    found = one.select("t", "y").mapInArrow(_train, "w binary, ratio binary, bias double, slope double, offset double").first()
    return found or next(_train([])).to_pylist()[0]


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null and empty texts have no n-gram and get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        w, ratio = np.frombuffer(m["w"], np.float32).astype(np.float64), np.frombuffer(m["ratio"], np.float32).astype(np.float64)
        weight, square = w * ratio, ratio * ratio
        for whole in batches:
            for batch in small_batches(whole, 1, 4 << 20):
                row, feature = ngram_features(batch.column(1))
                n = batch.num_rows
                norm = np.sqrt(np.bincount(row, square[feature], n))
                margin = np.bincount(row, weight[feature], n) / np.maximum(norm, 1e-9) + m["bias"]
                p = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the bias alone; long texts count whole; repeated rows give repeated rows; ids are whole numbers, or null; rows with
    a null id are never learnt from; conflicting labels of an id count as its largest; without labels all scores are 0.5; an empty table
    gives no rows; other columns are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).where(~held_out("_d"))
    model = train(texts, known)
    return score(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
