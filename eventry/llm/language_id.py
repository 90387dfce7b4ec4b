"""Language identification: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventry.llm._shared import cut, held_out, small_batches, table

BITS = 16
# The fit's bounds: rows of a language, rows of all languages together, characters of the window that a row gives, words of a
# language's lexicon. Whatever the input, one task fits at most ALL_ROWS windows (24 MB of text), or one a language if there are more.
MAX_ROWS, ALL_ROWS, MAX_CHARS, LEXICON = 600, 12_000, 2_000, 3_000
# Sweeps over the sample, sequences of a step, and mixed sequences for each sequence of the sample.
SWEEPS, BATCH, MIXED = 3, 512, 0.5
# So many languages' sizes go to all tasks; more are joined by a shuffle.
FEW_LANGUAGES = 10_000
# Words of a sequence: a sentence, or this many words of a longer one.
SENTENCE = 64
# Letters of a word; longer runs are consecutive words.
LONGEST = 40
# Cells (words times features or labels) that are worked on at once.
CELLS = 8 << 20
UNKNOWN = "und"
# The pipeline rejects a document whose score is nearer to that of an even guess over the n languages, 1/n, than this share of the way to 1.
REJECT = 0.07


def _slot(kind: int, letters: np.ndarray) -> np.ndarray:
    """The feature number of the letter strings along the last axis."""
    h = np.full(letters.shape[:-1], kind + 1, np.uint64)
    for i in range(letters.shape[-1]):
        h = (h ^ letters[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after the other, and how many each has.

    A word has hashed prefixes and suffixes of 1 to 3 letters, itself, n-grams of 2 and 3 with its edges marked, and for each language
    whose lexicon holds it one feature of that language.
    """
    chars = np.array(words, f"<U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST).astype(np.uint64)
    size = (chars > 0).sum(axis=1)
    own = [lexicon.get(w, ()) for w in words]
    width = 7 + 2 * size + 1 + np.array([len(x) for x in own], np.int64)
    begin = np.cumsum(width) - width
    flat = np.empty(width.sum(), np.int64)
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        m = chars[some, :n]
        edged = np.pad(m, ((0, 0), (1, 1)), constant_values=((0, 0), (ord("<"), ord(">"))))
        affixes = [_slot(side + k, m[:, : min(k, n)] if side == 0 else m[:, n - min(k, n) :])[:, None] for side in (0, 3) for k in (1, 2, 3)]
        grams = [_slot(7 + k, np.lib.stride_tricks.sliding_window_view(edged, k, axis=1)) for k in (2, 3) if k <= n + 2]
        found = np.concatenate([*affixes, _slot(7, m)[:, None], *grams], axis=1)
        flat[begin[some][:, None] + np.arange(found.shape[1])] = found
    for i, x in enumerate(own):
        if x:
            flat[begin[i] + width[i] - len(x) : begin[i] + width[i]] = (1 << BITS) + np.array(x)
    return flat, width


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words with letters: row and sequence of each, the distinct words, and each word's number among them.

    Words are maximal runs of letters and marks, lower-cased; a run of more than LONGEST is consecutive words of at most so many. A sequence is a sentence (it ends with . ! ? or a line break).
    """
    low = pc.utf8_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    ended = pc.replace_substring_regex(low, r"[.!?\r\n]+", " . ")
    lists = pc.split_pattern_regex(ended, r"[^\p{L}\p{M}.]+")
    flat = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] if len(lists) else lists.values
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    if any(len(w) > LONGEST for w in words):
        place = {w: i for i, w in enumerate(words)}
        pieces = [[place.setdefault(w[a : a + LONGEST], len(place)) for a in range(0, len(w), LONGEST)] or [i] for i, w in enumerate(words)]
        words, width = list(place), np.array([len(p) for p in pieces])
        times = width[codes]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, codes = np.repeat(row, times), np.concatenate(pieces)[np.repeat((np.cumsum(width) - width)[codes], times) + inside]
    is_word = np.array([any(map(str.isalpha, w)) for w in words], bool)  # marks alone are no word
    stop = np.array([w == "." for w in words], bool)
    if not len(codes):
        return row, row, words, codes
    seq = np.cumsum(stop[codes]) + row
    keep = is_word[codes]
    return row[keep], seq[keep], words, codes[keep]


def _sequences(row: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sequences, at most SENTENCE words each."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (seq[1:] != seq[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    starts = np.flatnonzero(inside % SENTENCE == 0)
    return starts, np.diff(np.append(starts, len(row)))


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of the labels of every word (and, for the fit, the expected transitions), all sequences at once.

    Sequences are sorted by length, so step t works on those that are still running. Messages are normalised each step.
    """
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    top = np.maximum(emit.max(axis=1, keepdims=True), -1e30)
    e, a = np.exp(np.clip(emit - top, -60, 0)), np.exp(trans)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # sequences longer than t
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        k = alive[t]
        at = s[:k] + t
        m = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        alpha[at] = m / m.sum(axis=1, keepdims=True)
    expected = np.zeros_like(trans)
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        at = s[:k] + t
        back = e[at + 1] * beta[at + 1]
        m = back @ a.T
        beta[at] = m / m.sum(axis=1, keepdims=True)
        if pairs:
            joint = alpha[at][:, :, None] * a[None] * back[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), expected


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, list[int]]) -> np.ndarray:
    """Scores of the labels for distinct words."""
    out = np.zeros((len(words), weights.shape[1]))
    step = max(1, CELLS // (64 * weights.shape[1]))
    for a in range(0, len(words), step):
        flat, width = features(words[a : a + step], lexicon)
        out[a : a + step] = np.add.reduceat(weights[flat], np.cumsum(width) - width, axis=0)
    return out


def mixed(y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rng) -> list[np.ndarray]:
    """Sequences that switch: the first words of one sequence, then the last words of one of another language, as places of words."""
    n = int(MIXED * len(starts)) if len({*y[starts]}) > 1 else 0
    a, b = rng.integers(len(starts), size=(2, n)) if n else np.zeros((2, 0), int)
    other = y[starts[a]] != y[starts[b]]
    out = []
    for i, j in zip(a[other], b[other], strict=True):
        head, tail = rng.integers(1, lengths[i] + 1), rng.integers(lengths[j])
        out.append(np.concatenate([np.arange(starts[i], starts[i] + head), np.arange(starts[j] + tail, starts[j] + lengths[j])])[:SENTENCE])
    return out


def fit(texts: pa.Array, labels: np.ndarray, n_labels: int, lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions by AdaGrad steps on the log-likelihood of sequences.

    Each training row has one language, so switches are learnt from sequences mixed of those of two rows.
    """
    row, seq, words, codes = tokenize(texts)
    flat, width = features(words, lexicon)
    begin = np.append(0, np.cumsum(width))
    w, trans = np.zeros(((1 << BITS) + n_labels, n_labels)), np.zeros((n_labels, n_labels))
    g2, t2 = np.full(w.shape, 1e-6), np.full(trans.shape, 1e-6)
    if not len(row):
        return w, trans
    rng = np.random.default_rng(11)
    y_all = labels[row]
    starts, lengths = _sequences(row, seq)
    sequences = [np.arange(s, s + n) for s, n in zip(starts, lengths, strict=True)] + mixed(y_all, starts, lengths, rng)
    for _ in range(SWEEPS):
        for some in np.array_split(rng.permutation(len(sequences)), -(-len(sequences) // BATCH)):
            at = np.concatenate([sequences[i] for i in some])
            n = np.array([len(sequences[i]) for i in some])
            first = np.cumsum(n) - n
            used, word = np.unique(codes[at], return_inverse=True)
            f = np.concatenate([flat[begin[u] : begin[u + 1]] for u in used])
            owner = np.repeat(np.arange(len(used)), width[used])
            emit = np.stack([np.bincount(owner, w[f, k], len(used)) for k in range(n_labels)], axis=1)
            y = y_all[at]
            post, expected = forward_backward(emit[word], first, n, trans, pairs=True)
            diff = -post
            diff[np.arange(len(y)), y] += 1
            per_word = np.stack([np.bincount(word, diff[:, k], len(used)) for k in range(n_labels)], axis=1) / len(at)
            slots, slot = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(slot, per_word[owner, k], len(slots)) for k in range(n_labels)], axis=1) - 1e-7 * w[slots]
            g2[slots] += grad * grad
            w[slots] += 0.3 * grad / np.sqrt(g2[slots])
            inside = np.ones(len(y), bool)
            inside[first] = False
            inside = np.flatnonzero(inside)
            seen = np.bincount(y[inside - 1] * n_labels + y[inside], minlength=n_labels**2).reshape(n_labels, n_labels)
            step = (seen - expected) / len(at) - 1e-3 * trans
            t2 += step * step
            trans += 0.05 * step / np.sqrt(t2)
    return w, trans


def _train(batches):
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    names, lexicon, w, trans = [], {}, np.zeros(((1 << BITS) + 1, 1)), np.zeros((1, 1))
    if tables:
        t = pa.concat_tables(tables).combine_chunks()
        names = sorted(set(t["lang"].to_pylist()))
        number = {x: i for i, x in enumerate(names)}
        y = np.array([number[x] for x in t["lang"].to_pylist()])
        texts = t["t"].combine_chunks()
        row, _, words, codes = tokenize(texts)
        for k in range(len(names)):
            count = np.bincount(codes[y[row] == k], minlength=len(words))
            for i in np.argsort(-count, kind="stable")[:LEXICON]:
                if count[i] > 1:
                    lexicon.setdefault(words[i], []).append(k)
        w, trans = fit(texts, y, len(names), lexicon)
    model = {"names": names, "lexicon": lexicon, "trans": trans.tolist()}
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)]), pa.array([w.astype(np.float32).tobytes()])], names=["model", "w"])


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, all_rows: int = ALL_ROWS) -> DataFrame:
    """``t, lang``: of each language the ``max_rows`` different windows with the smallest hashes, fewer if that exceeds ``all_rows`` in all.

    A row gives one window of at most MAX_CHARS characters, whose place in a longer text its hash tells, so a language that occurs only in
    long texts is learnt, too. Equal windows count once, and so do equal texts: rows whose hash is far from small go first, by the number of different
    texts of the language (a sketch, 2 % off at most times), so only about twice the sample is sorted, and a language of many copies keeps all its texts.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    h = F.xxhash64(text, F.lit("window"))
    windows = F.greatest(F.ceil(F.length(text) / MAX_CHARS), F.lit(1))
    known = labelled.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("t"), h.alias("h"), F.pmod(h, windows).alias("at"))
    sizes = cut(known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")))
    languages = sizes.count()
    each = max(1, min(max_rows, all_rows // max(languages, 1)))
    sizes = F.broadcast(sizes) if languages <= FEW_LANGUAGES else sizes
    # The hash as a share of its range: signed 64-bit, so even few of 10**15 rows are told apart.
    share = F.col("h") / F.lit(2.0**64) + 0.5
    few = known.join(sizes, "lang").where(share * F.col("n") < 2 * each).select("lang", "h", F.substring("t", (F.col("at") * MAX_CHARS + 1).cast("int"), F.lit(MAX_CHARS)).alias("t"))
    few = few.groupBy("lang", "t").agg(F.min("h").alias("h"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    return few.withColumn("_r", first).where(F.col("_r") <= each).select("t", "lang")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS):
    """A model from the ``sample`` of the labelled rows, fitted in one task; equal inputs give equal models."""
    some = sample(labelled, text_col, lang_col, max_rows).repartition(1).sortWithinPartitions(F.xxhash64("t"), "t", "lang")
    return some.mapInArrow(_train, "model string, w binary").first() or next(_train([])).to_pylist()[0]


class Labeller:
    """The trained model in a task."""

    def __init__(self, model):
        m = json.loads(model["model"])
        self.known, self.names = len(m["names"]) > 0, np.array([*m["names"], UNKNOWN], object)
        self.trans, self.lexicon = np.array(m["trans"]), m["lexicon"]
        self.weights = np.frombuffer(model["w"], np.float32).reshape(-1, len(self.trans))
        self.least = (1 - REJECT) / len(self.trans) + REJECT

    def posteriors(self, texts: pa.Array):
        """Blocks of sequences, whole texts in all: row, words and posteriors of the labels of each word."""
        row, seq, words, codes = tokenize(texts)
        if not len(row):
            return
        starts, lengths = _sequences(row, seq)
        used, word = np.unique(codes, return_inverse=True)
        emit = emissions([words[u] for u in used], self.weights, self.lexicon)
        most = max(SENTENCE, CELLS // (8 * len(self.trans)))
        block = starts // most
        for a, b in zip(cuts := np.flatnonzero(np.append(True, block[1:] != block[:-1])), [*cuts[1:], len(starts)], strict=True):
            low, high = starts[a], starts[b - 1] + lengths[b - 1]
            post, _ = forward_backward(emit[word[low:high]], starts[a:b] - low, lengths[a:b], self.trans)
            yield row[low:high], [words[c] for c in codes[low:high]] if self.listed else None, post

    listed = False

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Label and score of every text of a column."""
        n, k = len(texts), len(self.trans)
        sums = np.zeros((n, k))
        for row, _, post in self.posteriors(texts):
            sums += np.stack([np.bincount(row, post[:, i], n) for i in range(k)], axis=1)
        total = sums.sum(axis=1)
        found = (total > 0) & self.known
        best = np.where(found, sums.argmax(axis=1), len(self.names) - 1)
        return self.names[best], np.clip(np.where(found, sums.max(axis=1) / np.maximum(total, 1e-12), 0.0), 0, 1)

    def words(self, texts: pa.Array) -> list[list[dict]]:
        """Every word of every text with its label and posterior."""
        out, self.listed = [[] for _ in range(len(texts))], True
        for row, words, post in self.posteriors(texts):
            for r, w, k, p in zip(row, words, post.argmax(axis=1), post.max(axis=1), strict=True):
                out[r].append({"word": w, "lang": self.names[k] if self.known else UNKNOWN, "score": float(p)})
        return out


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the label with the largest mean posterior over all words of a text, and that mean.

    Texts that are null, empty or without a letter are ``und`` with score 0; long texts count whole; of equal sums the first language
    wins. Ids are whole numbers, or null. Repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        label = Labeller(shared.value)
        for whole in batches:
            for batch in small_batches(whole, 1, 4 << 20):
                names, scores = label(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, words``: every word of a text in order, as (word, lang, score) with its most likely language and posterior.

    Texts that are null or without a letter have no words; repeated rows give repeated rows; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches):
        label = Labeller(shared.value)
        for whole in batches:
            for batch in small_batches(whole, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.words(batch.column(1)), kind)], names=["doc_id", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def train_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """A model from the rows with a language that are not held out."""
    return train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(text_col, lang_col), text_col, lang_col)


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows with a language that are not held out, then label every row."""
    return identify(docs, train_documents(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a known language, with all their columns; rejected are ``und`` and scores near an even guess (REJECT).

    Rows are judged where they lie and passed on, so nothing is shuffled. Null texts and texts without a letter are rejected; long texts
    count whole; repeated rows, ties and rows without an id are judged alike; without any language in the table all rows are rejected; an
    empty table gives no rows; other columns are passed on, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_documents(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches):
        label = Labeller(shared.value)
        for whole in batches:
            for batch in small_batches(whole, at, 4 << 20):
                names, scores = label(batch.column(at))
                yield batch.filter(pa.array((names != UNKNOWN) & (scores >= label.least)))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
