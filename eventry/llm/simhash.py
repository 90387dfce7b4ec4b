"""SimHash near-duplicates: a byte-position index with count filtering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import components, cut, keep_rows, small_batches, table

SHINGLE, SEED, MAX_BITS = 3, 42, 3
# At most MAX_BITS of the 8 bytes differ, so a linked pair shares at least this many positional bytes.
MIN_SHARED = 8 - MAX_BITS
# Postings beyond this size are split by one more byte and dealt again; so are, within a task, groups of more than PAIRS members.
BUCKET, PAIRS = 1 << 16, 1024
# A component's result goes down in so many parts, so that the rows of a large one are spread.
PARTS = 256

_A, _B = ((0, 1, 2, 3), (4, 5, 6, 7))
_MATCHINGS = lambda s: (((s[0], s[1]), (s[2], s[3])), ((s[0], s[2]), (s[1], s[3])), ((s[0], s[3]), (s[1], s[2])))
# A posting of one byte position would hold 1/256 of all rows, so all are split by three more: 14 groups of 4 positions such that any
# 5 of the 8 hold a whole group. Five positions lie 4+1, or 3+2 over two halves; three positions of a half hold one pair of each of its
# three matchings, so also of the one the other two belong to.
QUADS = (_A, _B, *(p + q for a, b in zip(_MATCHINGS(_A), _MATCHINGS(_B), strict=True) for p in a for q in b))


def _mask(places, but: int = 0) -> int:
    """The bits of some byte positions, but for one bit of the last of them, as a signed number."""
    bits = sum(0xFF << (56 - 8 * p) for p in places) & ~(but << (56 - 8 * places[-1]))
    return bits - (1 << 64) if bits >> 63 else bits


def _levels() -> list[list[tuple[int, int, int]]]:
    """How each level splits postings: ``(tag of the posting, tag of a part, the bits that a part shares)``.

    Of four free bytes a linked pair shares one. Of three it shares one, or all but one bit of one.
    """
    one, two, three = [], [], []
    for quad in QUADS:
        one.append((0, len(one) + 1, _mask(quad)))
        for p in (p for p in range(8) if p not in quad):
            two.append((len(one), len(two) + 1, _mask((*quad, p))))
            for q in (q for q in range(8) if q not in (*quad, p)):
                for but in (0, *(1 << b for b in range(8))):
                    three.append((len(two), len(three) + 1, _mask((*quad, p, q), but)))
    return [one, two, three]


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a text in UTF-8: per bit the majority over all its shingles' hashes, repeats included."""
    words = raw.lower().split()  # folds A-Z only; splits at space and 0x09-0x0D only
    n = max(len(words) - SHINGLE + 1, 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BUCKET):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(a, min(a + BUCKET, n))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(batches):
    run = TaskContext.get().partitionId()
    for whole in batches:
        for batch in small_batches(whole, 1):
            texts = pc.fill_null(pc.cast(batch.column(1), pa.large_binary()), b"")
            raw = [x.as_buffer().to_pybytes() for x in texts]
            keys = np.array([xxhash.xxh64_intdigest(x, SEED) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array([fingerprint(x) for x in raw], pa.int64()), pa.array(np.full(len(raw), run))],
                names=["doc_id", "key", "fp", "run"],
            )


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``label`` holds each member's smallest known member and stays flat."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (flat := label[label]).tobytes() != label.tobytes():
            label[:] = flat


def _tally(xor: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes two fingerprints share, from the bits in which they differ."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((xor & low) + low) | xor | low))


def _linked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of x and y: those whose tally reaches the guaranteed minimum, then verified on their bits."""
    xor = x[:, None] ^ y[None]
    i, j = np.nonzero(_tally(xor) >= MIN_SHARED)
    near = np.bitwise_count(xor[i, j]) <= MAX_BITS
    return i[near], j[near]


def _meeting(at: np.ndarray, fps: np.ndarray, free: list[int]):
    """Groups of a posting in which all its linked pairs meet; ``free`` are the byte positions that members may differ in.

    Of more than MAX_BITS free bytes a linked pair shares one; of two or three it shares one, or all but one bit of one.
    """
    if len(at) <= PAIRS or len(free) < 2:
        yield at
        return
    for p in free:
        byte = (fps[at] >> np.uint64(56 - 8 * p)).astype(np.uint8)
        for but in (0, *(1 << b for b in range(8) if len(free) <= MAX_BITS)):
            key = byte & np.uint8(255 - but)
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                # Members with the same byte have met already.
                if len(part) > 1 and not (but and (byte[part] == byte[part[0]]).all()):
                    yield from _meeting(at[part], fps, [q for q in free if q != p])


def _posting_edges(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links among the distinct fingerprints of one posting."""
    if len(fps) == 2:
        tied = len(_linked(fps[:1], fps[1:])[0])
        return fps[2 - tied :], fps[:tied]
    label = np.arange(len(fps))
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [p for p in range(8) if differ >> (56 - 8 * p) & 255]
    for at in _meeting(label.copy(), fps, free):
        step = max(1, (1 << 20) // len(at))
        for a in range(0, len(at), step):
            i, j = _linked(fps[at[a : a + step]], fps[at[a:]])
            _unite(label, at[i + a], at[j + a])
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return fps[tied], fps[label[tied]]


_LINKS = "tag int, u long, v long"


def _solve(last: bool):
    """Postings, sorted by (tag, part), to links; those beyond BUCKET are passed on whole (u = fp, v = null) unless ``last``."""

    def run(batches):
        def rows(tag, u, v=None):
            v = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), tag, np.int32)), pa.array(u.view(np.int64)), v], names=["tag", "u", "v"])

        out, held = [], 0

        def done():
            """Keep the links of the posting that ends here, unless it has been passed on."""
            if not big and size > 1:
                u, v = _posting_edges(np.concatenate(parts))
                out.append((u, v))
                return len(u)
            return 0

        key, parts, size, big = None, [], 0, False
        for batch in batches:
            tags, part, fps = (batch.column(i).to_numpy() for i in range(3))
            fps = fps.view(np.uint64)
            first = np.flatnonzero(np.append(True, (tags[1:] != tags[:-1]) | (part[1:] != part[:-1]))) if len(tags) else []
            for a, b in zip(first, [*first[1:], len(tags)], strict=True):
                if (tags[a], part[a]) != key:
                    held += done()
                    key, parts, size, big = (tags[a], part[a]), [], 0, False
                parts.append(fps[a:b])
                size += b - a
                if not last and size > BUCKET:
                    yield rows(tags[a], np.concatenate(parts))
                    parts, big = [], True
            if held > 1 << 14:
                yield rows(0, *map(np.concatenate, zip(*out, strict=True)))
                out, held = [], 0
        done()
        if out:
            yield rows(0, *map(np.concatenate, zip(*out, strict=True)))

    return run


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints ``fp``: a spanning forest of each posting, none lost.

    The index posts each fingerprint under its positional bytes, in 14 groups of 4: a pair that shares the guaranteed 5 bytes shares a
    whole group. In a posting the shared positional bytes of pairs are tallied, pairs below 5 go, and the bits of the others are
    compared; only a forest of the links is kept. A posting beyond ``BUCKET`` is split by one more byte and dealt again; one that is
    still beyond it is split by a third rule, after which a posting has at most 2**17 members. A task splits in the same way
    groups of more than ``PAIRS``, so no task compares all pairs of a large posting.
    """
    spark = fps.sparkSession
    rows, found = fps.select(F.lit(0).alias("tag"), "fp"), []
    levels = _levels()
    for k, level in enumerate(levels):
        splits = F.broadcast(spark.createDataFrame(level, "tag int, to int, mask long"))  # a fixed list
        posted = rows.join(splits, "tag").select(F.col("to").alias("tag"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        last = k == len(levels) - 1
        solved = posted.repartition("tag", "part").sortWithinPartitions("tag", "part", "fp").mapInArrow(_solve(last), _LINKS)
        solved = solved if last else cut(solved)
        found.append(solved.where("v IS NOT NULL").select("u", "v"))
        rows = solved.where("v IS NULL").select("tag", F.col("u").alias("fp"))
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints, and the groups that chains of links of at most 3 differing bits make.

    Returns one row per input row: ``doc_id, key, fp, component_id, kept``. ``component_id`` is the smallest id reachable;
    ``key`` is the hash of the text (with the id it names the row), and ``kept`` marks the row of each group that stays: the
    smallest id, nulls last, then key. Repeated rows share all values. Null, empty and blank texts have fingerprint 0, which links
    like any other. An empty table gives no rows; other columns are ignored.
    """
    marked = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(_fingerprints, "doc_id long, key long, fp long, run long"))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key"))
    classes = cut(marked.groupBy("fp").agg(smallest.alias("first")))
    roots = components(fingerprint_links(classes.select("fp")))
    tied = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first")
    # The root itself is no node of the settled stars.
    root_rows = classes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", F.col("fp").alias("root"), "first")
    members = tied.union(root_rows)
    best = members.groupBy("root").agg(F.min("first").alias("best"))
    parted = members.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)))
    best = parted.select("root", "part").distinct().join(best, "root")
    best = parted.join(best, ["root", "part"]).select("fp", "best")
    classes = classes.join(best, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"))
    # Results go down to each run (input partition) once, then to its rows: a fingerprint of many copies is spread over the runs.
    down = marked.select("run", "fp").distinct().join(classes, "fp")
    return marked.join(down, ["run", "fp"]).select(
        "doc_id", "key", "fp", F.col("best.doc_id").alias("component_id"), (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.key") == F.col("key"))).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per near-duplicate group, with all their columns.

    Of a group the smallest id stays (nulls last), then the smallest text hash; of rows that agree in both, any one. Null, empty and
    blank texts are one group; long texts count whole; an empty table gives no rows; other columns are passed on, whatever their names.
    """
    kept = near_duplicates(docs, id_col, text_col).where("kept").select("doc_id", "key").distinct()
    return keep_rows(docs, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), kept)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
