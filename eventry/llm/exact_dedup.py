"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import LOWER, UPPER, binary_rows, cut, fold_case, keep_rows, small_batches, table

_LEAF = "id long, digest binary, n_bytes long, run long, pos long"
_RUN = "run long, digest binary, n_bytes long, has_id int, id long, pos_run long, pos long, n long"
# An entry of a run, in the order that sorts entries: of equal digests and lengths the last is the one that stays.
_ENTRY = ("digest", "n_bytes", "has_id", "id", "pos_run", "pos", "n")
_CHUNK = "crew long, span long, low binary, digest array<binary>, n_bytes array<long>, has_id array<int>, id array<long>, pos_run array<long>, pos array<long>, n array<long>"
# Entries of a run that travel in one row.
CHUNK_ROWS = 1024


def _leaves(batches):
    """One row per document: the digest of its folded text, and the run (input partition) it lies in."""
    run, at = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in small_batches(whole, 1):
            texts = pc.fill_null(pc.cast(batch.column(1), pa.large_binary()), b"")
            digests, sizes = [], []
            for text in texts:
                raw = text.as_buffer().to_pybytes().lower()  # bytes.lower() folds A-Z only
                digests.append(hashlib.sha256(raw).digest())
                sizes.append(len(raw))
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.full(n, run), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())],
                names=["id", "digest", "n_bytes", "run", "pos"],
            )
            at += n


def _sorted_run(batches):
    """Rows of one partition sorted by (digest, n_bytes, id, place) to its run: one row per (digest, n_bytes), the last, with summed counts.

    The last group of a batch is carried to the next, so memory is bounded by a batch whatever the size of a group.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        if held is not None:
            whole = pa.concat_tables([held, whole])
        whole = whole.combine_chunks()
        size, digest = whole["n_bytes"].to_numpy(), binary_rows(whole["digest"], 32)
        # Equal neighbours are verified on every byte of the digest and on the length of the text.
        new = np.ones(len(size), bool)
        new[1:] = (size[1:] != size[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(size)) - 1
        kept = whole.take(pa.array(last))
        # The field stays as it came, nullable or not: what is held must fit the next batch.
        at = whole.schema.get_field_index("n")
        kept = kept.set_column(at, whole.schema.field(at), pa.array(np.add.reduceat(whole["n"].to_numpy(), first), pa.int64()))
        held = kept.slice(len(last) - 1)
        yield from kept.slice(0, len(last) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _span(digest: bytes, bits: int) -> int:
    """Which of 2^bits equal ranges of digests holds this one."""
    return int.from_bytes(digest[:4], "big") >> (32 - bits)


def _pack(entries, shift: int, bits: int):
    """Sorted ``(crew, entry)`` to rows of at most CHUNK_ROWS entries; a row lies in one cell (crew, span) of the next round."""
    schema = pa.schema([("crew", pa.int64()), ("span", pa.int64()), ("low", pa.binary())] + [
        (f, pa.list_(pa.binary() if f == "digest" else pa.int32() if f == "has_id" else pa.int64())) for f in _ENTRY
    ])
    for (crew, span), cell in groupby(entries, lambda e: (e[0] >> shift, _span(e[1][0], bits))):
        for chunk in batched((e for _, e in cell), CHUNK_ROWS):
            row = {"crew": crew, "span": span, "low": chunk[0][0], **dict(zip(_ENTRY, map(list, zip(*chunk, strict=True)), strict=True))}
            yield pa.RecordBatch.from_pylist([row], schema)


def _one_each(entries):
    """Sorted entries to one per digest and length: the last, with summed counts. All 32 bytes and the length are compared."""
    for _, same in groupby(entries, lambda e: e[:2]):
        same = list(same)  # at most one per run
        yield (*same[-1][:-1], sum(e[-1] for e in same))


def _merged(batches):
    """Chunks sorted by (crew, span, lowest digest) to the merged runs of their cells, as sorted ``(crew, entry)``.

    What lies below the lowest digest of the next chunk is final and goes on, so a task holds one chunk of each of its runs.
    """
    cell, held = None, []
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a batch has many chunks
            entries = list(zip(*(row[f] for f in _ENTRY), strict=True))
            done = bisect_left(held, (row["low"],)) if cell == (row["crew"], row["span"]) else len(held)
            yield from ((cell[0], e) for e in held[:done])
            cell, held = (row["crew"], row["span"]), list(_one_each(heapq.merge(held[done:], entries)))
    yield from ((cell[0], e) for e in held)


def _deal(shift: int, bits: int):
    """The runs of the partitions, cut into the cells of the first round."""

    def deal(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _pack(((row["run"], tuple(row[f] for f in _ENTRY)) for row in rows), shift, bits)

    return deal


def _round(shift: int, bits: int):
    """Merge the runs that met in a cell, and cut the result into the cells of the next round."""
    return lambda batches: _pack(_merged(batches), shift, bits)


def _tree_merge(runs: DataFrame, n_runs: int, steps: int) -> DataFrame:
    """Merge ``n_runs`` sorted runs in binomial rounds: one entry per digest and length.

    In a binomial step, runs whose numbers differ in one bit exchange halves: each keeps half of the digests that it holds and merges what its partner sends
    of them. A round does ``steps`` steps at once, so 2^steps sorted runs are merged at a time. After b steps a cell is a crew of 2^b partitions and one of
    2^b equal ranges of digests, so that all partitions work in each round, and a cell never grows beyond what a partition began with (digests are uniform).
    """
    total = max(n_runs - 1, 0).bit_length()
    done = min(steps, total)
    level = runs.mapInArrow(_deal(done, done), _CHUNK)
    k = 0
    while True:
        ahead = min(done + steps, total)
        level = level.repartition("crew", "span").sortWithinPartitions("crew", "span", "low").mapInArrow(_round(ahead - done, ahead), _CHUNK)
        k += 1
        if done == total:
            break
        level, done = cut(level) if k % 4 == 0 else level, ahead
    return level.select(F.inline(F.arrays_zip(*_ENTRY)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 2) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z; of each group the row with the largest id stays.

    Every input partition makes one sorted run of (digest, largest id, count). Runs are exchanged in binomial rounds (``steps`` bits of the run number each)
    and merged as they stand, without another sort of their entries; each level verifies all 32 digest bytes and the length, and keeps the
    largest identifier. A digest has at most one entry per run, so a group with a third of all rows never meets in one task.
    The results go back down by (digest, run), which is no hotter than the runs themselves.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Ids are whole numbers. A null text counts as empty; long texts count whole.
    Null ids are smaller than all others. Of repeated rows with the same id exactly one has ``kept``. An empty table gives no rows.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    leaf = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_leaves, _LEAF))
    rows = leaf.select(
        "run", "digest", "n_bytes", F.col("id").isNotNull().cast("int").alias("has_id"), F.coalesce("id", F.lit(0)).alias("id"),
        F.col("run").alias("pos_run"), "pos", F.lit(1).cast("long").alias("n"),
    )
    runs = cut(rows.sortWithinPartitions("run", "digest", "n_bytes", "has_id", "id", "pos_run", "pos").mapInArrow(_sorted_run, _RUN))
    n_runs = leaf.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    top = _tree_merge(runs, n_runs, steps) if n_runs > 1 else runs
    top = top.select("digest", "n_bytes", "has_id", F.col("id").alias("keep"), F.col("pos_run").alias("keep_run"), F.col("pos").alias("keep_pos"), F.col("n").alias("group_size"))
    down = runs.select("run", "digest", "n_bytes").join(top, ["digest", "n_bytes"])
    return leaf.join(down, ["run", "digest", "n_bytes"]).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("has_id") == 1, F.col("keep")).alias("keep_id"),
        "group_size",
        ((F.col("run") == F.col("keep_run")) & (F.col("pos") == F.col("keep_pos"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per group of equal texts, with all their columns.

    The largest id of a group stays, nulls being smaller than all; of rows that agree in id and folded text, any one. Null and empty
    texts are equal; long texts count whole; an empty table gives no rows; other columns are passed on, whatever their names.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256")
    return keep_rows(docs, id_col, F.sha2(fold_case(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256), kept)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
}
