import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from eventry.llm import exact_dedup, simhash
from eventry.llm._shared import components


def fold(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("steps, parts", [(1, 9), (2, 9), (3, 33), (2, 1)])
def test_exact_dedup_equals_brute_force(docs, odd_texts, steps, parts):
    rng = random.Random(1)
    rows = odd_texts + [(100 + i, rng.choice(["Aa", "aA", "bb", "É", "é"])) for i in range(60)] + [(200 + i, f"T{i % 90}") for i in range(200)]
    got = exact_dedup.exact_dedup(docs(rows).repartition(parts), steps=steps).toPandas()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(fold(t)).hexdigest(), []).append(i)
    for sha, g in got.groupby("text_sha256"):
        ids = groups[sha]
        known = [i for i in ids if i is not None]
        assert len(g) == len(ids) == g.group_size.iloc[0]
        assert g.kept.sum() == 1
        if known:
            assert set(g.keep_id) == {max(known)}
            assert g[g.kept].doc_id.iloc[0] == max(known)


def test_exact_dedup_of_partitions_with_several_batches(small_records, docs, odd_texts):
    """A partition with more rows than an Arrow batch holds (10,000 unless set): groups lie in one batch, over two, and over many."""
    rows = odd_texts + [(100 + i, f"T{i % 9 if i < 60 else i}") for i in range(120)]
    got = exact_dedup.exact_dedup(docs(rows).coalesce(1).union(docs(rows[:40]).coalesce(1))).toPandas()
    groups = {}
    for i, t in rows + rows[:40]:
        groups.setdefault(hashlib.sha256(fold(t)).hexdigest(), []).append(i)
    assert len(got) == len(rows) + 40
    assert {*got.text_sha256} == {*groups}
    for sha, g in got.groupby("text_sha256"):
        assert len(g) == len(groups[sha]) == g.group_size.iloc[0]
        assert g.kept.sum() == 1
        assert set(g.keep_id) == {max(i for i in groups[sha] if i is not None)}


def test_runs_are_merged_chunk_by_chunk(monkeypatch):
    """Runs of one cell, in chunks of three entries, against one sort of all entries; a digest is in several runs, and at the edges of chunks."""
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 3)
    rng, chunks, flat = random.Random(4), [], []
    for crew in (0, 1):
        for run in range(4):
            digests = sorted(rng.sample([hashlib.sha256(bytes([i])).digest() for i in range(40)], 25))
            entries = [(d, 1, 1, rng.randrange(9), run, k, rng.randrange(1, 5)) for k, d in enumerate(digests)]
            flat += [(crew, e) for e in entries]
            chunks += [b.to_pylist()[0] for b in exact_dedup._pack(iter((crew, e) for e in entries), 0, 0)]
    assert max(len(c["n"]) for c in chunks) == 3
    chunks.sort(key=lambda c: (c["crew"], c["span"], c["low"]))
    batches = [pa.RecordBatch.from_pylist(chunks[i : i + 7]) for i in range(0, len(chunks), 7)]
    want = []
    for key, same in itertools.groupby(sorted(flat), lambda x: (x[0], x[1][:2])):
        same = [e for _, e in same]
        want.append((key[0], (*same[-1][:-1], sum(e[-1] for e in same))))
    assert list(exact_dedup._merged(batches)) == want


def test_exact_dedup_keeps_one_row_with_its_columns(docs, odd_texts):
    d = docs(odd_texts)
    kept = exact_dedup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted({fold(t) for _, t in odd_texts})


def test_empty_tables(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.keep_one(docs([])).count() == 0
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def plain_fingerprint(t):
    w = fold(t).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps, ids):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            up[find(i)] = find(j)
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for g in out.values() for i in g}


def test_near_duplicates_equal_brute_force(docs, odd_texts):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [r for r in odd_texts if r[0] is not None]
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "z"
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(5))) for i in range(40)]
    got = simhash.near_duplicates(docs(rows).repartition(5)).toPandas()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_groups(fps, [i for i, _ in rows])
    assert len(got) == len(rows)
    for r in got.itertuples():
        assert r.component_id == want[r.doc_id]
    by_id = dict(zip([i for i, _ in rows], fps, strict=True))
    assert all(r.fp % (1 << 64) == by_id[r.doc_id] for r in got.itertuples())
    assert len({*want.values()}) < len({*fps})


def test_null_ids_are_grouped(docs):
    got = simhash.near_duplicates(docs([(None, "a b c d"), (9, "A b c d"), (None, None)])).toPandas()
    assert sorted(got.component_id.dropna()) == [9, 9]
    assert simhash.keep_one(docs([(None, "a b c d"), (9, "A b c d"), (9, "A b c d")])).count() == 1


def test_every_five_positions_hold_a_group():
    assert all(any({*q} <= {*five} for q in simhash.QUADS) for five in itertools.combinations(range(8), 5))


def joined(fps, pairs):
    """The groups of fps that pairs join, each under its smallest member."""
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in pairs:
        up[find(u % (1 << 64))] = find(v % (1 << 64))
    out = {}
    for f in fps:
        out.setdefault(find(f), []).append(f)
    return {min(g): sorted(g) for g in out.values()}


def wanted(fps):
    groups = plain_groups(fps, fps)
    return {m: sorted(f for f in fps if groups[f] == m) for m in {*groups.values()}}


def test_the_tally_counts_shared_positional_bytes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 500, np.uint64)
    keep = rng.integers(0, 2, (500, 8)).astype(np.uint8) * 255
    y = x ^ (rng.integers(1, 256, (500, 8)).astype(np.uint8) & keep).view(np.uint64).ravel()
    assert (simhash._tally(x ^ y) == (x.view(np.uint8).reshape(-1, 8) == y.view(np.uint8).reshape(-1, 8)).sum(axis=1)).all()


def test_split_postings_lose_no_link(monkeypatch):
    rng = random.Random(5)
    low = 0xABCDEF0123 << 24
    sets = [
        {low | rng.getrandbits(12) for _ in range(200)} | {low | 0xFFF000 | rng.getrandbits(4) for _ in range(10)},
        {low | rng.getrandbits(24) for _ in range(400)} | {low ^ (1 << a | 1 << b | 1 << c) for a in range(8) for b in range(8, 16) for c in range(16, 24)},
        {rng.getrandbits(7) << rng.choice([0, 9, 25, 50]) for _ in range(300)},
    ]
    for fps in map(sorted, sets):
        for pairs in (4, 16, 1024):  # split to the end, in part, and not at all
            monkeypatch.setattr(simhash, "PAIRS", pairs)
            u, v = simhash._posting_edges(np.array(fps, np.uint64))
            assert joined(fps, zip(map(int, u), map(int, v), strict=True)) == wanted(fps)


def test_a_split_posting_tallies_few_pairs(monkeypatch):
    seen, whole = [], simhash._linked
    monkeypatch.setattr(simhash, "_linked", lambda x, y: (seen.append(len(x) * len(y)), whole(x, y))[1])
    fps = np.unique(np.random.default_rng(4).integers(0, 1 << 32, 30_000, np.uint64))
    simhash._posting_edges(fps)
    assert sum(seen) < len(fps) ** 2 / 20


def test_large_postings_are_passed_on_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    small = [2, 3, (1 << 63) - 1]
    tags = [1] * 40 + [2] * 3 + [3] * 12 + [3] * 2 + [4] * 20
    parts = [7] * 40 + [7] * 3 + [7] * 12 + [8] * 2 + [0] * 20
    fps = [*range(40), *small, *range(100, 112), 5, 7, *range(1000, 1020)]
    batch = pa.RecordBatch.from_arrays([pa.array(tags, pa.int32()), pa.array(parts, pa.int64()), pa.array(fps, pa.int64())], names=["tag", "part", "fp"])
    for size in (3, 10, 40, len(tags)):
        rows = [r for b in simhash._solve(False)(batch.slice(a, size) for a in range(0, len(tags), size)) for r in b.to_pylist()]
        passed = sorted((r["tag"], r["u"]) for r in rows if r["v"] is None)
        assert passed == [(1, f) for f in range(40)] + [(3, f) for f in range(100, 112)] + [(4, f) for f in range(1000, 1020)]
        assert [{r["u"], r["v"]} for r in rows if r["v"] is not None] == [{2, 3}, {5, 7}]


def test_large_postings_keep_all_links_of_a_table(spark, monkeypatch):
    rng = random.Random(8)
    fps = sorted({rng.getrandbits(7) << rng.choice([0, 8, 24]) for _ in range(150)} | {1 << a | 1 << b | 1 << c for a in range(4) for b in range(8, 12) for c in range(16, 20)} | {rng.getrandbits(60) for _ in range(50)})
    whole = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "_solve", _with_bucket(simhash._solve, 8))
    found = simhash.fingerprint_links(whole)
    assert joined(fps, [(r.u, r.v) for r in found.collect()]) == wanted(fps)
    roots = {f: f for f in fps} | {r.node: r.root for r in components(found).collect()}
    want = plain_groups(fps, fps)
    assert {frozenset(f for f in fps if roots[f] == g) for g in {*roots.values()}} == {frozenset(f for f in fps if want[f] == g) for g in {*want.values()}}


def _with_bucket(solve, limit):
    """``_solve`` with another ``BUCKET``, in the workers too."""

    def outer(last):
        def run(batches):
            simhash.BUCKET = limit
            try:
                yield from solve(last)(batches)
            finally:
                simhash.BUCKET = 1 << 16

        return run

    return outer


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(chain, "u long, v long")).toPandas()
    roots = dict(zip(got.node, got.root, strict=True))
    assert all(roots[i] == 0 for i in range(1, 41)) and all(roots[100 + i] == 100 for i in range(1, 30))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert isinstance(got, pd.DataFrame)
