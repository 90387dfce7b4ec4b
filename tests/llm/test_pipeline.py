import random

import corpus_pipeline as P

from tests.llm.test_decontaminate import plain as contamination
from tests.llm.test_exact_and_near import fold, plain_fingerprint, plain_groups
from tests.llm.test_models_and_licenses import corpus

PASSAGE = "water through there which running house think this with the water house running through think"


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    rng = random.Random(8)
    rows = corpus(120)
    rows += [(500, rows[3][1], "en", "s"), (501, rows[3][1].upper(), "en", "t"), (502, "12345 ...", None, "s"), (503, None, "en", "s"), (504, f"{rows[5][1]} {PASSAGE}", "en", None), (505, rows[7][1] + " the", "en", "t")]
    rows += [(600 + i, " ".join(rng.choice(["the", "house", "water", "this"]) for _ in range(40)), "en", f"u{i % 3}") for i in range(20)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [r for r in rows if r[0] not in (502, 503)]
    last = {}
    for r in left:
        last[fold(r[1])] = max(last.get(fold(r[1]), -1), r[0])
    left = [r for r in left if last[fold(r[1])] == r[0]]
    groups = plain_groups([plain_fingerprint(r[1]) for r in left], [r[0] for r in left])
    left = [r for r in left if groups[r[0]] == r[0]]
    left = [r for r in left if not contamination(r[1], [(1, PASSAGE)])[1]]
    got = P.run(spark, str(tmp_path)).toPandas()
    assert {*got.doc_id} <= {r[0] for r in left}
    assert (got.taken > 0).all() and (got.taken <= 2 * got["size"]).all()
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    for s, g in got.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == sizes[None if s != s else s]
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "mix_sources"]


def test_dedup_stages_over_partitions_with_several_batches(small_records, spark, docs):
    """More rows in a partition than an Arrow batch holds."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["The", "the", "house", "water", "this"]) for _ in range(rng.choice([2, 40])))) for i in range(150)]
    last = {}
    for i, t in rows:
        last[fold(t)] = i
    found = P.exact_copies(spark, docs(rows).coalesce(2), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(last.values())
    left = [r for r in rows if last[fold(r[1])] == r[0]]
    groups = plain_groups([plain_fingerprint(t) for _, t in left], [i for i, _ in left])
    found = P.near_copies(spark, docs(left).coalesce(2), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in left if groups[i] == i)


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
