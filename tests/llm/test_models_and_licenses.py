import random

import duckdb
import numpy as np

from eventry.llm import language_id as L
from eventry.llm import license_scan as S
from eventry.llm import quality as Q

EN = ["the", "house", "which", "think", "water", "this", "there", "running", "with", "through"]
DE = ["der", "haus", "welche", "denken", "wasser", "dieses", "dort", "schlafen", "mit", "durch"]


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = EN if i % 2 else DE
        rows.append((i, ". ".join(" ".join(rng.choice(lang) for _ in range(8)) for _ in range(3)), "en" if i % 2 else "de", "s"))
    return rows


def test_languages_of_held_out_and_odd_rows(docs, odd_texts):
    rows = corpus() + [(1000 + (i or 0), t, None, "s") for i, t in odd_texts] + [(3000, "123 ... !", None, "s"), (3002, "\u0301 \u0308", None, "s"), (3001, "der the haus house der the haus house", None, "s")]
    d = docs(rows)
    got = L.identify_documents(d).toPandas()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    known = got[got.doc_id.isin(truth)]
    assert (known.lang_pred == known.doc_id.map(truth)).mean() > 0.99
    by = got.set_index("doc_id")
    assert (by.lang_pred[[1001, 1002, 1003, 3000, 3002]] == "und").all() and (by.score[[1001, 3000]] == 0).all()
    assert got.score.between(0, 1).all() and by.score[3001] < 0.95
    kept = L.keep_known(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} >= {*truth} and not {1001, 1002, 3000} & {r.doc_id for r in kept.collect()}


def test_without_languages_everything_is_und(docs):
    got = L.identify_documents(docs([(1, "some text", None, "s"), (2, None, None, "s")])).toPandas()
    assert {*got.lang_pred} == {"und"}
    assert L.identify_documents(docs([])).count() == 0


def test_every_letter_of_a_long_run_is_read():
    import pyarrow as pa

    run = "".join(chr(ord("a") + i * 7 % 26) for i in range(1000))
    row, seq, words, codes = L.tokenize(pa.array(["short one. " + run, None, "", f"{run[:40]} {run[:41]}! {run[:80]} end", "短" * 100]))
    text = [[words[c] for c in codes[row == i]] for i in range(5)]
    assert text[0][:2] == ["short", "one"] and "".join(text[0][2:]) == run and max(map(len, text[0])) == 40
    assert text[1] == text[2] == [] and text[3] == [run[:40], run[:40], run[40], run[:40], run[40:80], "end"]
    assert [len(w) for w in text[4]] == [40, 40, 20] and len({*words}) == len(words)
    assert len({*seq[row == 0]}) == 2 and len({*seq[row == 3]}) == 2
    model = L.train.__globals__["_train"](iter([pa.RecordBatch.from_pydict({"t": [" ".join(EN), " ".join(DE)] * 60, "lang": ["en", "de"] * 60})]))
    label = L.Labeller(next(model).to_pylist()[0])
    one, two = (label(pa.array(["wasser" * 6 + "wass" + tail]))[1][0] for tail in ("", "this" * 200))
    assert abs(one - two) > 1e-6


def plain_slots(word, lexicon):
    """The features of a word, one by one."""

    def slot(kind, letters):
        h = kind + 1
        for c in letters:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            h ^= h >> 29
        return h >> 64 - L.BITS

    edged = f"<{word}>"
    out = [slot(k, word[:k]) for k in (1, 2, 3)] + [slot(3 + k, word[-k:]) for k in (1, 2, 3)] + [slot(7, word)]
    out += [slot(7 + k, edged[i : i + k]) for k in (2, 3) for i in range(len(edged) - k + 1)]
    return out + [(1 << L.BITS) + k for k in lexicon.get(word, ())]


def trained(seed=1):
    import pyarrow as pa

    rng = random.Random(seed)
    rows = [" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(150) for words in (EN, DE)]
    return next(L._train(iter([pa.RecordBatch.from_pydict({"t": rows, "lang": ["en", "de"] * 150})]))).to_pylist()[0]


def test_features_equal_a_plain_loop():
    words = ["a", "ab", "abc", "wasser", "日本語", "é", "x" * 40, "the"]
    flat, width = L.features(words, {"the": [0, 2], "ab": [1]})
    ends = np.cumsum(width)
    for w, a, b in zip(words, ends - width, ends, strict=True):
        assert flat[a:b].tolist() == plain_slots(w, {"the": [0, 2], "ab": [1]})


def test_scores_equal_brute_force(monkeypatch):
    import itertools
    import json

    import pyarrow as pa

    model = trained()
    m, w = json.loads(model["model"]), np.frombuffer(model["w"], np.float32).reshape(-1, 2).astype(float)
    texts = ["The house water. der the haus", "denken Wasser mit house! zzz", "日本 the"]
    want = []
    for t in texts:
        posts = []
        for sentence in t.lower().replace("!", ".").split("."):
            words = sentence.split()
            if not words:
                continue
            emit = np.array([w[plain_slots(x, m["lexicon"])].sum(axis=0) for x in words])
            paths = list(itertools.product(range(2), repeat=len(words)))
            score = np.array([sum(emit[i, k] for i, k in enumerate(p)) + sum(m["trans"][a][b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
            weight = np.exp(score - score.max())
            weight /= weight.sum()
            posts += [[sum(x for p, x in zip(paths, weight, strict=True) if p[i] == k) for k in range(2)] for i in range(len(words))]
        want.append(np.mean(posts, axis=0))
    for cells in (1, L.CELLS):
        monkeypatch.setattr(L, "CELLS", cells)
        names, scores = L.Labeller(model)(pa.array(texts))
        assert names.tolist() == [m["names"][int(np.argmax(x))] for x in want] and np.allclose(scores, [x.max() for x in want], atol=1e-5)


def test_words_of_switched_text(docs):
    import json

    model = trained(2)
    trans = np.array(json.loads(model["model"])["trans"])
    assert trans[0, 0] > trans[0, 1] and trans[1, 1] > trans[1, 0] and np.isfinite(trans).all()
    switched = [(1, "the water which think der haus wasser schlafen there running"), (2, None), (3, "haus 12 house"), (None, "")]
    by = {r.doc_id: [(w.word, w.lang) for w in r.words] for r in L.label_words(docs(switched), model).collect()}
    assert [x for _, x in by[1]] == ["en"] * 4 + ["de"] * 4 + ["en"] * 2 and [w for w, _ in by[1]] == switched[0][1].split()
    assert by[2] == by[None] == [] and [w for w, _ in by[3]] == ["haus", "house"]


def test_a_text_whose_language_changes_after_forty_letters(docs):
    import pyarrow as pa

    rng = random.Random(9)
    runs = {k: ["".join(rng.choice(letters) for _ in range(30)) for _ in range(150)] for k, letters in (("en", "abcdefgh"), ("de", "qrstuvwx"))}
    batch = pa.RecordBatch.from_pydict({"t": [t for k in runs for t in runs[k]], "lang": [k for k in runs for _ in runs[k]]})
    model = next(L._train(iter([batch]))).to_pylist()[0]
    text = "abcdefgh" * 5 + "qrstuvwx" * 30
    assert [w["lang"] for w in L.Labeller(model).words(pa.array([text]))[0]] == ["en"] + ["de"] * 6
    assert L.Labeller(model)(pa.array([text]))[0][0] == "de"


def test_the_sample_is_bounded_and_whole(docs, monkeypatch):
    rows = [(i, f"text number {i}", "en" if i % 2 else "de", "s") for i in range(400)] + [(1000 + i, "one hot text", "en", "s") for i in range(300)]
    rows += [(2000 + i, f"long {i} " + "wörter " * 5_000, "xx", "s") for i in range(3)] + [(3000, None, "en", "s"), (3001, "no language", None, "s")]
    got = L.sample(docs(rows), max_rows=50).toPandas()
    assert got.groupby("lang").size().le(50).all() and set(got.lang) == {"en", "de", "xx"} and (got.lang == "xx").sum() == 3
    assert not got.duplicated().any() and got.t.str.len().max() <= L.MAX_CHARS and (got.lang == "de").sum() > 40
    small = L.sample(docs(rows), max_rows=50, all_rows=30).toPandas()
    assert small.groupby("lang").size().to_dict() == {"de": 10, "en": small.groupby("lang").size()["en"], "xx": 3} and len(small) <= 30
    assert L.sample(docs([])).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([3, 4])
    post, expected = L.forward_backward(emit, np.array([0, 3]), lengths, trans, pairs=True)
    want, pairs = np.zeros_like(post), np.zeros((3, 3))
    for s, n in ((0, 3), (3, 4)):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.array([np.exp(sum(emit[s + i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, k in enumerate(p):
                want[s + i, k] += x
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += x
    assert np.allclose(post, want) and np.allclose(expected, pairs)


def test_quality_on_held_out_rows(spark, docs, odd_texts):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [rng.choice(EN) for _ in range(30)]
        rows.append((i, " ".join(words) if good else " ".join(w + "$$$" for w in words)))
        labels.append((i, int(good)))
    labels += [(5, 0), (5, 1), (None, 1), (9_999, 1), (7, None)]
    d = docs(rows + [(1000 + (i or 0), t) for i, t in odd_texts])
    got = Q.classify_quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert len(got) == len(rows) + len(odd_texts)
    held = got[got.held_out & (got.doc_id < 300)]
    assert len(held) > 30 and (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert got[got.doc_id.isin([1001, 1002, 1003])].score.nunique() == 1
    none = Q.classify_quality(d, spark.createDataFrame([], "doc_id long, quality int")).toPandas()
    assert np.allclose(none.score, 0.5)
    assert Q.classify_quality(docs([]), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def plain_ngrams(text):
    """The hashed n-gram indicators of a text, one by one."""
    import re

    import regex
    import xxhash

    full = (1 << 64) - 1

    def mix(h):
        h = ((h ^ h >> 31) * 0x9E3779B97F4A7C15) & full
        return h ^ h >> 29

    def word(w):
        b = w.encode()
        h = len(b)
        for c in b:
            h = (h * 0x100000001B3 + c) & full
        return mix(xxhash.xxh64_intdigest(b) if len(b) > Q.LONGEST else h)

    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    shapes = [re.sub("[0-9]+", "0", regex.sub(r"\p{Ll}+|\p{L}+", "x", regex.sub(r"\p{Lu}+", "X", w))) for w in words]
    pair = lambda a, b: mix((a * 0xC2B2AE3D27D4EB4F + b) & full)
    w, s = [*map(word, words)], [*map(word, shapes)]
    feats = [mix(x + 1 & full) for x in w] + [mix(x + 2 & full) for x in s] + [mix(pair(a, b) + 3 & full) for a, b in zip(w, w[1:], strict=False)] + [mix(pair(a, b) + 4 & full) for a, b in zip(s, s[1:], strict=False)]
    for a in range(len(w) - Q.PATTERN + 1):
        some = words[a : a + Q.PATTERN]
        feats.append(mix(sum(some.index(x) * Q.PATTERN ** (Q.PATTERN - 1 - i) for i, x in enumerate(some)) + 5))
    return sorted({x >> 64 - Q.BITS for x in feats})


def test_indicators_equal_a_plain_loop(odd_texts):
    import pyarrow as pa

    texts = [t for _, t in odd_texts] + ["One TWO three3 $$$ ünï 日本語 a a a", "x" * 100_000 + " y", "日" * 30 + " b", "a" * 64 + " " + "a" * 65]
    row, feature = Q.ngram_features(pa.array(texts))
    for i, t in enumerate(texts):
        assert feature[row == i].tolist() == plain_ngrams(t)


def test_ratios_and_coordinate_descent_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(Q, "BITS", 6)
    rows = [np.unique(rng.integers(0, 64, 12)) for _ in range(40)] + [np.zeros(0, int)]
    labels = np.array([1.0 if 5 in x or 9 in x else -1.0 for x in rows])
    pos, neg = [1 + sum(i in x for x, y in zip(rows, labels, strict=True) if y > 0) for i in range(64)], [1 + sum(i in x for x, y in zip(rows, labels, strict=True) if y < 0) for i in range(64)]
    ratio = [float(np.log(p / sum(pos)) - np.log(n / sum(neg))) for p, n in zip(pos, neg, strict=True)]
    vectors = []
    for x in rows:
        v = [ratio[i] for i in x]
        norm = max(sum(z * z for z in v) ** 0.5, 1e-9)
        vectors.append({int(i): z / norm for i, z in zip(x, v, strict=True)})
    cap = [len(rows) / (2 * (labels == y).sum()) for y in labels]
    for sweeps in (1, 400):
        monkeypatch.setattr(Q, "SWEEPS", sweeps)
        w, bias, alpha, order = [0.0] * 64, 0.0, [0.0] * len(rows), np.random.default_rng(7)
        for _ in range(sweeps):
            for i in order.permutation(len(rows)):
                g = labels[i] * (sum(w[k] * z for k, z in vectors[i].items()) + bias) - 1
                new = min(max(alpha[i] - g / (sum(z * z for z in vectors[i].values()) + 1), 0.0), cap[i])
                for k, z in vectors[i].items():
                    w[k] += (new - alpha[i]) * labels[i] * z
                bias, alpha[i] = bias + (new - alpha[i]) * labels[i], new
        got_w, got_ratio, got_bias, slope, _ = Q.fit(rows, labels)
        assert np.allclose(got_ratio, ratio) and np.allclose(got_w, w, atol=1e-4) and abs(got_bias - bias) < 1e-4 and slope > 0
    # At the optimum the duality gap vanishes.
    loss = sum(c * max(0.0, 1 - y * (sum(w[k] * z for k, z in v.items()) + bias)) for c, y, v in zip(cap, labels, vectors, strict=True))
    assert abs((sum(z * z for z in w) + bias * bias) / 2 + loss - (sum(alpha) - (sum(z * z for z in w) + bias * bias) / 2)) < 1e-2


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "_id long, _y int")


def test_the_labelled_sample_is_bounded_and_dealt_by_class(spark):
    n = 3_000
    texts = [(i, f"text {i} " + "word " * (i % 7)) for i in range(n)] + [(n + i, "one text again") for i in range(500)]
    d = spark.createDataFrame(texts, "_d long, _t string")
    known = labels_of(spark, [(i, int(i % 100 > 0)) for i in range(n + 500)])
    got = Q.sample(d, known, max_rows=100).toPandas()
    assert len(got) == 81 and got.y.value_counts().to_dict() == {1: 50, 0: 31}  # all of the rare class; the text of many copies has both labels
    odd = spark.createDataFrame([(9_000, "long " * 9_000), (9_001, None)], d.schema)
    whole = Q.sample(d.union(odd), known.union(labels_of(spark, [(9_000, 1), (9_001, 1)])), max_rows=100_000).toPandas()
    assert len(whole) == n + 4 and whole.t.str.len().max() == Q.MAX_CHARS and (whole.t == "").sum() == 1
    assert Q.sample(d.limit(0), known).count() == 0 and Q.sample(d, known.limit(0)).count() == 0


def test_copies_of_one_text_leave_both_classes_in_the_sample(spark):
    d = spark.range(43_000).selectExpr("id AS _d", "CASE WHEN id < 40000 THEN 'the one good text of all' ELSE concat('bad text ', id) END AS _t")
    known = spark.range(43_000).selectExpr("id AS _id", "CAST(id < 40000 AS INT) AS _y")
    got = Q.sample(d, known).toPandas()
    assert got.y.value_counts().to_dict() == {0: 3000, 1: 1}
    good = Q.score(d, Q.train(d, known), "_d", "_t").where("doc_id IN (0, 42000)").toPandas().set_index("doc_id").score
    assert good[0] > good[42000]


def test_a_language_of_copies_is_learnt(spark):
    d = spark.range(22_000).selectExpr("id AS doc_id", """CASE WHEN id < 20000 THEN concat('zoq vexi qatu brizz ', element_at(array('um', 'ox', 'iz', 'ek', 'ap'), CAST(id % 5 + 1 AS INT)))
                                                               ELSE concat('the word and thing number ', id, ' of the text') END AS text""", "CASE WHEN id < 20000 THEN 'zz' ELSE 'aa' END AS lang")
    got = L.sample(d).groupBy("lang").count().toPandas().set_index("lang")["count"].to_dict()
    assert got == {"zz": 5, "aa": 600}
    found = L.identify_documents(d).join(d, "doc_id").groupBy("lang", "lang_pred").count().toPandas()
    assert found[found.lang == found.lang_pred]["count"].sum() > 21_900


def test_a_file_takes_its_own_licence_or_the_nearest_above(spark):
    gpl, mit = S.TEMPLATES["GPL-3.0"], S.TEMPLATES["MIT/short"]
    rows = [
        (1, "a/LICENSE", f"{gpl}"), (2, "a/x.txt", "some words"), (3, "a/b/c/y.txt", None), (4, "a/b/LICENSE", mit), (5, "a/b/z.txt", f"text. {gpl}\nmore"), (6, "top.txt", ""), (7, None, mit), (8, None, "none"),
        (2, "a/x.txt", "some words"), (9, "q/LICENSE", "nothing of the kind"), (10, "q/w.txt", "x"), (None, "a/n.txt", "x"), (11, "long/x.txt", "word " * 20_000 + mit),
    ]
    files = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, path string, text string, license string, notice string")
    got = S.scan_licenses(files).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.own_license, r.license, r.from_dir) for r in got}
    assert by[1] == ("GPL-3.0", "GPL-3.0", None) and by[2] == (None, "GPL-3.0", "a") and by[3] == (None, "MIT", "a/b")
    assert by[5] == ("GPL-3.0", "GPL-3.0", None) and by[6] == by[8] == by[9] == by[10] == (None, None, None)
    assert by[7][0] == "MIT" and by[None] == (None, "GPL-3.0", "a")
    assert sum(r.doc_id == 2 for r in got) == 2
    assert S.scan_licenses(files.limit(0)).count() == 0


def test_templates_find_themselves(spark):
    names = list(S.TEMPLATES)
    files = spark.createDataFrame([(i, f"d/{i}.txt", S.TEMPLATES[n]) for i, n in enumerate(names)] + [(100, "d/x.txt", "other text")], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in S.scan_licenses(files).collect()}
    assert got == {i: n.split("/")[0] for i, n in enumerate(names)} | {100: None}


def test_tags_file_names_and_depths(spark):
    rows = [
        ("LICENSE", S.TEMPLATES["MPL-2.0"]), ("a/license_utils.py", S.TEMPLATES["MIT/short"]), ("a/b/c/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"), ("a/b/c/y.c", "int y;"), ("a/COPYING.LESSER", S.TEMPLATES["LGPL-2.1"]),
        ("a/b/z.c", "int z;"), ("q/w.c", "int w;"), ("q/r/LICENSE-MIT", "no notice"), ("q/r/UNLICENSE.md", S.TEMPLATES["Unlicense"]), ("q/r/s/t/v.c", None), ("a/bb/LICENSE.txt", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"), ("a/bb/u.c", ""),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.own_license, r.license, r.from_dir) for r in S.scan_licenses(files).collect()}
    assert got == {
        "LICENSE": ("MPL-2.0", "MPL-2.0", None), "a/license_utils.py": ("MIT", "MIT", None), "a/b/c/x.c": ("GPL-2.0-or-later", "GPL-2.0-or-later", None), "a/b/c/y.c": (None, "LGPL-2.1", "a"), "a/COPYING.LESSER": ("LGPL-2.1", "LGPL-2.1", None),
        "a/b/z.c": (None, "LGPL-2.1", "a"), "q/w.c": (None, "MPL-2.0", ""), "q/r/LICENSE-MIT": (None, "Unlicense", "q/r"), "q/r/UNLICENSE.md": ("Unlicense", "Unlicense", None), "q/r/s/t/v.c": (None, "Unlicense", "q/r"),
        "a/bb/LICENSE.txt": ("(MIT OR Apache-2.0)", "(MIT OR Apache-2.0)", None), "a/bb/u.c": (None, "(MIT OR Apache-2.0)", "a/bb"),
    }


def test_the_query_equals_its_sql(spark, tmp_path):
    notices = [S.TEMPLATES[n] for n in ("MIT/short", "GPL-3.0", "BSD-3-Clause")] + ["SPDX-License-Identifier: Apache-2.0 OR MIT", "All rights reserved."]
    notices[0] = f"All rights reserved. {notices[0]} {notices[2]}"
    real = [t for _, t, _ in real_files()]
    rows = [(i, notices[i // 100 % 5] if i % 100 == 0 and i % 3 else (notices[i % 5] if i % 37 == 0 else (None if i % 11 == 0 else f"plain words {i}"))) for i in range(0, 12_000, 10)]
    rows += [(20_000 + 25 * i, t) for i, t in enumerate(real)] + [(40_000 + 100 * i, t) for i, t in enumerate(real)] + [(100, notices[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op3_license_scan(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(S.ORACLES["op3_license_scan"]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    depths = got.from_dir.dropna().str.count("/")
    assert {*depths} >= {0, 1, 2}


GPL3 = """/*
 * Frob, a tool. Copyright (C) 2020 A. Person
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main(void) { return 0; }
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_wrapped_headers_and_whole_licence_files(spark):
    comment = "\n".join(f"# {x}" for x in MIT.split("\n"))
    whole = {k: " ".join(" ".join([w] * int(n)) for w, n in (x.split(":") for x in S.WORDS[k].split())) for k in S.WORDS}
    rows = [("a/gpl.c", GPL3, "GPL-3.0"), ("a/gpl2.c", GPL3.replace("version 3", "version 2").replace("\n", "\r\n"), "GPL-2.0"), ("a/one.c", " ".join(GPL3.split()[11:52]), "GPL-3.0"),
            ("a/mit.py", f"import os\n{comment}\nos.getcwd()\n" + "x = 1\n" * 200, "MIT"), ("a/mit.txt", f"word {'other words ' * 50}\n\n{MIT}\n\nmore", "MIT"), ("a/bsd.txt", BSD2, "BSD-2-Clause"),
            ("a/agpl.c", GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), ("a/none.txt", "a licence to print " + "money " * 40, None), *((f"{k}/LICENSE", t, k) for k, t in whole.items())]
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: r.own_license for r in S.scan_licenses(files).collect()}
    assert got == {p: k for p, _, k in rows}


def test_blocks_left_out_early_could_not_pass(spark, monkeypatch):
    texts = [GPL3, MIT, BSD2, MIT + " and " + "other words here " * 6, MIT + " word" * 5, "a licence to print " + "money " * 40, "the license of the software and the copies", "License."]
    texts += [f"{MIT} {'zeta eta theta ' * k}" for k in range(8)]
    found = S.notices(spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).cache()
    df = S._words(found.where("NOT block")).groupBy("word").agg({"n": "sum"}).toDF("word", "df")
    total, own = found.where("NOT block").count(), S._templates(spark, True)
    want = S._nearest(S._words(found.where("block")), df, total, own, 0.8).collect()
    for common in (3, 20_000):
        monkeypatch.setattr(S, "COMMON", common)
        few = S._promising(found.where("block"), df, total, own, 0.8)
        assert sorted(S._nearest(few, df, total, own, 0.8).collect()) == sorted(want) and want
    assert few.select("notice_id").distinct().count() < found.where("block").select("notice_id").distinct().count()


AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2_FILE = "Copyright (c) 2019, A. Person\nAll rights reserved.\n\n" + BSD2.replace("met:\n", "met:\n\n").replace("\n2.", "\n\n2.") + f"\n\n{AS_IS}\n"
BSD3_FILE = BSD2_FILE.replace("\n\nTHIS", "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS")
MIT_FILE = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT + """

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_FILE = """Copyright 2020 Foo. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
ZLIB_FILE = """Copyright (c) 2015 A. Person

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.

3. This notice may not be removed or altered from any source
   distribution.
"""
EPL_FILE = """Copyright (c) 2021 Frob GmbH and others. All rights reserved.

This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
REAL = {"BSD-2-Clause": BSD2_FILE, "BSD-3-Clause": BSD3_FILE, "MIT": MIT_FILE, "Apache-2.0": APACHE_FILE, "Zlib": ZLIB_FILE, "EPL-2.0": EPL_FILE, "BSL-1.0": S.HEADERS["BSL-1.0/whole"].replace("to do so, all", "to do\nso, all")}


def real_files():
    """Every licence as a licence file, a block comment and comment lines, with its empty lines; and short forms."""
    rows = [(f"{k}/LICENSE", t, k) for k, t in REAL.items()]
    rows += [(f"src/{k}.c", "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint main(void);\n", k) for k, t in REAL.items()]
    rows += [(f"src/{k}.py", "import os\n" + "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\n\nprint(1)\n", k) for k, t in REAL.items()]
    rows += [
        ("s/a.js", "// Licensed under the MIT license. See LICENSE file in the project root for full license information.\n", "MIT"),
        ("s/b.c", "// SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0"), ("s/c.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
        ("s/d.c", "// SPDX-License-Identifier:\n// nothing", None), ("s/e.txt", "Copyright 2020. All rights reserved.", "proprietary"), ("s/f.cpp", f"// {S.HEADERS['BSL-1.0/header']}", "BSL-1.0"),
    ]
    return rows


def test_real_files_with_their_empty_lines(spark):
    rows = real_files()
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: r.own_license for r in S.scan_licenses(files).collect()}
    assert got == {p: k for p, _, k in rows}


def plain_scan(rows):
    """The licence of each file by loops over blocks and templates."""
    import math
    import re
    from collections import Counter

    tokens = lambda t: Counter(x for x in re.split("[^a-z0-9]+", t.lower()) if x)

    def replaced(text, rules):
        for pattern, by in rules.items():
            text = re.sub(pattern, by.replace("$", "\\"), text)
        return text

    def paragraphs(text):
        return [p.strip(" ") for p in replaced(text, S.BREAKS).split("\x04")]

    lines, blocks, tags = {}, {}, {}
    for path, text in rows:
        whole = [text] if re.search(S.LICENCE_FILE, path) else []
        lines[path] = [x for x in re.split(r"[.!?;]\s+|[\r\n]+", text) if re.search(S.NOTICE, x)] + whole
        near = {p for p in paragraphs(text) + paragraphs(replaced(text, S.GAPS)) if re.search(S.WRAPPED, p)}
        blocks[path] = {x for p in near for x in [p, *re.split("[.!?;] +", p)] if re.search(S.WRAPPED, x)} | {*whole}
        tags[path] = re.findall(S.SPDX, text)
    total, df = sum(map(len, lines.values())), Counter()
    for found in lines.values():
        for x in found:
            df.update({*tokens(x)})
    weigh = lambda tf: {w: n * (math.log((total + 1.0) / (df[w] + 1.0)) + 1.0) for w, n in tf.items()}
    short = {k: weigh(tokens(t)) for k, t in S.TEMPLATES.items()}
    long = short | {k: weigh(tokens(t)) for k, t in S.HEADERS.items()} | {f"{k}/text": weigh({w: int(n) for w, n in (x.split(":") for x in t.split())}) for k, t in S.WORDS.items()}
    out = {}
    for path, _ in rows:
        options = [(0, 0, -1.0, t) for t in tags[path]]
        for notice, templates in [(x, short) for x in lines[path]] + [(x, long) for x in blocks[path]]:
            a, size = weigh(tokens(notice)), sum(tokens(notice).values())
            norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
            scores = [(-round(sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b), 6), k.split("/")[0]) for k, b in templates.items()]
            score, licence = min(scores)
            if -score >= S.THRESHOLD:
                options.append((2 if licence == "proprietary" else 1, score * size, score, licence))
        best = min(options, default=None)
        out[path] = (best and best[3], best and -best[2])
    return out


def test_blocks_and_whole_files_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = [(p, t) for p, t, _ in real_files()] + [("a/gpl.c", GPL3), ("a/mit.txt", f"word\n\n{MIT}\n\nmore")]
    words = ("the license of this software and copies must retain copyright notice permission is granted all rights reserved. \n \n\n // # " + MIT[:300]).split(" ")
    rows += [(f"r/{i}.txt", " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(40)]
    rows += [(f"m/{i}/LICENSE", "\n\n".join(rng.sample([BSD2_FILE, MIT_FILE, APACHE_FILE, "All rights reserved.", "plain words\nand more"], 2))) for i in range(12)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.own_license, r.own_score) for r in S.scan_licenses(files).collect()}
    want = plain_scan(rows)
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()}
    assert all(a == b or abs(a - b) < 2e-6 for a, b in ((got[p][1], want[p][1]) for p in want))
