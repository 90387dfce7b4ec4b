import re

import pytest

from eventry.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for a in range(max(len(iw) - size, 0) + 1 if iw else 0):
            win = iw[a : a + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"
ITEMS = [(1, PASSAGE), (2, "short item here"), (3, "solo"), (4, ""), (5, None), (None, "null id item with words"), (7, "a a a a a a a a a a a a"), (1, PASSAGE), (10, "É ü-日 x")]
TEXTS = [
    (1, None), (2, ""), (3, "..."), (4, f"before {PASSAGE.upper()}, after"), (5, "two three four five six seven eight nine ten eleven"), (6, "two three four five six seven eight nine ten"),
    (7, "a " * 30), (8, "a " * 9), (9, "SHORT, item! here"), (9, "SHORT, item! here"), (10, "solo"), (11, "x solo x SOLO"), (None, "short item here"), (12, "É Ü 日 X é ü 日 x"), (13, "é ü 日 x É ü 日 x"), (14, "null id item with words"),
    (15, "w " * 3000 + PASSAGE + " w" * 3000), (16, "one two three. one two three four five six seven eight nine ten"),
]


@pytest.mark.parametrize("limit, rows", [(32 << 20, 500_000), (0, 500_000), (0, 0)])
def test_hits_equal_brute_force(spark, docs, monkeypatch, limit, rows):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)  # 0: windows are joined by a shuffle
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)  # 0: so are the texts of candidates
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, win string")
    got = D.find_contamination(docs(TEXTS), items).collect()
    assert len(got) == len(TEXTS)
    known = [(i, t) for i, t in ITEMS if i is not None]
    left = [(i, *plain(t, known)) for i, t in TEXTS]
    for r in got:
        mine = (r.doc_id, r.n_words, r.n_hit, list(r["items"]))
        if r.doc_id == 14:  # hit by the item without an id, which has no name
            assert (r.n_hit, r.n_items, r.contaminated) == (5, 0, True)
            continue
        assert mine in left
        left.remove(mine)
    clean = D.keep_clean(docs(TEXTS), items)
    assert clean.columns == docs([]).columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 6, 8, 12} - ({12} if plain(dict(TEXTS)[12], known)[1] else set())


def test_windows_that_many_items_share(spark, docs):
    items = [(i, f"{PASSAGE} question {i} of many") for i in range(60)]
    texts = [(i, f"{PASSAGE} question {i} of many" if i % 2 else f"x {PASSAGE}") for i in range(8)]
    got = D.find_contamination(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == {(i, n, h, tuple(found)) for i, t in texts for n, h, found in [plain(t, items)]}
    windows, owners = D.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    assert windows.count() < 400 < owners.count() and set(windows.columns) == {"win", "win_id"}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(docs([]), none).count() == 0
    got = D.find_contamination(docs([(1, PASSAGE)]), none).first()
    assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (13, 0, 0, False)
