import hashlib
import random
import zlib

from eventry.llm import line_dedup, merkle, prefix_trie
from eventry.llm._shared import running

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda s: s.encode().lower().decode()
BLANK = " \t\n\x0b\x0c\r"


# ---- running values

def test_running_values_equal_a_loop(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 6), i, rng.getrandbits(62)) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(9)
    got = running(df, ["g"], ["o"], {"n": (F.sum, F.lit(1).cast("long")), "x": (F.bit_xor, F.col("v"))}).collect()
    n, x, seen = {}, {}, {}
    for g, o, v in sorted(rows):
        n[g], x[g] = n.get(g, 0) + 1, x.get(g, 0) ^ v
        seen[o] = (n[g], x[g])
    assert {r.o: (r.n, r.x) for r in got} == seen and all((r.n_all, r.x_all) == (n[r.g], x[r.g]) for r in got)


# ---- line dedup

def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: low(line.strip(BLANK))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def lines_of(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(df, **kw).collect()), key=repr)


def test_line_dedup_equals_brute_force(docs, odd_texts):
    rng = random.Random(5)
    common = ["A passage that very many of the documents share, word for word", "  a PASSAGE that very many of the documents share, word for word\r", "é" * 39, "É" * 40, "", "short", "x" * 41]
    rows = [(i, "\n".join(rng.choice(common + [f"a line of document number {i} that no other document has at all"]) for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    rows += odd_texts + [(7, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (500, "only\n\n"), (501, "\n")]
    want = plain_lines(rows)
    assert sum(r[2] for r in want) > 50
    assert lines_of(docs(rows).repartition(7)) == want
    assert lines_of(docs(rows), min_chars=5, min_docs=2) == plain_lines(rows, 5, 2)


def test_lines_of_repeated_rows_and_of_rows_without_id(docs):
    line = "this very line stands in some documents and is long enough for the rule"
    assert all(r[2] == 0 for r in lines_of(docs([(1, line)] * 9)))  # one document
    assert all(r[2] == 0 for r in lines_of(docs([(None, line)] * 9)))
    rows = [(i, f"{line}\n{line}") for i in (1, 2, 3, 4, 5, 5)] + [(None, line)]
    assert {(r[0], r[2]) for r in lines_of(docs(rows))} == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 0), (None, 1)}
    assert lines_of(docs([])) == []


def test_a_text_of_many_lines_keeps_its_order(docs):
    lines = [f"line number {k} that is as long as the rule of forty asks" for k in range(5000)]
    rows = [(i, "\n".join(lines[::7])) for i in range(4)] + [(9, "\n".join(lines))]
    assert lines_of(docs(rows)) == plain_lines(rows)
    assert lines_of(docs([*rows, (3, "x")])) == plain_lines([*rows, (3, "x")])


# ---- Merkle manifest

def plain_tree(nodes):
    """The root, and for every node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for p, k in zip(paths, at, strict=True):
            run, i = runs[k // 16], k % 16
            p.append(("".join(run[:i]), "".join(run[i + 1 :])))
        at = [k // 16 for k in at]
        nodes = [H("".join(r)) for r in runs]
    return nodes[0], paths


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = (own, *plain_tree([plain_leaf(r) for r in own]))
    root, above = plain_tree([trees[g][1] for g in names]) if names else (None, [])
    out = []
    for g, high in zip(names, above, strict=True):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = plain_leaf((*r[:4], None if r[4] is None else low(r[4]))) if bad else plain_leaf(r)
            for left, right in path + high:
                node = H(left + node + right)
            out.append((r[0], plain_leaf(r), subroot, root, H("".join(a + b for a, b in path + high)), node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", "x", 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, node string, b long, at string").repartition(parts)
    from pyspark.sql import functions as F

    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle._leaf([merkle.fold_case(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]))
    found = merkle.manifest(df, claim=claim).withColumns({"p": merkle.proof_digest(), "f": merkle.fold(F.coalesce("claim", "leaf"))})
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.p, r.f, r.f == r.root) for r in found.collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(5000)]  # three levels of blocks of two
    rows += [(i, f"s{rng.randrange(300)}", None, None, rng.choice([None, "", "Some", "plain"])) for i in range(5000, 5400)]
    rows += [(k, src, "de", 1, "Ü") for k, src in ((9001, None), (9002, None), (9003, "é"), (9004, "Z"))]
    rows += [(i, "sixteen", "en", 1, "A") for i in range(9100, 9116)] + [(i, "block", "en", 1, "A") for i in range(9200, 9456)] + [(i, "over", "en", 1, "A") for i in range(9500, 9757)]
    want = plain_manifest(rows)
    got = manifest_of(spark, rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_repeated_rows_nulls_and_few_rows(spark):
    same = (5, "a", "en", 4, "Same")
    rows = [same] * 40 + [(None, "a", None, None, None)] * 20 + [(5, "a", "en", 4, "Other")] + [(None, None, None, None, "t" * 100_000)]
    assert manifest_of(spark, rows) == plain_manifest(rows)
    for few in ([same], [same, (6, "b", None, 0, "")], [same] * 17):
        assert manifest_of(spark, few) == plain_manifest(few)
    assert manifest_of(spark, []) == []


# ---- prefix trie

def plain_trie(convs):
    """Nodes of {conversation: [(role, text), ...]} by loops over prefixes."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    def under(p):
        return [q for q in nodes if q[: len(p)] == p]

    out = []
    for p, members in nodes.items():
        below = under(p)
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[:-1] == q for z in below)]
        words = lambda q: len([w for w in q[-1][1].translate({ord(x): " " for x in BLANK}).split(" ") if w]) if q else 0
        saved = sum((len(nodes[q]) - 1) * words(q) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, H(ends)))
    return sorted(out, key=repr)


def ordered(rows):
    """Conversations of (conv, turn, role, text) rows, in the operator's order."""
    convs = {}
    t = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    for c, turn, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, t(r or "", x or ""), r or "", x or ""))
    return {c: [(v[3], v[4]) for v in sorted(turns)] for c, turns in convs.items()}


def plain_rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, c string, pos long, t string").repartition(6)


def nodes_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    texts = ["a b", "A b", "c  d\te", "", None, "f"]
    rows = []
    for c in range(n):
        length = rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 13])
        start = rng.choice([[], ["a b"] * 4, ["a b"] * 6, ["f", "c  d\te", "", "a b", "f"]])
        for k in range(length):
            text = start[k] if k < len(start) else rng.choice(texts if rng.random() < 0.3 else texts[:1])
            rows.append((c, k, ("user", "assistant", None)[k % 2 if rng.random() < 0.9 else 2], text))
    return rows


def test_trie_equals_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert nodes_of(prefix_trie.prefix_trie(conversations(spark, rows))) == plain_trie(ordered(rows))


def test_trie_of_rebuilt_conversations_equals_brute_force(spark):
    rows = random_rows(3, 120) + [(4000, 0, "user", "alone"), (4021, 0, "user", "no head"), (4021, 1, "user", "b")]
    got = nodes_of(prefix_trie.trie(*prefix_trie.rebuild(prefix_trie.digest_turns(conversations(spark, rows)))))
    assert got == plain_trie(plain_rebuild(ordered(rows)))


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (1, 0, "user", "z"), (2, None, "", ""), (None, 0, "user", "lost"), (3, 5, "user", "long " * 30_000)]
    assert nodes_of(prefix_trie.prefix_trie(conversations(spark, rows))) == plain_trie(ordered(rows))
    assert nodes_of(prefix_trie.prefix_trie(conversations(spark, []))) == []
    turns, convs = prefix_trie.rebuild(prefix_trie.digest_turns(conversations(spark, [(21, 0, "user", "x")])))  # h of 21 is 1: nothing is left of it
    assert nodes_of(prefix_trie.trie(turns, convs)) == plain_trie(plain_rebuild({21: [("user", "x")]}))


def test_a_long_list_of_members_is_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, k, "user", "same") for c in range(60) for k in range(2)] + [(c, 0, "user", "same") for c in range(100, 130)]
    assert nodes_of(prefix_trie.prefix_trie(conversations(spark, rows))) == plain_trie(ordered(rows))


def test_block_sizes_agree(spark):
    rows = random_rows(9, 40)
    want = plain_trie(ordered(rows))
    for block in (1, 3):
        assert nodes_of(prefix_trie.prefix_trie(conversations(spark, rows), block=block)) == want
