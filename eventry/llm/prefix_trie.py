"""The trie of conversation prefixes, by digests of blocks of turns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import cut, running, spread_join, table
from eventry.llm.merkle import _crc
from eventry.llm.mixing import word_count

# Turns of a block; ids that one piece of a list of members holds.
BLOCK, PIECE = 4, 4096
_NODE = ["depth", "ku", "kv"]


def digest_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Numbered turns without their texts: ``c, pos, t, words`` (conversation, place from 1, digest of role and text, words of the text).

    Rows of a conversation are ordered by turn (nulls first), then by digest. Null roles and texts count as empty. Places come from ranges of
    (conversation, turn), so a conversation may be larger than any task. Rows without an id are left out: they are in no conversation. Ids are whole numbers.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    named = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), t.alias("t"), word_count(text).alias("words")).where("c IS NOT NULL")
    return running(named, ["c"], ["turn", "t"], {"pos": (F.sum, F.lit(1).cast("long"))}).select("c", "pos", "t", "words")


def rebuild(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the head of conversation c - c % 20: its first h turns (all if fewer), then c's own after its first h; h is crc32(c) % 4.

    Returns the turns (c, pos, t, words) and all conversations (c), of which some may have no turn left.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    convs = cut(placed.groupBy("c").agg(F.lit(1).alias("one")).select("c", h("c").alias("h"), (F.col("c") - F.col("c") % 20).alias("b")))
    heads = placed.where("c % 20 = 0 AND pos <= 3").select(F.col("c").alias("b"), "pos", "t", "words")
    taken = convs.join(heads, "b").where("pos <= h").select("c", "pos", "t", "words")
    size = heads.groupBy("b").agg(F.count("*").alias("m"))
    shift = convs.join(size, "b", "left").select("c", (F.least("h", F.coalesce("m", F.lit(0))) - F.col("h")).alias("shift"))
    own = spread_join(placed.where(F.col("pos") > h("c")), shift, ["c"], ["pos"])
    return taken.union(own.select("c", (F.col("pos") + F.col("shift")).alias("pos"), "t", "words")), convs.select("c")


def _xor(a: str, b: Column) -> Column:
    return F.col(a).bitwiseXOR(b)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """A row per conversation and block of turns: the key of what stands before it (``u0, v0``), and for each of its turns the key of the prefix that ends there.

    A prefix's key joins, by exclusive or, two 64-bit hashes for each of its blocks, made of the block's number and the digests of its turns.
    """
    j = F.floor((F.col("pos") - 1) / block)
    rows = turns.select("c", j.alias("j"), F.struct("pos", "t", "words").alias("x")).groupBy("c", "j").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    rows = rows.withColumn("ts", F.transform("xs", lambda x: x["t"]))
    parts = lambda seed: F.transform(F.sequence(F.lit(1), F.size("ts")), lambda i: F.xxhash64(F.lit(seed), F.col("j"), F.slice("ts", F.lit(1), i)))
    rows = rows.select("c", "j", F.transform("xs", lambda x: x["words"]).alias("words"), parts(1).alias("us"), parts(2).alias("vs"))
    rows = rows.withColumns({"u": F.element_at("us", -1), "v": F.element_at("vs", -1)})
    rows = running(rows, ["c"], ["j"], {"pu": (F.bit_xor, F.col("u")), "pv": (F.bit_xor, F.col("v"))}).drop("pu_all", "pv_all")
    rows = rows.withColumns({"u0": _xor("pu", F.col("u")), "v0": _xor("pv", F.col("v"))})
    return rows.select("c", "j", "u0", "v0", F.transform("us", lambda x: _xor("u0", x)).alias("us"), F.transform("vs", lambda x: _xor("v0", x)).alias("vs"), "words")


def _turn_rows(blocks: DataFrame, block: int, *passed: str) -> DataFrame:
    """Blocks to a row per turn: c, the node's depth and key, its parent's key, the turn's words."""
    before = lambda a, z: F.concat(F.array(F.col(z)), F.slice(F.col(a), F.lit(1), F.size(a) - 1))
    zipped = F.arrays_zip("us", "vs", before("us", "u0").alias("pu"), before("vs", "v0").alias("pv"), "words")
    rows = blocks.select("c", "j", *passed, F.posexplode(zipped).alias("i", "x"))
    return rows.select("c", (F.col("j") * block + F.col("i") + 1).alias("depth"), F.col("x.us").alias("ku"), F.col("x.vs").alias("kv"), F.col("x.pu").alias("pu"), F.col("x.pv").alias("pv"), F.col("x.words").alias("words"), *passed)


def _list_digests(batches):
    """Pieces sorted by node and number to one digest per node; only a running digest is held."""
    last, digest = None, None

    def out(node, d):
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([d.hexdigest()])], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        for *node, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if node != last:
                if last is not None:
                    yield out(last, digest)
                last, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if last is not None:
        yield out(last, digest)


def _ends(blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Per node the digest of the ids of the conversations that end there, ascending. Lists are joined in pieces, dealt by ranges."""
    end = F.struct((F.col("j") * block + F.size("us")).alias("depth"), F.element_at("us", -1).alias("ku"), F.element_at("vs", -1).alias("kv"))
    last = blocks.groupBy("c").agg(F.max_by(end, "j").alias("e"))
    at = convs.join(last, "c", "left").select("c", *[F.coalesce(f"e.{k}", F.lit(0).cast("long")).alias(k) for k in _NODE])
    placed = running(at, _NODE, ["c"], {"n": (F.sum, F.lit(1).cast("long"))})
    pieces = placed.groupBy(*_NODE, F.floor((F.col("n") - 1) / PIECE).alias("k")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    pieces = pieces.select(*_NODE, "k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "k").mapInArrow(_list_digests, "depth long, ku long, kv long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns`` (c, pos from 1 without gaps, t, words); ``convs`` has each conversation (c) once, turnless ones too.

    Conversations are grouped by the digests of successive blocks of ``block`` turns. Where all that enter a block share it whole, its turns are the nodes,
    read from the smallest member; only where siblings diverge are its turns counted one by one (with partial counts before the shuffle).
    A node belongs to its smallest member, which owns the end of its own path from some depth on. Sums over subtrees follow without rounds: a conversation
    adds its owned nodes' sum to every node above them on its path. Rows of a hot prefix are dealt by prefix and conversation.

    Returns per node ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. No conversations give no rows.
    """
    blocks = cut(_blocks(turns, block))
    entered = blocks.groupBy("j", "u0", "v0").agg(
        F.count("*").alias("n"), F.min("c").alias("low"),
        ((F.min(F.element_at("us", -1)) == F.max(F.element_at("us", -1))) & (F.min(F.element_at("vs", -1)) == F.max(F.element_at("vs", -1)))).alias("shared"),
    )
    flagged = cut(spread_join(blocks, entered, ["j", "u0", "v0"], ["c"]).where("NOT shared OR c = low"))
    alike = _turn_rows(flagged.where("shared"), block, "n").select("depth", "ku", "kv", "pu", "pv", "words", "n", F.col("c").alias("conv"))
    split = _turn_rows(flagged.where("NOT shared"), block).groupBy("depth", "ku", "kv", "pu", "pv").agg(F.max("words").alias("words"), F.count("*").alias("n"), F.min("c").alias("conv"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("c").alias("conv")).where("n > 0").select(*[zero.alias(k) for k in (*_NODE, "pu", "pv", "words")], "n", "conv")
    nodes = cut(alike.unionByName(split).unionByName(root))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("ku"), F.col("pv").alias("kv")).agg(F.count("*").alias("children"))
    full = nodes.join(children, _NODE, "left").withColumns({
        "children": F.coalesce("children", zero),
        "leaf": F.col("children").isNull().cast("long"),
        "saved": (F.col("n") - 1) * F.col("words"),
    })
    # Sums over the owned nodes of a conversation from each of them down its path.
    own = running(full, ["conv"], ["depth"], {"s": (F.sum, F.col("saved")), "l": (F.sum, F.col("leaf")), "k": (F.sum, F.lit(1).cast("long"))})
    own = cut(own.withColumns({"s": F.col("s_all") - F.col("s") + F.col("saved"), "l": F.col("l_all") - F.col("l") + F.col("leaf")}))
    tops = own.where("k = 1 AND depth > 0").select(F.col("conv").alias("c"), F.col("depth").alias("top"), F.col("s_all").alias("s"), F.col("l_all").alias("l"), "pu", "pv")
    above = spread_join(blocks, tops.select("c", "top", "s", "l"), ["c"], ["j"]).where(F.col("j") * block + 1 < F.col("top"))
    given = _turn_rows(above, block, "top", "s", "l").where("depth < top").select(*_NODE, "s", "l")
    given = given.unionByName(tops.select(*[zero.alias(k) for k in _NODE], "s", "l")).groupBy(*_NODE).agg(F.sum("s").alias("s_in"), F.sum("l").alias("l_in"))
    # The parent of an owned node is owned by the same conversation, but for the topmost, which meets its parent's key.
    up = tops.select("c", (F.col("top") - 1).alias("depth"), F.col("pu").alias("ku"), F.col("pv").alias("kv"))
    parents = spread_join(up, nodes.select(*_NODE, F.col("conv").alias("parent")), _NODE, ["c"]).select(F.col("c").alias("conv"), (F.col("depth") + 1).alias("depth"), "parent")
    found = own.join(given, _NODE, "left").join(_ends(blocks, convs, block), _NODE, "left").join(parents, ["conv", "depth"], "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("l") + F.coalesce("l_in", zero)).alias("n_leaves"), (F.col("s") + F.coalesce("s_in", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of the prefixes of all conversations, as ``trie`` returns it.

    Null roles and texts are empty; null turns come first; equal turns of one conversation are ordered by digest; repeated rows are turns of their own;
    rows without an id are left out; long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    placed = digest_turns(turns, conv_col, turn_col, role_col, text_col)
    return trie(placed, placed.groupBy("c").agg(F.lit(1).alias("one")).select("c"), block)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuild(digest_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {
    "op11_prefix_trie": rf"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT c, {_crc("c")} % 4 AS h, c - c % 20 AS b FROM (SELECT DISTINCT c FROM t)),
        r0 AS (SELECT c.c, 0 AS own, t.pos, r, x FROM c JOIN t ON t.c = c.b AND t.pos <= c.h UNION ALL SELECT c.c, 1, t.pos, r, x FROM c JOIN t ON t.c = c.c AND t.pos > c.h),
        r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, sha256(r || chr(10) || x) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM r0),
        a AS (SELECT c, d, w, list(h) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS hs FROM r),
        p AS (SELECT c, d, w, sha256(array_to_string(hs, '')) AS k, CASE d WHEN 1 THEN '' ELSE sha256(array_to_string(hs[1:d - 1], '')) END AS up FROM a
              UNION ALL SELECT c, 0, 0, '', NULL FROM c),
        n AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, max(w) AS w FROM p GROUP BY d, k),
        m AS (SELECT n.*, (SELECT count(*) FROM n y WHERE y.up = n.k AND y.d = n.d + 1) AS children FROM n),
        s AS (SELECT p.d, p.k, sum((m.n - 1) * m.w) AS saved, count(*) FILTER (WHERE m.children = 0) AS leaves FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.d, p.k),
        z AS (SELECT c, arg_max(k, d) AS k, max(d) AS d FROM p GROUP BY c),
        e AS (SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM z GROUP BY d, k)
        SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
               coalesce(e.ends, sha256('')) AS ends_sha256
        FROM m JOIN s ON s.d = m.d AND s.k = m.k LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.up LEFT JOIN e ON e.d = m.d AND e.k = m.k"""
}
