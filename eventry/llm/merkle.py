"""Merkle manifest of a dataset: levels as strings of hexadecimal digests, a block at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import cut, fold_case, running, table

# The children of a node, the characters of a digest, the leaves of a block (two levels).
FAN, HEX = 16, 64
RUN, BLOCK = FAN * HEX, FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CHAIN = "array<struct<l:string,r:string>>"


def _leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, a null as a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def _up(level: str) -> Column:
    """The level above one: every ``FAN`` digests, cut out of the string at fixed widths, become their digest."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col(level), i * RUN + 1, F.lit(RUN)), 256)), "")


def _levels(blocks: DataFrame) -> DataFrame:
    """Blocks (g, b, n, items) with their levels as strings, and what is left of them: ``top``. n is the number of nodes that the whole group has."""
    joined = blocks.withColumn("s0", F.array_join(F.transform("items", lambda x: F.repeat(x["node"], x["copies"])), ""))
    joined = joined.withColumn("s1", _up("s0"))
    top = F.when(F.col("n") == 1, F.col("s0")).when(F.col("n") <= FAN, F.col("s1")).otherwise(F.sha2("s1", 256))
    return joined.withColumn("top", top)


def _build(leaves: DataFrame, order: list[str]) -> list[DataFrame]:
    """Levels of the trees of all groups: blocks of leaves first, then blocks of what these leave, until every group has one node.

    ``leaves`` has g (group, not null), the columns of ``order``, node (digest), copies (how often the leaf stands there) and payload (a struct).
    """
    placed = running(leaves, ["g"], order, {"upto": (F.sum, F.col("copies"))})
    first = F.col("upto") - F.col("copies")
    blocks = F.explode(F.sequence(F.floor(first / BLOCK), F.floor((F.col("upto") - 1) / BLOCK)))
    pieces = placed.select("g", F.col("upto_all").alias("n"), blocks.alias("b"), first.alias("first"), "upto", "node", "payload")
    at = F.greatest(F.col("first"), F.col("b") * BLOCK)
    copies = F.least(F.col("upto"), (F.col("b") + 1) * BLOCK) - at
    item = F.struct(at.alias("at"), copies.cast("int").alias("copies"), "node", "payload")
    stage = pieces.groupBy("g", "b").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    stages = [cut(_levels(stage))]
    n = stages[0].agg(F.max("n")).first()[0] or 0
    while n > BLOCK:
        item = F.struct(F.col("b").alias("at"), F.lit(1).alias("copies"), F.col("top").alias("node"))
        above = stages[-1].select("g", F.floor(F.col("b") / BLOCK).alias("b"), F.ceil(F.col("n") / BLOCK).alias("n"), item.alias("item"))
        stages.append(cut(_levels(above.groupBy("g", "b").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("item")).alias("items")))))
        n = -(-n // BLOCK)
    return stages


def _nodes(blocks: DataFrame, passed: list[str]) -> DataFrame:
    """One row per node of the blocks, with its chain of siblings: those of its own two levels, then the block's own chain."""
    each = F.flatten(F.transform("items", lambda x: F.transform(F.sequence(F.lit(0), x["copies"] - 1), lambda j: F.struct((x["at"] + j).alias("at"), x.alias("item")))))
    rows = blocks.withColumn("_each", F.explode(each)).withColumns({
        "at": F.col("_each.at"),
        "off": (F.col("_each.at") - F.col("b") * BLOCK).cast("int"),
    })
    r, i = F.floor(F.col("off") / FAN).cast("int"), F.col("off") % FAN
    rows = rows.withColumn("run", F.substring(F.col("s0"), r * RUN + 1, F.lit(RUN)))
    flanks = lambda s, k: F.struct(F.substring(F.col(s), F.lit(1), k * HEX).alias("l"), F.substring(F.col(s), (k + 1) * HEX + 1, F.lit(RUN)).alias("r"))
    own = F.filter(F.array(F.when(F.col("n") > 1, flanks("run", i)), F.when(F.col("n") > FAN, flanks("s1", r))), lambda s: s.isNotNull())
    return rows.select("g", "at", F.col("_each.item").alias("item"), F.concat(own, F.col("chain")).alias("chain"), *passed)


def _down(stages: list[DataFrame], tops: DataFrame, passed: list[str]) -> DataFrame:
    """The leaves of ``stages`` with their chains; ``tops`` has g, the chain above the group's last node, and the columns ``passed`` on."""
    chains = tops.withColumn("b", F.lit(0).cast("long"))
    for stage in reversed(stages[1:]):
        chains = _nodes(stage.join(chains, ["g", "b"]), passed).select("g", F.col("at").alias("b"), "chain", *passed)
    return _nodes(stages[0].join(chains, ["g", "b"]), passed)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """A Merkle tree over the rows: a tree per group, and a tree over the groups.

    A row's leaf is the digest of its fields. In a group leaves ascend by id (nulls first, then by digest); while several nodes remain, every 16
    consecutive ones (fewer in the last run) become the digest of their concatenated hexadecimal digests. What remains is the group's ``subroot``;
    subroots, by group (null first, then by UTF-8 bytes), make ``root`` likewise. Places come from ranges of (group, id), and an aligned block of 256
    nodes is a row whose levels are strings, so a group with a third of all rows is many blocks; what blocks leave is again cut into blocks.

    ``claim`` is an optional digest per row that somebody presents instead of the leaf (null: none).
    Returns one row per input row: ``doc_id, source, leaf, claim, subroot, root, proof``; ``proof`` lists, from the leaf to the root, the digests left
    and right of the node in its run. Null fields are dashes; rows that are equal in all fields are leaves of their own, one beside the other; texts
    count whole, empty ones too; an empty table gives no rows; columns other than ``fields`` are ignored. Ids and groups may have any type that casts to text.
    """
    g = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))  # null first
    leaves = docs.select(g.alias("g"), F.col(id_col).alias("doc_id"), F.col(group_col).alias("source"), _leaf([F.col(f) for f in fields]).alias("node"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    leaves = leaves.groupBy("g", "doc_id", "source", "node", "claim").agg(F.count("*").alias("copies"))  # repeated rows are counted before they are dealt
    stages = _build(leaves.select("g", "doc_id", "node", "copies", F.struct("doc_id", "source", "claim").alias("payload")), ["doc_id", "node"])
    roots = stages[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("top").alias("node"), F.lit(1).cast("long").alias("copies"), F.struct(F.col("g").alias("group")).alias("payload"))
    above = _build(roots, ["group"])
    top = above[-1].select("g", F.array().cast(_CHAIN).alias("chain"), F.col("top").alias("root"))
    subroots = _down(above, top, ["root"]).select(F.col("item.payload.group").alias("g"), "chain", F.col("item.node").alias("subroot"), "root")
    found = _down(stages, subroots, ["subroot", "root"])
    return found.select("item.payload.doc_id", "item.payload.source", F.col("item.node").alias("leaf"), "item.payload.claim", "subroot", "root", F.col("chain").alias("proof"))


def proof_digest(proof: str = "proof") -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(leaf: Column, proof: str = "proof") -> Column:
    """The root that a leaf leads to with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, _leaf([fold_case(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, claim=claim)
    folded = fold(F.coalesce("claim", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 of a decimal number: a byte goes in, then eight shifts.
def _crc(value: str) -> str:
    steps = f"flatten([[ord(b), -1, -1, -1, -1, -1, -1, -1, -1] for b in string_split(CAST({value} AS VARCHAR), '')])"
    step = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(y AS BIGINT) for y in {steps}]), lambda c, b: {step}), 4294967295)"


def _sql(levels: int = 6) -> str:
    """The trees in SQL, ``levels`` levels over the leaves and as many over the sources (16 to that power at most)."""
    field = lambda f, c: f"coalesce(strlen({c}) || ':' || {c}, '-')"  # noqa: E731, ARG005
    row = lambda text: "sha256(" + " || ".join(field(f, text if f == "text" else f"CAST({f} AS VARCHAR)") for f in FIELDS) + ")"
    parts = [f"d AS (SELECT doc_id, source AS g, {row('text')} AS leaf, {_crc('doc_id')} % 5 = 0 AS bad, {row(f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents)"]
    parts.append("a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, bad, low FROM d)")

    def tree(a: str, first: str) -> None:
        for k in range(levels):
            level = first if k == 0 else f"{a}{k}"
            parts.append(f"{a}r{k} AS (SELECT g, pos // 16 AS run, list(h ORDER BY pos) AS hs, max(n) AS n FROM {level} GROUP BY g, pos // 16)")
            parts.append(f"{a}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {a}r{k})")

    def path(a: str, level0: str, keep: str) -> str:
        # Left and right siblings per level; null where the group has one node only.
        cols, joins = [], []
        for k in range(levels):
            i = f"(x.pos // {16**k}) % 16"
            cols += [f"CASE WHEN r{k}.n > 1 THEN array_to_string(r{k}.hs[1:{i}], '') END AS {a}l{k}", f"CASE WHEN r{k}.n > 1 THEN array_to_string(r{k}.hs[{i} + 2:], '') END AS {a}g{k}"]
            joins.append(f"JOIN {a}r{k} r{k} ON r{k}.g IS NOT DISTINCT FROM x.g AND r{k}.run = x.pos // {16 ** (k + 1)}")
        return f"SELECT {keep}, {', '.join(cols)} FROM {level0} x {' '.join(joins)}"

    tree("a", "a0")
    parts.append(f"p AS ({path('a', 'a0', 'x.g, x.doc_id, x.h AS leaf, CASE WHEN x.bad THEN x.low ELSE x.h END AS claim')})")
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, g AS source FROM a{levels})")
    tree("b", "b0")
    parts.append(f"q AS ({path('b', 'b0', 'x.source, x.h AS subroot')})")
    parts.append(f"f0 AS (SELECT p.*, q.* EXCLUDE (source), (SELECT h FROM b{levels}) AS root, claim AS c FROM p JOIN q ON p.g IS NOT DISTINCT FROM q.source)")
    steps = [f"a{{}}{k}" for k in range(levels)] + [f"b{{}}{k}" for k in range(levels)]
    for k, s in enumerate(steps):
        parts.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {s.format('l')} IS NULL THEN c ELSE sha256({s.format('l')} || c || {s.format('g')}) END AS c) FROM f{k})")
    siblings = " || ".join(f"coalesce({s.format('l')} || {s.format('g')}, '')" for s in steps)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, c AS folded_root, c = root AS verified FROM f{len(steps)}"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _sql()}
