"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventry.llm._shared import LOWER, UPPER, cut, fold_case, fresh, spread_join, table

WINDOW = 10
SHINGLE = 2
# Beyond so many bytes of prefix shingles and window texts the windows are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
# So many rows to drop are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters (folded) and all characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _shingles(w: Column, n: Column) -> Column:
    """Overlapping shingles of SHINGLE words; of fewer words, the one there is."""
    at = F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1)))
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of ``size`` consecutive item words, ``win, win_id`` (shorter items are one window), and the items of each, ``win_id, item``.

    A window that many items share is one row of the first table, so hits carry its number and not its items.
    """
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("win"))
    each = each.withColumn("win_id", F.unhex(F.sha2(F.array_join("win", " "), 256)))
    return each.select("win", "win_id").dropDuplicates(["win_id"]), each.where("item IS NOT NULL").select("win_id", "item").distinct()


def _corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("_key"), words(text).alias("_w"))


def prefix_shingles(corpus: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """For each window its rarest shingle in the corpus and where in the window it stands.

    Containment needs every shingle of a window in the document, so a prefix of one, in the order of rarity, is all that
    must be joined. Windows with one word are joined on that word alone.
    """
    n = F.size("win")
    parts = windows.select("win_id", "win", F.posexplode(F.when(n >= SHINGLE, _shingles(F.col("win"), n)).otherwise(F.array(F.xxhash64(F.get("win", F.lit(0)))))).alias("off", "sh"))
    wanted = parts.select("sh").distinct()
    seen = _exploded(corpus, windows).select("sh")
    counts = seen.join(F.broadcast(wanted) if small else wanted, "sh").groupBy("sh").agg(F.count("*").alias("df"))
    ranked = Window.partitionBy("win_id").orderBy(F.coalesce("df", F.lit(0)), "sh", "off")
    return parts.join(counts, "sh", "left").withColumn("r", F.row_number().over(ranked)).where((F.col("r") == 1) & F.col("df").isNotNull()).select("win_id", "off", "sh")


def _exploded(corpus: DataFrame, windows: DataFrame) -> DataFrame:
    """Every position of every document with the hash of the shingle that starts there."""
    keys = F.col("_w")
    singles = windows.where(F.size("win") < SHINGLE).limit(1).count() > 0
    pairs = F.transform(keys, lambda x, i: F.xxhash64(x, F.get(keys, i + 1)))
    both = corpus.select("doc_id", "_key", "_w", F.posexplode(pairs).alias("pos", "sh"))
    if singles:
        both = both.unionByName(corpus.select("doc_id", "_key", "_w", F.posexplode(F.transform(keys, lambda x: F.xxhash64(x))).alias("pos", "sh")))
    return both


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Which words of every document lie inside an occurrence of a benchmark window.

    If the windows are small together, they are sent to the documents. If not, positions go to the windows by their shingle alone, frequent
    shingles in parts, and what fits comes back to the words of its document, which are shuffled once.

    Windows are ``size`` consecutive words of an item. The shingles of a window are ordered by their frequency over the
    whole corpus; only the rarest is joined with the documents' shingles. The place of that shingle in the window bounds where the window would start; it
    must fit the document on both sides, and its words are then compared one by one.

    Returns one row per input row: ``doc_id, key, n_words, n_hit, n_items, items, contaminated`` (key: hash of id and text). Null texts, and texts and items
    without words, have no hits; long texts count whole. Repeated rows, and rows without an id, each get their result; items without an id
    are hit but have no name. Empty tables are fine; other columns are ignored.
    """
    corpus = _corpus(docs, id_col, text_col)
    windows, owners = item_windows(items, item_col, item_text_col, size)
    bytes_ = windows.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "win")) + 200), F.lit(0))).first()[0]
    small = bytes_ * 2 <= BROADCAST_BYTES
    prefix = prefix_shingles(corpus, windows, small).join(windows, "win_id").select("sh", "off", "win", "win_id", F.size("win").alias("len"))
    at = _exploded(corpus, windows)
    start = F.col("pos") - F.col("off")
    if small:
        near = at.join(F.broadcast(prefix), "sh").where((start >= 0) & (start + F.col("len") <= F.size("_w")))
        hits = near.where(F.slice("_w", start + 1, F.col("len")) == F.col("win"))
    else:
        met = spread_join(at.select("doc_id", "_key", "sh", "pos"), prefix, ["sh"], ["doc_id", "_key", "pos"]).where(start >= 0)
        met = cut(met.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "pos", "off", "win", "win_id", "len"))
        keys = met.select("_d", "_k").distinct()
        few = keys.count() <= BROADCAST_ROWS
        ours = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
        texts = corpus.join(F.broadcast(keys), ours, "left_semi") if few else corpus
        near = met.join(texts.dropDuplicates(["doc_id", "_key"]), ours)
        hits = near.where((start + F.col("len") <= F.size("_w")) & (F.slice("_w", start + 1, F.col("len")) == F.col("win")))
    # Repeated rows have the same key and the same spans, which count once.
    hits = cut(hits.select("doc_id", "_key", start.alias("a"), (start + F.col("len")).alias("b"), "win_id").distinct())
    before = Window.partitionBy("doc_id", "_key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))), F.lit(0))
    spans = hits.select("doc_id", "_key", "a", "b").distinct().withColumn("fresh", fresh)
    found = spans.groupBy("doc_id", "_key").agg(F.sum("fresh").alias("n_hit"))
    named = spread_join(hits.select("doc_id", "_key", "win_id").distinct(), owners, ["win_id"], ["doc_id", "_key"]).select("doc_id", "_key", "item").distinct()
    named = named.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = found.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select("doc_id", "_key", "n_hit", "items")
    d = corpus.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"))
    same = d["doc_id"].eqNullSafe(found["doc_id"]) & (d["_key"] == found["_key"])
    none = F.array().cast("array<string>")
    return d.join(found, same, "left").select(
        d["doc_id"], d["_key"].alias("key"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
    ).select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns.

    Null and empty texts have none; long texts count whole; repeated rows, ties and rows without an id fare alike; an empty table gives no
    rows; other columns are passed on, whatever their names.
    """
    found = find_contamination(docs, items, id_col, text_col)
    key = fresh(docs, "_key")
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    return keyed.join(bad, keyed[id_col].eqNullSafe(bad["_bad_id"]) & (keyed[key] == bad["_bad_key"]), "left_anti").drop(key)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op7_decontaminate": op7_decontaminate}
_SQL_WORDS = f"[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_NOT_WORD}') IF x <> '']"
ORACLES = {
    "op7_decontaminate": f"""
        WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
        win AS (SELECT item_id, unnest([array_to_string(w[a:a + {WINDOW - 1}], ' ') FOR a IN range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)]) AS win,
                       least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0),
        d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
        hit AS (SELECT DISTINCT k, a, n, item_id FROM (
                  SELECT k, n, unnest(range(1, len(w) - n + 2)) AS a, unnest([array_to_string(w[a:a + n - 1], ' ') FOR a IN range(1, len(w) - n + 2)]) AS t
                  FROM d, (SELECT DISTINCT n FROM win)) JOIN win USING (n) WHERE t = win),
        covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(a, a + n)) AS p FROM hit) GROUP BY k),
        named AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)"""
}
