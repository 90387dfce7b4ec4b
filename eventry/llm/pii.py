"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import table

# Kinds in the order in which equal starts are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

# Formats of access keys and tokens (cloud and forge keys, chat and payment tokens), and plain hexadecimal ones.
KEYS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,64}"
HEX = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

# The patterns. The base ones find the same leftmost non-overlapping matches as the contract's patterns
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# Look-behinds and possessive repeats keep the scan linear in long runs of letters or digits. A card match is a maximal
# run of digits with single separators, so runs of other than 12 to 19 digits, which fail anyway, are not proposed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9]){IBAN}(?![A-Za-z0-9])",
    "ssn": rf"(?<![0-9-]){SSN}(?![0-9-])",
    "secret": rf"(?<![A-Za-z0-9_-])(?:{KEYS}|{HEX})(?![A-Za-z0-9_-])",
}
# Base scores (of a secret in a known format, SURE) and context words, looked for in the CONTEXT characters before a span.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.5, "ssn": 0.4, "secret": 0.4}
SURE = 0.8
WORDS = {
    "email": r"e-?mail|contact|write",
    "ip": r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social security|tax id",
    "secret": r"token|secret|passw|credential|auth|api|key",
}
CONTEXT, BONUS, THRESHOLD = 40, 0.3, 0.6
# Running sums and context are taken from blocks of so many matches and characters, so that their cost is in proportion to the text.
_BLOCK, _CHUNK = 512, 1024


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array<int>, in blocks, as an appended array is copied."""
    grow = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
    running = lambda a: F.aggregate(a, F.array().cast("array<int>"), grow)

    def blocked(v: Column) -> Column:
        count = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count), lambda b: running(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

        def shifted(blocks: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), running(F.transform(blocks, lambda b: F.element_at(b, -1))))
            return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, s: F.transform(b, lambda x: x + s)))

        return F.when(F.size(v) <= _BLOCK, running(v)).otherwise(_let(parts, shifted))

    return _let(values, blocked)


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits))
    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    packed = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4))
    def step(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    n_digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n_digits.between(12, 19) & _luhn(match)
    if kind == "phone":
        return n_digits.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":  # letters and digits, and not a few of them repeated
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 8)
    return F.lit(True)


def _spans(kind: str, chunks: Column, found: Column, pieces: Column) -> Column:
    """Validated, scored spans of one kind. ``pieces`` are the texts between the matches, so lengths give the places."""
    rank, word = KINDS.index(kind), f"(?i){WORDS[kind]}"

    def placed(v: Column) -> Column:
        sizes = F.zip_with(F.slice(v["pieces"], F.lit(1), F.size(v["found"])), v["found"], lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(v["found"], _prefix_sums(sizes), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))

    def scored(s: Column) -> Column:
        at = F.greatest(F.floor(s["start"] / _CHUNK).cast("int") - 1, F.lit(0))
        near = F.concat(F.get(chunks, at), F.coalesce(F.get(chunks, at + 1), F.lit("")))
        before = F.substring(near, F.greatest(s["start"] - CONTEXT, F.lit(0)) - at * _CHUNK + 1, F.least(s["start"], F.lit(CONTEXT)))
        base = F.when(s["text"].rlike(f"^(?:{KEYS})$"), SURE).otherwise(SCORES[kind]) if kind == "secret" else F.lit(SCORES[kind])
        score = F.least(F.round(base + F.when(before.rlike(word), BONUS).otherwise(0.0), 2), F.lit(1.0))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), score.alias("score"))

    proposed = _let(F.struct(found.alias("found"), pieces.alias("pieces")), placed)
    valid = F.transform(F.filter(proposed, lambda s: _valid(kind, s["text"])), scored)
    return valid if kind in BASE else F.filter(valid, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all its spans of personal data.

    Returns ``doc_id, spans`` where spans is an array of (start, rank, end, kind, text, score), sorted by start and then kind,
    in code points with exclusive ends. Base kinds (email, ip, card, phone) are kept whenever their check passes; iban (mod 97), ssn and
    secret (keys and tokens; letters, digits and variety are checked) are added when their score, raised by context words before them,
    reaches the threshold. Null and empty texts have no spans; the cost of a text grows with its length and its matches, not with their
    product; equal starts are listed by kind; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    hint = {"email": F.col("_text").contains("@"), "phone": F.col("_text").contains("+"), "ip": F.col("_text").contains("."), "ssn": F.col("_text").contains("-")}
    none = F.array().cast("array<string>")
    found = found.withColumns({k: F.when(hint.get(k, F.lit(True)), F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    empty = "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>"
    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    chunks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_CHUNK}}}+"), F.lit(0))

    def all_(c: Column) -> Column:
        spans = [F.when(F.size(k) > 0, _spans(k, c, F.col(k), F.split("_text", PATTERNS[k], -1)).cast(empty)).otherwise(F.array().cast(empty)) for k in KINDS]
        return F.array_sort(F.concat(*spans))

    return found.select("doc_id", F.when(some, _let(chunks, all_)).otherwise(F.array().cast(empty)).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    percent = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), percent.alias("scores"))


QUERIES = {"op1_pii": op1_pii}


def _sql() -> str:
    """The same spans from plain patterns: base kinds from the contract's own, the others from whole runs of their characters.

    Places come from the lengths of the pieces between the matches.
    """
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"[A-Za-z0-9]*{IBAN}[A-Za-z0-9]*",
        "ssn": "[0-9-]+",
        "secret": "[A-Za-z0-9_-]+",
    }
    # Texts without these have no span of the kind.
    hint = plain | {"ssn": SSN, "secret": f"{KEYS}|{HEX}"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN i % 2 = 0 THEN (CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END FOR d, i IN [CAST(c AS INT) FOR c IN string_split(reverse({digits}), '')]]) % 10 = 0"
    packed = "replace(m, ' ', '')"
    numeral = f"list_aggregate([CASE WHEN c <= '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split(substr({packed}, 5) || left({packed}, 4), '')], 'string_agg', '')"
    mod97 = f"list_reduce([CAST(c AS INT) FOR c IN string_split({numeral}, '')], lambda a, c: (a * 10 + c) % 97) = 1"
    check = {
        "email": "true",
        "ip": "len([1 FOR p IN string_split(m, '.') IF CAST(p AS HUGEINT) > 255]) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"regexp_full_match(m, '{IBAN}') AND length({packed}) BETWEEN 15 AND 34 AND {mod97}",
        "ssn": f"regexp_full_match(m, '{SSN}') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
        "secret": f"regexp_full_match(m, '{KEYS}|{HEX}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 8",
    }
    parts = [
        f"""SELECT k, doc_id, t, '{kind}' AS kind, {rank} AS rank, m, e - length(m) AS s, e, {check[kind]} AS ok FROM (
              SELECT k, doc_id, t, m, sum(length(p) + length(m)) OVER (PARTITION BY k ORDER BY i) AS e FROM (
                SELECT k, doc_id, t, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_split_to_array(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS p,
                       unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{hint[kind]}')))"""
        for rank, (kind, p) in enumerate(plain.items())
    ]
    base = " ".join(f"WHEN '{k}' THEN {int(v * 100)}" for k, v in SCORES.items())
    word = " ".join(f"WHEN '{k}' THEN regexp_matches(before, '{v}', 'i')" for k, v in WORDS.items())
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
        f AS (SELECT k, kind, rank, m, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, substr(t, CAST(greatest(s - {CONTEXT}, 0) AS BIGINT) + 1, CAST(least(s, {CONTEXT}) AS BIGINT)) AS before
              FROM ({' UNION ALL '.join(parts)}) WHERE ok),
        h AS (SELECT *, least(CASE WHEN kind = 'secret' AND regexp_full_match(m, '{KEYS}') THEN {int(SURE * 100)} ELSE CASE kind {base} END END
                              + CASE WHEN CASE kind {word} END THEN {int(BONUS * 100)} ELSE 0 END, 100) AS score FROM f),
        g AS (SELECT k, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores,
                     string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
                     {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}" for x in KINDS)} FROM h WHERE rank < {len(BASE)} OR score >= {int(THRESHOLD * 100)} GROUP BY k)
        SELECT doc_id, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
        FROM d LEFT JOIN g USING (k)"""


ORACLES = {"op1_pii": _sql()}
