"""Column functions on texts, keys, coordinates and probabilities (C01-C18). All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rewrite rules in the order in which they apply. The first 15 match case, the others do not.
ABBREVIATIONS = (
    (r"\b(f/off|face\s*off|faceoff)\b", "faceoff"),
    (r"\bchk\b", "check"),
    (r"\brec\b", "reception"),
    (r"\bdef\b", "defence"),
    (r"\bblue hold\b", "blueline hold"),
    (r"\b(e\s*w|e/w)\b", "east/west"),
    (r"\b(dz|d[- ]?zone|dzone|defensive zone)\b", "defensive zone"),
    (r"\b(nz|n[- ]?zone|nzone|neutral zone)\b", "neutral zone"),
    (r"\b(oz|o[- ]?zone|ozone|offensive zone)\b", "offensive zone"),
    (r"\b(dzpass|d[- ]?zone\s*pass|defensive zone\s*pass)\b", "defensive zone pass"),
    (r"\b(nzpass|n[- ]?zone\s*pass|neutral zone\s*pass)\b", "neutral zone pass"),
    (r"\b(ozpass|o[- ]?zone\s*pass|offensive zone\s*pass)\b", "offensive zone pass"),
    (r"\b(dzdeke|d[- ]?zone\s*deke|defensive zone\s*deke)\b", "defensive zone deke"),
    (r"\b(nzdeke|n[- ]?zone\s*deke|neutral zone\s*deke)\b", "neutral zone deke"),
    (r"\b(ozdeke|o[- ]?zone\s*deke|offensive zone\s*deke)\b", "offensive zone deke"),
)
REPLACEMENTS = (
    (r"\blpr\b", "loose puck recovery"),
    (r"\bcont\b", "contested"),
    (r"\breb\b", "rebound"),
    (r"\bopdump\b", "opposing dump"),
    (r"\bhipresopdump\b", "high pressure opposing dump"),
    (r"\bnofore\b", "no forecheck"),
    (r"\bhi press\b", "high pressure"),
    (r"offboards", "off boards"),
    (r"\bd2d\b", "defenceman to defenceman pass"),
    (r"\bbc\b", "board cycle"),
    (r"\bsc\b", "slot cycle"),
    (r"\bci\b", "chip in"),
    (r"\bdi\b", "dump in"),
    ("nzpuckprotection", "neutral zone puck protection"),
    ("ozpuckprotection", "offensive zone puck protection"),
    ("dzpuckprotection", "defensive zone puck protection"),
    ("lprreb", "loose puck recovery rebound"),
    ("failed pass trajectory location", "failed pass to"),
    ("offensive zone entry pass reception", "offensive zone entry pass successful"),
    ("defensive deflection; original description: outside shot for onnet", "defensive deflection"),
    ("defensive deflection; original description: slot shot for onnet", "defensive deflection"),
    (r"\bnz\b", "neutral zone"),
    (r"\boz\b", "offensive zone"),
    (r"\bdz\b", "defensive zone"),
)
REMOVALS = (r";\s*original\s+description\s*:.*$", r"\bsuccessful\b", r"\bmiss\s+pass\b", r"\bmiss\s+shot\b", r"\bblocked\b", r"\bmissed\b")
LEAKS = r"\bgoal\b|\bgoals\b|\bon\s*net\b|\bonnet\b|\bwith\s*goal\b|\bwith\s*shot\s*on\s*net(?:\s*whistle)?\b"
BLOCKED_TOKENS = ("withgoal", "withshotonnet", "withshotonnetwhistle")
PENALTY_CLASSES = ((("double", "minor"), "double_minor"), (("major",), "major"), (("misconduct",), "misconduct"), (("match",), "match"), (("minor",), "minor"))
TRUE_WORDS = ("1", "true", "t", "yes", "y")
GOALIE_ROLE = r"(?:^|\b)G(?:\b|$)|GOAL"

FORBIDDEN = ("successful", "miss pass", "miss shot", "blocked", "missed")
FLAG_PREFIX, BRACKETS = r"^(?:shot|deflection)\s*_?\s*flags?\s*[:_\-\s]*", r"[\[\](){}]"

DEFAULT_REWRITES = (*ABBREVIATIONS, *((f"(?i){f}", t) for f, t in REPLACEMENTS), *((f"(?i){f}", " ") for f in REMOVALS))


def normalize_text(col: Column) -> Column:
    """Plus and minus to spaces, white space collapsed, trimmed, lower case; null to ''."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[+-]", " "), r"\s+", " ")))


def rewrite_text(col: Column, rules=DEFAULT_REWRITES) -> Column:
    """Replacements one after the other; the order matters."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def strip_leaks(col: Column, leaks: str = LEAKS) -> Column:
    """Lower case, leaking words out, white space collapsed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), leaks, " "), r"\s+", " ")), F.lit(""))


def clean_description(col: Column) -> Column:
    """C01 to C03 in turn: a description normalised, rewritten by the rules, and stripped of what leaks."""
    return strip_leaks(rewrite_text(normalize_text(col)))


def has_leak(col: Column, leaks: str = LEAKS) -> Column:
    return F.coalesce(col.rlike(f"(?i){leaks}"), F.lit(False))


def tokenize_flags(col: Column) -> Column:
    """Flags split on , ; | and /, without brackets and prefix; the first of equal ones stays. Null has none."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(col, F.lit(""))), "+-", "  "), BRACKETS, "")
    def clean(token: Column) -> Column:
        bare = F.regexp_replace(F.trim(token), FLAG_PREFIX, "")
        return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ ,._:-]+|[ ,._:-]+$", "")
    return F.array_distinct(F.filter(F.transform(F.split(plain, r"[,;|/]"), clean), lambda t: t != ""))


def filter_tokens(tokens: Column, drop: tuple[str, ...] = (), blocked: tuple[str, ...] = BLOCKED_TOKENS, leaks: str = LEAKS) -> Column:
    """Tokens that leak nothing, hold no asterisk and are not on a list, joined again; none gives null."""
    compact = lambda t: F.regexp_replace(t, "[^a-z0-9]", "")
    good = F.filter(tokens, lambda t: ~compact(t).isin(*blocked) & ~has_leak(t, leaks) & ~t.contains("*") & (~t.isin(*drop) if drop else F.lit(True)))
    return F.nullif(F.array_join(good, ", "), F.lit(""))


def join_texts(*cols: Column) -> Column:
    """Texts joined by ' ; ', without such marks at the ends; '' becomes null."""
    return F.nullif(F.btrim(F.concat_ws(" ; ", *[F.coalesce(c, F.lit("")) for c in cols]), F.lit(" ;")), F.lit(""))


def to_seconds(col: Column) -> Column:
    """A number, or MM:SS, as seconds."""
    text = F.trim(col.cast("string"))
    parts = F.split(text, ":")
    clock = F.try_element_at(parts, F.lit(1)).try_cast("double") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.coalesce(text.try_cast("double"), F.when(F.size(parts) == 2, clock))


def classify_text(col: Column, rules=PENALTY_CLASSES, default: str = "other") -> Column:
    """The label of the first rule whose words all occur."""
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    cases = [(reduce(lambda a, b: a & b, [text.contains(w) for w in words]), label) for words, label in rules]
    return F.coalesce(*[F.when(c, F.lit(label)) for c, label in cases], F.lit(default))


def any_match(cols: list[Column], regex: str) -> Column:
    """Whether any of the texts matches."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.rlike(regex), F.lit(False)) for c in cols])


def distance_to(x: Column, y: Column, px=89.0, py=0.0) -> Column:
    """C10."""
    return F.hypot(F.lit(px) - x, F.lit(py) - y)


def angle_to(x: Column, y: Column, px=89.0, py=0.0) -> Column:
    """C10, in radians."""
    return F.atan2(F.lit(py) - y, F.lit(px) - x)


def flip_if(cond: Column, *cols: str) -> dict[str, Column]:
    """C11: the columns negated where the condition holds; a null condition is false."""
    return {c: F.when(F.coalesce(cond, F.lit(False)), -F.col(c)).otherwise(F.col(c)) for c in cols}


def relative_position(x: Column, y: Column, ox: Column, oy: Column) -> Column:
    """Place and distance seen from an origin."""
    return F.struct((x - ox).alias("dx"), (y - oy).alias("dy"), F.hypot(x - ox, y - oy).alias("distance"))


def role(entity: Column, team: Column, actor: Column, actor_team: Column) -> Column:
    """Actor, teammate or opponent."""
    return F.when(entity == actor, "actor").when(team == actor_team, "teammate").otherwise("opponent")


def normalize_keys(df: DataFrame, group: str, id: str) -> DataFrame:
    """A text group, and ids with six decimals so that equality joins are exact."""
    return df.withColumns({group: F.col(group).cast("string"), id: F.bround(F.col(id).cast("decimal(24,9)"), 6).cast("decimal(18,6)")})


def clip(col: Column, low: float, high: float) -> Column:
    """C14: null stays null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def wrap_angle(col: Column) -> Column:
    """C14: into (-pi, pi]."""
    return F.atan2(F.sin(col), F.cos(col))


def is_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """C14."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def parse_bool(*cols: Column) -> Column:
    """Whether any column says yes."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False)) for c in cols])


def match_role(col: Column, regex: str = GOALIE_ROLE) -> Column:
    """C16."""
    return F.coalesce(F.upper(col).rlike(regex), F.lit(False))


def band(col: Column, cuts: tuple[float, ...] = (5.0, 25.0), labels: tuple[str, ...] = ("center", "near", "far")) -> Column:
    """C17: the label of the first cut that the absolute value does not pass; null stays null."""
    cases = [F.when(F.abs(col) <= c, F.lit(label)) for c, label in zip(cuts, labels, strict=False)]
    return F.coalesce(*cases, F.when(col.isNotNull(), F.lit(labels[-1])))


def normalize_probs(cols: list[Column], eps: float = 1e-12) -> list[Column]:
    """A row of probabilities clipped to (0, 1] that sums to 1; uniform if there is nothing to scale."""
    clean = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in cols]
    total = reduce(lambda a, b: a + b, clean)
    clipped = [F.when(total <= eps, F.lit(1.0 / len(cols))).otherwise(F.least(F.greatest(c, F.lit(eps)), F.lit(1.0))) for c in clean]
    whole = reduce(lambda a, b: a + b, clipped)
    return [c / whole for c in clipped]
