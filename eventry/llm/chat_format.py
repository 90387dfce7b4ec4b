"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import table

# The control strings of the template. A backslash stands before those of them that are content.
#   user:      [INST] body [/INST]
#   assistant: body</s>
#   others:    <<ROLE>>role<</ROLE>>body</s>
CONTROLS = ("[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "<s>", "</s>")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_PAIR = r"\\[\\\[<]"
_TOKEN = re.compile(f"{_PAIR}|{_CONTROL}")
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_PIECE = "conv_id long, seq long, piece string, start long"


def _wrap(role: str, body: str, name: str) -> str:
    if role == "user":
        return f"[INST] {body} [/INST]"
    return f"{body}</s>" if role == "assistant" else f"<<ROLE>>{name}<</ROLE>>{body}</s>"


def _escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def _plain(text: str) -> str:
    return re.sub(_PAIR, lambda m: m[0][1], text)


class Unfinished(ValueError):
    """The text ends inside a turn."""


def _until(text: str, at: int, end: str) -> tuple[str, int]:
    """The content from ``at`` to the next control string, which must be ``end``, and the place after it."""
    for m in _TOKEN.finditer(text, at):
        if m[0][0] != "\\":
            if m[0] != end:
                raise ValueError(f"{m[0]} at {m.start()} where {end} is due")
            return text[at : m.start()], m.end()
    raise Unfinished(f"no {end} after {at}")


def _turn(text: str, at: int) -> tuple[tuple[str, str, str], int]:
    """The turn at ``at`` as (role, text, the text as it stands there), and the place after it."""
    if text.startswith("[INST] ", at):
        body, at = _until(text, at + 7, "[/INST]")
        if body[-1:] != " ":
            raise ValueError("no space before [/INST]")
        return ("user", _plain(body[:-1]), body[:-1]), at
    if text.startswith("<<ROLE>>", at):
        name, at = _until(text, at + 8, "<</ROLE>>")
        body, at = _until(text, at, "</s>")
        return (_plain(name), _plain(body), body), at
    if any(start.startswith(text[at:]) for start in ("[INST] ", "<<ROLE>>")):
        raise Unfinished("the start of a turn")
    body, at = _until(text, at, "</s>")
    return ("assistant", _plain(body), body), at


class Parser:
    """Reads a formatted text that comes in parts, wherever they are cut; only an unfinished turn is held."""

    def __init__(self):
        self.rest = ""

    def feed(self, part: str) -> list[tuple[str, str, str]]:
        """The turns that end in this part. Raises ValueError on anything the grammar lacks."""
        self.rest += part
        turns, at = [], 0
        while at < len(self.rest):
            try:
                turn, at = _turn(self.rest, at)
            except Unfinished:
                break
            turns.append(turn)
        self.rest = self.rest[at:]
        return turns

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends inside a turn")


def parse(text: str) -> list[tuple[str, str, str]]:
    """The turns of a whole formatted text. Raises ValueError on anything the grammar lacks."""
    parser = Parser()
    turns = parser.feed(text)
    parser.close()
    return turns


def render(role: str, text: str) -> str:
    """One turn. Content goes in as it is if the parser gets it back so; else it is escaped, and checked again."""
    for change in (lambda x: x, _escape):
        piece = _wrap(role, change(text), change(role))
        try:
            if [t[:2] for t in parse(piece)] == [(role, text)]:
                return piece
        except ValueError:
            pass
    raise ValueError("a turn does not survive its round trip")


def _format(batches):
    last, seq, start, parser = object(), 0, 0, Parser()
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if conv != last:
                last, seq, start, parser = conv, 0, 0, Parser()
            piece = render(role or "", text or "")
            # The conversation so far is parsed on, not the turn alone.
            if [t[:2] for t in parser.feed(piece)] != [(role or "", text or "")] or parser.rest:
                raise ValueError("a conversation does not survive its round trip")
            out.append((conv, seq, piece, start))
            seq, start = seq + 1, start + len(piece)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "seq", "piece", "start"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("start", pa.int64())]))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted text of every conversation, as one piece per turn: ``conv_id, seq, piece, start`` (code points).

    The pieces of a conversation, joined in the order of ``seq``, are its formatted text. Ids are whole numbers; long texts count whole. Rows of a
    conversation are ordered by turn (nulls first), then role and text. Null roles and texts count as empty; rows without an id are one conversation; repeated rows are turns of their own; an
    empty table gives no rows; other columns are ignored. A conversation streams through one task, a turn at a time.
    """
    named = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, _PIECE)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Conversations read back from their pieces; only counts and running digests are held."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    state = None

    def row(s):
        s["parser"].close()
        return (s["id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

    for batch in batches:
        out = []
        for conv, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or state["id"] != conv:
                if state:
                    out.append(row(state))
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "parser": Parser()}
            state["chars"] += len(piece)
            for role, text, _ in state["parser"].feed(piece):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                if role == "assistant":  # the loss mask: the content of assistant turns
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row(state), strict=True))], pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation the counts and digests of what the parser recovers from its whole text; ``pieces``, in order, may be cut anywhere."""
    return pieces.mapInArrow(_digest, _DIGEST)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(turns.union(own)))


QUERIES = {"op6_chat_format": op6_chat_format}
_SQL_CONTROL = r"\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>|<s>|</s>"
ORACLES = {
    "op6_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_matches(t, '\\[\\\[<]|{_SQL_CONTROL}') OR (r <> 'user' AND ends_with(t, '\')) OR
                        (r NOT IN ('user', 'assistant') AND (regexp_matches(r, '\\[\\\[<]|{_SQL_CONTROL}') OR ends_with(r, '\'))) AS esc FROM c),
        f AS (SELECT *, CASE WHEN esc THEN length(regexp_replace(t, '(\\|{_SQL_CONTROL})', '\\\1', 'g')) ELSE length(t) END AS nt,
                        CASE WHEN esc THEN length(regexp_replace(r, '(\\|{_SQL_CONTROL})', '\\\1', 'g')) ELSE length(r) END AS nr FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(nt + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 21 + nr END) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id"""
}
