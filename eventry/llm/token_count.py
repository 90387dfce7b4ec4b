"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventry.llm._shared import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Added to the smallest score for a character that no piece covers.
UNKNOWN_PENALTY = -10.0
# Scores at or below this mark pieces that no merge makes.
UNMADE = -1e8
# Words longer than this are not remembered; so many words are, in each task.
_REMEMBER, _WORDS = 48, 200_000


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, without control, unknown, unused and byte pieces.

    The file marks the 15 pieces of spaces alone, which no merge makes, with -1e9. They get the smallest score of the others less one, as
    next to -1e9 other scores vanish in single precision and the library's choices no longer follow from the scores.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)]
    least = min(s for _, s in pieces if s > UNMADE)
    return [(p, s if s > UNMADE else least - 1) for p, s in pieces]


class Segmenter:
    """Counts of the best segmentation under the pieces' scores.

    Ties go as in the left-to-right search that replaces a node's best path only by a strictly better one: of equal paths
    into a position the one whose last piece starts first stays, and an uncovered character comes after all pieces. Scores are summed
    word by word: a single-precision sum from the start of a text would lose the small differences in long ones, and the library's does not.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) + UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        # A text may be cut where no piece reaches across: before a space that follows something else, if no piece has one inside, and
        # around characters that no piece has.
        inside = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        lone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p, _ in pieces))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else "")) if not inside else re.compile(".+", re.S)
        self.known: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """Tokens (an uncovered character is as many as its bytes), pieces and score of the best path over one word."""
        n = len(word)
        best, count, tokens = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        at, (length, score) = next(matches, (n, (0, 0.0)))
        for end in range(1, n + 1):
            top, start, alone = None, 0, False
            while at == end - 1:  # longest pieces first, so of equal paths the first start stays
                if top is None or best[end - length] + score > top:
                    top, start = best[end - length] + score, end - length
                at, (length, score) = next(matches, (n, (0, 0.0)))
            if word[end - 1] not in self.single and (top is None or best[end - 1] + self.unknown > top):
                top, start, alone = best[end - 1] + self.unknown, end - 1, True
            best[end], count[end] = top, count[start] + 1
            tokens[end] = tokens[start] + (len(word[start:end].encode("utf-8", "surrogatepass")) if alone else 1)
        return tokens[n], count[n], best[n]

    def text(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        tokens, pieces, score = 0, 0, 0.0
        for word, times in Counter(self.words.findall(SPACE + text.replace(" ", SPACE))).items():
            found = self.known.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= _REMEMBER:
                    if len(self.known) >= _WORDS:
                        self.known.clear()
                    self.known[word] = found
            tokens, pieces, score = tokens + times * found[0], pieces + times * found[1], score + times * found[2]
        return tokens, pieces, score


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, pieces and score of the best segmentation of every text: ``doc_id, n_tokens, n_pieces, score``.

    Spaces become the space mark and one is put before the text, as the tokenizer does. The vocabulary (a list of fixed size) goes to
    the executors with the task; the automaton is built once per task. Null and empty texts have no tokens; long texts count whole; ids are
    whole numbers, or null; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counter = Segmenter(shared.value)
        for whole in batches:
            for batch in small_batches(whole, 1):
                found = [counter.text(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))],
                    names=["doc_id", "n_tokens", "n_pieces", "score"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, n_pieces long, score double")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary())


QUERIES = {"op5_token_count": op5_token_count}
ORACLES: dict[str, str] = {}
