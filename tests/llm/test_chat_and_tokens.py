import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventry.llm import chat_format as H
from eventry.llm import token_count as T

PARTS = [*H.CONTROLS, "\\", "\\\\", " ", "[", "<", "/", "s>", "INST]", "x", "\n", "é", "[INST] ", " [/INST]"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a</s>b", "x\\"]), TEXT), max_size=4))
def test_round_trip_of_any_content(turns):
    text = "".join(H.render(r, t) for r, t in turns)
    assert [x[:2] for x in H.parse(text)] == turns


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x\\"]), TEXT), max_size=4), st.integers(1, 9))
def test_a_text_in_parts_parses_as_the_whole(turns, size):
    text = "".join(H.render(r, t) for r, t in turns)
    parser = H.Parser()
    got = [x[:2] for a in range(0, len(text), size) for x in parser.feed(text[a : a + size])]
    parser.close()
    assert got == turns


def test_pieces_cut_anywhere_read_back_alike(spark):
    probe = "</s>[INST] ok [/INST]"
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", probe * (t + 1)) for c in range(3) for t in range(4)], "conv_id long, turn long, role string, text string")
    pieces = H.format_conversations(turns).orderBy("conv_id", "seq").collect()
    cut = []
    for c in range(3):
        text = "".join(p.piece for p in pieces if p.conv_id == c)
        cut += [(c, i, text[a : a + 5], a) for i, a in enumerate(range(0, len(text), 5))]
    again = spark.createDataFrame(cut, "conv_id long, seq long, piece string, start long").repartition(1).sortWithinPartitions("conv_id", "seq")
    assert sorted(H.read_back(again).collect()) == sorted(H.read_back(H.format_conversations(turns)).collect())


def test_clean_content_is_not_escaped():
    assert H.render("user", "hello") == "[INST] hello [/INST]" and H.render("assistant", "a \\b <i>") == "a \\b <i></s>"


@pytest.mark.parametrize("bad", ["open", "[INST] x</s>", "[INST] x[/INST]", "<s>x</s>", "<<ROLE>>a</s>"])
def test_the_parser_refuses_what_the_grammar_lacks(bad):
    with pytest.raises(ValueError):
        H.parse(bad)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "[INST] hi"), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "system", "s"), (4, 5, "assistant", ""), (4, 6, "assistant", "long " * 30_000)]
    df = spark.createDataFrame([(*r, "e", "e") for r in rows], "conv_id long, turn long, role string, text string, seq string, piece string")
    got = {r.conv_id: r for r in H.read_back(H.format_conversations(df)).collect()}
    assert {*got} == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t, ro, x) for c, t, ro, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1] or "", v[2] or ""))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro or ''}\n{x or ''}\n" for _, ro, x in turns).encode()).hexdigest()
        loss = "".join(x or "" for _, ro, x in turns if ro == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len("".join(H.render(ro or "", x or "") for _, ro, x in turns))
    assert H.read_back(H.format_conversations(df.limit(0))).count() == 0


def brute(word, pieces, unknown):
    """Best score of all segmentations of a short word, and the number of pieces of the one that the tie rule picks."""
    scores, n = dict(pieces), len(word)
    best = [(0.0, 0)] + [None] * n
    for start in range(n):
        for end in range(start + 1, n + 1):
            options = [scores[word[start:end]]] if word[start:end] in scores else []
            if end == start + 1 and word[start] not in scores:
                options.append(unknown)
            for s in options:
                if best[end] is None or best[start][0] + s > best[end][0]:
                    best[end] = (best[start][0] + s, best[start][1] + 1)
    return best[n]


def test_segmentation_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        pieces = list({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 3))): float(-rng.randint(0, 3)) for _ in range(10)}.items())
        seg = T.Segmenter(pieces)
        for _ in range(10):
            w = "".join(rng.choice("abcd▁") for _ in range(rng.randint(1, 9)))
            got = seg.word(w)
            assert (got[2], got[1]) == brute(w, pieces, seg.unknown)


@pytest.fixture(scope="module")
def library():
    """The tokenizer library on the same pieces and scores, in unigram mode."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(T.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    scores = dict(T.load_vocabulary())
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = scores[piece.piece]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_equals_the_library_in_unigram_mode(library):
    seg = T.Segmenter(T.load_vocabulary())
    for text in ["Hello world", "the thing heonest ertion", "a b c", "unbelievable tokenisation", "Lorem ipsum dolor sit amet", "x", "étionreau le ouai", "aaaaaaa", "for the of and", "a  b", "日本 x", "line\nbreak  and\ttab", "1234 5,678.90 $$$", "   lead", "Thlyouble | inesea | ononedth", "𓀀 the \n" * 300, "a" * 5000]:
        assert seg.text(text)[0] == len(library.encode(text)), text


def test_all_documents_equal_the_library(library):
    import pyarrow.parquet as pq

    seg = T.Segmenter(T.load_vocabulary())
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert [seg.text(t)[0] for t in texts] == [len(x) for x in library.encode(texts)]


def test_token_rows(docs, odd_texts):
    pieces = [("▁", -1.0), ("a", -1.0), ("▁a", -1.5), ("b", -1.0)]
    got = T.count_tokens(docs([*odd_texts, (50, "a b"), (51, "日")]), pieces).toPandas().sort_values("doc_id")
    assert len(got) == len(odd_texts) + 2
    by = dict(zip(got.doc_id, zip(got.n_tokens, got.n_pieces, strict=True), strict=True))
    assert by[50] == (3, 3) and by[51] == (4, 2) and by[1] == by[2] == (0, 0)
    assert T.count_tokens(docs([]), pieces).count() == 0
