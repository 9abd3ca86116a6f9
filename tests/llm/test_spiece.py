"""SentencePiece: equal to the library, exact round trips, both rules against brute force."""

import os
import random
from functools import cache

import pytest
from helpers import clashing, documents
from stayrate.llm import spiece
from stayrate.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def model():
    return spiece.Pieces.load(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


ALPHABET = "ab  e\n\tthéß漢🙂.0=inreo▁"


def test_equal_to_the_library(model, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(3_000)]
    texts += ["", " ", "a" * 5_000, " " * 3_000, "th" * 4_000 + " ", "=-" * 900, "in" * 2_000 + "  " * 300, "漢字" * 400]
    for text in texts:
        assert model.encode(text).tolist() == library.encode(text)
        if "▁" not in text:
            assert model.decode(model.encode(text)) == text


def test_decoding_broken_bytes_like_the_library(model, library):
    rnd = random.Random(2)
    for _ in range(300):
        ids = [rnd.choice([rnd.randint(3, 258), rnd.randint(259, 31_999)]) for _ in range(rnd.randint(0, 12))]
        text = model.decode(ids)
        assert "�" in library.decode(ids) or text == library.decode(ids)


def unigram(scores):
    return spiece.Pieces(["<unk>", *scores], [0.0, *scores.values()], [False, *[True] * len(scores)], [], 0, "unigram", False)


def test_unigram_takes_the_best_sum():
    rnd = random.Random(3)
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))): -rnd.random() * 9 for _ in range(40)}
    small = unigram(scores)
    for _ in range(60):
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 80)))

        @cache
        def best(end, text=text):
            if not end:
                return 0.0
            every = [best(end - 1) + scores.get(text[end - 1], small.floor)]
            every += [best(s) + scores[text[s:end]] for s in range(max(0, end - 5), end) if text[s:end] in scores]
            return max(every)

        pieces = [small._text(code) for code in small.segments(text)]
        assert "".join(pieces) == text
        assert sum(scores.get(p, small.floor) for p in pieces) == pytest.approx(best(len(text)))


def test_window_stays_bounded(model, monkeypatch):
    widest = 0
    meeting = spiece.Pieces._meeting

    def watched(self, back, base, end):
        nonlocal widest
        widest = max(widest, len(back))
        return meeting(self, back, base, end)

    monkeypatch.setattr(spiece.Pieces, "_meeting", watched)
    text = "".join(random.Random(4).choice("abcdefghijklmnop") for _ in range(20_000))
    assert "".join(map(model._text, model.segments(text))) == text
    assert widest <= 8 * model.longest


def test_frames(spark, model):
    rows = [(1, "One  text.\n"), (1, "One  text.\n"), (2, None), (3, ""), (None, "🙂"), (4, "word " * 200_000), (5, "▁")]
    docs = clashing(documents(spark, rows), "ids", "n_ids", "exact", "decoded")
    both = spiece.decode(spiece.encode(docs, model, keep=("doc_id", "text")), model)
    for r in both.collect():
        assert (r["ids"] is None) == (r["text"] is None) == (r["decoded"] is None)
        if r["text"] is not None:
            assert r["n_ids"] == len(r["ids"]) and r["decoded"] == r["text"].replace("▁", " ")
    found = {r["doc_id"]: (r["n_ids"], r["exact"]) for r in spiece.round_trips(docs, model).collect()}
    assert found[2] == (None, None) and found[3] == (0, True) and found[1][1] and found[None][1] and not found[5][1]
    assert spiece.round_trips(documents(spark, []), model).count() == 0


def test_query_on_tables(spark, sf_dir, library):
    rows = QUERIES["op8_sentencepiece"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r["exact"] for r in rows)


def test_model_file_is_a_parameter():
    assert os.path.exists(TOKENIZER)


def test_words_are_searched_without_a_window(model, library, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice(ALPHABET.replace("▁", "")) for _ in range(rnd.randint(1, 4 * model.longest))) for _ in range(800)]
    words += ["漢" * 9, "thheorwh", "zuheiter", "\x01\x02", "é漢é"]
    for word in words:
        assert model._short(word) == list(model.segments(word))
    monkeypatch.setattr(spiece.Pieces, "segments", None)
    model.parts.clear()
    for text in [*words, "Onlyblend ofentioned, anhaenin.\nTo"]:
        if text and "  " not in text:
            assert model._ids(("▁" + text).replace(" ", "▁")) == tuple(library.encode(text))


def test_batches_are_cut_where_no_piece_joins(library):
    import pyarrow as pa

    fresh = spiece.Pieces.load(TOKENIZER)
    rnd = random.Random(6)
    letters = ALPHABET.replace("▁", "") + "\x01,;'\"-_({Z9"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2_000)] + [None, "", " ", " \n  a"]
    ids, sizes, exact = spiece.encoded(fresh, pa.array(texts))
    assert ids.to_pylist() == [None if t is None else library.encode(t) for t in texts]
    assert sizes.to_pylist() == [None if t is None else len(library.encode(t)) for t in texts]
    assert exact.to_pylist() == [None if t is None else True for t in texts]
    # letters that no piece joins: each side is searched once, not each combination
    left, right = ("the", "one", "with", "from", "then"), ("\x01this", "\x01that", "\x01some", "\x01more")
    assert all(a[-1] + "\x01" not in fresh.inside for a in left)
    fresh.checked.clear(), fresh.before.clear()
    joined = [a + b for a in left for b in right]
    ids, _, _ = spiece.encoded(fresh, pa.array(joined))
    assert ids.to_pylist() == [library.encode(t) for t in joined]
    assert len(fresh.checked) <= len(left) + len(right) + 1
