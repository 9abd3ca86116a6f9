"""Rank-order profiles: brute force on small texts, held-out accuracy on the tables."""

from collections import Counter

from helpers import clashing, documents
from stayrate.llm import langid
from stayrate.llm.queries import QUERIES


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for word in words:
        padded = f"_{word}_"
        grams.update(word)
        grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return grams


def as_number(gram):
    points = [32 if c == "_" else ord(c) for c in gram]
    return sum(p << 21 * i for i, p in enumerate(reversed(points)))


def brute_top(grams, size):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], as_number(x[0])))][:size]


TRAIN = [(1, "the cat and the dog, the end", "en"), (2, "der Hund und die Katze", "de"), (3, "THE Thing is that", "en"),
         (4, "le chat est là. L'été", "fr"), (5, None, "fr"), (6, "no language", None), (7, "", "xx")]
ASKED = [(10, "the dog"), (11, "und der Hund"), (12, "été"), (13, None), (14, ""), (15, "123 !? ½"), (16, "Ж"), (16, "Ж"),
         (17, "l'été " * 300_000)]


def test_against_brute_force(spark):
    size = 30
    learned = langid.profiles(clashing(documents(spark, TRAIN), "gram", "n", "rank"), size)
    counts = {}
    for _, text, lang in TRAIN:
        if text and lang:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    want = {lang: brute_top(g, size) for lang, g in counts.items()}
    got = {}
    for r in learned.orderBy("lang", "rank").collect():
        got.setdefault(r["lang"], []).append(r["gram"])
    assert got == {lang: [as_number(g) for g in grams] for lang, grams in want.items()}

    rows = langid.identify(clashing(documents(spark, ASKED), "p", "score", "lang_pred"), learned, size).collect()
    assert len(rows) == len(ASKED)
    for row, (i, text) in zip(sorted(rows, key=lambda r: r["doc_id"]), ASKED):
        top = brute_top(brute_grams(text or ""), size)
        if not top:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(want[lang].index(g) - k) if g in want[lang] else size for k, g in enumerate(top)) for lang in want}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert row["lang_pred"] == best and abs(row["score"] - (1 - far[best] / (size * len(top)))) < 1e-12


def test_pieces_of_a_long_text_count_like_one(monkeypatch):
    text = "eins zwei, drei vier " * 50
    whole = langid._grams(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    parts = langid._grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_nothing_learned(spark):
    learned = langid.profiles(documents(spark, []))
    rows = langid.identify(documents(spark, [(1, "text")]), learned).collect()
    assert [tuple(r) for r in rows] == [(1, "und", 0.0)]
    assert langid.identify(documents(spark, []), learned).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op10_language_id"](spark, sf_dir.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
