"""Multiset hash: next documents and edits against Python, algebra of the fingerprints."""

import hashlib
import random

import pytest
from helpers import clashing, documents, store
from pyspark.sql import functions as F
from stayrate.llm import multiset
from stayrate.llm.queries import QUERIES


def brute(rows):
    """(id, n_chars, sha of the edited text) in order."""
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    out = []
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        third = len(text) // 3
        out.append((i, len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = clashing(documents(spark, rows), "fp", "next", "body", "_key", "_bucket", "_parts")
    return multiset.compared(docs).collect()


def test_next_and_edited(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(10**9), "".join(rnd.choice("ab é🙂.\n") for _ in range(rnd.randint(0, 90)))) for _ in range(300)]
    rows += [(5, None), (6, ""), (7, "x" * 500_000), (None, "no id"), (8, "same"), (8, "same"), (9, "one"), (9, "other"), (2**62, "high")]
    found = run(spark, rows)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str) == brute(rows)
    assert all(0 <= r[k] <= 1 for r in found for k in ("near_edited", "near_next"))


@pytest.mark.parametrize("rows", [[], [(1, "alone. here.")], [(2, None), (1, None)], [(3, "a"), (3, "a")]])
def test_few_rows(spark, rows):
    found = run(spark, rows)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str) == brute(rows)
    if len(rows) == 1 or not any(t for _, t in rows):
        assert all(r["near_next"] == 1.0 for r in found)


def prints(spark, texts):
    df = documents(spark, list(enumerate(texts)))
    return [r[0] for r in multiset.with_vector(df, "text", "fp").orderBy("doc_id").select("fp").collect()]


def test_algebra(spark):
    a, b, ab, ba, twice, empty, same = prints(spark, ["One. Two!\nThree?", "Four.\nTwo!", "One. Two!\nThree?\nFour.\nTwo!",
                                                      "Two!\nFour.\nTwo! Three?\nOne.", "Four.\nTwo!\nFour.\nTwo!", None, "  \n\n"])
    assert ab == ba and a != b and empty == same == [0] * multiset.LANES
    frame = spark.createDataFrame([(a, b, ab, twice)], "a array<long>, b array<long>, ab array<long>, twice array<long>")
    row = frame.select(multiset.added(F.col("a"), F.col("b")), multiset.removed(F.col("ab"), F.col("a")),
                       multiset.added(F.col("b"), F.col("b"))).first()
    assert list(row) == [ab, b, twice]


def test_vectors_are_wide_sums_modulo_a_power(spark):
    text = "Some paragraph."
    one, many = prints(spark, [text, f"{text}\n" * 200_000])
    assert many == [x * 200_000 % multiset.MODULUS for x in one]
    signed = [x - multiset.MODULUS if x >= multiset.MODULUS // 2 else x for x in one]
    assert len(one) == multiset.LANES and sorted(set(signed)) == list(range(-15, 16, 2))


def test_likeness_follows_the_shared_paragraphs(spark):
    words = [f"Paragraph number {i} says {i * i}." for i in range(3_000)]
    for shared in (0.0, 0.5, 0.9):
        k = int(1_000 * shared)
        a, b = prints(spark, ["\n".join(words[:1_000]), "\n".join(words[:k] + words[1_000 : 2_000 - k])])
        frame = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        assert abs(frame.select(multiset.likeness(F.col("a"), F.col("b"))).first()[0] - shared) < 3 / multiset.LANES**0.5


def test_query_on_tables(spark, sf_dir):
    rows = QUERIES["op6_multiset_hash"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == brute(list(texts.items()))
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    near = sum(r["near_edited"] for r in rows) / len(rows)
    assert near > 0.45 > 0.2 > sum(r["near_next"] for r in rows) / len(rows)


def test_same_next_for_any_number_of_ranges(spark, tmp_path):
    rows = [(i * 7 % 101, f"text {i}.") for i in range(101)]
    docs = documents(spark, rows).select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    one, many = (sorted(map(tuple, multiset.with_next(docs, "id", ["id", "body"], n).select("id", "next.id").collect()))
                 for n in (1, 50))
    assert one == many == sorted((i, (i - 1) % 101) for i in range(101))
    assert store(spark, tmp_path, documents=docs)


def test_vectors_equal_plain_sums_of_half_bytes(spark):
    """Every lane from xxhash in Python: one half-byte v of a hash per paragraph and seed, as 2 v - 15, modulo 2**24."""
    import re

    import xxhash

    rnd = random.Random(4)
    pieces = ["One two.", "Three!", "é 🙂?", "\nfour", " five", ".\t\x0b tabbed\t\n"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    for text, got in zip(texts, prints(spark, texts)):
        lanes = []
        parts = [p.strip(multiset.BLANK) for p in re.split(r"[\r\n]+|(?<=[.!?])\s+", text)]
        for seed in range(multiset.LANES // multiset.PER_HASH):
            start = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
            hashes = [xxhash.xxh64_intdigest(part.encode(), start) for part in parts if part]
            for at in range(8):
                lanes += [sum(2 * (h >> shift & 15) - 15 for h in hashes) for shift in (4 * at, 4 * at + 32)]
        assert got == [x % multiset.MODULUS for x in lanes]


def test_error_of_likeness(spark):
    """Over many pairs the error has the stated spread, and no pair is off by more than five times that."""
    rnd = random.Random(6)
    pairs, truth = [], []
    for k in range(200):
        shared = rnd.randint(0, 40)
        first = [f"Common {k} {i}." for i in range(shared)] + [f"First {k} {i}." for i in range(40 - shared)]
        pairs += [" ".join(first), " ".join([f"Common {k} {i}." for i in range(shared)] + [f"Second {k} {i}." for i in range(40 - shared)])]
        truth.append(shared / 40)
    found = prints(spark, pairs)
    frame = spark.createDataFrame([(k, found[2 * k], found[2 * k + 1]) for k in range(200)], "k int, a array<long>, b array<long>")
    got = [r[1] for r in frame.select("k", multiset.likeness(F.col("a"), F.col("b"))).orderBy("k").collect()]
    off = [g - t for g, t in zip(got, truth)]
    assert (sum(e * e for e in off) / 200) ** 0.5 < 1.1 / multiset.LANES**0.5
    assert max(map(abs, off)) < 5 / multiset.LANES**0.5


def test_ids_that_are_no_numbers_are_an_error(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError):
        multiset.compared(docs)
