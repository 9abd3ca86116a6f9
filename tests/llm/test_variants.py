import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, documents

from stayrate.llm import variants

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(rows, least_chars=6, least_n=5, ratio=5, slips=None):
    counts = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if c < "\x80" else c
            if c in ALPHABET:
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if slips and h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def found(df, **how):
    rows = variants.grouped(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def text(seed):
    """Words over few letters, so that many are near each other, often with accents and capitals."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀéÿ×") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    weights = [1 / (i + 1) ** 1.5 for i in range(60)]
    mixed = []
    for w in rng.choices(words, weights, k=1500):
        r = rng.random()
        if r < 0.2:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice("abéz") + w[at + (r < 0.1):]
        mixed.append(w.upper() if r > 0.95 else w)
    return rng.choice([" ", ", ", "\n", "1"]).join(mixed)


def test_equals_brute_force_also_in_many_passes(spark):
    rows = [(i, text(i)) for i in range(4)] + [(None, text(9)), (0, text(0))]
    expected = brute(rows, slips=7)
    assert sum(r[1] is not None for r in expected) > 5 and max(r[4] for r in expected) > 2
    assert found(documents(spark, rows), slips=7) == expected
    assert found(documents(spark, rows), slips=7, pass_bytes=200) == expected


def test_defined_cases(spark):
    many = " ".join(["abcdef"] * 30 + ["abcdeg"] * 6 + ["abcde"] * 50 + ["abcdefg"] * 5 + ["ÀBCDEF àbcdef"] * 5)
    rows = [(1, None), (2, ""), (3, " \n 12"), (None, many)]
    df = clashing(documents(spark, rows), "word", "n", "form", "other", "root")
    assert found(df) == brute(rows)
    # equal counts: the first in code-point order is the form; a capital letter beyond A-Z stays as it is
    tied = [(1, " ".join(["abcdez"] * 5 + ["abcdea"] * 25 + ["abcdeb"] * 25 + ["Àbcdez"] * 5))]
    assert dict((r[0], r[1]) for r in found(documents(spark, tied)))["abcdez"] == "abcdea"
    assert found(documents(spark, tied)) == brute(tied)
    assert found(documents(spark, rows[:3])) == [] and found(documents(spark, [])) == []


def test_a_very_long_word(spark):
    long = "".join(random.Random(1).choice("abcde") for _ in range(3000))
    rows = [(1, " ".join([long] * 25 + [long[:-1]] * 5 + ["x" + long] * 5))]
    got = found(documents(spark, rows))
    assert sorted((len(r[0]), r[1] and len(r[1]), r[3], r[4]) for r in got) == [
        (2999, 3000, 5, 1), (3000, None, 25, 2), (3001, 3000, 5, 1)]


def test_chains_of_forms_end_at_the_last(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(5 * 5**i)))]
    got = {r[0]: r[2] for r in found(documents(spark, rows))}
    assert got == dict.fromkeys(words, "aabbbb")


@pytest.mark.parametrize("n", [1, 4, 65_536, 65_537, 10_000_000])
def test_filters_keep_their_share_of_bits(n):
    segments, blocks = variants._shape(n)
    assert segments * blocks * variants.BLOCK_WORDS >= n and blocks <= variants.SEGMENT_BLOCKS


def test_edit_hashes_are_those_of_the_edited_words():
    known = variants._Pass({6: (1, 16), 5: (1, 16)}, [])
    seen = []
    known.hits = lambda length, h: (seen.append((length, h)), np.arange(len(h)))[1]
    edits = list(variants._probed(["aabcdz"], known, np.frombuffer(b"abcdz", np.uint8)))
    hashes = np.concatenate([h for _, h in seen])
    whole = [int(variants._terms(np.frombuffer(w.encode(), np.uint8)[None]).sum()) for _, w in edits]
    assert len(edits) == len(set(edits)) and whole == [int(h) for h in hashes]
