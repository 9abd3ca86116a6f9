"""SimHash near copies against a brute force over all pairs."""

import random

import pytest
import xxhash
from helpers import clashing, documents
from stayrate.llm import simhash
from stayrate.llm.graph import components


def brute_print(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(nodes, bits):
    """node -> smallest node reachable."""
    nodes, root = sorted(set(nodes)), {}
    for start in nodes:
        if start in root:
            continue
        todo, root[start] = [start], start
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in root and (a ^ b).bit_count() <= bits:
                    root[b] = start
                    todo.append(b)
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "one TWO", "a b c", "Á É a b  c d e", "x " * 70_000,
    " ".join(str(i % 977) for i in range(50_000))])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == signed(brute_print(text))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd", [2, 512])
def test_links_equal_brute_force(spark, bits, crowd):
    rnd = random.Random(bits)
    centres = [rnd.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    found = set(centres)
    for centre in centres:
        for _ in range(25):
            flips = rnd.sample(range(64), rnd.randint(1, 4))
            found.add(centre ^ sum(1 << f for f in flips))
    fps = spark.createDataFrame([(signed(f),) for f in found], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(fps, bits, crowd)).collect()}
    classes, expected = {}, {}
    for f in found:
        classes.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    for f, root in brute_components(found, bits).items():
        expected.setdefault(root, set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_long_postings_by_flips(spark):
    """More than 512 fingerprints that share six bytes."""
    values = [signed(0xABCDEF0123450000 | i) for i in range(0, 4_000, 3)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(fps, 2)).collect()}
    want = brute_components([v & (1 << 64) - 1 for v in values], 2)
    assert len({roots.get(v, v) for v in values}) == len(set(want.values()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (203, 201), (202, 203), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 202: 201, 203: 201, 301: 300}


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.upper()), (9, base + " end"), (4, None), (2, ""), (8, " \n"), (5, "alone in here"), (5, "alone in here"),
            (None, "without an id"), (None, base)]
    docs = clashing(documents(spark, rows), "fp", "component_id", "root", "a", "b", "key", "slot", "n")
    found = [tuple(r) for r in simhash.near_copies(docs).collect()]
    fps = {i: signed(brute_print(t)) for i, t in rows if i is not None}
    near = (fps[7] ^ fps[9]).bit_count() <= 2
    want = {7: 3, 3: 3, 9: 3 if near else 9, 4: 2, 2: 2, 8: 2, 5: 5}
    assert sorted((i, c) for i, _, c in found if i is not None) == sorted([*want.items(), (5, 5)])
    assert sorted(str(c) for i, _, c in found if i is None) == ["3", "None"]
    assert all(fp == fps[i] for i, fp, _ in found if i is not None)


def test_empty_table(spark):
    assert simhash.near_copies(documents(spark, [])).count() == 0


def test_query_on_tables(spark, sf_dir):
    from stayrate.llm.queries import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op9_simhash_near_copies"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(fps.values(), 2)
    smallest = {}
    for i in sorted(fps):
        smallest.setdefault(roots[fps[i]], i)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == {
        i: (f"{f:016x}", smallest[roots[f]]) for i, f in fps.items()}
