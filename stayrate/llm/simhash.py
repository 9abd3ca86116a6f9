"""SimHash near-copies: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most k bits share at least 8 - k of their 8 positional bytes. The index
lists distinct fingerprints under the bytes at several positions at once: the 8 positions are dealt into k + 2
blocks, of which two at least are untouched, so each fingerprint has one posting per pair of blocks. Inside a posting
the shared positional bytes of each pair are tallied, pairs with 8 - k or more stay, and their bits are compared.

Postings longer than ``crowd`` are refined, not cut: their fingerprints are listed again under every choice of 8 - k
positions. Such a posting leaves k bytes open, so it holds at most 256**k fingerprints, and partners are found by
flipping up to k of the open bits, in time linear in its length. Both ways give the same links.

Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows give
repeated result rows. A null id counts only where its whole component has none; its component is then null.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stayrate.llm.common import map_rows
from stayrate.llm.graph import components
from stayrate.session import cut

SEED = 42


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[:-1]]
    counts, total = np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    stops = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, total, 32_768):
        hashes = b"".join(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + 32_768], stops[at : at + 32_768])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``id_col``, ``keep`` and ``fp`` (long), one row per row of ``docs``."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, width) for text in texts], dtype="int64")

    return docs.select(id_col, *keep, of(F.col(text_col)).alias("fp"))


def _blocks(bits: int) -> list[list[int]]:
    return [list(block) for block in np.array_split(np.arange(8), bits + 2)]


def _mask(positions) -> int:
    value = sum(0xFF << (8 * int(p)) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(slot, key, fp): each fingerprint under its bytes at the positions of every mask."""
    keys = [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.slot", "p.key", "fp")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _pairs(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``bits`` bits, by tallying shared positional bytes and verifying."""
    bytes_ = values.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(values), len(values)), dtype=np.uint8)
    for position in range(8):
        column = bytes_[:, position]
        tally += column[:, None] == column[None, :]
    left, right = np.nonzero(np.triu(tally >= 8 - bits, 1))
    near = np.bitwise_count(values[left] ^ values[right]) <= bits
    return left[near], right[near]


def _flips(values: np.ndarray, open_mask: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for values that agree outside ``open_mask``, by flipping up to ``bits`` open bits."""
    values_sorted = np.argsort(values)
    ordered = values[values_sorted]
    free = [np.uint64(1 << b) for b in range(64) if open_mask >> b & 1]
    left, right = [], []
    for size in range(1, bits + 1):
        for chosen in combinations(free, size):
            partner = values ^ np.bitwise_or.reduce(np.array(chosen, dtype=np.uint64))
            at = np.minimum(np.searchsorted(ordered, partner), len(ordered) - 1)
            found = np.nonzero((ordered[at] == partner) & (values < partner))[0]
            left.append(found)
            right.append(values_sorted[at[found]])
    return np.concatenate(left), np.concatenate(right)


def _edges(members: DataFrame, bits: int, masks: list[int]) -> DataFrame:
    """Spanning links (a, b) of each posting's linked fingerprints; one array of fingerprints per posting."""

    def work(slots, lists):
        for slot, found in zip(slots, lists):
            values = np.unique(np.array(found, dtype=np.int64)).view(np.uint64)
            if len(values) <= 512:
                left, right = _pairs(values, bits)
            else:
                left, right = _flips(values, ~masks[slot] & (1 << 64) - 1, bits)
            if len(left):
                label = _forest(len(values), left, right)
                for i in np.nonzero(label != np.arange(len(values)))[0]:
                    yield int(values.view(np.int64)[i]), int(values.view(np.int64)[label[i]])

    lists = members.groupBy("slot", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return map_rows(lists.select("slot", "fps"), "a long, b long", work)


def links(fps: DataFrame, bits: int = 2, crowd: int = 512) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``bits`` bits; ``fps`` has one column ``fp``."""
    if not 0 <= bits <= 3 or crowd > 512:
        raise ValueError("bits up to 3, postings up to 512 before they are refined")
    if bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    coarse = [_mask(x + y) for x, y in combinations(_blocks(bits), 2)]
    fine = [_mask(chosen) for chosen in combinations(range(8), 8 - bits)]
    listed = _postings(fps, coarse)
    lengths = listed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(listed.join(lengths, ["slot", "key"]))
    short = shared.where(F.col("n") <= crowd)
    crowded = _postings(shared.where(F.col("n") > crowd).select("fp").distinct(), fine)
    return _edges(short, bits, coarse).union(_edges(crowded, bits, fine))


def near_copies(docs: DataFrame, width: int = 3, bits: int = 2, crowd: int = 512, id_col: str = "doc_id",
                text_col: str = "text", keep: tuple[str, ...] = (), roots: bool = False) -> DataFrame:
    """``id_col``, ``keep``, ``fp`` and ``component_id`` (smallest id reachable over links), one row per row of ``docs``;
    with ``roots`` also ``root``, the smallest fingerprint reachable."""
    marked = cut(fingerprints(docs, width, id_col, text_col, keep))
    first = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    linked = components(links(first.select("fp"), bits, crowd))
    labelled = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select(id_col, *keep, "fp", *["root"] * roots, "component_id")
