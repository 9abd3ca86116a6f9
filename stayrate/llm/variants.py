"""Spelling variants of a corpus vocabulary by Bloom-guided edit neighbourhoods.

Words are counted over whole texts. For every word all strings at one edit are probed, by their hashes alone, against
blocked Bloom filters of the vocabulary, one family of filters per word length; a blocked filter keeps all bits of a
word in one 64-bit block. Only strings that a filter lets through are written out and shuffled, to a join with the
vocabulary that removes the false positives. Being near is symmetric, so replacements are tried by larger code points
only, and insertions are found as the other word's deletions.

Filters are built where the words are, 65,536 words to a segment at most (but for the spread of the hash), and
broadcast in passes of ``PASS_BYTES``: a larger vocabulary takes more passes, at the same bits per word. Nothing is
collected but the segments of one pass, the number of words per length, and the letters that occur (90 at most).

A null id counts as the empty text; null and empty texts have no words; repeated rows count each; an empty table gives
no rows. Long words are handled like any other, in blocks of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_rows
from stayrate.session import cut

#: Words of a text: maximal runs of these after lower-casing A-Z.
LETTER = "a-zÀ-ÿ"
#: Blocks of 64 bits in a segment, words a block on average (16 bits a word), bits a word sets in its block.
SEGMENT_BLOCKS, BLOCK_WORDS, WORD_BITS = 1 << 14, 4, 4
#: Filters that are broadcast at once.
PASS_BYTES = 64 << 20
#: Edits hashed at once in a task, and distinct words counted there before they are sent on.
EDITS, HELD_WORDS = 1 << 20, 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slipped(run: str, seed: int, slips: int | None) -> str:
    """The run, less one code point where its CRC continues ``seed`` to a multiple of ``slips``."""
    if not slips:
        return run
    h = zlib.crc32(run.encode(), seed)
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, slips: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``least_chars`` code points or more that occur ``least_n`` times or more.

    With ``slips`` a run loses a code point where the CRC of ``id:run`` is a multiple of it, in all its places in the
    document: planted misspellings.
    """
    run = re.compile(f"[{LETTER}]{{{least_chars},}}")  # shorter runs can only get shorter

    def count(ids, texts):
        held: Counter[str] = Counter()
        for key, text in zip(ids, texts):
            seed = zlib.crc32(f"{'' if key is None else key}:".encode())
            lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            for found, n in Counter(run.findall(lowered)).items():
                word = slipped(found, seed, slips)
                if len(word) >= least_chars:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield from held.items()
                held = Counter()
        yield from held.items()

    counted = map_rows(docs.select(F.col(id_col).cast("string"), text_col), "word string, n long", count)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One random number per code point; a word's hash is their sum by powers of the base, so that an edit changes one term.
_LETTERS = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE)]))[:n]


def _terms(codes: np.ndarray) -> np.ndarray:
    return _LETTERS[codes] * _powers(codes.shape[1])


def _places(h: np.ndarray, segments: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, block and bits of word hashes; ``blocks`` is a power of two."""
    m = _mixed(h)
    segment = ((m >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    block = m & np.uint64(blocks - 1)
    bits, rest = np.zeros(len(m), np.uint64), _mixed(m ^ _BASE)
    for i in range(WORD_BITS):
        bits |= np.uint64(1) << ((rest >> np.uint64(6 * i)) & np.uint64(63))
    return segment.astype(np.int64), block.astype(np.int64), bits


def _shape(words: int) -> tuple[int, int]:
    """Segments and blocks per segment for so many words of one length."""
    segments = -(-words // (SEGMENT_BLOCKS * BLOCK_WORDS))
    needed = -(-words // (segments * BLOCK_WORDS))
    return segments, 1 << max(4, (needed - 1).bit_length())


def _coded(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions in the list, code points as a matrix), by length; every letter is below 256."""
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word)].append(i)
    for length, at in by_length.items():
        flat = "".join([words[i] for i in at]).encode("latin-1")
        yield length, np.array(at), np.frombuffer(flat, dtype=np.uint8).reshape(-1, length)


def filters(words: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(chars, segment, blob): the filter segments of all words; the blob holds 64-bit blocks."""

    def place(found):
        for length, at, codes in _coded(found):
            segment, _, _ = _places(_terms(codes).sum(axis=1), *shapes[length])
            for i, s in zip(at, segment):
                yield length, int(s), found[i]

    def build(part: pd.DataFrame) -> pd.DataFrame:
        length = int(part["chars"].iloc[0])
        blocks = shapes[length][1]
        filled = np.zeros(blocks, np.uint64)
        for _, _, codes in _coded(list(part["word"])):
            _, block, bits = _places(_terms(codes).sum(axis=1), *shapes[length])
            np.bitwise_or.at(filled, block, bits)
        return pd.DataFrame({"chars": [length], "segment": [int(part["segment"].iloc[0])], "blob": [filled.tobytes()]})

    placed = map_rows(words.select("word"), "chars int, segment int, word string", place)
    return placed.groupBy("chars", "segment").applyInPandas(build, "chars int, segment int, blob binary")


class _Pass:
    """Filter segments of one pass, flat; a segment of another pass is a run of zeros."""

    def __init__(self, shapes: dict[int, tuple[int, int]], segments: list[tuple[int, int, bytes]]):
        self.shapes = shapes
        self.start = {length: np.zeros(n, np.int64) for length, (n, _) in shapes.items()}
        parts, upto = [np.zeros(SEGMENT_BLOCKS, np.uint64)], SEGMENT_BLOCKS
        for length, segment, blob in segments:
            part = np.frombuffer(blob, np.uint64)
            self.start[length][segment] = upto
            parts.append(part)
            upto += len(part)
        self.flat = np.concatenate(parts)
        self.lengths = {length for length, _, _ in segments}

    def hits(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be words of that length."""
        if length not in self.lengths:
            return np.zeros(0, np.int64)
        segment, block, bits = _places(hashes, *self.shapes[length])
        return np.nonzero((self.flat[self.start[length][segment] + block] & bits) == bits)[0]


def _probed(words: list[str], known: _Pass, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """(position of a word, string at one edit) for all edits that the filters let through."""
    for length, at, codes in _coded(words):
        step = max(1, EDITS // (length * len(letters)))
        for first in range(0, len(at), step):
            some, own = codes[first:first + step], at[first:first + step]
            terms = _terms(some)
            whole = terms.sum(axis=1)
            # replacements by larger letters
            row, place, letter = np.nonzero(letters[None, None, :] > some[:, :, None])
            new = letters[letter]
            changed = whole[row] + (_LETTERS[new] - _LETTERS[some[row, place]]) * _powers(length)[place]
            for i in known.hits(length, changed):
                word, p = words[own[row[i]]], place[i]
                yield own[row[i]], word[:p] + chr(new[i]) + word[p + 1:]
            # deletions; of a run of one letter, only the first
            before = np.cumsum(terms, axis=1) - terms
            row, place = np.nonzero(np.concatenate(
                [np.ones((len(some), 1), bool), some[:, 1:] != some[:, :-1]], axis=1))
            left = before[row, place]
            shorter = left + (whole[row] - left - terms[row, place]) * _BASE_INVERSE
            for i in known.hits(length - 1, shorter):
                word, p = words[own[row[i]]], place[i]
                yield own[row[i]], word[:p] + word[p + 1:]


def near_words(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, other, other_n): all pairs of distinct words that differ by one edit, in both directions.

    ``words`` has one row (word, n) per word and must be stored, as it is read several times.
    """
    spark = words.sparkSession
    lengths = words.groupBy(F.length("word").alias("chars")).agg(F.count("*").alias("n")).collect()
    shapes = {r["chars"]: _shape(r["n"]) for r in lengths}
    letters = np.array(sorted(ord(r[0]) for r in words.select(
        F.explode(F.split("word", ""))).distinct().where("col <> ''").collect()), dtype=np.uint8)
    built = cut(filters(words, shapes))
    passes, room = [[]], pass_bytes
    for length, (segments, blocks) in sorted(shapes.items()):
        for segment in range(segments):
            if passes[-1] and room < 8 * blocks:
                passes.append([])
                room = pass_bytes
            passes[-1].append((length, segment))
            room -= 8 * blocks
    listed = spark.createDataFrame([(i, *s) for i, p in enumerate(passes) for s in p], "pass int, chars int, segment int")
    dealt, possible = cut(built.join(listed, ["chars", "segment"])), None
    for i in range(len(passes)):
        segments = dealt.where(F.col("pass") == i).select("chars", "segment", "blob").collect()
        known = spark.sparkContext.broadcast(_Pass(shapes, [tuple(s) for s in segments]))

        def probe(found, ns, known=known):
            for at, other in _probed(found, known.value, letters):
                yield found[at], ns[at], other

        part = map_rows(words.select("word", "n"), "word string, n long, other string", probe)
        possible = part if possible is None else possible.union(part)
    real = possible.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    return real.select(F.explode(F.array(
        F.struct("word", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form), following forms to the last; a form occurs more often, so none returns.

    Every round doubles the steps taken.
    """
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def grouped(docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, slips: int | None = None,
            id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary.

    The form is the near word that occurs most (ties: first in code-point order), where it occurs ``ratio`` times as
    often as the word or more; the root is the last form of forms, the word itself where it has no form.
    """
    words = cut(vocabulary(docs, least_chars, least_n, slips, id_col, text_col))
    near = near_words(words, pass_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("most"))
    often = -F.col("most.less")
    chosen = often >= F.lit(ratio) * F.col("n")
    named = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("most.other")).alias("form"), F.when(chosen, often).alias("form_n")))
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
