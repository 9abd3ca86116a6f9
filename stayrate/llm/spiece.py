"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once and keeps, for each position, the last piece of the best segmentation that ends there.
An automaton over the vocabulary names the pieces that end at each position. Only positions within the longest piece
can start a later piece, so whenever the back pointers of all of these meet at one boundary, the ids up to it are final
and leave the window. Two rules say which segmentation is best:

* ``unigram``: the largest sum of piece scores;
* ``bpe``: the one that merging by score yields. A sequence of pieces is that one exactly if merging keeps every
  adjacent pair of its pieces as it is (a merge across a boundary would already happen in the pair alone), so each
  position has one admissible back pointer.

Between two letters that stand together in no piece of the vocabulary every path has a boundary; stretches between such
places are searched on their own and remembered, up to ``MEMORY`` words and as many parts of words per worker.

Null texts have null ids, and null ids decode to null; empty texts have no ids. Unknown letters become byte pieces
(or the unknown id, if the vocabulary has no bytes). A text that holds the blank mark itself (U+2581) decodes with a
blank in its place, as the format has it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import compress, pairwise
from operator import add, not_

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BLANK = "▁"
START = -(1 << 30)
MEMORY = 150_000
#: The letters of one byte, blanks marked.
LETTERS = [chr(i).replace(" ", BLANK) for i in range(128)]
#: Bytes of text that are cut and gathered at once.
PORTION = 2 << 20


class Pieces:
    """A vocabulary and its search; made on the driver from a published model file and sent to the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], byte_ids: list[int], unknown: int,
                 rule: str = "bpe", dummy_prefix: bool = True):
        if rule not in ("bpe", "unigram"):
            raise ValueError(f"no such rule: {rule}")
        self.pieces, self.rule, self.unknown, self.byte_ids, self.dummy = pieces, rule, unknown, byte_ids, dummy_prefix
        self.scores = {p: s for p, s, ok in zip(pieces, scores, plain) if ok}
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        self.value = {i: b for b, i in enumerate(byte_ids)}
        self.inside = {a + b for p in self.ids for a, b in pairwise(p)}
        crossed = any(pair[1] == BLANK != pair[0] for pair in self.inside)
        # by two bytes of UTF-8 with plain blanks: both are letters, and these stand together in no piece
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = [[a + b not in self.inside for b in LETTERS] for a in LETTERS]
        self.apart = self.apart.ravel()
        self.whole = crossed
        self.stretch = re.compile(r"(?s).+" if crossed else f"(?s){BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.of_id = dict(zip(self.ids.values(), self.scores.values()))
        self.found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.keeps: dict[int, dict[int, bool]] = {}  # by piece before, by piece
        self.kept = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.checked: dict[bytes, tuple[tuple[int, ...], bool]] = {}
        self.before: dict[bytes, tuple[tuple[int, ...], bool]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str, rule: str = "bpe") -> Pieces:
        """Read a published model file; its normalisation must be the identity but for blank marks."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in every]
        byte_ids = [i for i in every if model.is_byte(i)]
        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every],
                   [not s for s in special], byte_ids, model.unk_id(), rule,
                   model.encode("a", out_type=str)[0].startswith(BLANK))

    # -------------------------------------------------------------- the search
    def merge(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, leftmost first, until none is in the vocabulary."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                score = scores.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _admits(self, before: int, piece: int) -> bool:
        """Whether merging keeps the piece as it is after the one before it (START: at the start of a stretch)."""
        end = self._text(piece)
        parts = [end] if before == START else [self._text(before), end]
        kept = self.merge("".join(parts)) == parts
        if self.kept >= 2 * MEMORY:
            self.keeps.clear()
            self.kept = 0
        self.kept += 1
        self._kept_after(before)[piece] = kept
        return kept

    def _kept_after(self, before: int) -> dict[int, bool]:
        """What is known of the pieces that may follow this one."""
        found = self.keeps.get(before)
        if found is None:
            found = self.keeps[before] = {}
        return found

    def _text(self, code: int) -> str:
        return self.pieces[code] if code >= 0 else chr(-code)

    def segments(self, text: str) -> Iterator[int]:
        """Pieces of one stretch, sent on as soon as they are final: ids, or a letter without a piece as -ord."""
        longest, bpe, scores, floor = self.longest, self.rule == "bpe", self.of_id, self.floor
        base, back, last, best = 0, [0], [START], [0.0]
        open_at, start, code, top = 0, -1, 0, 0.0  # the position being filled, and the best way there so far

        def fill() -> None:
            """Close the open position; a letter that no piece ends at stands alone."""
            nonlocal open_at, start, code, top
            alone = self.ids.get(text[open_at])
            if start < 0 or not bpe and alone is None and best[open_at - base] + floor > top:
                start, code, top = open_at, -ord(text[open_at]), best[open_at - base] + floor
            back.append(start)
            last.append(code)
            best.append(top)
            open_at, start = open_at + 1, -1

        for place, (size, piece) in self.found.iter(text):
            while open_at < place:
                fill()
                if open_at - base >= 4 * longest and (met := self._meeting(back, base, open_at)) > base:
                    yield from self._trace(last, back, base, met)
                    done = met - base
                    back, last, best, base = back[done:], last[done:], best[done:], met
            at = place + 1 - size
            if bpe:
                if start < 0:
                    before = last[at - base]
                    kept = self._kept_after(before).get(piece)
                    if kept or kept is None and self._admits(before, piece):
                        start, code = at, piece
            else:
                total = best[at - base] + scores[piece]
                if start < 0 or total > top:
                    start, code, top = at, piece, total
        while open_at < len(text):
            fill()
        yield from self._trace(last, back, base, len(text))

    def _meeting(self, back: list[int], base: int, end: int) -> int:
        """Where the paths of all positions that can start a later piece meet."""
        live = set(range(max(base, end - self.longest + 1), end + 1))
        while len(live) > 1:
            furthest = max(live)
            live.remove(furthest)
            live.add(back[furthest - base])
        return live.pop()

    @staticmethod
    def _trace(last: list[int], back: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = back[end - base]
        return out[::-1]

    # -------------------------------------------------------------- whole texts
    def _ids(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch, part by part between letters that stand together in no piece."""
        if not stretch:
            return ()
        out, start = [], 0
        together = map(self.inside.__contains__, map(add, stretch, stretch[1:]))
        for end in [*compress(range(1, len(stretch)), map(not_, together)), len(stretch)]:
            ids = self._part(stretch[start:end])
            if end - start == len(stretch):
                return ids
            out.extend(ids)
            start = end
        return tuple(out)

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._searched(part)
            self._remember(self.parts, part, ids)
        return ids

    @staticmethod
    def _remember(memory: dict[str, tuple[int, ...]], stretch: str, ids: tuple[int, ...]) -> None:
        if len(stretch) <= 64:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[stretch] = ids

    def _short(self, text: str) -> list[int]:
        """What ``segments`` gives by the rule ``bpe``, for a text that fits into its window: no bounds, no scores."""
        admits, after = self._admits, self._kept_after
        last: list = [START] + [None] * len(text)  # None: no piece ends here, a letter stands alone
        back = [0] * (len(text) + 1)
        follow = [after(START)] + [None] * len(text)  # what is known of the pieces after the one that ends here
        for place, (size, piece) in self.found.iter(text):
            end = place + 1
            if last[end] is None:
                start = end - size
                known = follow[start]
                if known is None:
                    before = last[start]
                    known = follow[start] = after(-ord(text[start - 1]) if before is None else before)
                kept = known.get(piece)
                if kept is None:
                    before = last[start]
                    kept = admits(-ord(text[start - 1]) if before is None else before, piece)
                if kept:
                    last[end], back[end] = piece, start
        out, end = [], len(text)
        while end:
            code = last[end]
            if code is None:
                end -= 1
                out.append(-ord(text[end]))
            else:
                out.append(code)
                end = back[end]
        out.reverse()
        return out

    def _searched(self, stretch: str) -> tuple[int, ...]:
        short = self.rule == "bpe" and len(stretch) <= 4 * self.longest
        codes = self._short(stretch) if short else self.segments(stretch)
        if short and min(codes) >= 0:
            return tuple(codes)
        out: list[int] = []
        for code in codes:
            if code >= 0:
                out.append(code)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(-code).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> array:
        marked = (" " + text if self.dummy and text else text).replace(" ", BLANK)
        out, known = array("i"), self.known
        for match in self.stretch.finditer(marked):
            stretch = match.group()
            ids = known.get(stretch)
            if ids is None:
                ids = self._ids(stretch)
                self._remember(known, stretch, ids)
            out.extend(ids)
        return out

    def stretch_ids(self, raw: bytes) -> tuple[tuple[int, ...], bool]:
        """Ids of a stretch of UTF-8 with plain blanks, and whether they decode to it; remembered."""
        found = self.checked.get(raw)
        if found is None:
            found = self.before.get(raw)  # what was asked for lately outlives what was not
            if found is None:
                text = raw.decode()
                part = text.replace(" ", BLANK)
                ids = self._part(part) if raw.isascii() else self._ids(part)  # letters of one byte are cut already
                found = ids, self._plain(ids) == text
            if len(raw) <= 64:
                if len(self.checked) >= MEMORY // 2:
                    self.before, self.checked = self.checked, {}
                self.checked[raw] = found
        return found

    def decode(self, ids) -> str:
        """Text of ids; a run of byte pieces is read as UTF-8, what is not UTF-8 becomes U+FFFD. Ids outside fail."""
        text = self._plain(ids)
        return text[1:] if self.dummy and text.startswith(" ") else text

    def _plain(self, ids) -> str:
        value, pieces = self.value, self.pieces
        if not self.byte_ids or value.keys().isdisjoint(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in value:
                    run.append(value[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(pieces[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        return text.replace(BLANK, " ")


def encode(docs: DataFrame, model: Pieces, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` plus ``ids`` (array of int, null for a null text) and ``n_ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        pieces = shared.value
        return pd.Series([None if t is None else memoryview(pieces.encode(t)).tolist() for t in texts], dtype=object)

    named = docs.select(*keep, ids_of(F.col(text_col)).alias("ids"))
    return named.withColumn("n_ids", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long"))


def decode(tokens: DataFrame, model: Pieces, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` plus the text of its ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("string")
    def text_of(lists: pd.Series) -> pd.Series:
        pieces = shared.value
        return pd.Series([None if ids is None else pieces.decode(list(ids)) for ids in lists], dtype=object)

    return tokens.withColumn(into, text_of(F.col(ids_col)))


def round_trips(docs: DataFrame, model: Pieces, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` plus ``ids``, ``n_ids`` and ``exact``: whether decoding gives the text back; one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.select(*keep).schema]
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType())), StructField("n_ids", LongType()),
                         StructField("exact", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for whole in batches:
            for batch in _portions(whole, len(fields)):
                ids, sizes, exact = encoded(pieces, batch.column(len(fields)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], ids, sizes, exact], [f.name for f in schema])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about PORTION bytes of text; a longer text has one of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // PORTION
    starts = np.nonzero(np.diff(part, prepend=-1))[0].tolist()
    for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, stop - start)


def encoded(pieces: Pieces, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, their number, and whether decoding gives the text back, of a batch of texts.

    The stretches of all texts are cut on the bytes of the batch, at blanks and between letters of one byte that stand
    together in no piece, and encoded as a dictionary: each distinct stretch is searched and decoded once, and the texts'
    ids are gathered by stretch number. A text decodes to what its stretches decode to, as none ends inside a letter's
    bytes.
    """
    texts = texts.cast(pa.large_string())
    none = texts.is_null().to_numpy(zero_copy_only=False)
    plain = texts.fill_null("")
    if pieces.whole or pc.any(pc.match_substring(plain, BLANK)).as_py():
        return _one_by_one(pieces, texts)
    empty, blank = (pa.scalar(t, pa.large_string()) for t in ("", " "))
    marked = plain
    if pieces.dummy:
        marked = pc.if_else(pc.equal(plain, empty), empty, pc.binary_join_element_wise(blank, plain, empty))
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset: marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    first = data == 32
    first[1:] &= ~first[:-1].copy()
    first[1:] |= pieces.apart.take((data[:-1].astype(np.uint16) << 8) | data[1:])
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.nonzero(first)[0]
    ends = np.append(starts, len(data)).astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    stretches = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    number = stretches.indices.to_numpy()
    flat, upto, exact = array("i"), [0], []
    for raw in stretches.dictionary.to_pylist():
        ids, same = pieces.stretch_ids(raw)
        flat.extend(ids)
        upto.append(len(flat))
        exact.append(same)
    known, upto, exact = np.array(flat, np.int32), np.array(upto), np.array(exact, bool)
    sizes = (upto[1:] - upto[:-1])[number]
    ends_of_ids = np.append(0, np.cumsum(sizes))
    gather = np.repeat(upto[:-1][number] - ends_of_ids[:-1], sizes) + np.arange(ends_of_ids[-1])
    stretch_at = np.searchsorted(starts, offsets)  # the first stretch of each text
    wrong = np.append(0, np.cumsum(~exact[number]))
    at = ends_of_ids[stretch_at]
    good = wrong[stretch_at[1:]] == wrong[stretch_at[:-1]]
    places = pa.array(at.astype(np.int32), mask=np.append(none, False) if none.any() else None)
    lists = pa.ListArray.from_arrays(places, pa.array(known[gather]))
    return lists, pa.array(np.diff(at), mask=none), pa.array(good, mask=none)


def _one_by_one(pieces: Pieces, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The same text by text, for texts that hold the blank mark, and vocabularies with blanks inside pieces."""
    every = [(None, None) if t is None else (pieces.encode(t), t) for t in texts.to_pylist()]
    return (pa.array([None if ids is None else memoryview(ids).tolist() for ids, _ in every], pa.list_(pa.int32())),
            pa.array([None if ids is None else len(ids) for ids, _ in every], pa.int64()),
            pa.array([None if ids is None else pieces.decode(ids) == t for ids, t in every], pa.bool_()))
