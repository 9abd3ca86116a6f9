"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded with a blank) of a
language, most frequent first. A document is ranked the same way, and each of its n-grams pays the difference between
its two ranks, or the profile length where the profile lacks it. The language with the smallest sum wins; ties go to
the smaller language name by code point.

Profiles count every n-gram of every training text: tasks add up counts per language, Spark adds up the tasks. Only
the profiles themselves (``size`` n-grams per language) reach the driver.

Null texts and texts without a letter get ``und`` and score 0. Rows with a null language or null text teach nothing.
No training row at all: every text gets ``und``. Repeated rows count as often as they occur, also in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

UNKNOWN = "und"
PIECE = 1 << 20
BLANK = ord(" ")
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, with one blank around every run of letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points], points, BLANK).astype(np.int64)
    points = np.concatenate(([BLANK], points, [BLANK]))
    return points[np.append(True, (points[1:] != BLANK) | (points[:-1] != BLANK))]


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text as numbers (21 bits a letter), and their counts."""
    grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = _codes(text)
    for at in range(0, len(codes) - 2, PIECE):
        c = codes[at : at + PIECE + 2]
        before, letter, after = c[:-2], c[1:-1], c[2:]
        is_letter = letter != BLANK
        pairs = (before << 21) | letter
        if at + PIECE + 2 >= len(codes):
            pairs = np.append(pairs, (letter[-1] << 21) | after[-1])
        three = ((before << 42) | (letter << 21) | after)[is_letter]
        found, n = np.unique(np.concatenate((letter[is_letter], pairs, three)), return_counts=True)
        grams, counts = _added(np.concatenate((grams, found)), np.concatenate((counts, n)))
    return grams, counts


def _added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(grams, return_inverse=True)
    return found, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller number."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kept = counts >= least
        grams, counts = grams[kept], counts[kept]
    return grams[np.lexsort((grams, -counts))][:size]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) per batch; texts of one language are counted together."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for start in range(0, len(texts), 500):
                grams, counts = _grams("\n".join(texts[start : start + 500]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, size: int = 400, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank from 0) of every language, from all rows of ``docs`` that have a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(lang_col, text_col)
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select(
        "lang", "gram", "rank")


class Ranks:
    """Profiles as one sorted table: for an n-gram its rank in every language, or the profile length."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], dtype=np.int64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), size, dtype=np.int64)
        place = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.grams, gram), place[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = _grams(text) if text else (np.zeros(0, dtype=np.int64),) * 2
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        ranked = _top(grams, counts, self.size)
        at = np.searchsorted(self.grams, ranked)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != ranked] = len(self.grams)
        known = self.rank[at]
        out = np.where(known < self.size, np.abs(known - np.arange(len(ranked))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(ranked))


def identify(docs: DataFrame, learned: DataFrame, size: int = 400, text_col: str = "text",
             keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score`` (1: all n-grams at their profile rank, 0: none in the profile).

    ``learned`` is the output of ``profiles``: at most ``size`` rows per language, gathered on the driver.
    """
    ranks = Ranks([(r["lang"], r["gram"], r["rank"]) for r in learned.collect()], size)

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ranks.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = docs.select(*keep).columns
    found = docs.select(*keep, predict(F.col(text_col)).alias("_predicted"))
    return found.select(*kept, "_predicted.lang_pred", "_predicted.score")
