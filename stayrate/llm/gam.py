"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree on the bins of one feature (then of one pair
of features) to the current residuals and adds its leaves to that feature's lookup table. A score is the sum of one
table entry per feature and pair, put through the logistic function, for whole Arrow batches at a time.

The tables are fitted on the driver from at most ``sample_rows`` labelled rows (20,000 by default, those with the
smallest hash of the id): their features only, never their texts. All texts are scored.

Null and empty texts have all-zero features and are scored like any other. Without labelled rows every score is 0.5;
with labels of one kind the score tends to that label. Rows with a null label teach nothing; a document that is
labelled twice counts twice. Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FEATURES = (
    "log_words", "word_length", "longest_word", "upper_share", "all_upper_words", "digit_share", "mark_share",
    "stop_share", "exclaim_share", "bar_share", "blank_share", "other_byte_share", "distinct_words", "top_word",
    "repeated_next", "distinct_lines", "line_words", "mark_ends",
)
_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90), "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57), "blank": np.isin(_BYTES, [32, 9, 10, 11, 12, 13]), "high": _BYTES >= 128,
    "mark": np.isin(_BYTES, list(b"#$%&*+/<=>@\\^_`{}~|[]")), "stop": np.isin(_BYTES, list(b".,;:?")),
}
_CLASSES = np.stack([_CLASS[k] for k in _CLASS]).astype(np.int64)
_MARKS = frozenset(b"#$%&*+/<=>@\\^_`{}~|[]!")


def features(text: str | None) -> tuple[float, ...]:
    """Shape of a whole text, one number per name in FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit, blank, high, mark, stop = (_CLASSES @ counts).tolist()
    size, n = len(raw), len(words)
    lengths = [len(word) for word in words]
    often = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    inked = size - blank
    return (
        float(np.log1p(n)), inked / n, float(min(max(lengths), 1_000)), upper / max(1, upper + lower),
        sum(map(bytes.isupper, words)) / n, digit / inked, mark / inked, stop / n, int(counts[33]) / n,
        int(counts[124]) / n, blank / size, high / size, len(often) / n, max(often.values()) / n,
        sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), n / len(lines),
        sum(word[-1] in _MARKS for word in words) / n,
    )


class Additive:
    """Lookup tables over binned features and pairs of them."""

    def __init__(self, edges: list[np.ndarray], base: float, single: list[np.ndarray],
                 pairs: dict[tuple[int, int], np.ndarray]):
        self.edges, self.base, self.single, self.pairs = edges, base, single, pairs

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(edge, x[:, j], side="right") for j, edge in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            total += table[bins[j]]
        for (i, j), table in self.pairs.items():
            total += table[bins[i], bins[j]]
        return 1.0 / (1.0 + np.exp(-total))


def _split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int]:
    """Best cut of a row of bins and its gain; cut 0 means none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Leaf value per bin of a tree with ``depth`` levels over one feature."""
    _, at = _split(g, h, smooth) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + smooth))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1, smooth), _tree(g[at:], h[at:], depth - 1, smooth)))


def _cross(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one feature and then, on either side, the other."""
    best, values = 0.0, np.full(g.shape, g.sum() / (h.sum() + smooth))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        first, at = _split(a.sum(axis=1), b.sum(axis=1), smooth)
        at = at or a.shape[0] // 2
        leaves, gain = np.empty(a.shape), first
        for part in (slice(0, at), slice(at, None)):
            rows_g, rows_h = a[part].sum(axis=0), b[part].sum(axis=0)
            more, _ = _split(rows_g, rows_h, smooth)
            gain += more
            leaves[part] = _tree(rows_g, rows_h, 1, smooth)
        if gain > best:
            best, values = gain, leaves.T if flip else leaves
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, n_bins: int = 32,
        rate: float = 0.1, smooth: float = 2.0) -> Additive:
    """Cyclic boosting of depth-2 trees, feature by feature, then of the pairs that explain most of what is left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0)
             for j in range(len(FEATURES))]
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Additive(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], {})
    if not len(y):
        return model
    bins, total = model.bins(x), np.full(len(y), model.base)

    def residuals():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def summed(flat, g, h, shape):
        size = int(np.prod(shape))
        return (np.bincount(flat, weights=w, minlength=size).reshape(shape) for w in (g, h))

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            step = rate * _tree(*summed(bins[j], *residuals(), table.shape), 2, smooth)
            table += step
            total += step[bins[j]]
    flat = {(i, j): bins[i] * len(model.single[j]) + bins[j] for i, j in combinations(range(len(edges)), 2)}
    shape = {(i, j): (len(model.single[i]), len(model.single[j])) for i, j in flat}
    gains = {ij: _cross(*summed(flat[ij], *residuals(), shape[ij]), smooth)[0] for ij in flat}
    chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:n_pairs]
    model.pairs.update({ij: np.zeros(shape[ij]) for ij in chosen})
    for _ in range(pair_rounds):
        for ij in chosen:
            step = rate * _cross(*summed(flat[ij], *residuals(), shape[ij]), smooth)[1]
            model.pairs[ij] += step
            total += step.ravel()[flat[ij]]
    return model


def _mapped(docs: DataFrame, keep: tuple[str | Column, ...], text_col: str, names: tuple[str, ...], compute) -> DataFrame:
    """``keep`` plus the columns that ``compute(features of a batch)`` returns."""
    kept = docs.select(*keep)
    n, extra = len(kept.columns), [StructField(name, DoubleType()) for name in names]
    schema = StructType([*kept.schema, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(n).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, compute(x))], schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 20_000,
          id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on at most ``sample_rows`` rows of ``labels`` (id, 0/1) that have a document."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = usable.select(id_col, F.col(label_col).alias("_label")).orderBy(
        F.xxhash64(id_col), id_col, "_label").limit(sample_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    found = _mapped(rows, (id_col, "_label"), text_col, FEATURES, lambda x: x.T).toPandas()
    found = found.sort_values([id_col, "_label", *FEATURES])
    return fit(found[list(FEATURES)].to_numpy(dtype=np.float64), found["_label"].to_numpy(dtype=np.float64))


def scores(docs: DataFrame, model: Additive, keep: tuple[str | Column, ...] = ("doc_id",), text_col: str = "text",
           name: str = "score") -> DataFrame:
    """``keep`` plus ``score`` (0 to 1) for every row."""
    return _mapped(docs, keep, text_col, (name,), lambda x: (model.score(x),))
