"""Text quality by a generalised additive model with pairwise interactions.

Numbers of a text (sizes, kinds of characters, repetition) are binned; cyclic boosting adds shallow trees over one
feature's bins, then over pairs of features, into lookup tables. A score is a sum of table entries.

The model is fitted on at most ``MOST_ROWS`` labelled rows, those with the smallest hashes; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.shared import free_held
from colsight.llm.words import U, chunks, grams, hashes, mix, split

MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.1, 1.0
REJECT_BELOW = 0.3
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "high", "distinct_words", "repeated_next", "distinct_3grams",
    "capital_words", "symbol_end", "bare_symbol", "log_lines", "words_per_line", "repeated_lines", "top_word", "sentence_end", "longest_word", "title_words",
]

# byte classes: 0 white space, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 newline, 6 beyond ASCII
CLASS = np.full(256, 4)
CLASS[[9, 11, 12, 13, 32]] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[10], CLASS[128:] = 1, 2, 3, 5, 6
SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])
SYMBOL = (CLASS == 4) & ~SENTENCE


def text_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null text counts as empty."""
    parts = [_features(offs, data) for _, offs, data in chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    rows = len(offs) - 1
    size = np.diff(offs)
    kind = np.bincount(np.repeat(np.arange(rows) * 8, size) + CLASS[data], minlength=8 * rows).reshape(rows, 8) if rows else np.zeros((0, 8))
    starts, ends, at = split(offs, data)
    word = hashes(data, starts, ends)
    n = np.diff(at)
    owner = np.repeat(np.arange(rows), n)
    length = ends - starts
    lower = np.concatenate(([0], np.cumsum(CLASS[data] == 1)))
    upper = np.concatenate(([0], np.cumsum(CLASS[data] == 2)))
    shouted = (lower[ends] == lower[starts]) & (upper[ends] > upper[starts]) & (length > 1)
    count = lambda mask: np.bincount(owner, mask, rows)
    last, first = data[ends - 1], data[starts]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    newlines = np.concatenate(([0], np.cumsum(data == 10)))
    line = newlines[starts] + owner
    opens = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(word) else np.zeros(0, np.int64)
    place = np.arange(len(word)) - np.repeat(opens, np.diff(np.append(opens, len(word))))
    line_hash = np.add.reduceat(mix(word + place.astype(U) * U(0x9E3779B97F4A7C15)), opens) if len(word) else word
    line_at = np.searchsorted(opens, at)
    run = grams(word, 3)
    varied = np.ones((rows, 4))
    for i, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), line_at[:-1].tolist(), line_at[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(word[a:b])
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            varied[i, 0] = len(edge) / (b - a)
            varied[i, 3] = np.diff(np.append(edge, b - a)).max() / (b - a)
            if b - a > 3:
                own = np.sort(run[a : b - 2])
                varied[i, 1] = (1 + np.count_nonzero(own[1:] != own[:-1])) / len(own)
            if d - c > 1:
                varied[i, 2] = len(set(line_hash[c:d].tolist())) / (d - c)
    total, words = np.maximum(size, 1), np.maximum(n, 1)
    lines = np.diff(line_at)
    return np.column_stack([
        np.log1p(size), np.log1p(n), size / words, kind[:, 2] / total, kind[:, 3] / total, kind[:, 4] / total, kind[:, 6] / total,
        varied[:, 0], count(same) / words, varied[:, 1], count(shouted) / words, count(SYMBOL[last] & (length > 1)) / words,
        count((length == 1) & (CLASS[first] == 4)) / words, np.log1p(lines), np.log1p(n / np.maximum(lines, 1)), 1 - varied[:, 2], varied[:, 3],
        count(SENTENCE[last]) / words, np.log1p(longest), count(CLASS[first] == 2) / words,
    ])


@dataclass
class Additive:
    """Bin edges and lookup tables; ``score`` is the chance of label 1."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], "right")]
        for i, j, left, right, table in self.pairs:
            total += table[np.searchsorted(left, x[:, i], "right"), np.searchsorted(right, x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: the best cuts of the bins into at most ``leaves`` runs."""
    cuts = [0, len(g)]
    sums_g, sums_h = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    for _ in range(leaves - 1):
        best, where = 1e-6, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                k = np.arange(a + 1, b)
                win = _gain(sums_g[k] - sums_g[a], sums_h[k] - sums_h[a]) + _gain(sums_g[b] - sums_g[k], sums_h[b] - sums_h[k]) - _gain(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a])
                if win.max() > best:
                    best, where = win.max(), k[win.argmax()]
        if where is None:
            break
        cuts = sorted([*cuts, int(where)])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + RIDGE)
    return step


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut of both axes of a grid: its gain, and the step of each cell."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sg, sh = pad(g), pad(h)
    inner = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    four = list(zip(inner(sg), inner(sh), strict=True))
    win = sum(_gain(a, b) for a, b in four)
    r, c = np.unravel_index(win.argmax(), win.shape)
    step = np.empty(g.shape)
    values = [a[r, c] / (b[r, c] + RIDGE) for a, b in four]
    step[: r + 1, : c + 1], step[: r + 1, c + 1 :], step[r + 1 :, : c + 1], step[r + 1 :, c + 1 :] = values
    return float(win.max() - _gain(sg[-1, -1], sh[-1, -1])), step


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of labels 0 and 1; without rows, or with one label only, it scores (a smoothed) share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Additive(start, [], [], [])
    total = np.full(len(y), start)
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slope()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            total += step[b]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    grid = lambda i, j, w: np.bincount(cell[i] * (len(coarse[j]) + 1) + cell[j], w, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, -1)
    g, h = slope()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quarters(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(ranked, grids, strict=True):
            g, h = slope()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[cell[i], cell[j]]
    return Additive(start, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(ranked, grids, strict=True)])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Additive:
    """The model of ``labels`` rows that are not held out. Null ids and labels are left out; repeated rows count again."""
    sample = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    sample = sample.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.record_batch([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["label", *FEATURES])

    rows = texts.mapInArrow(run, ", ".join(["label int", *(f"{f} double" for f in FEATURES)])).toPandas().to_numpy(np.float64)
    rows = rows[np.lexsort(rows.T)]
    return fit(rows[:, 1:], rows[:, 0])


def score_quality(docs: DataFrame, model: Additive, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null and empty texts are scored as empty ones. The new name must be free."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists already")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_held()
        for batch in batches:
            score = held.value.score(text_features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
