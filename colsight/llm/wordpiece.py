"""Counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie over bytes; each word ends in an end mark, a symbol of its own. A state's failure link says
where matching goes on after the longest pieces of its string are taken off, and a precomputed count says how many that
are, so a word's number of pieces falls out of one pass over it. All new words of a batch are passed together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.tokens import WordValues

END = 256
"""The end mark."""
SYMBOLS = 512


def _byte_of() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: themselves, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> set[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as tuples of bytes, the end mark being ``END``. Every single byte
    is a piece, with and without a word end, and so is the end mark, so that every word has pieces."""
    byte = _byte_of()
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    pieces = {(END,)} | {(b,) for b in range(256)} | {(b, END) for b in range(256)}
    for name in names:
        body, end = (name[:-4], (END,)) if name.endswith("</w>") else (name, ())
        if body and all(c in byte for c in body):
            pieces.add((*(byte[c] for c in body), *end))
    return pieces


class Automaton:
    """Trie edges sorted by (state, symbol); ``fail`` and ``popped`` of each state, -1 where no piece can be taken off."""

    def __init__(self, pieces: set[tuple[int, ...]]):
        nexts, final = [{}], [False]
        for piece in pieces:
            s = 0
            for c in piece:
                if c not in nexts[s]:
                    nexts[s][c] = len(nexts)
                    nexts.append({})
                    final.append(False)
                s = nexts[s][c]
            final[s] = True
        fail, popped = [-1] * len(nexts), [0] * len(nexts)
        order = [0]
        for s in order:
            for c, t in nexts[s].items():
                order.append(t)
                if final[t]:
                    fail[t], popped[t] = 0, int(s > 0 or c != END)  # an end mark left alone counts nothing
                    continue
                z, n = fail[s], popped[s]
                while z >= 0 and c not in nexts[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[t], popped[t] = nexts[z][c], n
        keys = [(s * SYMBOLS + c, t) for s, edges in enumerate(nexts) for c, t in edges.items()]
        keys.sort()
        self.keys, self.to = np.array([k for k, _ in keys], np.int64), np.array([t for _, t in keys], np.int32)
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self.root = np.full(SYMBOLS, -1, np.int32)
        for c, t in nexts[0].items():
            self.root[c] = t

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of greedy longest-match pieces of each word."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        state, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        live = np.argsort(-size, kind="stable")
        for i in range(int(size.max()) + 1 if len(words) else 0):
            live = live[size[live] >= i]
            symbol = np.full(len(live), END)
            inside = size[live] > i
            symbol[inside] = flat[first[live[inside]] + i]
            todo = np.arange(len(live))
            while len(todo):
                s = state[live[todo]]
                t = self._step(s, symbol[todo])
                went = t >= 0
                state[live[todo[went]]] = t[went]
                todo, s = todo[~went], s[~went]
                total[live[todo]] += self.popped[s]
                state[live[todo]] = self.fail[s]
        while (more := np.flatnonzero(state > 0)).size:
            total[more] += self.popped[state[more]]
            state[more] = self.fail[state[more]]
        return total


def count_pieces(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None, words: str = "n_words", pieces: str = "n_pieces") -> DataFrame:
    """``docs`` with the number of words (runs without ASCII white space, A-Z as a-z) and of their greedy pieces.

    Null and empty texts have 0 of both. The new names must be free; all other columns stay, row by row.
    """
    if taken := {words, pieces} & set(docs.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(vocabulary(path))
        lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        values = WordValues(lambda new: (automaton.counts([w.translate(lower) for w in new]), np.ones(len(new), np.int64)))
        for batch in batches:
            number = np.zeros((2, batch.num_rows), np.int64)
            for first, rows in values.rows(batch.column(at)):
                number[0, first : first + len(rows)] = [len(r) for r in rows]
                number[1, first : first + len(rows)] = [int(r.sum()) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number[0]), pa.array(number[1])], names=[*batch.schema.names, words, pieces])

    out = docs.withColumns({words: F.lit(0).cast("long"), pieces: F.lit(0).cast("long")}).schema
    return docs.mapInArrow(run, out)
