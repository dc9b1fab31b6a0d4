"""Byte-level BPE: texts to token ids with the byte range of every token, and back to bytes.

Pre-tokens are found by the scan of ``pretokens``. Each distinct one of a task is merged once, many in one vectorised
run, and kept; long ones are merged over a heap. Nothing is trained: the ranks come from a public vocabulary file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from colsight.llm.pretokens import code_point_classes, pretokens
from colsight.llm.shared import held_by_worker
from colsight.llm.tokens import CASED, WordValues
from colsight.llm.words import chunks, hashes

LONG_SLICE = 48
"""Pre-tokens of more bytes are merged one by one over a heap, whose time is near linear in their length."""
NONE = np.int64(1 << 40)


class Ranks:
    """The ranks of a vocabulary file, all pairs of tokens that merge, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        size = max(self.rank.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.rank.items():
            pieces[rank] = piece
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.pair = {}
        for piece, rank in self.rank.items():
            for k in range(1, len(piece)):
                a, b = self.rank.get(piece[:k]), self.rank.get(piece[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = rank
        self.keys = np.array(sorted(self.pair), np.int64)
        self.ranks = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, NONE where they do not merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _heap(self, piece: bytes) -> list[int]:
        tokens = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tokens)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        pair = self.pair.get
        waiting = [(r, i) for i in range(n - 1) if (r := pair(tokens[i] << 20 | tokens[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            if tokens[i] < 0 or (j := after[i]) < 0 or pair(tokens[i] << 20 | tokens[j]) != rank:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pair(rank << 20 | tokens[after[i]])) is not None:
                    heapq.heappush(waiting, (r, i))
            if before[i] >= 0 and (r := pair(tokens[before[i]] << 20 | rank)) is not None:
                heapq.heappush(waiting, (r, before[i]))
        return [t for t in tokens if t >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each has. In each round every piece merges the leftmost of its pairs
        of lowest rank; pieces without a pair leave."""
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for i in np.flatnonzero((whole < 0) & (size > LONG_SLICE)).tolist():
            ids = self._heap(pieces[i])
            done.append((np.full(len(ids), i), np.array(ids, np.int64)))
        short = np.flatnonzero((whole < 0) & (size <= LONG_SLICE))
        token = self.single[np.frombuffer(b"".join(pieces[i] for i in short.tolist()), np.uint8)]
        piece = np.repeat(short, size[short])
        rank = np.full(len(token), NONE)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self.of_pairs(token[inside], token[inside + 1])
        while len(token):
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(first, append=len(token)))
            if (ready := least == NONE).any():
                done.append((piece[ready], token[ready]))
                token, piece, rank = token[~ready], piece[~ready], rank[~ready]
                continue
            at = np.flatnonzero(rank == least)
            at = at[np.diff(piece[at], prepend=-1) != 0]
            token[at] = least[at]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))
            token, piece, rank = token[stays], piece[stays], rank[stays]
            rank[at] = NONE
            for here in (at[at + 1 < len(token)], at[at > 0] - 1):
                here = here[piece[here] == piece[here + 1]]
                rank[here] = self.of_pairs(token[here], token[here + 1])
        piece, token = (np.concatenate(x) for x in zip(*done, strict=True))
        return token[np.argsort(piece, kind="stable")].astype(np.int32), np.bincount(piece, minlength=len(pieces))


_HELD: dict[str, tuple[Ranks, WordValues]] = held_by_worker({})


def held(path: str) -> tuple[Ranks, WordValues]:
    """The vocabulary at a path and the merged pre-tokens; a Python worker keeps them from task to task."""
    if path not in _HELD:
        vocabulary = Ranks(path)
        _HELD[path] = vocabulary, WordValues(vocabulary.merge)
    return _HELD[path]


def encode_column(column: pa.Array, vocabulary: Ranks, memory: WordValues, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, where each row's ids begin, one more than rows; ids; byte length of each id) for runs of rows."""
    for first, offs, data in chunks(column):
        starts, ends, at = pretokens(offs, data, table)
        if not len(starts):
            yield first, np.zeros(len(offs), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
            continue
        codes, slices = pd.factorize(hashes(data, starts, ends, CASED))
        until, ids = memory.gather(codes, slices, data, starts, ends)
        yield first, until[at], ids, vocabulary.length[ids]


def decode_ids(ids: np.ndarray, vocabulary: Ranks) -> np.ndarray:
    """The bytes of all ids in a row."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.length)):
        raise ValueError("an id is not in the vocabulary")
    size = vocabulary.length[ids]
    until = np.cumsum(size)
    total = int(until[-1]) if len(until) else 0
    return vocabulary.bytes[np.arange(total) + np.repeat(vocabulary.begin[ids] - until + size, size)]


def _list(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    vocabulary, memory = held(path)
    for batch in batches:
        for first, at, ids, size in encode_column(batch.column(1), vocabulary, memory, table):
            ends = np.cumsum(size)
            base = np.concatenate(([0], ends))[at[:-1]]
            ends -= np.repeat(base, np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), _list(at, ids), _list(at, ends)], ["doc_id", "ids", "ends"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = held(path)[0]
    for batch in batches:
        out = [decode_ids(lists.values.to_numpy(), vocabulary).tobytes() if (lists := batch.column(1)[i]).is_valid else None for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encoded rows in, digests of their ids and of their decoded bytes out; bytes are decoded for a run of rows at once."""
    vocabulary = held(path)[0]
    for batch in batches:
        lists = batch.column(1)
        at, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        text = decode_ids(ids, vocabulary)
        place = np.concatenate(([0], np.cumsum(vocabulary.length[ids])))[at]
        raw = ids.astype("<u4")
        sha = [
            [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            for flat, cut in ((raw, at), (text, place))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at)), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def _vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id`` (of any type), ``ids`` (array<int>), ``ends`` (array<int>: the byte after each token in
    the document's UTF-8 text, so token i holds the bytes from ends[i-1], or 0, to ends[i]).

    A null or empty text has no ids; repeated rows give repeated rows; null ids stay; other columns are not read. Very long
    texts are encoded whole. ``path`` is a file of ranks that every executor can read; it holds all 256 single bytes.
    """
    place = _vocabulary_path(path)
    table = docs.sparkSession.sparkContext.broadcast(code_point_classes())  # a byte per code point
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(
        lambda batches: _encoded(batches, place, table.value), f"doc_id {kind}, ids array<int>, ends array<int>"
    )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``decoded`` (binary) of rows with ``doc_id`` and ``ids``. Null ids give null, no ids empty bytes; an id beyond
    the vocabulary raises."""
    place = _vocabulary_path(path)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, place), f"doc_id {kind}, decoded binary")


def bpe_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_sha256`` of its ids as little-endian unsigned 32-bit integers and
    ``decoded_sha256`` of the bytes that they decode to. The rows of ``encode`` are decoded in the task that made them."""
    place = _vocabulary_path(path)
    table = docs.sparkSession.sparkContext.broadcast(code_point_classes())
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(
        lambda batches: _digests(_encoded(batches, place, table.value), place), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
