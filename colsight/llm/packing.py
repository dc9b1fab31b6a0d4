"""Packing of tokenised documents into sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces first. The remainders are counted by length class (steps of
``STEP`` tokens). A linear program over patterns of classes, whose columns a knapsack dynamic program prices, is solved
on these counts; rounded down, its patterns say which class, and so which ranked remainders, each sequence takes. What
rounding leaves (fewer documents than patterns times a pattern's pieces, whatever the input) is laid end to end and cut.

Only the class counts (one row per class), the pattern plan and the rounding rest reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import cut
from colsight.llm.tokens import word_ids

LENGTH, STEP = 4096, 16
END_ID = 2
MOST_COLUMNS = 4000
"""Columns that are priced in; stopping early leaves more to the rest, never a document out."""


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def solve(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns for ``counts[c]`` items of size c + 1: a pattern is the items of each class it takes.

    No pattern exceeds the capacity, and together they never take more items than there are.
    """
    classes = np.flatnonzero(counts) + 1
    if not len(classes):
        return []
    demand = counts[classes - 1].astype(float)
    patterns = [np.zeros(len(classes), int) for _ in classes]
    for i, c in enumerate(classes):
        patterns[i][i] = capacity // c
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    amount = inverse @ demand
    for _ in range(MOST_COLUMNS):
        worth = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            m = np.searchsorted(classes, room, "right")
            best[room], last[room] = best[room - 1], -1
            if m:
                value = best[room - classes[:m]] + worth[:m]
                k = int(value.argmax())
                if value[k] > best[room] + 1e-12:
                    best[room], last[room] = value[k], k
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(len(classes), int), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= classes[last[room]]
        into = inverse @ column
        able = np.flatnonzero(into > 1e-9)
        leave = able[np.argmin(amount[able] / into[able])]
        step = max(amount[leave], 0) / into[leave]
        amount = amount - step * into
        amount[leave] = step
        row = inverse[leave] / into[leave]
        inverse = inverse - np.outer(into, row)
        inverse[leave] = row
        patterns[leave] = column
    plan, left = [], counts.copy()
    for p, x in zip(patterns, amount, strict=True):
        times = int(min([max(0, np.floor(x + 1e-6)), *(left[classes[k] - 1] // p[k] for k in np.flatnonzero(p))]))
        if times:
            full = np.zeros(len(counts), int)
            full[classes - 1] = p
            left -= times * full
            plan.append((full, times))
    return plan


def _pieces(tokenizer: str, end_id: int, length: int, step: int):
    """Pieces of each document: the full ones and the remainder, which gets a class and a rank among the task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, given = word_ids(tokenizer), np.zeros(length // step + 2, np.int64)
        for batch in batches:
            for first, at, flat in encode.runs(batch.column(1)):
                n = len(at) - 1
                ids = np.insert(flat, at[1:], end_id).astype("<u4")
                size = np.diff(at) + 1
                begin = np.cumsum(size) - size
                many = -(-size // length)
                row = np.repeat(np.arange(n), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * length
                part = np.minimum(length, size[row] - start)
                group = np.where(part < length, -(-part // step), 0)
                order = np.argsort(group, kind="stable")
                own = np.bincount(group, minlength=len(given))
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                rank += given[group]
                given += own
                raw, place = memoryview(ids.tobytes()), (begin[row] + start) * 4
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(place.tolist(), (place + part * 4).tolist(), strict=True)]
                columns = (start, part, np.array(sums, np.int64), size[row], group, rank)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), *map(pa.array, columns)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "group", "rank"])

    return run


def _cut_rest(rest: pd.DataFrame, length: int) -> list[tuple[int, int, int, int, int]]:
    """(uid, from, size, sequence, offset) of the rest laid end to end; a last short run is cut at powers of two."""
    total, edges = int(rest["length"].sum()), []
    while total - (edges[-1] if edges else 0) >= length:
        edges.append((edges[-1] if edges else 0) + length)
    while (short := total - (edges[-1] if edges else 0)) > 0:
        edges.append((edges[-1] if edges else 0) + (1 << short.bit_length() - 1))
    out, at, sequence, begin = [], 0, 0, 0
    for uid, size in zip(rest["uid"].tolist(), rest["length"].tolist(), strict=True):
        done = 0
        while done < size:
            part = min(size - done, edges[sequence] - at)
            out.append((uid, done, part, sequence, at - begin))
            done, at = done + part, at + part
            if at == edges[sequence]:
                sequence, begin = sequence + 1, at
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, step: int = STEP) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its token ids and then ``end_id``; a null or empty text is that id alone. Repeated rows are packed each
    on its own, also those without an id. Other columns are ignored. Without rows the result is empty. Each id lies in one
    piece; sequences are gapless from 0 and padding, at most ``step`` - 1 tokens a piece, is left at their ends.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, group long, rank long"
    pieces = docs.mapInArrow(_pieces(tokenizer, end_id, length, step), schema)
    pieces = cut(pieces.withColumns({"part": F.spark_partition_id(), "uid": F.monotonically_increasing_id()}))
    sizes = cut(pieces.groupBy("group", "part").agg((F.max("rank") + 1).alias("n")))
    earlier = F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.join(sizes.select("group", "part", F.coalesce(earlier, F.lit(0)).alias("earlier")), ["group", "part"])
    pieces = pieces.withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")

    counts = np.zeros(length // step, np.int64)
    full = 0
    for group, n in sizes.groupBy("group").agg(F.sum("n")).collect():
        if group:
            counts[group - 1] = n
        else:
            full = n
    # of each class, from which rank on a pattern takes its remainders, how many a sequence, and where these begin
    turns: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    given, sequence = np.zeros(len(counts), np.int64), full
    for pattern, times in solve(counts, length // step):
        place = 0
        for c in np.flatnonzero(pattern)[::-1]:
            turns[c].append((int(given[c]), int(pattern[c]), sequence, place))
            given[c] += times * pattern[c]
            place += int(pattern[c])
        sequence += times
    plan = spark.sparkContext.broadcast(([np.array(t, np.int64).reshape(-1, 4) for t in turns], given))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, used = plan.value
        for f in frames:
            group, rank = f["group"].to_numpy(), f["rank"].to_numpy()
            seq, slot = np.where(group == 0, rank, -1), np.zeros(len(f), np.int64)
            for g in np.unique(group[group > 0]):
                rows = np.flatnonzero((group == g) & (rank < used[g - 1]))
                if len(rows):
                    first, many, base, at = turn[g - 1][np.searchsorted(turn[g - 1][:, 0], rank[rows], "right") - 1].T
                    seq[rows] = base + (rank[rows] - first) // many
                    slot[rows] = at + (rank[rows] - first) % many
            yield f.assign(sequence_id=seq, slot=slot)

    placed = cut(pieces.mapInPandas(place, "group long, id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, uid long, sequence_id long, slot long"))
    rest = placed.where("sequence_id < 0")
    bound = rest.select("uid", "length").orderBy(F.desc("length"), "uid").toPandas()
    moves = spark.createDataFrame(
        pd.DataFrame(_cut_rest(bound, length), columns=["uid", "from", "size", "sequence", "offset"]).astype("int64"), "uid long, from long, size long, sequence long, offset long"
    )
    moved = rest.drop("sequence_id").join(moves, "uid")
    whole = moved.where("size = length")
    parts = moved.where("size < length")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Checksums of parts: rows of a text with all parts wanted of it."""
        encode = word_ids(tokenizer)
        for batch in batches:
            cuts = batch.column(1).to_pylist()
            out = []
            for first, rows in encode.rows(batch.column(0)):
                for i, ids in enumerate(rows):
                    ids = np.append(ids, end_id)
                    for c in cuts[first + i]:
                        if c["doc_tokens"] == len(ids) and crc(ids[c["start"] : c["start"] + c["length"]]) == c["ids_crc32"]:
                            begin = c["start"] + c["from"]
                            out.append((c["uid"], c["from"], crc(ids[begin : begin + c["size"]])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["uid", "from", "part_crc"]).astype("int64"), preserve_index=False)

    wanted = parts.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("uid", "from", "size", "start", "length", "doc_tokens", "ids_crc32")).alias("cuts"))
    texts = docs.join(F.broadcast(wanted), docs["id"].eqNullSafe(F.col("_id"))).select("text", "cuts")  # no more than the rest has sequences, twice
    sums = texts.mapInArrow(again, "uid long, from long, part_crc long").dropDuplicates(["uid", "from"])
    parts = parts.join(sums, ["uid", "from"]).withColumn("ids_crc32", F.col("part_crc"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    loose = [
        m.select("id", (F.col("start") + F.col("from")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + sequence).alias("sequence_id"), "offset")
        for m in (whole, parts)
    ]
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_plan = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0).cast("long")))
    return by_plan.select(columns).unionByName(loose[0]).unionByName(loose[1]).withColumnRenamed("id", id_col)
