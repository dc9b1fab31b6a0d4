"""Benchmark items in training text: BM25 over an inverted index of the items, block-max skipping, then overlap.

Items are the indexed documents, passages of the training text are the queries. A passage is two neighbouring stretches of
a text, each as long as the longest item, so every copy of an item lies in one passage. Impacts are BM25 weights as
shares of the item's own score; an item is retrieved where its impacts reach ``share``. A passage is dropped as soon as the
sum of its terms' largest impacts stays below that, then block by block of items with the block's largest impacts, and
only then scored item by item. What is retrieved counts if its question part and its answer part overlap the passage.

Words are runs of lower-cased letters, digits and bytes beyond ASCII. An item's answer is its last line, or the last
third of its words where it has one line; the question is the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import cut, free_held
from colsight.llm.words import SPACE, chunks, grams, hashes, split

K1, B = 1.2, 0.75
SHARE = 0.4
GRAM_WORDS = 3
QUESTION_OVERLAP, ANSWER_OVERLAP, WHOLE_OVERLAP = 0.5, 0.3, 0.6
BLOCK_ITEMS = 8
INDEX_BYTES = 32 << 20
"""Bytes of the items' texts of one index, which is sent to every task; more make more indexes, each met by all passages
in the same pass. Statistics are those of all items, so results do not depend on it."""

BETWEEN = SPACE.copy()
BETWEEN[:128] |= ~np.isin(np.arange(128), [*range(48, 58), *range(65, 91), *range(97, 123)])


@dataclass
class Index:
    """Postings by term: items with impacts, and blocks of items with their largest impact."""

    ids: np.ndarray
    stretch: int
    terms: np.ndarray
    top: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_impacts: np.ndarray
    run_words: np.ndarray
    question: tuple[np.ndarray, ...]
    answer: tuple[np.ndarray, ...]


def _parts(word: np.ndarray, answer: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of words of the question, and those that reach into the answer; of a shorter item, all its words."""
    n = min(GRAM_WORDS, len(word))
    run = grams(word, n)
    asks = np.arange(len(run)) + n <= answer
    return np.unique(run[asks]), np.unique(run[~asks])


def _item_words(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """The words of each text, and how many of them are the question's."""
    words, cut_at = [], []
    for _, offs, data in chunks(pc.utf8_lower(texts)):
        starts, ends, at = split(offs, data, BETWEEN)
        word = hashes(data, starts, ends)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            words.append(word[a:b])
            body = bytes(data[offs[i] : offs[i + 1]]).rstrip()
            line = body.rfind(b"\n")
            n = int(np.count_nonzero(starts[a:b] < offs[i] + line)) if line > 0 else 0
            cut_at.append(n if n else (b - a) - (b - a) // 3)
    return words, cut_at


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of texts: a row for each distinct term of each, and one without a term that has its number of words."""
    for batch in batches:
        words, _ = _item_words(batch.column(0))
        words = [w for w in words if len(w)]
        size = pa.array([len(w) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), size], ["term", "n"])
        term = np.concatenate([np.zeros(0, np.uint64), *(np.unique(w) for w in words)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.ones(len(term), np.int64))], ["term", "n"])


@dataclass
class Statistics:
    """Items with words, their mean and greatest length, and in how many items each of some terms (sorted) is."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def build_index(ids: list[int], texts: list[str], known: Statistics | None = None) -> Index | None:
    """The index of the items that have words; None if none has. ``known``: statistics of more items than these."""
    words, cut_at = _item_words(pa.array(texts, pa.string()))
    keep = [i for i, w in enumerate(words) if len(w)]
    if not keep:
        return None
    keep.sort(key=lambda i: (len(words[i]), ids[i]))  # blocks of items of like length
    words, cut_at = [words[i] for i in keep], [cut_at[i] for i in keep]
    size = np.array([len(w) for w in words])
    bags = [np.unique(w, return_counts=True) for w in words]
    terms, where = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    item = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    tf = np.concatenate([b[1] for b in bags]).astype(float)
    known = known or Statistics(len(bags), float(size.mean()), int(size.max()), terms, np.bincount(where))
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    weight = idf[where] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / known.mean))
    impact = weight / np.bincount(item, weight)[item]
    order = np.lexsort((item, where))
    where, item, impact = where[order], item[order], impact[order]
    key, first = np.unique(where * (len(bags) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS, return_index=True)
    return Index(
        np.array([ids[i] for i in keep], np.int64), max(32, known.longest), terms, np.maximum.reduceat(impact, np.searchsorted(where, np.arange(len(terms)))),
        np.searchsorted(where, np.arange(len(terms) + 1)), item, impact,
        np.searchsorted(key // (len(bags) // BLOCK_ITEMS + 1), np.arange(len(terms) + 1)), key % (len(bags) // BLOCK_ITEMS + 1), np.maximum.reduceat(impact, first),
        np.minimum(size, GRAM_WORDS), *zip(*(_parts(w, c) for w, c in zip(words, cut_at, strict=True)), strict=True),
    )


def _spread(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the postings of terms, and for each which of the terms it belongs to."""
    many = at[term + 1] - at[term]
    until = np.cumsum(many)
    return np.arange(until[-1] if len(until) else 0) + np.repeat(at[term] - until + many, many), np.repeat(np.arange(len(term)), many)


def _retrieved(index: Index, passage: np.ndarray, term: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all that reach the share; passage and term are distinct pairs."""
    blocks = int(index.blocks.max()) + 1
    posting, owner = _spread(index.block_at, term)
    bound = np.bincount(passage[owner] * blocks + index.blocks[posting], index.block_impacts[posting])
    live = bound >= share - 1e-9
    posting, owner = _spread(index.item_at, term)
    cell = passage[owner] * blocks + index.items[posting] // BLOCK_ITEMS
    posting, owner = posting[live[cell]], owner[live[cell]]
    key, place = np.unique(passage[owner] * len(index.ids) + index.items[posting], return_inverse=True)
    score = np.bincount(place, index.impacts[posting], len(key))
    hit = score >= share - 1e-9
    return key[hit] // len(index.ids), key[hit] % len(index.ids), score[hit]


def _matches(index: Index, offs: np.ndarray, data: np.ndarray, share: float) -> list[tuple[int, int, float, float, float, bool]]:
    """(row, item, score, question overlap, answer overlap, verified) of the retrieved items of a run of texts."""
    starts, ends, at = split(offs, data, BETWEEN)
    word = hashes(data, starts, ends)
    if not len(word):
        return []
    rows = len(offs) - 1
    n = np.diff(at)
    many = np.maximum(1, -(-n // index.stretch)) * (n > 0)
    base = np.concatenate(([0], np.cumsum(many)))
    owner = np.repeat(np.arange(rows), n)
    stretch = base[owner] + (np.arange(len(word)) - at[owner]) // index.stretch
    # distinct known terms of each stretch
    term = np.minimum(np.searchsorted(index.terms, word), len(index.terms) - 1)
    known = index.terms[term] == word
    key = np.unique(stretch[known] * len(index.terms) + term[known])
    stretch, term = key // len(index.terms), key % len(index.terms)
    bound = np.bincount(stretch, index.top[term], base[-1] + 1)
    text = np.repeat(np.arange(rows), many)
    after = np.append(text[1:] == text[:-1], False)
    live = bound[:-1] + np.where(after, bound[1:], 0) >= share - 1e-9
    live = np.flatnonzero(live)
    out = []
    for k in range(0, len(live), 256):
        some = live[k : k + 256]
        sides = [(np.arange(len(some)), some), (np.flatnonzero(after[some]), some[after[some]] + 1)]
        pairs = []
        for who, s in sides:
            a, b = np.searchsorted(stretch, s), np.searchsorted(stretch, s, "right")
            take = np.arange((b - a).sum()) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)
            pairs.append(np.repeat(who, b - a) * len(index.terms) + term[take])
        pairs = np.unique(np.concatenate(pairs))
        for p, item, score in zip(*_retrieved(index, pairs // len(index.terms), pairs % len(index.terms), share), strict=True):
            s = some[p]
            row = int(text[s])
            first = at[row] + (s - base[row]) * index.stretch
            here = grams(word[first : min(first + 2 * index.stretch, at[row + 1])], int(index.run_words[item]))
            q, a = index.question[item], index.answer[item]
            in_q, in_a = np.isin(q, here).sum(), np.isin(a, here).sum()
            over_q, over_a = in_q / max(1, len(q)), in_a / max(1, len(a))
            whole = (in_q + in_a) / max(1, len(q) + len(a))
            fits = whole >= WHOLE_OVERLAP and (over_q >= QUESTION_OVERLAP or not len(q)) and (over_a >= ANSWER_OVERLAP or not len(a))
            out.append((row, int(item), float(score), float(over_q), float(over_a), bool(fits)))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` with ``contaminated``, ``bench_items`` (ids of verified items, sorted), ``bench_retrieved`` (how many items
    were retrieved) and ``bench_score`` (the best share, null if none).

    Null and empty texts, and texts when there are no items with words, are clean. Items without words or with a null id
    match nothing. Rows are judged one by one, so repeated rows stay. The new names must be free.
    """
    added = ["contaminated", "bench_items", "bench_retrieved", "bench_score"]
    if taken := [c for c in added if c in docs.columns]:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    at = docs.columns.index(text_col)
    out = docs.withColumns({"bench_items": F.array().cast("array<long>"), "bench_retrieved": F.lit(0).cast("long"), "bench_score": F.lit(None).cast("double")})
    terms = items.select("text").mapInArrow(_item_terms, "term long, n long").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"), F.max("n").alias("longest"))
    sizes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-sizes["bytes"] // INDEX_BYTES))
    terms = cut(terms) if parts > 1 else terms.cache()
    total = terms.where("term IS NULL").first()
    for part in range(parts if total and total["df"] else 0):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        rows = own.orderBy("id", "text").toPandas()
        if not len(rows):
            continue
        met = terms.where("term IS NOT NULL")
        if parts > 1:
            met = met.join(own.select("text").mapInArrow(_item_terms, "term long, n long").select("term").distinct(), "term", "left_semi")
        met = met.select("term", "df").toPandas()
        order = np.argsort(met["term"].to_numpy(np.int64).view(np.uint64))
        known = Statistics(total["df"], total["n"] / total["df"], total["longest"], met["term"].to_numpy(np.int64).view(np.uint64)[order], met["df"].to_numpy(np.int64)[order])
        index = build_index(rows["id"].tolist(), rows["text"].tolist(), known)
        if index is not None:
            out = out.mapInArrow(_judge(spark.sparkContext.broadcast(index), at, share), out.schema)
    terms.unpersist()
    return out.withColumn("contaminated", F.size("bench_items") > 0)


def _judge(held, at: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_held()
        index = held.value
        for batch in batches:
            *own, items, retrieved, score = batch.columns
            items, retrieved, score = items.to_pylist(), retrieved.to_pylist(), score.to_pylist()
            for first, offs, data in chunks(pc.utf8_lower(batch.column(at))):
                seen: dict[int, set[int]] = {}
                for row, item, share_, _, _, fits in _matches(index, offs, data, share):
                    i = first + row
                    seen.setdefault(i, set()).add(item)
                    score[i] = max(score[i] or 0.0, share_)
                    if fits:
                        items[i] = sorted({*items[i], int(index.ids[item])})
                for i, found in seen.items():
                    retrieved[i] += len(found)
            tail = [pa.array(items, pa.list_(pa.int64())), pa.array(retrieved, pa.int64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*own, *tail], names=batch.schema.names)

    return run
