"""Collocations: phrases that are bound more strongly than their parts.

Each shard of texts (a bounded number of bytes) becomes a bidirectional FM-index over word ids: the Burrows-Wheeler
transforms of its words and of its words reversed. All phrases of one length are intervals of both; one extension step
turns all of them into the intervals of all phrases that are one word longer, with their counts. Counts are summed over
shards, and everything after that works on phrases, not texts.

Lengths are counted one after the other. A phrase that is frequent holds only frequent shorter ones, so before the next
length texts are broken where a phrase is not among the frequent ones of the last length. These are looked up in a Bloom
filter of fixed size: it never misses one, and what it lets through besides is counted and found to be rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import cut
from colsight.llm.words import GRAM, LOWER, U, chunks, grams, hashes, mix, split, strings

MOST_WORDS, LEAST_COUNT, COVERED, TOP = 3, 10, 50, 2000
SHARD_BYTES = 6 << 20
"""Bytes of text of an index; a longer text is a shard of its own."""
FILTER_BITS, FILTER_HASHES = 26, 4
"""The filter has 2 to this power bits (8 MB), however many phrases it holds."""
OUT_ROWS = 1 << 16
PARTS = 32
"""Parts of a language's phrases that are ranked on their own first."""
# fixed values: bytes that end a piece, and bytes between the words of a piece
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(10, 14)]] = True
BETWEEN = np.zeros(256, bool)
BETWEEN[[32, 9]] = True


def _stable_order(numbers: np.ndarray) -> np.ndarray:
    """What ``argsort(kind="stable")`` gives, by a sort of numbers with their places; both stay far below 2^31."""
    n = max(1, len(numbers))
    return np.sort(numbers * n + np.arange(len(numbers))) % n


@dataclass
class Phrases:
    """All phrases of one length: where their intervals begin in the forward and in the reversed index, and their sizes."""

    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray


class FMIndex:
    """Both transforms of ``text`` (ids from 1; 0 ends a piece, and the last id is 0). The forward one is sorted by ``depth``
    words of context, the reversed one by one less, as the last extension goes to the left."""

    def __init__(self, text: np.ndarray, depth: int):
        self.size = len(text)
        counts = np.bincount(text)
        self.first_of = np.concatenate(([0], np.cumsum(counts)))
        self.head = np.repeat(np.arange(len(counts)), counts)
        self.suffix, self.before = self._sorted(text, depth)
        _, self.after = self._sorted(text[::-1], max(1, depth - 1))

    def _sorted(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the suffixes by their first ``depth`` words, and the LF mapping of the words before them. Suffixes are
        sorted by one stable pass per word, that of the deepest word first."""
        order = np.arange(self.size)
        for k in reversed(range(depth)):
            order = order[_stable_order(np.roll(text, -k)[order])]
        lf = np.empty(self.size, np.int64)
        lf[_stable_order(text[order - 1])] = np.arange(self.size)
        return order, lf

    def words(self) -> Phrases:
        """The phrases of one word, in the order of their ids."""
        begin = self.first_of[1:-1]
        return Phrases(begin, begin, np.diff(self.first_of)[1:])

    def extended(self, phrases: Phrases, left: bool) -> Phrases:
        """All phrases with a word more on one side. The LF mapping of that side's index carries every place of the old
        intervals to its place under the new first word; places that lie together there and come from one phrase are a new
        interval. In the other index that lies inside the old one, after those of smaller words."""
        lf = self.before if left else self.after
        own, other = (phrases.forward, phrases.backward) if left else (phrases.backward, phrases.forward)
        until = np.cumsum(phrases.count)
        at = np.arange(until[-1] if len(until) else 0) + np.repeat(own - until + phrases.count, phrases.count)
        origin = np.full(self.size, -1)
        origin[lf[at]] = np.repeat(np.arange(len(own)), phrases.count)
        place = np.flatnonzero(origin >= 0)
        parent, symbol = origin[place], self.head[place]
        first = np.flatnonzero((np.diff(parent, prepend=-1) != 0) | (np.diff(symbol, prepend=-1) != 0))
        count = np.diff(first, append=len(place))
        place, parent, symbol = place[first], parent[first], symbol[first]
        by_parent = _stable_order(parent)  # inside a parent by word, since heads ascend
        sizes = count[by_parent]
        inside = np.empty(len(count), np.int64)
        inside[by_parent] = np.cumsum(sizes) - sizes
        inside += (other - until + phrases.count)[parent]
        real = symbol > 0
        place, inside, count = place[real], inside[real], count[real]
        return Phrases(place, inside, count) if left else Phrases(inside, place, count)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(a text position, count) of all phrases of so many words: extended to the right, the last time to the left."""
        found = self.words()
        for n in range(2, length + 1):
            found = self.extended(found, left=n == length)
        return self.suffix[found.forward], found.count


def _lang_code(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "big")


def _filter_places(gram: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit word of the filter, bit in it) for each of the filter's hashes."""
    for k in range(1, FILTER_HASHES + 1):
        place = mix(gram + GRAM[k]) >> U(64 - power)
        yield (place >> U(6)).astype(np.int64), place & U(63)


def _may_be_in(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    found = np.ones(len(gram), bool)
    for word, bit in _filter_places(gram, len(bits).bit_length() + 5):
        found &= (bits[word] >> bit & U(1)).astype(bool)
    return found


def _in_frequent(word: np.ndarray, opens: np.ndarray, length: int, bits: np.ndarray) -> np.ndarray:
    """Which words lie in a phrase of ``length`` words whose shorter phrases may all be frequent."""
    keep = np.zeros(len(word), bool)
    if len(word) < length:
        return keep
    good = _may_be_in(bits, grams(word, length - 1))
    begins = good[:-1] & good[1:]
    for k in range(1, length):
        begins &= ~opens[k : len(opens) - length + 1 + k]
    for k in range(length):
        keep[k : len(begins) + k] |= begins
    return keep


def _words(lang: np.ndarray, codes: np.ndarray, column: pa.Array, length: int, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, hashes with the language mixed in, whether a piece begins, language, text) of the words of runs of rows."""
    for first, offs, data in chunks(column):
        starts, ends, at = split(offs, data, ENDS_PIECE | BETWEEN)
        own = np.repeat(lang[first : first + len(offs) - 1], np.diff(at))
        word = mix(hashes(data, starts, ends) + codes[own])
        ended = np.concatenate(([0], np.cumsum(ENDS_PIECE[data])))
        opens = np.ones(len(starts), bool)
        opens[1:] = ended[starts[1:]] > ended[ends[:-1]]
        opens[at[:-1][at[:-1] < len(starts)]] = True
        if bits is not None:
            keep = np.flatnonzero(_in_frequent(word, opens, length, bits))
            opens = opens[keep] | (np.diff(keep, prepend=-2) > 1)
            word, own, starts, ends = word[keep], own[keep], starts[keep], ends[keep]
        yield len(data) * len(word) // max(1, int(at[-1])), word, opens, own, strings(LOWER[data], starts, ends)


def _rows(parts: list, langs: list[str], length: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n) of all phrases of ``length`` words of a shard; with single words also a row of 0 words that
    has each language's number of words."""
    word, opens, lang = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    if not len(word):
        return
    names = ["lang", "words", "phrase", "n"]
    spelled = pa.chunked_array([p[3] for p in parts])
    code, distinct = pd.factorize(word)
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    spelled = spelled.take(pa.array(first)).combine_chunks()
    text = np.insert(code + 1, np.append(np.flatnonzero(opens)[1:], len(code)), 0)
    of_word, named = lang[first], pa.array(langs, pa.string())
    del word, opens, code, parts
    if length == 1:
        every = np.bincount(lang, minlength=len(langs))
        yield pa.RecordBatch.from_arrays([named, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs)), pa.array(every)], names)
    at, count = FMIndex(text, length).phrases(length)
    for a in range(0, len(at), OUT_ROWS):
        place = at[a : a + OUT_ROWS]
        spelt = [spelled.take(pa.array(text[place + k] - 1)) for k in range(length)]
        phrase = spelt[0] if length == 1 else pc.binary_join_element_wise(*spelt, " ")
        own = named.take(pa.array(of_word[text[place] - 1]))
        yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(place), length, np.int32)), phrase, pa.array(count[a : a + OUT_ROWS])], names)


def _counted(length: int, bits):
    """Rows (lang, text) to counts of phrases of ``length`` words, shard by shard; ``bits``: the broadcast filter or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        parts, held = [], 0
        for batch in batches:
            column = pc.fill_null(batch.column(0), "und").dictionary_encode()
            numbers = np.array([known.setdefault(x, len(known)) for x in column.dictionary.to_pylist()], np.int64)
            codes = np.array([_lang_code(x) for x in known], U)
            for size, *part in _words(numbers[column.indices.to_numpy()], codes, batch.column(1), length, bits and bits.value):
                if parts and held + size > SHARD_BYTES:
                    yield from _rows(parts, list(known), length)
                    parts, held = [], 0
                parts.append(part)
                held += size
        if parts:
            yield from _rows(parts, list(known), length)

    return run


def _filter_bits(length: int, power: int):
    """Rows (lang, phrase) to the bits that the filter has for them, as (word of the filter, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).dictionary_encode()
            codes = np.array([_lang_code(x) for x in column.dictionary.to_pylist()], U)
            own = column.indices.to_numpy()
            for first, offs, data in chunks(batch.column(1)):
                starts, ends, at = split(offs, data, BETWEEN)
                word = mix(hashes(data, starts, ends) + np.repeat(codes[own[first : first + len(offs) - 1]], length))
                places = list(_filter_places(grams(word, length)[at[:-1]], power))
                mask = np.concatenate([U(1) << bit for _, bit in places]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w for w, _ in places])), pa.array(mask)], ["word", "mask"])

    return run


def _filter(frequent: DataFrame, length: int):
    """The broadcast filter of phrases of ``length`` words; rows of one per word of the filter at most reach the driver."""
    rows = frequent.select("lang", "phrase").mapInArrow(_filter_bits(length, FILTER_BITS), "word long, mask long")
    held = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # no row objects: 16 bytes for each word
    bits = np.zeros(1 << (FILTER_BITS - 6), U)
    bits[held["word"].to_numpy()] = held["mask"].to_numpy().view(U)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", most: int = MOST_WORDS, least: int = 1) -> DataFrame:
    """(lang, words, phrase, n): how often each phrase of up to ``most`` words occurs inside the pieces of all texts of a
    language, overlaps included, where that is ``least`` times or more; the row of 0 words and phrase '' has the number
    of all words."""
    read = docs.select(docs[lang_column].cast("string").alias("lang"), docs[text_column].cast("string").alias("text"))
    found, bits = [], None
    for length in range(1, most + 1):
        rows = read.mapInArrow(_counted(length, bits), "lang string, words int, phrase string, n long")
        # shards have summed already; most phrases are rare, so a second partial sum before the shuffle would only hold them
        sums = rows.repartition("lang", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
        found.append(cut(sums.where((F.col("n") >= least) | (F.col("words") == 0))))
        if length < most:
            bits = _filter(found[-1].where("words > 0"), length)
    return reduce(DataFrame.unionByName, found)


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", most: int = MOST_WORDS, least: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs without space and tab inside pieces, which end at ``. , ; : ! ?`` and line breaks; A-Z count as a-z. A
    phrase of 2 to ``most`` words with a >= ``least`` occurrences is cut where floor(10^6 a^2 / (l r)) is least (ties: the
    first cut). It goes when a longer candidate around it has ``covered`` per cent of its occurrences or more. Null texts
    are empty, null languages ``und``; repeated rows count each; no rows, or no candidates, give no rows. Other columns are
    not read.
    """
    counts = phrase_counts(docs, text_column, lang_column, most, least)
    known = counts.where("words > 0").select("lang", "phrase", "n")
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def joined(begin: str, size: str) -> str:
        return f"array_join(slice(w, {begin}, {size}), ' ')"

    cuts = found.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "w", "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(joined("1", "k")).alias("left"), F.expr(joined("k + 1", "words - k")).alias("right"))
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("n").alias(size)) for side, size in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # at most 10^6, as a is at most l and at most r
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))

    inner = "transform(sequence(2, words - 1), size -> transform(sequence(1, words - size + 1), b -> array_join(slice(w, b, size), ' ')))"
    longer = found.where("words > 2").select("lang", F.explode(F.flatten(F.expr(inner))).alias("phrase"), F.col("a").alias("around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(f"around is null or 100 * around < {covered} * best.a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    # what is among the first of its language is among the first of its part; no task sees more than PARTS times ``top``
    ranked = ranked.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM p),
f AS (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
cuts AS (
  SELECT lang, words, phrase, a, w, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:words], ' ') AS y
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < words),
scored AS (
  SELECT cuts.*, l.n AS l, r.n AS r, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.x JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3) GROUP BY ALL),
free AS (SELECT best.* FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase WHERE around.a IS NULL OR 100 * around.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT ranked.lang, rank, phrase, a, l, r, total.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
