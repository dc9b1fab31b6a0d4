"""Divergence of the sources of each language from one another, and the terms that set a source apart.

Term counts of each (language, source) are columns over the language's vocabulary. The vocabulary is dealt into blocks;
in a block it is reordered so that equal counts lie together, each source's column is run-length encoded, and two sources
are compared run by run: boundaries are intersected and the term's share of the divergence is taken times the run length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import cut
from colsight.llm.words import LOWER, chunks, hashes, split, strings

UNIT = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
COUNTED_BYTES = 4 << 20
"""Bytes of text whose terms are counted together before rows leave the task."""
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 22
"""Counts (sources times terms) that a block of the vocabulary has on average: more with many sources, so that the pairs
that every block returns stay fewer than its counts."""
SALTS = 32
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts in; (lang, source, term, n, docs) of runs of rows out, with a row without a term for every group."""
    for batch in batches:
        pairs = pa.table({"lang": pc.fill_null(batch.column(0), ""), "source": pc.fill_null(batch.column(1), "")})
        codes = [c.combine_chunks().dictionary_encode() for c in pairs.columns]
        lang, source = (c.indices.to_numpy().astype(np.int64) for c in codes)
        group, known = pd.factorize(lang * len(codes[1].dictionary) + source)
        names = [codes[0].dictionary.take(pa.array(known // max(1, len(codes[1].dictionary)))), codes[1].dictionary.take(pa.array(known % max(1, len(codes[1].dictionary))))]
        zero = pa.array(np.zeros(len(known), np.int64))
        yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(known), pa.string()), zero, zero], ["lang", "source", "term", "n", "docs"])
        for first, offs, data in chunks(batch.column(2), COUNTED_BYTES):
            starts, ends, at = split(offs, data, NOT_TERM)
            if not len(starts):
                continue
            word, terms = pd.factorize(hashes(data, starts, ends))
            size = len(terms)
            begin = np.empty(size, np.int64)
            begin[word[::-1]] = np.arange(len(word) - 1, -1, -1)
            row = np.repeat(np.arange(first, first + len(offs) - 1), np.diff(at))
            code, in_row = pd.factorize(row * size + word)
            times = np.bincount(code)
            code, in_group = pd.factorize(group[in_row // size] * size + in_row % size)
            n, docs = np.bincount(code, times).astype(np.int64), np.bincount(code)
            text = strings(LOWER[data], starts[begin], ends[begin])
            own = pa.array(in_group // size)
            yield pa.RecordBatch.from_arrays([*(x.take(own) for x in names), text.take(pa.array(in_group % size)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact for totals below 9 * 10^15, by long division in steps of 1000."""
    out, rest = np.divmod(counts.astype(np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def compare_block(counts: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """For each two sources a, b (rows of ``counts``, terms in columns) the sum over the columns of floor((p-q)^2 / q), p of
    a and q of b, in cell [a, b]."""
    sources, terms = counts.shape
    out = np.zeros((sources, sources), np.int64)
    if not terms:
        return out
    densest_last = np.argsort((counts > 0).sum(axis=1), kind="stable")
    counts = counts[:, np.lexsort(counts[densest_last])]
    runs = []
    for column, total in zip(counts, totals.tolist(), strict=True):
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        runs.append((starts, shares(column[starts], int(total) + vocabulary)))
    for a in range(sources):
        for b in range(a + 1, sources):
            edges = np.sort(np.concatenate((runs[a][0], runs[b][0])), kind="stable")  # two sorted lists, merged
            edges = edges[np.diff(edges, append=terms) > 0]
            length = np.diff(edges, append=terms)
            p, q = (share[np.searchsorted(starts, edges, "right") - 1] for starts, share in (runs[a], runs[b]))
            square = (p - q) * (p - q)
            out[a, b], out[b, a] = (square // q * length).sum(), (square // p * length).sum()
    return out


def _block(block: pa.Table) -> pa.Table:
    """One block of a language's vocabulary: rows without a term name its sources, n being their total."""
    head = block.filter(pc.is_null(block["term"]))
    cells = block.filter(pc.is_valid(block["term"]))
    source = head["source"].combine_chunks()
    term = cells["term"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(source), len(term.dictionary)), np.int64)
    counts[pc.index_in(cells["source"].combine_chunks(), source).to_numpy(), term.indices.to_numpy()] = cells["n"].to_numpy()
    value = compare_block(counts, head["n"].to_numpy(), int(head["v"][0].as_py()))
    a, b = np.nonzero(~np.eye(len(source), dtype=bool))
    lang = pa.array([head["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": source.take(pa.array(a)), "item": source.take(pa.array(b)), "value": pa.array(value[a, b])})


def source_divergence(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: every other source of the language by divergence. Part
    ``term``: the ``top_terms`` terms that the source uses more than its language does.

    Null text, language and source count as ''. Terms are runs of letters A-Z, a-z and signs beyond ASCII, with A-Z as a-z;
    a language keeps terms of at least ``least_docs`` of its documents (rows, so repeated rows count each). Sources without
    terms take part; a language without kept terms has pairs of value 0; a single source has none. Values tie by item in
    UTF-8 order. No rows give none. Other columns are not read. The pairs are sources squared, as the result is; a block of
    the vocabulary has a bounded number of counts, and every block compares all pairs of its language.
    """
    read = docs.select(*(docs[c].cast("string").alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    counted = read.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    cells = cut(counted.drop("docs").join(kept.drop("docs"), ["lang", "term"]))
    groups = counted.select("lang", "source").distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept_terms = cells.groupBy("lang", "term").agg(F.first("everywhere").alias("everywhere")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept_terms, "lang", "left")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").fillna(0, ["total", "v", "lang_total"])
    cells_each = F.greatest(F.lit(LEAST_CELLS), F.least(4 * F.col("sources") * F.col("sources"), F.lit(MOST_CELLS)))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") * F.col("sources") / cells_each))
    groups = cut(groups.withColumn("blocks", blocks))

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))  # a source with a third of all terms is dealt to all of these
    rich = cut(cells.withColumn("salt", salt).join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "source", "salt"]))

    share = f"1 + cast((cast({UNIT} as decimal(38,0)) * ({{}} + 1)) div ({{}} + v) as bigint)"
    terms = rich.withColumns({"p": F.expr(share.format("n", "total")), "q": F.expr(share.format("everywhere", "lang_total"))}).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    head = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "v")
    body = rich.select("lang", F.pmod(F.xxhash64("term", F.lit(1)), "blocks").alias("block"), "source", "term", "n", "v")
    pairs = head.unionByName(body).groupBy("lang", "block").applyInArrow(_block, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM occ GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS everywhere
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
size AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
p AS (
  SELECT cell.lang, cell.source, cell.term, cell.n,
         1 + (1000000000::HUGEINT * (cell.n + 1)::HUGEINT) // (size.n + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (cell.everywhere + 1)::HUGEINT) // (v.n + v.v)::HUGEINT AS q
  FROM cell JOIN size ON size.lang = cell.lang AND size.source = cell.source JOIN v ON v.lang = cell.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sums.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source AND sums.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
