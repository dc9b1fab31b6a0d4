"""Exact set-similarity join of word shingles by relations between sets.

1. Index lists. Shingles are ordered with the frequent ones last; two sets above the threshold share several of the first
   few. Only those go into the index, with their position in the set. Lists of one set are dropped as they are made.
2. Position skips. In each list every set points to its most popular fellow, if list positions and sizes still allow the
   threshold; the trees of pointers are mostly copies of one text. Between trees only the heads of a list look for
   partners: entries at a position from which a set of that size can still reach the threshold with a larger one. Trees
   that share enough lists, by the bounds of their positions and sizes, form a group. No pair of sets is written for this.
3. Answers from similar sets. In a group each set's overlaps with all others are derived from those of the answered set
   that is most similar to it, by the lists of the shingles in which the two differ. Sets whose partners are linked
   already, or whose sizes exclude links, are skipped.

Equal sets are one class from the start; a set is named by a 64-bit fingerprint and its size. Frequent shingles (each task
counts those met twice in a batch) only choose the order, so missing some changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import Links, components, cut, lean
from colsight.llm.words import GRAM, U, mix, shingle_sets

FREQUENT = 64
"""Counts from which a shingle goes last in the order."""
FREQUENT_ROWS = 200_000
"""Frequent shingles that are sent to the tasks, the most frequent ones."""
LIST_ROWS = 4096
"""Sets of a frequent shingle that stand in one part of its list."""
HOT_SHARE = 1000
"""A class with more than one row in so many is hot; that many are at most."""
HITS = 4
"""Shingles that two linked sets surely share among their first ones (or all, if they have fewer)."""
TILE_SETS, TILE_SHINGLES = 2048, 2_000_000
"""Sets and shingles of a tile of a group; larger groups are compared tile by tile."""


def _print(own: np.ndarray) -> int:
    return int(mix(own + GRAM[5]).sum().view(np.int64)) if len(own) else 0


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        often, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for first, sets in shingle_sets(batch.column(1), n):
                size = np.array([len(x) for x in sets], np.int64)
                prints = [_print(x) for x in sets]
                yield pa.record_batch([pa.array(np.zeros(len(sets), np.int32)), ids.slice(first, len(sets)), pa.array(prints, pa.int64()), pa.array(size)], names=["kind", "id", "print", "n"])
                fresh = []
                for x, p in zip(sets, prints, strict=True):
                    if len(x) and (p, len(x)) not in seen:
                        seen.add((p, len(x)))
                        fresh.append(x)
                if fresh:
                    value, count = np.unique(np.concatenate(fresh), return_counts=True)
                    often = np.concatenate((often, value[count > 1]))
                    counts = np.concatenate((counts, count[count > 1]))
                    if len(often) > 2 * FREQUENT_ROWS:
                        often, counts = _summed(often, counts)
        often, counts = _summed(often, counts)
        yield pa.record_batch([pa.array(np.ones(len(often), np.int32)), pa.nulls(len(often), pa.int64()), pa.array(often.view(np.int64)), pa.array(counts)], names=["kind", "id", "print", "n"])

    return lean(run)


def _summed(often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, where = np.unique(often, return_inverse=True)
    total = np.bincount(where, counts, len(value)).astype(np.int64)
    if len(value) > FREQUENT_ROWS:
        keep = np.argpartition(-total, FREQUENT_ROWS)[:FREQUENT_ROWS]
        value, total = value[keep], total[keep]
    return value, total


def _entries(n: int, percent: int, often):
    """The index entries of each set, in the order of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, rank, parts = often.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(value >> U(44)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), n):
                token, who, size, place, part = [], [], [], [], []
                for own in sets:
                    m = len(own)
                    if not m or (p := _print(own), m) in seen:
                        continue
                    seen.add((p, m))
                    first = min(m, m - (percent * m + 99) // 100 + HITS)
                    doubt = np.flatnonzero(maybe[(own >> U(44)).astype(np.int64)])
                    late = np.searchsorted(value, own[doubt])
                    hit = (late < len(value)) & (value[np.minimum(late, len(value) - 1)] == own[doubt]) if len(value) else np.zeros(len(doubt), bool)
                    doubt, late = doubt[hit], late[hit]
                    rare = np.delete(own, doubt) if len(doubt) else own
                    chosen, salt = rare[:first], np.zeros(min(first, len(rare)), np.int64)
                    if len(chosen) < first:
                        late = late[np.argsort(rank[late])][: first - len(chosen)]
                        chosen = np.concatenate((chosen, value[late]))
                        salt = np.concatenate((salt, 1 + (p & 0x7FFFFFFF) % parts[late]))
                    token.append(chosen)
                    part.append(salt)
                    who.append(np.full(len(chosen), p, np.int64))
                    size.append(np.full(len(chosen), m, np.int32))
                    place.append(np.arange(len(chosen), dtype=np.int32))
                if token:
                    yield pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(part).astype(np.int32)), pa.array(np.concatenate(who)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place))], names=["token", "part", "print", "n", "place"])

    return lean(run)


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token: those of tokens that several sets hold, each set once. Looks one row back and ahead."""
    held = before = None

    def several(x: np.ndarray, after: np.ndarray | None) -> pa.RecordBatch:
        token = x[:, 0]
        more = x[:, 1] > 0
        more[1:] |= token[1:] == token[:-1]
        more[:-1] |= token[1:] == token[:-1]
        more[0] |= before is not None and before[0] == token[0]
        more[-1] |= after is not None and after[0] == token[-1]
        return pa.record_batch([pa.array(x[more][:, k]) for k in (0, 2, 3, 4)], names=["token", "print", "n", "place"])

    for batch in batches:
        x = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
        x = x if held is None else np.concatenate((held, x))
        if not len(x):
            continue
        x = x[np.concatenate(([True], (x[1:, :4] != x[:-1, :4]).any(axis=1)))]
        if len(x) > 1:
            yield several(x[:-1], x[-1])
            before = x[-2]
        held = x[-1:]
    if held is not None:
        yield several(held, None)


def _linked(sets: list[np.ndarray], percent: int, links: Links, rows: np.ndarray, cols: np.ndarray | None) -> None:
    """Link the sets with numbers ``rows`` among each other, or with those of ``cols``.

    Sets are answered in order of size. A set's overlaps with all others are those of the answered set that differs least
    from it, plus those of the shingles that only the new one holds, less those of the shingles that only the old one
    holds; without a set that is near enough they are counted from the lists of its shingles. A set whose size or links
    leave no open partner is skipped.
    """
    by_size = lambda x: x[np.argsort([len(sets[i]) for i in x], kind="stable")]
    rows, cols = by_size(rows), None if cols is None else by_size(cols)
    every = rows if cols is None else np.concatenate((rows, cols))
    size = np.array([len(sets[i]) for i in every])
    token, where = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True)
    held = np.bincount(where, minlength=len(token))
    common = int((held == len(every)).sum())
    open_ = ((held > 1) & (held < len(every)))[where]
    owner, where = np.repeat(np.arange(len(every)), size)[open_], where[open_]
    begin = np.searchsorted(owner, np.arange(len(every) + 1))  # owners ascend
    owners = owner[np.argsort(where, kind="stable")]
    list_at = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(token)))))

    def holders(some: np.ndarray) -> np.ndarray:
        """How many of some shingles each set holds."""
        many = list_at[some + 1] - list_at[some]
        until = np.cumsum(many)
        at = np.arange(until[-1] if len(until) else 0) + np.repeat(list_at[some] - until + many, many)
        return np.bincount(owners[at], minlength=len(every))

    own = [where[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    kept = np.diff(begin)
    answers = np.zeros((len(rows), len(every)), np.int32)
    answered = np.zeros(0, np.int64)
    first_target = len(rows) if cols is not None else 0
    for i in range(len(rows)):
        root = links.roots()[every]
        fits = (root != root[i]) & (100 * size >= percent * size[i]) & (100 * size[i] >= percent * size)
        fits[: max(first_target, i + 1 if cols is None else 0)] = False
        if not fits.any():
            continue
        differ = kept[answered] + kept[i] - 2 * answers[answered, i]
        if len(answered) and differ.min() < kept[i]:
            near = answered[differ.argmin()]
            answers[i] = answers[near] + holders(np.setdiff1d(own[i], own[near], True)) - holders(np.setdiff1d(own[near], own[i], True))
        else:
            answers[i] = holders(own[i])
        answered = np.append(answered, i)
        both = answers[i].astype(np.int64) + common
        hit = np.flatnonzero(fits & ((100 + percent) * both >= percent * (size + size[i])))
        links.join(np.full(len(hit), every[i]), every[hit])


def _compare(words: int, percent: int):
    """Links inside each key of rows sorted by key: (node, a node that it reaches)."""

    def finish(rows: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame | None:
        rows = [r for r in rows if len(r[2])]
        if len(rows) < 2:
            return None
        node = np.array([r[0] for r in rows], np.int64)
        tile = np.array([r[1] for r in rows])
        sets = [r[2] for r in rows]
        links = Links(len(rows))
        if (tile == tile[0]).all():
            _linked(sets, percent, links, np.arange(len(rows)), None)
        else:
            _linked(sets, percent, links, np.flatnonzero(tile == tile[0]), np.flatnonzero(tile != tile[0]))
        root = links.roots()
        own = root != np.arange(len(rows))
        return pd.DataFrame({"u": node[own], "v": node[root[own]]}) if own.any() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for f in frames:
            for first, sets in shingle_sets(pa.array(f["text"], pa.string()), words):
                part = f.iloc[first : first + len(sets)]
                for k1, k2, node, tile, own in zip(part["k1"], part["k2"], part["node"], part["tile"], sets, strict=True):
                    if (k1, k2) != key:
                        if (out := finish(rows)) is not None:
                            yield out
                        key, rows = (k1, k2), []
                    rows.append((node, tile, own))
        if (out := finish(rows)) is not None:
            yield out

    return lean(run)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, and ``component_id``, the smallest id reachable by links.

    Two rows link when 100 x common >= percent x union over their distinct shingles of ``words`` words; a row with fewer
    words has its whole sequence as one shingle. Rows without words (null, empty, blank) link with nothing, are in a
    component of their own and have size 0. Equal texts are linked; repeated rows stay repeated rows, and rows that share
    an id are one node. A row with a null id takes part in no link: n_shingles is counted, component_id is null. Other
    columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = cut(docs.mapInArrow(_sketch(words), "kind int, id long, print long, n long"))
    rows = sketch.where("kind = 0").drop("kind")
    often = (
        sketch.where("kind = 1").groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "print").limit(FREQUENT_ROWS).toPandas().sort_values("print", key=lambda x: x.to_numpy(np.int64).view(U))
    )
    count = often["n"].to_numpy(np.int64)
    rank = np.argsort(np.argsort(count, kind="stable"))
    table = spark.sparkContext.broadcast((often["print"].to_numpy(np.int64).view(U), rank, 1 + count // LIST_ROWS))

    entries = docs.where("id IS NOT NULL").select("text").mapInArrow(_entries(words, percent, table), "token long, part int, print long, n int, place int")
    entries = entries.repartition("token", "part").sortWithinPartitions("token", "part", "print", "n")
    lists = cut(entries.mapInArrow(_shared_lists, "token long, print long, n long, place long"))

    def enough(hits: str, a: str, b: str):
        """Whether two sets share as many of their first shingles as linked ones must."""
        return F.col(hits) >= F.least(F.lit(HITS), *(F.ceil(F.col(n) * percent / 100) for n in (a, b)))

    # a set's popularity: the lengths of the lists it is in
    by_token, by_set = Window.partitionBy("token"), Window.partitionBy("print", "n")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("print", "n").agg(F.min("id").alias("node"), F.count("*").alias("rows"))
    lists = lists.withColumn("length", F.count("*").over(by_token)).where("length > 1")
    lists = lists.join(classes.drop("rows").hint("merge"), ["print", "n"]).withColumn("popular", F.sum("length").over(by_set))
    lists = lists.withColumn("shared", F.count("*").over(by_set)).where(enough("shared", "n", "n"))
    lists = cut(lists.select("token", "node", "n", "place", "popular"))

    def may(a: str, b: str):
        """Whether the sizes and positions of a shared shingle still allow the threshold."""
        n1, n2, p1, p2 = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}place", f"{b}place"))
        return (100 + percent) * (HITS + F.least(n1 - 1 - p1, n2 - 1 - p2)) >= percent * (n1 + n2)

    best = F.max(F.struct("popular", "node", "n", "place")).over(by_token)
    votes = lists.withColumn("best", best).where("node <> best.node").where(may("", "best."))
    votes = votes.groupBy("node", F.col("best.node").alias("other")).agg(F.count("*").alias("votes"), F.max("best.popular").alias("popular"), F.first("n").alias("n"), F.first("best.n").alias("m"))
    pointers = cut(votes.where(enough("votes", "n", "m")).groupBy("node").agg(F.max(F.struct("votes", "popular", "other")).alias("top")).select("node", F.col("top.other").alias("other")))
    grouped = cut(components(pointers, "node", "other").select("node", F.col("component").alias("root")))

    # of each list one row per pointer tree, with the bounds of its sets' sizes and positions
    trees = lists.select("token", "node", "n", "place").join(grouped.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    trees = trees.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("n"), F.min("place").alias("place"))
    trees = cut(trees.withColumn("trees", F.count("*").over(by_token)).where("trees > 1").drop("trees"))
    # of two linked sets the smaller one stands so far ahead in each shared list that the rest of it could still suffice;
    # only such heads look for partners, which skips the long tails of lists that very many sets share
    head = (100 + percent) * (HITS + F.col("n") - 1 - F.col("place")) >= 2 * percent * F.col("low")
    trees = trees.withColumn("head", head)
    other = trees.select("token", *(F.col(c).alias(f"other_{c}") for c in ("root", "low", "n", "place", "head")))
    sizes_fit = (100 * F.col("n") >= percent * F.col("other_low")) & (100 * F.col("other_n") >= percent * F.col("low"))
    room = HITS + F.least(F.col("n") - 1 - F.col("place"), F.col("other_n") - 1 - F.col("other_place"))
    once = F.when(F.col("other_head"), F.col("root") < F.col("other_root")).otherwise(F.col("root") != F.col("other_root"))
    near = trees.where("head").join(other, "token").where(once).where(sizes_fit & ((100 + percent) * room >= percent * (F.col("low") + F.col("other_low"))))
    swap = F.col("root") > F.col("other_root")
    near = near.select(
        F.least("root", "other_root").alias("root"), F.greatest("root", "other_root").alias("other_root"),
        F.when(swap, F.col("other_low")).otherwise(F.col("low")).alias("low"), F.when(swap, F.col("low")).otherwise(F.col("other_low")).alias("other_low"),
    )
    near = near.groupBy("root", "other_root").agg(F.count("*").alias("hits"), F.min("low").alias("n"), F.min("other_low").alias("m")).where(enough("hits", "n", "m"))
    bonds = grouped.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(near.select(F.col("root").alias("u"), F.col("other_root").alias("v")))
    grouped = cut(components(bonds).select("node", F.col("component").alias("root")))

    size = classes.select("node", "n")
    members = grouped.join(size, "node")
    tiles = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    members = members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.select("node", F.col("root").alias("k1"), F.concat_ws("-", F.lit("g"), F.least("tile", "o"), F.greatest("tile", "o")).alias("k2"), "tile")
    wanted = cut(members)

    texts = docs.join(wanted.hint("merge"), docs["id"] == wanted["node"]).select("k1", "k2", "tile", "node", "text")
    links = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "tile", "node").mapInPandas(_compare(words, percent), "u long, v long")
    found = components(links)
    # copies of one text: classes with many rows, HOT_SHARE of them at most, meet their rows without a shuffle
    total = rows.count()
    hot = F.broadcast(classes.where(F.col("rows") * HOT_SHARE > total).select("print", "n", F.col("node").alias("hot_node")))
    placed = rows.join(hot, ["print", "n"], "left")
    rest = placed.where("hot_node IS NULL").join(classes.drop("rows"), ["print", "n"], "left")
    placed = placed.where("hot_node IS NOT NULL").withColumn("node", F.col("hot_node")).unionByName(rest).drop("hot_node")
    named = placed.join(found, "node", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
