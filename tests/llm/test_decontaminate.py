"""Benchmark items against an exhaustive BM25 and in several indexes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from colsight.llm import decontaminate
from colsight.llm.decontaminate import B, K1, _matches, build_index, contamination
from colsight.llm.words import chunks

SCHEMA = "doc_id long, text string, term long, n long, id string"


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def exhaustive(texts, ids, items, share):
    """(row, item id, score) of all passages, two neighbouring stretches, that reach the share: every item is scored."""
    bags = {i: Counter(words(t)) for i, t in zip(ids, items, strict=True) if words(t)}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weight = {i: {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * sum(b.values()) / mean)) for t, n in b.items()} for i, b in bags.items()}
    stretch = max(32, *(sum(b.values()) for b in bags.values()))
    out = {}
    for row, text in enumerate(texts):
        w = words(text)
        for s in range(0, max(1, -(-len(w) // stretch))):
            here = set(w[s * stretch : (s + 2) * stretch])
            for i, own in weight.items():
                score = sum(x for t, x in own.items() if t in here) / sum(own.values())
                if score >= share - 1e-9:
                    out[row, i] = max(out.get((row, i), 0), score)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    items = [" ".join(word() for _ in range(rng.choice([1, 3, 8, 30, 45]))) + rng.choice(["", "\nanswer " + word()]) for _ in range(60)]
    items += ["", "!!", items[3]]
    texts = [" ".join(word() for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(60)]
    texts += [t + " " + rng.choice(items).upper() + " " + t for t in texts[:40]] + [None, "", "Q. " * 30_000, texts[0], texts[0]]
    return texts, items


def test_block_maxima_lose_nothing():
    texts, items = corpus(1)
    index = build_index(list(range(len(items))), items)
    for share in (0.2, 0.4, 0.7):
        got = {}
        for first, offs, data in chunks(pa.array([(t or "").lower() for t in texts], pa.string())):
            for row, item, score, *_ in _matches(index, offs, data, share):
                key = first + row, int(index.ids[item])
                got[key] = max(got.get(key, 0), score)
        want = exhaustive(texts, range(len(items)), items, share)
        assert got.keys() == want.keys()
        assert np.allclose([got[k] for k in want], list(want.values()))


def test_several_indexes_give_the_same(spark, monkeypatch):
    texts, items = corpus(2)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)] + [(None, items[0], 5), (90, None, 5)], "item_id long, text string, df long")
    key = lambda r: (r.doc_id, r.contaminated, r.bench_items, r.bench_retrieved, None if r.bench_score is None else round(r.bench_score, 9))
    want = sorted(map(key, contamination(docs, bench).collect()))
    assert sum(w[1] for w in want) >= 30
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 300)
    found = contamination(docs.repartition(3), bench)
    assert found.columns == [*docs.columns, "bench_items", "bench_retrieved", "bench_score", "contaminated"]
    assert sorted(map(key, found.collect())) == want
    none = contamination(docs, bench.where("item_id < 0"))
    assert none.where("contaminated or bench_retrieved > 0").count() == 0 and none.count() == len(texts)
    assert contamination(docs.where("doc_id < 0"), bench).count() == 0
