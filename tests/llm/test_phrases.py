"""Collocations against brute force, and the index against counted n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from colsight.llm import phrases
from colsight.llm.phrases import FMIndex, Phrases, collocations, phrase_counts

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, words string"


def grams(text, most):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
        w = re.findall("[^\x20\x09]+", piece)
        for k in range(1, most + 1):
            for i in range(len(w) - k + 1):
                yield tuple(w[i : i + k])


def brute(rows, most=3, least=10, covered=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        f["und" if lang is None else lang].update(grams(text, most))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i : i + k]] = max(around[g[i : i + k]], a)
        kept = []
        for g, a in cand.items():
            if 100 * around[g] >= covered * a:
                continue
            score, _, l, r = min((10**6 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, n, vocabulary=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Éa", "é", " x", "Up", "up", "漢字"]
    weight = [1 / (i + 1) for i in range(len(words))]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "?"]
    out = []
    for _ in range(n):
        text = "".join(w + rng.choice(glue) for w in rng.choices(words, weight, k=rng.randrange(40)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out + [("en", None), (None, None), ("en", ""), ("en", " ... \n"), ("fr", "rare words only"), ("en", out[0][1]), ("en", out[0][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "x", "y") for i, (lang, t) in enumerate(rows)], SCHEMA)


def test_intervals_of_both_directions_hold_the_same_phrases():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 6, 400), 0)
    want = [Counter() for _ in range(4)]
    for k in (1, 2, 3):
        for i in range(len(text) - k + 1):
            if (text[i : i + k] > 0).all():
                want[k][tuple(text[i : i + k].tolist())] += 1
    for length in (1, 2, 3):
        for depth in range(length, 4):
            at, count = FMIndex(text, depth).phrases(length)
            assert {tuple(text[p : p + length].tolist()): c for p, c in zip(at, count, strict=True)} == want[length]
    index = FMIndex(text, 3)
    words = index.words()
    for left in (True, False):
        pairs = index.extended(words, left)
        got = {tuple(text[p : p + 2].tolist()): c for p, c in zip(index.suffix[pairs.forward], pairs.count, strict=True)}
        assert got == want[2]
    both = index.extended(index.extended(words, False), True)
    assert both.count.sum() == sum(want[3].values())
    assert len(index.extended(Phrases(*[np.zeros(0, np.int64)] * 3), True).count) == 0


def test_counts_and_collocations_equal_brute_force(spark, monkeypatch):
    rows = corpus(1, 700)
    docs = frame(spark, rows)
    assert sorted(tuple(r) for r in collocations(docs.repartition(3)).collect()) == brute(rows)
    small = sorted(tuple(r) for r in collocations(docs, most=4, least=3, covered=80, top=40).collect())
    assert small == brute(rows, 4, 3, 80, 40)
    pairs = sorted(tuple(r) for r in collocations(docs, most=2, least=4).collect())
    assert pairs == brute(rows, 2, 4)


def test_shards_add_up():
    import pyarrow as pa

    rows = corpus(2, 120)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])
    want = Counter()
    for lang, text in rows:
        for g in grams(text, 3):
            want[lang if lang is not None else "und", len(g), " ".join(g)] += 1
            want[lang if lang is not None else "und", 0, ""] += len(g) == 1
    for limit in (1, 12 << 20):
        phrases.SHARD_BYTES, kept = limit, phrases.SHARD_BYTES
        got = Counter()
        for length in (1, 2, 3):
            for out in phrases._counted(length, None)(iter([batch, batch.slice(0, 0)])):
                for r in out.to_pylist():
                    got[r["lang"], r["words"], r["phrase"]] += r["n"]
        phrases.SHARD_BYTES = kept
        assert +got == +want


def test_filter_loses_no_frequent_phrase(spark, monkeypatch):
    rows = corpus(3, 500)
    docs = frame(spark, rows)
    want = Counter()
    for lang, text in rows:
        for g in grams(text, 4):
            want[lang if lang is not None else "und", " ".join(g)] += 1
    for bits in (26, 9):  # the small one lets nearly all through
        monkeypatch.setattr(phrases, "FILTER_BITS", bits)
        got = {(r.lang, r.phrase): r.n for r in phrase_counts(docs, most=4, least=5).where("words > 0").collect()}
        assert got == {k: n for k, n in want.items() if n >= 5}


def test_edges(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [("en", None), (None, "")])).collect() == []
    long = frame(spark, [("en", "a b " * 60000)])
    assert [tuple(r) for r in collocations(long).collect()] == brute([("en", "a b " * 60000)])
    assert phrase_counts(frame(spark, [("en", "A a\ta")])).where("phrase = 'a a'").first().n == 2
