"""Source divergence against brute force in whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from colsight.llm import divergence
from colsight.llm.divergence import compare_block, shares, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def brute(rows, least=3, top=200):
    count, docs, groups, out = defaultdict(Counter), defaultdict(Counter), defaultdict(set), []
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(w)
        docs[lang].update(set(w))
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        def p(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        own = {s: p(count[lang, s]) for s in sources}
        q = p(whole)
        for s in sources:
            value = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode()) for o in sources - {s}]
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(value), 1)]
            value = [(-((own[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and own[s][t] > q[t]]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(sorted(value)[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Été", "été", "漢字", "It's", "x1y", "ZZ", " "]
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "", None])
        rows.append((" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "de", "", None]), source))
    return rows + [(None, "en", "empty"), ("", "fr", "only"), ("1 2 3", "it", "x"), ("", "it", "y"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "t", 3) for i, r in enumerate(rows)], SCHEMA)


def test_equals_brute_force(spark):
    rows = corpus(1, 200)
    assert sorted(tuple(r) for r in source_divergence(frame(spark, rows).repartition(3)).collect()) == brute(rows)


def test_blocks_and_chunks_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_CELLS", 20)
    monkeypatch.setattr(divergence, "MOST_CELLS", 20)
    rows = corpus(2, 120)
    assert sorted(tuple(r) for r in source_divergence(frame(spark, rows), least_docs=1, top_terms=5).collect()) == brute(rows, 1, 5)


def test_shares_are_exact():
    rng = random.Random(3)
    for total in (1, 7, 10**9, 8 * 10**15):
        counts = [0, total - 1, *(rng.randrange(total) for _ in range(50))]
        assert shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_runs_give_what_single_terms_give():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.7, (6, 300)) * rng.integers(1, 4, 300)
    totals = counts.sum(axis=1) + 50
    p = [[1 + 10**9 * (int(c) + 1) // (int(t) + 400) for c in row] for row, t in zip(counts, totals, strict=True)]
    want = [[sum((x - y) ** 2 // y for x, y in zip(p[a], p[b], strict=True)) if a != b else 0 for b in range(6)] for a in range(6)]
    assert compare_block(counts, totals, 400).tolist() == want
    assert compare_block(np.zeros((3, 0), np.int64), np.zeros(3, np.int64), 0).tolist() == [[0] * 3] * 3


def test_no_rows(spark):
    assert source_divergence(frame(spark, [])).collect() == []
    assert source_divergence(frame(spark, [("word", "en", "one")])).collect() == []
