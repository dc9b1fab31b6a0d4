"""Operators on texts against brute force, and their edge rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsight.llm.decontaminate import contamination
from colsight.llm.jaccard import jaccard_groups
from colsight.llm.licenses import TEXTS, license_scan
from colsight.llm.packing import pack, solve
from colsight.llm.quality import fit, fit_quality, score_quality
from colsight.llm.wordpiece import END, Automaton, count_pieces, vocabulary

SCHEMA = "doc_id long, text string, node long, token string, n long"


def docs(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], SCHEMA)


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows, n, percent):
    own = {i: sets(t, n) for i, t in rows}
    comp = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                o = len(own[a] & own[b])
                if o and 100 * o >= percent * len(own[a] | own[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(own[i]), comp[i]) for i in own}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows, at = [], 0
    for _ in range(12):
        base = words_of(rng, rng.choice([3, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = [w if rng.random() > 0.01 else "edit" for w in base]
            rows.append((at, " \n".join(copy)))
            at += 1
    rows += [(at, ""), (at + 1, None), (at + 2, " \t\n"), (at + 3, "One two"), (at + 4, "one\ttwo"), (at + 5, "one"), (at + 6, rows[0][1])]
    got = {r[0]: (r[1], r[2]) for r in jaccard_groups(docs(spark, rows).repartition(3), words=n, percent=percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_jaccard_is_exact_at_the_threshold_of_very_long_texts():
    from colsight.llm.jaccard import _linked
    from colsight.llm.shared import Links

    common = np.arange(90_729, dtype=np.uint64)
    for own, other, links in ((8_005, 8_006, True), (8_006, 8_006, False)):  # 100 x 90,729 = 85 x 106,740
        sets = [np.concatenate((common, np.arange(n, dtype=np.uint64) + np.uint64(k << 20))) for n, k in ((own, 1), (other, 2))]
        found = Links(2)
        _linked(sets, 85, found, np.arange(2), None)
        assert (found.roots()[1] == 0) == links


@pytest.mark.parametrize("seed", range(6))
def test_derived_answers_equal_counted_ones(seed):
    from colsight.llm.jaccard import _linked
    from colsight.llm.shared import Links

    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(8):
        base = rng.choice(4000, rng.integers(3, 120), replace=False)
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate((keep, rng.choice(4000, rng.integers(0, 5))))).astype(np.uint64))
    sets = [s for s in sets if len(s)]
    n, percent = len(sets), int(rng.choice([60, 80, 85, 100]))
    link = [[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets]
    half = rng.permutation(n)[: n // 2]
    for rows, cols in ((np.arange(n), None), (np.sort(half), np.setdiff1d(np.arange(n), half))):
        want, got = Links(n), Links(n)
        for i in rows:
            for j in rows if cols is None else cols:
                if link[i][j]:
                    want.join(np.array([i]), np.array([j]))
        _linked(sets, percent, got, rows, cols)
        assert got.roots().tolist() == want.roots().tolist()


def test_pages_of_one_template_are_not_paired(spark):
    """Pages that share most words in one order but link with none: list tails are skipped, not paired."""
    rng = random.Random(2)
    head = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, head + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(12))) for i in range(600)]
    rows += [(i + 1000, t.replace("menu3 ", "menu3 x ")) for i, t in rows[:20]]
    got = {r[0]: r[2] for r in jaccard_groups(docs(spark, rows)).collect()}
    want = brute_groups([r for r in rows if r[0] % 1000 < 25], 4, 85)
    assert {i: got[i] for i in want} == {i: c for i, (_, c) in want.items()}
    assert all(got[i] == i for i, _ in rows[20:600])


def test_jaccard_star_of_copies_and_empty_table(spark):
    rng = random.Random(5)
    base = words_of(rng, 150, 10**6)
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(150)] = f"edit{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = {r[0]: (r[1], r[2]) for r in jaccard_groups(docs(spark, rows)).collect()}
    assert got == brute_groups(rows, 4, 85)
    assert jaccard_groups(docs(spark, [])).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    got = sorted(map(tuple, jaccard_groups(docs(spark, [(3, text), (3, text), (9, text), (None, text), (5, "b")])).collect()), key=str)
    assert got == sorted([(3, 27, 3), (3, 27, 3), (9, 27, 3), (None, 27, None), (5, 1, 5)], key=str)


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(i, " ".join(words_of(rng, rng.choice([0, 1, 50, 400, 900, 4000])))) for i in range(60)] + [(100, None), (101, ""), (102, "Häß x <|endoftext|> 'S"), (102, "again"), (None, "no id")]
    out = pack(docs(spark, rows).repartition(4)).toPandas()
    assert list(out.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in rows:
        if i is None or i == 102:
            continue
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2])
        at = 0
        for r in out[out.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert zlib.crc32(ids[r.start : at].astype("<u4").tobytes()) == r.ids_crc32
        assert at == len(ids)
    assert len(out[out.doc_id.isna()]) == 1 and len(out[out.doc_id == 102]) == 2
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (by.cumsum() - by.obj == out.sort_values(["sequence_id", "offset"]).offset).all()
    total = by.sum()
    assert total.max() <= 4096 and set(total.index) == set(range(len(total)))
    assert pack(docs(spark, [])).count() == 0


def test_patterns_take_no_more_than_there_is():
    counts = np.random.default_rng(0).integers(0, 300, 64)
    plan = solve(counts, 64)
    taken = sum(times * p for p, times in plan)
    size = np.arange(1, 65)
    assert (taken <= counts).all() and all((p * size).sum() <= 64 for p, _ in plan)
    assert sum(times for _, times in plan) <= (taken * size).sum() / 64 * 1.05 + 1
    assert (taken * size).sum() > 0.95 * (counts * size).sum()


def test_word_pieces_equal_longest_match(spark):
    import public_tokenizers

    pieces = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    longest = max(map(len, pieces))

    def count(word):
        s, i, n = [*word, END], 0, 0
        while i < len(s):
            j = next(j for j in range(min(len(s), i + longest), i, -1) if tuple(s[i:j]) in pieces)
            n, i = n + (s[i:j] != [END]), j
        return n

    rng = random.Random(4)
    words = [bytes(rng.choice(b"abethinoresd%.,\xc3\xa9") for _ in range(rng.randint(1, 25))) for _ in range(500)]
    assert Automaton(pieces).counts(words).tolist() == [count(w) for w in words]
    rows = [(0, "The Éclair, the\n\tunbelievable  thing"), (1, None), (2, ""), (3, "a" * 5000)]
    got = {r.doc_id: (r.n_words, r.n_pieces) for r in count_pieces(docs(spark, rows)).collect()}
    assert got[0] == (5, sum(count(w.encode()) for w in ["the", "Éclair,", "the", "unbelievable", "thing"]))
    assert got[1] == got[2] == (0, 0) and got[3] == (1, count(b"a" * 5000))
    with pytest.raises(ValueError):
        count_pieces(docs(spark, rows).withColumn("n_words", F.lit(1)))


def test_quality_learns_and_handles_edges(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = words_of(rng, 80, 5000)
        rows.append((i, " ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(i % 3 > 0)))
    table = docs(spark, [*rows, (900, None), (901, ""), (902, "x" * 300_000)])
    model = fit_quality(table, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int"))
    got = {r.doc_id: r.quality_score for r in score_quality(table, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels) and all(0 <= s <= 1 for s in got.values())
    none = fit(np.zeros((0, 20)), np.zeros(0))
    assert none.score(np.zeros((2, 20))).tolist() == [0.5, 0.5]
    assert score_quality(docs(spark, []), none).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(float)
    score = fit(x, y).score(x)
    assert ((score > 0.5) == y).mean() > 0.9


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words_of(rng, 20, 3000)) + ".\n" + " ".join(words_of(rng, 6, 3000))) for i in range(30)] + [(90, None), (91, ""), (None, "q"), (92, "ab cd")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(60):
        own = words_of(rng, 200, 3000)
        if i < 30:
            at = rng.randrange(200)
            own[at:at] = items[i][1].upper().split()
        rows.append((i, " ".join(own)))
    rows += [(100, items[4][1].split("\n")[0]), (101, None), (102, ""), (103, "cd. AB\ncd x"), (104, f"ÉA {items[5][1]}")]
    got = {r.doc_id: r.bench_items for r in contamination(docs(spark, rows), table).collect()}
    assert all(i in got[i] for i in range(30)) and not any(got[i] for i in range(30, 60))
    assert got[101] == got[102] == [] and got[103] == [92] and got[104] == [5]
    assert not any(r.contaminated for r in contamination(docs(spark, rows), table.where("item_id < 0")).collect())


def test_license_scan(spark):
    text = TEXTS["MIT"]
    changed = text.replace("2000 holder", "1999-2020 Somebody Else").upper().replace(",", " ;").replace("LICENSE", "LICENCE")
    rows = [(0, text), (1, changed), (2, text + " more"), (3, "Words.\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0."), (4, None), (5, ""), (5, text)]
    got = sorted((r.doc_id, r.license or "", r.notices) for r in license_scan(docs(spark, rows)).collect())
    assert got == [(0, "MIT", ""), (1, "MIT", ""), (2, "", ""), (3, "", "CC-BY-NC-4.0,MIT"), (4, "", ""), (5, "", ""), (5, "MIT", "")]


def test_word_ids_equal_those_of_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from colsight.llm.tokens import word_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(1)
    signs = "abcXYZ019'\"!<|>.,-_\x00\x1c\x7f\n\t \x85 éÉß́ΣİΩ漢字²½"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["it's we'll I'D 'RE ''s '''ll <|endoftext|>x a<|endoftext|>b <|ENDOFTEXT|>", "", "'", None]
    got = [ids.tolist() for _, rows in word_ids(path).rows(pa.array(texts, pa.string())) for ids in rows]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_latin_letters_are_cut_and_encoded_together():
    """Letters of U+00C0 to U+00FF count as letters: such words need no call of their own, and their ids stay."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from colsight.llm.tokens import is_odd, word_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["".join(chr(c) for c in range(0xC0, 0x100)), "Ärger, Übermaß2× déjà÷vu", "e\u0301 \u00e9 É\u0301", "ÿ<|endoftext|>ÿ", "l'été \u00aa\u00b5\u00ba", "Ã\u00a0Ã", "\u0080\u00ad"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for _, rows in word_ids(path).rows(pa.array(texts, pa.string())) for ids in rows] == want
    assert [is_odd(x) for x in ("Übermaß", "×", "l'été", "e\u0301", "a<|")] == [False, True, True, True, True]


def test_tasks_of_the_join_give_their_memory_back(monkeypatch):
    from colsight.llm import jaccard, shared

    kept, given = shared.held_by_worker({"words": 1}), []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(dict(kept)))
    batch = pa.record_batch({"id": pa.array([1, 2]), "text": pa.array(["a b c d e", "a b c d e f"])})
    assert sum(len(b) for b in jaccard._sketch(3)(iter([batch, batch]))) >= 4
    assert given == [{}, {}]  # what others kept went first, its own memory at the end
    shared._held.remove(kept)
