"""Byte-level BPE against the public library, and its edge rows."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from colsight.llm.bytebpe import LONG_SLICE, Ranks, bpe_digest, decode, encode
from colsight.llm.pretokens import BEGINS, COMPOSED, FRESH, GIVES, NEXT, OF_CLASS, _before, code_point_classes, pretokens
from colsight.llm.words import chunks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=3, n=300):
    rng = random.Random(seed)
    signs = ["'", "'s", "'re", "'ve", "'S", " ", " ", "  ", "\n", "\t", " ", "　", "a", "word", "Zeit", "é", "1", "²", "٣", "!", "-", "漢字", "😀", "́", "​", "<|endoftext|>"]
    odd = [None, "", " ", "\n\n", "it's", "'", "''s", " 's", "x" * 5000, " " * 3000, "9" * 200, "ab" * 1500, "'" * 99, "a\x00b", "they'll've", "\r\n \r\n", "word " * 20000]
    return odd + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_scan_composes_step_by_step():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 4097, 9000):
        kinds = rng.integers(0, 16, n)
        state, want = FRESH, []
        for k in kinds:
            want.append(state)
            state = NEXT[state, k]
        assert GIVES[_before(OF_CLASS[kinds]), FRESH].tolist() == want
    a, b, c = rng.integers(0, len(COMPOSED), (3, 500))
    assert (COMPOSED[COMPOSED[a, b], c] == COMPOSED[a, COMPOSED[b, c]]).all()
    assert BEGINS.shape == NEXT.shape


def test_pretokens_cover_all_bytes_and_equal_the_pattern():
    regex = pytest.importorskip("regex")
    table, column = code_point_classes(), pa.array(texts(), pa.string())
    for first, offs, data in chunks(column):
        starts, ends, at = pretokens(offs, data, table)
        assert starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(data)
        for i in range(len(offs) - 1):
            got = [data[a:b].tobytes().decode() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)]
            assert got == regex.findall(public_tokenizers.PATTERN, column[first + i].as_py() or "")


def test_merges_equal_the_library_on_both_sides_of_the_length_limit(library):
    ranks, rng = Ranks(PATH), random.Random(8)
    pieces = [bytes(rng.choice(b"abcehinorst\xc3\xa9") for _ in range(n)) for n in (1, 2, 7, LONG_SLICE, LONG_SLICE + 1, 900) for _ in range(30)]
    ids, size = ranks.merge(pieces)
    at = np.concatenate(([0], np.cumsum(size)))
    for i, piece in enumerate(pieces):
        assert ids[at[i] : at[i + 1]].tolist() == ([ranks.rank[piece]] if piece in ranks.rank else library._encode_single_piece(piece))


def test_encode_decode_round_trip(spark, library):
    rows = [(i if i % 7 else None, t, "en", 1) for i, t in enumerate([*texts(), "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    encoded = encode(docs)
    assert encoded.columns == ["doc_id", "ids", "ends"]
    want = sorted((i or -1, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    got = encoded.collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == want
    for r in got:
        text = b"".join(library.decode_single_token_bytes(i) for i in r.ids)
        assert [text[a:b] for a, b in zip([0, *r.ends[:-1]], r.ends, strict=False)] == [library.decode_single_token_bytes(i) for i in r.ids]
    back = sorted(bytes(r.decoded) for r in decode(encoded).collect())
    assert back == sorted((t or "").encode() for _, t, *_ in rows)
    digests = sorted(tuple(r) for r in bpe_digest(docs).where("doc_id is not null").collect())
    assert digests == sorted(
        (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows if i is not None for ids in [library.encode_ordinary(t or "")]
    )


def test_no_rows_null_ids_and_unknown_ids(spark):
    assert bpe_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([("a", None), ("b", [])], "doc_id string, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in decode(odd).collect()) == [("a", None), ("b", b"")]
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([("a", [10**6])], "doc_id string, ids array<int>")).collect()
