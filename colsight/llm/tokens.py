"""Values of words, looked up once per task for each distinct word, and token ids as such values.

Whitespace-separated words of a batch are numbered by hash; each new one is valued (encoded, counted) once and kept, up to
a bound beyond which the words used longest ago go.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from colsight.llm.shared import held_by_worker
from colsight.llm.words import U, chunks, hashes, mix, split

KEPT_WORDS = 300_000
KEPT_VALUES = 4_000_000
"""Words, and integers of them, that a Python worker keeps; beyond it those used longest ago go."""
VALUED_AT_ONCE = 10_000
# fixed values of the public word tokenizer: its split (of lower-cased text) and its mark at the end of a split part
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PART_END = "</w>"
NORMAL = ["NFC", "Replace", "Lowercase"]
_MOVED = [*range(33), *range(127, 161), 173]
BYTE_SIGNS = "".join(chr(256 + _MOVED.index(b) if b in _MOVED and b != 32 else b) for b in range(256))
"""The sign of each byte in a byte-level vocabulary, except that of the space."""
LETTER, DIGIT, ODD = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[39, *range(128, 256)]] = ODD
LATIN_LEAD, NO_LETTERS = 0xC3, (0x97, 0xB7)
"""UTF-8 of U+00C0 to U+00FF begins with this byte; two signs among them, by their second bytes, are no letters."""
NOT_PLAIN = re.compile("'|<\\||[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
CASED = mix(np.arange(256, dtype=U) + U(0xA0761D6478BD642F))


def is_odd(text: str) -> bool:
    """Whether a word stays whole: with an apostrophe, beyond ASCII and the letters of Latin-1 (composed, and lower-cased
    one by one), or with what may begin a special token."""
    return NOT_PLAIN.search(text) is not None


def parts(offs: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into runs of letters, single digits and runs of others, except odd ones; as ``split`` returns them."""
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == LATIN_LEAD)
    lead = lead[~np.isin(data[lead + 1], NO_LETTERS)]
    kind[lead] = kind[lead + 1] = LETTER
    odd = kind == ODD
    special = np.zeros(len(data), bool)
    special[:-1] = (data[:-1] == 60) & (data[1:] == 124)
    special[ends - 1] = False  # the next byte is another word's, perhaps of the next row
    odd |= special
    odd = np.concatenate(([0], np.cumsum(odd)))
    whole = odd[ends] > odd[starts]
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
    word = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[(word >= 0) & (cuts > starts[word]) & (cuts < ends[word]) & ~whole[word]]
    starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(starts, offs)


def _grown(buffer: np.ndarray, used: int, more: int) -> np.ndarray:
    """The buffer itself, or one of at least twice its size that begins with what is used."""
    if used + more <= len(buffer):
        return buffer
    out = np.zeros(max(2 * len(buffer), used + more), buffer.dtype)
    out[:used] = buffer[:used]
    return out


class WordValues:
    """Arrays of integers for words: ``value`` maps a list of words (bytes) to all their integers in order and to how many
    each has. Beyond ``KEPT_WORDS`` words or ``KEPT_VALUES`` integers those used last stay, half of the bound."""

    def __init__(self, value: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], by_parts: bool = False):
        self.value, self.by_parts = value, by_parts
        self.number: dict[int, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.keys, self.used = np.zeros(1 << 14, U), np.zeros(1 << 14, np.int64)
        self.clock = 0

    def _forget(self) -> None:
        n = len(self.number)
        if n <= KEPT_WORDS and self.ends[n] <= KEPT_VALUES:
            return
        last = np.argsort(-self.used[:n], kind="stable")[: KEPT_WORDS // 2]
        size = np.diff(self.ends[: n + 1])[last]
        stay = last[np.cumsum(size) <= KEPT_VALUES // 2]
        flat, until = self._of(stay)
        self.flat[: len(flat)] = flat
        self.ends[: len(until)] = until
        self.keys[: len(stay)], self.used[: len(stay)] = self.keys[stay], self.used[stay]
        self.number = dict(zip(self.keys[: len(stay)].tolist(), range(len(stay)), strict=True))

    def _numbers(self, codes: np.ndarray, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._forget()
        self.clock += 1
        keys = word.tolist()
        known = np.array([self.number.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            first = np.empty(len(word), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            first = first[new]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            values, sizes = zip(*(self.value(texts[i : i + VALUED_AT_ONCE]) for i in range(0, len(texts), VALUED_AT_ONCE)), strict=True)
            size, base = np.concatenate(sizes), len(self.number)
            total = int(self.ends[base])
            self.flat = _grown(self.flat, total, int(size.sum()))
            self.flat[total : total + size.sum()] = np.concatenate(values)
            self.ends = _grown(self.ends, base + 1, len(new))
            self.ends[base + 1 : base + 1 + len(new)] = total + np.cumsum(size)
            self.keys, self.used = _grown(self.keys, base, len(new)), _grown(self.used, base, len(new))
            self.keys[base : base + len(new)] = word[new]
            known[new] = np.arange(base, base + len(new))
            self.number.update(zip(word[new].tolist(), known[new].tolist(), strict=True))
        self.used[known] = self.clock
        return known

    def _of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[number]
        size = self.ends[number + 1] - begin
        until = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(until[-1]) + np.repeat(begin - until[:-1], size)], until

    def gather(self, codes: np.ndarray, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's integers begin (one more than words) and the integers; ``codes`` number the words by the distinct
        hashes ``word``, and ``starts``, ``ends`` say where each lies in ``data``."""
        flat, until = self._of(self._numbers(codes, word, data, starts, ends)[codes])
        return until, flat

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, where each row's values begin, one more than rows; the values) for runs of rows."""
        for first, offs, data in chunks(column):
            starts, ends, at = split(offs, data)
            if self.by_parts:
                starts, ends, at = parts(offs, data, starts, ends)
            if len(starts):
                codes, word = pd.factorize(hashes(data, starts, ends, CASED))
                until, flat = self.gather(codes, word, data, starts, ends)
                yield first, until[at], flat
            else:
                yield first, np.zeros(len(offs), np.int64), self.flat[:0]

    def rows(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, the values of all words of each row in order) for runs of rows."""
        for first, at, flat in self.runs(column):
            yield first, [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_HELD: dict[str, WordValues] = held_by_worker({})


def word_ids(path: str) -> WordValues:
    """Token ids of words by a tokenizer that neither joins words over white space nor marks where they stand.

    With the public word tokenizer, plain words are cut into its parts first; distinct parts are encoded many in one call.
    All other words are encoded one by one. A Python worker keeps them from task to task.
    """
    if path in _HELD:
        return _HELD[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task its core
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    spec = json.loads(held.to_str())
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    by_parts = (first.get("pattern") or {}).get("Regex") == SPLIT and spec["model"].get("end_of_word_suffix") == PART_END and normal == NORMAL
    # plain parts are lower-cased and written in the signs of the byte-level vocabulary here, so the model alone is asked
    parts_only = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
    model = Tokenizer.from_str(json.dumps(spec | parts_only)) if by_parts else held
    vocabulary = held.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for piece, i in vocabulary.items() if piece.endswith(PART_END)]] = True

    def value(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = np.array([not by_parts or is_odd(t) for t in texts])
        plain = [texts[i] for i in np.flatnonzero(~odd)]
        raw = " ".join(plain).lower().encode()
        ids = np.array(model.encode_batch_fast([codecs.charmap_decode(raw, "strict", BYTE_SIGNS)[0]], add_special_tokens=False)[0].ids, np.int32)
        alone = [e.ids for e in held.encode_batch_fast([texts[i] for i in np.flatnonzero(odd)], add_special_tokens=False)]
        size = np.zeros(len(texts), np.int64)
        size[~odd] = np.diff(np.flatnonzero(last[ids]), prepend=-1)
        size[odd] = [len(x) for x in alone]
        out, one = np.zeros(size.sum(), np.int32), np.repeat(odd, size)
        out[~one], out[one] = ids, [i for x in alone for i in x]
        return out, size

    _HELD[path] = WordValues(value, by_parts)
    return _HELD[path]
