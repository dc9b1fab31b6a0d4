"""Pre-tokens of whole Arrow text columns without a regular expression.

Code points become classes, classes become transition functions between a few states, and the functions are composed by a
blocked scan: composition is associative, so all blocks of a chunk advance together. The pattern that is followed is that
of the public byte-level tokenizer: contractions; an optional space before letters, numbers or other signs; white space.
"""

from __future__ import annotations

import numpy as np

# fixed values of the public pattern: its contractions, by the number of signs after the apostrophe
AFTER_APOSTROPHE = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}
LETTER, NUMBER, OTHER, WHITE = range(4)
CODE_POINTS = 0x110000

# states between two code points: what the open token may still take
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
# classes of code points in their surroundings: an apostrophe that could open a contraction of two or three signs; a space
# before a sign; other white space before a sign; white space before white space or the end; each also at a row's begin
L, N, O, SHORT, LONG, SPACE, LAST_WHITE, MORE_WHITE = range(8)
ROW_BEGIN = 8
BLOCK = 64


def code_point_classes() -> np.ndarray:
    """The class of every code point, as the public tokenizer's own library sees letters, numbers and white space."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, CODE_POINTS)]))
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[[ord(c) for c in bytes(probe.encode_ordinary(every)).decode()]] = kind
    return table


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a token begins with it."""
    if kind >= ROW_BEGIN:
        return _step(FRESH, kind - ROW_BEGIN)
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if kind in (L, N):
        run = IN_LETTERS if kind == L else IN_NUMBERS
        return run, state not in (run, AFTER_SPACE)
    if kind in (O, SHORT, LONG):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return {O: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind], True
    if kind == MORE_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if kind == SPACE else FRESH), True


NEXT = np.array([[_step(s, k)[0] for k in range(2 * ROW_BEGIN)] for s in range(STATES)], np.uint8)
BEGINS = np.array([[_step(s, k)[1] for k in range(2 * ROW_BEGIN)] for s in range(STATES)], bool)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that runs of code points make of the states, numbered: (their table of compositions, the number of
    each class's function, the states they give). The identity has number 0."""
    functions = [tuple(range(STATES))]
    functions += dict.fromkeys(tuple(NEXT[:, k].tolist()) for k in range(2 * ROW_BEGIN))
    number = {f: i for i, f in enumerate(functions)}
    rows = []
    for f in functions:  # grows while it is walked, until no composition is new
        row = []
        for g in functions[: 1 + 2 * ROW_BEGIN]:
            both = tuple(g[s] for s in f)
            if both not in number:
                number[both] = len(functions)
                functions.append(both)
            row.append(both)
        rows.append(row)
    table = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    own = np.array([number[tuple(NEXT[:, k].tolist())] for k in range(2 * ROW_BEGIN)], np.uint16)
    return table, own, np.array(functions, np.uint8)


COMPOSED, OF_CLASS, GIVES = _monoid()


def _before(functions: np.ndarray) -> np.ndarray:
    """For each position the composition of all functions before it: blocks are composed side by side, their totals are
    scanned in the same way, and each block is walked again from its begin."""
    n, count = len(functions), len(COMPOSED)
    flat = COMPOSED.ravel()
    width = min(BLOCK, n)
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    total = grid[0].astype(np.int32)
    for row in grid[1:]:
        total = flat[total * count + row].astype(np.int32)
    at = _before(total.astype(np.uint16)).astype(np.int32) if blocks > 1 else np.zeros(1, np.int32)
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        out[j] = at
        at = flat[at * count + row].astype(np.int32)
    return out.T.ravel()[:n]


def pretokens(offs: np.ndarray, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens of rows of UTF-8 bytes, and for each row where its tokens begin among them
    (one entry more than rows). Tokens cover every byte. ``table`` is that of ``code_point_classes``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    code = first.astype(np.int32)
    for mask, mark, size in ((0xE0, 0xC0, 2), (0xF0, 0xE0, 3), (0xF8, 0xF0, 4)):
        wide = np.flatnonzero((first & mask) == mark)
        if len(wide):
            value = code[wide] & (0x7F >> size)
            for k in range(1, size):
                value = value << 6 | data[np.minimum(lead[wide] + k, len(data) - 1)] & 0x3F
            code[wide] = np.minimum(value, CODE_POINTS - 1)
    base = table[code]
    begin = np.searchsorted(lead, offs[:-1][offs[:-1] < offs[1:]])
    white = base == WHITE
    following = np.ones(len(code), bool)  # white space or the row's end
    following[:-1] = white[1:]
    following[begin[1:] - 1] = True
    kind = np.where(following, MORE_WHITE, np.where(code == 32, SPACE, LAST_WHITE)).astype(np.uint8)
    np.copyto(kind, base, where=~white)
    quotes = np.flatnonzero(code == 39)
    row_end = np.append(begin, len(code))[np.searchsorted(begin, quotes, "right")]
    for size, endings in AFTER_APOSTROPHE.items():
        at, until = quotes[quotes + size < row_end], (SHORT, LONG)[size - 1]
        for ending in endings:
            hit = np.logical_and.reduce([code[at + 1 + k] == ord(c) for k, c in enumerate(ending)])
            kind[at[hit]] = until
    kind[begin] += ROW_BEGIN
    state = GIVES[_before(OF_CLASS[kind]), FRESH]
    opens = np.flatnonzero(BEGINS[state, kind])
    starts = lead[opens]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)
