"""Token boundaries of many texts at once, by codepoint classes and an associative scan instead of a regex.

The boundaries are those of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Every codepoint becomes a symbol (its class, with what can be seen one or two places ahead); a symbol is a function
from the state before it to the state after it.  Functions compose associatively, so a row of 64 symbols is composed
column by column over all rows at once, the rows' functions are folded into each row's entry state, and a second
sweep reads off which symbols begin a token.
"""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, OTHER, BLANK, QUOTE2, QUOTE3, ATTACHED, LAST, END = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_MORE, TWO_MORE, FRESH = range(8)
ROW = 64


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]."""
    after = np.empty((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for symbol, run in runs.items():
        after[symbol] = run
        starts[symbol, [run, AFTER_SPACE]] = False
    after[LETTER, TWO_MORE], after[LETTER, ONE_MORE] = ONE_MORE, FRESH
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    after[BLANK], after[LAST], after[END], after[ATTACHED] = IN_BLANKS, FRESH, FRESH, AFTER_SPACE
    starts[BLANK, IN_BLANKS] = False
    for symbol, state in ((QUOTE2, ONE_MORE), (QUOTE3, TWO_MORE)):
        after[symbol] = state
        for joined in (IN_OTHERS, AFTER_SPACE):
            after[symbol, joined] = IN_OTHERS
            starts[symbol, joined] = False
    return after, starts


AFTER, STARTS = _machine()


@functools.cache
def classes() -> np.ndarray:
    """The class of every codepoint: letter, number, white space or other."""
    import regex
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for match in regex.finditer(pattern, everything):
            first, last = (ord(match[0][k]) for k in (0, -1))
            if last - first + 1 == len(match[0]):
                out[first:last + 1] = kind
            else:
                out[[ord(c) for c in match[0]]] = kind
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of codepoints; `ends` are the places of the separators between texts."""
    kind = classes()[points]
    kind[ends] = END
    n = len(points)
    solid = np.zeros(n, bool)
    solid[:-1] = kind[1:] < BLANK
    out = kind.copy()
    blank = (kind == BLANK) & solid
    out[blank] = LAST
    out[blank & (points == 0x20)] = ATTACHED
    at = np.flatnonzero(points == 0x27)
    one, two = (points[np.minimum(at + k, n - 1)] for k in (1, 2))
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
    for first, second in ("re", "ve", "ll"):
        out[at[(one == ord(first)) & (two == ord(second))]] = QUOTE3
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Which symbols begin a token (the separators themselves are marked as well)."""
    n = len(symbol)
    rows = -(-n // ROW)
    padded = np.full(rows * ROW, END, np.uint8)
    padded[:n] = symbol
    column = np.ascontiguousarray(padded.reshape(rows, ROW).T) * np.uint8(8)
    flat = AFTER.ravel()
    states = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(ROW):
        states = flat[column[j][:, None] + states]
    entry = _entries(states)
    begins = np.empty((ROW, rows), bool)
    held = STARTS.ravel()
    for j in range(ROW):
        at = column[j] + entry
        begins[j] = held[at]
        entry = flat[at]
    return begins.T.ravel()[:n]


def _entries(functions: np.ndarray) -> np.ndarray:
    """The state in which each row begins: an exclusive scan of the rows' functions, doubling its reach."""
    scanned, reach = functions.copy(), 1
    while reach < len(scanned):
        scanned[reach:] = np.take_along_axis(scanned[reach:], scanned[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[FRESH], scanned[:-1, FRESH]]).astype(np.uint8)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(joined UTF-8, byte offset of every token start and of the end, index of each text's first token).

    The texts are joined by one byte that belongs to no token; a text's tokens are
    offsets[first[k]] .. offsets[first[k + 1]], whose last is its separator.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = token_starts(symbols(points, ends))
    begins[ends] = True
    width = np.ones(len(points), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += points >= limit
    place = np.cumsum(width) - width
    tokens = np.flatnonzero(begins)
    first = np.concatenate([[0], np.searchsorted(tokens, ends) + 1])
    return joined.encode(), np.append(place[tokens], place[-1] + 1), first
