"""Vectorised pre-tokenisation of byte-level BPE and the cached look-up of the resulting pieces.

No regular expression runs. Every code point is mapped to a symbol by a table; the automaton that tells where a
piece begins is run over all symbols at once: each symbol is an element of the automaton's transition monoid, and
as composition is associative the states at all positions come from a blocked prefix scan over a multiplication
table. Boundaries then follow from the states and the symbols around a position.
"""

from __future__ import annotations

import secrets
import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

# Symbols; adding FIRST marks the first character of a text.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, ONE_LETTER, WANTS_E, WANTS_L, IS_E, N_SYMBOLS = range(11)
FIRST = 10
# States of the automaton after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AT_APOSTROPHE, APOSTROPHE_E, APOSTROPHE_L, CONTRACTED = range(9)
N_STATES = 9
BLOCK = 64

#: Fixed by Unicode: the characters with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Fixed by Unicode 16: first and last code points of the letters and numbers it added to the older data of `unicodedata`.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x16130, 0x16139), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@cache
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for ranges, symbol in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = symbol
    table[WHITE_SPACE] = BLANK
    table[ord(" ")], table[ord("'")] = SPACE, APOSTROPHE
    for letters, symbol in (("stmd", ONE_LETTER), ("rv", WANTS_E), ("l", WANTS_L), ("e", IS_E)):
        table[[ord(c) for c in letters]] = symbol
    return table


def _step(state: int, symbol: int) -> int:
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == OTHER:
        return IN_OTHERS
    if symbol == SPACE:
        return AFTER_SPACE
    if symbol == BLANK:
        return FRESH
    if symbol == APOSTROPHE:  # begins a piece unless a space or a run of other characters takes it in
        return IN_OTHERS if state in (AFTER_SPACE, IN_OTHERS, AT_APOSTROPHE) else AT_APOSTROPHE
    if state == AT_APOSTROPHE:
        return {ONE_LETTER: CONTRACTED, WANTS_E: APOSTROPHE_E, WANTS_L: APOSTROPHE_L}.get(symbol, IN_LETTERS)
    if (state, symbol) in ((APOSTROPHE_E, IS_E), (APOSTROPHE_L, WANTS_L)):
        return CONTRACTED
    return IN_LETTERS


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(element of each symbol, flat multiplication table, state after an element from FRESH, number of elements); 0 is the identity."""
    symbols = [tuple(_step(s, c) for s in range(N_STATES)) for c in range(FIRST)]
    symbols += [tuple([_step(FRESH, c)] * N_STATES) for c in range(FIRST)]
    found = {tuple(range(N_STATES)): 0}
    queue = list(found)
    for f in queue:
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    n = len(found)
    assert n <= 256, "elements must fit a byte"
    times = np.empty(n * n, np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            times[i * n + j] = found[tuple(g[s] for s in f)]
    return np.array([found[g] for g in symbols], np.uint8), times, np.array([f[FRESH] for f in found], np.uint8), n


def states(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state after every position, by an associative scan."""
    element, times, after, n = _monoid()
    rows = -(-len(symbols) // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[: len(symbols)] = element[symbols]
    by_column = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):  # inclusive products inside each block
        by_column[j] = times[by_column[j - 1].astype(np.uint16) * np.uint16(n) + by_column[j]]
    ahead = np.zeros(rows, np.uint8)
    ahead[1:] = by_column[-1][:-1]
    step = 1
    while step < rows:  # inclusive products of the blocks before each block
        ahead[step:] = times[ahead[:-step].astype(np.uint16) * np.uint16(n) + ahead[step:]]
        step *= 2
    whole = after[times[ahead.astype(np.uint16) * np.uint16(n) + by_column]]
    return np.ascontiguousarray(whole.T).reshape(-1)[: len(symbols)]


def piece_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of rows laid end to end begin (every row's first character begins one)."""
    if not len(raw):
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    if len(points) == len(raw):
        at, first_at = None, ends[:-1][np.diff(ends) > 0]
    else:
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        first_at = np.searchsorted(at, ends[:-1][np.diff(ends) > 0])
    symbol = symbol_table()[points]
    first = np.zeros(len(points) + 1, bool)
    first[first_at], first[-1] = True, True
    st = states(symbol + np.uint8(FIRST) * first[:-1])

    before = np.empty_like(st)
    before[0], before[1:] = FRESH, st[:-1]
    before[first_at] = FRESH
    white = (symbol == SPACE) | (symbol == BLANK)
    number, other = symbol == NUMBER, (symbol == OTHER) | (symbol == APOSTROPHE)
    begins = np.ones(len(points), bool)
    # what a space takes in, and runs of one kind, go on
    goes_on = (before == AFTER_SPACE) & ~white
    goes_on |= number & (before == IN_NUMBERS)
    goes_on |= other & ((before == IN_OTHERS) | (before == AT_APOSTROPHE))
    letter = ~(white | number | other)
    goes_on |= letter & ((before == IN_LETTERS) | (before == APOSTROPHE_E) | (before == APOSTROPHE_L))
    # a letter after an apostrophe goes on where the contraction is completed
    i = np.flatnonzero(letter & (before == AT_APOSTROPHE))
    ahead = st[np.minimum(i + 1, len(points) - 1)]
    full = (st[i] == CONTRACTED) | ((st[i] == APOSTROPHE_E) | (st[i] == APOSTROPHE_L)) & (ahead == CONTRACTED) & ~first[i + 1]
    goes_on[i[full]] = True
    # of white space, all but the last character before something else is one piece
    after_white = np.zeros(len(points), bool)
    after_white[1:] = white[:-1]
    after_white[first_at] = False
    last = np.empty(len(points), bool)
    last[:-1] = ~white[1:]
    last[-1] = False
    last &= ~first[1:]
    goes_on |= white & after_white & ~last
    begins &= ~goes_on
    out = np.flatnonzero(begins)
    return out if at is None else at[out]


class PieceCache:
    """Numbers of distinct pieces, and the token ids of each number, merged once and kept.

    Pieces of up to 16 bytes, nearly all, stand in arrays: a table with open addressing, by a hash whose factors are drawn for
    each cache, so that no text is written to crowd it. A dictionary has the longer ones.

    merge: the ids of each piece of a list. keep: the number of distinct pieces held; beyond it those that came only once go,
    or all if that isn't enough, which costs time only.
    """

    def __init__(self, merge: Callable[[list[bytes]], list[list[int]]], keep: int = 1 << 18):
        self.merge, self.keep = merge, keep
        self.factors = np.frombuffer(secrets.token_bytes(24), "<u8") | np.uint64(1)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.begin, self.used, self.count = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0
        self.again = np.zeros(1 << 14, bool)  # what came more than once
        self._table(1 << 15)

    def _table(self, slots: int) -> None:
        """An empty table; a size of 0 tells a free slot."""
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.at = np.zeros(slots, np.uint8), np.zeros(slots, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b, c = self.factors
        return ((low * a + high * b + size.astype(np.uint64) * c) >> np.uint64(65 - len(self.size).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of short pieces, -1 for those that the table hasn't got."""
        out, slot, live = np.full(len(low), -1, np.int64), self._slots(low, high, size), np.arange(len(low))
        while len(live):
            there = self.size[slot]
            same = (there == size[live]) & (self.low[slot] == low[live]) & (self.high[slot] == high[live])
            out[live[same]] = self.at[slot[same]]
            on = (there != 0) & ~same
            live, slot = live[on], slot[on] + 1 & len(self.size) - 1
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> None:
        """Adds short pieces under new numbers."""
        slots, n = len(self.size), int(np.count_nonzero(self.size)) + len(low)
        if 4 * n > 3 * slots:  # at most three quarters are taken
            full = np.flatnonzero(self.size)
            low, high, size, numbers = (np.concatenate(x) for x in ((self.low[full], low), (self.high[full], high), (self.size[full], size), (self.at[full], numbers)))
            self._table(1 << (4 * n // 3).bit_length())
        slot, live = self._slots(low, high, size), np.arange(len(low))
        while len(live):
            free = np.flatnonzero(self.size[slot] == 0)
            self.at[slot[free]] = numbers[live[free]]
            won = free[self.at[slot[free]] == numbers[live[free]]]  # of several at one slot the last written
            at, i = slot[won], live[won]
            self.low[at], self.high[at], self.size[at] = low[i], high[i], size[i]
            on = np.ones(len(live), bool)
            on[won] = False
            live, slot = live[on], slot[on] + 1 & len(self.size) - 1

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """New numbers of pieces, which are merged together."""
        merged = self.merge(pieces)
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        n, more = self.count, int(sizes.sum())
        while n + len(pieces) + 2 > len(self.begin):
            self.begin, self.again = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.again, np.zeros_like(self.again)])
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + more] = np.fromiter(chain.from_iterable(merged), np.int32, more)
        self.begin[n + 1 : n + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += more
        self.count += len(pieces)
        return np.arange(n, self.count)

    def _forget(self) -> None:
        """Keeps the pieces that came more than once, if these leave room; the rest starts anew."""
        full = np.flatnonzero(self.size)
        full = full[self.again[self.at[full]]]
        if 2 * len(full) > self.keep:
            self._clear()
            return
        low, high, size, old = self.low[full], self.high[full], self.size[full], self.at[full]
        begin, count = self.begin[old], self.begin[old + 1] - self.begin[old]
        until = np.cumsum(count)
        ids = self.ids[np.arange(int(count.sum())) + np.repeat(begin - (until - count), count)]
        self._clear()
        self.ids, self.used, self.count = np.concatenate([ids, self.ids]), len(ids), len(old)
        self.begin = np.concatenate([[0], until, np.zeros_like(self.begin)])
        self.again = np.zeros(len(self.begin), bool)
        self._put(low, high, size, np.arange(len(old)))

    def numbers(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each piece. Pieces of up to 16 bytes are grouped by their very bytes before the look-up."""
        if self.count > self.keep:
            self._forget()
        data, size = raw.tobytes(), stops - starts
        out = np.empty(len(starts), np.int64)

        def cut(a: np.ndarray, b: np.ndarray) -> list[bytes]:
            return [data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]

        short = np.flatnonzero(size <= 16)
        if len(short):
            padded = np.frombuffer(data + bytes(16), np.uint8)
            eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
            masks = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
            masks = np.append(masks, np.uint64(0xFFFFFFFFFFFFFFFF))
            s, n = starts[short], size[short]
            low = eight[s] & masks[np.minimum(n, 8)]
            high = eight[s + 8] & masks[np.maximum(n - 8, 0)]
            key = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ n.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            bits = np.uint64(max(1, int(len(short) - 1).bit_length()))
            packed = np.sort((key >> bits << bits) | np.arange(len(short), dtype=np.uint64))
            order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            low, high, n = low[order], high[order], n[order]
            new = np.ones(len(order), bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (n[1:] != n[:-1])
            lead = np.flatnonzero(new)
            low, high, n, a = low[lead], high[lead], n[lead].astype(np.uint8), s[order[lead]]
            found = self._find(low, high, n)
            self.again[found[found >= 0]] = True
            fresh = np.flatnonzero(found < 0)
            if len(fresh):
                found[fresh] = self._add(cut(a[fresh], a[fresh] + n[fresh]))
                self._put(low[fresh], high[fresh], n[fresh], found[fresh])
            out[short[order]] = found[np.cumsum(new) - 1]
        long = np.flatnonzero(size > 16)
        if len(long):
            pieces = cut(starts[long], stops[long])
            fresh = [p for p in dict.fromkeys(pieces) if p not in self.number]
            if fresh:
                self.number.update(zip(fresh, self._add(fresh).tolist(), strict=True))
            out[long] = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        return out

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, n + 1 offsets of the rows' ids, byte offset of each piece, its number of ids)."""
        starts = piece_starts(raw, ends)
        stops = np.append(starts[1:], len(raw)) if len(starts) else starts
        numbers = self.numbers(raw, starts, stops)
        begin = self.begin[numbers]
        count = self.begin[numbers + 1] - begin
        until = np.cumsum(count)
        total = int(until[-1]) if len(until) else 0
        ids = self.ids[np.arange(total) + np.repeat(begin - (until - count), count)]
        first_piece = np.searchsorted(starts, ends)
        return ids, np.concatenate([[0], until])[first_piece], starts, count
