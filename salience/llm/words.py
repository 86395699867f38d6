r"""Words, word hashes and shingle sets of Arrow text columns, for use inside tasks.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count
as a-z. Hashes are computed over the column's bytes at once: with a random number for each byte value and a fixed odd
base, a word's polynomial is the difference of two running sums, shifted back to the word's start; mixing spreads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at once.
STRETCH = 1 << 20
TOKEN_BITS = 50
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_EVEN = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(64 - TOKEN_BITS)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A"):ord("Z") + 1] = _VALUE[ord("a"):ord("z") + 1]
_BASE = 0x2545F4914F6CDD1B  # 3 modulo 8, which keeps powers apart
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
                      for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _powers


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a text column as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each value starts, with the end behind; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads nearby ones."""
    x = x ^ (x >> np.uint64(33))
    x = x * _EVEN
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a text column: 64-bit hashes in order, start bytes, and where each value's words begin."""

    def __init__(self, column: pa.Array):
        raw, offsets = column_bytes(column)
        self.raw, self.offsets = raw, offsets
        inside = ~_SPACE[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(raw))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + STRETCH, "right")))
            piece = raw[base:end[hi - 1]]
            up, down = _power_tables(len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUE[piece] * up[:len(piece)], out=sums[1:])
            a, b = self.start[lo:hi] - base, end[lo:hi] - base
            self.hash[lo:hi] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD[7])
            lo = hi


def shingled(hashes: np.ndarray, width: int, first: np.ndarray | None = None) -> np.ndarray:
    """A hash for every ``width`` consecutive words, or for those that begin at ``first``; the width is part of it."""
    total = np.full(max(0, len(hashes) - width + 1) if first is None else len(first), width, np.uint64)
    for i in range(width):
        total = mixed(total + (hashes[i:i + len(total)] if first is None else hashes[first + i]) * _ODD[i % len(_ODD)])
    return total


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


class TokenSets:
    """Distinct shingles of units of texts, as flat arrays.

    ``row`` and ``line`` tell where a set comes from; ``tokens[starts[i]:starts[i + 1]]`` are its sorted distinct tokens,
    hashes below 2**``TOKEN_BITS``.
    """

    #: Units whose tokens are sorted at once; a token and the number of its unit fit into 63 bits.
    AT_ONCE = 1 << (63 - TOKEN_BITS)

    def __init__(self, row: np.ndarray, line: np.ndarray, owner: np.ndarray, tokens: np.ndarray):
        self.row, self.line = row, line
        # one sort by unit and token: the number of the unit within its stretch goes in front of the token
        marked = ((owner % self.AT_ONCE) << TOKEN_BITS) | tokens
        stretches = np.searchsorted(owner, np.arange(0, len(row) + self.AT_ONCE, self.AT_ONCE))
        parts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (lo, hi) in enumerate(zip(stretches, stretches[1:])):
            some = np.sort(marked[lo:hi])
            if len(some):
                some = some[np.concatenate([[True], some[1:] != some[:-1]])]
                parts.append(some & ((1 << TOKEN_BITS) - 1))
                owners.append((some >> TOKEN_BITS) + i * self.AT_ONCE)
        self.tokens = np.concatenate(parts)
        self.starts = np.searchsorted(np.concatenate(owners), np.arange(len(row) + 1))

    @classmethod
    def of_lines(cls, column: pa.Array, size: int, short: bool = False) -> "TokenSets":
        """Sets of the lines with at least ``size`` words; with ``short``, of all but blank lines, fewer words being one token."""
        words = Words(column)
        breaks = np.flatnonzero(words.raw == 10)
        of_row = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.bounds))
        # lines counted over the whole column, so that a unit is a line of one text; a text starts a line as well
        before = np.searchsorted(breaks, words.start)
        unit = before + of_row
        new = np.ones(len(unit), bool)
        new[1:] = unit[1:] != unit[:-1]
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(unit)))
        row = of_row[at]
        line = before[at] - np.searchsorted(breaks, words.offsets[row])
        kept = (lengths >= size) | short
        number = np.cumsum(kept) - 1
        owner = np.repeat(np.where(kept, number, -1), lengths)
        tokens = (shingled(words.hash, size) >> _SHIFT).astype(np.int64)
        head, tail = owner[:len(tokens)], owner[size - 1:][:len(tokens)]
        inside = (head == tail) & (head >= 0)
        owner, tokens = head[inside], tokens[inside]
        if short:
            few = np.flatnonzero(lengths < size)
            whole = np.zeros(len(few), np.int64)
            for n in range(1, size):
                some = lengths[few] == n
                whole[some] = (shingled(words.hash, n, at[few[some]]) >> _SHIFT).astype(np.int64)
            spot = np.searchsorted(owner, few)
            owner, tokens = np.insert(owner, spot, few), np.insert(tokens, spot, whole)
        return cls(row[kept], line[kept], owner, tokens)

    @classmethod
    def of_texts(cls, column: pa.Array, size: int) -> "TokenSets":
        """One set per text; fewer words than ``size`` are one token, no words none."""
        words = Words(column)
        n = np.diff(words.bounds)
        owner = np.repeat(np.arange(len(n)), n)
        tokens = (shingled(words.hash, size) >> _SHIFT).astype(np.int64)
        head = owner[:len(tokens)]
        inside = head == owner[size - 1:][:len(tokens)]
        short = np.flatnonzero((n > 0) & (n < size))
        whole = [(shingled(words.hash[words.bounds[i]:words.bounds[i + 1]], n[i]) >> _SHIFT).astype(np.int64) for i in short]
        owner = np.concatenate([head[inside], short])
        tokens = np.concatenate([tokens[inside], *whole])
        order = np.argsort(owner, kind="stable")
        return cls(np.arange(len(n)), np.zeros(len(n), np.int64), owner[order], tokens[order])

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row)), self.sizes())

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.starts[i]:self.starts[i + 1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit numbers per set that tell sets apart; 0 for empty ones."""
        spread = mixed(self.tokens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        some = self.starts[:-1] < self.starts[1:]
        out = []
        for add, values in ((np.add, spread), (np.bitwise_xor, mixed(spread * np.uint64(0xD6E8FEB86659FD93)))):
            sums = np.zeros(len(self.row), np.uint64)
            if some.any():
                sums[some] = add.reduceat(values, self.starts[:-1][some])
            out.append(sums.view(np.int64))
        return out[0], out[1]

    def low(self, similarity) -> tuple[np.ndarray, pa.Array]:
        """Low tokens per set, and the tokens that a similarity join may need."""
        sizes, owner = self.sizes(), self.owners()
        n_low = np.bincount(owner[self.tokens < similarity.low], minlength=len(sizes))
        most = np.where(sizes > 0, np.maximum(n_low, similarity.prefix(sizes)), 0)
        keep = np.arange(len(self.tokens)) - self.starts[owner] < most[owner]
        offsets = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
        return n_low, pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.tokens[keep]))
