"""Words of many UTF-8 texts at once, told apart by a table-driven automaton over bytes.

The texts of a batch lie one after the other in one array of bytes. A machine is three tables: the class of each byte, the state
after a byte of a class, and what a byte of a class marks in a state. Its state after a byte follows from the class of that byte
alone, so all bytes take their step at once. Words are spans of that array; they are never made into strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BETWEEN, INSIDE = 0, 1
#: Bytes of text that are worked on at once; one text at least.
PIECE = 1 << 20
#: Words of more bytes than this are hashed and compared one by one; there are few of them in a text.
LONG = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i] ... starts[i] + sizes[i] - 1`` of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, bytes, bounds)`` of successive texts with about ``most`` bytes; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(column):
        stop = min(max(int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1, start + 1), len(column))
        yield start, stop - start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def steps(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray, moves: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each byte marks, and the state after it. Every text starts ``BETWEEN`` words.

    ``classes``: of the 256 bytes. ``moves``: state after a byte of each class. ``marks``: flags by state before and class.
    """
    kind = classes[data]
    after = moves[kind]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    firsts = bounds[:-1]
    before[firsts[firsts < len(data)]] = BETWEEN
    return marks.ravel()[before * marks.shape[1] + kind], after


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.zeros(len(bounds) - 1, dtype=np.int64)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if len(filled):
        total[filled] = np.add.reduceat(flags, bounds[:-1][filled], dtype=np.int64)
    return total


class Words:
    """Word spans of a piece: ``owner`` (the text), ``begin``, ``size``, and what reads their bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, begins: np.ndarray, after: np.ndarray):
        self.data = data
        last = after == INSIDE
        closes = np.ones(len(data), dtype=bool)
        closes[:-1] = after[1:] == BETWEEN
        closes[bounds[1:][np.diff(bounds) > 0] - 1] = True
        self.begin = np.flatnonzero(begins)
        self.size = np.flatnonzero(last & closes) + 1 - self.begin
        self.owner = np.searchsorted(bounds, self.begin, side="right") - 1
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def lane(self, which: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of some words from byte ``at`` on, zeros behind the word's end."""
        return self.lanes[self.begin[which] + at] & _KEEP[np.minimum(self.size[which] - at, 8)]

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.begin[word] : self.begin[word] + self.size[word]].tobytes()

    def hashes(self) -> np.ndarray:
        h = mixed(self.size.astype(np.uint64) * _ODD)
        rest = np.flatnonzero(self.size <= LONG)
        for at in range(0, LONG, 8):
            rest = rest[self.size[rest] > at]
            if not len(rest):
                break
            h[rest] = mixed(h[rest] * _ODD + self.lane(rest, at))
        for word in np.flatnonzero(self.size > LONG):
            h[word] = int.from_bytes(hashlib.blake2b(self.bytes_of(word), digest_size=8).digest(), "little")
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a[i]`` and ``b[i]`` have the same bytes."""
        equal = self.size[a] == self.size[b]
        rest = np.flatnonzero(equal & (self.size[a] <= LONG))
        for at in range(0, LONG, 8):
            rest = rest[self.size[a[rest]] > at]
            if not len(rest):
                break
            apart = self.lane(a[rest], at) != self.lane(b[rest], at)
            equal[rest[apart]] = False
            rest = rest[~apart]
        for i in np.flatnonzero(equal & (self.size[a] > LONG)):
            equal[i] = self.bytes_of(a[i]) == self.bytes_of(b[i])
        return equal

    def new_in_text(self) -> np.ndarray:
        """Whether a word is the first of its kind in its text: all words go into one hash table with open addressing.

        A slot belongs to the word that came first. A word that meets another in its slot is compared with it byte by byte: if
        they are equal and of one text it is a repetition, else it goes on to the next slot. At most half of the slots fill up.
        """
        n = len(self.begin)
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        table = np.full(mask + 1, -1, dtype=np.int64)
        hashes = self.hashes()
        place = (mixed(hashes + self.owner.astype(np.uint64) * _ODD) & np.uint64(mask)).astype(np.int64)
        new = np.zeros(n, dtype=bool)
        waiting = np.arange(n)
        while len(waiting):
            at = place[waiting]
            free = table[at] < 0
            table[at[free][::-1]] = waiting[free][::-1]
            held = table[at]
            new[waiting[held == waiting]] = True
            known = (self.owner[held] == self.owner[waiting]) & (hashes[held] == hashes[waiting])
            like = np.flatnonzero(known)
            known[like] = self.same(held[like], waiting[like])
            waiting = waiting[~known]
            place[waiting] = (place[waiting] + 1) & mask
        return new
