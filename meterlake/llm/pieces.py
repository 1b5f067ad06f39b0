"""Texts cut into pieces by classes of characters, a whole Arrow batch at once, and numbers for distinct pieces.

A batch of texts is one run of UTF-8 bytes.  Every byte gets the class of its character, pieces begin where classes
change, and Arrow finds the distinct pieces, so Python handles each of these once a batch and numpy does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, WHITE = range(4)
#: Bytes that are cut together; distinct pieces, and their numbers, that a worker remembers before it starts anew.
SLICE, PIECES, POOL = 4 << 20, 250_000, 2_000_000


@lru_cache
def character_classes() -> np.ndarray:
    """The class of every code point as the tokenizers library's own patterns see it, whatever Unicode Python follows."""
    from tokenizers import Regex, normalizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, others in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (WHITE, r"\S+")):
        left = normalizers.Replace(Regex(others), "").normalize_str(every)
        out[np.frombuffer(left.encode("utf-32-le"), np.uint32)] = kind
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and the offsets of the texts in them; nulls are empty."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def classes_of(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8: that of its character."""
    out = table[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
        kind = table[code]
        out[lead] = kind
        for k in (1, 2, 3):
            out[lead[size > k] + k] = kind[size > k]
    return out


def begins(data: np.ndarray, kinds: np.ndarray, starts: np.ndarray, joined_space: bool, single_numbers: bool, endings: bool) -> np.ndarray:
    """For each byte whether a piece begins there.  starts: where texts begin.

    joined_space: a space goes with what follows it, and other white space is cut before its last character.
    single_numbers: each number is a piece.  endings: 's, 't, 're, 've, 'm, 'll and 'd are pieces of their own.
    """
    n = len(data)
    out = np.ones(n, bool)
    if not n:
        return out
    out[1:] = kinds[1:] != kinds[:-1]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    out[first[:n]] = True
    if single_numbers:
        out |= (kinds == NUMBER) & ((data & 0xC0) != 0x80)
    if joined_space:
        after = np.flatnonzero((kinds[1:] != WHITE) & (kinds[:-1] == WHITE) & ~first[1:n]) + 1
        space = data[after - 1] == 0x20
        out[after[space]] = False
        last = after - 1
        for _ in range(2):
            last = last - ((data[last] & 0xC0) == 0x80)
        out[last] = True
    if endings:
        at = np.flatnonzero(data[:-1] == 0x27)
        at = at[out[at] & (kinds[at + 1] == LETTER) & ~first[at + 1]]
        if len(at):
            wide = np.concatenate((data, np.zeros(2, np.uint8)))
            a, b = wide[at + 1], wide[at + 2]
            a_two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            two = a_two & ~first[np.minimum(at + 2, n)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            out[at[one | two] + 1] = False
            end = at[one | two] + np.where(two[one | two], 3, 2)
            out[end[end < n]] = True
    return out


def slices(data: np.ndarray, ends: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of about limit bytes: they end with a text, or inside a longer one before a space between two plain characters."""
    at, n = 0, len(data)
    plain = np.zeros(256, bool)
    plain[33:127] = True
    while at < n:
        to = int(ends[np.searchsorted(ends, at + limit, "right") - 1])
        reach = limit
        while to <= at:
            if at + reach >= n:
                to = n
                break
            part = data[at : at + reach]
            cut = np.flatnonzero((part[1:-1] == 0x20) & plain[part[:-2]] & plain[part[2:]])
            end = int(ends[np.searchsorted(ends, at, "right")])
            to = min(end, at + int(cut[-1]) + 1) if len(cut) else end if end <= at + reach else 0
            reach *= 2
        yield at, to
        at = to


def distinct_pieces(data: np.ndarray, start: np.ndarray) -> pa.DictionaryArray:
    """The pieces that begin at the given places, which cover the data."""
    offsets = pa.array(np.append(start, len(data)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(start), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


class PieceNumbers:
    """The numbers (such as token ids) that each distinct piece stands for, remembered in one pool."""

    def __init__(self, numbers_of: Callable[[list[bytes]], list[list[int]]], table: np.ndarray, joined_space: bool, single_numbers: bool):
        self.numbers_of, self.table, self.how = numbers_of, table, (joined_space, single_numbers, True)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        found = self.numbers_of(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.pool = np.append(self.pool, np.fromiter((x for f in found for x in f), np.uint32, int(sizes.sum())))
        self.size = np.append(self.size, sizes)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
        n = len(self.place)
        self.place.update(zip(new, range(n, n + len(new))))

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the texts, one after another, and how many each text has."""
        out, counts = [], np.zeros(len(ends) - 1, np.int64)
        for a, b in slices(data, ends):
            part = data[a:b]
            inside = ends[(ends >= a) & (ends < b)] - a
            kinds = classes_of(part, self.table)
            start = np.flatnonzero(begins(part, kinds, inside, *self.how))
            pieces = distinct_pieces(part, start)
            if len(self.place) > PIECES or len(self.pool) > POOL:
                self.clear()
            distinct = pieces.dictionary.to_pylist()
            new = [x for x in distinct if x not in self.place]
            if new:
                self._learn(new)
            which = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
            size, begin = self.size[which], self.begin[which]
            index = pieces.indices.to_numpy()
            n = size[index]
            total = np.cumsum(n)
            step = np.repeat(begin[index] - (total - n), n)
            out.append(self.pool[step + np.arange(len(step))])
            first, last = np.searchsorted(ends, (a, b), "right") - 1  # texts that the stretch begins and ends in
            bounds = np.searchsorted(start, np.clip(ends[first : last + 2] - a, 0, b - a))
            counts[first : last + 1] += np.diff(np.concatenate(([0], total))[bounds])[: len(counts) - first]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts
