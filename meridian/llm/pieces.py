"""A worker's bounded table of distinct text pieces and what a tokenizer makes of each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import LONG, MASKS, TextSlice, eights, runs_of, stretch_names

#: Pieces that a Python worker remembers; the table starts anew beyond it.
REMEMBERED = 400_000


class PieceTable:
    """Piece -> number; number -> token ids. New pieces are encoded once each, in one call.

    encode gives the pieces in an order of its choice, all their ids in a row, and their lengths.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.n = 0

    def _add(self, pieces: list[str]) -> None:
        pieces, ids, lengths = self.encode(pieces)
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(pieces) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + total] = ids
        self.ends[self.n : self.n + len(pieces)] = self.used + np.cumsum(lengths)
        self.index.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.used += total
        self.n += len(pieces)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; valid until the next call."""
        if self.n > self.limit:
            self._clear()
        get = self.index.get
        found = list(map(get, pieces))
        if None in found:
            gaps = [i for i, k in enumerate(found) if k is None]
            self._add(list(dict.fromkeys(pieces[i] for i in gaps)))
            for i in gaps:
                found[i] = get(pieces[i])
        return np.array(found, dtype=np.int64)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        return ends - starts

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each piece has."""
        lengths = self.lengths(numbers)
        starts = self.ends[numbers] - lengths
        total = int(lengths.sum())
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
        return self.ids[at], lengths


_tables: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """make(), once in a Python worker."""
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def joined(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The lists in a row, and the first place of each (and the end)."""
    flat: list[str] = []
    edge = [0]
    for x in lists:
        flat += x
        edge.append(len(flat))
    return flat, np.array(edge, dtype=np.int64)


def summed(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[edge[1:]] - sums[edge[:-1]]


def rows_of(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in a row, and the lengths."""
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter((x for y in lists for x in y), dtype=np.int32, count=int(lengths.sum())), lengths


def equal_stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether data[start:end] and other[begin:stop] are the same bytes, for each pair of stretches."""
    size = end - start
    same = size == stop - begin
    one, two = eights(data), eights(other)
    todo, at = np.flatnonzero(same & (size <= LONG)), 0
    while len(todo):
        mask = MASKS[np.minimum(size[todo] - at, 8)]
        same[todo] = (one[start[todo] + at] & mask) == (two[begin[todo] + at] & mask)
        at += 8
        todo = todo[same[todo] & (size[todo] > at)]
    for i in np.flatnonzero(same & (size > LONG)):
        same[i] = data[start[i] : end[i]].tobytes() == other[begin[i] : stop[i]].tobytes()
    return same


class WordTable:
    """A worker's bounded table of words in numpy arrays: found by name, compared by their bytes.

    encode gets new words as texts and gives an order of them, all their ids in that order, and
    how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.names, self.of_name = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.byte_ends, self.id_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the word before, and of each
        self.others: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.byte_ends) - 1

    def _add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of new words."""
        order, ids, lengths = self.encode([x.decode() for x in words])
        sizes = np.fromiter((len(words[i]) for i in order), dtype=np.int64, count=len(order))
        numbers = np.empty(len(order), dtype=np.int64)
        numbers[order] = len(self) + np.arange(len(order))
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words[i] for i in order), dtype=np.uint8)])
        self.ids = np.concatenate([self.ids, ids])
        self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum(sizes)])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(lengths)])
        return numbers

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[begin:end]; valid until the next call."""
        if len(self) > self.limit:
            self._clear()
        names, first, which = np.unique(stretch_names(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        fresh = np.append(self.names, np.uint64(0))[at] != names if len(names) else np.zeros(0, dtype=bool)
        fresh |= at == len(self.names)
        if fresh.any():
            raw, new = data.tobytes(), first[fresh]
            numbers = self._add([raw[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            self.of_name = np.insert(self.of_name, at[fresh], numbers)
            self.names = np.insert(self.names, at[fresh], names[fresh])
            at = np.searchsorted(self.names, names)
        out = self.of_name[at][which]
        wrong = np.flatnonzero(~equal_stretches(data, begin, end, self.bytes, self.byte_ends[out], self.byte_ends[out + 1]))
        if len(wrong):  # words that share a name with another one
            words = [data[begin[i] : end[i]].tobytes() for i in wrong]
            new = list(dict.fromkeys(x for x in words if x not in self.others))
            if new:
                self.others.update(zip(new, self._add(new).tolist(), strict=True))
            out[wrong] = [self.others[x] for x in words]
        return out

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        starts, ends = self.id_ends[numbers], self.id_ends[numbers + 1]
        lengths = ends - starts
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - ends, lengths)
        return self.ids[at], lengths


_LETTER, _UPPER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: First bytes of the letters U+00C0 to U+023F, but for three characters (see below).
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xC9] = True


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Latin letters: without the signs for times and divided by, and without I with a dot above, which two letters replace in lower case."""
    ok = _LETTER[data]
    if len(data) < 2:
        return ok
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    two = _LEAD[data[:-1]] & (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)
    ok[:-1] |= two
    ok[1:] |= two
    return ok


def parts_of(part: TextSlice, cuts: bytes, stops: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice, start and end of each part, and each document's first part.

    Parts are the stretches between cut bytes. One of Latin letters, with one stop behind it or
    none, is lower-cased (A to Z) and gives letters and stop as two parts.
    """
    cut, stop = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    cut[list(cuts)] = True
    stop[list(stops)] = True
    data = part.data
    starts, ends = runs_of(~cut[data], part.off)
    if not len(starts):
        return data, starts, ends, np.zeros(len(part) + 1, np.int64)
    odd = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(~latin_letters(data), out=odd[1:])
    stopped = stop[data[ends - 1]] & (ends - starts > 1)
    plain = odd[ends - stopped] == odd[starts]
    stopped &= plain
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts[plain]] += 1
    inside[ends[plain]] -= 1
    data = data + 32 * (_UPPER[data] & (np.cumsum(inside[:-1], dtype=np.int8) > 0)).astype(np.uint8)
    # Where a stretch is cut in two, its stop is a part of its own.
    at = np.arange(len(starts)) + np.cumsum(stopped) - stopped
    total = len(starts) + int(stopped.sum())
    begin, end = np.empty(total, np.int64), np.empty(total, np.int64)
    begin[at], end[at] = starts, ends - stopped
    begin[at[stopped] + 1], end[at[stopped] + 1] = ends[stopped] - 1, ends[stopped]
    return data, begin, end, np.searchsorted(begin, part.off)
