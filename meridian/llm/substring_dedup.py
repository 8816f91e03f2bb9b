"""Substring dedup on words, by recompression.

Rounds of recompression name runs of a symbol (name of symbol and length) and pairs (a
symbol of the left half of the alphabet before one of the right half). A name is a
fingerprint of its parts and its round, so it is the same in every document and task; a
round needs no exchange. In each round a window loses its first and last run, and a symbol
that may pair with what lies outside; what is left of it, its core, is parsed alike at
every place where the window occurs. Of the highest round that leaves a core, the longest
symbol (by words, then by name, then the leftmost) is the window's anchor. repeats.py
compares windows with a shared anchor.

Nulls and empty texts have no words and lose none. Texts under 35 words have no window.
Rows that repeat id and text are read as one document (their windows are not elsewhere); rows
that share an id and differ are documents of their own. Texts of any length are searched whole.
Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, mix, slices, word_names, words_of
from .repeats import covered, parse_rows, repeated_windows

_U = np.uint64
WINDOW = 35
#: More rounds give fewer, longer symbols, but leave less of a window certain.
ROUNDS = 4
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(a + _U(salt)) * _U(3) + b)


def recompressed(names: np.ndarray, doc: np.ndarray, rounds: int) -> list[dict[str, np.ndarray]]:
    """The symbols of each round: name, first word, words; and how to get there from below.

    run: index of each lower symbol's run; head: index of each run's symbol; left: whether a
    run may end a pair, which makes it unsure at a window's left border (else at its right).
    """
    n = len(names)
    level = {"name": names, "at": np.arange(n), "doc": doc}
    out = [level]
    for k in range(1, rounds + 1):
        sym, own = level["name"], level["doc"]
        new = np.ones(len(sym), dtype=bool)
        new[1:] = (sym[1:] != sym[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(sym)))
        name = sym[first].copy()
        long = length > 1
        name[long] = _pair_name(name[long], length[long].astype(np.uint64), 2 * k)
        own = own[first]
        right = (mix(name + _U(1000 + k)) & _U(1)).astype(bool)
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & (own[1:] == own[:-1])
        head = np.ones(len(name), dtype=bool)
        head[1:] = ~pair[:-1]
        which = np.flatnonzero(pair)
        name[which] = _pair_name(name[which], name[which + 1], 2 * k + 1)
        run = np.cumsum(new) - 1
        level = {"name": name[head], "at": level["at"][first][head], "doc": own[head], "run": run, "right": right, "head": np.cumsum(head) - 1}
        out.append(level)
    return out


def anchors(names: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, round and first word of the anchor of each window, which begin at the words at."""
    levels = recompressed(names, doc, rounds)
    name = np.zeros(len(at), dtype=np.uint64)
    height = np.zeros(len(at), dtype=np.int64)
    where = np.zeros(len(at), dtype=np.int64)
    live, lo, hi = np.arange(len(at)), at, at + window
    cores: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(live, lo, hi)]
    for level in levels[1:]:
        run, right, head = level["run"], level["right"], level["head"]
        left = run[lo] + 1
        end = run[hi - 1]
        ok = left < end
        live, left, end = live[ok], left[ok], end[ok]
        left = left + right[left]
        end = end - ~right[end - 1]
        ok = left < end
        live, left, end = live[ok], left[ok], end[ok]
        lo, hi = head[left], head[end - 1] + 1
        cores.append((live, lo, hi))
        if not len(live):
            break
    done = np.zeros(len(at), dtype=bool)
    for k in range(len(cores) - 1, -1, -1):
        live, lo, hi = cores[k]
        fresh = ~done[live]
        live, lo, hi = live[fresh], lo[fresh], hi[fresh]
        if not len(live):
            continue
        done[live] = True
        level = levels[k]
        words = np.diff(np.append(level["at"], len(names)))
        ends = np.flatnonzero(np.append(level["doc"][1:] != level["doc"][:-1], True))
        last_word = np.searchsorted(doc, level["doc"][ends], side="right")
        words[ends] = last_word - level["at"][ends]
        # Longer symbols first, then by name: one number to compare.
        rank = (np.minimum(words, 255).astype(np.uint64) << _U(56)) | (mix(level["name"] + _U(k)) >> _U(8))
        best, most = lo.copy(), rank[lo]
        step, open_ = 1, np.flatnonzero(lo + 1 < hi)
        while len(open_):
            other = rank[lo[open_] + step]
            better = other > most[open_]
            got = open_[better]
            most[got] = other[better]
            best[got] = lo[got] + step
            step += 1
            open_ = open_[lo[open_] + step < hi[open_]]
        name[live], height[live], where[live] = level["name"][best], k, level["at"][best]
    return name, height, where


def _parse(window: int, rounds: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts, ends, doc = words_of(part)
            if len(starts) < window:
                continue
            names = word_names(part, starts, ends)
            at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
            if not len(at):
                continue
            name, height, where = anchors(names, doc, at, window, rounds)
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1]) | (height[1:] != height[:-1]) | (doc[at[1:]] != doc[at[:-1]])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            begin = at[first]
            # Anchors are made of the first names, so runs are told apart by names that don't depend on these.
            span = Rolling(word_names(part, starts, ends, True), True).of(begin, begin + count - 1 + window)
            span = mix(span ^ mix(((where[first] - begin) << 16 | count).astype(np.uint64)))
            anchor = mix(name[first] + height[first].astype(np.uint64))
            own = doc[begin]
            start = begin - np.searchsorted(doc, own, side="left")
            yield parse_rows(part, own, anchor, span, (start, where[first] - begin, count), False)

    return parse


def _names(part, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, own = words_of(part)
    base = np.searchsorted(own, np.arange(len(part)), side="left")[doc]
    return tuple(Rolling(word_names(part, starts, ends, second), second).of(base + start, base + end) for second in (False, True))


def _sizes(part) -> np.ndarray:
    return np.bincount(words_of(part)[2], minlength=len(part))


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: documents without the words of repeated windows.

    kept_text joins the words that are left by one space; it is empty if none are.
    """
    return _finished(docs, window, rounds, False)


def repeated_passages_report(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """As remove_repeated_passages, with the SHA-256 of the kept text in place of it."""
    return _finished(docs, window, rounds, True)


def _finished(docs: DataFrame, window: int, rounds: int, digest: bool) -> DataFrame:
    found = repeated_windows(docs, _parse(window, rounds), _names, _sizes, window, first_only=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts, ends, own = words_of(part)
            n = np.bincount(own, minlength=len(part)).astype(np.int64)
            gone = covered(part, n, window)
            kept = np.flatnonzero(~gone)
            # The kept words with one space after each, as one byte array.
            size = ends[kept] - starts[kept] + 1
            to = np.cumsum(size) - size
            text = np.full(int(size.sum()), 32, dtype=np.uint8)
            length = size - 1
            put = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            text[np.repeat(to, length) + put] = part.data[np.repeat(starts[kept], length) + put]
            bounds = np.searchsorted(own[kept], np.arange(len(part) + 1), side="left")
            edge = np.append(to, len(text))[bounds]
            pieces = [text[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            last = [hashlib.sha256(x).hexdigest() for x in pieces] if digest else [x.decode() for x in pieces]
            removed = n - np.diff(bounds)
            yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(removed), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])

    schema = REPORT if digest else REPORT.replace("kept_sha256", "kept_text")
    return found.mapInArrow(finish, schema)
