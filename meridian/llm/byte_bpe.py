"""Byte-level BPE with the tokenizers library, from a file of ranks.

Bytes become characters by the byte table, ranks become a vocabulary and merges (each token's
two parts are what lower ranks make of it). A text is split by the pattern; each distinct
match is encoded once. Decoding looks ids up in the reversed byte table, so characters whose
bytes lie in different tokens come out whole.

A null text is empty; an empty text has no tokens. Rows are encoded each, also if they repeat a
doc_id; a text of any length is encoded whole. Of merges of equal rank (ties), the leftmost comes
first. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .pieces import PieceTable, joined, once, rows_of, summed

REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>, ends array<int>"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two stretches that merges of lower rank make of a token."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= limit:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def tokenizer_of(ranks: dict[bytes, int]):
    """A tokenizer of single matches: no pattern of its own, no special tokens."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_characters()
    name = lambda x: "".join(table[b] for b in x)
    ordered = sorted(ranks, key=ranks.get)
    merges = [tuple(map(name, p)) for t in ordered if len(t) > 1 and len(p := parts_of(t, ranks)) == 2]
    tokenizer = Tokenizer(models.BPE(vocab={name(t): k for t, k in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


class Codec:
    """Encoding and decoding by one file of ranks; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        tokenizer = tokenizer_of(ranks)
        self.split = regex.compile(pattern).findall
        self.table = PieceTable(lambda x: (x, *rows_of([y.ids for y in tokenizer.encode_batch_fast(x, add_special_tokens=False)])))
        top = max(ranks.values()) + 1
        known: list[bytes] = [b""] * top
        for token, k in ranks.items():
            known[k] = token
        self.size = np.array([len(x) for x in known], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(known), dtype=np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and how many each text has."""
        pieces, edge = joined([self.split(x) for x in texts])
        ids, lengths = self.table.tokens(self.table.numbers(pieces))
        return ids, summed(lengths, edge)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) - np.repeat(ends - size - self.start[ids], size)
        return self.bytes[at], ends


def _codec(path: str, pattern: str) -> Codec:
    return once(("byte", path, pattern), lambda: Codec(path, pattern))


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids, ends: token ids and the byte at which each token ends in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for part in slices(batches):
            ids, n = codec.encode(part.column("text").fill_null("").to_pylist())
            _, ends = codec.decode(ids)
            ends = ends - np.repeat(part.off[:-1], n)
            off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.record_batch([part.column("doc_id"), *lists], names=["doc_id", "ids", "ends"])

    return id_and_text(docs).mapInArrow(run, ENCODED)


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, content: the bytes that lists of ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            raw = [codec.decode(np.array(x or [], dtype=np.int64))[0].tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "content"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        spelled = [str(k) for k in range(len(codec.size))]
        for part in slices(batches):
            ids, n = codec.encode(part.column("text").fill_null("").to_pylist())
            raw, ends = codec.decode(ids)
            edge = np.concatenate([[0], np.cumsum(n)])
            byte = np.concatenate([[0], ends])[edge]
            names = [spelled[k] for k in ids.tolist()]
            one = [hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            two = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(byte[:-1], byte[1:], strict=True)]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(one, pa.string()), pa.array(two, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, REPORT)
