"""Packing by concatenating and cutting.

Each document is encoded once; its ids, with an end id, are kept in a
checkpoint with the number of the partition and the ids before it there. The partitions'
totals, a row each, are summed in order, which gives every document a place in one long row
of ids. That row is cut every 2048 ids. A document that crosses cuts gives a piece for each
sequence; only the last sequence of all is not full, and is padded.

A null or empty text is the end id alone. Rows that repeat a doc_id are packed each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpointed, id_and_text, slices, spread
from .pieces import WordTable, once, parts_of, rows_of, summed

LENGTH, END = 2048, 1
#: Words that a Python worker remembers: about 70 bytes each.
REMEMBERED_WORDS = 1_200_000
#: Bytes of text that are encoded in one step.
ENCODE_BYTES = 4 * SLICE_BYTES
#: Above so many partitions, their totals are joined by a shuffle instead of a broadcast.
BROADCAST_PARTITIONS = 1_000_000
ENCODED = "doc_id long, part long, before long, n long, ids binary"
REPORT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = REPORT.replace("ids_crc32 long", "ids array<int>")


def word_table(path: str, words: int = REMEMBERED_WORDS) -> WordTable:
    """Ids of parts of stretches between blanks; the tokenizer drops white space before it splits."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    last[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
    plain = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]+").fullmatch

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # A word of Latin letters is one unit of the tokenizer and ends with an end-of-word token,
        # so many words can be encoded as one text.
        units = np.fromiter((plain(x) is not None for x in words), dtype=bool, count=len(words))
        single, joint = np.flatnonzero(~units), np.flatnonzero(units)
        ids, lengths = rows_of([x.ids for x in tokenizer.encode_batch_fast([words[i] for i in single], add_special_tokens=False)])
        texts = [" ".join([words[i] for i in joint[k : k + 1024]]) for k in range(0, len(joint), 1024)]
        more = np.concatenate([np.zeros(0, np.int32), *[np.array(x.ids, dtype=np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]])
        return np.concatenate([single, joint]), np.concatenate([ids, more]), np.concatenate([lengths, np.diff(np.flatnonzero(last[more]), prepend=-1)])

    return WordTable(encode, words)


def encoded_texts(part, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice's documents in a row and how many each has."""
    data, begin, end, edge = parts_of(part, b" \n", b".,")
    ids, lengths = table.tokens(table.numbers(data, begin, end))
    return ids, summed(lengths, edge)


def _encoded(path: str, words: int, step: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(("word", path, words), lambda: word_table(path, words))
        here, before = TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=step):
            ids, n = encoded_texts(part, table)
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = ids.astype("<u2") if ids.max(initial=0) < 65536 else ids.astype("<u4")
            raw, size = ids.tobytes(), ids.itemsize
            raw = [raw[size * a : size * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = n + 1
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.full(len(n), here)), pa.array(first), pa.array(n), pa.array(raw, pa.binary())],
                names=["doc_id", "part", "before", "n", "ids"],
            )

    return encode


def _cut(length: int, digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):  # a few documents at a time
                batch = whole.slice(first, 256)
                at, n = (np.asarray(batch.column(x)).astype(np.int64) for x in ("at", "n"))
                last = (at + n - 1) // length
                pieces = last - at // length + 1
                own = np.repeat(np.arange(len(n)), pieces)
                sequence = spread(at // length, pieces)
                begin = np.maximum(at[own], sequence * length)
                size = np.minimum(at[own] + n[own], (sequence + 1) * length) - begin
                start = begin - at[own]
                values, k = [], 0
                for i, raw in enumerate(batch.column("ids").to_pylist()):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * (n[i] - 1) else "<u4")
                    ids = np.append(ids.astype("<u4"), np.uint32(END))
                    for _ in range(pieces[i]):
                        one = ids[start[k] : start[k] + size[k]]
                        values.append(zlib.crc32(one.tobytes()) if digest else one.astype(np.int32))
                        k += 1
                column = pa.array(values, pa.int64() if digest else pa.list_(pa.int32()))
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(own)), pa.array(start), pa.array(size), column, pa.array(n[own]), pa.array(sequence), pa.array(begin - sequence * length)],
                    names=["doc_id", "start", "length", "ids" if not digest else "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return cut


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, digest: bool = False, words: int = REMEMBERED_WORDS, step: int = ENCODE_BYTES) -> DataFrame:
    """Pieces of documents with their ids (or, with digest, the CRC-32 of them) and places.

    words and step: words that a worker remembers and bytes that it encodes at once, which set its memory, not the result.
    """
    encoded = checkpointed(id_and_text(docs).mapInArrow(_encoded(tokenizer, words, step), ENCODED))
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")  # a row for each partition
    totals = checkpointed(totals.select("part", before.alias("base")))
    small = totals.count() <= BROADCAST_PARTITIONS
    placed = encoded.join(F.broadcast(totals) if small else totals, "part")
    placed = placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cut(length, digest), REPORT if digest else PIECES)
