"""Packing documents into training sequences by harmonic classes.

Class k takes the pieces of at least capacity/(k+1) (exclusive) and at most capacity/k tokens, and each of its bins is
filled with exactly k pieces. Documents are cut so that little of a bin stays empty: full sequences first, then the largest
whole reciprocal of the capacity that fits, a bounded number of times; the rest goes to its own class. Every Spark task
fills the bins of its own partition, without a shuffle; a task holds only its unfinished bins, and packs these few at its end by
first fit, longest first. A sequence's number joins the task's partition and a counter, so that a task that runs again gives the
same rows.

Defined results: a null or empty text has only the closing id; repeated rows are packed each; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    """``cuts``: reciprocal pieces taken of a document's tail at most; ``end``: id that closes a document."""

    tokenizer: str
    kind: str = "byte"
    capacity: int = 1024
    cuts: int = 3
    end: int = 0
    rows_per_batch: int = 1000


def pieces(n: int, capacity: int, cuts: int) -> list[int]:
    """Lengths that a document of ``n`` tokens is cut into."""
    return [capacity] * (n // capacity) + _tail(n % capacity, capacity, cuts)


@lru_cache(maxsize=8192)
def _tail(rest: int, capacity: int, cuts: int) -> list[int]:
    out = []
    while rest and cuts:
        k = -(-capacity // rest)  # the first reciprocal not above the rest
        part = min(rest, capacity // k) or rest
        out.append(part)
        rest, cuts = rest - part, cuts - 1
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """Bins of one worker. ``add`` gives the rows of a bin that is full, ``close`` those of all others."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.open = capacity, first, {}

    def _emit(self, held: list[list[int]]) -> list[list[int]]:
        at = 0
        for row in held:
            row += [self.next, at]
            at += row[2]
        self.next += 1
        return held

    def add(self, row: list[int]) -> list[list[int]]:
        k = self.capacity // row[2]
        held = self.open.setdefault(k, [])
        held.append(row)
        return self._emit(self.open.pop(k)) if len(held) == k else []

    def close(self) -> list[list[int]]:
        rows = sorted((r for held in self.open.values() for r in held), key=lambda r: -r[2])
        self.open = {}
        bins: list[tuple[int, list[list[int]]]] = []
        for row in rows:
            for i, (room, held) in enumerate(bins):
                if room >= row[2]:
                    held.append(row)
                    bins[i] = (room - row[2], held)
                    break
            else:
                bins.append((self.capacity - row[2], [row]))
        return [r for _, held in bins for r in self._emit(held)]


def packed(docs: DataFrame, how: Packing) -> DataFrame:
    """One row per piece: where it is cut from its document, and its place in a sequence."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.tokens import encoder

        encode = encoder(how.tokenizer, how.kind).encode
        bins = HarmonicBins(how.capacity, TaskContext.get().partitionId() << 36)
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)
        crc = zlib.crc32
        for batch in batches:
            rows: list[list[int]] = []
            ids, starts = encode(batch.column(1).to_pylist(), how.end)
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), starts.tolist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                n, start, base = at[i + 1] - at[i], 0, 4 * at[i]
                for length in pieces(n, how.capacity, how.cuts):
                    rows += bins.add([doc, start, length, crc(raw[base + 4 * start : base + 4 * (start + length)]), n])
                    start += length
            yield frame(rows)
        yield frame(bins.close())

    pieces_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA)
    return written(pieces_, "packed", rows=how.rows_per_batch)  # bounds the texts that one batch brings
