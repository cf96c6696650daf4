"""Token ids in range-coded files, written in ascending document order and read back.

Documents are sorted by id over ranges of ids; every task encodes its range and closes a file whenever enough ids are gathered, always between two
documents. A file is one row of a Parquet table in the shared folder: its place in the order, the ids and lengths of its documents, and the coded
ids (``range_coder``). Files are decoded independently of each other, each in one task; ids before a file are the sums of the
files before it, one row per file.

Defined results: a null or empty text has only the closing id; documents with equal ids follow each other in the order of a hash of their texts; a null id comes
first; damaged blocks raise; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tables import written

FILE_SCHEMA = "task int, file int, n_ids long, docs binary, counts binary, nulls binary, data binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class TokenFiles:
    """``ids_per_file`` closes a file; ``end`` is the id that closes a document; ``broadcast_files``: files up to which their starts are broadcast."""

    tokenizer: str
    kind: str = "word"
    end: int = 1
    ids_per_file: int = 8_000_000
    rows_per_batch: int = 1000
    broadcast_files: int = 100_000


def files(docs: DataFrame, how: TokenFiles) -> DataFrame:
    """The written files of all documents."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.range_coder import compress
        from millrace.llm.tokens import encoder

        encode_texts = encoder(how.tokenizer, how.kind).encode
        task, file = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            docs = pa.chunked_array([h[0] for h in held], pa.int64())
            counts, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            row = (task, file, len(ids), docs.fill_null(0).to_numpy().astype("<i8").tobytes(), counts.astype("<u4").tobytes(), docs.is_valid().to_numpy().astype(np.uint8).tobytes(), compress(ids))
            kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split(" ")[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            ids, starts = encode_texts(batch.column(1).to_pylist(), how.end)
            held.append((batch.column(0), np.diff(starts), ids))
            if sum(len(h[2]) for h in held) >= how.ids_per_file:
                yield close()
                held, file = [], file + 1
        if held:
            yield close()

    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")  # a text is not sampled for ranges
    return written(ordered.mapInArrow(encode, FILE_SCHEMA), "token-files", compression="none", rows=how.rows_per_batch)


def read(stored: DataFrame, how: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.range_coder import decompress

        for batch in batches:
            for i in range(batch.num_rows):
                docs, counts, known, data, before = (batch.column(k)[i].as_py() for k in range(5))
                counts = np.frombuffer(counts, "<u4").astype(np.int64)
                ids = memoryview(decompress(data).astype("<u4", copy=False)).cast("B")
                if len(ids) != 4 * counts.sum():
                    raise ValueError("a file's ids and its documents differ")
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                names = pa.array(np.frombuffer(docs, "<i8"), mask=np.frombuffer(known, np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([names, pa.array(before + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], [c.split(" ")[0] for c in DOC_SCHEMA.split(", ")])

    before = W.orderBy("task", "file").rowsBetween(W.unboundedPreceding, -1)  # one row per file, of three numbers
    starts = written(stored.select("task", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before")), "token-starts")
    if starts.count() <= how.broadcast_files:
        starts = F.broadcast(starts)
    return stored.join(starts, ["task", "file"]).select("docs", "counts", "nulls", "data", "before").mapInArrow(decode, DOC_SCHEMA)


def report(docs: DataFrame, how: TokenFiles) -> DataFrame:
    """Writes the files, reads them back, and gives one row per document."""
    return read(files(docs, how), how)
