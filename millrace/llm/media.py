"""Media columns in a store of content-defined chunks.

A payload is one channel of 8-bit samples. A rolling gear hash over the last 32 samples cuts it where its masked bits are zero, so that equal
stretches give equal chunks wherever they stand. Joins on chunk digests find the chunks that occur again: these are kept once, by digest. Chunks that occur
nowhere else stay together in the container of their payload, compressed as one, and never move: the tasks that read the texts write them in place. A
container also has the payload's recipe, the ordered list of its chunks. Reading takes a payload's own chunks from its container and joins
the others to it, puts the chunks in order, checks every digest, the length and the payload's own digest, and computes the features from what was read. A payload
is read back once, however many documents hold it.

The stored form of a payload is its recipe, its own chunks and its compressed common chunks in order; ``media_bytes`` and ``media_sha256`` are of that.

Defined results: a null text is empty; an empty payload is one block of zeros; repeated rows share one payload; a damaged or missing chunk
raises; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import mix
from millrace.llm.tables import discard, written

MAGIC = b"CDC9"
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class ChunkStore:
    """Chunks have ``least`` to ``most`` samples, about ``least + 2 ** bits`` on average: half of a usual document, so that passages inside documents are found.

    Tables of digests are broadcast up to ``broadcast_rows`` rows, counted beforehand.
    """

    block: int = 64
    least: int = 256
    bits: int = 9
    most: int = 16384
    level: int = 6
    rows_per_batch: int = 2000
    broadcast_rows: int = 200_000


def payload(text: str | None, block: int) -> bytes:
    """UTF-8 bytes, filled with zeros to a positive multiple of ``block``."""
    raw = (text or "").encode()
    return raw + bytes(block - len(raw) if not raw else -len(raw) % block)


def gear(samples: np.ndarray) -> np.ndarray:
    """The gear hash after each sample: each of the last 32 samples' table values, shifted by its age."""
    h = _GEAR[samples]
    for w in (1, 2, 4, 8, 16):
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h


def chunks(raw: bytes, how: ChunkStore) -> list[bytes]:
    """The payload cut where its content says so."""
    mask = np.uint32(((1 << how.bits) - 1) << (32 - how.bits))
    out, start = [], 0
    if len(raw) > how.least:
        cuts = (np.flatnonzero((gear(np.frombuffer(raw, np.uint8)) & mask) == 0) + 1).tolist()
        while len(raw) - start > how.least:
            i = bisect_left(cuts, start + how.least)
            cut = min(cuts[i] if i < len(cuts) else len(raw), start + how.most, len(raw))
            out.append(raw[start:cut])
            start = cut
    if start < len(raw):
        out.append(raw[start:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(raw: bytes) -> str:
    """Count, mean, spread and zero crossings of the samples, around their middle value."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    up = x >= 0
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};min={int(x.min())};max={int(x.max())};crossings={int((up[1:] != up[:-1]).sum())}"


RECIPES = "doc_id long, n_bytes long, payload_bytes long, content binary, digests binary, lengths binary"
PIECES = "kind string, key binary, payload_bytes long, digests binary, lengths binary, shared array<int>, data binary"


def _content(text: Column, block: int) -> Column:
    """The digest of a text's payload."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    fill = F.when(F.length(raw) == 0, block).otherwise(F.pmod(-F.length(raw), F.lit(block)))
    return F.unhex(F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill))), 256))


def _places(digests: str) -> Column:
    """Place and digest of each chunk of a recipe."""
    return F.transform(F.sequence(F.lit(0), (F.length(digests) / 16).cast("int") - 1), lambda i: F.struct(i.alias("place"), F.substring(digests, 16 * i + 1, F.lit(16)).alias("digest")))


def store(docs: DataFrame, how: ChunkStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(recipes, containers, common)`` of all texts, written: one recipe per row of ``docs``, containers with the chunks that occur once, one row per other chunk."""

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                raw = payload(text, how.block)
                parts = chunks(raw, how)
                out.append((len((text or "").encode()), len(raw), hashlib.sha256(raw).digest(), b"".join(map(digest, parts)), struct.pack(f"<{len(parts)}I", *map(len, parts))))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True))], [c.split(" ")[0] for c in RECIPES.split(", ")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=how.level, write_content_size=True).compress
        seen: set[bytes] = set()
        for b in batches:
            out = []
            for content, text, shared in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if content in seen:
                    continue
                seen.add(content)
                parts = chunks(payload(text, how.block), how)
                names = [digest(c) for c in parts]
                there = set(shared or ())
                own = b"".join(c for i, c in enumerate(parts) if i not in there)
                out.append(("container", content, sum(map(len, parts)), b"".join(names), struct.pack(f"<{len(parts)}I", *map(len, parts)), sorted(there), pack(own) if own else b""))
                for i in sorted(there):
                    if names[i] not in seen:
                        seen.add(names[i])
                        out.append(("common", names[i], None, None, None, None, pack(parts[i])))
            if len(seen) > 1_000_000:  # only saves repeats
                seen.clear()
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in PIECES.split(", ")])

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= how.broadcast_rows else df

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = written(texts.mapInArrow(recipes, RECIPES), "recipes", rows=how.rows_per_batch)
    again = listed.select(F.explode(_places("digests")).alias("p")).groupBy("p.digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    again = written(again, "digests")
    once = listed.groupBy("content").agg(F.first("digests").alias("digests"))
    marks = once.select("content", F.explode(_places("digests")).alias("p")).select("content", "p.place", "p.digest").join(bounded(again), "digest", "left_semi")
    marks = written(marks.groupBy("content").agg(F.sort_array(F.collect_list("place")).alias("shared")), "marks")
    rows = texts.select(_content(F.col("text"), how.block).alias("content"), "text").join(bounded(marks), "content", "left").select("content", "text", "shared")
    every = written(rows.mapInArrow(pieces, PIECES), "pieces", compression="none", rows=how.rows_per_batch)
    common = written(every.filter("kind = 'common'").groupBy(F.col("key").alias("digest")).agg(F.first("data").alias("data")), "common", compression="none")
    discard(again, marks)
    return listed, every.filter("kind = 'container'").select(F.col("key").alias("content"), "payload_bytes", "digests", "lengths", "shared", "data"), common


def restored(containers: DataFrame, common: DataFrame, how: ChunkStore) -> DataFrame:
    """``content`` and what was read back of it, for every distinct payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for content, n, names, lengths, shared, own, parts in zip(*(b[c] for c in ("content", "payload_bytes", "digests", "lengths", "shared", "data", "parts")), strict=True):
                sizes = struct.unpack(f"<{len(lengths) // 4}I", lengths)
                there = {p["place"]: p["data"] for p in parts}
                if sorted(there) != list(shared):
                    raise ValueError(f"stored media of payload {content.hex()} lack chunks")
                kept, at, plain = unpack(own) if own else b"", 0, []
                for i, size in enumerate(sizes):
                    if i in there:
                        plain.append(unpack(there[i]))
                    else:
                        plain.append(kept[at : at + size])
                        at += size
                raw = b"".join(plain)
                if b"".join(map(digest, plain)) != names or list(map(len, plain)) != list(sizes) or len(raw) != n or hashlib.sha256(raw).digest() != content:
                    raise ValueError(f"stored media of payload {content.hex()} are damaged")
                media = MAGIC + struct.pack("<QII", n, len(sizes), len(there)) + names + lengths + struct.pack(f"<{len(there)}I", *sorted(there)) + own + b"".join(there[i] for i in sorted(there))
                out.append((content, content.hex(), zlib.crc32(raw[-how.block :]), len(media), hashlib.sha256(media).hexdigest(), f"chunks={len(plain)};{features(raw)}"))
            yield pd.DataFrame(out, columns=["content", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    columns = ["content", "payload_bytes", "digests", "lengths", "shared", "data"]
    none = F.expr("cast(array() as array<struct<place: int, data: binary>>)")
    alone = containers.filter(F.size("shared") == 0).select(*columns, none.alias("parts"))
    # Only containers that lack chunks move; tasks that met the same payload wrote the same container.
    mixed = containers.filter(F.size("shared") > 0).dropDuplicates(["content"])
    wanted = mixed.select("content", F.explode(F.filter(_places("digests"), lambda p: F.array_contains("shared", p["place"]))).alias("p")).select("content", "p.place", "p.digest")
    parts = wanted.join(common, "digest").groupBy("content").agg(F.collect_list(F.struct("place", "data")).alias("parts"))
    every = alone.unionByName(mixed.join(parts, "content", "left").withColumn("parts", F.coalesce("parts", none)).select(*columns, "parts"))
    return every.mapInPandas(read, "content binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def report(docs: DataFrame, how: ChunkStore = ChunkStore()) -> DataFrame:
    """Stores all texts, reads them back, and gives one row per document."""
    recipes, containers, common = store(docs, how)
    facts = written(restored(containers, common, how), "media-facts", rows=how.rows_per_batch)
    return recipes.select("doc_id", "n_bytes", "payload_bytes", "content").join(facts, "content").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
