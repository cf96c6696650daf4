"""Fuzzy line removal: MinHash over character shingles, banding, exact Jaccard, union-find, one line kept per component.

A node is a distinct line with at least one word; equal lines are one node and need no check. The signatures of a
band are hashed to a join key; lines that share a key are checked on their exact shingle sets (``links``), and the first
line of each component (by document id, row, place in the document) is kept. All others go; lines without a word stay.

Defined results: a null text stays null; empty texts stay; of lines that repeat inside a document the first is kept; a document whose
lines all go is kept with what is left, which may be empty; ``n_chars``, where the table has it, follows the text; repeated rows count
one after the other; a null ``doc_id`` comes first; extra columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm import links
from millrace.llm.hashing import U, character_shingles, lowered, mix, quick_shingles, slices, text_bytes
from millrace.llm.tables import discard, written
from millrace.llm.text import SPACE_CLASS


#: Bytes of lines whose hashes are made at once, for signatures and for sets: their arrays stay in the processor's cache.
KEY_BYTES, SET_BYTES = 1 << 17, 1 << 16


@dataclass(frozen=True)
class LineDedup:
    """At similarity 0.75 a pair shares a band with probability 1 - (1 - 0.75 ** rows) ** bands: 0.9993; above 0.75 it is greater.
    Lines that are alike by chance share a band more rarely the more rows it has.

    One changed inner character leaves (L - 2 * shingle + 1) / (L + 1) of a line of L characters: 0.75 from 39 characters on.
    """

    shingle: int = 5
    bands: int = 27
    rows: int = 5
    percent: int = 75
    lines_per_batch: int = 10_000
    broadcast_rows: int = 300_000
    seed: int = 5


def signatures(hashes: np.ndarray, firsts: np.ndarray, how: LineDedup) -> np.ndarray:
    """MinHash values, one row per line. Worked through in slices of whole lines that stay in the processor's cache."""
    factors = np.random.default_rng(how.seed).integers(0, 1 << 32, how.bands * how.rows, np.uint32) | np.uint32(1)
    h = hashes if hashes.dtype == np.uint32 else (hashes >> U(32)).astype(np.uint32)
    out = np.empty((len(factors), len(firsts)), np.uint32)
    ends = np.append(firsts, len(h))
    i = 0
    while i < len(firsts):
        k = max(i + 1, int(np.searchsorted(ends, ends[i] + 65_536)) - 1)
        part, at = h[ends[i] : ends[k]], firsts[i:k] - ends[i]
        permuted = np.empty_like(part)
        for j, factor in enumerate(factors):
            np.minimum.reduceat(np.multiply(part, factor, out=permuted), at, out=out[j, i:k])
        i = k
    return out.T


def band_keys(sig: np.ndarray, how: LineDedup) -> np.ndarray:
    """One join key per line and band."""
    keys = np.empty((len(sig), how.bands), U)
    for b in range(how.bands):
        h = np.full(len(sig), b + 1, U)
        for r in range(how.rows):
            h = mix(h ^ sig[:, b * how.rows + r].astype(U))
        keys[:, b] = h
    return keys


def marks(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 MinHash values: similar lines agree in most."""
    return np.ascontiguousarray(np.packbits(sig[:, :64] * np.uint32(0x9E3779B1) >= np.uint32(1 << 31), axis=1)).view(U).ravel()


def _resolved(lines: DataFrame, how: LineDedup) -> DataFrame:
    """``(node, label)`` of lines that are similar to others; ``lines`` has ``node`` and ``line``."""
    spark = lines.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-2 * buckets // how.bands)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            fresh = np.array([x not in seen for x in nodes.tolist()], bool)
            if len(seen) > 500_000:  # only saves repeats
                seen.clear()
            seen.update(nodes.tolist())
            nodes, first = nodes[fresh], first[fresh]
            found = []
            for _, _, data, at in slices(*text_bytes(batch.column(1).take(pa.array(first))), KEY_BYTES):
                sig = signatures(*quick_shingles(lowered(data), at, how.shingle), how)
                found.append((marks(sig), band_keys(sig, how)))
            if found:
                yield links.band_rows(nodes, np.concatenate([m for m, _ in found]), np.concatenate([k for _, k in found]), parts)

    def as_set(raw: bytes) -> np.ndarray:
        return np.unique(character_shingles(lowered(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]), how.shingle)[0])

    def many(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = text_bytes(column)
        return character_shingles(lowered(data), at, how.shingle)

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k, data, at in slices(*text_bytes(batch.column(1)), SET_BYTES):
                sizes, sketches = links.outlines(*links.distinct(*character_shingles(lowered(data), at, how.shingle)), k - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k - i), pa.array(sizes, pa.int64()), sketches, batch.column(1).slice(i, k - i)], ["node", "n", "sketch", "elements"])

    def bounded(nodes: DataFrame) -> DataFrame:
        return F.broadcast(nodes) if nodes.count() <= how.broadcast_rows else nodes

    spare: list[DataFrame] = []

    def likely(lines: DataFrame, nodes: DataFrame) -> DataFrame:
        """``lines`` without most of those that ``nodes`` doesn't name, before they are shuffled: by a bitmap of the nodes' hashes, of 8 MB at most, where there are too many nodes to broadcast."""
        n = nodes.count()
        if n <= how.broadcast_rows:
            return lines
        words = min(1 << max(10, (n // 8).bit_length()), 1 << 20)
        hashed = F.xxhash64("node")
        word, bit = F.shiftrightunsigned(hashed, 6).bitwiseAND(words - 1).cast("int"), hashed.bitwiseAND(63).cast("int")
        filled = nodes.select(word.alias("word"), F.expr("1L << cast(xxhash64(node) & 63 as int)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        every = spark.range(words).select(F.col("id").cast("int").alias("word")).join(filled, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
        bitmap = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bitmap")), "line-bitmap")  # one row
        spare.append(bitmap)
        return lines.join(F.broadcast(bitmap), F.getbit(F.get("bitmap", word), bit) == 1, "left_semi")

    rows = lines.select("node", "line").mapInArrow(keys, links.KEYS_SCHEMA)
    groups = written(links.grouped(rows, buckets, how.percent), "line-groups", rows=how.lines_per_batch)
    wanted = written(groups.select(F.explode(F.concat(F.array("pivot"), F.col("members"))).alias("node")).distinct(), "line-nodes")
    chosen = likely(lines, wanted).join(bounded(wanted), "node", "left_semi").groupBy("node").agg(F.first(F.col("line").cast("binary")).alias("elements"))
    sketches = written(chosen.mapInArrow(outlines, "node long, n long, sketch binary, elements binary"), "line-outlines", rows=how.lines_per_batch)
    fetch = lambda nodes: sketches.join(bounded(nodes), "node", "left_semi").select("node", "elements")
    labels = links.resolve(groups, sketches, fetch, how.percent, as_set, many, at_once=True)
    discard(groups, wanted, sketches, *spare)
    return labels


def deduplicated(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """``row`` (struct of the caller's columns, its text and ``n_chars`` replaced), ``n_lines`` and ``n_removed``.

    A row is known by its id and a hash of its text. Rows that repeat both are found where the texts meet what goes of them: the first, by
    its other columns written as JSON, is treated as described, the others lose every line that has a word.
    """
    base = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("uid"))
    lines = base.select("uid", F.col("row.doc_id").alias("doc_id"), F.posexplode(F.split(F.col("row.text"), "\n", -1)).alias("place", "line"))
    has_word = f"[^{SPACE_CLASS}]"
    lines = lines.filter(F.col("line").rlike(has_word)).withColumn("node", F.xxhash64("line"))
    labels = _resolved(lines, how)
    places = written(lines.select("uid", "doc_id", "place", "node"), "line-places")
    # Counted by node before anything is joined, so that a common line is one row.
    first = places.groupBy("node").agg(F.min(F.struct("doc_id", "uid", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = written(first.join(labels, "node", "left").filter("n > 1 or label is not null").withColumn("label", F.coalesce("label", "node")), "line-firsts")
    kept = nodes.groupBy("label").agg(F.min("first").alias("keep"))
    doubtful = nodes.join(kept, "label").select("node", "keep.uid", "keep.place")
    if nodes.count() <= how.broadcast_rows:
        doubtful = F.broadcast(doubtful)
    gone = places.select("uid", "place", "node").alias("l").join(doubtful.alias("k"), "node").filter("l.uid != k.uid or l.place != k.place")
    gone = written(gone.groupBy("l.uid").agg(F.collect_set("l.place").alias("gone")), "lines-gone")
    discard(nodes, labels, places)
    extra = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    again = F.row_number().over(W.partitionBy("uid").orderBy(F.to_json(F.struct(*extra)) if extra else "uid")) > 1
    out = base.join(gone, "uid", "left").withColumn("again", again)
    left = F.filter(F.split("row.text", "\n", -1), lambda x, i: F.when(F.col("again"), ~x.rlike(has_word)).otherwise(~F.coalesce(F.array_contains("gone", i), F.lit(False))))
    out = out.withColumn("left", F.when(F.col("again") | F.col("gone").isNotNull(), left)).withColumn("text", F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("left").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1))).cast("long")
    return out.select(row.alias("row"), n_lines.alias("n_lines"), F.when(F.col("left").isNull(), 0).otherwise(n_lines - F.size("left")).cast("long").alias("n_removed"))


def report(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """One row per document: lines, lines removed, and the digest of the text that is left (null: empty)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return deduplicated(docs.select("doc_id", "text"), how).select("row.doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def filtered(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """The documents with their repeated lines removed."""
    return deduplicated(docs, how).select("row.*")
