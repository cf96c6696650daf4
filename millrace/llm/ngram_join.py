"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. Inside a size band every set is split by hash into
the band's segments, and a segment's sketch is the XOR of its hashes. An element that only one of two sets
has touches one segment, so the number of differing segments bounds the symmetric difference from below; for similar sets it is at most
d = (n + m)(100 - s)/(100 + s). By the pigeonhole principle two similar sets agree in one of their first d + 1 segments that are not empty: of
the segments before the first one without a difference, every one that is not empty has a difference. Each document therefore joins on the
sketches of its first d + 1 such segments, d being taken for the largest partner, in its own size band and in
the following ones where a partner may lie. A band has as few segments as that allows, so that each holds two or three elements and a
shingle or passage that many documents share does not bring them together by itself. A document with too few segments of that kind joins again under the next seed, and at last on every
element. Candidates are ruled out by Hamming distance between whole parity sketches and then verified on the sets (``links``).

Defined results: a null or blank text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle; a null ``doc_id`` is a document of its own that never becomes a component's id unless it stands alone; repeated rows are equal documents;
an empty table gives an empty result. Equal sets are one node, so copies are never paired with each other. Shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import links
from millrace.llm.hashing import U, lowered, mix, set_id, shingle_hashes, short_hash, slices, text_bytes, word_hashes
from millrace.llm.tables import discard, written

SEEDS = 6


@dataclass(frozen=True)
class NgramJoin:
    """``percent``: least similarity; the table of candidate nodes is broadcast up to ``broadcast_rows`` rows, counted beforehand."""

    words: int = 5
    percent: int = 75
    rows_per_batch: int = 1000
    broadcast_rows: int = 300_000


@lru_cache(maxsize=4096)
def band(n: int) -> tuple[int, int]:
    """First size of the size band and of the next one: powers of the square root of two, rounded up."""
    k = max(0, int(2 * log2(n)) - 2)
    while ceil(2 ** ((k + 1) / 2)) <= n:
        k += 1
    return ceil(2 ** (k / 2)), ceil(2 ** ((k + 1) / 2))


@lru_cache(maxsize=256)
def segments(start: int, percent: int) -> int:
    """As few as leave the band's largest sets enough that are not empty: the fuller a segment, the fewer sets share it by chance."""
    largest = band(start)[1] - 1
    need = links.allowed(largest, largest, percent) + 1
    n = need
    while n * (1 - exp(-largest / n)) < need + 0.4 * n**0.5 * (need > 1) and n < 4 * largest:
        n += max(1, n // 64)
    return n


def join_keys(distinct: np.ndarray, percent: int) -> np.ndarray:
    """The segment sketches that a set joins on, in its own band and in those of larger partners."""
    n = len(distinct)
    largest = 100 * n // percent
    out = []
    start = 0
    while start <= largest:
        start, following = band(max(n, start))
        need = links.allowed(n, max(n, min(largest, following - 1)), percent) + 1
        for seed in range(SEEDS + 1):
            h = mix(distinct ^ U(0x9FB21C651E98DF25 * (seed + 1) % (1 << 64)))
            if seed == SEEDS:
                out.append(mix(h + U(start)))
                break
            where = (h >> U(20)) % U(segments(start, percent))
            order = np.argsort(where, kind="stable")
            where = where[order]
            firsts = np.flatnonzero(np.diff(where, prepend=U(1 << 40)))
            parity = np.bitwise_xor.reduceat(h[order], firsts)
            out.append(mix(parity ^ mix(where[firsts] + U((start << 20) + (seed << 60))))[:need])
            if len(firsts) >= need:
                break
        start = following
    return np.concatenate(out)


def document_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes, sorted, text by text."""
    for _, _, part, starts in slices(data, offsets):
        words, at = word_hashes(lowered(part), starts)
        shingles = shingle_hashes(words, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(shingles[a : b - n + 1])
            else:
                yield short_hash(words[a:b]) if b > a else np.zeros(0, U)


def _passes(docs: DataFrame, how: NgramJoin, buckets: int) -> tuple[DataFrame, DataFrame, Callable, Callable]:
    """Plans over all texts, ids and sizes and join keys; and plans over wanted ones, sketches and whole sets."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(set_id(s), len(s)) for s in document_sets(*text_bytes(batch.column(1)), how.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i if n else None for i, n in sets], pa.int64()), pa.array([n for _, n in sets], pa.int64())], ["doc_id", "node", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, out = [], [], []
            for s in document_sets(*text_bytes(batch.column(1)), how.words):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    nodes.append(i)
                    sizes.append(len(s))
                    out.append(join_keys(s, how.percent))
            if len(seen) > 500_000:  # only saves repeats; the reducer counts a node once
                seen.clear()
            yield links.key_rows(np.array(nodes, np.int64), np.array(sizes, np.int64), np.array([len(k) for k in out], np.int64), np.concatenate([*out, np.zeros(0, U)]), buckets)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(i, s) for i, s in zip(batch.column(0).to_pylist(), document_sets(*text_bytes(batch.column(1)), how.words), strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in every], pa.int64()), pa.array([set_id(s) for _, s in every], pa.int64()), pa.array([s.tobytes() for _, s in every], pa.binary())], ["doc_id", "node", "elements"])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(i, s) for i, s in zip(batch.column(0).to_pylist(), document_sets(*text_bytes(batch.column(1)), how.words), strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in every], pa.int64()), pa.array([set_id(s) for _, s in every], pa.int64()), pa.array([len(s) for _, s in every], pa.int64()), pa.array([links.sketch(s) for _, s in every], pa.binary())], ["doc_id", "node", "n", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(wanted: DataFrame, task: Callable, schema: str) -> DataFrame:
        """What a task makes of the documents that stand for the wanted nodes; only their texts are read into it."""
        if wanted.count() <= how.broadcast_rows:
            wanted = F.broadcast(wanted)
        chosen = texts.alias("t").join(wanted.select("doc_id").distinct().alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
        on = F.col("s.node").eqNullSafe(F.col("w.node")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
        # Rows that share an id with a wanted document fall away here; of equal rows one stays.
        return chosen.mapInArrow(task, schema).alias("s").join(wanted.alias("w"), on, "left_semi").drop("doc_id")

    sketches = lambda wanted: of(wanted, outlines, "doc_id long, node long, n long, sketch binary")
    elements = lambda wanted: of(wanted, sets, "doc_id long, node long, elements binary")
    return texts.mapInArrow(ids, "doc_id long, node long, n long"), texts.mapInArrow(keys, links.KEYS_SCHEMA), sketches, elements


def joined(docs: DataFrame, how: NgramJoin = NgramJoin()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids, keys, sketches, elements = _passes(docs, how, buckets)
    ids = written(ids, "ids", rows=how.rows_per_batch)
    groups = written(links.grouped(keys, buckets, how.percent), "groups", rows=how.rows_per_batch)
    nodes = groups.select(F.explode(F.concat(F.array("pivot"), F.col("members"))).alias("node")).distinct()
    first = ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(first.join(nodes, "node"), "wanted")
    outlines = written(sketches(wanted).dropDuplicates(["node"]), "outlines", rows=how.rows_per_batch)
    asked: list[DataFrame] = []

    def fetch(some: DataFrame) -> DataFrame:
        discard(*asked)  # the sets of the round before are stored
        asked[:] = [written(wanted.join(some, "node"), "asked")]
        return elements(asked[0]).dropDuplicates(["node"])

    labels = links.resolve(groups, outlines, fetch, how.percent)
    discard(groups, wanted, outlines, *asked)
    rows = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, how: NgramJoin = NgramJoin()) -> DataFrame:
    """One document of each component, with its columns as they came: the one whose id names the component.

    Of rows that repeat an id, and of rows without one, all stay together.
    """
    drop = joined(docs, how).filter("doc_id != component_id").select(F.col("doc_id").alias("_dropped_id"))
    row = docs.select(F.struct("*").alias("row"))
    return row.join(drop, F.col("row.doc_id") == F.col("_dropped_id"), "left_anti").select("row.*")
