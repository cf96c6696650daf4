"""Removal of long repeated byte strings with a run-length index.

A text's suffixes are only compared where a long match is possible. Of the hashes of all ``key``-byte strings, those that are the least
of some window are anchors; every string of ``length`` bytes holds an anchor, at the same place in each of its
copies, so equal strings meet in the group of one anchor. An anchor's segment is the text in which such strings can lie.

Segments of a group that are equal are covered whole. For the different segments of a group a run-compressed Burrows-Wheeler transform is built
column by column from their common alignment (a positional transform: rows are sorted by what stands before the column, read backwards). A column is
kept as runs of equal bytes. Each row has the start of its match with the row before it; inside a run it carries over, and at a run's head it is the latest start
between the ends of the run and of the last run with the same byte, found from one sample per run. The matching statistic of a row at a column is the longer of the matches
with its two neighbours; where it reaches ``length``, the string that ends there also starts elsewhere.

Work is dealt by anchor; tasks hold whole groups in flat arrays. Documents are numbered in a written copy, so that repeated rows and ids stay apart.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are equal texts; removed strings may end inside a
character, so what is left is bytes; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import U, mix, powers, prefix_sums, slices, text_bytes
from millrace.llm.tables import written

#: Stands where a segment has no byte; UTF-8 does not use it.
_NONE = 0xFF
_FAR = 1 << 20


@dataclass(frozen=True)
class SuffixDedup:
    """Strings of ``length`` bytes; anchors have ``key`` bytes. ``rows_at_once`` bounds the segments in one transform; a larger group is split by what stands beside its key."""

    length: int = 200
    key: int = 100
    rows_per_batch: int = 1000
    rows_at_once: int = 30_000


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def anchors(sums: np.ndarray, down: np.ndarray, a: int, b: int, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the key, digest of the segment, and place in the text, for every anchor of the text at ``a`` to ``b``."""
    k, reach = how.key, how.length - how.key
    at = np.arange(a, b - k + 1)
    h = mix((sums[a + k : b + 1] - sums[a : b - k + 1]) * down[a : b - k + 1])
    least = window_min(h, reach + 1)
    # A value is chosen where it is the least of some window that it lies in: compare with the greatest of those minima.
    padded = np.concatenate((np.zeros(reach, U), least, np.zeros(reach, U)))
    greatest = ~window_min(~padded, reach + 1)
    chosen = np.flatnonzero(h == greatest[: len(h)])
    p = at[chosen]
    lo, hi = np.maximum(p - reach, a), np.minimum(p + how.length, b)
    digest = mix((sums[hi] - sums[lo]) * down[lo] + (hi - p).astype(U) * U(0xA24BAED4963EE407) + (p - lo).astype(U) * U(0x9FB21C651E98DF25))
    return h[chosen], digest, chosen


def match_ends(rows: np.ndarray, group: np.ndarray, clip: np.ndarray, end: np.ndarray, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which each row's matching statistic reaches ``length``; ``_FAR`` and -1 if none does.

    ``rows`` has one aligned segment per row, in the order of ``group``; ``clip`` and ``end`` are where its bytes begin and end.
    """
    m, width = rows.shape
    columns = np.ascontiguousarray(rows.T)
    order = np.arange(m)
    head = np.ones(m, bool)
    head[1:] = group[1:] != group[:-1]
    start = np.where(head, _FAR, 0)
    base = np.cumsum(head).astype(np.int64) << 8
    first, last = np.full(m, _FAR), np.full(m, -1)
    reach = how.length - how.key
    for c in range(width):
        if not reach <= c < how.length:  # the key's columns are equal in a group
            byte = columns[c][order]
            edge = head.copy()
            edge[1:] |= byte[1:] != byte[:-1]
            runs = np.flatnonzero(edge)
            if len(runs) > base[-1] >> 8:
                value = base[runs] + byte[runs]
                latest = np.maximum.reduceat(np.where(head, 0, start), runs)  # one sample per run
                by = np.argsort(value, kind="stable")
                same = np.zeros(len(by), bool)
                same[1:] = value[by][1:] == value[by][:-1]
                t, u = by[1:][same[1:]], by[:-1][same[1:]]
                fresh = np.full(len(runs), c + 1)
                fresh[t] = np.maximum(_range_max(latest, u + 1, t), start[runs[t]])
                sizes = np.diff(runs, append=m)
                start[runs] = fresh
                # Runs move as a whole, in the order of their byte.
                moved = np.repeat(runs[by] - np.concatenate(([0], np.cumsum(sizes[by])[:-1])), sizes[by]) + np.arange(m)
                order, start = order[moved], start[moved]
                start[head] = _FAR
        if c >= how.length - 1:
            after = np.append(start[1:], _FAR)
            match = np.maximum(np.minimum(start, after), clip[order])
            hit = order[(c + 1 - match >= how.length) & (c < end[order])]
            first[hit] = np.minimum(first[hit], c)
            last[hit] = c
    return first, last


def _range_max(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Greatest of ``x[a:b]``, 0 for an empty range."""
    out = np.zeros(len(a), x.dtype)
    size = b - a
    level, width = x, 1
    while True:
        here = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(here):
            out[here] = np.maximum(level[a[here]], level[b[here] - width])
        if not (size >= 2 * width).any():
            return out
        level = np.maximum(level[:-width], level[width:])
        width *= 2


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("uid")), "numbered")


def _plans(how: SuffixDedup, buckets: int) -> tuple:
    """The four functions that run in tasks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of each text, packed by bucket."""
        for batch in batches:
            uids = batch.column(0).to_pylist()
            keys, digests, places, owners = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, k, data, at in slices(*text_bytes(batch.column(1))):
                sums, (_, down) = prefix_sums(data), powers(len(data))
                for uid, a, b in zip(uids[i:k], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if b - a >= how.length:
                        h, d, p = anchors(sums, down, a, b, how)
                        keys.append(h)
                        digests.append(d)
                        places.append(p)
                        owners.append(np.full(len(p), uid))
            h = np.concatenate(keys)
            bucket = ((h >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            columns = [x[order] for x in (h, np.concatenate(digests), np.concatenate(owners), np.concatenate(places).astype(np.uint32))]
            full = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()) for c in columns)], ["bucket", "keys", "digests", "owners", "places"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of shared anchors: ``covered`` where the whole segment is repeated, ``asked`` where the transform needs the segment."""
        parts: list[list] = [[], [], [], []]
        for batch in batches:
            for out, column, kind in zip(parts, batch.columns[1:], (U, U, np.int64, np.uint32), strict=True):
                out += [np.frombuffer(x, kind) for x in column.to_pylist()]
        if not parts[0]:
            return
        h, d, uid, place = map(np.concatenate, parts)
        order = np.lexsort((place, uid, d, h))
        h, d, uid, place = h[order], d[order], uid[order], place[order]
        n = len(h)
        new_h, new_d = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_d[1:] = new_h[1:] | (d[1:] != d[:-1])
        kinds = np.add.reduceat(new_d.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
        copies = np.diff(np.flatnonzero(new_d), append=n)[np.cumsum(new_d) - 1]
        covered, asked = copies > 1, new_d & (kinds > 1)
        hot = kinds > how.rows_at_once
        keep = np.flatnonzero(covered | asked)
        for i in range(0, len(keep), 500_000):
            k = keep[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(uid[k]), pa.array(place[k].astype(np.int64)), pa.array(h[k].view(np.int64)), pa.array(covered[k]), pa.array(asked[k]), pa.array(hot[k])], ["uid", "place", "anchor", "covered", "asked", "hot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments that are asked for.

        Every string of ``length`` around the key holds ``side`` bytes left or right of it, so a hot anchor's segments are dealt by either.
        """
        side = (how.length - how.key) // 2
        for batch in batches:
            out: list[tuple] = []
            for uid, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in asked:
                    lo = max(x["place"] - (how.length - how.key), 0)
                    segment, key = text[lo : x["place"] + how.length], x["place"] - lo
                    groups = [x["anchor"]]
                    if x["hot"]:
                        around = (b"l" + segment[max(key - side, 0) : key], b"r" + segment[key + how.key : key + how.key + side])
                        groups = [int.from_bytes(hashlib.blake2b(b"%d" % x["anchor"] + a, digest_size=8).digest(), "little", signed=True) for a in around if len(a) == side + 1]
                    out += [(g, uid, x["place"], segment) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["anchor", "uid", "place", "segment"])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that the matching statistics mark."""
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        table = table.take(pa.array(np.argsort(table.column(0).to_numpy(), kind="stable")))
        anchor, uid, place = (table.column(i).to_numpy() for i in range(3))
        data, at = text_bytes(table.column(3))
        sizes = np.diff(at)
        reach = how.length - how.key
        clip = np.maximum(reach - place, 0)
        heads = np.append(np.flatnonzero(np.diff(anchor, prepend=~anchor[:1])), len(anchor))
        i = 0
        while i < len(heads) - 1:
            k = max(i + 1, int(np.searchsorted(heads, heads[i] + how.rows_at_once, "right")) - 1)
            s = slice(int(heads[i]), int(heads[k]))
            n = s.stop - s.start
            rows = np.full((n, reach + how.length), _NONE, np.uint8)
            inside = np.arange(int(at[s.stop] - at[s.start])) - np.repeat(at[s] - at[s.start], sizes[s])
            rows[np.repeat(np.arange(n), sizes[s]), inside + np.repeat(clip[s], sizes[s])] = data[at[s.start] : at[s.stop]]
            first, last = match_ends(rows, anchor[s], clip[s], clip[s] + sizes[s], how)
            hit = np.flatnonzero(last >= 0)
            begin = place[s][hit] - reach
            yield pa.RecordBatch.from_arrays([pa.array(uid[s][hit]), pa.array(begin + first[hit] + 1 - how.length), pa.array(begin + last[hit] + 1)], ["uid", "lo", "hi"])
            i = k

    return find, compare, cut, transform


def spans(base: DataFrame, how: SuffixDedup) -> DataFrame:
    """``(uid, lo, hi)``: stretches of bytes in which every string of ``length`` also starts elsewhere; they may overlap."""
    spark = base.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    find, compare, cut, transform = _plans(how, buckets)
    packed = base.select("uid", "text").mapInArrow(find, "bucket int, keys binary, digests binary, owners binary, places binary")
    shared = packed.repartition(buckets, "bucket").mapInArrow(compare, "uid long, place long, anchor long, covered boolean, asked boolean, hot boolean")
    shared = written(shared, "anchors", rows=how.rows_per_batch)
    asked = shared.filter("asked").groupBy("uid").agg(F.collect_list(F.struct("place", "anchor", "hot")).alias("asked"))
    segments = base.select("uid", "text").join(asked, "uid").mapInArrow(cut, "anchor long, uid long, place long, segment binary")
    marked = segments.repartition(buckets, "anchor").mapInArrow(transform, "uid long, lo long, hi long")
    whole = shared.filter("covered").join(base.select("uid", F.length("text").alias("size")), "uid").select("uid", F.greatest(F.col("place") - (how.length - how.key), F.lit(0)).alias("lo"), F.least(F.col("place") + how.length, F.col("size")).cast("long").alias("hi"))
    return written(marked.unionByName(whole), "spans", rows=how.rows_per_batch)


def _removed(docs: DataFrame, how: SuffixDedup) -> DataFrame:
    base = _numbered(docs)
    found = spans(base, how)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((m["lo"], m["hi"]) for m in marks or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                begins, ends = [0, *(hi for _, hi in merged)], [*(lo for lo, _ in merged), len(text)]
                left = b"".join(text[a:b] for a, b in zip(begins, ends, strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(len(merged))
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marks = found.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return base.join(marks, "uid", "left").select("doc_id", "text", "marks").mapInArrow(remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame, how: SuffixDedup = SuffixDedup()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that are left) for every row, as a written table."""
    return written(_removed(docs, how), "deduplicated", rows=how.rows_per_batch)  # bounds the texts that one batch brings


def report(docs: DataFrame, how: SuffixDedup = SuffixDedup()) -> DataFrame:
    """One row per document: bytes, bytes removed, stretches removed, and the digest of what is left."""
    digests = _removed(docs, how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return written(digests, "suffix-report", rows=how.rows_per_batch)
