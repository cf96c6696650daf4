"""Importance resampling towards a target's distribution of hashed word features.

Features are runs of one to ``ngram`` words; a feature's bucket is the checksum of its bytes, modulo the number of buckets. The
logarithm of how much likelier a bucket is in the target than in the corpus is its gain, the mean gain of a document's features its weight, and
the documents with the greatest weight plus Gumbel noise are a draw without replacement.

Features are made for a batch at once: its texts are joined with a sentinel that no word holds, one pass of a
regular expression finds all words, a search for their places among the texts' offsets tells which runs cross from one text into the next,
and what is left is counted. Checksums of runs come from those of their words, as a checksum moved over n further bytes is a
linear map of its bits. Features are made twice, for counts and for weights, so that nothing but one row a document is stored. Ranks come
from counts by score and range of ids; no task sorts all documents.

Defined results: a null or empty text has no words and no features, and weight 0; fewer words than ``min_words`` are never drawn; a null id
is hashed as an empty one and comes after other ids; repeated rows are drawn each for itself; documents with equal scores and ids come in
the order of their features and weights; an empty table gives an empty result, an empty target is one without features; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.hashing import text_bytes
from millrace.llm.tables import written

U = np.uint32
#: Longer words are rare, and their checksums are carried on byte by byte.
_MOVES = 64


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with ``min_words`` are drawn. ``buckets`` numbers pass through the driver; ``span`` ids are ranked in one group at most."""

    buckets: int = 10_000
    ngram: int = 2
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    scale: int = 1000
    span: int = 1 << 20
    batch_bytes: int = 1 << 20
    words_kept: int = 500_000
    rows_per_batch: int = 1000
    broadcast_rows: int = 300_000


@lru_cache(maxsize=1)
def _moved() -> np.ndarray:
    """``[n, k, byte]``: what byte k of a checksum becomes when n zero bytes follow."""
    step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], U)  # linear in the byte
    at = (np.arange(256, dtype=U)[None, :] << (8 * np.arange(4, dtype=U))[:, None]).astype(U)
    out = [at]
    for _ in range(_MOVES - 1):
        at = (at >> U(8)) ^ step[at & U(255)]
        out.append(at)
    return np.stack(out)


def carried(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums after ``sizes`` (below 64) zero bytes."""
    table = _moved().ravel()
    base = sizes * 1024
    out = table[base + (crc & U(255))]
    for k in range(1, 4):
        out = out ^ table[base + 256 * k + ((crc >> U(8 * k)) & U(255))]
    return out


class BatchFeatures:
    """Words and buckets of many texts at once. Keeps a bounded number of words' checksums between batches."""

    #: All separators are ASCII, so that bytes of UTF-8 are split like characters; 0 is one of them and the sentinel.
    _apart = re.compile(rb"([\x00-\x2F\x3A-\x60\x7B-\x7F]+)")

    def __init__(self, how: Resampling) -> None:
        self.how = how
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.alone, self.spaced, self.sizes = (np.zeros(0, k) for k in (U, U, np.int64))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.how.words_kept:
            self._clear()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        crc = zlib.crc32
        more = (np.fromiter(map(crc, new), U, len(new)), np.fromiter((crc(b" " + w) for w in new), U, len(new)), np.fromiter(map(len, new), np.int64, len(new)))
        self.alone, self.spaced, self.sizes = (np.concatenate(x) for x in zip((self.alone, self.spaced, self.sizes), more, strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text; and for runs of one word, two words and so on the texts and buckets of all of them."""
        joined = b"\0".join(texts).lower()  # of bytes: A-Z only
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        parts = self._apart.split(joined)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[::2]
        words = parts[::2]
        if words and not words[-1]:
            words, ends = words[:-1], ends[:-1]
        if words and not words[0]:
            words, ends = words[1:], ends[1:]
        text = np.searchsorted(offsets, ends, "left") - 1  # a word ends behind its text's offset and before the next one
        n = self._numbers(words)
        runs, crc = [], self.alone[n]
        runs.append((text, crc % U(self.how.buckets)))
        for k in range(1, self.how.ngram):
            if len(n) <= k:
                break
            size = self.sizes[n[k:]] + 1
            long = np.flatnonzero(size >= _MOVES)
            before, crc = crc[:-1], carried(crc[:-1], np.minimum(size, _MOVES - 1)) ^ self.spaced[n[k:]]
            for i in long.tolist():
                crc[i] = zlib.crc32(b" " + words[i + k], int(before[i]))
            inside = text[k:] == text[:-k]
            runs.append((text[k:][inside], (crc % U(self.how.buckets))[inside]))
        return np.bincount(text, minlength=len(texts)), runs


def _batches(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts with about ``limit`` bytes, and the row at which each begins."""
    data, offsets = text_bytes(batch.column(column))
    i = 0
    while i < len(offsets) - 1:
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        at = (offsets[i : k + 1] - offsets[i]).tolist()
        raw = data[offsets[i] : offsets[k]].tobytes()
        yield i, [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        i = k


def _counter(how: Resampling) -> Callable:
    """Counts of every bucket over a task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = BatchFeatures(how), np.zeros(how.buckets, np.int64)
        for batch in batches:
            for _, texts in _batches(batch, 0, how.batch_bytes):
                for _, buckets in features(texts)[1]:
                    total += np.bincount(buckets, minlength=how.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``bucket, n`` over all texts: a task adds up its own before anything moves."""
    return texts.select(F.col("text").cast("string")).mapInArrow(_counter(how), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``bucket, gain`` for every bucket, from the counts of both."""
    every = corpus.sparkSession.range(how.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    b = float(how.buckets)
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + b) / ((F.col("s") + 1.0) * (F.col("all_t") + b))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(how.scale * F.log(ratio)).alias("gain"))  # one row


def weighed(docs: DataFrame, by_bucket: np.ndarray, how: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = BatchFeatures(how)
        for batch in batches:
            for first, texts in _batches(batch, 1, how.batch_bytes):
                words, runs = features(texts)
                number, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for owner, buckets in runs:
                    number += np.bincount(owner, minlength=len(texts))
                    total += np.bincount(owner, weights=by_bucket[buckets], minlength=len(texts)).astype(np.int64)  # whole numbers below 2^53
                weight = np.where(number > 0, total // np.maximum(number, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array(x, pa.int64()) for x in (words, number, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document, as a written table."""
    counts = written(bucket_counts(docs, how).withColumn("side", F.lit("s")).unionByName(bucket_counts(target, how).withColumn("side", F.lit("t"))), "buckets", rows=how.rows_per_batch)
    side = lambda k: counts.filter(F.col("side") == k).drop("side")
    by_bucket = np.zeros(how.buckets, np.int64)
    for r in gains(side("s"), side("t"), how).collect():  # one number a bucket, whatever the input
        by_bucket[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-how.scale * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return written(weighed(docs, by_bucket, how).withColumn("score", F.col("weight") + noise), "scored", rows=how.rows_per_batch)


def ranked(scores: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """Adds ``rank`` (from 1, greatest score first) of the documents that are drawn; null for all others.

    Scores are whole numbers of a narrow range: documents are counted by score and span of ids, counts are added up, and only the place inside
    such a cell comes from a window.
    """
    able = F.col("n_words") >= how.min_words
    cell = F.coalesce(F.floor(F.col("doc_id") / how.span), F.lit(1 << 62))
    rows = scores.withColumn("cell", cell)
    cells = written(rows.filter(able).groupBy("score", "cell").agg(F.count(F.lit(1)).alias("n")), "score-cells")
    upto = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)  # a row for each distinct score
    by_score = cells.groupBy("score").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    drawn = cells.agg(F.floor(how.percent * F.coalesce(F.sum("n"), F.lit(0)) / 100).alias("drawn"))
    by_score = by_score.drop("n").crossJoin(F.broadcast(drawn)).filter("above < drawn")  # one row
    inside = W.partitionBy("score").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    before = cells.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(by_score, "score").select("score", "cell", (F.col("above") + F.col("earlier")).alias("before"), "drawn")
    before = written(before, "score-starts")
    small = F.broadcast(before) if before.count() <= how.broadcast_rows else before
    out = rows.join(small, ["score", "cell"], "left").withColumn("before", F.when(able, F.col("before")))
    place = F.row_number().over(W.partitionBy("score", "cell").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    top = out.filter("before IS NOT NULL").withColumn("rank", (F.col("before") + place).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = out.filter("before IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("cell", "before", "drawn")


def report(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """One row per document: features, weight, score, and its rank in the draw."""
    return ranked(scored(docs, target, how), how).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """The documents that are drawn, with their columns as they came; rows that share an id are drawn when one of them is."""
    drawn = report(docs, target, how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi")
