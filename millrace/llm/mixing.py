"""Mixing sources to target weights by systematic sampling.

A source's documents stand in a fixed order (by size or by a hash of it, then by a hash of the row's key); each has the same expected
number of copies, its source's target over its size. The copies expected up to a document, plus one random
offset per source, cross a whole number for every copy that the mix takes of it. Ordering by size spreads
the rounding evenly over short and long documents. Of a number of seeded orders and random offsets the pair is used whose words come
nearest to the target, which matters where a few documents hold most of a source.

The order is never built in one task: documents are counted by (source, size, slice), the counts are added up
along a source, and only the rank inside such a cell is taken from a window. A source's slices bound
what one task holds even where a third of all rows are copies of one text.

Defined results: a null text has size 0; documents of size 0 and sources without words are taken 0 times; a null
source is a source of its own that comes last; repeated rows count each for itself; an empty table gives an
empty result. Reruns agree, as all randomness is hashed from ``seed``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tables import written
from millrace.llm.text import word_count


@dataclass(frozen=True)
class Mix:
    """Weights repeat along the sources in the order of their code points. ``share_percent`` of all sizes is dealt out.

    A source has so many seeded ``orders`` of its sizes, and ``offsets`` in each, to choose from; rows of sources are broadcast up to ``broadcast_sources``.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    most_times: int = 2
    slices: int = 256
    seed: int = 17
    orders: int = 8
    offsets: int = 32
    broadcast_sources: int = 50_000


def targets(by_source: DataFrame, mix: Mix) -> DataFrame:
    """``(source, source_size, target)``; what a capped source can't take is dealt to the others by weight.

    With limits of ``most_times`` the size, the share of each source is the smaller of its limit and its weight times
    one common level. Sources in the order of limit over weight are capped from the front; the level is the one of the
    first source that stays below its limit. Works on one row per source, not on documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(place, F.lit(len(mix.weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", mix.most_times * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    s = s.withColumn("level", (mix.share_percent * F.col("total") - 100 * F.col("capped")) / (100 * F.col("open")))
    s = s.withColumn("level", F.max_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("open"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _offsets(sizes: DataFrame, dealt: DataFrame, mix: Mix, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(source, turn, offset)``: of a source's seeded orders and offsets the pair whose mix comes nearest to the target.

    How many copies an offset takes of a source's documents of one size follows from their ranks, so the choice is made on counts by size.
    """
    draw = lambda k: F.pmod(F.xxhash64(F.lit(mix.seed), F.lit(k), F.col("source")), F.lit(1_000_000)) / 1_000_000.0
    rate = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    crossed = lambda k: F.floor((F.col("smaller") + F.col("n")) * rate + draw(k)) - F.floor(F.col("smaller") * rate + draw(k))
    taken = sizes.filter("size > 0").join(small(dealt), "source").groupBy("source", "turn", "target").agg(*(F.sum(F.col("size") * crossed(k)).alias(f"taken{k}") for k in range(mix.offsets)))
    choices = F.array(*(F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.col("turn"), draw(k).alias("offset")) for k in range(mix.offsets)))
    best = taken.groupBy("source").agg(F.min(F.array_min(choices)).alias("best"))
    return best.select("source", "best.turn", "best.offset")


def mixed(docs: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (struct of the caller's columns, or of ``keep``), ``size``, ``source_size``, ``target``, ``copies``.

    Rows that are cut to ``keep`` are stored; whole rows are read a second time instead, and move once.
    """
    key = F.xxhash64(F.lit(mix.seed), F.col("row.doc_id"), F.col("row.text"))
    rows = docs.select(F.struct("*").alias("row"), word_count(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"))
    rows = rows.select(F.struct(*(F.col(f"row.{c}") for c in keep)).alias("row") if keep is not None else "row", "size", "source", key.alias("key")).withColumn("slice", F.pmod("key", F.lit(mix.slices)))
    if keep is not None:
        rows = written(rows, "mixing")
    cells = written(rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "cells")
    by_source = cells.groupBy(F.when(F.col("source") != "", F.substr("source", F.lit(2))).alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    dealt = targets(by_source, mix).withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    dealt = written(dealt, "targets")  # one row per source
    # Two steps, so that a window spans a source's distinct sizes and not all its cells.
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(mix.orders - 1))))
    place = F.when(F.col("turn") == 0, F.col("size").cast("long")).otherwise(F.xxhash64(F.lit(mix.seed), "turn", "source", "size"))
    along = W.partitionBy("source", "turn").orderBy(place, "size").rowsBetween(W.unboundedPreceding, -1)
    sizes = written(sizes.select("source", "turn", "size", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("smaller")), "sizes")
    few = dealt.count() <= mix.broadcast_sources
    small = lambda df: F.broadcast(df) if few else df
    offsets = written(_offsets(sizes, dealt, mix, small), "offsets")
    inside = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "size", "slice", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("earlier"))
    dealt = dealt.join(offsets, "source", "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    start = cells.join(sizes.join(small(dealt), ["source", "turn"]).select("source", "size", "smaller", "source_size", "target", "offset"), ["source", "size"])
    start = start.select("source", "size", "slice", (F.col("smaller") + F.col("earlier")).alias("before"), "source_size", "target", "offset")
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("key")))
    out = ranked.join(start, ["source", "size", "slice"]).withColumn("rank", F.col("before") + F.col("nth"))
    rate, u = F.col("target") / F.col("source_size"), F.col("offset")
    crossed = F.floor(F.col("rank") * rate + u) - F.floor((F.col("rank") - 1) * rate + u)
    return out.select("row", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("source_size") > 0), crossed).otherwise(0).cast("long").alias("copies"))


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: ``size``, its source's size and target, and the words that the mix takes of it."""
    return mixed(docs, mix, keep=("doc_id",)).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def sampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix: each document as often as it is taken, with its columns as they came."""
    out = mixed(docs, mix).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
