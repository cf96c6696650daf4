"""Quality rules with thresholds that follow the data: quantile sketches per language and source.

Every document is measured once. Each measure is a ratio in thousandths (whole numbers, so that results
do not depend on the order of addition). A sketch is a histogram over buckets that keep the seven leading
bits of a value (relative error below 1/64); sketches are merged by adding bucket counts, so that
those of (language, source) add up to those of a language and of the corpus. From the quartiles of the
finest level with ``min_group`` measured documents come the fences that a kept document lies between.
Everything runs on DataFrame functions.

Defined results: a null, empty or blank text has no words and fails the base rule; a null language or source
is a group of its own; repeated rows are judged row by row; an empty table gives an empty result;
extra columns never clash, as the caller's columns travel in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tables import discard, written
from millrace.llm.text import SPACE_CLASS, words

MEASURES = ("word_length", "symbols", "dup_lines", "repeats")


@dataclass(frozen=True)
class QualityRules:
    """``reach``: fences lie so many spreads beyond the quartiles; ``least``: the smallest spread by measure, in thousandths."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    reach: int = 4
    least: tuple[int, int, int, int] = (500, 25, 90, 60)
    min_group: int = 100
    broadcast_rows: int = 300_000


def _measured(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """``row`` (the caller's columns) and the base figures."""
    n = rules.window
    symbols = r"[#*$%&|<>]"
    text = F.coalesce(F.col("row.text"), F.lit(""))
    out = docs.select(F.struct("*").alias("row"))
    out = out.select("row", words(text).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, symbols, ""))).cast("long").alias("n_symbols"))
    out = out.select(
        "row", "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.xxhash64(F.slice("words", i, n)))).alias("windows"),
    )
    # Only texts with a repeated window pay for the sort that places it.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("placed", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    out = out.withColumn("at", F.array_sort(F.transform(F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("placed")
    covered = F.aggregate(F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(n)), F.lit(n))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _with_ratios(measured: DataFrame) -> DataFrame:
    """Adds the measures in thousandths and the group's keys; documents that failed the base rule have no measures."""
    per = lambda a, b: F.when(~F.col("base_failed"), F.expr(f"(1000 * {a}) div {b}"))
    ratios = zip(MEASURES, (per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words")), strict=True)
    return measured.withColumns({k: v for k, v in ratios} | {f"{k}_key": F.coalesce(F.concat(F.lit("="), F.col(f"row.{k}").cast("string")), F.lit("null")) for k in ("lang", "source")})


def bucket(value: Column) -> Column:
    """The least value with the same seven leading bits."""
    rest = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return value - F.pmod(value, F.pow(F.lit(2), rest).cast("long"))


def sketches(ratios: DataFrame) -> DataFrame:
    """Bucket counts by (language, source), by language and over all; one row per level, group, measure and bucket."""
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in MEASURES)))
    fine = ratios.filter(~F.col("base_failed")).select("lang_key", "source_key", long.alias("x")).groupBy("lang_key", "source_key", "x.measure", "x.b").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (F.col("lang_key") if k < 2 else F.lit("")).alias("lang"), (F.col("source_key") if k < 1 else F.lit("")).alias("source")) for k in range(3))))
    return fine.select(levels.alias("g"), "measure", "b", "n").groupBy("g", "measure", "b").agg(F.sum("n").alias("n")).select("g.*", "measure", "b", "n")


def fences(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """``(level, lang, source, n, lo_<measure>, hi_<measure>)`` from the sketches' quartiles."""
    group = W.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("b")), "total": F.sum("n").over(group)})
    # The least bucket that reaches a quarter (three quarters) of the documents.
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("b")))
    q = ranked.groupBy("level", "lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("n"))
    least = F.element_at(F.create_map(*(F.lit(x) for pair in zip(MEASURES, rules.least, strict=True) for x in pair)), F.col("measure"))
    spread = rules.reach * F.greatest(F.col("q3") - F.col("q1"), least)
    q = q.select("level", "lang", "source", "measure", "n", (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))
    pick = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *(pick(c, m) for m in MEASURES for c in ("lo", "hi")))


def _group_fences(table: DataFrame, rules: QualityRules) -> DataFrame:
    """For each (language, source) the fences of its finest level with enough documents."""
    lo_hi = [f"{c}_{m}" for m in MEASURES for c in ("lo", "hi")]
    level = lambda k: table.filter(F.col("level") == k).select(*(F.col(c).alias(f"{c}{k}") for c in ("lang", "source", "n", *lo_hi)))
    every = level(0).join(level(1), F.col("lang0") == F.col("lang1")).crossJoin(F.broadcast(level(2)))  # level 2 is one row
    choose = lambda c: F.when(F.col("n0") >= rules.min_group, F.col(f"{c}0")).when(F.col("n1") >= rules.min_group, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c)
    return every.select(F.col("lang0").alias("lang_key"), F.col("source0").alias("source_key"), *(choose(c) for c in lo_hi))


def _judged(ratios: DataFrame, table: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return ratios.join(table, ["lang_key", "source_key"], "left").withColumn("kept", kept)


def _fence_table(ratios: DataFrame, rules: QualityRules) -> DataFrame:
    return written(_group_fences(fences(sketches(ratios), rules), rules).coalesce(1), "fences")


def report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: the base figures, ``base_failed`` and ``kept``."""
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    ratios = written(_with_ratios(_measured(docs, rules)).withColumn("row", F.struct("row.doc_id")), "quality")
    table = _fence_table(ratios, rules)
    out = written(_judged(ratios, table).select("row.doc_id", *figures, *MEASURES), "quality-report")
    discard(ratios, table)
    return out


def filtered(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, with their columns as they came.

    What a verdict depends on is the text, the language and the source; measures are stored under two hashes of these three, which tell a null from every value, and texts are read again for the result.
    """
    key = lambda at, k: F.xxhash64(F.lit(k), *(x for c in ("text", "lang", "source") for x in (F.col(f"{at}{c}").isNull(), F.col(f"{at}{c}"))))
    uid = lambda at: (key(at, 1).alias("uid"), key(at, 2).alias("uid2"))
    ratios = _with_ratios(_measured(docs.select("text", "lang", "source"), rules)).withColumn("row", F.struct(*uid("row.")))
    ratios = written(ratios, "quality")
    table = _fence_table(ratios, rules)
    rejected = written(_judged(ratios, table).filter("not kept").select("row.uid", "row.uid2").distinct(), "rejected")
    discard(ratios, table)
    if rejected.count() <= rules.broadcast_rows:
        rejected = F.broadcast(rejected)
    return docs.select(F.struct("*").alias("row"), *uid("")).join(rejected, ["uid", "uid2"], "left_anti").select("row.*")
