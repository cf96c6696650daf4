"""URL filter: host and path rules first, then a ratio of two character language models.

The URLs that a rule blocks and those that a rule allows train two smoothed variable-order Markov models
over folded characters. A character's probability is taken in the longest context that was seen, mixed with the shorter ones in the
proportion of distinct to all continuations of the context. The score of a URL is the difference of its two
log-likelihoods over its length. The threshold is calibrated on rule-judged URLs that were held out of the training:
the bin edge with the least sum of both error rates, the one nearest to zero on ties. Everything runs on DataFrame functions; the
models are tables of grams, whose counts are added up before they are shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored as it stands;
a URL without characters scores 0; without a URL for either model the method allows everything; repeated rows are
judged alike, row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tables import written

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class UrlModel:
    """``order``: characters of context; one in ``held_out`` rule-judged URLs calibrates; ``bins`` over scores of up to ``bound``.

    The gram table is broadcast only up to ``broadcast_rows`` rows, counted beforehand; beyond it is joined by shuffle.
    """

    rules: tuple[tuple[str, str, str], ...] = RULES
    order: int = 3
    held_out: int = 5
    bins: int = 4000
    bound: float = 10.0
    broadcast_rows: int = 250_000
    symbols: int = 64


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """Lower case, digits as 0, and one sign for everything outside printable ASCII: a closed alphabet."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), r"[^!-`{-}a-z]", "~")


def _grams(text: Column, order: int) -> Column:
    """Each character with the ``order`` before it; the start is padded."""
    padded = F.concat(F.lit(" " * order), text)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(order + 1))))


def trained(grams: DataFrame, model: UrlModel) -> DataFrame:
    """``(gram, ratio)``: log of the accepted over the rejected model's probability, for every gram of the corpus.

    ``grams`` has ``gram, allow, block`` (counts, zero for URLs that no rule judged).
    """
    k = model.order
    out = grams
    p = {v: F.lit(1.0 / model.symbols) for v in ("allow", "block")}
    for n in range(k + 1):
        own = F.substring("gram", k + 1 - n, n + 1)
        context = F.substring("gram", k + 1 - n, n) if n else F.lit("")
        counts = grams.groupBy(own.alias("own"), context.alias("context")).agg(*(F.sum(v).alias(v) for v in p))
        seen = counts.groupBy("context").agg(*(F.sum(v).alias(f"all_{v}") for v in p), *(F.sum((F.col(v) > 0).cast("long")).alias(f"kinds_{v}") for v in p))
        rates = counts.join(seen, "context").select(F.col("own").alias(f"own{n}"), *(F.col(c).alias(f"{c}{n}") for v in p for c in (v, f"all_{v}", f"kinds_{v}")))
        out = out.withColumn(f"own{n}", own).join(rates, f"own{n}")
        for v in p:
            mass = F.col(f"all_{v}{n}") + F.col(f"kinds_{v}{n}")
            p[v] = F.when(mass > 0, (F.col(f"{v}{n}") + F.col(f"kinds_{v}{n}") * p[v]) / mass).otherwise(p[v])
            out = out.withColumn(f"p_{v}{n}", p[v])
            p[v] = F.col(f"p_{v}{n}")
    return out.select("gram", (F.log(p["allow"]) - F.log(p["block"])).alias("ratio"))


def calibrated(scores: DataFrame, model: UrlModel) -> DataFrame:
    """One row ``(threshold, ready)`` from held-out scores; ``ready`` is false if either verdict is missing there."""
    width = 2 * model.bound / model.bins
    at = F.floor(F.least(F.greatest(F.col("score"), F.lit(-model.bound)), F.lit(model.bound)) / width)
    hist = scores.groupBy(at.alias("bin")).agg(*(F.sum((F.col("known") == v).cast("long")).alias(v) for v in ("allow", "block")))
    below, all_ = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # at most bins + 1 rows
    hist = hist.withColumns({"lost": F.coalesce(F.sum("allow").over(below), F.lit(0)), "caught": F.coalesce(F.sum("block").over(below), F.lit(0)), "n_allow": F.sum("allow").over(all_), "n_block": F.sum("block").over(all_)})
    errors = F.try_divide("lost", "n_allow") + F.try_divide(F.col("n_block") - F.col("caught"), F.col("n_block"))  # null without one of the verdicts
    best = F.min_by("bin", F.struct(F.round(errors, 9), F.abs("bin"), "bin"))
    return hist.groupBy().agg(F.coalesce(best * width, F.lit(0.0)).alias("threshold"), F.coalesce((F.max("n_allow") > 0) & (F.max("n_block") > 0), F.lit(False)).alias("ready"))


def judged(pages: DataFrame, model: UrlModel = UrlModel()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the score for every row of ``pages``."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", folded(F.col("url")).alias("text"), host.alias("host"), path.alias("path"), F.xxhash64("url").alias("h"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), model.rules))
    rows = rows.select("page_id", "text", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("known"), (F.pmod("h", F.lit(model.held_out)) == 0).alias("held"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "urls")
    trains = lambda v: F.sum((~F.col("held") & F.coalesce(F.col("known") == v, F.lit(False))).cast("long")).alias(v)
    exploded = rows.select("row", "known", "held", F.explode(_grams(F.col("text"), model.order)).alias("gram"))
    ratios = written(trained(exploded.groupBy("gram").agg(trains("allow"), trains("block")), model), "url-grams")
    if ratios.count() <= model.broadcast_rows:
        ratios = F.broadcast(ratios)
    scores = exploded.join(ratios, "gram").groupBy("row").agg(F.avg("ratio").alias("score"))
    scores = written(rows.drop("text").join(scores, "row", "left").withColumn("score", F.coalesce(F.round("score", 9), F.lit(0.0))), "url-scores")
    line = written(calibrated(scores.filter(F.col("held") & F.col("known").isNotNull()), model), "url-line")
    method = F.when(~F.col("ready") | (F.col("score") >= F.col("threshold")), "allow").otherwise("block")
    return scores.crossJoin(F.broadcast(line)).select("page_id", "host", "path", "rule", F.coalesce("known", method).alias("verdict"), "score")  # line has one row
