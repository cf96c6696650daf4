"""Benchmark passages in a corpus, found on a distributed positional inverted index.

The index is two tables: the documents' words as hashes in order, and postings ``(term, uid, pos)``, one for every word of every
document, which each task sorts by term, so that a term's list lies together in each file. A query is a window of an item's words. Its terms are ordered by
how many postings they have; the lists of its rarest terms are intersected one after the other, each list's positions shifted
by the term's place in the window, so that what is left after a few are places at which a window may begin. The words that stand there
decide. The same lists give proximity matches: the rarest terms of a window within a span of words, in any order.

What grows with the benchmark (terms, windows, places) is broadcast only after a count and joined by shuffle beyond it. Everything runs on
DataFrame functions. Words are known by 64 bits of a hash, in the index as in the windows.

Defined results: null and empty texts have no words; an item without words is never found; a null item id counts as an empty string, and rows of
one item id are one item; repeated documents are judged row by row; an empty table on either side leaves all documents clean; extra columns
are not read by ``report``, and kept as they are by ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tables import discard, written
from millrace.llm.text import alnum_words


@dataclass(frozen=True)
class Decontamination:
    """``window`` words in a row are a match; ``lists``: how many of a window's lists are intersected before words are compared."""

    window: int = 10
    lists: int = 3
    broadcast_rows: int = 300_000


def _small(df: DataFrame, how: Decontamination) -> DataFrame:
    """Broadcast after a count of a written table of narrow rows."""
    return F.broadcast(df) if df.count() <= how.broadcast_rows else df


def _terms(text: Column) -> Column:
    return F.transform(alnum_words(text), lambda w: F.xxhash64(w))


class Index:
    """``documents`` (uid, doc_id, n_words, terms) and ``postings`` (term, uid, pos) as written tables."""

    def __init__(self, docs: DataFrame) -> None:
        rows = docs.select("doc_id", _terms(F.col("text")).alias("terms"))
        self.documents = written(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.size("terms").cast("long").alias("n_words"), "terms"), "index-documents")
        self.postings = written(self.documents.select("uid", F.posexplode("terms").alias("pos", "term")).select("term", "uid", "pos").sortWithinPartitions("term"), "index-postings")

    def lists(self, terms: DataFrame, how: Decontamination) -> DataFrame:
        """The postings of some terms."""
        return self.postings.join(_small(terms, how), "term", "left_semi")

    def discard(self) -> None:
        discard(self.documents, self.postings)


class Windows:
    """A benchmark's windows: ``windows`` (win, length, terms), each once; ``owners`` (win, item); ``places`` (win, off, term)."""

    def __init__(self, items: DataFrame, how: Decontamination) -> None:
        n = how.window
        rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
        cut = F.when(F.size("terms") <= n, F.array("terms")).otherwise(F.transform(F.sequence(F.lit(1), F.size("terms") - (n - 1)), lambda i: F.slice("terms", i, n)))
        every = written(rows.select("item", F.explode(cut).alias("terms")), "window-items")
        self.windows = written(every.select("terms").distinct().select(F.monotonically_increasing_id().alias("win"), F.size("terms").alias("length"), "terms"), "windows")
        self.owners = written(every.join(self.windows, "terms").select("win", "item").distinct(), "window-owners")
        self.places = written(self.windows.select("win", F.posexplode("terms").alias("off", "term")), "window-places")
        self.terms = written(self.places.select("term").distinct(), "window-terms")
        discard(every)

    def discard(self) -> None:
        discard(self.windows, self.owners, self.places, self.terms)


def rarest(index: Index, windows: Windows, how: Decontamination) -> DataFrame:
    """``win, off, term, nth`` of each window's rarest terms, from 1; a window with a term that no document holds has none."""
    counts = written(index.lists(windows.terms, how).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    known = windows.places.join(counts, "term", "left").withColumn("missing", F.count_if(F.col("n").isNull()).over(W.partitionBy("win"))).filter("missing = 0")
    nth = F.row_number().over(W.partitionBy("win").orderBy("n", "term", "off"))
    out = written(known.withColumn("nth", nth).filter(F.col("nth") <= how.lists).select("win", "off", "term", "nth"), "rarest")
    discard(counts)
    return out


def _rare_lists(index: Index, rare: DataFrame, how: Decontamination) -> DataFrame:
    terms = written(rare.select("term").distinct(), "rare-terms")
    out = written(index.lists(terms, how), "rare-lists")
    discard(terms)
    return out


def matches(index: Index, windows: Windows, how: Decontamination = Decontamination()) -> DataFrame:
    """``uid, win, start, length``: every place at which a window stands word for word, as a written table."""
    rare = rarest(index, windows, how)
    lists = _rare_lists(index, rare, how)
    step = lambda k: rare.filter(F.col("nth") == k).select("win", F.col("off"), "term")
    first = _small(written(step(1), "rare-1"), how)
    found = lists.join(first, "term").select("win", "uid", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")
    for k in range(2, how.lists + 1):
        # Windows with fewer words have no further list and stay as they are.
        found = found.join(_small(written(step(k), f"rare-{k}"), how), "win", "left")
        # A list holds each document's place once.
        held = found.filter("term IS NOT NULL").withColumn("pos", (F.col("start") + F.col("off")).cast("int")).join(lists, ["term", "uid", "pos"], "left_semi")
        short = found.filter("term IS NULL")
        found = held.select("win", "uid", "start").unionByName(short.select("win", "uid", "start"))
        found = written(found, f"intersected-{k}")
    if how.lists < 2:
        found = written(found, "intersected-1")
    asked = written(found.select("uid").distinct(), "asked")
    texts = index.documents.select("uid", "terms").join(_small(asked, how), "uid", "left_semi")
    wanted = found.join(_small(windows.windows.withColumnRenamed("terms", "wanted"), how), "win")
    same = F.slice("terms", F.col("start") + 1, F.col("length")) == F.col("wanted")
    out = written(texts.join(wanted, "uid").filter(same).select("uid", "win", "start", "length"), "matches")
    discard(rare, lists, asked, found)
    return out


def near(index: Index, windows: Windows, span: int, how: Decontamination = Decontamination()) -> DataFrame:
    """``item, doc_id, first, last``: places at which all of a window's rarest terms stand within ``span`` words, in any order; the earliest of each last term."""
    rare = rarest(index, windows, how)
    needed = rare.groupBy("win").agg(F.count_distinct("term").alias("needed"))
    lists = _rare_lists(index, rare, how)
    wins = _small(written(rare.select("win", "term").distinct().join(needed, "win"), "near-terms"), how)
    rows = lists.join(wins, "term").select("win", "uid", "term", "pos", "needed")
    within = W.partitionBy("win", "uid").orderBy("pos").rangeBetween(-(span - 1), 0)
    found = rows.withColumns({"seen": F.size(F.collect_set("term").over(within)), "first": F.min("pos").over(within)}).filter("seen = needed")
    found = found.join(windows.owners, "win").select("item", "uid", "first", F.col("pos").alias("last")).distinct()
    out = written(found.join(index.documents.select("uid", "doc_id"), "uid").select("item", "doc_id", "first", "last"), "near")
    discard(rare, lists)
    return out


def _judged(index: Index, windows: Windows, how: Decontamination) -> DataFrame:
    """``uid, n_hit, n_items, items`` of the documents with a match."""
    hits = matches(index, windows, how)
    end = F.col("start") + F.col("length")
    before = F.max(end).over(W.partitionBy("uid").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1))
    covered = hits.select("uid", "start", "length").distinct().withColumn("new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
    covered = covered.groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.select("uid", "win").distinct().join(_small(windows.owners, how), "win").select("uid", "item").distinct()
    named = named.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = written(covered.join(named, "uid"), "judged")
    discard(hits)
    return out


def report(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """One row per document: words, words inside a match, items that match, and their digest."""
    index, windows = Index(docs), Windows(items, how)
    judged = _judged(index, windows, how)
    # Lists of items are at most as long as the benchmark and only for documents with a match.
    out = index.documents.select("uid", "doc_id", "n_words").join(_small(judged, how), "uid", "left")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n > 0).alias("contaminated"))
    return _stored(out, index, windows, judged)


def _stored(out: DataFrame, index: Index, windows: Windows, *tables: DataFrame) -> DataFrame:
    """The result as a table, after which the index goes."""
    out = written(out, "decontaminated")
    index.discard()
    windows.discard()
    discard(*tables)
    return out


def clean(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """The documents without a match, with their columns as they came; rows of one text are judged alike."""
    key = F.concat(F.hex(F.xxhash64("text")), F.coalesce(F.md5("text"), F.lit("")))
    bad = report(docs.select(key.alias("doc_id"), "text"), items, how).filter("contaminated").select("doc_id").distinct()
    kept = docs.select(F.struct("*").alias("row"), key.alias("doc_id")).join(bad, "doc_id", "left_anti")
    return kept.select("row.*")
