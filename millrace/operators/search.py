"""Text search over ``lines`` joined with ``files``: ``repo_slug, path, qualified_path, extension, line_number, content``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import patterns
from millrace.plans.scope import FileFilter
from millrace.plans.tables import written
from millrace.sources.ingest import line_array

KEYS = ["repo_slug", "path"]


def _clamped(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


@dataclass(frozen=True)
class Grep:
    """A search: words that must all occur, or with ``regex`` a pattern; pages count files."""

    query: str
    regex: bool = False
    ignore_case: bool = True
    whole_tokens: bool = False
    filter: FileFilter = FileFilter()
    page: int = 1
    page_size: int = 20
    context: int = 0
    lines_per_file: int = 20

    def predicate(self, content: Column) -> Column:
        if not self.regex:
            return patterns.has_words(content, self.query, self.whole_tokens)
        pattern = patterns.check_regex(self.query)
        return content.rlike(("(?i)" if self.ignore_case else "") + pattern)


def hits(lines: DataFrame, grep: Grep) -> DataFrame:
    """Matching lines in the files that the filter keeps."""
    return grep.filter.apply(lines).filter(grep.predicate(F.col("content")))


def per_file(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def totals(found: DataFrame) -> DataFrame:
    """One row: files and lines; zeros where nothing matches."""
    return per_file(found).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


def page_files(found: DataFrame, grep: Grep) -> DataFrame:
    """The page's files, most matches first."""
    size = _clamped(grep.page_size, 1, 100)
    return per_file(found).orderBy(F.desc("n"), "path", "repo_slug").offset((max(grep.page, 1) - 1) * size).limit(size)


def grep_lines(lines: DataFrame, grep: Grep) -> DataFrame:
    """Lines of the page's files: matches up to a number per file, and lines around them, each once.

    Context is found by numbers that are equal, not by ranges. Without context the matches carry their text and nothing is joined again.
    """
    found = hits(lines, grep)
    page = F.broadcast(page_files(found, grep))  # at most 100 rows
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy("line_number"))
    shown = found.join(page, KEYS).withColumn("rank", rank).filter(F.col("rank") <= _clamped(grep.lines_per_file, 1, 200))
    context = _clamped(grep.context, 0, 10)
    if not context:
        return shown.select(*KEYS, "n", "line_number", "content", F.lit(True).alias("is_match"))
    around = shown.select(*KEYS, "n", F.explode(F.sequence(F.col("line_number") - context, F.col("line_number") + context)).alias("at"), F.col("line_number").alias("hit"))
    wanted = around.groupBy(*KEYS, "n", F.col("at").cast("int").alias("line_number")).agg(F.bool_or(F.col("at") == F.col("hit")).alias("is_match"))
    return lines.select(*KEYS, "line_number", "content").join(F.broadcast(wanted), [*KEYS, "line_number"]).select(*KEYS, "n", "line_number", "content", "is_match")  # bounded by page, lines per file and context


def with_commits(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds the commit that each line comes from, where it is known."""
    return rows.join(commits.select("commit_id", "sha", "author_name", "authored_at"), "commit_id", "left")


def recount(lines: DataFrame, grep: Grep) -> DataFrame:
    """Files and lines that match with and without the filter, in one pass: what a search without a hit reports."""
    file = F.struct(*KEYS)
    every = lines.filter(grep.predicate(F.col("content")))
    return every.agg(F.count_distinct(F.when(grep.filter.keeps(), file)).alias("files"), F.count_distinct(file).alias("all_files"), F.count(F.lit(1)).alias("all_lines"))


def documents(lines: DataFrame) -> DataFrame:
    """One row per file with its lines joined by line feeds, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "content")))
    return lines.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"))


def grep_multiline(docs: DataFrame, pattern: str, ignore_case: bool = False, count_bytes: int | None = None) -> DataFrame:
    """Matches of a pattern that may span lines, per file. A text that every match holds is looked for first.

    ``count_bytes`` stops counting behind that many bytes in path order (the first file always counts); by default all files count.
    """
    pattern = patterns.check_regex(pattern)
    literal = patterns.required_literal(pattern)
    flags = "(?si)" if ignore_case else "(?s)"
    if literal and not ignore_case:
        docs = docs.filter(F.contains("content", F.lit(literal)))
    elif literal and literal.isascii() and not re.search("[sk]", literal, re.I):  # s and k have other forms without case
        docs = docs.filter(F.contains(F.lower("content"), F.lit(literal.lower())))
    if count_bytes is not None:
        sizes = docs.select(*KEYS, F.octet_length("content").alias("_size"))  # one task orders sizes, not texts
        before = F.sum("_size").over(W.orderBy("path", "repo_slug").rowsBetween(W.unboundedPreceding, -1))
        counted = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < count_bytes).select(*KEYS)
        docs = docs.join(counted, KEYS, "left_semi")
    return docs.withColumn("n", F.regexp_count("content", F.lit(flags + pattern)).cast("long")).filter("n > 0").select(*KEYS, "n", "content")


def whole_documents(files: DataFrame) -> DataFrame:
    """``documents`` of files that still have their ``content``: no line is cut off and put together again."""
    return files.select(*KEYS, F.array_join(line_array(F.col("content")), "\n").alias("content")).filter("content IS NOT NULL")


def spans_in(text: str, compiled: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of a text's matches that are not empty: line ends are found once, and each match is placed among them by binary search."""
    found = np.fromiter((x for m in compiled.finditer(text) if m.end() > m.start() for x in m.span()), np.int64).reshape(-1, 2)
    if not len(found):
        return found[:, 0], found[:, 1]
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord("\n"))
    return np.searchsorted(ends, found[:, 0]) + 1, np.searchsorted(ends, found[:, 1] - 1) + 1


def match_spans(found: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Lines that each match of a multiline search covers; empty matches cover none."""
    source = patterns.check_regex(pattern).replace(r"\z", r"\Z").replace(r"\p{Is", r"\p{")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(source, regex.S | (regex.I if ignore_case else 0))  # it has the classes of Unicode
        for b in batches:
            for repo, path, text in zip(b["repo_slug"], b["path"], b["content"], strict=True):
                first, last = spans_in(text, compiled)
                yield pd.DataFrame({"repo_slug": repo, "path": path, "first_line": first, "last_line": last})

    return found.select(*KEYS, "content").mapInPandas(mark, "repo_slug string, path string, first_line int, last_line int")


def within_bytes(page: DataFrame, budget: int) -> DataFrame:
    """Of a page's files (at most 100 rows with ``place`` and ``bytes``) those that are read: the first, and each later one that still fits beside those before it."""
    listed = page.agg(F.array_sort(F.collect_list(F.struct("place", "bytes", *KEYS))).alias("page"))
    kept = F.aggregate("page", F.struct(F.lit(0).cast("long").alias("used"), F.filter("page", lambda x: F.lit(False)).alias("kept")), lambda a, x: F.when((F.size(a["kept"]) == 0) | (a["used"] + x["bytes"] <= budget), F.struct((a["used"] + x["bytes"]).alias("used"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a))
    return listed.select(F.explode(kept["kept"]).alias("x")).select("x.place", *(f"x.{k}" for k in KEYS))


def multiline_page(found: DataFrame, pattern: str, grep: Grep = Grep("", regex=True), budget: int = 8 << 20, most_lines: int = 4_200) -> DataFrame:
    """Lines that matches cover in a page of ``grep_multiline``'s files: the files with most matches first, up to a budget of bytes, and up to so many lines of each.

    Texts are joined to the page only after the budget has picked its files.
    """
    size = _clamped(grep.page_size, 1, 100)
    order = [F.desc("n"), F.col("path"), F.col("repo_slug")]
    page = found.select(*KEYS, "n", F.octet_length("content").alias("bytes")).orderBy(*order).offset((max(grep.page, 1) - 1) * size).limit(size)
    page = page.withColumn("place", F.row_number().over(W.orderBy(*order)))  # at most 100 rows
    read = F.broadcast(within_bytes(page, budget))
    texts = found.join(read, KEYS)
    spans = match_spans(texts, pattern, grep.ignore_case).select(*KEYS, F.explode(F.sequence("first_line", "last_line")).alias("line_number")).distinct()
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy("line_number"))
    shown = spans.withColumn("rank", rank).filter(F.col("rank") <= most_lines).drop("rank")
    lines = texts.select(*KEYS, "place", "n", F.posexplode(F.split("content", "\n")).alias("at", "content")).withColumn("line_number", F.col("at") + 1)
    return shown.join(lines, [*KEYS, "line_number"]).select("place", *KEYS, "n", "line_number", "content")


def distinct_matches(lines: DataFrame, pattern: str, group: int = 0, ignore_case: bool = False, limit: int | None = None) -> DataFrame:
    """Distinct values of a pattern or one of its groups, with how often and in how many files they occur; empty values are dropped."""
    pattern = patterns.check_regex(pattern, group)
    value = F.explode(F.regexp_extract_all("content", F.lit(("(?i)" if ignore_case else "") + pattern), group))
    found = lines.select(*KEYS, value.alias("value")).filter("value != ''")
    out = found.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*KEYS).alias("files")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit else out


def match_totals(lines: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """Distinct values, occurrences and files of a pattern."""
    value = F.explode(F.regexp_extract_all("content", F.lit(patterns.check_regex(pattern, group)), group))
    found = lines.select(*KEYS, value.alias("value")).filter("value != ''")
    return found.agg(F.count_distinct("value").alias("values"), F.count(F.lit(1)).alias("n"), F.count_distinct(*KEYS).alias("files"))


def symbol_lines(lines: DataFrame, symbol: str) -> DataFrame:
    """Lines that name the symbol as a whole word, with how often."""
    found = lines.filter(patterns.names_symbol(F.col("content"), symbol))
    return found.withColumn("occurrences", patterns.occurrences(F.col("content"), patterns.symbol_regex(symbol)))


def references(lines: DataFrame, symbol: str, scope: FileFilter = FileFilter(), kinds: DataFrame | None = None, most_files: int = 100, lines_per_file: int = 200) -> DataFrame:
    """Lines that name the symbol in the files that name it most, with totals; ``kinds`` (repo_slug, path, line_number, ...) adds what a scan says of them."""
    named = written(symbol_lines(lines, symbol), "named")  # the lines are searched once for hits, page, totals and the count without the filter
    found = scope.apply(named)
    by = found.groupBy(*KEYS).agg(F.sum("occurrences").alias("n"))
    whole = by.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("total"))
    everywhere = named.agg(F.count_distinct(*KEYS).alias("all_files"))
    top = F.broadcast(by.orderBy(F.desc("n"), "path", "repo_slug").limit(min(most_files, 100)))  # at most 100 rows
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy("line_number"))
    out = found.join(top, KEYS).withColumn("rank", rank).filter(F.col("rank") <= min(lines_per_file, 200))
    out = out.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(everywhere))  # one row each
    out = out.select(*KEYS, "line_number", "content", "occurrences", "n", "files", "total", "all_files")
    return out.join(kinds, [*KEYS, "line_number"], "left") if kinds is not None else out


def definitions(declarations: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Sites that declare the symbol as type or member; implementations first."""
    role = F.when(F.col("role") == "implementation", 0).when(F.col("role") == "declaration", 1).otherwise(2)
    return declarations.filter((F.col("type_name") == symbol) | (F.col("member") == symbol)).orderBy(role, "path", "line_number", "repo_slug").limit(limit)


def file_declarations(declarations: DataFrame, size: int = 500, number: int = 1) -> DataFrame:
    """A page of each file's declarations, in line order."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy("line_number", "member"))
    first = (max(number, 1) - 1) * size
    return declarations.withColumn("rank", rank).filter((F.col("rank") > first) & (F.col("rank") <= first + size))


def scan_coverage(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Languages among the matching files that have no profile, or one without declaration shapes; ``profiles`` has ``extension, language, has_shapes``."""
    files = found.select(*KEYS, "extension").distinct().join(F.broadcast(profiles), "extension", "left")
    gap = F.when(F.col("language").isNull(), "no profile").when(~F.col("has_shapes"), "no shapes")
    return files.withColumn("gap", gap).filter("gap IS NOT NULL").groupBy(F.coalesce("language", "extension").alias("language"), "gap").agg(F.count(F.lit(1)).alias("files"))


def naming_counts(lines: DataFrame, symbol: str, scope: FileFilter = FileFilter()) -> DataFrame:
    """Files that name a symbol, inside the filter and everywhere, in one pass."""
    file = F.struct(*KEYS)
    named = lines.filter(patterns.names_symbol(F.col("content"), symbol))
    return named.agg(F.count_distinct(F.when(scope.keeps(), file)).alias("files"), F.count_distinct(file).alias("all_files"))


def resolve_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """For each ``request``: the file of that path without regard to case; exact spelling wins."""
    rows = requests.join(files.select("file_id", "repo_slug", "path", "qualified_path"), F.lower("request") == F.lower("qualified_path"))
    rank = F.row_number().over(W.partitionBy("request").orderBy(F.desc(F.col("qualified_path") == F.col("request")), "qualified_path"))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def suggest_paths(requests: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """For each ``request``: files whose last segment is the same."""
    leaf = lambda c: F.lower(F.split_part(c, F.lit("/"), F.lit(-1)))
    rows = requests.withColumn("_l", leaf(F.col("request"))).join(files.select("qualified_path", leaf(F.col("path")).alias("_l")), "_l")
    rank = F.row_number().over(W.partitionBy("request").orderBy("qualified_path"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("request", "rank", "qualified_path")


def diagnose_slug(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests of a project with one repository that name it needlessly, with the path that fits without it."""
    rest = requests.withColumn("path", F.regexp_extract("request", "^[^/]+/(.+)$", 1)).filter("path != ''")
    return rest.join(files.select(F.lower("path").alias("_p"), F.col("path").alias("found")), F.lower("path") == F.col("_p")).select("request", F.col("found").alias("path"))


def read_windows(windows: DataFrame, lines: DataFrame, most_windows: int = 100, most_lines: int = 100_000, most_chars: int = 16_000_000) -> DataFrame:
    """Lines of ``request_id, window_id, repo_slug, path, start_line, end_line``, clamped to the file, up to budgets of each request in the order of its windows."""
    request = W.partitionBy("request_id")
    own = windows.withColumn("_w", F.row_number().over(request.orderBy("window_id"))).filter(F.col("_w") <= most_windows)
    ends = lines.select(*KEYS, "line_number").join(own.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(F.max("line_number").alias("last"))
    own = own.join(ends, KEYS).select("request_id", "window_id", *KEYS, F.explode(F.expr("CASE WHEN least(end_line, last) >= greatest(start_line, 1) THEN sequence(greatest(start_line, 1), least(end_line, last)) END")).alias("line_number"))
    order = request.orderBy("window_id", "line_number")
    own = own.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most_lines)  # before any text is joined
    rows = own.join(lines.select(*KEYS, "line_number", "content"), [*KEYS, "line_number"])
    rows = rows.withColumn("_c", F.sum(F.length("content")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter(F.col("_c") <= most_chars).drop("_n", "_c")


def list_files(files: DataFrame, glob: str, scope: FileFilter = FileFilter(), size: int = 100, number: int = 1) -> DataFrame:
    """A page of the files that a glob fits, with the total; and how many fit outside the filter."""
    fits = files.filter(patterns.glob_match(F.lower("qualified_path"), patterns.check_glob(glob.lower())))
    inside = scope.apply(fits)
    counts = inside.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(fits.agg(F.count(F.lit(1)).alias("everywhere"))))
    out = inside.orderBy("qualified_path").offset((max(number, 1) - 1) * size).limit(size)
    return out.select("qualified_path", "size_bytes", "line_count").crossJoin(F.broadcast(counts))  # one row
