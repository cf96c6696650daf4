"""Project overviews, cards and call statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import patterns
from millrace.operators.history import distinct_counts, hot_files, prefixes
from millrace.operators.language import PROFILES
from millrace.plans.scope import Scope, seconds
from millrace.plans.tables import small

# Our own choice: extensions of files that are no code.
NOT_CODE = ("md", "txt", "json", "xml", "yml", "yaml", "csv", "lock", "svg", "png", "jpg", "ico")
# Our own choice: file names of well-known generated files.
WELL_KNOWN = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock", "go.sum", "packages.lock.json")


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.count("skip_reason").alias("skipped"))


def languages(spark: SparkSession) -> DataFrame:
    """Extension and language name: a short fixed table."""
    return spark.createDataFrame([(e, p.name) for p in PROFILES for e in p.extensions], "extension string, language string")


def with_language(df: DataFrame) -> DataFrame:
    """Adds the language; an extension without one stands for itself."""
    return df.join(F.broadcast(languages(df.sparkSession)), "extension", "left").withColumn("language", F.coalesce("language", "extension"))


def language_shares(files: DataFrame, top: int = 20) -> DataFrame:
    """Languages by lines; those beyond the first ``top`` are one row of others."""
    by = with_language(extension_counts(files).filter(~F.col("extension").isin(*NOT_CODE))).groupBy("language").agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))
    ranked = by.withColumn("rank", F.row_number().over(W.orderBy(F.desc("lines"), F.desc("files"), "language")))  # one row per language
    name = F.when(F.col("rank") <= top, F.col("language")).otherwise("(others)")
    return ranked.groupBy(name.alias("language")).agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))


def top_folders(files: DataFrame, most: int = 100) -> DataFrame:
    """First segments of each repository with files, lines and bytes; files at the root are one group; dropped folders are counted."""
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1)))
    by = files.groupBy("repo_slug", folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"))
    repo = W.partitionBy("repo_slug")
    ranked = by.withColumns({"rank": F.row_number().over(repo.orderBy(F.col("folder").isNull(), F.desc("files"), "folder")), "folders": F.count(F.lit(1)).over(repo)})
    return ranked.filter(F.col("rank") <= most).withColumn("dropped", F.greatest(F.col("folders") - most, F.lit(0))).drop("rank", "folders")


def largest_files(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.filter("skip_reason IS NULL").orderBy(F.desc("size_bytes"), "path", "repo_slug").limit(limit).select("repo_slug", "path", "size_bytes", "line_count")


def overview_churn(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope) -> DataFrame:
    return hot_files(commits, commit_files, files, replace(scope, days=90), 10)


def section_authors(commits: DataFrame, commit_files: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """Authors of commits that touched no file, or at least one that is not excluded."""
    touched = commit_files.groupBy("commit_id").agg(F.bool_or(~patterns.excluded(F.col("path"), scope.excluded_paths)).alias("counts"))
    own = commits.filter(F.col("repo_slug") == scope.repo) if scope.repo else commits
    own = own.join(touched, "commit_id", "left").filter("coalesce(counts, true)")
    return own.groupBy("author_email").agg(F.max_by("author_name", "commit_id").alias("author_name"), F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "author_email").limit(limit)


def excluded_counts(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope) -> DataFrame:
    """What the excluded paths hide: files at HEAD, paths changed in the window, paths ever changed."""
    out = lambda df, name: distinct_counts(df.filter(patterns.excluded(F.col("path"), scope.excluded_paths)), [], ["repo_slug", "path"], name)
    head, ever = out(files, "head_files"), out(commit_files, "committed_paths")
    churn = out(replace(scope, excluded_paths=[]).history(commits, commit_files), "churn_paths")
    return head.crossJoin(F.broadcast(churn)).crossJoin(F.broadcast(ever))  # one row each


def hotspots(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """Files by commits times lines; ties by changed lines, then path. Files without lines and files that are gone are not among them."""
    by = scope.rows(commits, commit_files).groupBy("repo_slug", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("changed"))
    rows = by.join(files.filter("skip_reason IS NULL AND line_count > 0").select("repo_slug", "path", "line_count"), ["repo_slug", "path"])
    return rows.withColumn("score", F.col("commits") * F.col("line_count")).orderBy(F.desc("score"), F.desc("changed"), "path", "repo_slug").limit(limit)


def authors_per_file(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """Files with most authors, and the shares of the three who changed it most."""
    each = scope.rows(commits, commit_files).groupBy("repo_slug", "path", "author_email").agg(F.count(F.lit(1)).alias("n"))
    by = each.groupBy("repo_slug", "path").agg(F.count(F.lit(1)).alias("authors"), F.sum("n").alias("commits"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    by = by.join(files.select("repo_slug", "path"), ["repo_slug", "path"], "left_semi").orderBy(F.desc("authors"), F.desc("commits"), "path", "repo_slug").limit(limit)
    share = lambda i: (F.coalesce(F.try_element_at("ns", F.lit(i)), F.lit(0)) / F.col("commits")).alias(f"share{i}")
    return by.select("repo_slug", "path", "authors", "commits", share(1), share(2), share(3))


def _folder_root(files: DataFrame, levels: int = 3, share: float = 0.8) -> DataFrame:
    """Per repository the directory whose subfolders are compared, and how many segments it has: one that holds most files and at least two subfolders is descended into.

    The files are counted once by the first segments of their directories; every level reads these counts.
    """
    parts = F.split("path", "/", -1)
    counts = files.select("repo_slug", F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(levels + 1))).alias("above")).groupBy("repo_slug", "above").agg(F.count(F.lit(1)).alias("n"))
    roots = None
    for _ in range(levels):
        inside = counts.withColumns({"root": F.lit(""), "depth": F.lit(0)}) if roots is None else counts.join(roots, "repo_slug").filter(F.array_join(F.slice("above", F.lit(1), F.col("depth")), "/") == F.col("root"))
        inside = inside.select("repo_slug", "root", "depth", "n", F.get("above", F.col("depth")).alias("folder"), F.get("above", F.col("depth") + 1).alias("second"))
        by = inside.groupBy("repo_slug", "root", "depth", "folder").agg(F.sum("n").alias("n"), F.count_distinct("second").alias("subfolders"))
        total = by.groupBy("repo_slug", "root", "depth").agg(F.sum("n").alias("total"), F.max_by(F.struct("folder", "n", "subfolders"), F.when(F.col("folder").isNotNull(), F.col("n"))).alias("most"))
        down = (F.col("most.n") >= share * F.col("total")) & (F.col("most.subfolders") >= 2)
        into = F.when(F.col("root") == "", F.col("most.folder")).otherwise(F.concat_ws("/", "root", "most.folder"))
        roots = total.select("repo_slug", F.when(down, into).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.when(down, 1).otherwise(0)).alias("depth"))
    return roots


def folder_coupling(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope, ceiling: int = 200, top: int = 12) -> DataFrame:
    """Folders that change in the same commits: pairs ``a < b`` of a repository's most changed folders, with the commits of each.

    Commits over the ceiling are left out before exclusions; a repository's folders are cut to ``top``, so a commit's list of
    them is short and its pairs come from the list.
    """
    rows = scope.history(commits, commit_files).join(small(_folder_root(files), "folder-roots"), "repo_slug")
    inside = scope.kept(F.col("path")) & ((F.col("root") == "") | F.startswith("path", F.concat("root", F.lit("/"))))
    rest = F.when(F.col("root") == "", F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.length("path")))
    folder = F.when(inside & F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1)))
    rows = rows.select("repo_slug", "commit_id", folder.alias("folder")).groupBy("repo_slug", "commit_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("size", F.sum("n").over(W.partitionBy("commit_id"))).filter((F.col("size") <= ceiling) & F.col("folder").isNotNull()).select("repo_slug", "commit_id", "folder")
    by = rows.groupBy("repo_slug", "folder").agg(F.count(F.lit(1)).alias("commits"))
    kept = by.withColumn("rank", F.row_number().over(W.partitionBy("repo_slug").orderBy(F.desc("commits"), "folder"))).filter(F.col("rank") <= top).drop("rank")
    lists = rows.join(small(kept, "folders-kept"), ["repo_slug", "folder"]).groupBy("repo_slug", "commit_id").agg(F.sort_array(F.collect_list(F.struct("folder", "commits"))).alias("changed"))
    pairs = lists.filter(F.size("changed") > 1).select("repo_slug", F.posexplode("changed").alias("i", "x"), "changed").select("repo_slug", "x", F.explode(F.slice("changed", F.col("i") + 2, F.lit(top))).alias("y"))
    pairs = pairs.select("repo_slug", F.col("x.folder").alias("a"), F.col("y.folder").alias("b"), F.col("x.commits").alias("commits_a"), F.col("y.commits").alias("commits_b"))
    return pairs.groupBy("repo_slug", "a", "b", "commits_a", "commits_b").agg(F.count(F.lit(1)).alias("together"))


def period_unit(days: int) -> str:
    """Days up to 31, ISO weeks up to 186, months beyond."""
    return "day" if days <= 31 else "week" if days <= 186 else "month"


def changes_over_time(commits: DataFrame, commit_files: DataFrame, scope: Scope) -> DataFrame:
    """Files added, deleted and renamed per period of the window, in UTC; periods without changes are kept."""
    days = min(max(scope.days or 90, 1), 3650)
    unit = period_unit(days)
    rows = scope.rows(commits, commit_files)
    newest = (commits.filter(F.col("repo_slug") == scope.repo) if scope.repo else commits).agg(F.max(seconds(F.col("authored_at"))).alias("newest"))
    since = F.date_trunc(unit, F.timestamp_seconds(F.col("newest") - 86_400 * days))
    step = {"day": F.expr("interval 1 day"), "week": F.expr("interval 7 days"), "month": F.expr("interval 1 month")}[unit]
    periods = newest.filter("newest IS NOT NULL").select(F.explode(F.sequence(since, F.date_trunc(unit, F.timestamp_seconds("newest")), step)).alias("period"))
    counted = rows.groupBy(F.date_trunc(unit, F.col("authored_at").cast("timestamp")).alias("period")).agg(*(F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "deleted", "renamed")))
    out = periods.join(counted, "period", "left")
    return out.select(seconds(F.col("period")).alias("period_second"), *(F.coalesce(k, F.lit(0)).alias(k) for k in ("added", "deleted", "renamed")))


def suggestions(commits: DataFrame, commit_files: DataFrame, files: DataFrame, attributes: list[str] = (), globs: list[str] = (), bump_commits: int = 10, bump_lines: int = 4, existing: list[str] = ()) -> list[tuple[str, str, int]]:
    """Patterns worth excluding, in order, each with the files that neither an existing pattern nor an earlier one covers.

    Declared patterns that a setting would refuse are left out.

    Sources: declared generated files, generated names of the languages, well-known names, and files that many commits only bump. The
    coverage of at most a few hundred patterns is counted in one job; only the order is settled here.
    """
    bumps = commit_files.groupBy("repo_slug", "path").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("added") + F.col("deleted")).alias("most")).withColumn("bumped", (F.col("n") >= bump_commits) & (F.col("most") <= bump_lines))
    head = files.filter(~patterns.excluded(F.col("path"), list(existing))).select("repo_slug", "path", F.split_part("path", F.lit("/"), F.lit(-1)).alias("name")).join(bumps.select("repo_slug", "path", "bumped"), ["repo_slug", "path"], "left").withColumn("bumped", F.coalesce("bumped", F.lit(False)))
    names = head.groupBy("name").agg(F.bool_and("bumped").alias("all"), F.count_if("bumped").alias("n"), F.min(F.when(F.col("bumped"), F.col("path"))).alias("path")).filter("n > 0").orderBy(F.desc("n"), "name").limit(patterns.MAX_EXCLUDED).collect()
    def accepted(pattern: str) -> bool:
        try:
            return bool(patterns.excluded_regex([pattern]))
        except patterns.PatternError:
            return False

    candidates = [(p, "attributes") for p in attributes if accepted(p)] + [(p, "language") for p in globs] + [(p, "known") for p in WELL_KNOWN] + [(r["name"] if r["all"] else "/" + r["path"], "history") for r in names]
    covers = F.array(*(patterns.excluded(F.col("path"), [p]) for p, _ in candidates))
    # A file counts for the first pattern that covers it.
    first = head.select(F.array_position(covers, F.lit(True)).alias("i")).filter("i > 0").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    won = {int(r["i"]): r["n"] for r in first.collect()}
    return [(p, why, won[i]) for i, (p, why) in enumerate(candidates, 1) if i in won]


def tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """Directories down to a depth with all files below them, and the files at most so deep; ``sort_key`` orders depth first, directories before files."""
    depth = min(max(depth, 1), 64)
    level = F.regexp_count("path", F.lit("/"))
    dirs = prefixes(files.select("repo_slug", "path", "line_count", "size_bytes")).filter(F.regexp_count("directory", F.lit("/")) < depth)
    dirs = dirs.groupBy("repo_slug", F.col("directory").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes")).withColumn("is_directory", F.lit(True))
    leaves = files.filter(level < depth).select("repo_slug", "path", F.lit(1).cast("long").alias("files"), F.col("line_count").alias("lines"), F.col("size_bytes").alias("bytes"), F.lit(False).alias("is_directory"))
    parent = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    key = F.concat(F.regexp_replace(parent, "([^/]+)/", "0$1/"), F.when(F.col("is_directory"), "0").otherwise("1"), F.split_part("path", F.lit("/"), F.lit(-1)))
    return dirs.unionByName(leaves).withColumn("sort_key", key)


def repository_level(files: DataFrame) -> DataFrame:
    """The tree's top level: repositories with their sums."""
    return files.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"))


def _nearest_rank(p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)")


def call_statistics(calls: DataFrame, last: int = 100) -> DataFrame:
    """Per project and tool over its last calls: count, failed, median and 95th percentile by nearest rank, greatest, and the last one's time."""
    rank = F.row_number().over(W.partitionBy("project", "tool").orderBy(F.desc("called_at"), F.desc("call_id")))
    recent = calls.withColumn("rank", rank).filter(F.col("rank") <= last)
    return recent.groupBy("project", "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failed"), _nearest_rank(0.5).alias("p50"), _nearest_rank(0.95).alias("p95"), F.max("seconds").alias("max"), F.max(seconds(F.col("called_at"))).alias("last_second"))


def project_p95(calls: DataFrame, last: int = 200) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("project").orderBy(F.desc("called_at"), F.desc("call_id")))
    return calls.withColumn("rank", rank).filter(F.col("rank") <= last).groupBy("project").agg(_nearest_rank(0.95).alias("p95"))


def calls_per_minute(calls: DataFrame, now: Column | None = None, minutes: int = 60) -> DataFrame:
    """Calls and failures of each of the last minutes, with zeros; ``now`` is the newest call unless given."""
    end = calls.agg(F.floor(F.max(seconds(F.col("called_at"))) / 60).alias("end")) if now is None else calls.sparkSession.range(1).select(F.floor(seconds(now) / 60).alias("end"))
    every = end.filter("end IS NOT NULL").select(F.explode(F.sequence(F.col("end") - minutes + 1, F.col("end"))).alias("minute"))
    counted = calls.groupBy(F.floor(seconds(F.col("called_at")) / 60).alias("minute")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failed"))
    return every.join(counted, "minute", "left").select("minute", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"))


def recent_calls(calls: DataFrame, limit: int = 50) -> DataFrame:
    return calls.orderBy(F.desc("called_at"), F.desc("call_id")).limit(limit)


def phases(events: DataFrame) -> DataFrame:
    """Seconds of each phase of a run, from ``run, phase, at`` with a last row that ends it."""
    run = W.partitionBy("run").orderBy("at")
    out = events.withColumn("seconds", F.lead(F.col("at").cast("double")).over(run) - F.col("at").cast("double"))
    return out.filter("seconds IS NOT NULL").select("run", "phase", "at", "seconds")


def overview(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope) -> dict[str, DataFrame]:
    """All sections of an overview for one scope: days, repository, excluded paths. A stored overview is this with the defaults, a live one with the caller's."""
    head = files.filter(F.col("repo_slug") == scope.repo) if scope.repo else files
    head = head.filter(~patterns.excluded(F.col("path"), scope.excluded_paths))
    return {
        "extensions": extension_counts(head), "languages": language_shares(head), "folders": top_folders(head), "largest": largest_files(head), "churn": hot_files(commits, commit_files, head, scope, 10),
        "authors": section_authors(commits.filter(F.col("repo_slug") == scope.repo) if scope.repo else commits, commit_files, scope), "excluded": excluded_counts(commits, commit_files, files, scope), "hotspots": hotspots(commits, commit_files, head, scope),
        "per_file": authors_per_file(commits, commit_files, head, scope), "coupling": folder_coupling(commits, commit_files, head, scope), "changes": changes_over_time(commits, commit_files, scope),
    }
