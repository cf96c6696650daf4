"""History analytics over ``commits`` and ``commit_files``."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.plans.scope import Scope, page, seconds
from millrace.plans.tables import written


def _flag(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """``name``: whether the keys occur in ``other``."""
    return df.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _flag_few(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """``_flag`` for at most 100 rows: of ``other`` only what they name is looked at, without a shuffle of the rest."""
    df = written(df, "survivors")
    return _flag(df, other.select(*on).join(F.broadcast(df.select(*on)), on, "left_semi"), on, name)


def distinct_counts(df: DataFrame, by: list[str], of: list[str], name: str) -> DataFrame:
    """Distinct values of ``of`` by ``by``, nulls left out: values are made distinct where they are dealt by themselves, so that no task holds those of a whole group."""
    known = reduce(and_, (F.col(c).isNotNull() for c in of))
    return df.select(*by, *of).distinct().groupBy(*by).agg(F.count_if(known).alias(name))


def hot_files(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope, limit: int = 20) -> DataFrame:
    """Most often changed paths; whether a path is at HEAD is looked up for the survivors only."""
    top = scope.rows(commits, commit_files).groupBy("repo_slug", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    top = top.orderBy(F.desc("commits"), F.desc(F.col("added") + F.col("deleted")), "path", "repo_slug").limit(min(limit, 100))
    return _flag_few(top, files, ["repo_slug", "path"], "at_head")


def prefixes(df: DataFrame, path: str = "path", name: str = "directory", most: int | None = None) -> DataFrame:
    """A row for every directory above the path, or for those of at most ``most`` segments."""
    parts = F.split(F.col(path), "/", -1)
    return df.withColumn("_parts", parts).filter(F.size("_parts") > 1).withColumn("_depth", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1 if most is None else F.least(F.size("_parts") - 1, F.lit(most))))).withColumn(name, F.array_join(F.slice("_parts", F.lit(1), F.col("_depth")), "/")).drop("_parts", "_depth")


def hot_directories(commits: DataFrame, commit_files: DataFrame, files: DataFrame, scope: Scope, depth: int = 2, limit: int = 20) -> DataFrame:
    """Most often changed directories ``depth`` segments below the scope's; a commit counts once however many files it touched."""
    skip = len(scope.directory.strip("/").split("/")) if scope.directory else 0
    parts = F.split("path", "/", -1)
    most = skip + min(max(depth, 1), 10)
    directory = F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), "/")
    rows = scope.rows(commits, commit_files).filter(F.size(parts) > 1).withColumn("directory", directory)
    each = rows.groupBy("repo_slug", "directory", "commit_id").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))  # no task holds a directory's commits
    top = each.groupBy("repo_slug", "directory").agg(F.count("commit_id").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    top = top.orderBy(F.desc("commits"), F.desc(F.col("added") + F.col("deleted")), "directory", "repo_slug").limit(min(limit, 100))
    return _flag_few(top, prefixes(files.select("repo_slug", "path"), most=most), ["repo_slug", "directory"], "at_head")


def hidden_paths(commits: DataFrame, commit_files: DataFrame, scope: Scope) -> DataFrame:
    """How many distinct changed paths the scope's filters hide."""
    return distinct_counts(scope.history(commits, commit_files).filter(~scope.kept(F.col("path"))), [], ["repo_slug", "path"], "hidden")


def extension_of(path: Column) -> Column:
    """After the last dot of the last segment, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.split_part(path, F.lit("/"), F.lit(-1)), r"\.([^.]*)$", 1))


def churned_extensions(commits: DataFrame, commit_files: DataFrame, scope: Scope, limit: int = 24) -> DataFrame:
    """Changed extensions with their distinct commits and paths; exclusions hold, the extension filter does not."""
    menu = Scope(scope.days, scope.repo, scope.directory, None, scope.exclude, scope.excluded_paths)
    rows = menu.rows(commits, commit_files).withColumn("extension", extension_of(F.col("path")))
    # A row for every commit and one for every path of an extension, each made distinct by itself.
    item = F.explode(F.array(F.struct(F.lit(True).alias("is_commit"), F.lit(None).cast("string").alias("repo_slug"), F.lit(None).cast("string").alias("path"), F.col("commit_id")), F.struct(F.lit(False).alias("is_commit"), "repo_slug", "path", F.lit(None).cast(rows.schema["commit_id"].dataType).alias("commit_id"))))
    each = rows.select("extension", item.alias("item")).select("extension", "item.*").distinct()
    counted = each.groupBy("extension").agg(F.count("commit_id").alias("commits"), F.count_if(F.col("repo_slug").isNotNull() & F.col("path").isNotNull()).alias("paths"))
    return counted.orderBy(F.desc("commits"), F.desc("paths"), "extension").limit(limit)


def directory_states(requests: DataFrame, commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """For ``repo_slug, path``: ``live``, ``history`` or ``unknown``, and whether it names a directory."""
    keys = ["repo_slug", "path"]
    as_dir = lambda df: prefixes(df.select(*keys)).select("repo_slug", F.col("directory").alias("path"))
    out = _flag(_flag(_flag(_flag(requests, files, keys, "f"), commit_files, keys, "h"), as_dir(files), keys, "fd"), as_dir(commit_files), keys, "hd")
    state = F.when(F.col("f") | F.col("fd"), "live").when(F.col("h") | F.col("hd"), "history").otherwise("unknown")
    return out.select(*requests.columns, state.alias("state"), ((F.col("fd") | F.col("hd")) & ~F.col("f")).alias("is_directory"))


def log_page(commits: DataFrame, size: int = 50, number: int = 1) -> DataFrame:
    """Commits, newest first."""
    return page(commits.orderBy(F.desc("commit_id")), min(size, 200), number).select("commit_id", "repo_slug", "sha", "author_name", "author_email", "authored_at", "subject")


def authors(commits: DataFrame, limit: int = 200) -> DataFrame:
    """Authors by address with their newest name; totals are over all of them."""
    by = commits.groupBy("author_email").agg(F.max_by("author_name", "commit_id").alias("author_name"), F.count(F.lit(1)).alias("commits"), F.max("authored_at").alias("last_at"))
    totals = by.agg(F.count(F.lit(1)).alias("total_authors"), F.sum("commits").alias("total_commits"))
    top = by.orderBy(F.desc("commits"), "author_email").limit(min(limit, 200))
    return top.crossJoin(F.broadcast(totals))  # one row


def author_echo(commits: DataFrame, author: str, limit: int = 20) -> DataFrame:
    """What a search without a hit says of its author filter: the addresses that it fits, their commits, and how many authors and commits there are in all."""
    whole = commits.agg(F.count_distinct("author_email").alias("total_authors"), F.count(F.lit(1)).alias("total_commits"))
    found = commits.filter(F.contains(F.lower("author_email"), F.lit(author.lower()))).groupBy("author_email").agg(F.count(F.lit(1)).alias("commits"))
    top = found.orderBy(F.desc("commits"), "author_email").limit(min(limit, 100))
    return F.broadcast(whole).join(top, F.lit(True), "left").select("author_email", "commits", "total_authors", "total_commits")  # one row on the left


def change_log(commits: DataFrame, commit_files: DataFrame, size: int = 50, number: int = 1) -> DataFrame:
    """A page of commits with their number of files and changed lines; only the page's commits are added up."""
    rows = log_page(commits, size, number)
    sums = commit_files.join(F.broadcast(rows.select("commit_id")), "commit_id", "left_semi").groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))  # at most 200 rows
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(sums, "commit_id", "left").select(*rows.columns, zero("files"), zero("added"), zero("deleted"))


def commits_by_prefix(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """For each ``prefix`` (trimmed, lower-cased, four characters at least): its commit if one sha fits, and up to four that do."""
    wanted = requests.withColumn("_p", F.lower(F.trim("prefix"))).filter(F.length("_p") >= 4).withColumn("_k", F.substring("_p", 1, 4))
    hits = wanted.join(commits.select("sha", "commit_id", F.substring(F.lower("sha"), 1, 4).alias("_k")), "_k").filter(F.startswith(F.lower("sha"), F.col("_p")))
    by = hits.groupBy("prefix").agg(F.count_distinct("sha").alias("matches"), F.min("commit_id").alias("commit_id"), F.slice(F.array_sort(F.collect_set("sha")), 1, 4).alias("candidates"))
    return by.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("commit_id")).alias("commit_id"), "candidates")


def commit_record(commits: DataFrame, commit_files: DataFrame, sha: str) -> DataFrame:
    """One commit with its sums; the lowest id if two repositories have the sha."""
    one = commits.filter(F.col("sha") == sha).orderBy("commit_id").limit(1)
    return change_log(one, commit_files, 1).join(one.select("commit_id", "body"), "commit_id")


def commit_paths(commit_files: DataFrame, files: DataFrame, commit_ids: DataFrame) -> DataFrame:
    """Paths of the given commits, and whether each is at HEAD."""
    rows = commit_files.join(commit_ids, "commit_id", "left_semi")
    return _flag(rows.select("commit_id", "repo_slug", "path", "change_kind", "added", "deleted", "old_path"), files, ["repo_slug", "path"], "at_head")


def file_history(commits: DataFrame, commit_files: DataFrame, paths: DataFrame, limit: int = 50) -> DataFrame:
    """Newest commits of each requested ``repo_slug, path``."""
    rows = commit_files.join(paths, ["repo_slug", "path"], "left_semi").join(commits.drop("repo_slug"), "commit_id")
    rank = F.row_number().over(W.partitionBy("repo_slug", "path").orderBy(F.desc("commit_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("repo_slug", "path", "rank", "commit_id", "sha", "author_email", "change_kind", "added", "deleted")


def blame_runs(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one commit: ``path, start_line, end_line, sha`` from ``path, line_number, sha``."""
    island = F.col("line_number") - F.row_number().over(W.partitionBy("path", "sha").orderBy("line_number"))
    runs = lines.withColumn("island", island).groupBy("path", "sha", "island")
    return runs.agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line")).drop("island")


def file_ends(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """First and last commit of every path, with their authors."""
    by = commit_files.groupBy("repo_slug", "path").agg(F.min("commit_id").alias("first_commit"), F.max("commit_id").alias("last_commit"))
    side = lambda k: commits.select(F.col("commit_id").alias(f"{k}_commit"), F.col("author_email").alias(f"{k}_author"))
    return by.join(side("first"), "first_commit", "left").join(side("last"), "last_commit", "left").select("repo_slug", "path", "first_commit", "first_author", "last_commit", "last_author")


def co_changed(commits: DataFrame, commit_files: DataFrame, files: DataFrame, anchors: DataFrame, lineage: DataFrame | None = None, days: int | None = 90, ceiling: int = 200, limit: int = 20) -> DataFrame:
    """Paths that change together with each anchor ``repo_slug, path``, over the names that its lineage gives it.

    Commits with more than ``ceiling`` paths are left out; so are renames of paths that moved with the anchor.
    """
    own = anchors.select("repo_slug", F.col("path").alias("anchor"), F.col("path").alias("name"), F.lit(False).alias("old"))
    if lineage is not None:
        dirs = prefixes(anchors.select("repo_slug", "path"), "path").join(lineage.select("repo_slug", F.col("path").alias("directory"), "previous_path"), ["repo_slug", "directory"])
        before = dirs.select("repo_slug", F.col("path").alias("anchor"), F.concat("previous_path", F.substring("path", F.length("directory") + 1, F.length("path"))).alias("name"), F.lit(True).alias("old"))
        own = own.unionByName(before).distinct()
    renamed = F.col("change_kind") == "renamed"
    whole = W.partitionBy("commit_id")
    rows = Scope(days).history(commits, commit_files).select("commit_id", "repo_slug", "path", "change_kind")
    rows = rows.withColumns({"paths": F.count(F.lit(1)).over(whole), "moves": F.count_if(renamed).over(whole)}).filter(F.col("paths") <= ceiling)
    rows = written(rows, "window")  # the window's changes are read once
    touching = rows.withColumnRenamed("path", "name").join(own, ["repo_slug", "name"]).groupBy("repo_slug", "anchor", "commit_id")
    touching = touching.agg(F.bool_or(renamed).alias("moved"), F.count(F.lit(1)).alias("own"), F.count_if(renamed).alias("own_moves"), F.first("paths").alias("paths"), F.first("moves").alias("moves"))
    # Whether a commit has another path follows from its counts: all paths but the anchor's own, without what moved if the anchor did.
    others = F.col("paths") - F.col("own") - F.when(F.col("moved"), F.col("moves") - F.col("own_moves")).otherwise(0)
    touching = written(touching.select("repo_slug", "anchor", "commit_id", "moved", others.alias("others")), "touching")
    totals = touching.groupBy("repo_slug", "anchor").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("others") > 0).alias("paired"))
    pairs = touching.filter("others > 0").join(rows.select("commit_id", "repo_slug", "path", "change_kind"), ["commit_id", "repo_slug"]).filter(~(F.col("moved") & renamed))
    if lineage is None:
        pairs = pairs.filter("path != anchor")
    else:
        pairs = pairs.join(own.select("repo_slug", "anchor", F.col("name").alias("path")), ["repo_slug", "anchor", "path"], "left_anti")
    counted = pairs.groupBy("repo_slug", "anchor", "path").agg(F.count_distinct("commit_id").alias("together"))
    rank = F.row_number().over(W.partitionBy("repo_slug", "anchor").orderBy(F.desc("together"), "path"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return _flag(top.join(totals, ["repo_slug", "anchor"]), files, ["repo_slug", "path"], "at_head")


def recorded(commits: DataFrame, commit_files: DataFrame, paths: DataFrame) -> DataFrame:
    """Whole recorded history of the paths: number of commits and the newest, whatever the window."""
    rows = commit_files.select("repo_slug", "path", "commit_id").join(paths, ["repo_slug", "path"], "left_semi").join(commits.select("commit_id", "authored_at"), "commit_id")
    return rows.groupBy("repo_slug", "path").agg(F.count_distinct("commit_id").alias("commits"), F.max("authored_at").alias("newest_at"))


def coverage(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Repositories, and whether any history is recorded for them."""
    return _flag(files.select("repo_slug").distinct(), commits, ["repo_slug"], "has_history")


def repository_status(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Per repository: number of commits, the newest one's fields, first and last dates."""
    by = commits.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("commits"), F.max_by(F.struct("sha", "author_name", "subject"), "commit_id").alias("newest"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"))
    out = files.select("repo_slug").distinct().join(by, "repo_slug", "left")
    return out.select("repo_slug", F.coalesce("commits", F.lit(0)).alias("commits"), "newest.sha", "newest.author_name", "newest.subject", seconds(F.col("first_at")).alias("first_second"), seconds(F.col("last_at")).alias("last_second"))
