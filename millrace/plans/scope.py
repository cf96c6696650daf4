"""History scopes: window, repository, directory, filters and exclusions as one list of predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import patterns

DAY = 86_400


def seconds(at: Column) -> Column:
    """Whole seconds since 1970, so that session time zones and fractions don't matter."""
    return F.unix_seconds(at.cast("timestamp"))


@dataclass(frozen=True)
class Scope:
    """What part of the history a question is about; ``days=None`` is all of it. Windows end at the newest commit in scope."""

    days: int | None = 90
    repo: str | None = None
    directory: str | None = None
    include: str | None = None
    exclude: str | None = None
    excluded_paths: list[str] = field(default_factory=list)

    def history(self, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
        """Changed paths with their commits, inside the window and the directory, before any filter on paths."""
        own = commits.filter(F.col("repo_slug") == self.repo) if self.repo else commits
        own = own.withColumn("authored_second", seconds(F.col("authored_at")))
        if self.days is not None:
            span = min(max(self.days, 1), 3650) * DAY
            newest = own.agg(F.max("authored_second").alias("newest"))
            own = own.join(F.broadcast(newest), F.col("authored_second") >= F.col("newest") - span).drop("newest")  # one row
        rows = own.join(commit_files.drop("repo_slug"), "commit_id")
        if self.directory:
            rows = rows.filter(F.startswith("path", F.lit(self.directory.rstrip("/") + "/")))
        return rows

    def kept(self, path: Column) -> Column:
        """Whether the filters on paths keep a path."""
        out = patterns.has_extension(path, self.include) & patterns.no_term(path, self.exclude)
        return out & ~patterns.excluded(path, self.excluded_paths)

    def rows(self, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
        return self.history(commits, commit_files).filter(self.kept(F.col("path")))


def commit_scope(commits: DataFrame, commit_files: DataFrame | None = None, repo: str | None = None, author: str | None = None, subject: str | None = None, prefix: str | None = None) -> DataFrame:
    """Commits by repository, part of the address, part of the subject (both without case), and a path or directory that they touch."""
    if repo:
        commits = commits.filter(F.col("repo_slug") == repo)
    if author:
        commits = commits.filter(F.contains(F.lower("author_email"), F.lit(author.lower())))
    if subject:
        commits = commits.filter(F.contains(F.lower("subject"), F.lit(subject.lower())))
    if prefix:
        touched = commit_files.filter((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "/"))).select("commit_id")
        commits = commits.join(touched, "commit_id", "left_semi")
    return commits


def page(df: DataFrame, size: int, number: int = 1) -> DataFrame:
    """A page of an ordered frame."""
    return df.offset((max(number, 1) - 1) * size).limit(size)


def trimmed(df: DataFrame, limit: int) -> DataFrame:
    """One row more than the limit, by which a caller sees that rows were left out."""
    return df.limit(limit + 1)


@dataclass(frozen=True)
class FileFilter:
    """Files by repository, path terms (any), excluded terms (none) and extension."""

    repo: str | None = None
    paths: str | None = None
    exclude: str | None = None
    extension: str | None = None

    def keeps(self) -> Column:
        """The filter as a condition on a row."""
        out = patterns.any_term(F.col("qualified_path"), self.paths) & patterns.no_term(F.col("qualified_path"), self.exclude)
        if self.repo:
            out = (F.col("repo_slug") == self.repo) & out
        return out & (F.col("extension") == self.extension.lower().lstrip("*.")) if self.extension else out

    def apply(self, files: DataFrame) -> DataFrame:
        return files.filter(self.keeps())


def qualified(slug: Column, path: Column, single: bool) -> Column:
    """A path as users name it: with its repository unless there is only one."""
    return path if single else F.concat_ws("/", slug, path)


def parsed(name: Column, slugs: DataFrame, requests: DataFrame, single: bool) -> DataFrame:
    """``requests`` with ``repo_slug`` and ``path`` of a qualified name; null where no repository fits."""
    if single:
        return requests.withColumn("path", name).crossJoin(F.broadcast(slugs.select(F.col("slug").alias("repo_slug")).limit(1)))
    first = requests.withColumn("path", F.regexp_extract(name, "^[^/]*/(.*)$", 1)).withColumn("_slug", F.split_part(name, F.lit("/"), F.lit(1)))
    return first.join(slugs.select(F.col("slug").alias("repo_slug")), F.lower("_slug") == F.lower("repo_slug"), "left").drop("_slug")
