"""Which commit each line comes from: replay of line edits, runs and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.plans.tables import discard, written

RUNS = "repo_slug string, path string, start_line int, end_line int, commit_id long"


class OverlapError(ValueError):
    """Runs of one path that overlap."""


class Rope:
    """A file's lines as runs ``(lines, commit)`` in blocks, edited in place by offset.

    An edit touches the blocks that it reaches and no line. Blocks never change, so that a copy of a file shares them.
    """

    BLOCK = 128

    def __init__(self, runs: Iterable[tuple[int, int]] = ()) -> None:
        self.blocks: list[tuple[tuple[int, int], ...]] = []
        self.sizes: list[int] = []
        self._put(0, 0, list(runs))

    def __len__(self) -> int:
        return sum(self.sizes)

    def copy(self) -> Rope:
        out = Rope()
        out.blocks, out.sizes = self.blocks[:], self.sizes[:]
        return out

    def _put(self, first: int, last: int, runs: list[tuple[int, int]]) -> None:
        """Runs in place of the blocks ``first .. last`` (exclusive); equal neighbours become one."""
        joined: list[tuple[int, int]] = []
        for n, commit in runs:
            if n and joined and joined[-1][1] == commit:
                joined[-1] = (joined[-1][0] + n, commit)
            elif n:
                joined.append((n, commit))
        parts = [tuple(joined[i : i + self.BLOCK]) for i in range(0, len(joined), self.BLOCK)]
        self.blocks[first:last] = parts
        self.sizes[first:last] = [sum(n for n, _ in p) for p in parts]

    def splice(self, at: int, gone: int, new: int, commit: int) -> None:
        """``new`` lines of a commit in place of ``gone`` lines behind the first ``at``."""
        first, begin = 0, 0
        while first < len(self.sizes) and begin + self.sizes[first] < at:
            begin += self.sizes[first]
            first += 1
        last, end = first, begin
        while last < len(self.sizes) and (end < at + gone or last == first):
            end += self.sizes[last]
            last += 1
        runs: list[tuple[int, int]] = []
        place, put = begin, False
        for n, c in (r for block in self.blocks[first:last] for r in block):
            before, behind = max(0, min(n, at - place)), max(0, min(n, place + n - at - gone))
            runs.append((before, c))
            if place + n >= at and not put:
                runs.append((new, commit))
                put = True
            runs.append((behind if place + n > at else 0, c))
            place += n
        self._put(first, last, runs if put else [*runs, (new, commit)])

    def apply(self, edits: list, commit: int) -> bool:
        """A commit's edits, in file order and by old line numbers; False, and nothing is changed, if they don't fit."""
        at, size = 0, len(self)
        for e in edits:
            if e["old_line"] < at or e["old_line"] + e["deleted"] > size:
                return False
            at = e["old_line"] + e["deleted"]
        for e in reversed(edits):  # so that old numbers hold
            self.splice(e["old_line"], e["deleted"], e["added"], commit)
        return True

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """First line, last line and commit of each run; lines of commit 0 belong to none."""
        line, held = 1, None
        for n, commit in (r for block in self.blocks for r in block):
            if held and held[2] == commit:
                held = (held[0], line + n - 1, commit)
            else:
                if held and held[2]:
                    yield held
                held = (line, line + n - 1, commit)
            line += n
        if held and held[2]:
            yield held


def rope_of(runs: pd.DataFrame) -> Rope:
    """A file from its runs; lines between them are of commit 0."""
    parts, line = [], 1
    for r in runs.sort_values("start_line").itertuples(index=False):
        parts += [(int(r.start_line) - line, 0), (int(r.end_line) - int(r.start_line) + 1, int(r.commit_id))]
        line = int(r.end_line) + 1
    return Rope(parts)


State = dict[tuple[str, str], Rope]


def replay_group(changes: pd.DataFrame, state: State | None = None, given: dict[tuple[str, str, int], Rope] | None = None, asked: list[tuple[int, str, str]] = ()) -> tuple[State, dict[tuple[str, str, int], Rope]]:
    """State by (repository, path) after the changes, oldest first, and the states that were ``asked`` for: of a path before a commit.

    Deleting and binary changes drop a path, renames move it, copies clone it; an edit that does not fit drops it. ``given`` are states before a commit of
    paths that are replayed elsewhere.
    """
    state, given, shots = dict(state or {}), given or {}, {}
    todo = sorted(asked)
    ordered = changes.sort_values(["commit_id", "path"]).itertuples(index=False)
    for commit, group in groupby(ordered, key=lambda r: r.commit_id):
        rows = list(group)
        while todo and todo[0][0] <= commit:
            at, repo, path = todo.pop(0)
            shots[(repo, path, at)] = state.get((repo, path), Rope()).copy()
        before = dict(state)
        for r in rows:
            if r.change_kind == "deleted" or (r.change_kind == "renamed" and r.old_path):
                state.pop((r.repo_slug, r.path if r.change_kind == "deleted" else r.old_path), None)
        for r in rows:
            key = (r.repo_slug, r.path)
            if r.change_kind == "deleted":
                continue
            if r.is_binary:
                state.pop(key, None)
                continue
            source = (r.repo_slug, r.old_path) if r.change_kind in ("renamed", "copied") and r.old_path else key
            lines = Rope() if r.change_kind == "added" else before[source].copy() if source in before else given.get((*source, int(commit)), Rope()).copy()
            if lines.apply(list(r.edits if r.edits is not None else []), int(r.commit_id)):
                state[key] = lines
            else:
                state.pop(key, None)
    for at, repo, path in todo:
        shots[(repo, path, at)] = state.get((repo, path), Rope()).copy()
    return state, shots


def rename_groups(changes: DataFrame, rounds: int = 60) -> DataFrame:
    """``repo_slug, path, family``: paths that changes with an old path join, by rounds of least labels with doubling."""
    edges = changes.filter("old_path IS NOT NULL").select("repo_slug", F.col("path").alias("a"), F.col("old_path").alias("b")).distinct()
    both = written(edges.unionByName(edges.select("repo_slug", F.col("b").alias("a"), F.col("a").alias("b"))), "rename-edges")
    if both.isEmpty():
        return changes.select("repo_slug", "path").distinct().withColumn("family", F.col("path"))
    names = changes.select("repo_slug", "path").union(edges.select("repo_slug", "b")).distinct()
    labels = written(names.withColumn("family", F.col("path")), "families")
    for _ in range(rounds):
        near = both.join(labels.select("repo_slug", F.col("path").alias("b"), "family"), ["repo_slug", "b"]).groupBy("repo_slug", "a").agg(F.min("family").alias("other"))
        step = labels.join(near.withColumnRenamed("a", "path"), ["repo_slug", "path"], "left").select("repo_slug", "path", F.least("family", F.coalesce("other", "family")).alias("family"))
        jump = step.select("repo_slug", F.col("path").alias("family"), F.col("family").alias("root"))
        fresh = written(step.join(jump, ["repo_slug", "family"], "left").select("repo_slug", "path", F.coalesce("root", "family").alias("family")), "families")
        settled = fresh.join(labels.withColumnRenamed("family", "was"), ["repo_slug", "path"]).filter("family != was").isEmpty()
        discard(labels)
        labels = fresh
        if settled:
            discard(both)
            return labels
    raise ValueError(f"paths are joined by chains of renames that {rounds} rounds don't resolve")


_SHOTS = "repo_slug string, path string, at long, start_line int, end_line int, commit_id long"
_STATE = "repo_slug string, family string, path string, at long, wanted boolean, start_line int, end_line int, commit_id long"


def _round(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Replays families, each in one task. ``state`` has what a family starts from: known runs, runs of copied files before a commit (``at``), and what is ``wanted`` of it."""

    def run(edits: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        wanted = before["wanted"].astype(bool)
        asked = [(int(r.at), r.repo_slug, r.path) for r in before[wanted].itertuples(index=False)]
        begin: State = {}
        given: dict[tuple[str, str, int], Rope] = {}
        for (repo, path, at), g in before[~wanted].assign(at=before["at"].fillna(-1).astype("int64")).groupby(["repo_slug", "path", "at"]):
            if at < 0:
                begin[(repo, path)] = rope_of(g)
            else:
                given[(repo, path, int(at))] = rope_of(g)
        state_, shots = replay_group(edits, begin, given, asked)
        out = [(repo, path, None, *r) for (repo, path), rope in state_.items() for r in rope.runs()]
        out += [(repo, path, at, *r) for (repo, path, at), rope in shots.items() for r in rope.runs()]
        return pd.DataFrame(out, columns=["repo_slug", "path", "at", "start_line", "end_line", "commit_id"]).astype({"at": "Int64"})

    held = state.select(F.col("repo_slug").alias("slug"), F.col("family").alias("kin"), *(F.col(c).alias(c) for c in ("repo_slug", "path", "at", "wanted", "start_line", "end_line", "commit_id")))
    return rows.groupBy("repo_slug", "family").cogroup(held.groupBy("slug", "kin")).applyInPandas(run, _SHOTS)


def replay(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Runs after ``repo_slug, commit_id, path, old_path, change_kind, is_binary, edits``, starting from known runs.

    Families of paths that renames join are replayed apart from each other, each in one task. A copy joins no family: its first state is the copied file's before that
    commit, which the other family's replay gives. So families come in rounds, those first that copy from none, and a file that is copied everywhere is still
    one family with its own changes. Families that copy from each other in turn are replayed as one.
    """
    spark = changes.sparkSession
    changes = changes.withColumn("old_path", F.when(F.col("change_kind").isin("renamed", "copied"), F.col("old_path")))
    moved = changes.filter("old_path IS NOT NULL")
    copies = written(moved.filter("change_kind = 'copied'").select("repo_slug", "path", F.col("old_path").alias("source"), F.col("commit_id").alias("at")).distinct(), "copies")
    families = rename_groups(changes.withColumn("old_path", F.when(F.col("change_kind") == "renamed", F.col("old_path"))))
    if known is None:
        known = spark.createDataFrame([], RUNS)
    family = lambda c: families.select("repo_slug", F.col("path").alias(c), F.col("family").alias(f"{c}_family"))
    asks = written(copies.join(family("path"), ["repo_slug", "path"]).join(family("source"), ["repo_slug", "source"], "left").filter("source_family IS NULL OR source_family != path_family"), "asks")
    # A copied path without changes of its own is a family by itself, from what is known of it.
    still = asks.filter("source_family IS NULL").select("repo_slug", "source", "at", "path_family").distinct()
    given = known.join(still, (known.repo_slug == still.repo_slug) & (known.path == still.source)).select(known.repo_slug, F.col("path_family").alias("family"), known.path, "at", F.lit(False).alias("wanted"), "start_line", "end_line", "commit_id")
    links = asks.filter("source_family IS NOT NULL")
    rows = changes.join(families, ["repo_slug", "path"])
    start = known.join(families, ["repo_slug", "path"]).select("repo_slug", "family", "path", F.lit(None).cast("long").alias("at"), F.lit(False).alias("wanted"), "start_line", "end_line", "commit_id")
    none = F.lit(None).cast("int")
    wanted = links.select("repo_slug", F.col("source_family").alias("family"), F.col("source").alias("path"), "at").distinct().select("repo_slug", "family", "path", "at", F.lit(True).alias("wanted"), none.alias("start_line"), none.alias("end_line"), none.cast("long").alias("commit_id"))
    state = start.unionByName(given).unionByName(wanted)
    if links.isEmpty():
        return _round(rows, state).drop("at")
    todo = written(families.select("repo_slug", "family").distinct(), "families-todo")
    done, shots = [], []
    while not todo.isEmpty():
        waits = links.join(todo.withColumnRenamed("family", "source_family"), ["repo_slug", "source_family"], "left_semi").select("repo_slug", F.col("path_family").alias("family")).distinct()
        ready = written(todo.join(waits, ["repo_slug", "family"], "left_anti"), "families-ready")
        if ready.isEmpty():
            break
        made = written(_round(rows.join(ready, ["repo_slug", "family"], "left_semi"), _with_shots(state, links, shots).join(ready, ["repo_slug", "family"], "left_semi")), "replayed")
        done.append(made.filter("at IS NULL").drop("at"))
        shots.append(made.filter("at IS NOT NULL"))
        rest = written(todo.join(ready, ["repo_slug", "family"], "left_anti"), "families-todo")
        discard(todo, ready)
        todo = rest
    if not todo.isEmpty():  # they copy from each other in turn
        both = links.join(todo.withColumnRenamed("family", "path_family"), ["repo_slug", "path_family"], "left_semi").join(todo.withColumnRenamed("family", "source_family"), ["repo_slug", "source_family"], "left_semi")
        tied = _tied(both, todo)
        again = rows.join(tied, ["repo_slug", "family"]).drop("family").withColumnRenamed("tie", "family")
        held = _with_shots(state, links, shots).filter("NOT wanted").join(tied, ["repo_slug", "family"]).drop("family").withColumnRenamed("tie", "family").select(*(c.split(" ")[0] for c in _STATE.split(", ")))
        done.append(written(_round(again, held), "replayed").filter("at IS NULL").drop("at"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _with_shots(state: DataFrame, links: DataFrame, shots: list[DataFrame]) -> DataFrame:
    """The state with the copied files that earlier rounds gave, for every family that asks for one."""
    for made in shots:
        got = made.withColumnRenamed("path", "source").join(links.select("repo_slug", "source", "at", F.col("path_family").alias("family")).distinct(), ["repo_slug", "source", "at"])
        state = state.unionByName(got.select("repo_slug", "family", F.col("source").alias("path"), "at", F.lit(False).alias("wanted"), "start_line", "end_line", "commit_id"))
    return state


def _tied(links: DataFrame, todo: DataFrame) -> DataFrame:
    """``repo_slug, family, tie``: families that links join, named by the least of them."""
    pairs = links.select("repo_slug", F.col("path_family").alias("path"), F.col("source_family").alias("old_path"))
    ties = rename_groups(pairs)
    return todo.join(ties.select("repo_slug", F.col("path").alias("family"), F.col("family").alias("tie")), ["repo_slug", "family"])


def touched_paths(changes: DataFrame) -> DataFrame:
    """Paths whose runs a replay gives anew: those that change or move away. A file that is only copied stays as it is."""
    return changes.select("repo_slug", "path").union(changes.filter("change_kind = 'renamed' AND old_path IS NOT NULL").select("repo_slug", "old_path")).distinct()


def read_paths(changes: DataFrame) -> DataFrame:
    """Paths whose known runs a replay starts from."""
    return touched_paths(changes).union(changes.filter("change_kind = 'copied' AND old_path IS NOT NULL").select("repo_slug", "old_path")).distinct()


def replay_touched(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Known runs with only the touched paths replayed and rewritten."""
    keys = ["repo_slug", "path"]
    return known.join(touched_paths(changes), keys, "left_anti").unionByName(replay(changes, known.join(read_paths(changes), keys, "left_semi")))


def overlaps(runs: DataFrame) -> DataFrame:
    """Runs that begin before an earlier one of their path has ended."""
    before = W.partitionBy("repo_slug", "path").orderBy("start_line", "end_line").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("ended", F.max("end_line").over(before)).filter("start_line <= ended")


def checked(runs: DataFrame) -> DataFrame:
    bad = overlaps(runs).limit(1).collect()
    if bad:
        raise OverlapError(f"runs of {bad[0]['path']} overlap at line {bad[0]['start_line']}")
    return runs


def run_lines(runs: DataFrame) -> DataFrame:
    """One row per attributed line."""
    return runs.select("repo_slug", "path", F.explode(F.sequence("start_line", "end_line")).alias("line_number"), "commit_id")


def attributed(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """``lines`` with ``commit_id``: runs are expanded to lines, which makes the join one on equal keys."""
    return lines.drop("commit_id").join(run_lines(runs), ["repo_slug", "path", "line_number"], "left")


def with_ends(files: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``files`` with their first and last commit; null where no history names them."""
    ends = commit_files.groupBy("repo_slug", "path").agg(F.min("commit_id").alias("first_commit"), F.max("commit_id").alias("last_commit"))
    return files.drop("first_commit", "last_commit").join(ends, ["repo_slug", "path"], "left")
