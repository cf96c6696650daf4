"""Attribution as a stream with state of its own: no batch reads what earlier ones wrote.

Two stateful steps. The first knows of every path which component of moved and copied files it belongs to, keyed by repository, and handles nothing
but names: a renamed or copied path takes the component of its source. The second keeps the runs of each path, keyed by component, so
that components are replayed apart from each other on as many tasks as there are. Both keep one entry a path in the state store and read only
those that a delivery touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.attribution import RUNS, Rope, replay_group

_EDITS = "edits array<struct<old_line:int,deleted:int,added:int>>"
_CHANGE = f"commit_id long, path string, old_path string, change_kind string, is_binary boolean, {_EDITS}"
_COLUMNS = ["commit_id", "path", "old_path", "change_kind", "is_binary", "edits"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Components(StatefulProcessor):
    """Names of a repository: gives each change its component, and tells a component that a path has left it. Commits that were seen are not given again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of = handle.getMapState("component", "path string", "component string")
        self.last = handle.getValueState("last", "commit_id long")

    def _component(self, path: str) -> str | None:
        return self.of.getValue((path,))[0] if self.of.containsKey((path,)) else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        (repo,) = key
        last = self.last.get()[0] if self.last.exists() else -1
        every = pd.concat(list(rows)).sort_values(["commit_id", "path"])
        every = every[every["commit_id"] > last].drop_duplicates(["commit_id", "path"])
        out = []
        for commit, group in every.groupby("commit_id", sort=True):
            found = list(group.itertuples(index=False))
            before = {p: self._component(p) for r in found for p in (r.path, r.old_path) if p}
            for r in found:
                moved = r.change_kind in ("renamed", "copied") and r.old_path
                source = before[r.old_path] if moved else before[r.path]
                component = source or (r.old_path if moved else r.path)
                if moved and before[r.path] not in (None, component):
                    out.append((repo, before[r.path], commit, r.path, None, "deleted", False, None))
                out.append((repo, component, commit, r.path, r.old_path if moved else None, r.change_kind, r.is_binary, r.edits))
                if r.change_kind != "deleted":
                    self.of.updateValue((r.path,), (component,))
            last = int(commit)
        if last >= 0:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["repo_slug", "component", *_COLUMNS])


class Attribution(StatefulProcessor):
    """Runs of the paths of a component; gives those of every path that a delivery touches, or none for a path that is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "path string", "runs binary")

    def _rope(self, path: str) -> Rope | None:
        if not self.runs.containsKey((path,)):
            return None
        return Rope(map(tuple, np.frombuffer(self.runs.getValue((path,))[0], "<i8").reshape(-1, 2).tolist()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        repo, _ = key
        changes = pd.concat(list(rows))
        moved = changes.loc[changes["change_kind"] == "renamed", ["old_path", "commit_id"]].dropna().rename(columns={"old_path": "path"})
        touched = pd.concat([changes[["path", "commit_id"]], moved]).groupby("path")["commit_id"].max()
        read = {*changes["path"], *changes["old_path"].dropna()}
        state = {(repo, p): rope for p in read if (rope := self._rope(p)) is not None}
        after, _ = replay_group(changes.assign(repo_slug=repo), state)
        out = []
        for path, newest in touched.items():
            rope = after.get((repo, path))
            if rope is None:
                if self.runs.containsKey((path,)):
                    self.runs.removeKey((path,))
            else:
                self.runs.updateValue((path,), (np.array([r for block in rope.blocks for r in block], "<i8").tobytes(),))
            listed = [{"start_line": a, "end_line": b, "commit_id": c} for a, b, c in rope.runs()] if rope else []
            out.append((repo, path, int(newest), len(listed) > 0, listed))
        yield pd.DataFrame(out, columns=["repo_slug", "path", "upto", "held", "runs"])


def attribution_stream(changes: DataFrame) -> DataFrame:
    """``repo_slug, path, upto, held, runs``: for each delivery the runs of the paths that it touches, up to a commit. Deliveries bring whole commits, in order."""
    keyed = changes.select("repo_slug", *_COLUMNS).groupBy("repo_slug").transformWithStateInPandas(Components(), f"repo_slug string, component string, {_CHANGE}", "append", "none")
    return keyed.groupBy("repo_slug", "component").transformWithStateInPandas(Attribution(), "repo_slug string, path string, upto long, held boolean, runs array<struct<start_line:int,end_line:int,commit_id:long>>", "append", "none")


def start_attribution(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every delivery's touched paths to a Parquet folder, exactly once, and ends when all input is read. The state store must be RocksDB's."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return attribution_stream(changes).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_runs(appended: DataFrame) -> DataFrame:
    """The runs that hold now: of every path the newest; where a path left one component for another in a commit, what holds lines counts."""
    newest = appended.groupBy("repo_slug", "path").agg(F.max_by("runs", F.struct("upto", "held")).alias("runs"))
    return newest.select("repo_slug", "path", F.explode("runs").alias("r")).select("repo_slug", "path", "r.*").select(*(c.split(" ")[0] for c in RUNS.split(", ")))
