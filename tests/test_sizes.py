"""Tasks stay as small as they are when the input grows: how rows are dealt, and that no task holds a whole group's values."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import history, language, lineage, overview
from millrace.plans import corpus
from millrace.plans.scope import Scope
from millrace.plans.tables import settings, written

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_history_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 100)
    rows, before = spark.read.parquet(f"{DATA}/lineitem.parquet").count(), dict(spark.conf.getAll)
    own = corpus.sized(spark, DATA, "commits", "commit_files")
    changes = corpus.view(own, DATA, "commit_files")
    assert int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= rows / 100 > 2
    assert changes.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"
    assert dict(spark.conf.getAll) == before
    assert corpus.sized(spark, DATA, "commits") is spark


def test_scans_of_the_history_are_cut(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SCAN_BYTES", "64k")  # a scan that sorts for an aggregate holds what it reads
    own = corpus.sized(spark, DATA, "commit_files")
    with settings(own, spark__sql__files__openCostInBytes="1k"):
        assert own.read.parquet(f"{DATA}/lineitem.parquet").rdd.getNumPartitions() > 1
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "64k"


@pytest.fixture(scope="module")
def tables(spark):
    return [corpus.view(spark, DATA, n) for n in ("commits", "commit_files", "files")]


@pytest.mark.parametrize("what", ["hidden_paths", "hot_directories", "churned_extensions", "excluded_counts", "lineage"])
def test_no_task_makes_a_groups_values_distinct(tables, what):
    commits, changes, files = tables
    scope = Scope(365, include="*.cs", excluded_paths=["*.sql"])
    asked = {
        "hidden_paths": lambda: history.hidden_paths(commits, changes, scope), "hot_directories": lambda: history.hot_directories(commits, changes, files, scope), "churned_extensions": lambda: history.churned_extensions(commits, changes, scope),
        "excluded_counts": lambda: overview.excluded_counts(commits, changes, files, scope), "lineage": lambda: lineage.lineage_hops(changes),
    }
    assert "distinct" not in plan(asked[what]()).split("== Optimized Logical Plan ==")[1].lower()


def test_distinct_counts_leave_out_nulls_and_keep_their_groups(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("b", None, "x")], "g string, i int, s string")
    got = history.distinct_counts(rows, ["g"], ["i", "s"], "n").collect()
    assert {(r["g"], r["n"]) for r in got} == {("a", 1), ("b", 0)}
    assert history.distinct_counts(rows.filter("g = 'c'"), [], ["i", "s"], "n").collect()[0]["n"] == 0


def test_files_of_one_block_are_scanned_by_many_tasks(spark):
    files = spark.range(200).coalesce(1).select(F.lit("r").alias("repo_slug"), F.concat(F.lit("f"), "id").alias("path"), F.lit("cs").alias("extension"), F.array(F.lit("class A { }")).alias("lines"))
    for scanned in (language.declarations(files), language.occurrences(files, "A"), language.line_states(files)):
        held = scanned.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(held) == 2 and sum(r["n"] for r in held) == 200


@pytest.mark.parametrize("name", ["co_changed", "co_changed_ceiling"])
def test_changes_are_put_together_once(spark, name):
    read = queries.QUERIES[name](spark, DATA).inputFiles()
    assert read and not any("lineitem.parquet" in f or "orders.parquet" in f for f in read)


def test_excluded_counts_puts_changes_together_once(spark):
    read = queries.QUERIES["excluded_counts"](spark, DATA).inputFiles()
    assert read and not any("lineitem.parquet" in f for f in read)


def test_folders_are_not_dealt_by_repository(tables):
    commits, changes, files = tables
    dealt = plan(overview.folder_coupling(commits, changes, files, Scope(365))).split("== Physical Plan ==")[1]
    assert "hashpartitioning(commit_id" in dealt and not re.search(r"hashpartitioning\(repo_slug#\d+L?(, folder#\d+)?, \d", dealt)


@pytest.mark.parametrize("name", ["hidden_paths", "hot_files", "hotspots", "churned_extensions", "authors_per_file", "recorded_history", "excluded_files", "excluded_inner", "extension_counts"])
def test_history_queries_are_dealt_by_rows_and_cut_their_scans(spark, monkeypatch, name):
    monkeypatch.setattr(corpus, "TASK_ROWS", 100)
    own = queries.QUERIES[name](spark, DATA).sparkSession
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == corpus.SCAN_BYTES
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= spark.read.parquet(f"{DATA}/lineitem.parquet").count() / 100


def shuffled(spark):
    """Rows that all shuffles of the session so far have written."""
    store, gateway = spark._jsc.sc().statusStore(), spark._sc._gateway
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lineage_moves_a_change_once_for_directories_and_once_for_commits(spark):
    n = 5000
    changes = spark.range(n).select(F.lit("r").alias("repo_slug"), F.col("id").alias("commit_id"), F.concat(F.lit("new/a/b/c/d/f"), "id").alias("path"), F.lit("renamed").alias("change_kind"), F.concat(F.lit("old/a/b/c/d/f"), "id").alias("old_path"))
    changes = written(changes, "renames")
    before = shuffled(spark)
    rows = lineage.path_lineage(changes).collect()
    assert {(r["path"], r["previous_path"], r["combined_commits"]) for r in rows} == {("new" + t, "old" + t, n) for t in ("", "/a", "/a/b", "/a/b/c", "/a/b/c/d")}
    assert 2 * n <= shuffled(spark) - before < 2.2 * n  # a row for each directory and pair of them would be five times as many and more


def plain_lineage(changes):
    """``path_lineage`` of ``(slug, commit, path, kind, old)`` by loops."""
    below, commits, moved = defaultdict(set), defaultdict(set), defaultdict(dict)
    above = lambda p: [p[:i] for i, c in enumerate(p) if c == "/"]
    for slug, commit, path, kind, old in changes:
        if slug is None or path is None:
            continue
        for d in above(path):
            below[slug, d].add(path)
            commits[slug, d].add(commit)
            if kind == "renamed" and old is not None and old.endswith(path[len(d) :]):
                previous = old[: len(old) - len(path) + len(d)]
                if previous != d and not d.startswith(previous + "/") and not previous.startswith(d + "/"):
                    moved[slug, d].setdefault(previous, []).append((path, commit))
    hops = {}
    for (slug, d), found in moved.items():
        newest = lambda v: max((c for _, c in v if c is not None), default=-1)
        ranked = sorted((-len({p for p, _ in v}), -newest(v), previous) for previous, v in found.items() if 2 * len({p for p, _ in v}) > len(below[slug, d]))
        if ranked:
            hops[slug, d] = ranked[0][2]
    out = set()
    for slug, d in hops:
        names = [d]
        while len(names) <= lineage.MAX_HOPS and (slug, names[-1]) in hops and hops[slug, names[-1]] not in names:
            names.append(hops[slug, names[-1]])
        whole = set().union(*(commits[slug, x] for x in names)) - {None}
        out |= {(slug, d, i, x, len(commits[slug, x]), len(whole)) for i, x in enumerate(names) if i}
    return out


@pytest.mark.parametrize("broadcast", [0, 300_000])
def test_lineage_in_shares_is_that_of_loops(spark, monkeypatch, broadcast):
    deal = random.Random(4)
    some = lambda: "/".join(deal.choice(["a", "b", "", "é", "a.b"]) for _ in range(deal.randint(1, 4)))
    moves = [(deal.choice("rs"), some() + "/", some() + "/") for _ in range(14)]
    changes = [(deal.choice(["r", "s", "s", None]), deal.choice([*range(30), None]), some(), deal.choice(["renamed", "added"]), deal.choice([some(), None])) for _ in range(60)]
    for slug, new, old in moves:
        for _ in range(12):
            tail = f"{some()}.x{deal.randint(1, 9)}"
            changes.append((slug, deal.choice([*range(30), None]), new + tail, "renamed", old + tail))
    changes += [("r", 1, None, "renamed", "a/b"), ("r", 2, "", "renamed", "a/b"), ("r", 3, "/", "renamed", "b/"), ("r", 3, "/c", "renamed", "b/c"), ("r", 4, "/d", "renamed", "b/d")]
    frame = spark.createDataFrame(changes, "repo_slug string, commit_id long, path string, change_kind string, old_path string")
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lineage, "SHARE_ROWS", 100)
    expected = plain_lineage(changes)
    assert len(expected) > 10 and max(r[2] for r in expected) > 1
    got = lineage.path_lineage(frame).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("name", ["path_lineage", "path_lineage_hops"])
def test_lineage_reads_changes_that_were_put_together_once(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(lineage, "path_lineage", lambda changes: made.append(changes.inputFiles()) or changes)
    queries.QUERIES[name](spark, DATA)
    assert made[0] and not any("lineitem.parquet" in f for f in made[0])


def test_changes_in_shares_are_those_of_the_view(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SHARE_ROWS", 1500)
    got = corpus.paths(spark, DATA)
    shares = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    view = corpus.view(spark, DATA, "commit_files").select("repo_slug", "commit_id", "path")
    assert len(shares) >= 4 and got.count() == view.count() > 0 and got.exceptAll(view).isEmpty()
