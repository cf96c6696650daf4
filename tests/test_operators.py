import random
from datetime import datetime, timedelta

import pandas as pd

from millrace.operators import attribution, history, imports, language, lineage, overview
from millrace.plans.schema import TABLES
from millrace.plans.scope import Scope
from millrace.sources import ingest, publish

BASE = datetime(2024, 1, 1)


def corpus(spark, rows):
    """``(minute, author, [(kind, path, old_path)])`` as commits and changed paths of one repository."""
    commits = [(i, "one", f"{i:040x}", a, f"{a}@x", BASE + timedelta(minutes=m), f"s{i}", "") for i, (m, a, _) in enumerate(rows, 1)]
    changes = [(i, "one", p, k, 1, 0, o) for i, (_, _, fs) in enumerate(rows, 1) for k, p, o in fs]
    return spark.createDataFrame(commits, "commit_id long, repo_slug string, sha string, author_name string, author_email string, authored_at timestamp, subject string, body string"), spark.createDataFrame(changes, "commit_id long, repo_slug string, path string, change_kind string, added long, deleted long, old_path string")


def heads(spark, *paths):
    return spark.createDataFrame([("one", p, None, 10) for p in paths], "repo_slug string, path string, skip_reason string, line_count long")


A, M, D, R = "added", "modified", "deleted", "renamed"


def test_churn_window(spark):
    commits, changes = corpus(spark, [(0, "Ada", [(A, "old/Ancient.cs", None)]), (14400, "Ada", [(A, f"src/{n}.cs", None) for n in ("Cold", "Gone", "Hot")]), (14401, "Grace", [(M, "src/Hot.cs", None)]), (14402, "Grace", [(M, "src/Hot.cs", None), (M, "src/Cold.cs", None)]), (14403, "Grace", [(D, "src/Gone.cs", None)])])
    rows = {r.path: r for r in history.hot_files(commits, changes, heads(spark, "src/Hot.cs", "src/Cold.cs"), Scope(days=1)).collect()}
    assert rows["src/Hot.cs"].commits == 3 and rows["src/Cold.cs"].commits == 2 and not rows["src/Gone.cs"].at_head and "old/Ancient.cs" not in rows
    assert "old/Ancient.cs" in {r.path for r in history.hot_files(commits, changes, heads(spark, "src/Hot.cs"), Scope(days=30)).collect()}


def test_scope_is_literal(spark):
    commits, changes = corpus(spark, [(0, "a", [(A, "app/[slug]/page.tsx", None), (A, "app/s/page.tsx", None)])])
    assert [r.path for r in history.hot_files(commits, changes, heads(spark, "x"), Scope(directory="app/[slug]")).collect()] == ["app/[slug]/page.tsx"]


def test_co_change_with_ceiling(spark):
    bulk = [(M, f"vendor/Bulk{i:02}.cs", None) for i in range(12)]
    commits, changes = corpus(spark, [(0, "a", [(A, f"src/{n}.cs", None) for n in ("Api", "Dto", "Old", "Store")]), (1, "a", [(M, "src/Api.cs", None), (M, "src/Store.cs", None)]), (2, "a", [(M, "src/Api.cs", None), (M, "src/Store.cs", None)]), (3, "a", [(M, "src/Api.cs", None), (M, "src/Dto.cs", None)]), (4, "a", [(A, "src/Lonely.cs", None)]), (5, "a", [(M, "src/Api.cs", None), *bulk])])
    anchor = spark.createDataFrame([("one", "src/Api.cs")], "repo_slug string, path string")
    rows = {r.path: r for r in history.co_changed(commits, changes, heads(spark, "src/Store.cs"), anchor, None, 30, 5).collect()}
    assert {p: r.together for p, r in rows.items()} == {"src/Store.cs": 3, "src/Dto.cs": 2, "src/Old.cs": 1}
    assert rows["src/Store.cs"].commits == 4 and rows["src/Store.cs"].paired == 4 and not rows["src/Old.cs"].at_head


def test_lineage(spark):
    names = ("Contact", "Order", "Api/Handler")
    commits, changes = corpus(spark, [(0, "a", [(A, f"model/{n}.cs", None) for n in names]), (1, "a", [(M, "model/Contact.cs", None)]), (2, "a", [(R, f"src/Model/{n}.cs", f"model/{n}.cs") for n in names])])
    rows = {r.path: r for r in lineage.path_lineage(changes).collect()}
    assert rows["src/Model"].previous_path == "model" and rows["src/Model"].previous_commits == 2 and rows["src/Model"].combined_commits == 3


def test_folders(spark):
    commits, changes = corpus(spark, [(0, "a", [(A, p, None) for p in ("src/A.cs", "src/B.cs", "lib/C.cs", "docs/D.md", "Root.md")]), (1, "a", [(M, p, None) for p in ("src/A.cs", "src/B.cs", "lib/C.cs")])])
    rows = {(r.a, r.b): r.together for r in overview.folder_coupling(commits, changes, heads(spark, "src/A.cs", "lib/C.cs", "docs/D.md"), Scope()).collect()}
    assert rows == {("lib", "src"): 2, ("docs", "lib"): 1, ("docs", "src"): 1}


def test_replay_against_lists(spark):
    """Random edit scripts against a plain list of lines."""
    rng, rows, state = random.Random(4), [], {}
    for commit in range(1, 25):
        path = f"p{rng.randrange(3)}"
        lines = state.get(path)
        if lines is None:
            n = rng.randrange(1, 6)
            state[path] = [commit] * n
            rows.append((commit, path, None, A, [(0, 0, n)]))
        elif rng.random() < 0.15:
            del state[path]
            rows.append((commit, path, None, D, []))
        else:
            old = rng.randrange(len(lines) + 1)
            gone, new = rng.randrange(len(lines) - old + 1), rng.randrange(4)
            state[path] = lines[:old] + [commit] * new + lines[old + gone :]
            rows.append((commit, path, None, M, [(old, gone, new)]))
    changes = spark.createDataFrame([("one", *r[:4], False, r[4]) for r in rows], "repo_slug string, commit_id long, path string, old_path string, change_kind string, is_binary boolean, edits array<struct<old_line:int,deleted:int,added:int>>")
    runs = attribution.replay(changes)
    got = {}
    for r in attribution.run_lines(attribution.checked(runs)).orderBy("path", "line_number").collect():
        got.setdefault(r.path, []).append(r.commit_id)
    assert got == {p: v for p, v in state.items() if v}


def test_edits_that_do_not_fit():
    rope = attribution.Rope([(1, 1), (1, 2)])
    assert not rope.apply([{"old_line": 2, "deleted": 1, "added": 0}], 3) and list(rope.runs()) == [(1, 1, 1), (2, 2, 2)]
    rope = attribution.Rope([(1, 1), (1, 2), (1, 3)])
    assert rope.apply([{"old_line": 1, "deleted": 1, "added": 2}], 9) and list(rope.runs()) == [(1, 1, 1), (2, 3, 9), (4, 4, 3)]


def test_ingest(spark):
    rows = [("one", "a/B.cs", b"x\r\ny\n", 5), ("one", "bin", b"\x00\x01", 2), ("one", "big", b"z", 1 << 30), ("one", "w.txt", b"caf\xe9", 4), ("one", "u.txt", b"\xff\xfeh\x00i\x00", 6), ("one", "empty", b"", 0)]
    files, lines = ingest.ingest(spark.createDataFrame(rows, "repo_slug string, path string, content binary, length long"))
    by = {r.path: r for r in files.collect()}
    assert by["a/B.cs"].line_count == 2 and by["a/B.cs"].extension == "cs" and by["a/B.cs"].directory == "a"
    assert by["bin"].skip_reason == "binary" and by["big"].skip_reason == "larger than 25 MiB" and by["empty"].line_count == 0
    text = {r.content for r in lines.collect()}
    assert text == {"x", "y", "café"} and by["u.txt"].skip_reason == "binary"
    assert ingest.decode(pd.Series([b"\xff\xfeh\x00i\x00", b"\xef\xbb\xbfx"])).tolist() == ["hi", "x"]


def test_patch_and_commits(spark):
    patch = "@@ -1,2 +1,3 @@\n a\n@@ -5,0 +7 @@\n+x"
    got = spark.range(1).select(ingest.line_edits(ingest.F.lit(patch)).alias("e")).first().e
    assert [tuple(x) for x in got] == [(0, 2, 3), (5, 0, 1)]
    export = spark.createDataFrame([("one", i, f"s{3 - i}", "a", "a@x", BASE, f"subject{3 - i}\n\nbody") for i in range(3)], "repo_slug string, walk_pos int, sha string, author_name string, author_email string, authored_at timestamp, message string")
    known = spark.createDataFrame([(7, "one", "s1")], "commit_id long, repo_slug string, sha string")
    assert [(r.commit_id, r.sha, r.subject, r.body) for r in ingest.new_commits(export, known).orderBy("commit_id").collect()] == [(8, "s2", "subject2", "body"), (9, "s3", "subject3", "body")]


def test_publish(spark, tmp_path):
    files = heads(spark, "a").selectExpr("*", "1L AS file_id", "1 AS line_number")
    assert publish.restore(spark, f"file://{tmp_path}/d") is None
    rest = {n: files for n in TABLES if n != "index_info"}
    assert publish.publish(f"file://{tmp_path}/d", rest) == 1
    assert publish.publish(f"file://{tmp_path}/d", rest | {"files": heads(spark, "a", "b")}) == 2
    assert publish.restore(spark, f"file://{tmp_path}/d")["files"].count() == 2


def test_language(spark):
    source = ["// Order in a comment", "using Shop.Core;", "namespace Shop.Orders;", "public class Order", "{", '    public string Name = "Order";', "    public Order Copy() { return new Order(); }", "    /* Order", "       Order */ Order x = y;", "}"]
    files = spark.createDataFrame([("one", "Order.cs", "cs", source)], "repo_slug string, path string, extension string, lines array<string>")
    kinds = [(r.line_number, r.kind) for r in language.occurrences(files, "Order").orderBy("line_number", "column").collect()]
    assert kinds == [(1, "comment"), (4, "definition"), (6, "string_literal"), (7, "type_use"), (7, "instantiation"), (8, "comment"), (9, "comment"), (9, "type_use")]
    assert [r.name for r in language.imports(files).collect()] == ["Shop.Core"]
    assert language.modules(files).first().module == "Shop.Orders"
    declared = language.declarations(files)
    assert {(r.type_name, r.member) for r in declared.collect()} >= {("Order", None), (None, "Name"), (None, "Copy")}
    rows = spark.createDataFrame([("one", "Order.cs", 8, 8)], "repo_slug string, path string, line_number int, indent int")
    assert language.enclosing(rows, declared).first().scope == "Order.Copy"
    assert [r.state for r in language.line_states(files).orderBy("line_number").collect()][8] == "comment"


def test_imports(spark):
    files = spark.createDataFrame([(1, "one", "src/a.ts", "src", None), (2, "one", "src/lib/index.ts", "src/lib", None), (3, "one", "x.cs", "", "Shop.Core")], "file_id long, repo_slug string, path string, directory string, module string")
    edges = spark.createDataFrame([(1, 1, 1, "./lib", "path"), (2, 1, 2, "../../up", "path"), (3, 1, 3, "react", "path"), (4, 1, 4, "https://x/y", "path"), (5, 3, 1, "shop.core", "module"), (6, 3, 2, "Gone", "module"), (7, 2, 1, "../a.ts?x", "path")], "import_id long, file_id long, line_number int, name string, shape string")
    got = {r.import_id: (r.target_file, r.unresolved) for r in imports.resolved(edges, files).collect()}
    assert got == {1: (2, None), 2: (None, "no such file"), 3: (None, "package"), 4: (None, "external"), 5: (3, None), 6: (None, "nothing declares it"), 7: (1, None)}


def test_stream_equals_batch(spark, tmp_path):
    from millrace.streaming import jobs

    calls = spark.createDataFrame([("p", "grep", BASE + timedelta(seconds=30 * i), 0.1, i % 2 == 0, i) for i in range(8)] + [("p", "grep", BASE + timedelta(hours=3), 0.1, False, 99)], "project string, tool string, called_at timestamp, seconds double, failed boolean, call_id long")
    calls.write.parquet(f"{tmp_path}/in")
    jobs.start_minute_counts(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    final = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = max(r[0] for r in map(tuple, jobs.minute_counts(calls).collect()))
    assert final == {tuple(r) for r in jobs.minute_counts(calls).collect() if r[0] != last}


def test_rope_against_lists():
    """Random edits of a long file; copies stay as they were, and memory goes with runs, not with lines."""
    rng = random.Random(8)
    for block in (2, 128):
        attribution.Rope.BLOCK = block
        lines, rope, kept = [0] * 50, attribution.Rope([(50, 0)]), []
        for commit in range(1, 400):
            edits, at = [], 0
            for _ in range(rng.randrange(1, 4)):
                old = rng.randrange(at, len(lines) + 1)
                gone = rng.randrange(min(9, len(lines) - old) + 1)
                edits.append({"old_line": old, "deleted": gone, "added": rng.randrange(7)})
                at = old + gone
            assert rope.apply(edits, commit)
            for e in reversed(edits):
                lines[e["old_line"] : e["old_line"] + e["deleted"]] = [commit] * e["added"]
            assert len(rope) == len(lines)
            if commit % 50 == 0:
                kept.append((rope.copy(), lines[:]))
        for r, plain in [*kept, (rope, lines)]:
            got = [0] * len(plain)
            for a, b, c in r.runs():
                got[a - 1 : b] = [c] * (b - a + 1)
            assert got == plain
            runs = list(r.runs())
            assert all(x[1] + 1 < y[0] or x[2] != y[2] for x, y in zip(runs, runs[1:], strict=False))
    big = attribution.Rope([(10**9, 1)])
    assert big.apply([{"old_line": 5, "deleted": 10, "added": 10**8}], 2) and len(big.blocks) == 1 and len(big) == 11 * 10**8 - 10


def test_runs_of_known_lines():
    runs = pd.DataFrame([("one", "a", 4, 4, 2), ("one", "a", 1, 2, 1)], columns=["repo_slug", "path", "start_line", "end_line", "commit_id"])
    assert list(attribution.rope_of(runs).runs()) == [(1, 2, 1), (4, 4, 2)]


def test_replay_of_copies_between_families(spark):
    """A file that is copied everywhere is replayed once; copies of copies, copies back, and copies of what was known before."""
    schema = "repo_slug string, commit_id long, path string, old_path string, change_kind string, is_binary boolean, edits array<struct<old_line:int,deleted:int,added:int>>"
    add, copy = lambda c, p, n: ("one", c, p, None, "added", False, [(0, 0, n)]), lambda c, p, o, e=(): ("one", c, p, o, "copied", False, list(e))
    rows = [add(1, "base", 2), *(copy(2 + k, f"c{k}", "base") for k in range(5)), ("one", 8, "base", None, "modified", False, [(1, 1, 1)]), copy(9, "late", "base", [(0, 1, 0)]), copy(10, "again", "c3", [(2, 0, 1)])]
    rows += [add(20, "x", 1), add(20, "y", 2), copy(21, "x2", "y"), ("one", 22, "x", "x2", "renamed", False, []), copy(23, "y2", "x"), ("one", 24, "y", "y2", "renamed", False, [(0, 0, 1)]), copy(30, "of-known", "known", [(1, 0, 1)]), copy(31, "of-nothing", "nothing")]
    known = spark.createDataFrame([("one", "known", 1, 3, 7)], attribution.RUNS)
    runs = attribution.replay(spark.createDataFrame(rows, schema), known.filter("true"))
    got = {}
    for r in attribution.run_lines(attribution.checked(runs)).orderBy("path", "line_number").collect():
        got.setdefault(r.path, []).append(r.commit_id)
    whole = attribution.replay_touched(spark.createDataFrame(rows[-2:], schema), known)
    assert {(r.path, r.start_line, r.end_line, r.commit_id) for r in whole.collect()} == {("known", 1, 3, 7), ("of-known", 1, 1, 7), ("of-known", 2, 2, 30), ("of-known", 3, 4, 7)}
    assert got == {"base": [1, 8], **{f"c{k}": [1, 1] for k in range(5)}, "late": [8], "again": [1, 1, 10], "x": [20, 20], "y": [24, 20, 20], "of-known": [7, 30, 7, 7]}


def test_skip_reasons_of_every_page(spark, tmp_path):
    from millrace import queries

    rows = [(1, "é" * 14_000_000), (2, "é" * 5000), (3, "a\x00b"), (4, None), (5, "plain"), (6, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.skip_reason for r in queries.QUERIES["page_skip_reasons"](spark, str(tmp_path)).collect()}
    assert got == {1: "larger than 25 MiB", 2: None, 3: "binary", 4: None, 5: None, 6: None}


def test_ceiling_of_paths(spark, tmp_path):
    """Commits of 6 to 200 paths link theirs, one of 201 doesn't."""
    from millrace import queries

    assert "<= 200 GROUP" in queries.ORACLES["co_changed"] and "<= 5 GROUP" not in queries.ORACLES["co_changed"]
    assert "<= 200)" in queries.ORACLES["folder_coupling"] and "<= 10)" not in queries.ORACLES["folder_coupling"]
    many = lambda a, b, n: [(M, a, None), *((M, f"{b}/{i}.cs", None) for i in range(n - 1))]
    commits, changes = corpus(spark, [(0, "Ada", many("a/Six.cs", "b", 6)), (1, "Ada", many("a/Full.cs", "b", 200)), (2, "Ada", many("a/Over.cs", "c", 201))])
    anchors = changes.select("repo_slug", "path").filter("path like 'a/%'").distinct()
    got = {}
    for r in history.co_changed(commits, changes, heads(spark, "a/Six.cs"), anchors, None, 365, limit=1000).collect():
        got.setdefault(r.anchor, set()).add(r.path)
    assert {k: len(v) for k, v in got.items()} == {"a/Six.cs": 5, "a/Full.cs": 199}
    rows = {(r.a, r.b): r.together for r in overview.folder_coupling(commits, changes, heads(spark, "a/Six.cs", "b/0.cs"), Scope()).collect()}
    assert rows == {("a", "b"): 2}


def test_folders_below_the_one_that_holds_most(spark):
    """Up to three levels are descended; a folder with one subfolder, or with too few of the files, is not."""
    paths = {"deep": [f"a/b/c/{x}/{y}.cs" for x in "de" for y in range(8)] + ["a/b/x.cs", "a/q/y.cs", "a/b/r/z.cs"], "flat": ["a/x/1.cs", "b/y/2.cs", "3.cs"], "one": ["a/b/1.cs", "a/b/2.cs"], "none": ["1.cs"]}
    files = spark.createDataFrame([(r, p) for r, ps in paths.items() for p in ps], "repo_slug string, path string")
    got = {r.repo_slug: (r.root, r.depth) for r in overview._folder_root(files).collect()}
    assert got == {"deep": ("a/b/c", 3), "flat": ("", 0), "one": ("", 0), "none": ("", 0)}
