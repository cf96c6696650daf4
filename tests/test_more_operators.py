"""Operators that no registered query reaches, and cases that the driver's tables lack."""

from datetime import timedelta

import pytest
from test_operators import BASE, A, D, M, R, corpus, heads

from millrace.functions import patterns
from millrace.operators import attribution, history, imports, language, lineage, overview, search
from millrace.plans.schema import TABLES
from millrace.plans.scope import Scope, parsed, qualified, trimmed
from millrace.sources import ingest, publish
from millrace.streaming import jobs

LINES = "repo_slug string, path string, qualified_path string, extension string, line_number int, content string, commit_id long"
CHANGES = "repo_slug string, commit_id long, path string, old_path string, change_kind string, is_binary boolean, edits array<struct<old_line:int,deleted:int,added:int>>"


def lines_of(spark, **files):
    return spark.createDataFrame([("one", p, f"one/{p}", p.split(".")[-1], i, x, i) for p, text in files.items() for i, x in enumerate(text.split("\n"), 1)], LINES)


def source(spark, path, text):
    return spark.createDataFrame([("one", path, path.split(".")[-1], text.split("\n"))], "repo_slug string, path string, extension string, lines array<string>")


def test_partial_version_is_none(spark, tmp_path):
    one = heads(spark, "a").selectExpr("*", "1L AS file_id", "1 AS line_number")
    root, whole = f"file://{tmp_path}/d", {n: one for n in TABLES if n != "index_info"}
    assert publish.publish(root, {"files": heads(spark, "a")}) == 1
    assert publish.restore(spark, root) is None
    assert publish.publish(root, whole | {"files": heads(spark, "a", "b")}) == 2
    got = publish.restore(spark, root)
    assert got.keys() == set(TABLES) and got["files"].count() == 2 and publish.restore(spark, root, 1) is None and publish.restore(spark, root, 9) is None


def test_carried_history_and_document(spark):
    commits, changes = corpus(spark, [(0, "Ada", [(A, "a.cs", None)]), (1, "Ada", [(M, "a.cs", None)])])
    both = publish.carried({"commits": commits.filter("commit_id = 1")}, {"commits": commits.filter("commit_id = 2"), "commit_files": changes})
    assert both["commits"].count() == 2 and both["commit_files"].count() == 2 and "attribution" not in both
    document = publish.overview_document({"files": heads(spark, "a"), "none": heads(spark, "a").limit(0)}).first().document
    assert document == '{"files":[{"repo_slug":"one","path":"a","line_count":10}],"none":[]}'


def test_pruned_and_rewritten(spark):
    commits, changes = corpus(spark, [(0, "Ada", [(A, "a.cs", None)]), (1, "Ada", [(M, "a.cs", None)])])
    one = spark.createDataFrame([("one",)], "slug string")
    assert [x.count() for x in ingest.pruned(commits, changes, one)] == [2, 2]
    assert [x.count() for x in ingest.pruned(commits, changes, one.limit(0))] == [0, 0]
    assert [x.count() for x in ingest.pruned(commits, changes, one, spark.createDataFrame([("one",)], "repo_slug string"))] == [0, 0]
    export = commits.select("repo_slug", "sha")
    assert ingest.rewritten(export, commits).count() == 0
    assert [r.repo_slug for r in ingest.rewritten(export.limit(1), commits).collect()] == ["one"]


def test_changes_over_the_limit(spark):
    patch = "@@ -1,2 +1,3 @@\n a\n@@ -9 +10,0 @@\n-x"
    rows = [(1, "a", None, M, False, 10, patch), (1, "big", None, M, False, 99, patch), (1, "bin", None, M, True, 5, None), (2, "b", None, D, None, 0, None)]
    got = {r.path: (r.is_binary, len(r.edits), r.added, r.deleted) for r in ingest.change_rows(spark.createDataFrame(rows, "commit_id long, path string, old_path string, change_kind string, is_binary boolean, size_bytes long, patch string"), 50).collect()}
    assert got == {"a": (False, 2, 3, 3), "big": (True, 0, 0, 0), "bin": (True, 0, 0, 0), "b": (False, 0, 0, 0)}


def test_rewritten_history_is_read_anew(spark):
    shape = "repo_slug string, walk_pos int, sha string, author_name string, author_email string, authored_at timestamp, message string"
    known = spark.createDataFrame([(1, "one", "s1"), (2, "one", "s2"), (3, "two", "t1")], "commit_id long, repo_slug string, sha string")
    export = spark.createDataFrame([("one", 0, "n2", "a", "a@x", BASE, "m"), ("one", 1, "s1", "a", "a@x", BASE, "m"), ("two", 0, "t2", "a", "a@x", BASE, "m"), ("two", 1, "t1", "a", "a@x", BASE, "m")], shape)
    kept, fresh = ingest.imported(export, known)
    assert [r.commit_id for r in kept.collect()] == [3]
    assert [(r.commit_id, r.sha) for r in fresh.orderBy("commit_id").collect()] == [(4, "s1"), (5, "n2"), (6, "t2")]


def test_overview_of_a_scope(spark):
    commits, changes = corpus(spark, [(0, "Ada", [(A, "src/a.cs", None), (A, "gen/b.cs", None)]), (1, "Bob", [(M, "gen/b.cs", None)])])
    files = spark.createDataFrame([("one", f"{d}/{n}.cs", "cs", None, 10, 100) for d, n in (("src", "a"), ("gen", "b"))], "repo_slug string, path string, extension string, skip_reason string, line_count long, size_bytes long")
    parts = overview.overview(commits, changes, files, Scope(excluded_paths=["gen/*"]))
    got = {k: v.collect() for k, v in parts.items()}
    assert [r.path for r in got["churn"]] == ["src/a.cs"] and [r.files for r in got["extensions"]] == [1] and [r.author_email for r in got["authors"]] == ["Ada@x"] and got["excluded"][0].head_files == 1
    assert publish.overview_document(parts).count() == 1
    assert [tuple(r) for r in history.author_echo(commits, "nobody").collect()] == [(None, None, 2, 2)]
    assert [tuple(r) for r in history.author_echo(commits, "ADA").collect()] == [("Ada@x", 1, 2, 2)]


def test_names(spark):
    slugs = spark.createDataFrame([("One",)], "slug string")
    asked = spark.createDataFrame([("one/src/A.cs",), ("two/x",)], "name string")
    got = {r.name: (r.repo_slug, r.path) for r in parsed(asked.name, slugs, asked, False).collect()}
    assert got == {"one/src/A.cs": ("One", "src/A.cs"), "two/x": (None, "x")}
    assert {r.repo_slug for r in parsed(asked.name, slugs, asked, True).collect()} == {"One"}
    assert [asked.select(qualified(patterns.F.lit("r"), asked.name, k)).first()[0] for k in (True, False)] == ["one/src/A.cs", "r/one/src/A.cs"]
    files = spark.createDataFrame([("src/A.cs",)], "path string")
    assert [r.path for r in search.diagnose_slug(asked.select(asked.name.alias("request")), files).collect()] == ["src/A.cs"]
    assert trimmed(asked, 1).count() == 2 and trimmed(asked, 2).count() == 2


def test_search_pages_and_budgets(spark):
    lines = lines_of(spark, **{"a.cs": "x1\nx2\ny\nx3", "b.cs": "x1", "c.cs": "z"})
    commits = spark.createDataFrame([(1, "s", "Ada", BASE)], "commit_id long, sha string, author_name string, authored_at timestamp")
    shown = search.grep_lines(lines, search.Grep("x", page_size=0, lines_per_file=-5))  # both are raised to one
    assert [(r.path, r.line_number, r.n) for r in shown.collect()] == [("a.cs", 1, 3)]
    assert search.grep_lines(lines, search.Grep("x", context=99)).count() == 5
    assert {r.line_number: r.author_name for r in search.with_commits(lines.filter("path = 'a.cs'"), commits).collect()} == {1: "Ada", 2: None, 3: None, 4: None}
    docs = search.documents(lines)
    assert [r.path for r in search.grep_multiline(docs, r"x1", count_bytes=1).collect()] == ["a.cs"]
    assert sorted(r.path for r in search.grep_multiline(docs, r"[]x]1").collect()) == ["a.cs", "b.cs"]
    spans = search.match_spans(search.grep_multiline(docs, r"x2\ny\n\p{Ll}"), r"x2\ny\n\p{Ll}")
    assert [tuple(r) for r in spans.collect()] == [("one", "a.cs", 2, 4)]
    windows = spark.createDataFrame([(r, w, "one", "a.cs", -3, 2) for r in (1, 2) for w in (7, 1000)], "request_id int, window_id int, repo_slug string, path string, start_line int, end_line int")
    assert search.read_windows(windows, lines).count() == 8 and search.read_windows(windows, lines, most_windows=1).count() == 4
    assert [tuple(r) for r in search.read_windows(windows, lines, most_lines=3).groupBy("request_id").count().orderBy("request_id").collect()] == [(1, 3), (2, 3)]
    assert search.read_windows(windows, lines, most_chars=5).count() == 4


CODE = """namespace Shop;
public class Order
{
    private const int Most = 5;
    private int count;
    public Order Copy()
    {
        var order = count;
        return order;
    }
    public string Name => "x";
}"""


def test_declarations_and_scopes(spark):
    files = source(spark, "Order.cs", CODE)
    declared = language.declarations(files)
    assert {(r.member, r.opens_scope) for r in declared.filter("member IS NOT NULL").collect()} == {("Most", False), ("count", False), ("Copy", True), ("Name", True)}
    rows = spark.createDataFrame([("one", "Order.cs", n, d) for n, d in ((5, 4), (6, 4), (8, 8), (11, 4), (12, 0))], "repo_slug string, path string, line_number int, indent int")
    assert {r.line_number: r.scope for r in language.enclosing(rows, declared).collect()} == {5: "Order", 6: "Order", 8: "Order.Copy", 11: "Order", 12: None}
    delphi = language.declarations(source(spark, "u.pas", "unit U;\ninterface\ntype\n  TA = class\n    procedure Save;\n  end;\nimplementation\nprocedure TA.Save;\nbegin\n  x := 1;\nend;"))
    got = {(r.line_number, r.type_name, r.member, r.role) for r in delphi.collect()}
    assert {(5, None, "Save", "declaration"), (8, "TA", "Save", "implementation")} <= got
    rows = spark.createDataFrame([("one", "u.pas", 10, 2)], "repo_slug string, path string, line_number int, indent int")
    assert language.enclosing(rows, delphi).first().scope == "TA.Save"
    every = declared.unionByName(delphi)
    assert [(r.path, r.line_number) for r in search.definitions(every, "Save").collect()] == [("u.pas", 8), ("u.pas", 5)]
    assert [r.line_number for r in search.file_declarations(declared, 2, 2).orderBy("line_number").collect()] == [r.line_number for r in declared.orderBy("line_number").collect()][2:4]


def test_declarations_behind_many_lines(spark):
    declared = language.declarations(source(spark, "Big.cs", "//\n" * 25_000 + "public class Late\n{\n}"))
    assert [(r.line_number, r.type_name) for r in declared.collect()] == [(25_001, "Late")]
    states = language.line_states(source(spark, "Big.cs", "a\nb\nc"), bound=2)
    assert [r.state for r in states.orderBy("line_number").collect()] == ["code", "code", "unknown"]


def test_other_languages(spark):
    xsharp = source(spark, "a.prg", '#using System.Text\nusing Shop.Core\n* a whole line of comment CLASS No\n#include "std.ch"\nDEFINE MAX := 5\nCLASS Order\n  METHOD Copy() AS VOID\nEND CLASS')
    assert [(r.name, r.shape) for r in language.imports(xsharp).orderBy("line_number").collect()] == [("System.Text", "module"), ("Shop.Core", "module"), ("std.ch", "path")]
    assert {(r.type_name, r.member, r.opens_scope) for r in language.declarations(xsharp).collect()} == {(None, "MAX", False), ("Order", None, True), (None, "Copy", True)}
    assert [r.state for r in language.line_states(source(spark, "a.html", "<p>\n<!-- a\nb -->\nc")).orderBy("line_number").collect()] == ["code", "code", "comment", "code"]
    page = language.imports(source(spark, "a.html", '<script src="a.js"></script>\n<!-- <script src="b.js"> -->\n<link rel="x" href="c.css">'))
    assert [r.name for r in page.orderBy("line_number").collect()] == ["a.js", "c.css"]
    names = spark.createDataFrame([("a_vo.prg",), ("x/B.g.cs",), ("a.prg",), ("f.designer.prg",)], "path string")
    assert sorted(r.path for r in language.generated(names).collect()) == ["a_vo.prg", "f.designer.prg", "x/B.g.cs"]
    found = lines_of(spark, **{"a.cs": "x", "b.zz": "x", "c.html": "x"})
    assert {(r.language, r.gap, r.files) for r in search.scan_coverage(found, language.profile_table(spark)).collect()} == {("zz", "no profile", 1), ("HTML", "no shapes", 1)}


def test_outgoing_edges(spark):
    files = spark.createDataFrame([(1, "one/a.ts"), (2, "one/b.ts")], "file_id long, qualified_path string")
    edges = spark.createDataFrame([(i, 1, i, 2 if i % 2 else None) for i in range(1, 6)], "import_id long, file_id long, line_number int, target_file long")
    assert [(r.import_id, r.target_path) for r in imports.outgoing(edges, files, 3).orderBy("import_id").collect()] == [(1, "one/b.ts"), (2, None), (3, "one/b.ts")]


def delivery(spark, *rows):
    return spark.createDataFrame([("one", c, p, o, k, False, e) for c, p, o, k, e in rows], CHANGES)


def attributed(runs):
    out = {}
    for r in attribution.run_lines(runs).orderBy("path", "line_number").collect():
        out.setdefault(r.path, []).append(r.commit_id)
    return out


FIRST = ((1, "a", None, A, [(0, 0, 3)]), (2, "b", None, A, [(0, 0, 2)]), (3, "gone", None, A, [(0, 0, 1)]))
SECOND = ((4, "c", "a", R, [(1, 1, 2)]), (5, "gone", None, D, []))


def test_replay_of_what_was_touched(spark):
    known = attribution.replay(delivery(spark, *FIRST))
    assert attributed(attribution.replay_touched(delivery(spark, *SECOND), known)) == {"b": [2, 2], "c": [1, 4, 4, 1]}
    assert attributed(attribution.replay(delivery(spark, *FIRST, *SECOND))) == {"b": [2, 2], "c": [1, 4, 4, 1]}


def test_streams_of_history(spark, tmp_path):
    for i, rows in enumerate((FIRST, SECOND)):
        delivery(spark, *rows).write.mode("append").parquet(f"{tmp_path}/edits")
        stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/edits")
        jobs.append_attribution(stream, f"file://{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
        assert attributed(jobs.current_runs(spark, f"file://{tmp_path}/state")) == ({"a": [1] * 3, "b": [2] * 2, "gone": [3]}, {"b": [2, 2], "c": [1, 4, 4, 1]})[i]
    assert {r.path for r in spark.read.parquet(f"file://{tmp_path}/state/runs").filter("batch = 1").collect()} == {"c"}
    shape = "repo_slug string, walk_pos int, sha string, author_name string, author_email string, authored_at timestamp, message string"
    for n in (2, 4):
        spark.createDataFrame([("one", i, f"s{n - i}", "a", "a@x", BASE, "m") for i in range(n)], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/walks")
        jobs.append_history(spark.readStream.schema(shape).parquet(f"{tmp_path}/walks"), f"file://{tmp_path}/h", f"{tmp_path}/cp2").awaitTermination()
    assert [(r.commit_id, r.sha) for r in spark.read.parquet(f"file://{tmp_path}/h/commits").orderBy("commit_id").collect()] == [(i, f"s{i}") for i in range(1, 5)]


def test_stateful_attribution(spark, tmp_path):
    """Deliveries, one of them twice, and a restart each: the same runs as one replay, with state that no batch reads from what was written."""
    from millrace.streaming import stateful

    third = ((6, "d", "c", "copied", [(0, 0, 1)]), (7, "c", None, M, [(0, 1, 0)]), (8, "b", "d", R, []), (8, "e", None, A, [(0, 0, 2)]), (9, "bin", "e", "copied", []))
    for rows in (FIRST, SECOND, SECOND, third, FIRST):
        delivery(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/edits")
        stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/edits")
        stateful.start_attribution(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        for f in (tmp_path / "edits").glob("*.parquet"):  # what was delivered is gone before the next one
            f.unlink()
    whole = attributed(attribution.replay(delivery(spark, *FIRST, *SECOND, *third)))
    appended = spark.read.parquet(f"{tmp_path}/out")
    assert attributed(stateful.newest_runs(appended)) == whole == {"c": [4, 4, 1], "b": [6, 1, 4, 4, 1], "e": [8, 8], "bin": [8, 8]}
    assert sorted(r.path for r in appended.filter("upto = 4").collect()) == ["a", "c"]


def test_two_hops(spark):
    move = lambda a, b: [(R, f"{b}/{n}.cs", f"{a}/{n}.cs") for n in "xyz"]
    _, changes = corpus(spark, [(0, "a", [(A, f"old/{n}.cs", None) for n in "xyz"]), (1, "a", move("old", "mid")), (2, "a", [(M, "mid/x.cs", None)]), (3, "a", move("mid", "new/deep"))])
    rows = lineage.path_lineage(changes)
    assert {(r.hop, r.previous_path, r.previous_commits, r.combined_commits) for r in rows.filter("path = 'new/deep'").collect()} == {(1, "mid", 2, 4), (2, "old", 1, 4)}
    note = lineage.lineage_note(rows, 1).filter("path = 'new/deep'").first()
    assert (note.previous, note.more, note.combined_commits) == (["mid"], 1, 4)


def test_record_and_churn(spark):
    commits, changes = corpus(spark, [(0, "Ada", [(A, "a.cs", None), (A, "b.cs", None)]), (1, "Ada", [(M, "a.cs", None)])])
    one = history.commit_record(commits, changes, f"{1:040x}").first()
    assert (one.commit_id, one.files, one.added, one.body) == (1, 2, 2, "") and history.commit_record(commits, changes, "none").count() == 0
    assert [r.path for r in overview.overview_churn(commits, changes, heads(spark, "a.cs"), Scope(days=1)).collect()] == ["a.cs", "b.cs"]


def test_suggestions(spark):
    commits, changes = corpus(spark, [(i, "Ada", [(M, "src/version.txt", None), (M, "src/real.cs", None)]) for i in range(12)])
    changes = changes.withColumn("added", patterns.F.when(changes.path == "src/real.cs", 50).otherwise(1).cast("long"))
    got = overview.suggestions(commits, changes, heads(spark, "src/version.txt", "src/real.cs", "gen/A.g.cs", "src/x/y/gen.out"), ["/gen/*"], ["*.g.cs", "src/**/gen.out"])
    assert got == [("/gen/*", "attributes", 1), ("src/**/gen.out", "language", 1), ("version.txt", "history", 1)]
    assert [p for p, *_ in overview.suggestions(commits, changes, heads(spark, "src/version.txt", "gen/A.g.cs"), ["gen/{a,b}", "/gen/*"], existing=["version.txt"])] == ["/gen/*"]


def test_phases_and_depth_first_tree(spark):
    events = spark.createDataFrame([(1, p, BASE + timedelta(seconds=s)) for p, s in (("read", 0), ("build", 3), ("end", 10))], "run int, phase string, at timestamp")
    assert {r.phase: r.seconds for r in overview.phases(events).collect()} == {"read": 3.0, "build": 7.0}
    files = spark.createDataFrame([("one", p, 1, 1) for p in ("b.cs", "a/z.cs", "a/c/q.cs", "a/b.cs", "d/x.cs")], "repo_slug string, path string, line_count long, size_bytes long")
    assert [r.path for r in overview.tree(files, 3).orderBy("sort_key").collect()] == ["a", "a/c", "a/c/q.cs", "a/b.cs", "a/z.cs", "d", "d/x.cs", "b.cs"]
    assert [r.folder for r in overview.top_folders(files, 5).collect()].count(None) <= 1


@pytest.mark.parametrize(("pattern", "path", "expected"), [("a/**/b.cs", "a/b.cs", True), ("/src/**/x.ts", "src/x.ts", True), ("/src/**/x.ts", "src/a/b/x.ts", True), ("/src/**/x.ts", "src/ax.ts", False), ("a/**/b/**/c", "q/a/b/c", True), ("**/b.cs", "a/b.cs", True)])
def test_stars_for_no_folder(spark, pattern, path, expected):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(patterns.excluded(df.path, [pattern])).first()[0] is expected


@pytest.mark.parametrize("pattern", [r"(?P<x>a)(?P=x)", "a++", "a**", "*a", "a)", r"\Z", "(?>a)", "a{1001}", "[[:foo:]]", r"\k<x>"])
def test_refused_dialect(pattern):
    with pytest.raises(patterns.PatternError):
        patterns.check_regex(pattern)


@pytest.mark.parametrize(("pattern", "text", "expected"), [(r"\p{Lu}+", "ab CD", "CD"), (r"b\z", "ab", "b"), ("(?<n>a)b", "xab", "ab"), ("(?P<n_1>a)", "a", "a"), ("[]a]+", "x]a", "]a"), ("[[:digit:]x]+", "a1x", "1x"), (r"\Qa+b", "a+b", "a+b"), (r"\x41\102", "AB", "AB"), (r"[a&&b]+", "&a", "&a"), ("x{", "x{", "x{"), (r"a\v?", "a\x0b", "a\x0b")])
def test_dialect(spark, pattern, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(patterns.F.regexp_extract("s", patterns.check_regex(pattern), 0)).first()[0] == expected


def test_literals_that_every_match_holds():
    want = {"ab[]c]defg": "defg", r"\x41bcd": "bcd", "foo(bar[)]x)bazq": "bazq", "[^]]]abcd": "]abcd", r"\Qa|b": None}
    assert {k: patterns.required_literal(k) for k in want} == want
