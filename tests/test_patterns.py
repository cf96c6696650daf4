import re

import pytest

from millrace.functions import patterns as p


def fits(glob, path):
    return bool(re.search(p.glob_regex(glob), path))


@pytest.mark.parametrize(
    ("glob", "path", "expected"),
    [("*.cs", "a/b.cs", True), ("a?c", "abc", True), ("a?c", "a/c", True), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("a**b", "aXb", True), ("app/[slug]/*", "app/s/page", True), ("a[", "a[", True), ("x", "xy", False), ("*a*b*c", "zaybxc", True), ("*a*b*c", "zcybxa", False)],
)
def test_globs(glob, path, expected):
    assert fits(glob, path) is expected


@pytest.mark.parametrize("glob", ["", "a{b,c}", "dir/", "[z-a]", "[ab", "x" * 257])
def test_refused_globs(glob):
    with pytest.raises(p.PatternError):
        p.check_glob(glob)


def test_many_stars_stay_fast():
    assert not fits("*a" * 12 + "b", "a" * 60)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "a\\"])
def test_refused_patterns(pattern):
    with pytest.raises(p.PatternError):
        p.check_regex(pattern)


def test_groups():
    assert p.check_regex("(a)(b)", 2) == "(a)(b)"
    with pytest.raises(p.PatternError):
        p.check_regex("(a)", 2)


def test_required_literal():
    assert p.required_literal("foo.*barbaz+x") == "barbaz"
    assert p.required_literal("a|b") is None
    assert p.required_literal("ab?c") is None


def test_terms(spark):
    paths = spark.createDataFrame([("src/App.cs",), ("docs/a.md",), ("lib/x.sql",)], "path string")
    kept = lambda c: sorted(r[0] for r in paths.filter(c).collect())
    assert kept(p.any_term(paths.path, "SRC; *.md")) == ["docs/a.md", "src/App.cs"]
    assert kept(p.no_term(paths.path, "docs")) == ["lib/x.sql", "src/App.cs"]
    assert kept(p.has_extension(paths.path, ".cs,*.sql")) == ["lib/x.sql", "src/App.cs"]
    assert kept(p.excluded(paths.path, ["App.cs", "/docs/*"])) == ["docs/a.md", "src/App.cs"]


def test_whole_words(spark):
    text = "Ship Shipping Ship;Ship\nÄnderung Änderungen _id x_id v2"
    df = spark.createDataFrame([(line,) for line in text.split("\n")], "content string")
    count = lambda s: df.select(p.occurrences(df.content, p.symbol_regex(s)).alias("n")).groupBy().sum("n").first()[0]
    assert (count("Ship"), count("Änderung"), count("_id"), count("v2")) == (3, 1, 1, 1)
