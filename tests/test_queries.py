"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"

from millrace import queries  # noqa: E402


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return pd.Timestamp(v).tz_localize(None).isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, other, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        expected = other.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        WITHOUT_SQL[name](got, other)


def page_states(got, other):
    """Every line of every page has a state; what no comment has opened before it is code."""
    lines = "SELECT concat('p', page_id, '.html') AS path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT page_id, string_split(replace(html, chr(13), ''), chr(10)) AS l FROM pages WHERE html <> '')"
    every = dict(other.execute(f"SELECT path, len(l) FROM ({lines}) q WHERE len(l) > 0").fetchall())
    assert got.groupby("path").size().to_dict() == every and len(got) > 0
    plain = {p for (p,) in other.execute("SELECT concat('p', page_id, '.html') FROM pages WHERE NOT contains(html, '<!--')").fetchall()}
    assert set(got.loc[got["path"].isin(plain), "state"]) <= {"code"}
    assert set(got["state"]) <= {"code", "comment"}


def page_names(got, other):
    """Scripts and sheets that the pages name, outside of comments."""
    found = other.execute("""SELECT concat('p', page_id, '.html') AS path, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:script|link)\\b[^>]*?\\s(?:src|href)="([^"]*)"', 1)) AS name FROM pages""".replace("\\\\", "\\")).fetchall()
    assert sorted(zip(got["path"], got["name"], strict=True)) == sorted(found)


def page_edges(got, other):
    """Every link of every page is an edge, and leads to a page of the same name or says why not."""
    assert len(got) == other.execute("SELECT coalesce(sum(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), 0) FROM pages").fetchone()[0]
    external = got["name"].str.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:|//")
    assert set(got.loc[external, "unresolved"]) <= {"external"}
    assert got.loc[got["target_file"].isna(), "unresolved"].notna().all()


WITHOUT_SQL = {"line_states": page_states, "page_imports": page_names, "resolved_page_links": page_edges}
