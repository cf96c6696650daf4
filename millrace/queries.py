"""Registered queries over the driver's tables seen as a corpus, each with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import patterns
from millrace.operators import attribution, history, imports, language, lineage, overview, search
from millrace.plans import corpus
from millrace.plans.scope import FileFilter, Scope, commit_scope, seconds
from millrace.plans.tables import discard
from millrace.sources import ingest
from millrace.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEAR = Scope(days=365)
EXCLUDED = ["ECONOMY*/*", "*.sql", "**/Brand#1?/*"]


def _views(body: str) -> str:
    """The SQL with the views that it names before it."""
    over_text, over_history = "text_lines" in body or "named" in body, "scoped" in body or "folders a" in body
    views = [n for n in corpus.VIEWS if n in body or (n == "text_files" and over_text) or (n in ("commits", "commit_files") and over_history)]
    ctes = [f"{n} AS ({corpus.sql(n)})" for n in views]
    if over_text:
        ctes.append("""text_lines AS (SELECT * EXCLUDE (ls), unnest(ls) AS content, generate_subscripts(ls, 1) AS line_number FROM (
            SELECT file_id, repo_slug, path, qualified_path, extension, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls
            FROM (SELECT *, string_split(replace(content, chr(13), ''), chr(10)) AS l FROM text_files)))""")
    if "named" in body:
        # Matches that share a boundary: doubling every separator gives each its own.
        ctes.append(r"""named AS (SELECT *, len(regexp_extract_all(regexp_replace(content, '([^\p{L}\p{Nd}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{Nd}_])the(?:$|[^\p{L}\p{Nd}_])')) AS occurrences
            FROM text_lines WHERE contains(content, 'the') AND regexp_matches(content, '(?:^|[^\p{L}\p{Nd}_])the(?:$|[^\p{L}\p{Nd}_])'))""")
    if over_history:
        ctes.append("""scoped AS (SELECT c.commit_id, c.repo_slug, c.author_email, c.author_name, c.authored_at, f.path, f.added, f.deleted, f.change_kind, f.old_path
            FROM commits c JOIN commit_files f ON f.commit_id = c.commit_id
            WHERE floor(epoch(c.authored_at)) >= (SELECT max(floor(epoch(authored_at))) FROM commits) - 365 * 86400)""")
    if "folders a" in body:
        ctes.append("""changed AS (SELECT DISTINCT repo_slug, commit_id, split_part(path, '/', 1) AS folder FROM scoped WHERE commit_id IN (SELECT commit_id FROM scoped GROUP BY 1 HAVING count(*) <= 200))""")
        ctes.append("""kept AS (SELECT repo_slug, folder, commits FROM (SELECT repo_slug, folder, count(*) AS commits, row_number() OVER (PARTITION BY repo_slug ORDER BY count(*) DESC, folder) AS rank FROM changed GROUP BY 1, 2) WHERE rank <= 12)""")
        ctes.append("folders AS (SELECT r.*, k.commits FROM changed r JOIN kept k ON k.repo_slug = r.repo_slug AND k.folder = r.folder)")
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = _views(oracle)
        return f

    return register


def _v(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    own = corpus.sized(spark, d, *names)
    return [corpus.view(own, d, n) for n in names]


@query("""SELECT t.*, EXISTS (SELECT 1 FROM files h WHERE h.repo_slug = t.repo_slug AND h.path = t.path) AS at_head FROM (
    SELECT repo_slug, path, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM scoped GROUP BY 1, 2
    ORDER BY commits DESC, sum(added) + sum(deleted) DESC, path, repo_slug LIMIT 50) t""")
def hot_files(spark, d):
    return history.hot_files(*_v(spark, d, "commits", "commit_files", "files"), YEAR, 50)


@query("""SELECT t.*, EXISTS (SELECT 1 FROM files h WHERE h.repo_slug = t.repo_slug AND starts_with(h.path, t.directory || '/')) AS at_head FROM (
    SELECT repo_slug, array_to_string(list_slice(string_split(path, '/'), 1, least(len(string_split(path, '/')) - 1, 2)), '/') AS directory,
           count(DISTINCT commit_id) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM scoped GROUP BY 1, 2
    ORDER BY commits DESC, sum(added) + sum(deleted) DESC, directory, repo_slug LIMIT 50) t""")
def hot_directories(spark, d):
    return history.hot_directories(*_v(spark, d, "commits", "commit_files", "files"), YEAR, 2, 50)


_EXCLUDED_SQL = "(starts_with(path, 'ECONOMY') OR ends_with(path, '.sql') OR regexp_matches(path, '(^|/)Brand#1./'))"


@query(f"SELECT count(DISTINCT (repo_slug, path)) AS hidden FROM scoped WHERE {_EXCLUDED_SQL} OR NOT ends_with(path, '.cs')")
def hidden_paths(spark, d):
    return history.hidden_paths(*_v(spark, d, "commits", "commit_files"), Scope(365, include="*.cs", excluded_paths=EXCLUDED))


@query("""SELECT CASE WHEN contains(split_part(path, '/', -1), '.') THEN lower(split_part(split_part(path, '/', -1), '.', -1)) ELSE '' END AS extension,
    count(DISTINCT commit_id) AS commits, count(DISTINCT (repo_slug, path)) AS paths FROM scoped GROUP BY 1""")
def churned_extensions(spark, d):
    return history.churned_extensions(*_v(spark, d, "commits", "commit_files"), Scope(365, include="cs"))


@query("""SELECT r.repo_slug, r.path, CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.repo_slug = r.repo_slug AND (f.path = r.path OR starts_with(f.path, r.path || '/'))) THEN 'live'
    WHEN EXISTS (SELECT 1 FROM commit_files f WHERE f.repo_slug = r.repo_slug AND (f.path = r.path OR starts_with(f.path, r.path || '/'))) THEN 'history' ELSE 'unknown' END AS state,
    NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_slug = r.repo_slug AND f.path = r.path) AND (EXISTS (SELECT 1 FROM files f WHERE f.repo_slug = r.repo_slug AND starts_with(f.path, r.path || '/'))
      OR EXISTS (SELECT 1 FROM commit_files f WHERE f.repo_slug = r.repo_slug AND starts_with(f.path, r.path || '/'))) AS is_directory
    FROM (SELECT DISTINCT repo_slug, p_type AS path FROM part, (SELECT DISTINCT repo_slug FROM commits) UNION SELECT DISTINCT repo_slug, old_path FROM commit_files WHERE old_path IS NOT NULL AND commit_id % 50 = 0
      UNION SELECT DISTINCT repo_slug, path FROM commit_files WHERE commit_id % 50 = 0) r""")
def directory_states(spark, d):
    commits, changes, files = _v(spark, d, "commits", "commit_files", "files")
    kinds = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("path")).distinct()
    some = changes.filter("commit_id % 50 = 0")  # the requests
    requests = commits.select("repo_slug").distinct().join(kinds, F.lit(True)).unionByName(some.select("repo_slug", F.col("old_path").alias("path")).filter("path IS NOT NULL")).unionByName(some.select("repo_slug", "path")).distinct()
    return history.directory_states(requests, changes, files)


@query("SELECT commit_id, repo_slug, sha, author_name, author_email, authored_at, subject FROM commits WHERE repo_slug = 'o' AND contains(author_email, '1') AND contains(lower(subject), 'high') ORDER BY commit_id DESC LIMIT 50 OFFSET 50")
def log_page(spark, d):
    (commits,) = _v(spark, d, "commits")
    return history.log_page(commit_scope(commits, repo="o", author="1", subject="HIGH"), 50, 2)


@query("""SELECT t.*, (SELECT count(DISTINCT author_email) FROM commits) AS total_authors, (SELECT count(*) FROM commits) AS total_commits FROM (
    SELECT author_email, arg_max(author_name, commit_id) AS author_name, count(*) AS commits, max(authored_at) AS last_at FROM commits GROUP BY 1 ORDER BY commits DESC, author_email LIMIT 200) t""")
def authors(spark, d):
    return history.authors(*_v(spark, d, "commits"))


@query("""SELECT t.author_email, t.commits, w.total_authors, w.total_commits FROM (SELECT count(DISTINCT author_email) AS total_authors, count(*) AS total_commits FROM commits) w
    LEFT JOIN (SELECT author_email, count(*) AS commits FROM commits WHERE contains(author_email, '7@') GROUP BY 1 ORDER BY commits DESC, author_email LIMIT 20) t ON true""")
def author_echo(spark, d):
    return history.author_echo(*_v(spark, d, "commits"), "7@X")


@query("""SELECT c.commit_id, c.repo_slug, c.sha, c.author_name, c.author_email, c.authored_at, c.subject, coalesce(n, 0) AS files, coalesce(a, 0) AS added, coalesce(x, 0) AS deleted
    FROM (SELECT * FROM commits ORDER BY commit_id DESC LIMIT 100) c LEFT JOIN (SELECT commit_id, count(*) AS n, sum(added)::BIGINT AS a, sum(deleted)::BIGINT AS x FROM commit_files GROUP BY 1) f ON f.commit_id = c.commit_id""")
def change_log(spark, d):
    return history.change_log(*_v(spark, d, "commits", "commit_files"), 100)


@query("""SELECT p AS prefix, count(DISTINCT sha) AS matches, CASE WHEN count(DISTINCT sha) = 1 THEN min(commit_id) END AS commit_id, array_to_string(list_slice(list_sort(list(DISTINCT sha)), 1, 4), ',') AS candidates
    FROM (SELECT DISTINCT substr(sha, 1, 5) AS p FROM commits) r JOIN commits ON starts_with(sha, p) GROUP BY 1""")
def commits_by_prefix(spark, d):
    (commits,) = _v(spark, d, "commits")
    out = history.commits_by_prefix(commits.select(F.substring("sha", 1, 5).alias("prefix")).distinct(), commits)
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query("""SELECT f.commit_id, f.repo_slug, f.path, f.change_kind, f.added, f.deleted, f.old_path, h.path IS NOT NULL AS at_head FROM commit_files f
    LEFT JOIN (SELECT DISTINCT repo_slug, path FROM files) h ON h.repo_slug = f.repo_slug AND h.path = f.path""")
def commit_paths(spark, d):
    commits, changes, files = _v(spark, d, "commits", "commit_files", "files")
    return history.commit_paths(changes, files, commits.select("commit_id"))


@query("""SELECT repo_slug, path, rank, commit_id, sha, author_email, change_kind, added, deleted FROM (SELECT f.*, c.sha, c.author_email, row_number() OVER (PARTITION BY f.repo_slug, f.path ORDER BY f.commit_id DESC) AS rank
    FROM commit_files f JOIN commits c ON c.commit_id = f.commit_id) WHERE rank <= 5""")
def file_history(spark, d):
    commits, changes = _v(spark, d, "commits", "commit_files")
    return history.file_history(commits, changes, changes.select("repo_slug", "path").distinct(), 5)


@query("""SELECT path, sha, min(line_number) AS start_line, max(line_number) AS end_line FROM (SELECT *, line_number - row_number() OVER (PARTITION BY path, sha ORDER BY line_number) AS island FROM line_commits)
    GROUP BY path, sha, island""")
def blame_runs(spark, d):
    return history.blame_runs(*_v(spark, d, "line_commits"))


@query("""SELECT f.repo_slug, f.path, f.first_commit, a.author_email AS first_author, f.last_commit, b.author_email AS last_author FROM (SELECT repo_slug, path, min(commit_id) AS first_commit, max(commit_id) AS last_commit
    FROM commit_files GROUP BY 1, 2) f JOIN commits a ON a.commit_id = f.first_commit JOIN commits b ON b.commit_id = f.last_commit""")
def file_ends(spark, d):
    return history.file_ends(*_v(spark, d, "commits", "commit_files"))


@query("""SELECT t.repo_slug, t.anchor, t.path, t.together, t.rank, t.commits, t.paired, EXISTS (SELECT 1 FROM files h WHERE h.repo_slug = t.repo_slug AND h.path = t.path) AS at_head FROM (
    SELECT a.repo_slug, a.path AS anchor, b.path, count(DISTINCT a.commit_id) AS together, row_number() OVER (PARTITION BY a.repo_slug, a.path ORDER BY count(DISTINCT a.commit_id) DESC, b.path) AS rank,
           any_value(n.commits) AS commits, any_value(n.paired) AS paired
    FROM scoped a JOIN scoped b ON a.commit_id = b.commit_id AND a.path <> b.path AND NOT (a.change_kind = 'renamed' AND b.change_kind = 'renamed')
    JOIN (SELECT x.repo_slug, x.path, count(DISTINCT x.commit_id) AS commits, count(DISTINCT CASE WHEN y.path IS NOT NULL THEN x.commit_id END) AS paired FROM scoped x
          LEFT JOIN scoped y ON x.commit_id = y.commit_id AND x.path <> y.path AND NOT (x.change_kind = 'renamed' AND y.change_kind = 'renamed')
          WHERE (SELECT count(*) FROM commit_files z WHERE z.commit_id = x.commit_id) <= 200 GROUP BY 1, 2) n ON n.repo_slug = a.repo_slug AND n.path = a.path
    WHERE (SELECT count(*) FROM commit_files z WHERE z.commit_id = a.commit_id) <= 200 GROUP BY 1, 2, 3) t WHERE t.rank <= 10""")
def co_changed(spark, d):
    commits, changes, files = corpus.history(corpus.sized(spark, d, "commit_files"), d)
    return history.co_changed(commits, changes, files, changes.select("repo_slug", "path").distinct(), None, 365, limit=10)


def co_changed_ceiling(spark, d):
    """``co_changed`` with a ceiling that leaves commits out."""
    commits, changes, files = corpus.history(corpus.sized(spark, d, "commit_files"), d)
    return history.co_changed(commits, changes, files, changes.select("repo_slug", "path").distinct(), None, 365, 5, 10)


QUERIES["co_changed_ceiling"] = co_changed_ceiling
ORACLES["co_changed_ceiling"] = ORACLES["co_changed"].replace("<= 200 GROUP", "<= 5 GROUP")


@query("SELECT f.repo_slug, f.path, count(DISTINCT f.commit_id) AS commits, max(c.authored_at) AS newest_at FROM commit_files f JOIN commits c ON c.commit_id = f.commit_id GROUP BY 1, 2")
def recorded_history(spark, d):
    commits, changes = _v(spark, d, "commits", "commit_files")
    return history.recorded(commits, changes, changes.select("repo_slug", "path").distinct())


@query("SELECT DISTINCT f.repo_slug, EXISTS (SELECT 1 FROM commits c WHERE c.repo_slug = f.repo_slug) AS has_history FROM files f")
def history_coverage(spark, d):
    files, commits = _v(spark, d, "files", "commits")
    return history.coverage(files, commits)


@query("""SELECT repo_slug, count(*) AS commits, arg_max(sha, commit_id) AS sha, arg_max(author_name, commit_id) AS author_name, arg_max(subject, commit_id) AS subject, floor(epoch(min(authored_at)))::BIGINT AS first_second,
    floor(epoch(max(authored_at)))::BIGINT AS last_second FROM commits WHERE repo_slug IN (SELECT repo_slug FROM files) GROUP BY 1""")
def repository_status(spark, d):
    files, commits = _v(spark, d, "files", "commits")
    return history.repository_status(files, commits)


_HOPS_SQL = """deep AS (SELECT repo_slug, commit_id, path, array_to_string(n[:len(n) - k], '/') AS directory, array_to_string(o[:len(o) - k], '/') AS previous
      FROM (SELECT *, string_split(path, '/') AS n, string_split(old_path, '/') AS o FROM commit_files WHERE change_kind = 'renamed') r, (SELECT unnest(range(1, 20)) AS k) ks
      WHERE k < len(n) AND k < len(o) AND n[len(n) - k + 1:] = o[len(o) - k + 1:]),
    whole AS (SELECT repo_slug, array_to_string(p[:k], '/') AS directory, count(DISTINCT path) AS paths FROM (SELECT DISTINCT repo_slug, path, string_split(path, '/') AS p FROM commit_files) q, (SELECT unnest(range(1, 20)) AS k) ks
      WHERE k < len(p) GROUP BY 1, 2),
    hops AS (SELECT repo_slug, directory AS path, previous AS previous_path FROM (SELECT d.*, row_number() OVER (PARTITION BY d.repo_slug, d.directory ORDER BY moved DESC, newest DESC, previous) AS rank
      FROM (SELECT repo_slug, directory, previous, count(DISTINCT path) AS moved, max(commit_id) AS newest FROM deep WHERE directory <> previous AND NOT starts_with(directory, previous || '/') AND NOT starts_with(previous, directory || '/')
            GROUP BY 1, 2, 3) d JOIN whole w ON w.repo_slug = d.repo_slug AND w.directory = d.directory WHERE 2 * moved > paths) WHERE rank = 1)"""


@query()
def path_lineage(spark, d):
    changes = corpus.paths(spark, d)
    out = lineage.path_lineage(_moved(changes))
    discard(changes)  # counted by now
    return out


def _moved(changes: DataFrame) -> DataFrame:
    """The driver's tables rename too few files of a directory: here every first change of a path is a rename."""
    return changes.withColumns({"change_kind": F.lit("renamed"), "old_path": F.concat(F.lit("legacy/"), F.col("path"))})


ORACLES["path_lineage"] = (
    f"WITH commit_files AS (SELECT * REPLACE ('renamed' AS change_kind, 'legacy/' || path AS old_path) FROM ({corpus.sql('commit_files')})), {_HOPS_SQL}, "
    """below AS (SELECT DISTINCT repo_slug, array_to_string(p[:k], '/') AS directory, commit_id FROM (SELECT *, string_split(path, '/') AS p FROM commit_files) q, (SELECT unnest(range(1, 20)) AS k) ks WHERE k < len(p)),
    chains AS (SELECT repo_slug, path, 1 AS hop, previous_path FROM hops)
    SELECT c.repo_slug, c.path, c.hop, c.previous_path, (SELECT count(*) FROM below b WHERE b.repo_slug = c.repo_slug AND b.directory = c.previous_path) AS previous_commits,
           (SELECT count(DISTINCT commit_id) FROM below b WHERE b.repo_slug = c.repo_slug AND b.directory IN (c.path, c.previous_path)) AS combined_commits FROM chains c"""
)


@query()
def path_lineage_hops(spark, d):
    """Chains of two hops: every path was renamed twice."""
    changes = corpus.paths(spark, d)
    before = lambda a, b: changes.withColumns({"change_kind": F.lit("renamed"), "path": F.concat(F.lit(b), F.col("path")), "old_path": F.concat(F.lit(a), F.col("path"))})
    out = lineage.path_lineage(before("older/", "legacy/").unionByName(before("legacy/", "")))
    discard(changes)  # counted by now
    return out


ORACLES["path_lineage_hops"] = (
    f"WITH raw AS ({corpus.sql('commit_files')}), commit_files AS (SELECT * REPLACE ('renamed' AS change_kind, 'older/' || path AS old_path, 'legacy/' || path AS path) FROM raw UNION ALL SELECT * REPLACE ('renamed' AS change_kind, 'legacy/' || path AS old_path) FROM raw), {_HOPS_SQL}, "
    """below AS (SELECT DISTINCT repo_slug, array_to_string(p[:k], '/') AS directory, commit_id FROM (SELECT *, string_split(path, '/') AS p FROM commit_files) q, (SELECT unnest(range(1, 20)) AS k) ks WHERE k < len(p)),
    chains AS (SELECT repo_slug, path, 1 AS hop, previous_path FROM hops UNION ALL SELECT h.repo_slug, h.path, 2, g.previous_path FROM hops h JOIN hops g ON g.repo_slug = h.repo_slug AND g.path = h.previous_path AND g.previous_path <> h.path),
    named AS (SELECT repo_slug, path, path AS directory FROM hops UNION SELECT repo_slug, path, previous_path FROM chains),
    whole_chain AS (SELECT n.repo_slug, n.path, count(DISTINCT b.commit_id) AS combined_commits FROM named n JOIN below b ON b.repo_slug = n.repo_slug AND b.directory = n.directory GROUP BY 1, 2)
    SELECT c.repo_slug, c.path, c.hop, c.previous_path, (SELECT count(*) FROM below b WHERE b.repo_slug = c.repo_slug AND b.directory = c.previous_path) AS previous_commits, w.combined_commits
    FROM chains c JOIN whole_chain w ON w.repo_slug = c.repo_slug AND w.path = c.path"""
)


@query("SELECT extension, count(*) AS files, sum(line_count)::BIGINT AS lines, count(skip_reason) AS skipped FROM files GROUP BY 1")
def extension_counts(spark, d):
    return overview.extension_counts(*_v(spark, d, "files"))


@query("SELECT CASE extension WHEN 'cs' THEN 'C#' WHEN 'ts' THEN 'TypeScript' WHEN 'sql' THEN 'SQL' ELSE extension END AS language, count(*) AS files, sum(line_count)::BIGINT AS lines FROM files GROUP BY 1")
def language_shares(spark, d):
    return overview.language_shares(*_v(spark, d, "files"))


@query("""SELECT repo_slug, folder, files, lines, bytes, greatest(folders - 20, 0) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY files DESC, folder) AS rank, count(*) OVER (PARTITION BY repo_slug) AS folders
    FROM (SELECT repo_slug, split_part(path, '/', 1) AS folder, count(*) AS files, sum(line_count)::BIGINT AS lines, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1, 2)) WHERE rank <= 20""")
def top_folders(spark, d):
    return overview.top_folders(*_v(spark, d, "files"), 20)


@query("SELECT repo_slug, path, size_bytes, line_count FROM files WHERE skip_reason IS NULL ORDER BY size_bytes DESC, path, repo_slug LIMIT 10")
def largest_files(spark, d):
    return overview.largest_files(*_v(spark, d, "files"))


@query(f"""SELECT author_email, arg_max(author_name, commit_id) AS author_name, count(*) AS commits FROM commits c WHERE NOT EXISTS (SELECT 1 FROM commit_files f WHERE f.commit_id = c.commit_id)
    OR EXISTS (SELECT 1 FROM commit_files f WHERE f.commit_id = c.commit_id AND NOT {_EXCLUDED_SQL}) GROUP BY 1 ORDER BY commits DESC, author_email LIMIT 10""")
def section_authors(spark, d):
    return overview.section_authors(*_v(spark, d, "commits", "commit_files"), Scope(None, excluded_paths=EXCLUDED))


@query(f"""SELECT (SELECT count(DISTINCT (repo_slug, path)) FROM files WHERE {_EXCLUDED_SQL}) AS head_files, (SELECT count(DISTINCT (repo_slug, path)) FROM scoped WHERE {_EXCLUDED_SQL}) AS churn_paths,
    (SELECT count(DISTINCT (repo_slug, path)) FROM commit_files WHERE {_EXCLUDED_SQL}) AS committed_paths""")
def excluded_counts(spark, d):
    return overview.excluded_counts(*corpus.history(corpus.sized(spark, d, "commit_files"), d), Scope(365, excluded_paths=EXCLUDED))


@query("""SELECT s.repo_slug, s.path, count(*) AS commits, sum(added + deleted)::BIGINT AS changed, any_value(f.line_count) AS line_count, count(*) * any_value(f.line_count) AS score FROM scoped s
    JOIN files f ON f.repo_slug = s.repo_slug AND f.path = s.path AND f.skip_reason IS NULL AND f.line_count > 0 GROUP BY 1, 2 ORDER BY score DESC, changed DESC, path, repo_slug LIMIT 10""")
def hotspots(spark, d):
    return overview.hotspots(*_v(spark, d, "commits", "commit_files", "files"), YEAR)


@query("""SELECT repo_slug, path, authors, commits, ns[1] / commits AS share1, coalesce(ns[2], 0) / commits AS share2, coalesce(ns[3], 0) / commits AS share3 FROM (
    SELECT repo_slug, path, count(*) AS authors, sum(n)::BIGINT AS commits, list(n ORDER BY n DESC) AS ns FROM (SELECT repo_slug, path, author_email, count(*) AS n FROM scoped GROUP BY 1, 2, 3) e
    WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo_slug = e.repo_slug AND f.path = e.path) GROUP BY 1, 2 ORDER BY authors DESC, commits DESC, path, repo_slug LIMIT 10)""")
def authors_per_file(spark, d):
    return overview.authors_per_file(*_v(spark, d, "commits", "commit_files", "files"), YEAR)


@query("""SELECT a.repo_slug, a.folder AS a, b.folder AS b, any_value(a.commits) AS commits_a, any_value(b.commits) AS commits_b, count(*) AS together FROM folders a JOIN folders b ON a.commit_id = b.commit_id AND a.repo_slug = b.repo_slug
    AND a.folder < b.folder GROUP BY 1, 2, 3""")
def folder_coupling(spark, d):
    return overview.folder_coupling(*_v(spark, d, "commits", "commit_files", "files"), YEAR)


def folder_coupling_ceiling(spark, d):
    """``folder_coupling`` with a ceiling that leaves commits out."""
    return overview.folder_coupling(*_v(spark, d, "commits", "commit_files", "files"), YEAR, ceiling=10)


QUERIES["folder_coupling_ceiling"] = folder_coupling_ceiling
ORACLES["folder_coupling_ceiling"] = ORACLES["folder_coupling"].replace("count(*) <= 200)", "count(*) <= 10)")


@query("""SELECT floor(epoch(p))::BIGINT AS period_second, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(renamed, 0) AS renamed
    FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT max(authored_at) FROM commits) - INTERVAL 365 DAY)::TIMESTAMP, date_trunc('month', (SELECT max(authored_at) FROM commits))::TIMESTAMP, INTERVAL 1 MONTH)) AS p)
    LEFT JOIN (SELECT date_trunc('month', authored_at)::TIMESTAMP AS m, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'deleted') AS deleted, count(*) FILTER (change_kind = 'renamed') AS renamed
    FROM scoped GROUP BY 1) ON m = p""")
def changes_over_time(spark, d):
    return overview.changes_over_time(*_v(spark, d, "commits", "commit_files"), YEAR)


@query("""SELECT repo_slug, array_to_string(string_split(path, '/')[:k], '/') AS path, count(*) AS files, sum(line_count)::BIGINT AS lines, sum(size_bytes)::BIGINT AS bytes, true AS is_directory
    FROM files, (SELECT unnest([1, 2]) AS k) WHERE k < len(string_split(path, '/')) GROUP BY 1, 2""")
def tree(spark, d):
    return overview.tree(*_v(spark, d, "files"), 2).drop("sort_key")


@query("SELECT repo_slug, count(*) AS files, sum(line_count)::BIGINT AS lines, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def repository_level(spark, d):
    return overview.repository_level(*_v(spark, d, "files"))


@query("""SELECT project, tool, count(*) AS calls, count(*) FILTER (failed) AS failed, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95, max(seconds) AS max, floor(epoch(max(called_at)))::BIGINT AS last_second
    FROM (SELECT *, row_number() OVER (PARTITION BY project, tool ORDER BY called_at DESC, call_id DESC) AS rank FROM calls) WHERE rank <= 100 GROUP BY 1, 2""")
def call_statistics(spark, d):
    return overview.call_statistics(*_v(spark, d, "calls"))


@query("SELECT project, quantile_disc(seconds, 0.95) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY called_at DESC, call_id DESC) AS rank FROM calls) WHERE rank <= 200 GROUP BY 1")
def project_p95(spark, d):
    return overview.project_p95(*_v(spark, d, "calls"))


@query("""SELECT m AS minute, count(call_id) AS calls, coalesce(count(*) FILTER (failed), 0) AS failed FROM (SELECT unnest(range(e - 59, e + 1)) AS m FROM (SELECT floor(epoch(max(called_at)) / 60)::BIGINT AS e FROM calls))
    LEFT JOIN calls ON floor(epoch(called_at) / 60)::BIGINT = m GROUP BY 1""")
def calls_per_minute(spark, d):
    return overview.calls_per_minute(*_v(spark, d, "calls"))


@query("SELECT floor(epoch(called_at) / 60)::BIGINT AS minute, project, tool, count(*) AS calls, count(*) FILTER (failed) AS failed FROM calls GROUP BY 1, 2, 3")
def stream_minutes(spark, d):
    """The stream's plan over a bounded input; ``tests`` run it as a stream."""
    return jobs.minute_counts(*_v(spark, d, "calls"))


@query("""SELECT h.repo_slug, h.path, n, h.line_number, content, true AS is_match FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug, path ORDER BY line_number) AS rank FROM text_lines WHERE contains(lower(content), 'the') AND contains(lower(content), 'tion')) h
    JOIN (SELECT repo_slug, path, count(*) AS n FROM text_lines WHERE contains(lower(content), 'the') AND contains(lower(content), 'tion') GROUP BY 1, 2 ORDER BY n DESC, path, repo_slug LIMIT 20) p ON p.repo_slug = h.repo_slug AND p.path = h.path WHERE rank <= 5""")
def grep_text(spark, d):
    return search.grep_lines(corpus.lines(spark, d), search.Grep("the TION", lines_per_file=5))


@query("""SELECT count(DISTINCT (repo_slug, path)) AS files, count(*) AS lines FROM text_lines WHERE contains(lower(content), 'and') AND regexp_matches(lower(content), '(?:^|[^a-z0-9_])and(?:$|[^a-z0-9_])')""")
def grep_tokens(spark, d):
    return search.totals(search.hits(corpus.lines(spark, d), search.Grep("and", whole_tokens=True)))


@query("""SELECT l.repo_slug, l.path, n, l.line_number, l.content, bool_or(l.line_number = s.line_number) AS is_match FROM (
      SELECT h.repo_slug, h.path, n, h.line_number FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug, path ORDER BY line_number) AS rank FROM text_lines WHERE regexp_matches(content, '[0-9]{4}')) h
      JOIN (SELECT repo_slug, path, count(*) AS n FROM text_lines WHERE regexp_matches(content, '[0-9]{4}') GROUP BY 1, 2 ORDER BY n DESC, path, repo_slug LIMIT 20) p ON p.repo_slug = h.repo_slug AND p.path = h.path WHERE rank <= 20) s
    JOIN text_lines l ON l.repo_slug = s.repo_slug AND l.path = s.path AND abs(l.line_number - s.line_number) <= 2 GROUP BY 1, 2, 3, 4, 5""")
def grep_regex_context(spark, d):
    return search.grep_lines(corpus.lines(spark, d), search.Grep("[0-9]{4}", regex=True, context=2))


@query("""SELECT count(DISTINCT CASE WHEN repo_slug = 'src1' AND contains(lower(qualified_path), 'en/') THEN (repo_slug, path) END) AS files, count(DISTINCT (repo_slug, path)) AS all_files, count(*) AS all_lines FROM text_lines WHERE regexp_matches(content, '(?i)license')""")
def grep_recount(spark, d):
    return search.recount(corpus.lines(spark, d), search.Grep("license", regex=True, filter=FileFilter(repo="src1", paths="en/")))


_SENTENCE = r"\.\nThe[^\n]*\n"


@query(r"""SELECT repo_slug, path, len(regexp_extract_all(content, '(?s)\.\nThe[^\n]*\n')) AS n, content FROM (SELECT repo_slug, path, string_agg(content, chr(10) ORDER BY line_number) AS content FROM text_lines GROUP BY 1, 2)
    WHERE regexp_matches(content, '(?s)\.\nThe[^\n]*\n')""")
def grep_multiline(spark, d):
    return search.grep_multiline(search.whole_documents(*_v(spark, d, "text_files")), _SENTENCE)


#: A line is a match's first if it ends in a full stop and the next one begins with "The" and is not the last; matches don't overlap, so of a chain every second one counts.
_SPANS = """spans AS (SELECT repo_slug, path, first_line FROM (
    SELECT repo_slug, path, line_number AS first_line, line_number - min(line_number) OVER (PARTITION BY repo_slug, path, island) AS nth FROM (
        SELECT *, line_number - row_number() OVER (PARTITION BY repo_slug, path ORDER BY line_number) AS island FROM (
            SELECT *, lead(content) OVER w AS following, max(line_number) OVER (PARTITION BY repo_slug, path) AS last FROM text_lines WINDOW w AS (PARTITION BY repo_slug, path ORDER BY line_number)) a
        WHERE ends_with(content, '.') AND starts_with(following, 'The') AND line_number + 1 < last) b) c WHERE nth % 2 = 0)"""


@query(f"""SELECT repo_slug, path, first_line::INT AS first_line, (first_line + 1)::INT AS last_line FROM (WITH {_SPANS} SELECT * FROM spans) s""")
def match_spans(spark, d):
    return search.match_spans(search.grep_multiline(search.whole_documents(*_v(spark, d, "text_files")), _SENTENCE), _SENTENCE)


@query(f"""SELECT p.place, l.repo_slug, l.path, p.n, l.line_number, l.content FROM (WITH {_SPANS},
        ranked AS (SELECT repo_slug, path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, path, repo_slug) AS place FROM spans GROUP BY 1, 2)
        SELECT r.place, r.n, s.repo_slug, s.path, unnest([first_line, first_line + 1]) AS line_number FROM ranked r JOIN spans s ON s.repo_slug = r.repo_slug AND s.path = r.path WHERE r.place <= 20) p
    JOIN text_lines l ON l.repo_slug = p.repo_slug AND l.path = p.path AND l.line_number = p.line_number""")
def multiline_page(spark, d):
    """The lines of the first page's matches; the page's files stay below the budget."""
    found = search.grep_multiline(search.whole_documents(*_v(spark, d, "text_files")), _SENTENCE)
    return search.multiline_page(found, _SENTENCE, search.Grep(_SENTENCE, regex=True, ignore_case=False))


@query("""SELECT value, count(*) AS n, count(DISTINCT (repo_slug, path)) AS files FROM (SELECT repo_slug, path, unnest(regexp_extract_all(content, '([A-Z][a-z]+)tion', 1)) AS value FROM text_lines) WHERE value <> '' GROUP BY 1""")
def distinct_matches(spark, d):
    return search.distinct_matches(corpus.lines(spark, d), "([A-Z][a-z]+)tion", 1)


@query("""SELECT count(DISTINCT value) AS values, count(*) AS n, count(DISTINCT (repo_slug, path)) AS files FROM (SELECT repo_slug, path, unnest(regexp_extract_all(content, '[0-9]+')) AS value FROM text_lines) WHERE value <> ''""")
def match_totals(spark, d):
    return search.match_totals(corpus.lines(spark, d), "[0-9]+")


@query(r"""SELECT h.repo_slug, h.path, h.line_number, h.content, h.occurrences, t.n, w.files, w.total, w.files AS all_files FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug, path ORDER BY line_number) AS rank FROM named) h
    JOIN (SELECT repo_slug, path, sum(occurrences)::BIGINT AS n FROM named GROUP BY 1, 2 ORDER BY n DESC, path, repo_slug LIMIT 100) t ON t.repo_slug = h.repo_slug AND t.path = h.path
    CROSS JOIN (SELECT count(DISTINCT (repo_slug, path)) AS files, sum(occurrences)::BIGINT AS total FROM named) w WHERE rank <= 200""")
def references(spark, d):
    return search.references(corpus.lines(spark, d), "the")


@query(r"""SELECT count(DISTINCT CASE WHEN repo_slug = 'src2' THEN (repo_slug, path) END) AS files, count(DISTINCT (repo_slug, path)) AS all_files FROM text_lines
    WHERE contains(content, 'and') AND regexp_matches(content, '(?:^|[^\p{L}\p{Nd}_])and(?:$|[^\p{L}\p{Nd}_])')""")
def naming_counts(spark, d):
    return search.naming_counts(corpus.lines(spark, d), "and", FileFilter(repo="src2"))


@query("SELECT qualified_path, size_bytes, line_count, (SELECT count(*) FROM files WHERE regexp_matches(lower(qualified_path), '^[a-z]/eco.*brand#[12][0-9]/.*\\.cs$') AND repo_slug = 'o') AS total, (SELECT count(*) FROM files WHERE regexp_matches(lower(qualified_path), '^[a-z]/eco.*brand#[12][0-9]/.*\\.cs$')) AS everywhere FROM files WHERE regexp_matches(lower(qualified_path), '^[a-z]/eco.*brand#[12][0-9]/.*\\.cs$') AND repo_slug = 'o' ORDER BY qualified_path LIMIT 100".replace("\\\\", "\\"))
def list_files(spark, d):
    return search.list_files(*_v(spark, d, "files"), "[a-z]/ECO*brand#[12][0-9]/*.cs", FileFilter(repo="o"))


@query("SELECT upper(qualified_path) AS request, file_id, repo_slug, path, qualified_path FROM files")
def resolve_paths(spark, d):
    (files,) = _v(spark, d, "files")
    return search.resolve_paths(files.select(F.upper("qualified_path").alias("request")), files)


@query("""SELECT request, rank, qualified_path FROM (SELECT r.request, f.qualified_path, row_number() OVER (PARTITION BY request ORDER BY qualified_path) AS rank FROM (SELECT DISTINCT 'gone/' || upper(name) AS request FROM files) r
    JOIN files f ON lower(split_part(request, '/', -1)) = lower(f.name)) WHERE rank <= 5""")
def suggest_paths(spark, d):
    (files,) = _v(spark, d, "files")
    return search.suggest_paths(files.select(F.concat(F.lit("gone/"), F.upper("name")).alias("request")).distinct(), files)


@query("""SELECT f.file_id // 5000 AS request_id, (f.file_id % 5000) // 50 AS window_id, l.repo_slug, l.path, l.line_number, l.content FROM text_files f
    JOIN text_lines l ON l.repo_slug = f.repo_slug AND l.path = f.path AND l.line_number BETWEEN 2 AND 6 WHERE f.file_id % 50 = 0""")
def read_windows(spark, d):
    (files,) = _v(spark, d, "text_files")
    asked = files.filter("file_id % 50 = 0")  # the requests, of at most 100 windows each
    windows = asked.select(F.expr("file_id div 5000").alias("request_id"), F.expr("(file_id % 5000) div 50").alias("window_id"), "repo_slug", "path", F.lit(2).alias("start_line"), F.lit(6).alias("end_line"))
    return search.read_windows(windows, corpus.lines(spark, d))


@query("SELECT repo_slug, path, line_number, content FROM text_lines")
def split_lines(spark, d):
    return corpus.lines(spark, d).select("repo_slug", "path", "line_number", "content")


@query("SELECT path, line_number, sha FROM line_commits")
def expanded_runs(spark, d):
    """Runs and back: every line gets the commit of its run."""
    (lines,) = _v(spark, d, "line_commits")
    runs = history.blame_runs(lines).withColumn("repo_slug", F.lit("r")).withColumnRenamed("sha", "commit_id")
    return attribution.attributed(lines.drop("sha").withColumn("repo_slug", F.lit("r")), runs).select("path", "line_number", F.col("commit_id").alias("sha"))


@query("""SELECT count(*) AS overlapping FROM (SELECT start_line, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM (
    SELECT path, sha, min(line_number) AS start_line, max(line_number) + (CASE sha WHEN 'click' THEN 1 ELSE 0 END) AS end_line FROM (SELECT *, line_number - row_number() OVER (PARTITION BY path, sha ORDER BY line_number) AS island FROM line_commits)
    GROUP BY path, sha, island)) WHERE start_line <= ended""")
def run_overlaps(spark, d):
    (lines,) = _v(spark, d, "line_commits")
    runs = history.blame_runs(lines).withColumn("repo_slug", F.lit("r")).withColumn("end_line", F.col("end_line") + F.when(F.col("sha") == "click", 1).otherwise(0))
    return attribution.overlaps(runs).agg(F.count(F.lit(1)).alias("overlapping"))


@query("SELECT f.file_id, f.repo_slug, f.path, e.a AS first_commit, e.b AS last_commit FROM files f LEFT JOIN (SELECT repo_slug, path, min(commit_id) AS a, max(commit_id) AS b FROM commit_files GROUP BY 1, 2) e ON e.repo_slug = f.repo_slug AND e.path = f.path")
def files_with_ends(spark, d):
    files, changes = _v(spark, d, "files", "commit_files")
    return attribution.with_ends(files, changes).select("file_id", "repo_slug", "path", "first_commit", "last_commit")


@query()
def line_states(spark, d):
    """Lexical states of the raw pages read as HTML files."""
    return language.line_states(_page_files(spark, d))


@query()
def page_imports(spark, d):
    return language.imports(_page_files(spark, d))


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select(F.lit("web").alias("repo_slug"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("extension"), ingest.line_array(F.col("html")).alias("lines"))


@query("SELECT page_id, CASE WHEN strlen(html) > 5000 THEN 'larger than 5000 bytes' WHEN regexp_matches(substr(hex(html), 1, 16000), '^(?:..)*?00') THEN 'binary' END AS skip_reason FROM pages")
def skip_reasons(spark, d):
    """Every page by its bytes against a ceiling that some exceed."""
    raw = F.col("html").cast("binary")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", ingest.skip_reason(raw, F.length(raw), 5000).alias("skip_reason"))


@query("SELECT page_id, CASE WHEN strlen(html) > 26214400 THEN 'larger than 25 MiB' WHEN regexp_matches(substr(hex(html), 1, 16000), '^(?:..)*?00') THEN 'binary' END AS skip_reason FROM pages")
def page_skip_reasons(spark, d):
    """Every page by its bytes against the default ceiling; a page without html has no reason."""
    raw = F.col("html").cast("binary")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", ingest.skip_reason(raw, F.length(raw)).alias("skip_reason"))


@query("SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE " + _EXCLUDED_SQL)
def excluded_files(spark, d):
    (files,) = _v(spark, d, "files")
    return files.filter(patterns.excluded(F.col("path"), EXCLUDED)).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query("""SELECT count(*) AS files, count(DISTINCT directory) AS directories FROM files WHERE regexp_matches(lower('/' || path), '/economy.*/(.*/)?p.*[.]cs$') OR regexp_matches(lower('/' || path), '^/standard.*/(.*/)?brand#1./(.*/)?p[0-9].*[.]ts$')""")
def excluded_inner(spark, d):
    """Stars between slashes that stand for no folder, for one, or for more."""
    (files,) = _v(spark, d, "files")
    kept = files.filter(patterns.excluded(F.col("path"), ["ECONOMY*/**/p*.cs", "/STANDARD*/**/Brand#1?/**/p[0-9]*.ts"]))
    return kept.groupBy("directory").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count("directory").alias("directories"))


@query("""SELECT floor(epoch(authored_at))::BIGINT AS second, count(*) AS commits FROM commits WHERE commit_id IN (SELECT commit_id FROM commit_files WHERE starts_with(path, 'PROMO')) GROUP BY 1""")
def commits_of_prefix(spark, d):
    commits, changes = _v(spark, d, "commits", "commit_files")
    kinds = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("directory")).distinct().filter("directory LIKE 'PROMO%'")
    below = history.prefixes(changes.select("commit_id", "path")).join(kinds, "directory", "left_semi")
    touched = commits.join(below.select("commit_id"), "commit_id", "left_semi")
    return touched.groupBy(seconds(F.col("authored_at")).alias("second")).agg(F.count(F.lit(1)).alias("commits"))


@query()
def resolved_page_links(spark, d):
    """Links of the pages as import edges of shape ``path``."""
    files = _page_files(spark, d).select(F.xxhash64("path").alias("file_id"), "repo_slug", "path", F.lit("").alias("directory"), F.lit(None).cast("string").alias("module"))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("i", "name"))
    edges = links.select(F.xxhash64("page_id", "i").alias("import_id"), F.xxhash64(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))).alias("file_id"), F.lit(1).alias("line_number"), "name", F.lit("path").alias("shape"), F.lit("parsed").alias("evidence"))
    return imports.resolved(edges, files)


def _code_files(spark: SparkSession, d: str) -> DataFrame:
    (files,) = _v(spark, d, "code_files")
    return files.select("repo_slug", "path", "extension", F.split("content", "\n").alias("lines"))


#: Every template's lines, as a reader of the languages expects them.
_STATES = "('cs', [3, 4], 'comment'), ('cs', [10, 11], 'literal'), ('ts', [4], 'literal'), ('sql', [5], 'comment'), ('pas', [11], 'comment')"


@query(f"""SELECT f.repo_slug, f.path, f.line_number, coalesce(s.state, 'code') AS state
    FROM (SELECT repo_slug, path, extension, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS line_number FROM code_files) f
    LEFT JOIN (SELECT extension, unnest(numbers) AS line_number, state FROM (VALUES {_STATES}) v(extension, numbers, state)) s ON s.extension = f.extension AND s.line_number = f.line_number""")
def code_states(spark, d):
    """States of the lines of generated sources in four languages, of all kinds."""
    return language.line_states(_code_files(spark, d))


_DECLARED = """('cs', 5, 'P@key', NULL, 'class', NULL, 0, true), ('cs', 7, NULL, 'Size', 'member', NULL, 4, false), ('cs', 8, NULL, 'Name', 'member', NULL, 4, true),
    ('ts', 2, 'P@key', NULL, 'class', NULL, 0, true), ('ts', 3, NULL, 'q', 'member', NULL, 0, false), ('ts', 6, NULL, 'Size', 'member', NULL, 0, false), ('ts', 7, NULL, 'Name', 'member', NULL, 2, true),
    ('sql', 3, NULL, 'Name', 'procedure', 'implementation', 0, true), ('sql', 6, NULL, 'P@key_Name', 'index', 'implementation', 0, true),
    ('pas', 6, 'TP@key', NULL, 'class', 'declaration', 2, true), ('pas', 7, NULL, 'Name', 'procedure', 'declaration', 4, true), ('pas', 12, 'TP@key', 'Name', 'procedure', 'implementation', 0, true), ('pas', 13, NULL, 'Size', 'var', 'implementation', 0, false)"""
_KEYED = "replace({0}, '@key', regexp_extract(path, '[0-9]+'))"


@query(f"""SELECT f.repo_slug, f.path, v.line_number, {_KEYED.format("v.type_name")} AS type_name, {_KEYED.format("v.member")} AS member, v.kind, v.role, v.indent, v.opens_scope
    FROM code_files f JOIN (VALUES {_DECLARED}) v(extension, line_number, type_name, member, kind, role, indent, opens_scope) ON v.extension = f.extension""")
def code_declarations(spark, d):
    """Declaring lines of the generated sources."""
    return language.declarations(_code_files(spark, d))


_IMPORTED = "('cs', 1, 'Shop.P@key', 'module'), ('ts', 1, './p@key', 'path'), ('pas', 4, 'Shop.Forms', 'module'), ('pas', 4, 'Shop.P@key', 'module')"


@query(f"""SELECT f.repo_slug, f.path, v.line_number, {_KEYED.format("v.name")} AS name, v.shape, 'text' AS evidence FROM code_files f JOIN (VALUES {_IMPORTED}) v(extension, line_number, name, shape) ON v.extension = f.extension""")
def code_imports(spark, d):
    """Import edges of the generated sources."""
    return language.imports(_code_files(spark, d))


#: The n-th appearance of the name on a line, and its kind.
_NAMED = """('cs', 8, 1, 'definition'), ('cs', 8, 2, 'string_literal'), ('cs', 8, 3, 'call'), ('cs', 8, 4, 'string_literal'), ('cs', 10, 1, 'string_literal'), ('cs', 11, 1, 'call'),
    ('ts', 3, 1, 'string_literal'), ('ts', 3, 2, 'call'), ('ts', 4, 1, 'string_literal'), ('ts', 4, 2, 'call'), ('ts', 7, 1, 'definition'),
    ('sql', 1, 1, 'comment'), ('sql', 3, 1, 'definition'), ('sql', 5, 1, 'string_literal'), ('sql', 5, 2, 'call'), ('sql', 6, 1, 'other'),
    ('pas', 7, 1, 'definition'), ('pas', 10, 1, 'comment'), ('pas', 12, 1, 'definition')"""


@query(f"""SELECT f.repo_slug, f.path, v.line_number, v.nth, v.kind FROM code_files f JOIN (VALUES {_NAMED}) v(extension, line_number, nth, kind) ON v.extension = f.extension""")
def code_kinds(spark, d):
    """Every appearance of one name in the generated sources, with its kind."""
    nth = F.row_number().over(Window.partitionBy("repo_slug", "path", "line_number").orderBy("column"))
    return language.occurrences(_code_files(spark, d), "Name").withColumn("nth", nth).drop("column")


#: Every event puts one to three lines at the top of its user's file; halfway through its events the file is copied.
_GROWN = "SELECT user_id, event_id + 1 AS event_id, 1 + event_id % 3 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS events FROM events"


@query(f"""SELECT 'r' AS repo_slug, path, (coalesce(sum(n) OVER later, 0) + 1)::INT AS start_line, (coalesce(sum(n) OVER later, 0) + n)::INT AS end_line, event_id AS commit_id
    FROM (SELECT cast(user_id AS varchar) AS path, event_id, n FROM ({_GROWN}) g UNION ALL SELECT concat('copy', cast(user_id AS varchar)), event_id, n FROM ({_GROWN}) g WHERE nth < 1 + events // 2) q
    WINDOW later AS (PARTITION BY path ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def replayed_runs(spark, d):
    """Attribution of growing files and of copies made of them in between, by replay."""
    grown = spark.sql(_GROWN.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    edit = F.array(F.struct(F.lit(0).alias("old_line"), F.lit(0).alias("deleted"), F.col("n").cast("int").alias("added")))
    kinds = lambda path, old, kind, edits: grown.select(F.lit("r").alias("repo_slug"), F.col("event_id").alias("commit_id"), path.alias("path"), old.alias("old_path"), kind.alias("change_kind"), F.lit(False).alias("is_binary"), edits.alias("edits"), "nth", "events")
    user, none = F.col("user_id").cast("string"), F.lit(None).cast("string")
    own = kinds(user, none, F.when(F.col("nth") == 1, "added").otherwise("modified"), edit)
    copies = kinds(F.concat(F.lit("copy"), user), user, F.lit("copied"), F.filter(edit, lambda e: F.lit(False))).filter("nth = 1 + events DIV 2")
    return attribution.replay(own.unionByName(copies).drop("nth", "events"))
