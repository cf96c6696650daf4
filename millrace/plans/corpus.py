"""The driver's tables seen as a code corpus with history: the same SELECTs for Spark and for other SQL engines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.tables import SHARE_ROWS, written, written_in_shares

VIEWS: dict[str, str] = {
    "commits": """
        SELECT o_orderkey AS commit_id, lower(o_orderstatus) AS repo_slug, md5(cast(o_orderkey AS varchar(20))) AS sha, c_name AS author_name,
               concat(cast(o_custkey AS varchar(20)), '@x') AS author_email, cast(o_orderdate AS timestamp) AS authored_at,
               o_orderpriority AS subject, concat('order ', o_orderpriority) AS body
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "commit_files": """
        SELECT commit_id, repo_slug, path, added, deleted, change_kind, CASE WHEN change_kind = 'renamed' THEN concat('legacy/', path) END AS old_path
        FROM (SELECT l_orderkey AS commit_id, min(lower(o_orderstatus)) AS repo_slug,
                     concat(p_type, '/', p_brand, '/p', cast(l_partkey AS varchar(20)),
                            CASE l_partkey % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.ts' WHEN 2 THEN '.sql' ELSE '' END) AS path,
                     cast(sum(cast(l_quantity AS int)) AS bigint) AS added, cast(sum(l_linenumber) AS bigint) AS deleted,
                     CASE WHEN min(l_returnflag) = 'N' AND max(l_orderkey) % 3 = 0 THEN 'deleted'
                          WHEN min(l_returnflag) = 'A' THEN 'added' WHEN min(l_returnflag) = 'R' THEN 'renamed' ELSE 'modified' END AS change_kind
              FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey GROUP BY l_orderkey, p_type, p_brand, l_partkey) q""",
    "files": """
        SELECT p_partkey * 8 + r.n AS file_id, r.repo_slug, path, concat(r.repo_slug, '/', path) AS qualified_path, concat(p_type, '/', p_brand) AS directory,
               concat('p', cast(p_partkey AS varchar(20)), ext) AS name, substr(ext, 2) AS extension, cast(floor(p_retailprice * 100) AS bigint) AS size_bytes,
               cast(p_size AS bigint) AS line_count, CASE WHEN p_size > 48 THEN 'binary' END AS skip_reason
        FROM (SELECT *, concat(p_type, '/', p_brand, '/p', cast(p_partkey AS varchar(20)), ext) AS path
              FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.ts' WHEN 2 THEN '.sql' ELSE '' END AS ext FROM {part}) a) p
        CROSS JOIN (SELECT 0 AS n, 'f' AS repo_slug UNION ALL SELECT 1, 'o' UNION ALL SELECT 2, 'p') r
        LEFT JOIN (SELECT repo_slug AS gone_slug, path AS gone_path FROM ({commit_files}) c GROUP BY 1, 2 HAVING max_by(change_kind, commit_id) = 'deleted') g
               ON g.gone_slug = r.repo_slug AND g.gone_path = p.path
        WHERE g.gone_path IS NULL""",
    "text_files": """
        SELECT doc_id AS file_id, source AS repo_slug, concat(lang, '/doc', cast(doc_id AS varchar(20)), '.txt') AS path,
               concat(source, '/', lang, '/doc', cast(doc_id AS varchar(20)), '.txt') AS qualified_path, 'txt' AS extension, text AS content
        FROM {documents}""",
    "code_files": """
        SELECT 'code' AS repo_slug, concat('p', cast(p_partkey AS varchar(20)), '.', ext) AS path, ext AS extension,
               replace(replace(replace(replace(replace(replace(replace(template, '@(', chr(123)), ')@', chr(125)), '@name', p_name), '@key', cast(p_partkey AS varchar(20))), '~', chr(10)), '^', chr(34)), '|', chr(39)) AS content
        FROM {part} JOIN (
            SELECT 0 AS n, 'cs' AS ext, 'using Shop.P@key;~/* @name~using No.Such;~*/ namespace Shop.Parts;~public class P@key~@(~    private const int Size = 1;~    public string Name() @( return $^@(Trim(^Name^, Name(1)))@ Name // x^; )@~    var raw = ^^^^~  ^^^ Name()~  ^^^^; Name();~)@' AS template
            UNION ALL SELECT 1, 'ts', 'import @( a )@ from ^./p@key^;~export class P@key @(~const q = `Name $@(Name(1))@~@name Name` + Name(2);~// import ^no^~export const Size = 1;~  Name(n: number): void @(~  )@~)@'
            UNION ALL SELECT 2, 'sql', '-- @name Name~create or replace package body app.P@key as~procedure Name(n int) is~/* create table No (~*/ select |it||s Name|, Name(1)~create unique index P@key_Name on t (Name)'
            UNION ALL SELECT 3, 'pas', 'unit P@key;~interface~uses~  Shop.Forms, Shop.P@key;~type~  TP@key = class(TObject)~    procedure Name;~  end;~implementation~@( Name~@name )@~procedure TP@key.Name;~var Size: Integer;~begin~end.'
        ) t ON t.n = p_partkey % 4""",
    "calls": """
        SELECT cast(user_id % 10 AS varchar(20)) AS project, event_type AS tool, cast(ts AS timestamp) AS called_at, value / 1000 AS seconds,
               event_type = 'error' AS failed, event_id AS call_id
        FROM {events}""",
    "line_commits": """
        SELECT cast(user_id AS varchar(20)) AS path, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS int) AS line_number, event_type AS sha
        FROM {events}""",
}

#: Views as they read other views, before those are put into them.
READING = {"files": VIEWS["files"]}
#: What is at HEAD follows from history: a path whose newest change deletes it is gone.
VIEWS["files"] = VIEWS["files"].replace("{commit_files}", VIEWS["commit_files"])


#: Rows of the longest table in one task of a shuffle, how much adaptive execution puts together for one, and how much of the files one task scans.
TASK_ROWS, TASK_BYTES, SCAN_BYTES = 250_000, "8m", "16m"


def sized(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """A session like ``spark`` whose scans and shuffles are dealt by the size of the history that the views read, so that a task's memory does not grow with them.

    The settings belong to the session of the returned frames, whose jobs start later; those of ``spark`` stay as they are.
    """
    if not any("{lineitem}" in VIEWS[n] for n in names):
        return spark
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # from the files' footers
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    own.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    return own


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    tables = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``commits``, ``commit_files`` and ``files``, for questions that read changes several times: these are written once and what is at HEAD is read from them."""
    changes = written(view(spark, sf_dir, "commit_files"), "changes")
    files = spark.sql(READING["files"], commit_files=changes, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return view(spark, sf_dir, "commits"), changes, files


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commit changed which path, written in shares of commits: for questions that read it several times and change it to their own needs."""
    own = sized(spark, sf_dir, "commit_files")
    lines, orders, part = (own.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))

    def share(wanted: Column) -> DataFrame:
        of = lambda df, key: df.withColumn("_key", F.col(key).cast("long")).filter(wanted)
        return own.sql(VIEWS["commit_files"], lineitem=of(lines, "l_orderkey"), orders=of(orders, "o_orderkey"), part=part).select("repo_slug", "commit_id", "path")

    return written_in_shares(share, "_key", lines.count(), SHARE_ROWS, "paths")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the text files, with their numbers."""
    from millrace.sources.ingest import split_lines

    return split_lines(view(spark, sf_dir, "text_files"))


def sql(name: str) -> str:
    """A view's text for an engine that has the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
