"""From exported files and patches to the tables of a dataset version."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MIB = 1 << 20
SIZE_LIMIT = 25 * MIB
#: A byte 0 among so many leading bytes marks a file as binary.
SNIFFED = 8000


def read_files(spark: SparkSession, root: str, repo_slug: str, glob: str = "*") -> DataFrame:
    """``repo_slug, path, content, length`` of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    relative = F.regexp_extract("path", "(?:^|/)" + root.strip("/").split("/")[-1] + "/(.*)$", 1)
    return raw.select(F.lit(repo_slug).alias("repo_slug"), relative.alias("path"), "content", "length")


def size_text(limit: int = SIZE_LIMIT) -> str:
    """The limit in MiB where it is a whole number of quarters, else in bytes."""
    quarters, rest = divmod(limit * 4, MIB)
    return f"{limit} bytes" if rest else f"{quarters / 4:g} MiB"


def skip_reason(content: Column, length: Column, limit: int = SIZE_LIMIT) -> Column:
    """Why a file has no lines; size is looked at before content."""
    head = F.substring(content, 1, SNIFFED)
    return F.when(length > limit, F.lit(f"larger than {size_text(limit)}")).when(F.hex(head).rlike("^(?:..)*?00"), F.lit("binary"))


def decode(content: pd.Series) -> pd.Series:
    """Text of a file: by its byte order mark, else UTF-8 where it is valid, else Windows-1252."""
    marks = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for mark, name in marks:
            if raw.startswith(mark):
                return raw[len(mark) :].decode(name, "replace")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            # The five bytes that the code page leaves open stand for themselves.
            return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)

    return content.map(one)


def decoded(content: Column) -> Column:
    return F.pandas_udf(decode, "string")(content)


def line_array(content: Column) -> Column:
    """Lines without line ends: every carriage return goes, and a last line feed opens no line."""
    parts = F.split(F.replace(content, F.lit("\r"), F.lit("")), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; files without lines give none."""
    keep = [c for c in files.columns if c != "content"]
    out = files.select(*keep, F.posexplode(line_array(F.col("content"))).alias("at", "content"))
    return out.select(*keep, (F.col("at") + 1).alias("line_number"), "content")


def path_columns(path: Column) -> dict[str, Column]:
    """Directory, name, and extension in lower case without its dot (empty without one)."""
    name = F.split_part(path, F.lit("/"), F.lit(-1))
    return {"directory": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "name": name, "extension": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))}


def ingest(documents: DataFrame, single: bool = False, limit: int = SIZE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``lines`` of ``repo_slug, path, content (binary), length``; ids are hashes and survive a rebuild."""
    rows = documents.withColumn("skip_reason", skip_reason(F.col("content"), F.col("length"), limit))
    rows = rows.withColumns({"file_id": F.xxhash64("repo_slug", "path"), "text": decoded(F.when(F.col("skip_reason").isNull(), F.col("content")))}).drop("content")
    rows = rows.withColumns(path_columns(F.col("path"))).withColumn("qualified_path", F.col("path") if single else F.concat_ws("/", "repo_slug", "path"))
    counted = F.when(F.col("skip_reason").isNull(), F.size(line_array(F.col("text")))).otherwise(0).cast("long")
    files = rows.select("file_id", "repo_slug", "path", "qualified_path", "directory", "name", "extension", F.col("length").alias("size_bytes"), counted.alias("line_count"), "skip_reason")
    lines = split_lines(rows.filter("skip_reason IS NULL").select("file_id", F.col("text").alias("content")))
    return files, lines.select(F.xxhash64("file_id", "line_number").alias("line_id"), "file_id", "line_number", "content")


def repositories(files: DataFrame) -> DataFrame:
    """Counts per repository; files that are skipped count too."""
    return files.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("line_count"), F.sum("size_bytes").alias("byte_count"))


def new_commits(exported: DataFrame, known: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """Commits of ``repo_slug, walk_pos (0 is newest), sha, author_name, author_email, authored_at, message`` newer than the newest known one, numbered on.

    The walk stops before the newest recorded commit of its repository. Ids ascend with history: oldest first, after all known ids, or those of ``numbered``.
    """
    stop = exported.join(known.select("repo_slug", "sha").distinct(), ["repo_slug", "sha"]).groupBy("repo_slug").agg(F.min("walk_pos").alias("stop"))
    fresh = exported.join(stop, "repo_slug", "left").filter("stop IS NULL OR walk_pos < stop")
    subject, body = F.split_part("message", F.lit("\n"), F.lit(1)), F.regexp_extract("message", r"(?s)^[^\n]*\n\n?(.*)$", 1)
    counts = fresh.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("repo_slug", F.coalesce(F.sum("n").over(W.orderBy("repo_slug").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # one row per repository
    last = (known if numbered is None else numbered).agg(F.coalesce(F.max("commit_id"), F.lit(0)).alias("last"))
    rank = F.row_number().over(W.partitionBy("repo_slug").orderBy(F.desc("walk_pos")))
    out = fresh.withColumn("rank", rank).join(offsets, "repo_slug").crossJoin(F.broadcast(last))  # one row
    return out.select((F.col("last") + F.col("offset") + F.col("rank")).cast("long").alias("commit_id"), "repo_slug", "sha", "author_name", "author_email", "authored_at", F.rtrim(subject).alias("subject"), F.rtrim(body).alias("body"))


def line_edits(patch: Column) -> Column:
    """Hunks of a unified patch as ``(old_line, deleted, added)``; ``old_line`` is the last line before an insertion, else the line before the first deleted one."""
    header = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    hunks = F.filter(F.split(patch, "\n"), lambda line: line.rlike(header))

    def edit(line: Column) -> Column:
        count = lambda i: F.when(F.regexp_extract(line, header, i) == "", F.lit(1)).otherwise(F.regexp_extract(line, header, i).cast("int"))
        start = F.regexp_extract(line, header, 1).cast("int")
        return F.struct(F.when(count(2) == 0, start).otherwise(start - 1).alias("old_line"), count(2).alias("deleted"), count(4).alias("added"))

    return F.transform(hunks, edit)


def change_rows(changes: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """``commit_id, path, old_path, change_kind, is_binary, size_bytes (of the larger side), patch`` with the patch read as ``edits, added, deleted``.

    A binary change, and one of a file over the limit, has no lines.
    """
    binary = F.coalesce("is_binary", F.lit(False)) | (F.col("size_bytes") > limit)
    none = F.array().cast("array<struct<old_line:int,deleted:int,added:int>>")
    out = changes.withColumn("is_binary", binary).withColumn("edits", F.when(F.col("is_binary") | F.col("patch").isNull(), none).otherwise(line_edits(F.col("patch"))))
    total = lambda name: F.aggregate("edits", F.lit(0).cast("long"), lambda a, e: a + e[name]).alias(name)
    return out.select("commit_id", "path", "old_path", "change_kind", "is_binary", "edits", total("added"), total("deleted"))


def paired_renames(changes: DataFrame) -> DataFrame:
    """``commit_id, path, old_path, change_kind, blob`` with added and deleted paths of one blob in a commit paired as renames, in path order."""
    rank = F.row_number().over(W.partitionBy("commit_id", "blob", "change_kind").orderBy("path"))
    ranked = changes.withColumn("rank", F.when(F.col("change_kind").isin("added", "deleted") & F.col("blob").isNotNull(), rank))
    gone = ranked.filter("change_kind = 'deleted' AND rank IS NOT NULL").select("commit_id", "blob", "rank", F.col("path").alias("from"))
    came = ranked.filter("change_kind = 'added' AND rank IS NOT NULL").select("commit_id", "blob", "rank", F.col("path").alias("to"))
    pairs = came.join(gone, ["commit_id", "blob", "rank"])
    out = ranked.join(pairs.select("commit_id", F.col("to").alias("path"), "from"), ["commit_id", "path"], "left")
    out = out.join(pairs.select("commit_id", F.col("from").alias("path"), F.lit(True).alias("moved")), ["commit_id", "path"], "left")
    out = out.filter("NOT (change_kind = 'deleted' AND coalesce(moved, false))")
    renamed = F.col("from").isNotNull() & (F.col("change_kind") == "added")
    return out.select("commit_id", "path", F.when(renamed, F.col("from")).otherwise(F.col("old_path")).alias("old_path"), F.when(renamed, F.lit("renamed")).otherwise(F.col("change_kind")).alias("change_kind"), "blob")


def rewritten(exported: DataFrame, known: DataFrame) -> DataFrame:
    """Repositories whose newest known commit is missing in the export: their history was rewritten and is to be read anew."""
    tips = known.groupBy("repo_slug").agg(F.max_by("sha", "commit_id").alias("sha"))
    return tips.join(exported.select("repo_slug").distinct(), "repo_slug", "left_semi").join(exported.select("repo_slug", "sha"), ["repo_slug", "sha"], "left_anti").select("repo_slug")


def imported(exported: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, fresh)``: the known commits that stay, and those to add. A repository whose history was rewritten is dropped and read anew, under ids of its own."""
    kept = known.join(rewritten(exported, known), "repo_slug", "left_anti")
    return kept, new_commits(exported, kept, numbered=known)


def pruned(commits: DataFrame, commit_files: DataFrame, configured: DataFrame, forgotten: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """History of the repositories that are still configured and not to be forgotten, and the changes of the commits that stay."""
    kept = commits.join(configured.select(F.col("slug").alias("repo_slug")), "repo_slug", "left_semi")
    if forgotten is not None:
        kept = kept.join(forgotten, "repo_slug", "left_anti")
    return kept, commit_files.join(kept.select("commit_id"), "commit_id", "left_semi")

