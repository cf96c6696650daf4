"""Renamed directories: which directory a path came from, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.operators.history import prefixes
from millrace.plans.tables import SHARE_ROWS, small, written, written_in_shares

MAX_HOPS = 8
BROADCAST_ROWS = 300_000


def _directories(changes: DataFrame) -> DataFrame:
    """``repo_slug, directory, previous``: distinct paths that were renamed to the directory from the previous one, and the newest commit; without a previous one, distinct paths below the directory."""
    rows = changes.repartition("repo_slug", "path")  # the only shuffle of rows: a path's are together, directories are counted where they are
    rows = rows.withColumn("old_path", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), "old_path"))))
    each = rows.groupBy("repo_slug", "path", "old_path").agg(F.max("commit_id").alias("newest"))
    tail = F.substring(F.col("path"), F.length("directory") + 1, F.length("path"))
    each = prefixes(each).withColumn("tail", tail)
    # Directory, previous one and path name the old path, so that a pair's paths are distinct as they are.
    each = each.withColumn("previous", F.when(F.endswith("old_path", "tail"), F.substring(F.col("old_path"), F.lit(1), F.length("old_path") - F.length("tail"))))
    apart = ~F.startswith("directory", F.concat("previous", F.lit("/"))) & ~F.startswith("previous", F.concat("directory", F.lit("/")))
    each = each.filter(F.col("old_path").isNull() | ((F.col("previous") != F.col("directory")) & apart))
    return each.groupBy("repo_slug", "directory", "previous").agg(F.count(F.lit(1)).alias("n"), F.max("newest").alias("newest"))


def lineage_hops(commit_files: DataFrame, rows: int = 0) -> DataFrame:
    """``repo_slug, path, previous_path``: the directory most of whose renamed files came from one other.

    A rename names a pair of directories at each depth at which both paths end alike. A pair is kept if its distinct renamed paths are
    more than half of the distinct paths recorded below the directory, and neither lies below the other. The changes are read once for each share of ``rows``.
    """
    renamed = F.when(F.col("change_kind") == "renamed", F.col("old_path")).alias("old_path")
    changes = commit_files.filter("repo_slug IS NOT NULL AND contains(path, '/')").select("repo_slug", "commit_id", "path", renamed)
    counts = written_in_shares(lambda wanted: _directories(changes.filter(wanted)), "path", rows, SHARE_ROWS, "directories")
    counts = counts.groupBy("repo_slug", "directory", "previous").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    pairs = counts.filter("previous IS NOT NULL").withColumnRenamed("n", "moved")
    whole = counts.filter("previous IS NULL").select("repo_slug", "directory", F.col("n").alias("paths"))
    kept = pairs.join(whole, ["repo_slug", "directory"]).filter(2 * F.col("moved") > F.col("paths"))
    rank = F.row_number().over(W.partitionBy("repo_slug", "directory").orderBy(F.desc("moved"), F.desc("newest"), "previous"))
    return kept.withColumn("rank", rank).filter("rank = 1").select("repo_slug", F.col("directory").alias("path"), F.col("previous").alias("previous_path"))


def lineage_chains(hops: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """``repo_slug, path, hop, previous_path``: followed for up to eight hops, never twice over one name."""
    hops = written(hops, "hops")
    step = hops.select("repo_slug", F.col("path").alias("previous_path"), F.col("previous_path").alias("next"))
    chain = hops.select("repo_slug", "path", F.lit(1).alias("hop"), "previous_path", F.array("path", "previous_path").alias("seen"))
    out = chain
    for hop in range(2, most + 1):
        chain = chain.join(step, ["repo_slug", "previous_path"]).filter(~F.array_contains("seen", F.col("next")))
        chain = chain.select("repo_slug", "path", F.lit(hop).alias("hop"), F.col("next").alias("previous_path"), F.array_append("seen", F.col("next")).alias("seen"))
        chain = written(chain, "chains")
        if chain.isEmpty():
            break
        out = out.unionByName(chain)
    return out.drop("seen")


def _chain_commits(commit_files: DataFrame, chains: DataFrame, rows: int) -> DataFrame:
    """``repo_slug, path, whole, commits, known``: distinct commits below any name of the chain of a path if ``whole``, otherwise below an earlier name by itself; ``known`` leaves out null."""
    names = chains.select("repo_slug", "path", F.col("previous_path").alias("directory")).union(chains.select("repo_slug", "path", F.col("path").alias("directory"))).withColumn("whole", F.lit(True))
    each = chains.select("repo_slug", F.col("previous_path").alias("path"), F.col("previous_path").alias("directory")).withColumn("whole", F.lit(False))
    names = written(names.unionByName(each).distinct(), "chain-names")
    numbered = written(names.select("repo_slug", "path", "whole").distinct().withColumn("chain", F.monotonically_increasing_id()), "chain-numbers")
    names = small(names.join(numbered, ["repo_slug", "path", "whole"]).select("repo_slug", "directory", "chain"), "chain-directories", BROADCAST_ROWS)

    def counted(share: DataFrame) -> DataFrame:
        rows = share.repartition("commit_id")  # the only shuffle of rows: a commit's are together, made distinct and counted where they are
        rows = prefixes(rows).join(names, ["repo_slug", "directory"]).select("chain", "commit_id").distinct()
        return rows.groupBy("chain").agg(F.count(F.lit(1)).alias("commits"), F.count("commit_id").alias("known"))

    # Up to the last slash: a directory is above it as it is above the path, and fewer bytes are moved.
    above = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))").alias("path")
    changes = commit_files.filter("contains(path, '/')").select("repo_slug", "commit_id", above)
    counts = written_in_shares(lambda wanted: counted(changes.filter(wanted)), "commit_id", rows, SHARE_ROWS, "chain-commits")
    counts = counts.groupBy("chain").agg(F.sum("commits").alias("commits"), F.sum("known").alias("known"))
    return written(counts.join(numbered, "chain").drop("chain"), "chain-counts")


def path_lineage(commit_files: DataFrame) -> DataFrame:
    """Chains with the commits of each earlier name, and the distinct commits of a whole chain.

    The changes are read several times before this returns, in shares of ``SHARE_ROWS``, and not after: what takes long to make is to be written before.
    """
    rows = commit_files.count()
    chains = lineage_chains(lineage_hops(commit_files, rows))
    counts = _chain_commits(commit_files, chains, rows)
    own = counts.filter("NOT whole").select("repo_slug", F.col("path").alias("previous_path"), F.col("commits").alias("previous_commits"))
    together = counts.filter("whole").select("repo_slug", "path", F.col("known").alias("combined_commits"))
    out = chains.join(own, ["repo_slug", "previous_path"], "left").join(together, ["repo_slug", "path"], "left")
    return out.select("repo_slug", "path", "hop", "previous_path", F.coalesce("previous_commits", F.lit(0)).alias("previous_commits"), F.coalesce("combined_commits", F.lit(0)).alias("combined_commits"))


def lineage_note(lineage: DataFrame, named: int = 3) -> DataFrame:
    """Per path: the first earlier names in order, and how many more there are."""
    by = lineage.groupBy("repo_slug", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "previous_path"))), lambda x: x["previous_path"]).alias("names"), F.max("combined_commits").alias("combined_commits"))
    return by.select("repo_slug", "path", F.slice("names", 1, named).alias("previous"), F.greatest(F.size("names") - named, F.lit(0)).alias("more"), "combined_commits")
