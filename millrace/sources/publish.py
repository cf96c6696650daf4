"""Dataset versions: every table as Parquet under ``version=N``; a pointer row is written last and makes the version current.

Readers resolve the pointer once and stay on that version, so a build beside them never disturbs them, and a build
that fails leaves the pointer where it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.schema import SCHEMA_VERSION, TABLES


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest complete version, or None."""
    try:
        row = spark.read.parquet(f"{root}/pointer").agg(F.max("version")).first()
    except AnalysisException as e:  # no pointer yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return row[0]


def publish(root: str, tables: dict[str, DataFrame], single: bool = False) -> int:
    """Writes a new version and points to it; ``index_info`` comes after all other tables."""
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, root) or 0) + 1
    base = f"{root}/version={version}"
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if name == "lines":
            writer = df.repartitionByRange("file_id").sortWithinPartitions("file_id", "line_number").write.mode("overwrite").option("compression", "zstd")
        writer.parquet(f"{base}/{name}")
    info = spark.sql(f"SELECT {SCHEMA_VERSION} AS schema_version, current_timestamp() AS built_at, false AS fts_indexed, {str(single).lower()} AS single_repository")
    info.write.mode("overwrite").parquet(f"{base}/index_info")
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{root}/pointer")
    return version


def restore(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """The tables of a version; None where there is none, where one of its tables is missing, or where it was written under another schema version."""
    version = version if version is not None else current_version(spark, root)
    if version is None:
        return None
    base = f"{root}/version={version}"
    try:
        out = {name: spark.read.parquet(f"{base}/{name}") for name in TABLES}
    except AnalysisException as e:  # a part of a version is no version
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return out if out["index_info"].first()["schema_version"] == SCHEMA_VERSION else None


def carried(previous: dict[str, DataFrame] | None, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New history appended to that of the version before."""
    names = ("commits", "commit_files", "attribution")
    return {n: previous[n].unionByName(fresh[n], allowMissingColumns=True) if previous and n in previous else fresh[n] for n in names if n in fresh}


def overview_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with all overview sections as a JSON document. Sections are short by their own limits."""
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).drop("id")
    for name, df in parts.items():
        out = out.crossJoin(F.broadcast(df.agg(F.collect_list(F.struct(*df.columns)).alias(name))))  # one row each
    return out.select(F.to_json(F.struct(*parts)).alias("document"))
