"""Import edges: resolution of module names and of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "css", "html")


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of shape ``module``: the one file that declares the name, else why there is none."""
    modules = files.filter("module IS NOT NULL").groupBy(F.lower("module").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("only"))
    rows = imports.filter("shape = 'module'").join(modules, F.lower("name") == F.col("key"), "left")
    why = F.when(F.col("n").isNull(), "nothing declares it").when(F.col("n") > 1, "several files declare it")
    return rows.select(*imports.columns, F.when(F.col("n") == 1, F.col("only")).alias("target_file"), why.alias("unresolved"))


def resolve_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of shape ``path``: relative names are walked from the importing file and tried with extensions and as folders; the first candidate that exists wins."""
    name = F.regexp_replace(F.regexp_replace("name", r"\\", "/"), "[?#].*$", "")
    rows = imports.filter("shape = 'path'").join(files.select("file_id", "repo_slug", F.col("directory").alias("_d")), "file_id")
    rows = rows.withColumn("_n", name)
    external = F.col("_n").rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)")
    relative = F.col("_n").rlike(r"^\.{1,2}(?:/|$)") | F.startswith("_n", F.lit("/"))
    parts = F.when(F.startswith("_n", F.lit("/")), F.split("_n", "/")).otherwise(F.split(F.concat_ws("/", "_d", "_n"), "/"))
    # Walking above the root leaves nothing.
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(a.isNull(), a).when(x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.array_append(a, x)))
    rows = rows.withColumns({"_kind": F.when(external, "external").when(~relative, "package").otherwise("relative"), "_path": F.when(relative & ~external, F.array_join(walked, "/"))})
    tries = F.array(F.col("_path"), *(F.concat("_path", F.lit(f".{e}")) for e in EXTENSIONS), *(F.concat("_path", F.lit(f"/index.{e}")) for e in EXTENSIONS))
    open_ = rows.filter("_path IS NOT NULL").select("import_id", "repo_slug", F.posexplode(tries).alias("_pos", "_try")).withColumn("_key", F.lower("_try"))
    found = open_.join(files.select("repo_slug", F.lower("path").alias("_key"), F.col("file_id").alias("_file")), ["repo_slug", "_key"]).groupBy("import_id").agg(F.min_by("_file", F.struct("_pos", "_file")).alias("target_file"))
    why = F.when(F.col("_kind") != "relative", F.col("_kind")).when(F.col("target_file").isNull(), "no such file")
    return rows.join(found, "import_id", "left").select(*imports.columns, "target_file", why.alias("unresolved"))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    return resolve_modules(imports, files).unionByName(resolve_paths(imports, files))


def outgoing(edges: DataFrame, files: DataFrame, limit: int = 500) -> DataFrame:
    """A file's edges with the paths that they lead to."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("file_id").orderBy("line_number", "import_id"))
    target = files.select(F.col("file_id").alias("target_file"), F.col("qualified_path").alias("target_path"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank").join(target, "target_file", "left")
