"""Files of a source tree as rows, and path exclusions as one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that are never a customer's own code, and folders that builds leave behind.
DEFAULT_GLOBS = ["vendor/", "vendors/", "third-party/", "third_party/", "ThirdParty/", "external/", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.bundle.js"]
PRUNED = [
    ".git", ".vs", ".idea", ".nuget", "bin", "obj", "node_modules", "artifacts", "graphify-out",
    ".gradle", "Pods", ".expo", ".next", ".angular", ".dart_tool", "DerivedData", "__pycache__", ".venv", "venv", ".terraform", "dist",
]
# Kept while reading, as coverage reports lie there, but no source.
NOT_SOURCE = ["TestResults"]
# A folder of a package cache: its name ends with a version.
_CACHED = r"(?i)^(.*/)?packages/[a-z0-9_.-]+\.\d+(\.\d+)+([-+][a-z0-9.-]+)?/"


def glob_pattern(glob: str) -> str:
    """** any depth, * and ? within a folder; a pattern without a slash matches at any depth; what lies below counts."""
    g = glob.replace("\\", "/")
    body = g.strip("/")
    out = "" if g.startswith("/") or "/" in body else "(?:.*/)?"
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"(?i)^{out}(?:/.*)?$"


def ignore_lines(content: str | None) -> list[str]:
    return [x.strip() for x in (content or "").split("\n") if x.strip() and not x.strip().startswith("#")]


def excluded(path: Column, globs: list[str] | None = None, defaults: bool = True) -> Column:
    """The last glob that matches decides; ! negates."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    out = F.lit(False)
    for g in [*(DEFAULT_GLOBS if defaults else []), *ignore_lines("\n".join(globs or []))]:
        out = F.when(p.rlike(glob_pattern(g.lstrip("!"))), not g.startswith("!")).otherwise(out)
    return out


def pruned(path: Column) -> Column:
    return F.arrays_overlap(F.transform(F.split(path, "/"), lambda s: F.lower(s)), F.array(*[F.lit(p.lower()) for p in PRUNED]))


def is_source(path: Column) -> Column:
    """Neither below a pruned folder nor below one that holds reports."""
    return ~pruned(path) & ~F.arrays_overlap(F.transform(F.split(path, "/"), lambda s: F.lower(s)), F.array(*[F.lit(p.lower()) for p in NOT_SOURCE]))


def without_caches(files: DataFrame) -> DataFrame:
    """files (path, ...) without those below a package cache: a folder `packages` that holds repositories.config or folders
    named by package and version. Any other folder `packages` is a repository's own and stays."""
    in_packages = F.regexp_extract("path", r"(?i)^((?:.*/)?packages)/", 1)
    telling = files.filter(F.col("path").rlike(_CACHED) | F.col("path").rlike(r"(?i)(^|/)packages/repositories\.config$"))
    caches = telling.select(F.lower(in_packages).alias("_cache")).distinct()
    return files.withColumn("_in", F.lower(in_packages)).join(caches, F.col("_in") == F.col("_cache"), "left_anti").drop("_in")


def contained(relative: Column) -> Column:
    """False for absolute paths and for those that climb out."""
    return ~(relative.rlike(r"^([/\\]|[A-Za-z]:)") | F.array_contains(F.split(relative, r"[/\\]"), ".."))


def read_workspace(spark: SparkSession, root: str, globs: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, content, length) of the files under root, text as UTF-8, without pruned and excluded paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "")
    df = files.select(path.alias("path"), "content", "length").filter(contained(F.col("path")) & ~pruned(F.col("path")) & ~excluded(F.col("path"), globs))
    df = without_caches(df)
    df = df.filter(F.col("length") <= most_bytes) if most_bytes else df
    return df.withColumn("content", F.decode("content", "UTF-8"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1, carriage returns cut."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).select("path", (F.col("line") + 1).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))
