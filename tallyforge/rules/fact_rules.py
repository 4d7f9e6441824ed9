"""Rules over facts: tests, complexity, architecture, churn, packages, licences, frameworks, data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LICENSE_CLASSES, cvss_score, cvss_severity, license_class, path_normalize, sensitive_category
from ..functions.versions import in_segment, version_key
from ..operators import graph


def complexity(methods: DataFrame) -> DataFrame:
    """From 15 Medium, from 30 High."""
    return methods.filter("complexity >= 15").select(F.lit("quality.complexity.method").alias("rule_id"), F.when(F.col("complexity") >= 30, 3).otherwise(2).alias("severity"), "file_path", "line", "symbol")


def large_files(files: DataFrame, most: int = 1000) -> DataFrame:
    return files.filter(F.col("lines") > most).select(F.lit("quality.file.large").alias("rule_id"), F.lit(1).alias("severity"), F.col("relative_path").alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("symbol"))


def uncovered_projects(projects: DataFrame, references: DataFrame) -> DataFrame:
    """Projects (path, is_test) that no test project reaches through references (src, dst)."""
    reached = graph.reachable_from(references, projects.filter("is_test").select("path"))
    return projects.filter("not is_test").join(reached, F.col("path") == F.col("node"), "left_anti").select("path")


def cycles(edges: DataFrame) -> DataFrame:
    return graph.cycles(edges).groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))


def high_fan_out(edges: DataFrame, least: int = 10) -> DataFrame:
    return graph.degrees(edges).filter(F.col("fan_out") >= least).select("node", "fan_out")


def hotspots(edges: DataFrame, methods: DataFrame, fan_in: int = 3, hot: int = 3, complexity_from: int = 10) -> DataFrame:
    """Nodes with fan_in users and `hot` complex methods at least."""
    per = methods.filter(F.col("complexity") >= complexity_from).groupBy(F.col("project").alias("node")).agg(F.count(F.lit(1)).alias("hot_methods"))
    return graph.degrees(edges).join(per, "node").filter((F.col("fan_in") >= fan_in) & (F.col("hot_methods") >= hot)).select("node", "fan_in", "hot_methods")


def change_hotspots(churn: DataFrame, files: DataFrame) -> DataFrame:
    """Churn meets complexity by normalized path: 10 commits and complexity 15, High at twice either; silos of one author."""
    c = churn.withColumn("key", path_normalize(F.col("path")))
    f = files.select(path_normalize(F.col("relative_path")).alias("key"), "max_complexity")
    df = c.join(f, "key", "left")
    hot = (F.col("commits") >= 10) & (F.col("max_complexity") >= 15)
    severity = F.when((F.col("commits") >= 20) & (F.col("max_complexity") >= 30), 3).otherwise(2)
    a = df.filter(hot).select(F.lit("architecture.hotspot.change").alias("rule_id"), severity.alias("severity"), F.col("path").alias("file_path"))
    return a.unionByName(df.filter("commits >= 8 and authors = 1").select(F.lit("architecture.knowledge-silo").alias("rule_id"), F.lit(1).alias("severity"), F.col("path").alias("file_path")))


def untested_estate(projects: DataFrame, references: DataFrame) -> DataFrame:
    """(rule_id, path): quality.tests.none where no project is a test project, else the projects that no test reaches."""
    tests = projects.agg(F.count_if("is_test").alias("tests"), F.count(F.lit(1)).alias("n"))
    none = tests.filter("tests = 0 and n > 0").select(F.lit("quality.tests.none").alias("rule_id"), F.lit(None).cast("string").alias("path"))
    bare = uncovered_projects(projects, references).join(tests.filter("tests > 0").select(F.lit(True).alias("_")), F.lit(True)).select(F.lit("quality.tests.project-uncovered").alias("rule_id"), "path")
    return none.unionByName(bare)


def unresolved_references(references: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, symbol) of references (src, dst, resolved) to projects that are not in the workspace."""
    return references.filter("not resolved").select(F.lit("dependency.project-reference.unresolved").alias("rule_id"), F.lit(2).alias("severity"), F.col("src").alias("file_path"), F.col("dst").alias("symbol"))


def npm_inventory(locks: DataFrame) -> DataFrame:
    """(rule_id, file_path, packages, dev): one finding a lockfile, from npm_lock's rows."""
    return locks.groupBy("path").agg(F.count(F.lit(1)).alias("packages"), F.count_if("is_dev").alias("dev")).select(F.lit("dependency.npm.inventory").alias("rule_id"), F.col("path").alias("file_path"), "packages", "dev")


def syntax_errors(files: DataFrame) -> DataFrame:
    return files.filter("has_errors").select(F.lit("quality.file.syntax-error").alias("rule_id"), F.lit(1).alias("severity"), F.col("relative_path").alias("file_path"))


def version_conflicts(packages: DataFrame) -> DataFrame:
    """(name, versions) of packages used in several versions."""
    return packages.groupBy(F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("version")).alias("versions")).filter(F.size("versions") > 1)


def vulnerable_packages(packages: DataFrame, segments: DataFrame) -> DataFrame:
    """(name, version, id, score, severity): packages (ecosystem, name, version) inside a segment of osv_segments.

    Equality on ecosystem and name, then a comparison of order-preserving keys, made once for each distinct version. Where the table
    tells pins from ranges, only pins are judged: a range says nothing of what is installed.
    """
    packages = packages.filter("pinned") if "pinned" in packages.columns else packages
    p = packages.select("ecosystem", F.lower("name").alias("name"), "version").distinct().withColumn("k", version_key("version"))
    s = segments.withColumns({"i": version_key("introduced"), "f": version_key("fixed"), "l": version_key("last_affected")})
    hit = p.join(s, ["ecosystem", "name"]).filter(F.col("k").isNotNull() & in_segment(F.col("k"), F.col("i"), F.col("f"), F.col("l")))
    score = cvss_score(F.col("vector"))
    return hit.select("ecosystem", "name", "version", "id", score.alias("score"), F.when(score.isNull(), 2).otherwise(cvss_severity(score)).alias("severity")).distinct()


# Rule ids of the licence classes that are findings.
LICENSE_RULES = {"StrongCopyleft": "license.strong-copyleft", "WeakCopyleft": "license.weak-copyleft", "Restricted": "license.restricted", "Unknown": "license.unknown"}


def licenses(packages: DataFrame, denied: list[str]) -> DataFrame:
    """(name, version, license, class, rule_id): denied (by class, expression or a part) outranks the class; permissive
    licences are no findings and have no rule_id."""
    df = packages.select("name", "version", "license").distinct().withColumn("class", license_class(F.col("license")))
    low = [d.lower() for d in denied]
    parts = F.transform(F.split(F.lower("license"), r"\s+(?:or|and|with)\s+|[()]"), lambda x: F.trim(x))
    is_denied = F.lower("class").isin(low) | F.lower("license").isin(low) | F.arrays_overlap(parts, F.array(*map(F.lit, low or [""])))
    rule = F.when(F.coalesce(is_denied, F.lit(False)), "license.denied")
    for name, rule_id in LICENSE_RULES.items():
        rule = rule.when(F.col("class") == name, rule_id)
    return df.withColumn("rule_id", rule)


def license_counts(packages: DataFrame) -> DataFrame:
    """Counts by class, as the inventory shows them; classes without packages are there too."""
    spine = packages.sparkSession.createDataFrame([(c,) for c in LICENSE_CLASSES], "class string")
    return spine.join(licenses(packages, []).groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").fillna(0, ["n"])


def framework_support(projects: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """projects with rule_id by the end of support (framework, end_date, legacy) of the catalog: ended, ending within 183 days,
    supported but legacy, or not in the catalog; others are no findings."""
    catalog = catalog if "legacy" in catalog.columns else catalog.withColumn("legacy", F.lit(False))
    df = projects.join(catalog, F.lower("target_framework") == F.lower("framework"), "left")
    left = F.datediff("end_date", today)
    rule = F.when(F.col("framework").isNull(), "dependency.framework.unknown").when(left < 0, "dependency.framework.end-of-life").when(left <= 183, "dependency.framework.ending-soon").when(F.coalesce("legacy", F.lit(False)), "dependency.framework.legacy")
    return df.withColumn("rule_id", rule).filter("rule_id is not null").select("path", "target_framework", "rule_id")


def personal_data(columns: DataFrame) -> DataFrame:
    """(table, category, columns): columns (table, column) whose names tell of personal data."""
    return columns.withColumn("category", sensitive_category(F.col("column"))).filter("category is not null").groupBy("table", "category").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def owned_by_signature(packages: DataFrame, signatures: DataFrame) -> DataFrame:
    """packages with the longest signature (prefix, provider) that equals or begins their name.

    Distinct names meet the small signature table; max_by keeps the longest.
    """
    names = packages.select("name").distinct()
    hit = names.join(signatures, F.lower("name").startswith(F.lower("prefix"))).groupBy("name").agg(F.max_by("provider", F.length("prefix")).alias("provider"))
    return packages.join(hit, "name", "left")
