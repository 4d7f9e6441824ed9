"""Rules over personal data, databases, coverage and old interfaces. Facts in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ladder, sensitive_category
from ..operators.latest import latest_per_key

# Severities of fields and leaks of personal data, and categories whose leak is a step worse.
FIELD_RULES = {"identifier": 2, "contact": 1, "financial": 3, "health": 3, "credential": 2, "birth": 1}
LEAK_RULES = {"pii.leak.log": ("privacy.leak.log", 3), "pii.leak.exception": ("privacy.leak.exception", 2)}
WORSE = ["financial", "health", "credential"]
# From how many procedures, cursors and branches on there is a finding, and the share of lines that must be covered.
PROCEDURES, CURSORS, BRANCHES, COVERED = 20, 5, 10, 0.5


def _owner(symbol: Column) -> Column:
    return F.when(F.instr(symbol, ".") > 1, F.regexp_replace(symbol, r"\.[^.]*$", "")).otherwise(symbol)


def privacy_fields(patterns: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, line, type, category, members) of patterns (pattern_id, file_path, line, symbol) named
    pii.field.<category>: one finding a type and category, at its first place by path, with the distinct members in order."""
    df = patterns.withColumn("category", F.regexp_extract("pattern_id", r"^pii\.field\.(.+)$", 1)).filter(F.col("category").isin(list(FIELD_RULES)))
    df = df.withColumns({"type": _owner(F.col("symbol")), "member": F.regexp_replace("symbol", r"^.*\.", "")})
    per = df.groupBy("type", "category").agg(F.min(F.struct("file_path", "line")).alias("at"), F.array_sort(F.collect_set("member")).alias("members"))
    severity = ladder([(F.col("category") == c, s) for c, s in FIELD_RULES.items()])
    return per.select(F.concat(F.lit("privacy.pii."), "category").alias("rule_id"), severity.alias("severity"), "at.file_path", "at.line", "type", "category", "members")


def privacy_leaks(patterns: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, line, symbol, category) of leaks, one a fact; patterns have a detail that ends with
    [category]."""
    category = F.when(F.col("detail").contains("["), F.regexp_replace(F.regexp_replace("detail", r"^.*\[", ""), r"\]+$", "")).otherwise("unknown")
    worse = F.lit(False)
    for c in WORSE:
        worse = worse | F.col("detail").contains(f"[{c}]")
    rule = ladder([(F.col("pattern_id") == p, r) for p, (r, _) in LEAK_RULES.items()])
    base = ladder([(F.col("pattern_id") == p, s) for p, (_, s) in LEAK_RULES.items()])
    return patterns.withColumn("rule_id", rule).filter("rule_id is not null").select("rule_id", F.least(base + worse.cast("int"), F.lit(4)).alias("severity"), "file_path", "line", "symbol", category.alias("category"))


def database_findings(objects: DataFrame, routines: DataFrame, columns: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, line, symbol) of the database rules.

    objects: path, kind, name, line; routines: path, kind, name, line, complexity, cursors, dynamic_sql; columns: path, table,
    column, line; files: path (all files of the workspace); packages: name.
    """
    none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda df, rule, severity, symbol, path=F.col("path"), line=F.col("line"): df.select(F.lit(rule).alias("rule_id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), path.alias("file_path"), line.cast("int").alias("line"), symbol.alias("symbol"))
    p = F.lower("path")
    f = files.select("path").agg(
        F.count_if(p.endswith(".sql")).alias("sql"), F.count_if(p.endswith(".edmx")).alias("edmx"), F.count_if(p.endswith(".dbml")).alias("dbml"), F.count_if(p.endswith(".sqlproj")).alias("sqlproj"),
        F.count_if(p.rlike(r"/migrations/.*\.cs$") & ~p.rlike(r"\.designer\.cs$|modelsnapshot\.cs$")).alias("migrations"), F.count_if(F.col("path").rlike(r"(^|/)V[^/]*__[^/]*\.sql$")).alias("versioned"),
    )
    o = objects.agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "procedure").alias("procedures"))
    r = routines.agg(F.coalesce(F.sum("cursors"), F.lit(0)).alias("cursors"))
    m = packages.agg(F.count_if(F.lower("name").rlike(r"fluentmigrator|dbup|evolve|roundhouse|grate|yuniql")).alias("tools"))
    # One row each, so their product is one row.
    totals = f.join(o, F.lit(True)).join(r, F.lit(True)).join(m, F.lit(True)).filter(F.col("sql") + F.col("edmx") + F.col("dbml") + F.col("migrations") > 0)
    category = sensitive_category(F.col("column"))
    personal = columns.withColumn("category", category).filter("category is not null").groupBy("table", "category").agg(F.min_by(F.struct("path", "line"), F.struct("line", "path")).alias("at"))
    parts = [
        row(totals, "database.inventory", 0, F.lit("database"), none, no_line),
        row(totals.filter((F.col("procedures") >= PROCEDURES) | (F.col("cursors") >= CURSORS)), "database.logic-in-procedures", 2, F.lit("database.procedures"), none, no_line),
        row(totals.filter("tables > 0 and migrations = 0 and sqlproj = 0 and tools = 0 and versioned = 0"), "database.unversioned-schema", 2, F.lit("database.schema"), none, no_line),
        row(objects.filter("kind = 'trigger'"), "database.trigger", 1, F.col("name")),
        row(routines.filter("dynamic_sql"), "database.dynamic-sql", 3, F.concat_ws(":", "kind", "name")),
        row(routines.filter((F.col("kind") != "trigger") & (F.col("complexity") >= BRANCHES)), "database.complex-routine", 2, F.concat_ws(":", "kind", "name")),
        row(files.filter(p.endswith(".edmx")), "database.edmx-model", 3, F.element_at(F.split("path", "/"), -1), line=no_line),
        row(files.filter(p.endswith(".dbml")), "database.linq-to-sql", 3, F.element_at(F.split("path", "/"), -1), line=no_line),
        row(personal, "database.pii-column", F.when(F.col("category").isin("health", "financial"), 3).otherwise(2), F.concat_ws("#", "table", "category"), F.col("at.path"), F.col("at.line")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def old_interfaces(patterns: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, api, line, lines) of patterns api.legacy and api.obsolete (pattern_id, file_path, line,
    detail): one finding a file and interface, whose name stands before the detail's first colon."""
    df = patterns.filter(F.col("pattern_id").isin("api.legacy", "api.obsolete")).withColumn("api", F.trim(F.split("detail", ":")[0]))
    per = df.groupBy("pattern_id", "file_path", "api").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return per.select(F.concat(F.lit("quality."), "pattern_id").alias("rule_id"), F.when(F.col("pattern_id") == "api.legacy", 2).otherwise(1).alias("severity"), "file_path", "api", F.col("lines")[0].alias("line"), "lines")


def coverage_findings(reports: DataFrame, packages: DataFrame) -> DataFrame:
    """(rule_id, severity, file_path, symbol, line_rate) from reports (path, line_rate) and packages (path, package, line_rate).

    Reports of the same rates, to four places, are one, the first by path. Without any report the data is unknown, not zero.
    """
    told = packages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("package", F.round("line_rate", 4).alias("r")))).alias("p"))
    distinct = reports.join(told, "path", "left").withColumns({"p": F.coalesce(F.to_json("p"), F.lit("")), "r": F.round("line_rate", 4)})
    kept = latest_per_key(distinct, ["r", "p"], [F.col("path")])
    row = lambda df, rule, severity, symbol, path, rate: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), path.alias("file_path"), symbol.alias("symbol"), rate.cast("double").alias("line_rate"))
    nothing = reports.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    low = packages.filter(F.col("line_rate") < COVERED).join(kept.select("path"), "path", "left_semi")
    none = F.lit(None)
    out = row(nothing, "quality.coverage.no-data", 0, F.lit("estate"), none.cast("string"), none)
    out = out.unionByName(row(kept, "quality.coverage.summary", 0, F.lit("overall"), F.col("path"), F.col("line_rate")))
    return out.unionByName(row(low, "quality.coverage.low", 2, F.col("package"), F.col("path"), F.col("line_rate")))
