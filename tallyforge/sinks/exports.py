"""Exports: CSV with guarded cells, JSON, SARIF, SBOM and a Markdown summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import csv_guard, sarif_level

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def guarded(df: DataFrame, chars: str = "=+@-") -> DataFrame:
    """String columns safe to open in a spreadsheet."""
    return df.select(*[csv_guard(F.col(c), chars).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, chars: str = "=+@-", mark: bool = False) -> None:
    """Files with a header below path. mark: each begins with a byte-order mark, by which spreadsheets know UTF-8."""
    out = guarded(df, chars)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One SARIF result a row (`value`): level, rule index, location, baseline state, suppression.

    Rule indexes come from the rules alone, a small table; results stay a table and are joined to it by rule.
    """
    indexed = rules.select("rule_id").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)
    state = F.when(F.col("outcome") == "new", "new").when(F.col("outcome") == "resolved", "absent").otherwise("unchanged")
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    location = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    suppressed = F.when(F.col("status").isin("Suppressed", "FalsePositive"), F.array(F.struct(F.lit("external").alias("kind"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), location.alias("locations"), state.alias("baselineState"), suppressed.alias("suppressions"))
    return findings.join(indexed, "rule_id").select("rule_id", "rule_index", F.to_json(result).alias("value"))


def sarif_document(findings: DataFrame, rules: DataFrame, tool: str, most: int | None = None) -> str:
    """A whole document on the driver, for a consumer that needs one; sarif_results is the way for many. most: only the gravest
    results, for readers that take no more."""
    top = findings.orderBy(F.desc("severity"), "rule_id", "file_path").limit(most) if most else findings
    results = [r[0] for r in sarif_results(top, rules).orderBy("rule_index").select("value").collect()]
    ids = [r[0] for r in rules.select("rule_id").distinct().orderBy("rule_id").collect()]
    import json

    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": i} for i in ids]}}, "results": [json.loads(r) for r in results]}]})


# Package-URL types of ecosystems.
PURL = {"nuget": "nuget", "npm": "npm", "pypi": "pypi", "maven": "maven"}


def sbom_components(packages: DataFrame) -> DataFrame:
    """(purl, value): a CycloneDX component a row; a licence of one identifier by id, anything else as an expression."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in PURL.items() for x in kv])[F.lower("ecosystem")], F.lower("ecosystem"))
    name = F.when(kind == "maven", F.replace("name", F.lit(":"), F.lit("/"))).otherwise(F.replace("name", F.lit("@"), F.lit("%40")))
    purl = F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), "version")
    single = F.col("license").rlike(r"^[A-Za-z0-9.+-]+$")
    lic = F.when(F.col("license").isNotNull(), F.array(F.struct(F.when(single, F.struct(F.col("license").alias("id"))).alias("license"), F.when(~single, F.col("license")).alias("expression"))))
    comp = F.struct(F.lit("library").alias("type"), purl.alias("bom-ref"), F.col("name"), F.col("version"), purl.alias("purl"), lic.alias("licenses"))
    return packages.select("ecosystem", "name", "version", "license").distinct().select(purl.alias("purl"), F.to_json(comp).alias("value"))


# The columns of the findings file, in order.
FINDING_COLUMNS = ["id", "rule_id", "category", "severity", "confidence", "status", "title", "message", "file_path", "line_start", "line_end", "symbol", "first_seen", "last_seen", "remediation"]


def finding_rows(findings: DataFrame) -> DataFrame:
    """The columns of the findings file, guarded; one that findings lacks is empty."""
    return guarded(findings.select(*[(F.col(c) if c in findings.columns else F.lit(None).cast("string")).alias(c) for c in FINDING_COLUMNS]))


def compliance_files(findings: DataFrame, licenses: DataFrame, waivers: DataFrame, path: str, mark: bool = False) -> None:
    """summary.md and three guarded CSV folders below path: open privacy findings, licence findings, waivers with their
    policies. The summary counts each. mark: as in write_csv."""
    parts = {"privacy": findings.filter("rule_id like 'privacy.%' and status in ('Open', 'Regressed')"), "licenses": licenses, "waivers": waivers}
    lines = ["# Compliance", ""]
    for name, df in parts.items():
        write_csv(df, f"{path}/{name}.csv", mark=mark)
        lines.append(f"- {name}: {df.count()}")
    spark = findings.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/summary.md")


def markdown_summary(gate: DataFrame, top: DataFrame, key: str, dimensions: DataFrame | None = None, rules: DataFrame | None = None, most: int = 10) -> list[str]:
    """Lines of a summary from small aggregates: gate verdicts (key, passed, reasons) and top rules; what health.dimension_deltas and
    health.rule_deltas tell of one run, where they are given, `most` rules of each kind."""
    out = ["| | verdict | reasons |", "|-|-|-|"]
    out += [f"| {r[key]} | {'passed' if r['passed'] else 'failed'} | {'; '.join(r['reasons'])} |" for r in gate.orderBy(key).collect()]
    if dimensions is not None:
        shown = lambda n: "–" if n is None else f"{n:+d}"
        out += ["", "| dimension | before | after | change |", "|-|-|-|-|"]
        out += [f"| {r['dimension']} | {'–' if r['before'] is None else r['before']} | {r['after']} | {shown(r['delta'])} |" for r in dimensions.collect()]
    out += ["", "| rule | findings | worst |", "|-|-|-|"]
    out += [f"| {r['rule_id']} | {r['n']} | {r['max_severity']} |" for r in top.collect()]
    if rules is not None:
        w = Window.partitionBy("kind").orderBy(F.desc("max_severity"), F.desc("n"), "rule_id")
        few = rules.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).orderBy("kind", "_r")
        out += ["", "| change | rule | findings | where |", "|-|-|-|-|"]
        out += [f"| {r['kind']} | {r['rule_id']} | {r['n']} | {', '.join(r['locations'])} |" for r in few.collect()]
    return out


def replace_window(spark, new: DataFrame, table: str, partition: str = "period") -> None:
    """Delete-then-insert of the days that `new` holds, by dynamic partition overwrite."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
