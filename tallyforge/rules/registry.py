"""Scanners as data: each names its rules and turns facts into candidates of one schema, so that a family of rules is added without
touching the others. Facts come from parsers, which are registered alike and run where a scanner first asks for them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.portfolio import merged_candidates
from ..sources import code_text, documents, manifests
from . import data_rules, duplication, estate_rules, fact_rules, platform_rules, text_rules

SCHEMA = "rule_id string, severity int, file_path string, line int, symbol string"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: int


@dataclass(frozen=True)
class Scanner:
    """rules: every rule that it may emit; an id that ends with * stands for all that begin so."""

    id: str
    rules: list[Rule]
    scan: Callable[[Facts], DataFrame]


@dataclass
class Facts:
    """Tables of facts over files (path, content). A table that is given stands; others come from the parser of their name, once."""

    files: DataFrame
    given: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.given:
            if name not in PARSERS:
                raise KeyError(f"no parser gives {name}")
            self.given[name] = PARSERS[name](self)
        return self.given[name]

    def of_udtf(self, parser, columns: Iterable[str] = ("path", "content")) -> DataFrame:
        """path and what a Python table function (path, content -> rows) yields for each file."""
        return self.files.lateralJoin(parser(*[F.col(c).outer() for c in columns])).drop("content")


PARSERS: dict[str, Callable[[Facts], DataFrame]] = {
    "code": lambda f: code_text.code_facts(f.files),
    "npm_dependencies": lambda f: documents.npm_dependencies(f.files),
    "maven_modules": lambda f: documents.maven_modules(f.files),
    "script_tags": lambda f: text_rules.script_tags(f.files.filter(F.col("path").rlike(r"(?i)\.(cshtml|aspx|ascx|master|html|vbhtml)$"))),
    "python_packages": lambda f: reduce(DataFrame.unionByName, [t.select("path", "name", "version", "pinned") for t in (documents.python_requirements(f.files), manifests.pyproject_dependencies(f.files), manifests.pipfile_dependencies(f.files), manifests.setup_dependencies(f.files))]),
    "python_requires": lambda f: platform_rules.python_requires(f.files),
    "packages": lambda f: manifests.package_facts(("npm", manifests.npm_packages(f.files)), ("pypi", f["python_packages"]), ("maven", documents.maven_dependencies(f.files)), ("maven", documents.gradle_dependencies(f.files)), ("nuget", manifests.project_packages(f.files))),
    "segments": lambda f: f.files.sparkSession.createDataFrame([], "id string, ecosystem string, name string, introduced string, fixed string, last_affected string, vector string"),
    "sql_columns": lambda f: documents.sql_columns(f.files),
}


def candidates(df: DataFrame) -> DataFrame:
    """df in the one schema; what it lacks is null."""
    kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _code(f: Facts) -> DataFrame:
    methods = f["code"].filter("kind = 'method'").withColumnRenamed("path", "file_path")
    patterns = f["code"].filter("kind = 'pattern'").select("rule_id", F.lit(2).alias("severity"), F.col("path").alias("file_path"), "line", "symbol")
    return candidates(fact_rules.complexity(methods)).unionByName(candidates(patterns))


def _java(f: Facts) -> DataFrame:
    jdk = estate_rules.old_jdk(f["maven_modules"].select("path", "jdk")).select(F.lit("java.jdk.eol").alias("rule_id"), "severity", F.col("path").alias("file_path"), F.concat(F.lit("jdk:"), "path").alias("symbol"))
    coordinates = f["packages"].filter("ecosystem = 'maven'").select("path", F.col("name").alias("coordinate"), "version")
    legacy = estate_rules.legacy_frameworks(coordinates, estate_rules.LEGACY_JAVA, "java").select("rule_id", "severity", F.col("path").alias("file_path"), F.concat(F.lit("java:"), "name").alias("symbol"))
    parts = [platform_rules.java_footprint(f["maven_modules"], f.files), jdk, legacy, platform_rules.vulnerable(f["packages"], f["segments"], "maven", "java.vulnerable-dependency")]
    return reduce(DataFrame.unionByName, map(candidates, parts))


def _python(f: Facts) -> DataFrame:
    floor = estate_rules.python_floor(f["python_requires"]).select(F.lit("python.interpreter.eol").alias("rule_id"), "severity", F.col("path").alias("file_path"), F.concat(F.lit("python:"), "path").alias("symbol"))
    coordinates = f["python_packages"].select("path", F.col("name").alias("coordinate"), "version")
    legacy = estate_rules.legacy_frameworks(coordinates, estate_rules.LEGACY_PYTHON, "python").select("rule_id", "severity", F.col("path").alias("file_path"), F.concat(F.lit("python:"), "name").alias("symbol"))
    parts = [platform_rules.python_footprint(f["python_packages"], f["python_requires"], f.files), floor, legacy, platform_rules.vulnerable(f["packages"], f["segments"], "pypi", "python.vulnerable-dependency")]
    return reduce(DataFrame.unionByName, map(candidates, parts))


def _privacy(f: Facts) -> DataFrame:
    return fact_rules.personal_data(f["sql_columns"]).select(F.concat(F.lit("privacy.pii."), "category").alias("rule_id"), F.lit(2).alias("severity"), F.col("table").alias("symbol"))


_line_rule_ids = sorted({r for r, *_ in text_rules.LINE_RULES})
SCANNERS = [
    Scanner("containers", [Rule("infra.docker.*", "Security", 2), Rule("infra.compose.*", "Security", 3)], lambda f: candidates(text_rules.docker(f.files)).unionByName(candidates(text_rules.compose(f.files)))),
    Scanner("settings", [Rule("infra.appsettings.*", "Security", 1)], lambda f: text_rules.settings(f.files)),
    Scanner("lines", [Rule(r, "Security", 2) for r in _line_rule_ids], lambda f: text_rules.line_rules(f.files)),
    Scanner("code", [Rule("quality.complexity.method", "Quality", 2), Rule("sec.crypto.weak-hash", "Security", 2), Rule("sec.sql.string-concatenation", "Security", 2)], _code),
    Scanner("duplication", [Rule("quality.duplication.block", "Quality", 1)], lambda f: duplication.duplication_findings(duplication.copied_blocks(f.files.filter(F.col("path").rlike(r"(?i)\.(cs|vb|java|py|js|ts|sql)$")).select("path", "content")))),
    Scanner("java", [Rule("java.*", "Modernization", 2)], _java),
    Scanner("python", [Rule("python.*", "Modernization", 2)], _python),
    Scanner("front-end", [Rule("javascript.inventory", "Quality", 0), Rule("javascript.legacy-framework", "Modernization", 2)], lambda f: platform_rules.front_end_findings(platform_rules.front_end_uses(f["npm_dependencies"], f["script_tags"]), f.files)),
    Scanner("privacy", [Rule("privacy.pii.*", "Data", 2)], _privacy),
]


def catalog(files: DataFrame, scanners: list[Scanner]) -> DataFrame:
    """(scanner, rule_id, category, severity) of all rules that may come."""
    return files.sparkSession.createDataFrame([(s.id, r.id, r.category, r.severity) for s in scanners for r in s.rules], "scanner string, rule_id string, category string, severity int")


def run(facts: Facts, scanners: list[Scanner] | None = None) -> DataFrame:
    """(scanner, rule_id, severity, file_path, line, symbol, declared) of every scanner's candidates, in one plan. declared tells whether
    the scanner names the rule; fact_rules and reconciliation expect that all are."""
    out = None
    for s in scanners if scanners is not None else SCANNERS:
        declared = F.lit(False)
        for r in s.rules:
            declared |= F.col("rule_id").startswith(r.id[:-1]) if r.id.endswith("*") else F.col("rule_id") == r.id
        one = candidates(s.scan(facts)).select(F.lit(s.id).alias("scanner"), "*", declared.alias("declared"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return facts.files.sparkSession.createDataFrame([], f"scanner string, {SCHEMA}, declared boolean")
    return out


#: Sources of candidates for business rules: facts -> (score, file_path, start_line, snippet).
CandidateSource = Callable[[Facts], DataFrame]


def method_candidates(f: Facts) -> DataFrame:
    """Methods of code text by their complexity."""
    m = f["code"].filter("kind = 'method' and complexity > 1")
    return m.select(F.col("complexity").cast("double").alias("score"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("symbol").alias("snippet"))


def routine_candidates(f: Facts) -> DataFrame:
    """Database routines by their branches, with weight for text that they put together."""
    r = manifests.sql_routines(f.files).filter("complexity > 1")
    return r.select((F.col("complexity") + F.when(F.col("dynamic_sql"), 2).otherwise(0)).cast("double").alias("score"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("name").alias("snippet"))


CANDIDATE_SOURCES: dict[str, CandidateSource] = {"methods": method_candidates, "routines": routine_candidates}


def business_candidates(facts: Facts, most: int, sources: dict[str, CandidateSource] | None = None) -> DataFrame:
    """(score, file_path, start_line, snippet, source): the best of all sources."""
    named = [s(facts).withColumn("source", F.lit(name)) for name, s in (CANDIDATE_SOURCES if sources is None else sources).items()]
    return merged_candidates(named, most)
