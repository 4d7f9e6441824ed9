"""Java, Python and front-end platforms of an estate: footprints, old interpreters and frameworks, vulnerable pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import jdk_major
from ..operators.latest import latest_per_key
from .fact_rules import vulnerable_packages

# Front-end packages with the name that they are shown by, and whether they are out of maintenance.
FRAMEWORKS = [
    ("react", "React", False), ("vue", "Vue", False), ("@angular/core", "Angular", False), ("svelte", "Svelte", False), ("next", "Next.js", False),
    ("jquery", "jQuery", False), ("angular", "AngularJS 1.x", True), ("knockout", "Knockout", True), ("backbone", "Backbone", True),
    ("ember-source", "Ember", False), ("bootstrap", "Bootstrap", False), ("moment", "Moment.js (deprecated)", True), ("kendo-ui", "Kendo UI", False),
    ("@microsoft/signalr", "SignalR", False), ("typescript", "TypeScript", False), ("webpack", "webpack", False), ("vite", "Vite", False),
    ("gulp", "gulp", True), ("grunt", "Grunt", True), ("bower", "Bower", True),
]
# What an old script's address holds, and what the beginning of its file name says it is.
OLD_SCRIPTS = ["jquery-1.", "jquery-2.", "jquery.min.js", "angular.js", "angular.min.js", "knockout", "backbone", "prototype.js", "mootools", "dojo.js", "ext-all", "microsoftajax"]
SCRIPT_NAMES = [
    ("jquery-1.", "jQuery 1.x/2.x"), ("jquery-2.", "jQuery 1.x/2.x"), ("jquery", "jQuery (bundled)"), ("angular", "AngularJS 1.x"), ("knockout", "Knockout"), ("backbone", "Backbone"),
    ("prototype", "Prototype.js"), ("mootools", "MooTools"), ("dojo", "Dojo"), ("ext-all", "ExtJS (legacy bundle)"), ("microsoftajax", "ASP.NET AJAX (MicrosoftAjax)"),
]
OLD_JQUERY = "jQuery 1.x/2.x"


def _footprint(rule: str, symbol: str, counts: DataFrame, path: Column, something: Column) -> DataFrame:
    """One finding with its counts as a map, where there is something to count."""
    data = F.create_map(*[x for c in counts.columns if c != "first" for x in (F.lit(c), F.col(c).cast("string"))])
    return counts.filter(something).select(F.lit(rule).alias("rule_id"), F.lit(0).alias("severity"), path.alias("file_path"), F.lit(symbol).alias("symbol"), data.alias("data"))


def _joined(values: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(values)), ", "), F.lit("")), F.lit("—"))


def java_footprint(modules: DataFrame, files: DataFrame) -> DataFrame:
    """java.inventory: how many modules (path, name, jdk) and .java files there are, and the JDKs asked for."""
    jdk = F.format_string("%02d", jdk_major(F.col("jdk")))
    m = modules.agg(F.count(F.lit(1)).alias("modules"), _joined(jdk).alias("jdks"), F.min("path").alias("first"))
    n = files.filter(F.lower("path").endswith(".java")).agg(F.count(F.lit(1)).alias("files"))
    jdks = F.regexp_replace("jdks", r"\b0(\d)", "$1")
    return _footprint("java.inventory", "java-platform", m.join(n, F.lit(True)).withColumn("jdks", jdks), F.col("first"), (F.col("modules") > 0) | (F.col("files") > 0))


def python_footprint(packages: DataFrame, requires: DataFrame, files: DataFrame) -> DataFrame:
    """python.inventory: distinct packages (path, name), the manifests that name them, .py files, and the interpreters asked for in
    requires (path, requires)."""
    p = packages.agg(F.countDistinct("name").alias("packages"))
    manifests = packages.select("path").unionByName(requires.select("path"))
    m = manifests.agg(F.countDistinct("path").alias("manifests"), F.min("path").alias("first"))
    t = requires.agg(_joined(F.nullif(F.trim("requires"), F.lit(""))).alias("targets"))
    n = files.filter(F.lower("path").endswith(".py")).agg(F.count(F.lit(1)).alias("files"))
    return _footprint("python.inventory", "python-platform", p.join(m, F.lit(True)).join(n, F.lit(True)).join(t, F.lit(True)), F.col("first"), (F.col("manifests") > 0) | (F.col("files") > 0))


def front_end_uses(dependencies: DataFrame, tags: DataFrame) -> DataFrame:
    """(path, name, legacy): front-end frameworks in manifests (path, section, name, version) and script tags (path, src).

    jQuery is old below 3 by its own version; whatever stands in bower.json is. A tag counts by an old script's address, or as jQuery.
    """
    known = dependencies.sparkSession.createDataFrame(FRAMEWORKS, "key string, shown string, old boolean")
    d = dependencies.filter(F.col("section").isin("dependencies", "devDependencies")).join(known, F.lower("name") == F.col("key"))
    old_jquery = (F.col("key") == "jquery") & F.ltrim(F.coalesce("version", F.lit("")), F.lit("^~=v")).rlike(r"^[12]\.")
    named = d.select("path", F.when(old_jquery, OLD_JQUERY).otherwise(F.col("shown")).alias("name"), (F.col("old") | old_jquery | F.lower("path").endswith("bower.json")).alias("legacy"))
    src, file = F.lower("src"), F.regexp_extract(F.lower("src"), r"([^/\\]*)$", 1)
    old = F.lit(False)
    for part in OLD_SCRIPTS:
        hit = src.rlike(r"jquery-[12]\.\d") if part.startswith("jquery-") else F.contains(src, F.lit(part))
        old |= hit
    shown = F.coalesce(*[F.when(file.startswith(p), F.lit(n)) for p, n in SCRIPT_NAMES], file)
    scripts = tags.filter(old | F.contains(src, F.lit("jquery"))).select("path", F.when(old, shown).otherwise("jQuery").alias("name"), old.alias("legacy"))
    return named.unionByName(scripts)


def _scripts(files: DataFrame) -> DataFrame:
    """Files of scripts that are an estate's own."""
    p = F.concat(F.lit("/"), F.lower("path"))
    library = p.rlike(r"/(node_modules|bower_components|wwwroot/lib|scripts/lib|dist|vendor|typings)/") | p.rlike(r"\.(min|bundle)\.js$|\.d\.ts$") | p.rlike(r"/jquery(\.js|-[^/]*|\.(\d|ui|min|slim|migrate|validate|unobtrusive|signalr)[^/]*)$")
    return files.filter(p.rlike(r"\.(js|ts|jsx|tsx|mjs)$") & ~library)


def front_end_findings(uses: DataFrame, files: DataFrame) -> DataFrame:
    """javascript.inventory once, and javascript.legacy-framework for each framework that is old anywhere, at its first path, with how
    many files and uses it has. files: path."""
    per = uses.groupBy("name").agg(F.max("legacy").alias("legacy"), F.min(F.lower("path")).alias("_low"), F.min_by("path", F.lower("path")).alias("first"), F.countDistinct(F.lower("path")).alias("files"), F.count(F.lit(1)).alias("uses"))
    n = _scripts(files).agg(F.count(F.lit(1)).alias("files"))
    m = files.filter(F.lower("path").rlike(r"(^|/)(package|bower)\.json$")).agg(F.count(F.lit(1)).alias("manifests"))
    names = per.agg(_joined(F.col("name")).alias("frameworks"), _joined(F.when(F.col("legacy"), F.col("name"))).alias("legacyFrameworks"))
    inventory = _footprint("javascript.inventory", "frontend", n.join(m, F.lit(True)).join(names, F.lit(True)), F.lit(None).cast("string"), (F.col("files") > 0) | (F.col("manifests") > 0) | (F.col("frameworks") != "—"))
    data = F.create_map(F.lit("name"), F.col("name"), F.lit("files"), F.col("files").cast("string"), F.lit("count"), F.col("uses").cast("string"))
    old = per.filter("legacy").select(F.lit("javascript.legacy-framework").alias("rule_id"), F.lit(2).alias("severity"), F.col("first").alias("file_path"), F.concat(F.lit("frontend:"), "name").alias("symbol"), data.alias("data"))
    return inventory.unionByName(old)


def vulnerable(packages: DataFrame, segments: DataFrame, ecosystem: str, rule: str) -> DataFrame:
    """(rule_id, severity, file_path, symbol, data) of one ecosystem's pins (ecosystem, path, name, version, pinned) that lie in a vulnerable
    segment: each name and version once, at its first path. Only literal versions are judged."""
    literal = packages.filter((F.lower("ecosystem") == ecosystem.lower()) & F.col("version").rlike(r"^[0-9]") & ~F.col("version").rlike(r"[*$]"))
    literal = (literal.filter("pinned") if "pinned" in literal.columns else literal).withColumn("name", F.lower("name"))
    once = latest_per_key(literal, ["name", "version"], [F.col("path")])
    s = segments.filter(F.lower("ecosystem") == ecosystem.lower()).withColumn("ecosystem", F.lit(ecosystem))
    hits = vulnerable_packages(once.withColumn("ecosystem", F.lit(ecosystem)), s)
    data = F.create_map(F.lit("package"), F.col("name"), F.lit("version"), F.col("version"), F.lit("vulnerability"), F.col("id"))
    return hits.join(once.select("name", "version", "path"), ["name", "version"]).select(F.lit(rule).alias("rule_id"), "severity", F.col("path").alias("file_path"), F.concat("name", F.lit("@"), "version", F.lit(":"), "id").alias("symbol"), data.alias("data"))


def python_requires(files: DataFrame) -> DataFrame:
    """(path, requires): the interpreters that manifests ask for, of those that ask."""
    pattern = [(r"(^|/)pyproject\.toml$", r"requires-python\s*=\s*[\"']([^\"']+)[\"']"), (r"(^|/)pyproject\.toml$", r"(?m)^python\s*=\s*[\"']([^\"']+)[\"']"), (r"(^|/)setup\.py$", r"python_requires\s*=\s*[\"']([^\"']+)[\"']"), (r"(^|/)Pipfile$", r"(?m)^python_version\s*=\s*[\"']([^\"']+)[\"']")]
    asked = F.coalesce(*[F.when(F.col("path").rlike(p), F.nullif(F.concat(F.lit(">=" if "Pipfile" in p else ""), F.regexp_extract("content", rx, 1)), F.lit(">=" if "Pipfile" in p else ""))) for p, rx in pattern])
    return files.select("path", asked.alias("requires")).filter("requires is not null")
