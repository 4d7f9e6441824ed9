"""Blockers, legacy frameworks and AI use on small tables."""

from tallyforge.rules import estate_rules as er


def test_migration_blockers(spark):
    p = spark.createDataFrame([("a", False, ["EntityFramework", "Microsoft.AspNet.WebApi.Client"], ["System.Web", "System.Workflow.Runtime"], 3), ("b", True, ["Microsoft.AspNet.WebApi.Core"], None, 0)], "path string, is_sdk_style boolean, packages array<string>, assemblies array<string>, packages_config int")
    got = {(r.path, r.rule_id[-6:]) for r in er.migration_blockers(p).collect()}
    assert got == {("a", "mb-001"), ("a", "mb-002"), ("a", "mb-003"), ("a", "mb-006"), ("a", "mb-009"), ("b", "mb-005")}


def test_legacy_frameworks(spark):
    m = spark.createDataFrame([("m1", "Log4j:log4j", "1.2.17"), ("m2", "log4j:log4j", "1.2"), ("m1", "org.springframework:spring-core", "${v}"), ("m1", "org.hibernate:hibernate-core", "4.3")], "path string, coordinate string, version string")
    assert {(r.name, r.path) for r in er.legacy_frameworks(m, er.LEGACY_JAVA, "java").collect()} == {("Log4j 1.x", "m1"), ("Hibernate ORM 4.x or older", "m1")}
    p = spark.createDataFrame([("r", "django", "1.11"), ("s", "django", "2.2"), ("s", "nose", None)], "path string, coordinate string, version string")
    assert {(r.name, r.severity) for r in er.legacy_frameworks(p, er.LEGACY_PYTHON, "python").collect()} == {("Django 1.x", 3), ("Django 2.x", 2), ("nose", 2)}


def test_platform_floors(spark):
    j = spark.createDataFrame([("a", "1.8"), ("b", "11"), ("c", "17")], "path string, jdk string")
    assert {(r.path, r.severity) for r in er.old_jdk(j).collect()} == {("a", 3), ("b", 2)}
    q = spark.createDataFrame([("a", ">=2.7"), ("b", ">=3.8,<4"), ("c", ">=3.12"), ("d", None)], "path string, requires string")
    assert {(r.path, r.severity) for r in er.python_floor(q).collect()} == {("a", 3), ("b", 2)}
    i = spark.createDataFrame([("a", "javax.servlet.http.X"), ("a", "javax.persistence.Y"), ("b", "java.util.List")], "path string, name string")
    assert [(r.path, r.groups) for r in er.javax_modules(i).collect()] == [("a", ["javax.persistence", "javax.servlet"])]


def test_ai_use(spark):
    p = spark.createDataFrame([("a", "openai"), ("a", "@langchain/core"), ("b", "ollama-js"), ("b", "left-pad")], "path string, name string")
    found = er.ai_packages(p)
    assert {(r.name, r.kind) for r in found.collect()} == {("openai", "sdk"), ("@langchain/core", "framework"), ("ollama-js", "local-runtime")}
    assert {r.name for r in er.unapproved_providers(found, ["langchain"]).collect()} == {"openai"} and er.unapproved_providers(found, None).count() == 0
    f = spark.createDataFrame([("a", "privacy.pii.email", "Open"), ("a", "secrets.aws", "Resolved")], "path string, rule_id string, status string")
    r = {x.path: x for x in er.estate_rollup(found, f, "path").collect()}
    assert r["a"].providers == ["openai"] and r["a"].personal_data == 1 and r["a"].secrets == 0
