"""Scanners through one registry, platform rules, and a parser as a table function."""

import json

from pyspark.sql import functions as F

from tallyforge.rules import platform_rules, registry
from tallyforge.sources import documents

POM = "<project><artifactId>shop</artifactId><properties><java.version>1.8</java.version></properties><dependencies><dependency><groupId>log4j</groupId><artifactId>log4j</artifactId><version>1.2.17</version></dependency><dependency><groupId>g</groupId><artifactId>open</artifactId><version>[1,2)</version></dependency></dependencies></project>"
BLOCK = "\n".join(f"step {i}" for i in range(14))
FILES = {
    "pom.xml": POM,
    "b/pom.xml": POM.replace("1.8", "17"),
    "A.java": "class A {\n  void f() { " + "if (a) {} " * 16 + "}\n}\n",
    "requirements.txt": "django==1.11\nflask>=1\nopen==2.*\n",
    "pyproject.toml": '[project]\nrequires-python = ">=3.7"\ndependencies = [\n  "Django==1.11",\n]\n',
    "x.py": "import hashlib\ndef f():\n    return hashlib.new('md5')\n",
    "package.json": '{"dependencies": {"React": "18", "jquery": "^2.1", "left-pad": "1"}, "peerDependencies": {"vue": "3"}}',
    "web/bower.json": '{"dependencies": {"bootstrap": "3"}}',
    "web/Index.html": '<script src="/lib/jquery-1.9.js"></script><script src="x/jquery.js"></script><script src="own.js"></script><script src="KNOCKOUT-3.js"></script>',
    "web/app.js": "eval(x)\n" + BLOCK,
    "web/copy.js": BLOCK,
    "web/lib.min.js": "eval(y)",
    "Dockerfile": "FROM node:latest\n",
    "appsettings.json": '{"DetailedErrors": true}',
    "s.sql": "CREATE TABLE People (\n  Email NVARCHAR(50)\n);\nCREATE PROC p AS IF 1=1 SELECT 1\n",
}
SEGMENTS = [{"id": i, "affected": [{"package": {"ecosystem": e, "name": n}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]} for i, e, n in [("V1", "Maven", "log4j:log4j"), ("V2", "PyPI", "Django"), ("V3", "PyPI", "flask"), ("V4", "PyPI", "open"), ("V5", "Maven", "g:open")]]


def facts(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    segments = documents.osv_segments(spark.createDataFrame([(json.dumps(s),) for s in SEGMENTS], "entry string"))
    return registry.Facts(files, {"segments": segments})


def test_all_scanners_in_one_plan(spark):
    f = facts(spark)
    found = registry.run(f)
    rows = {(r.rule_id, r.severity, r.file_path, r.symbol) for r in found.collect()}
    assert {
        ("java.inventory", 0, "b/pom.xml", "java-platform"), ("java.jdk.eol", 3, "pom.xml", "jdk:pom.xml"), ("java.legacy-framework", 3, "b/pom.xml", "java:Log4j 1.x"), ("java.vulnerable-dependency", 2, "b/pom.xml", "log4j:log4j@1.2.17:V1"),
        ("python.inventory", 0, "pyproject.toml", "python-platform"), ("python.interpreter.eol", 2, "pyproject.toml", "python:pyproject.toml"), ("python.vulnerable-dependency", 2, "pyproject.toml", "django@1.11:V2"), ("python.legacy-framework", 3, "pyproject.toml", "python:Django 1.x"),
        ("javascript.inventory", 0, None, "frontend"), ("javascript.legacy-framework", 2, "package.json", "frontend:jQuery 1.x/2.x"), ("javascript.legacy-framework", 2, "web/Index.html", "frontend:Knockout"),
        ("quality.complexity.method", 2, "A.java", "f"), ("sec.crypto.weak-hash", 2, "x.py", "f"), ("infra.docker.unpinned-base", 1, "Dockerfile", "node:latest"), ("privacy.pii.contact", 2, None, "People"),
    } <= rows
    assert {r[0] for r in rows if r[0].endswith("vulnerable-dependency")} and sum(r[0].endswith("vulnerable-dependency") for r in rows) == 2
    blocks = [r for r in rows if r[0] == "quality.duplication.block"]
    assert {(r[2], r[3].split(" ")[1]) for r in blocks} == {("web/app.js", "web/copy.js:1"), ("web/copy.js", "web/app.js:2")}
    assert found.filter("not declared").count() == 0 and {r.scanner for r in found.select("scanner").distinct().collect()} == {s.id for s in registry.SCANNERS}
    assert registry.catalog(f.files, registry.SCANNERS).filter("rule_id = 'javascript.inventory'").first().scanner == "front-end"


def test_footprints(spark):
    f = facts(spark)
    java = platform_rules.java_footprint(f["maven_modules"], f.files).first().data
    assert java == {"modules": "2", "jdks": "8, 17", "files": "1"}
    python = platform_rules.python_footprint(f["python_packages"], f["python_requires"], f.files).first().data
    assert python == {"packages": "3", "manifests": "2", "files": "1", "targets": ">=3.7"}
    front = platform_rules.front_end_findings(platform_rules.front_end_uses(f["npm_dependencies"], f["script_tags"]), f.files).filter("rule_id = 'javascript.inventory'").first().data
    assert front == {"files": "2", "manifests": "2", "frameworks": "Knockout, React, jQuery, jQuery 1.x/2.x", "legacyFrameworks": "Knockout, jQuery 1.x/2.x"}
    old = platform_rules.front_end_findings(platform_rules.front_end_uses(f["npm_dependencies"], f["script_tags"]), f.files).filter("symbol = 'frontend:jQuery 1.x/2.x'").first().data
    assert old == {"name": "jQuery 1.x/2.x", "files": "2", "count": "2"}
    none = f.files.limit(0)
    empty = registry.Facts(none)
    assert platform_rules.java_footprint(empty["maven_modules"], none).count() == 0 == platform_rules.python_footprint(empty["python_packages"], empty["python_requires"], none).count()


def test_a_third_family_plugs_in(spark):
    @F.udtf(returnType="line: int, word: string")
    class Todo:
        def eval(self, path: str, content: str):
            for n, text in enumerate((content or "").split("\n"), 1):
                if "step 3" in text:
                    yield n, text.strip()

    f = facts(spark)
    own = registry.Scanner("todo", [registry.Rule("own.todo", "Quality", 1)], lambda g: g.of_udtf(Todo).select(F.lit("own.todo").alias("rule_id"), F.lit(1).alias("severity"), F.col("path").alias("file_path"), "line", F.col("word").alias("symbol")))
    loose = registry.Scanner("loose", [], lambda g: g.files.select(F.lit("not.named").alias("rule_id"), F.col("path").alias("file_path")).limit(1))
    found = registry.run(f, [own, loose])
    assert sorted((r.file_path, r.line, r.declared) for r in found.filter("rule_id = 'own.todo'").collect()) == [("web/app.js", 5, True), ("web/copy.js", 4, True)]
    assert [(r.rule_id, r.severity, r.declared) for r in found.filter("scanner = 'loose'").collect()] == [("not.named", None, False)]
    assert registry.run(f, []).count() == 0


def test_business_candidates(spark):
    got = registry.business_candidates(facts(spark), 5).collect()
    assert [(r.source, r.snippet) for r in got] == [("methods", "f"), ("routines", "p")]
