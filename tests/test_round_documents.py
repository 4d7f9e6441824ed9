"""Lockfiles at any depth, pins, CVSS 4, Maven modules, SARIF slugs, routines and code text: small inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalar
from tallyforge.rules import fact_rules
from tallyforge.sources import code_text, documents, manifests


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_lockfile_at_any_depth(spark):
    tree = {"version": "10.0", "dev": True}
    for depth in range(9, 0, -1):
        tree = {"version": f"{depth}.0", "dependencies": {f"p{depth + 1}": tree, "shared": {"version": "1.0", "dev": depth > 1}}}
    lock = {"lockfileVersion": 1, "dependencies": {"P1": tree, "safe": {"version": "npm:@real/pkg@4.5.6"}, "folder": {"bundled": True}}}
    flat = {"packages": {"": {}, "node_modules/x": {"version": "2"}}, "dependencies": {"hidden": {"version": "1"}}}
    bare = {"packages": {"": {"version": "0"}}, "dependencies": {"y": {"version": "3", "dependencies": {"z": {"version": "4"}}}}}
    f = files(spark, **{"package-lock.json": json.dumps(lock), "a/package-lock.json": json.dumps(flat), "b/package-lock.json": json.dumps(bare), "c/package-lock.json": "{broken", "d/package-lock.json": "[]"})
    got = manifests.npm_packages(f)
    want = [(f"p{i}", f"{i}.0", i == 10) for i in range(1, 11)] + [("@real/pkg", "4.5.6", False), ("shared", "1.0", False)]
    assert rows(got.filter("path = 'package-lock.json'"), "name", "version", "is_dev") == sorted(want, key=str)
    assert rows(got.filter("path <> 'package-lock.json'"), "path", "name") == [("a/package-lock.json", "x"), ("b/package-lock.json", "y"), ("b/package-lock.json", "z")]
    assert rows(manifests.npm_lock_v1(f), "name", "version") == sorted(((n, v) for n, v, _ in want), key=str)
    assert manifests.npm_packages(f.limit(0)).count() == 0


def test_lockfile_is_read_once_however_deep(spark):
    """1,500 levels, and entries of every kind."""
    deep = '{"lockfileVersion":1' + "".join(f',"dependencies":{{"P{i}":{{"version":"{i}.0"' for i in range(1500)) + "}}" * 1500 + "}"
    odd = '{"dependencies": {"a": {"version": 1.50, "dev": "true"}, "b": "text", "c": {"version": null, "dependencies": {"d": {"version": "\\ud800x"}}}, "a": {"version": "2"}, "e": {"version": "3", "dependencies": []}}}'
    f = files(spark, **{"package-lock.json": deep, "o/package-lock.json": odd, "p/package-lock.json": '{"packages": {"node_modules/@s/x": {"version": "1", "name": "Real"}, "node_modules/y": {"version": "npm:z@2", "dev": true}}}'})
    got = manifests.npm_packages(f)
    by_path = {}
    for r in got.collect():
        by_path.setdefault(r["path"], set()).add((r["name"], r["version"], r["is_dev"]))
    assert by_path["package-lock.json"] == {(f"p{i}", f"{i}.0", False) for i in range(1500)}
    assert by_path["o/package-lock.json"] == {("a", "1.50", True), ("a", "2", False), ("d", "?x", False), ("e", "3", False)}
    assert by_path["p/package-lock.json"] == {("real", "1", False), ("y", "npm:z@2", True)}


def test_only_pins_are_judged(spark):
    f = files(spark, **{
        "pyproject.toml": '[project]\ndependencies = [\n  "django>=4.2",\n  "exact==1.5",\n  "wild==2.*",\n]\n\n[tool.poetry.dependencies]\nflask = "^2.0"\nnumpy = {version = "1.26.0", extras = ["x"]}\nrange = ">=1.0,<2"\nbare = "3.1"\n',
        "Pipfile": '[packages]\nrich = "==13.1"\nloose = "~=2.0"\n',
        "setup.py": "setup(install_requires=['six>=1.16', 'attrs===20.1'])",
        "requirements.txt": "a==1\nb>=1\n",
        "package.json": '{"dependencies": {"left": "1.0.0", "ranged": "^1.0.0"}}',
    })
    python = [manifests.pyproject_dependencies(f), manifests.pipfile_dependencies(f), manifests.setup_dependencies(f), documents.python_requirements(f)]
    facts = manifests.package_facts(*[("pypi", t) for t in python], ("npm", documents.npm_dependencies(f)))
    pinned = {r["name"] for r in facts.filter("pinned").collect()}
    assert pinned == {"exact", "numpy", "bare", "rich", "attrs", "a", "left"} and facts.count() == 15
    osv = [{"id": f"V-{n}", "affected": [{"package": {"ecosystem": "pypi", "name": n}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}]}]}]} for n in ("django", "exact", "six", "attrs", "wild")]
    seg = documents.osv_segments(spark.createDataFrame([(json.dumps(o),) for o in osv], "entry string"))
    assert rows(fact_rules.vulnerable_packages(facts, seg), "id") == [("V-attrs",), ("V-exact",)]


V4 = "CVSS:4.0/AV:{}/AC:L/AT:N/PR:{}/UI:{}/VC:{}/VI:{}/VA:{}/SC:N/SI:N/SA:N"


@pytest.mark.parametrize("vector,score", [
    (V4.format("N", "N", "N", "H", "H", "H"), 9.5),
    (V4.format("N", "N", "N", "H", "H", "L"), 9.5),
    (V4.format("N", "L", "N", "H", "H", "H"), 8.0),
    (V4.format("N", "N", "P", "H", "H", "N"), 8.0),
    (V4.format("L", "N", "N", "H", "H", "H"), 6.5),
    (V4.format("N", "N", "N", "H", "L", "N"), 6.5),
    (V4.format("P", "H", "A", "L", "N", "N"), 4.0),
    (V4.format("N", "N", "N", "N", "N", "N"), 1.0),
    ("cvss:4.0/av:n/vc:h/vi:h/va:h", 9.5),
    ("CVSS:4.0/AV:N/AC:L", None),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    ("AV:N/AC:L/Au:N/C:P/I:P/A:P", None),
    (None, None),
])
def test_cvss(spark, vector, score):
    assert spark.range(1).select(scalar.cvss_score(F.lit(vector).cast("string")).alias("s")).first().s == score


def test_osv_keeps_vectors_of_version_4(spark):
    v3, v4 = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", V4.format("L", "N", "N", "H", "H", "H")
    both = lambda *s: {"id": f"V{len(s)}{s[0][0]}", "severity": [{"type": t, "score": v} for t, v in s], "affected": [{"package": {"ecosystem": "npm", "name": "x"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}]}]}]}
    entries = [both(("CVSS_V4", v4)), both(("CVSS_V4", v4), ("CVSS_V3", v3))]
    seg = documents.osv_segments(spark.createDataFrame([(json.dumps(e),) for e in entries], "entry string"))
    p = spark.createDataFrame([("npm", "x", "1.0")], "ecosystem string, name string, version string")
    assert rows(fact_rules.vulnerable_packages(p, seg), "id", "score", "severity") == [("V1CVSS_V4", 6.5, 2), ("V2CVSS_V4", 9.8, 4)]


def test_maven_modules(spark):
    pom = """<project><!-- <dependency><groupId>no</groupId><artifactId>no</artifactId></dependency> -->
<parent><groupId>org.boot</groupId><artifactId>starter-parent</artifactId><version>${boot}</version></parent>
<artifactId>shop</artifactId><version>3.0</version>
<properties><boot>1.5.9</boot><base>2</base><lib>${base}.${minor}</lib><minor>7</minor><loop>${loop}</loop><maven.compiler.source>1.8</maven.compiler.source><maven.compiler.target>11</maven.compiler.target></properties>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId><version>1</version></dependency></dependencies></dependencyManagement>
<dependencies>
<dependency><groupId>g</groupId><artifactId>nested</artifactId><version>${lib}</version><exclusions><exclusion><groupId>x</groupId><artifactId>y</artifactId></exclusion></exclusions></dependency>
<dependency><groupId>${project.groupId}</groupId><artifactId>sibling</artifactId><version>${project.version}</version></dependency>
<dependency><groupId>g</groupId><artifactId>endless</artifactId><version>${loop}</version></dependency>
<dependency><groupId>g</groupId><artifactId>unknown</artifactId><version>${nowhere}</version></dependency>
<dependency><groupId>g</groupId><artifactId>none</artifactId></dependency>
</dependencies><build><plugins><plugin><dependencies><dependency><groupId>p</groupId><artifactId>plug</artifactId></dependency></dependencies></plugin></plugins></build></project>"""
    f = files(spark, **{"shop/pom.xml": pom, "bare/pom.xml": "<project></project>", "x.xml": pom})
    assert rows(documents.maven_dependencies(f), "coordinate", "version") == [("g:endless", None), ("g:nested", "2.7"), ("g:none", None), ("g:unknown", None), ("org.boot:sibling", "3.0"), ("org.boot:starter-parent", "1.5.9")]
    assert rows(documents.maven_modules(f), "path", "name", "jdk") == [("bare/pom.xml", "bare", None), ("shop/pom.xml", "shop", "1.8")]


def test_sarif_ids_stay_apart(spark):
    result = lambda i, **more: {"ruleId": i, "level": "note", "message": {"text": "m"}} | more
    log = {"runs": [
        {"tool": {"driver": {"name": "Lint", "rules": [{"id": "no.console"}, {"id": "known"}]}}, "results": [result("no-console"), result("no.console"), result("late x"), result("late.x"), result(""), result("known", properties={"security-severity": "9.1"})]},
        {"tool": {"driver": {"name": "lint"}}, "results": [result("late x")]},
        {"tool": {"driver": {"name": "Other"}}, "results": [result("other")]},
    ]}
    found = documents.sarif_findings(files(spark, a=json.dumps(log), b=json.dumps({"runs": []}), c="no json"))
    of = {}
    for r in found.collect():
        of.setdefault(r.sarif_rule, set()).add(r.rule_id)
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()[:6]
    assert of == {"no.console": {"external.lint.no-console"}, "no-console": {f"external.lint.no-console-{sha('no-console')}"}, "late x": {"external.lint.late-x"}, "late.x": {f"external.lint.late-x-{sha('late.x')}"}, "result": {"external.lint.result"}, "known": {"external.lint.known"}}
    assert found.count() == 7 and found.filter("sarif_rule = 'known'").first().severity == 4


def test_routines_by_tokens(spark):
    sql = "\n".join([
        "/* CREATE PROCEDURE no AS */", "-- CREATE PROC no", "SELECT 'CREATE FUNCTION no' ",
        'CREATE OR REPLACE PROCEDURE "own".[pro c] AS', "DECLARE k INSENSITIVE SCROLL CURSOR FOR SELECT 1;", "CURSOR d IS SELECT 2", "EXEC('x' + 'GO')", "GO",
        "SELECT 1", "create trigger t on a as", "declare @q nvarchar(max) = concat('a', @b)", "EXECUTE IMMEDIATE @q", "go ;",
        "create function f() as", "set @s += 'x'; exec ( @s )", "create function g() as", "set @s = 'a'", "exec(@s); select a + b", "GO BACK",
    ])
    got = {r["name"]: r for r in manifests.sql_routines(files(spark, **{"a.sql": sql, "e.sql": ""})).collect()}
    assert {k: (r.kind, r.line, r.end_line, r.cursors, r.dynamic_sql) for k, r in got.items()} == {"own.pro c": ("procedure", 4, 7, 2, True), "t": ("trigger", 10, 12, 0, True), "f": ("function", 14, 15, 0, True), "g": ("function", 16, 19, 0, False)}


def test_code_text_by_tokens(spark):
    java = """package org.shop.core;
@Deprecated
public final class Cart<T extends Comparable<T>> implements Runnable {
    enum Kind { A, B }
    record Line(String sku, int n) { Line { if (n < 0) throw new IllegalArgumentException("x()"); } }
    Cart(int n) { this.n = n; }
    public Map<String, List<int[]>> lines(final String[] a, int... b) throws IOException, Oops {
        return new Thing() { void inner() { while (true) {} } }.call(() -> { run(); });
    }
    abstract void none();
    @Test
    void adds() { }
}
interface Other { default int size() { return 1; } }
"""
    python = "class Shop(Base):\n    def test_it(self): pass\n    async   def go(self,\n           a=1):\n        return hashlib.new('SHA1')\nclass Plain:\n    x = 'def no(): pass'\n# def no(): pass\ndefault = 1\n"
    got = code_text.code_facts(files(spark, **{"S.java": java, "m.py": python}))
    assert rows(got.filter("language = 'java' and kind = 'method'"), "symbol", "complexity") == [("Cart", 1), ("adds", 1), ("inner", 2), ("lines", 2), ("size", 1)]
    assert rows(got.filter("kind = 'type'"), "symbol", "rule_id") == [("Cart", "class"), ("Kind", "enum"), ("Line", "record"), ("Other", "interface"), ("Plain", "class"), ("Shop", "class")]
    assert rows(got.filter("kind = 'package'"), "symbol") == [("org.shop.core",)] and rows(got.filter("kind = 'test'"), "symbol", "line") == [("adds", 12), ("test_it", 2)]
    assert rows(got.filter("language = 'python' and kind = 'method'"), "symbol", "line") == [("go", 3), ("test_it", 2)]
    assert rows(got.filter("kind = 'pattern'"), "rule_id", "symbol") == [("sec.crypto.weak-hash", "go")]


def test_mcp_servers(spark):
    config = """{
  // servers
  "mcpServers": {
    "files": {"command": "/usr/bin/npx", "args": ["-y", "server-filesystem", "--token=abcd1234efgh5678"], "env": {"B": "${HOME}", "A": "Zq81mVt0Lp2wZq81"}},
    "remote": {"url": "https://Tools.example.com:8443/mcp?k=1", "headers": {"Authorization": "Bearer abcdef1234567890"}}, // note
    "local": {"url": "http://127.0.0.1:80/x", "type": "SSE"},
    "odd": 7,
  },
  "servers": [{"name": "listed", "url": "https://h.io/"}, {"type": "streamable-http"}],
  "experimental": {"modelContextProtocolServers": [{"transport": {"type": "stdio", "command": "C:\\\\tools\\\\run.exe"}}]}
}"""
    got = {r.server: r for r in documents.mcp_servers(files(spark, **{".cursor/mcp.json": config, "mcp.json": "[]", "x/mcp.json": "broken", "other.json": config})).collect()}
    assert {k: (r.transport, r.command, r.host, r.remote, r.secrets) for k, r in got.items()} == {
        "files": ("stdio", "npx", None, False, 2), "remote": ("http", None, "tools.example.com:8443", True, 1), "local": ("sse", None, "127.0.0.1", False, 0), "odd": ("unknown", None, None, False, 0),
        "listed": ("http", None, "h.io", True, 0), "server-1": ("http", None, None, False, 0), "continue-0": ("stdio", "run.exe", None, False, 0),
    }
    assert got["files"].env_keys == ["A", "B"] and got["remote"].env_keys == []
    known = spark.createDataFrame([("filesystem", "Filesystem", "ReadWrite"), ("server", "Any", "Read")], "match string, known string, capability string")
    told = manifests.known_servers(documents.mcp_servers(files(spark, **{"mcp.json": config})), known)
    assert rows(told.filter("known is not null"), "server", "known", "capability") == [("files", "Filesystem", "ReadWrite"), ("server-1", "Any", "Read")]


def test_sampled_days(spark):
    from tallyforge.plans import health

    runs = lambda *days: spark.createDataFrame([(d,) for d in days], "finished_at string").withColumn("finished_at", F.to_timestamp("finished_at"))
    days = lambda r, today, weeks=26: [str(x.day) for x in health.sampled_days(r, F.lit(today).cast("date"), weeks).orderBy("day").collect()]
    assert days(runs("2025-01-01 10:00:00", "2025-01-03 10:00:00"), "2025-01-04") == ["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-04"]
    assert days(runs("2025-01-01 10:00:00"), "2025-01-15") == ["2025-01-01", "2025-01-08", "2025-01-15"]
    assert days(runs("2025-01-02 10:00:00"), "2025-01-16", 1) == ["2025-01-09", "2025-01-16"]
    assert len(days(runs("2000-01-02 10:00:00"), "2025-01-16", 900)) == 104 and days(runs(), "2025-01-16") == [] and days(runs("2025-02-01 00:00:00"), "2025-01-16") == ["2025-01-16"]
