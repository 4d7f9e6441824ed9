"""Manifests, build files, routines, code text, usage logs: small inputs with known results."""

from pyspark.sql import functions as F

from tallyforge.rules import estate_rules, fact_rules
from tallyforge.sources import code_text, documents, manifests


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_python_manifests(spark):
    f = files(spark, **{
        "a/pyproject.toml": '[project]\nname = "x"\ndependencies = [\n  "Django>=4.2",\n  "requests[socks] ~= 2.31",\n  "attrs",\n]\n\n[tool.poetry.dependencies]\npython = "^3.11"\nFlask = "^2.0"\nnumpy = {version = ">=1.26", optional = true}\n\n[tool.black]\nline = "1"\n',
        "Pipfile": '[packages]\nrich = "==13.1"\nanything = "*"\n[dev-packages]\npytest = ">=8"\n[requires]\npython_version = "3.11"\n',
        "setup.py": "setup(install_requires=['six>=1.16', \"idna\"])",
        "setup.cfg": "[options]\ninstall_requires =\n    click>=8.1\n    toml\n",
    })
    assert rows(manifests.pyproject_dependencies(f), "name", "version") == [("attrs", None), ("django", "4.2"), ("flask", "2.0"), ("numpy", "1.26"), ("requests", "2.31")]
    assert rows(manifests.pipfile_dependencies(f), "name", "version") == [("anything", None), ("pytest", "8"), ("rich", "13.1")]
    assert rows(manifests.setup_dependencies(f), "name", "version") == [("click", "8.1"), ("idna", None), ("six", "1.16"), ("toml", None)]
    union = manifests.package_facts(("pypi", manifests.setup_dependencies(f)), ("pypi", manifests.setup_dependencies(f)), ("maven", spark.createDataFrame([("p", "g:a", "1")], "path string, coordinate string, version string")))
    assert union.count() == 5


def test_lockfile_v1(spark):
    f = files(spark, **{"package-lock.json": '{"lockfileVersion": 1, "dependencies": {"A": {"version": "1.0", "dependencies": {"b": {"version": "2.0", "dev": true}}}, "b": {"version": "2.0"}, "c": {"version": "3", "dev": true}}}', "x/package-lock.json": '{"packages": {"": {}}, "dependencies": {"z": {"version": "1"}}}'})
    got = manifests.npm_lock_v1(f)
    assert rows(got, "name", "version", "is_dev") == [("a", "1.0", False), ("b", "2.0", False), ("c", "3", True)]
    assert rows(fact_rules.npm_inventory(got), "rule_id", "packages", "dev") == [("dependency.npm.inventory", 3, 1)]


def test_project_packages_and_references(spark):
    f = files(spark, **{
        "src/App/App.csproj": '<Project Sdk="x"><ItemGroup><PackageReference Include="Dapper" /><PackageReference Include="Own" Version="1.2" /><PackageReference Include="Prop"><Version>$(PropVersion)</Version></PackageReference></ItemGroup></Project>',
        "tools/T.csproj": '<Project Sdk="x"><PackageReference Include="Dapper" /></Project>',
        "Directory.Packages.props": '<Project><PackageVersion Include="Dapper" Version="2.0" /></Project>',
        "src/Directory.Packages.props": '<Project><PackageVersion Include="dapper" Version="2.1" /></Project>',
        "src/Directory.Build.props": "<Project><PropVersion>9.9</PropVersion></Project>",
    })
    assert rows(manifests.project_packages(f), "path", "name", "version") == [("src/App/App.csproj", "Dapper", "2.1"), ("src/App/App.csproj", "Own", "1.2"), ("src/App/App.csproj", "Prop", "9.9"), ("tools/T.csproj", "Dapper", "2.0")]
    p = spark.createDataFrame([("src/App/App.csproj", ["..\\Core\\core.csproj", "../../gone/G.csproj", "./Sub/../S.csproj"]), ("src/Core/Core.csproj", [])], "path string, references array<string>")
    refs = manifests.project_references(p)
    assert rows(refs, "dst", "resolved") == [("gone/G.csproj", False), ("src/App/S.csproj", False), ("src/Core/Core.csproj", True)]
    assert fact_rules.unresolved_references(refs).count() == 2


def test_known_servers(spark):
    s = spark.createDataFrame([("gh", "npx -y @mcp/server-github-enterprise", None), ("own", "node x.js", None)], "server string, command string, url string")
    k = spark.createDataFrame([("github", "GitHub"), ("server-github-enterprise", "GitHub Enterprise")], "match string, known string")
    assert rows(manifests.known_servers(s, k), "server", "known") == [("gh", "GitHub Enterprise"), ("own", None)]


def test_sql_routines(spark):
    sql = """CREATE PROCEDURE [dbo].[A] AS
BEGIN
  -- IF in a comment
  IF @x = 1 SELECT * FROM t;
  DECLARE @s nvarchar(99) = 'select ' + @n
  EXEC sp_executesql @s
END
GO
create or alter function dbo.B() returns int as begin
  declare c cursor for select 1
  while 1 = 1 set @retry = @retry + 1
  exec sp_executesql @fixed
  return 1
end
CREATE TRIGGER T ON t AS EXEC('drop ' + @t)
"""
    got = {r["name"]: r for r in manifests.sql_routines(files(spark, **{"a.SQL": sql, "b.txt": sql})).collect()}
    assert set(got) == {"dbo.A", "dbo.B", "T"}
    a, b, t = got["dbo.A"], got["dbo.B"], got["T"]
    assert (a.kind, a.line, a.complexity, a.select_all, a.dynamic_sql) == ("procedure", 1, 2, True, True)
    assert (b.kind, b.line, b.complexity, b.cursors, b.dynamic_sql) == ("function", 9, 2, 1, False)
    assert (t.kind, t.line, t.dynamic_sql) == ("trigger", 15, True)


def test_coverage_reports(spark):
    f = files(spark, **{"c.xml": '<coverage line-rate="0.5" x="1"><package name="P" line-rate="0.25"/></coverage>', "o.xml": '<CoverageSession><Summary numSequencePoints="10" visitedSequencePoints="7"/><Modules><Module hash="a"><Summary numSequencePoints="4" visitedSequencePoints="1"/><ModuleName>M</ModuleName></Module></Modules></CoverageSession>', "bad.xml": '<coverage line-rate="7">'})
    reports, packages = manifests.coverage_reports(f)
    assert rows(reports, "path", "line_rate") == [("c.xml", 0.5), ("o.xml", 0.7)] and rows(packages, "package", "line_rate") == [("M", 0.25), ("P", 0.25)]


def test_code_text(spark):
    java = """package a;
// if (x) { }
public class Shop {
    public int price(int n) {
        if (n > 1 && n < 9) { for (;;) { } }
        String s = "if { while } // no";
        return n;
    }
    private static <T> void load(String id) throws Exception {
        run("SELECT * FROM t WHERE id=" + id);
        MessageDigest.getInstance("MD5"); /* getInstance("SHA1") */
    }
}
"""
    python = """import hashlib


def outer(a):
    # if this counted
    if a and a > 1:
        pass
    elif a:
        for x in a: pass
    s = 'while or and'
    return hashlib.md5(s)

async def load(cur, n):
    cur.execute(f"select {n}")
    cur.execute("select 1", n)
"""
    got = code_text.code_facts(files(spark, **{"S.java": java, "m.py": python, "x.cs": java}))
    assert rows(got.filter("kind = 'method'"), "symbol", "complexity", "line") == [("load", 1, 13), ("load", 1, 9), ("outer", 5, 4), ("price", 4, 4)]
    assert rows(got.filter("kind = 'pattern'"), "rule_id", "symbol", "line") == [("sec.crypto.weak-hash", "load", 11), ("sec.crypto.weak-hash", "outer", 11), ("sec.sql.string-concatenation", "load", 10), ("sec.sql.string-concatenation", "load", 14)]
    assert rows(got.filter("kind = 'type'"), "symbol") == [("Shop",)]


def test_usage_feeds(spark):
    use = lambda i, c, o: '{"type":"event_msg","timestamp":"2025-01-02T03:00:00Z","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":%d,"cached_input_tokens":%d,"output_tokens":%d}}}}' % (i, c, o)
    text = [use(5, 0, 1), '{"type":"session_meta","payload":{"id":"s1"}}', '{"type":"turn_context","payload":{"model":"gpt-5"}}', use(10, 4, 2), "broken", use(0, 0, 0), use(3, 9, 0)]
    lines = spark.createDataFrame([("d/r1.jsonl", n, t) for n, t in enumerate(text)], "path string, n int, text string")
    assert rows(manifests.rollout_usage(lines), "model", "input_tokens", "output_tokens", "cache_read_tokens", "requests", "sessions") == [("gpt-5", 6, 2, 13, 2, 1), ("unknown", 5, 1, 0, 1, 1)]
    r = spark.createDataFrame([("2025-01-01", "a", 2, [("m", 10, 150)]), ("2025-01-01", "b", 1, [("m", 5, 25), ("n", 1, 1)])], "day string, actor string, sessions int, models array<struct<model:string,tokens:long,cents:long>>")
    assert [(x.model, x.actors, x.sessions, x.tokens, float(x.cost)) for x in manifests.analytics_by_day(r).orderBy("model").collect()] == [("m", 2, 3, 15, 1.75), ("n", 2, 3, 1, 0.01)]
    seats = spark.createDataFrame([("a", "Business"), ("a", "business"), ("b", "business"), ("c", "trial")], "actor string, plan string")
    assert rows(manifests.seat_costs(seats, spark.createDataFrame([("Business", 19.0)], "plan string, price double")), "plan", "seats", "monthly") == [("business", 2, 38.0), ("trial", 1, None)]
    e = spark.createDataFrame([("a", "2025-01-01 10:00:00", "m", 3, 7), ("a", "2025-01-01 11:00:00", "m", 4, 8), ("x", "2025-01-01 11:00:00", "m", 1, 1)], "actor string, at string, model string, tokens long, cents long").withColumn("at", F.to_timestamp("at"))
    got = manifests.event_usage(spark.createDataFrame([("a", "Ann"), ("z", "Zed")], "actor string, name string"), e)
    assert rows(got, "actor", "name", "tokens", "requests") == [("a", "Ann", 7, 2), ("x", None, 1, 1), ("z", "Zed", None, None)]


def test_renames_carry_history(spark):
    text = ["commit\th3\t300\ta@x\tA", "5\t0\tsrc/{c.cs => d.cs}", "commit\th2\t200\ta@x\tA", "1\t1\tsrc/b.cs => src/c.cs", "commit\th1\t100\tb@x\tB", "9\t0\tsrc/b.cs", "2\t0\tother.cs"]
    log = spark.createDataFrame([("r", n, t) for n, t in enumerate(text)], "repo string, n int, text string")
    assert rows(manifests.renamed_paths(log), "path", "alias") == [("src/b.cs", "src/d.cs"), ("src/c.cs", "src/d.cs")]
    got = {r.path: (r.commits, r.lines_added, r.authors) for r in documents.git_churn(log).collect()}
    assert got == {"src/d.cs": (3, 15, 2), "other.cs": (1, 2, 1)}


def test_ai_findings(spark):
    p = spark.createDataFrame([("a", "openai", "openai", "sdk"), ("b", "langchain", "langchain", "framework")], "path string, name string, provider string, kind string")
    e = spark.createDataFrame([("c", "ollama", True), ("d", "acme", False)], "path string, provider string, local boolean")
    m = spark.createDataFrame([("d", "old", "2024-01-01"), ("d", "new", None)], "path string, model string, retired_on string")
    s = spark.createDataFrame([("m.json", "x", "http", True), ("m.json", "y", "stdio", False)], "path string, server string, transport string, has_secret boolean")
    got = rows(estate_rules.ai_findings(p, e, m, s, ["OpenAI"]), "rule_id", "severity", "symbol")
    assert got == [("ai.agent.framework", 0, "langchain"), ("ai.inventory", 0, "ai-estate"), ("ai.local-runtime", 0, "ollama"), ("ai.mcp.remote-server", 2, "x"), ("ai.mcp.secret-in-config", 3, "x"), ("ai.mcp.server", 1, "x"), ("ai.mcp.server", 1, "y"), ("ai.model.retired", 2, "old"), ("ai.provider.direct-endpoint", 1, "acme"), ("ai.provider.sdk", 0, "openai"), ("ai.unapproved-provider", 3, "acme")]
    assert estate_rules.ai_findings(p.limit(0), e.limit(0), m.limit(0), s.limit(0)).count() == 0


def test_untested_estates(spark):
    p = spark.createDataFrame([("a", False), ("b", False), ("t", True)], "path string, is_test boolean")
    r = spark.createDataFrame([("t", "a")], "src string, dst string")
    assert rows(fact_rules.untested_estate(p, r), "rule_id", "path") == [("quality.tests.project-uncovered", "b")]
    assert rows(fact_rules.untested_estate(p.filter("not is_test"), r.limit(0)), "rule_id", "path") == [("quality.tests.none", None)]


def test_upsert_by_partition(spark, tmp_path):
    import glob
    import os

    from tallyforge.streaming import telemetry

    table = str(tmp_path / "t")
    write = telemetry.upsert_by(table, ["day", "actor"], "at", "day")
    batch = lambda *r: spark.createDataFrame(list(r), "day string, actor string, at int, tokens long")
    write(batch(("d1", "a", 1, 10), ("d1", "b", 1, 5), ("d2", "a", 1, 7)), 0)
    kept = {f: os.path.getmtime(f) for f in glob.glob(table + "/day=d2/*.parquet")}
    second = batch(("d1", "a", 2, 11), ("d3", "c", 1, 1), ("d1", "b", 0, 99))
    for n in (1, 1):
        write(second, n)
        got = rows(spark.read.schema("actor string, at int, tokens long, day string").parquet(table), "day", "actor", "tokens")
        assert got == [("d1", "a", 11), ("d1", "b", 5), ("d2", "a", 7), ("d3", "c", 1)]
    assert kept and kept == {f: os.path.getmtime(f) for f in glob.glob(table + "/day=d2/*.parquet")}
