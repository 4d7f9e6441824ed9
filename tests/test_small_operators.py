"""Small operators without a query of their own: inputs with known results."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalar
from tallyforge.functions.versions import sort_key, version_key
from tallyforge.operators import findings, latest, matching
from tallyforge.plans import health, modernization, usage
from tallyforge.rules import fact_rules
from tallyforge.sinks import exports
from tallyforge.sources import documents, manifests, workspace


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_levels(spark):
    f = lambda c: one(spark, c)
    assert f(scalar.repository_key(F.lit(" HTTPS://Host/Team/Repo.GIT// "))) == "https://host/team/repo"
    assert [f(scalar.provider_of(F.lit(p).cast("string"), F.lit(m).cast("string"))) for p, m in [("Azure_OpenAI", "x"), (None, " Claude-4 "), ("", "anthropic.claude"), ("own", "gpt-5"), (None, "unknown"), (None, None)]] == ["azure-openai", "anthropic", "aws-bedrock", "own", None, None]
    texts = F.create_map(F.lit("pt"), F.lit("olá"), F.lit("en"), F.lit("hello"))
    assert [f(scalar.localized(texts, x)) for x in ("pt-BR", "en-GB", "de", "pt")] == ["olá", "hello", "hello", "olá"]
    assert [f(scalar.sarif_severity(F.lit(s).cast("double"), F.lit(v).cast("string"))) for s, v in [(9.0, "note"), (0.0, "error"), (None, "error"), (None, "warning"), (None, "note"), (None, "none"), (None, None), (6.9, None)]] == [4, 0, 3, 2, 1, 0, 2, 2]
    assert [f(scalar.sarif_level(F.lit(s))) for s in range(5)] == ["note", "note", "warning", "error", "error"]


def test_version_keys_agree_with_their_order(spark):
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10", "2.0-SNAPSHOT", "2.0", "1!0.1"]
    keys = [r.k for r in spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").select("i", version_key("v").alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) == [sort_key(v) for v in order] and len(set(keys)) == len(keys)
    assert sort_key("1.0") == sort_key("v1.0.0+build") and sort_key(None) is None is sort_key("  ")


def test_ignore_files_and_pruning(spark):
    assert workspace.ignore_lines("# note\n\n dist/ \r\n!keep.js\n") == ["dist/", "!keep.js"] and workspace.ignore_lines(None) == []
    paths = ["src/a.cs", "node_modules/x/a.js", "src/Bin/x.dll", "TestResults/c.xml", "packages/Own/a.cs", "lib/packages/Dapper.2.0.1/x.dll", "lib/packages/README"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(df.filter(~workspace.pruned(F.col("path")))) == sorted((p,) for p in paths if p not in paths[1:3])
    assert ("TestResults/c.xml",) not in rows(df.filter(workspace.is_source(F.col("path"))))
    assert rows(workspace.without_caches(df)) == sorted((p,) for p in paths if not p.startswith("lib/"))


def test_solutions(spark):
    sln = 'Project("{FAE0}") = "A", "src\\A\\A.csproj", "{1}"\nEndProject\nProject("{2150}") = "docs", "docs", "{2}"\nEndProject\n'
    f = spark.createDataFrame([("x.sln", sln), ("y.slnx", '<Solution><Project Path="b\\B.vbproj" /></Solution>'), ("z.txt", sln)], "path string, content string")
    assert rows(documents.solution_projects(f)) == [("x.sln", "src/A/A.csproj"), ("y.slnx", "b/B.vbproj")]


def test_cursors_of_scripts(spark):
    f = spark.createDataFrame([("a.sql", "declare c cursor for select 1; -- declare d cursor for\nCURSOR e IS SELECT 'declare x cursor'"), ("b.sql", "select 1"), ("c.sql", None)], "path string, content string")
    assert rows(manifests.sql_cursors(f)) == [("a.sql", 2)]


FACTS = "actor string, tool string, period date, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, requests long, sessions long, estimated_cost decimal(18,4)"


def facts(spark, *given):
    import datetime as dt
    from decimal import Decimal

    return spark.createDataFrame([(a, t, dt.date.fromisoformat(p), m, i, 0, 0, 0, r, s, None if c is None else Decimal(str(c))) for a, t, p, m, i, r, s, c in given], FACTS)


def test_usage_entries_and_actors(spark):
    f = facts(spark, ("a", "t", "2025-03-01", "m", 5, 1, 1, 1), ("b", "t", "2025-03-02", "m", 5, 1, 1, 1), ("c", "t", "2025-03-03", "m", 5, 1, 1, 1), ("d", "t", "2024-01-01", "m", 5, 1, 1, 1), ("e", "t", "2025-03-01", " ", 5, 1, 1, 1), ("f", "t", "2025-03-01", "m", -5, 1, 1, 1))
    assert rows(usage.valid_entries(f, F.lit("2025-03-01").cast("date")), "actor", "reject") == [("a", None), ("b", None), ("c", "future"), ("d", "too old"), ("e", "no model"), ("f", "negative")]
    assert {r.actor for r in usage.known_actors(f, F.lit("2025-03-01").cast("date")).collect()} == set("abcef")


def test_usage_is_priced_again(spark):
    f = facts(spark, ("a", "t", "2025-03-01", "gpt-5", 1_000_000, 1, 1, 2), ("b", "t", "2025-03-01", "gpt-5", 500_000, 1, 1, 1), ("c", "t", "2025-03-01", "none", 5, 1, 1, None), ("d", "t", "2025-03-01", "none", 5, 1, 1, 3))
    prices = spark.createDataFrame([(0, "^gpt", 2.0, 4.0, None, None)], "ordinal int, pattern string, input double, output double, cache_read double, cache_write double")
    got = {r.actor: (None if r.estimated_cost is None else float(r.estimated_cost), r.changed) for r in usage.repriced(f, prices).collect()}
    assert got == {"a": (2.0, False), "b": (1.0, False), "c": (None, False), "d": (None, True)}


def test_payback(spark):
    pay = lambda c, a, s=1.0: one(spark, modernization.payback_months(F.lit(c), F.lit(a), F.lit(s)))
    assert [pay(1200.0, 1200.0), pay(1200.0, 1200.0, 0.5), pay(1e9, 1.0), pay(100.0, 0.0), pay(100.0, None)] == [12.0, 24.0, 120.0, None, None]


def test_rule_candidates(spark):
    m = spark.createDataFrame([("k", "plain", 4, 0, 0, 0, False), ("k", "domain", 1, 0, 0, 0, True), ("k", "maths", 1, 2, 1, 90, False), ("o", "x", 1, 0, 0, 0, False)], "k string, symbol string, complexity int, comparisons int, throws int, arithmetic int, is_domain boolean")
    got = modernization.rule_candidates(m, "k", 2)
    assert rows(got, "k", "symbol", "score", "rank") == [("k", "domain", 5.0, 2), ("k", "maths", 8.0, 1), ("o", "x", 1.0, 1)]
    assert rows(latest.top_k(m, ["k"], [F.desc("complexity"), F.col("symbol")], 1), "symbol") == [("plain",), ("x",)]


def test_rules_over_facts(spark):
    f = spark.createDataFrame([("a.cs", 1001, True), ("b.cs", 1000, False)], "relative_path string, lines int, has_errors boolean")
    assert rows(fact_rules.large_files(f), "rule_id", "file_path") == [("quality.file.large", "a.cs")] == [("quality.file.large", r[0]) for r in rows(fact_rules.syntax_errors(f), "file_path")]
    p = spark.createDataFrame([("X", "1"), ("x", "2"), ("y", "1"), ("y", "1")], "name string, version string")
    assert rows(fact_rules.version_conflicts(p)) == [("x", ["1", "2"])]
    e = spark.createDataFrame([(f"u{i}", "core") for i in range(3)] + [("u1", "other")], "src string, dst string")
    m = spark.createDataFrame([("core", c) for c in (10, 11, 12, 9)] + [("other", 50)] * 3, "project string, complexity int")
    assert rows(fact_rules.hotspots(e, m)) == [("core", 3, 3)]
    s = spark.createDataFrame([("openai", "o"), ("openai-agents", "a"), ("lang", "l")], "prefix string, provider string")
    names = spark.createDataFrame([("OpenAI-Agents-X",), ("openai",), ("none",)], "name string")
    assert rows(fact_rules.owned_by_signature(names, s)) == [("OpenAI-Agents-X", "a"), ("none", None), ("openai", "o")]


@pytest.mark.parametrize("framework,rule", [("net5.0", "end-of-life"), ("NET9.0", "ending-soon"), ("net10.0", None), ("net48", "legacy"), ("own", "unknown")])
def test_framework_support(spark, framework, rule):
    catalog = spark.createDataFrame([("net5.0", "2022-05-10", False), ("net9.0", "2026-05-12", False), ("net10.0", "2028-11-10", False), ("net48", "2040-01-01", True)], "framework string, end_date string, legacy boolean").withColumn("end_date", F.to_date("end_date"))
    p = spark.createDataFrame([("p", framework)], "path string, target_framework string")
    got = [r.rule_id for r in fact_rules.framework_support(p, catalog, F.lit("2026-01-01").cast("date")).collect()]
    assert got == ([f"dependency.framework.{rule}"] if rule else [])


def test_tenants_and_prefixes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, n int")
    assert rows(findings.tenant_rows(df, "b")) == [("b", 2)]
    assert hasattr(matching, "longest_prefix")


def test_json_and_sarif(spark):
    f = spark.createDataFrame([("r2", 3, "t", "a.cs", 5, "Open", "new"), ("r1", 1, "u", None, None, "Suppressed", "recurring"), ("r1", 2, "v", "b.cs", None, "Resolved", "resolved")], "rule_id string, severity int, title string, file_path string, line int, status string, outcome string")
    assert json.loads(exports.json_rows(f.filter("title = 'u'")).first().value) == {"rule_id": "r1", "severity": 1, "title": "u", "file_path": None, "line": None, "status": "Suppressed", "outcome": "recurring"}
    got = {json.loads(r.value)["message"]["text"]: json.loads(r.value) for r in exports.sarif_results(f, f).collect()}
    assert {k: (v["ruleIndex"], v["level"], v["baselineState"], v.get("suppressions")) for k, v in got.items()} == {"t": (1, "error", "new", None), "u": (0, "note", "unchanged", [{"kind": "external"}]), "v": (0, "warning", "absent", None)}
    assert got["t"]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.cs"}, "region": {"startLine": 5}}
    whole = json.loads(exports.sarif_document(f, f, "tool", 1))
    assert [r["ruleId"] for r in whole["runs"][0]["results"]] == ["r2"] and [r["id"] for r in whole["runs"][0]["tool"]["driver"]["rules"]] == ["r1", "r2"]


def test_csv_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), ('say "x"', 3)], "a string, b int")
    exports.write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    text = open(glob.glob(str(tmp_path / "c/part-*"))[0], encoding="utf-8").read()
    assert text == '﻿a,b\n\'=1+1,2\n"say ""x""",3\n'


def test_windows_are_replaced(spark, tmp_path):
    table = str(tmp_path / "t")
    batch = lambda *r: spark.createDataFrame(list(r), "v int, period string")
    exports.replace_window(spark, batch((1, "d1"), (2, "d1"), (3, "d2")), table)
    exports.replace_window(spark, batch((9, "d1"), (8, "d3")), table)
    assert rows(spark.read.schema("v int, period string").parquet(table)) == [(3, "d2"), (8, "d3"), (9, "d1")]


def test_summary_with_deltas(spark):
    gate = spark.createDataFrame([("a", False, ["over"]), ("b", True, [])], "k string, passed boolean, reasons array<string>")
    top = spark.createDataFrame([("r", 3, 4)], "rule_id string, n long, max_severity int")
    snapshots = spark.createDataFrame([("a", 1, 50, 40), ("a", 2, 60, 30)], "k string, run int, score int, score_security int").withColumns({f"score_{n.lower()}": F.lit(100) for n, _, _ in health.DIMENSIONS if n != "Security"})
    touched = spark.createDataFrame([("r", "Security", 4, "Open", "s2", "s2", None, "a.cs", 3, "x"), ("r", "Security", 1, "Open", "s2", "s2", None, None, None, "sym"), ("q", "Code", 2, "Resolved", "s1", "s1", "s2", "b.cs", None, "x")], "rule_id string, category string, severity int, status string, first_seen_scan_id string, last_seen_scan_id string, resolved_scan_id string, file string, line int, symbol string")
    lines = exports.markdown_summary(gate, top, "k", health.dimension_deltas(snapshots, "k"), health.rule_deltas(touched, ["s2"]))
    assert "| a | failed | over |" in lines and "| Overall | 50 | 60 | +10 |" in lines and "| Security | 40 | 30 | -10 |" in lines and "| Quality | 100 | 100 | +0 |" in lines
    assert "| new | r | 2 | a.cs:3, sym |" in lines and "| resolved | q | 1 | b.cs |" in lines
    assert exports.markdown_summary(gate, top, "k")[-1] == "| r | 3 | 4 |"


def test_twenty_rules_by_severity(spark):
    f = spark.createDataFrame([(f"r{i:02}", i % 5, f"a{j % 3}") for i in range(20) for j in range(i + 1)] + [("dependency.migration-blocker", 4, "a")] * 99, "rule_id string, severity int, assessment_id string")
    got = [(r.rule_id, r.max_severity, r.n) for r in health.top_rules(f).collect()]
    want = sorted(((f"r{i:02}", i % 5, i + 1) for i in range(20)), key=lambda r: (-r[1], -r[2], r[0]))[:15]
    assert got == want


def test_side_by_side(spark):
    p = spark.createDataFrame([("a", 1, 2.5, "x"), ("b", 4, None, "y"), ("c", 9, 9.0, "z")], "k string, n int, v double, s string")
    assert [tuple(r) for r in health.side_by_side(p, "k", "a", "b").collect()] == [("n", 1.0, 4.0, 3.0), ("v", 2.5, None, None)]


def test_refresh_reads_changed_keys_alone(spark, tmp_path):
    f = spark.createDataFrame([(k, "Security", 4, s) for k in ("a", "b", "c") for s in ("Open", "Resolved", "Regressed")], "k string, category string, severity int, status string")
    f.write.partitionBy("k").parquet(str(tmp_path / "f"))
    stored = spark.read.schema("category string, severity int, status string, k string").parquet(str(tmp_path / "f"))
    projects = spark.createDataFrame([("a", 3), ("b", 30), ("c", 3)], "k string, project_count long")
    full = health.health(stored.filter("status in ('Open', 'Regressed')"), projects, "k")
    snapshots = full.select("*", F.lit(7).cast("long").alias("run_id"), F.concat(F.lit("c"), "k").alias("commit"), F.lit("2025-01-01").cast("timestamp").alias("taken_at"))
    triaged = stored.withColumn("status", F.when((F.col("k") == "b") & (F.col("status") == "Open"), "FalsePositive").otherwise(F.col("status")))
    changed = spark.createDataFrame([("b",), ("b",)], "k string")
    out = health.refreshed(snapshots, triaged, projects, changed, "k", F.lit("2025-01-02").cast("timestamp"))
    new = out.filter("run_id is null").collect()
    again = health.health(triaged.filter("status in ('Open', 'Regressed')"), projects, "k").filter("k = 'b'").first()
    assert out.count() == 4 and [(r.k, r.commit, r.score, r.score_security) for r in new] == [("b", "cb", again.score, again.score_security)]
    assert again.score_security > full.filter("k = 'b'").first().score_security
    plan = health.refreshed(snapshots, triaged, projects, changed, "k", F.current_timestamp())._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
