"""Published numbers of the analytics, ported."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import findings as fnd
from tallyforge.operators import graph, latest, matching
from tallyforge.plans import health, modernization, usage

DAY = dt.date


def h(spark, rows, projects):
    f = spark.createDataFrame([("a", *r) for r in rows], "k string, rule_id string, category string, severity int")
    return health.health(f, spark.createDataFrame([("a", projects)], "k string, project_count int"), "k").first()


def test_health_scores(spark):
    assert (h(spark, [], 3).score, h(spark, [], 3).risk) == (100, "Low")
    r = h(spark, [("x", "Security", 4), ("x", "Security", 3), ("y", "Secrets", 2), ("z", "Modernization", 1), ("q", "Quality", 0)], 5)
    assert (r.score_security, r.score_modernization, r.score_quality, r.score) == (74, 99, 100, 92)
    many = [("x", "Security", 3)] * 20
    assert h(spark, many, 5).score_security == 0 and h(spark, many, 200).score_security == 92
    assert h(spark, [("mb", "Modernization", 3)] * 2 + [("legacy", "Modernization", 1)], 3).penalty == 17


def test_risk_bands_and_contributors(spark):
    df = spark.createDataFrame([(s,) for s in (39, 40, 59, 60, 79, 80)], "s int")
    assert [r[0] for r in df.orderBy("s").select(health.risk(F.col("s"))).collect()] == ["Critical", "High", "High", "Medium", "Medium", "Low"]
    f = spark.createDataFrame([("a", "mb", "Modernization", 3)] * 2 + [("a", "legacy", "Modernization", 1)], "k string, rule_id string, category string, severity int")
    top = health.contributors(f, "k").filter("rank = 1").first()
    assert (top.rule_id, top.n, top.points) == ("mb", 2, 16)


@pytest.mark.parametrize("values,want", [([10, 20, 30, 40, 50], (20, 30, 40)), ([10, 40], (17.5, 25, 32.5)), ([42], (42, 42, 42))])
def test_benchmark(spark, values, want):
    r = health.benchmark(spark.createDataFrame([("a", v) for v in values], "k string, v int"), "k", "v").first()
    assert (r.p25, r.p50, r.p75) == want


def test_percentile_rank(spark):
    ranks = dict(health.percentile_rank(spark.createDataFrame([(v,) for v in (21, 47, 56, 89)], "v int"), "v").collect())
    assert ranks[21] == 12 and ranks[56] == 62 and ranks[89] == 88
    assert {r.pct_rank for r in health.percentile_rank(spark.createDataFrame([(45,)] * 3, "v int"), "v").collect()} == {50}
    r = health.benchmark(spark.createDataFrame([("a", v) for v in (88, 12, 100, 45)], "k string, v int"), "k", "v").first()
    assert (r.best, r.worst, r.p50) == (100, 12, 66.5)


def test_target_status(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([(1, 70, None, None), (2, 70, 70, t("2026-01-01")), (3, 50, 70, t("2026-01-01")), (4, 60, 70, t("2026-06-20")), (5, 40, 70, t("2027-01-01")), (6, 60, 70, t("2027-01-01"))], "i int, score int, target int, due timestamp_ntz")
    got = {r.i: r.s for r in df.select("i", health.target_status(F.col("score"), F.col("target"), F.col("due"), F.expr("timestamp_ntz '2026-06-01'")).alias("s")).collect()}
    assert got == {1: "None", 2: "Met", 3: "Missed", 4: "AtRisk", 5: "AtRisk", 6: "OnTrack"}


FACT = "actor string, tool string, period date, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, requests long, sessions long, estimated_cost decimal(18,6), provider string, reported_at timestamp"


def fact(period, cost, tokens=0, actor="a", tool="t", model="m", provider=None):
    return (actor, tool, period, model, tokens, 0, 0, 0, 1, 1, None if cost is None else Decimal(str(cost)), provider, None)


def test_forecast_golden_numbers(spark):
    today = DAY(2026, 9, 10)
    rows = [fact(today - dt.timedelta(i), 10) for i in range(10)] + [fact(today - dt.timedelta(i), 4) for i in range(10, 30)] + [fact(today, None, 500)]
    r = usage.forecast(spark.createDataFrame(rows, FACT), "2026-09-10", []).first()
    assert (r.month_to_date, r.projected, r.avg7, r.avg30, r.next30, r.trend_pct, r.month_unpriced) == (100, 300, 10, 6, 300, 66.67, 500)
    r = usage.forecast(spark.createDataFrame([fact(DAY(2026, 9, 2), 5), fact(DAY(2026, 9, 3), 5)], FACT), "2026-09-03", []).first()
    assert (r.month_to_date, r.projected, r.trend_pct) == (10, 100, None)


def test_forecast_seasonal(spark):
    today = DAY(2026, 9, 20)
    days = [today - dt.timedelta(i) for i in range(35)]
    rows = [fact(d, 2 if d.weekday() >= 5 else 10) for d in days]
    r = usage.forecast(spark.createDataFrame(rows, FACT), "2026-09-20", [], F.lit(1.5)).first()
    assert r.seasonal == r.month_to_date + 84 and r.high >= r.seasonal and r.calibrated == round(r.seasonal * 1.5, 2)


def test_live(spark):
    t = lambda hm: dt.datetime.fromisoformat(f"2026-09-07 {hm}:00")
    rows = [("ann", "x", DAY(2026, 9, 7), t("08:30"), 3000, Decimal("3.0"), 3), ("ann", "x", DAY(2026, 9, 7), t("09:50"), 7200, Decimal("7.2"), 7), ("bob", "x", DAY(2026, 9, 7), t("07:00"), 1000, Decimal("1.0"), 1)]
    e = spark.createDataFrame(rows, "actor string, tool string, period date, reported_at timestamp, tokens_today long, estimated_cost_today decimal(18,6), requests_today int")
    got = {r.actor: r for r in usage.live(e, "2026-09-07 10:00:00").collect()}
    assert len(got) == 2 and sum(r.active_now for r in got.values()) == 1 and sum(r.tokens_today for r in got.values()) == 8200
    assert got["ann"].tokens_last_hour == 4200 and got["bob"].tokens_last_hour == 0
    curve = usage.live_curve(e, "2026-09-07 10:00:00").orderBy("at").collect()
    assert curve[-1].at == t("10:00") and curve[-1].tokens == 8200 and curve[0].at == t("07:00")


def test_reconciliation_ratios(spark):
    days = [DAY(2026, 9, 1) + dt.timedelta(i) for i in range(10)]
    u = spark.createDataFrame([fact(d, 10, provider="openai") for d in days] + [fact(d, 10, provider="google") for d in days[:3]], FACT)
    c = spark.createDataFrame([("openai", "provider-reported", d, Decimal("12")) for d in days] + [("google", "provider-reported", d, Decimal("8")) for d in days[:3]] + [("mistral", "provider-reported", days[0], Decimal("5"))], "provider string, basis string, period date, amount decimal(18,6)")
    rec = usage.reconciliation(u, c)
    got = {r.provider: (r.ratio, r.usable) for r in rec.collect()}
    assert got == {"openai": (1.2, True), "google": (0.8, False), "mistral": (None, False)}
    assert usage.blended_ratio(rec).first().ratio == 1.2


def test_budget_alerts_and_anomaly(spark):
    today = "2026-09-20"
    f = spark.createDataFrame([fact(DAY(2026, 9, 2), 45, actor="ann"), fact(DAY(2026, 9, 3), 40, actor="bob")], FACT)
    teams = spark.createDataFrame([("core", ["ann"], 0)], "name string, members array<string>, ordinal int")
    b = spark.createDataFrame([("t", "tenant", None, 100.0, True), ("c", "team", "CORE", 50.0, True)], "id string, scope string, scope_key string, monthly_amount double, enabled boolean")
    none = spark.createDataFrame([], "key string")
    first = usage.budget_alerts(usage.budget_status(f, b, teams, today), none, today)
    assert first.count() == 4
    assert usage.budget_alerts(usage.budget_status(f, b, teams, today), first, today).count() == 0
    more = f.unionByName(spark.createDataFrame([fact(DAY(2026, 9, 4), 10, actor="ann")], FACT))
    assert usage.budget_alerts(usage.budget_status(more, b, teams, today), first, today).count() == 2 - (45 + 40 + 10 < 100)
    days = [fact(DAY(2026, 9, 1) + dt.timedelta(i), 2) for i in range(7)] + [fact(DAY(2026, 9, 8), 20)]
    assert [r.period for r in usage.anomalies(spark.createDataFrame(days, FACT)).collect()] == [DAY(2026, 9, 8)]


def test_counter_resets(spark):
    p = spark.createDataFrame([("s", 1, 1000.0, 1), ("s", 2, 1500.0, 1), ("s", 3, 50.0, 2), ("s", 4, 50.0, 2)], "k string, n int, v double, started long")
    assert [r.delta for r in latest.counter_deltas(p, ["k"], ["n"], "v", "started").orderBy("n").collect()] == [1000, 500, 50, 0]


def test_as_of(spark):
    f = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("b", 4, 40)], "k string, at int, v int")
    cuts = spark.createDataFrame([(3,), (4,), (6,)], "cut int")
    got = {(r.k, r.cut): r.v for r in latest.as_of(f, cuts, ["k"], "at", "cut", "v").collect()}
    assert got == {("a", 3): 10, ("a", 4): 10, ("a", 6): 50, ("b", 4): 40, ("b", 6): 40}


EXISTING = "fingerprint string, rule_id string, category string, severity int, title string, status string, first_seen string, last_seen string, resolved_in string, predecessor string"
CAND = "fingerprint string, rule_id string, category string, severity int, title string, ordinal int, previous string"


def old(fp, status="Open"):
    return (fp, "r", "Quality", 1, "t", status, "s0", "s0", "s0" if status == "Resolved" else None, None)


def test_reconcile_lifecycle(spark):
    existing = spark.createDataFrame([old("rec"), old("gone"), old("back", "Resolved"), old("mute", "Suppressed"), old("prev")], EXISTING)
    cands = spark.createDataFrame([("new", "r", "Quality", 2, "n", 0, "prev"), ("rec", "r", "Quality", 1, "t1", 1, None), ("rec", "r", "Quality", 3, "t2", 2, None), ("back", "r", "Quality", 1, "t", 3, None), ("mute", "r", "Quality", 1, "t", 4, None)], CAND)
    got = {r.fingerprint: r for r in fnd.reconcile(existing, cands, "s1", True).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"new": "new", "rec": "recurring", "back": "regressed", "mute": "recurring", "gone": "resolved", "prev": "resolved"}
    assert got["rec"].severity == 3 and got["rec"].title == "t2" and got["rec"].occurrences == 2
    assert got["back"].status == "Regressed" and got["back"].resolved_in is None
    assert got["mute"].status == "Suppressed" and got["new"].predecessor == "prev" and got["gone"].resolved_in == "s1"
    failed = {r.fingerprint: r.status for r in fnd.reconcile(existing, cands, "s1", False).collect()}
    assert failed["gone"] == "Open"


def test_fingerprints_ignore_case_and_separators(spark):
    df = spark.createDataFrame([("R.1 ", "./Src\\A.cs"), ("r.1", "src/a.cs")], "rule string, path string")
    got = df.select(fnd.fingerprint(F.col("rule"), F.lit(1), F.lit("Repo"), F.col("path"), F.lit("sym")).alias("f")).distinct()
    assert got.count() == 1


def test_policies_and_waivers(spark):
    f = spark.createDataFrame([("1", "sec.sql", "src/a/b.cs"), ("2", "sec.tls", "src/c.cs"), ("3", "quality.x", "tests/t.cs")], "fingerprint string, rule_id string, file_path string")
    now = F.expr("timestamp '2026-01-01'")
    p = spark.createDataFrame([("sec.*", "src/**/*.cs", None), ("quality.x", None, dt.datetime(2025, 1, 1))], "rule string, path_glob string, expires_at timestamp")
    assert {r.fingerprint for r in fnd.policy_matches(f, p, now).collect()} == {"1", "2"}
    w = spark.createDataFrame([("1", "ok", dt.datetime(2025, 6, 1), dt.datetime(2025, 1, 1), None)], "fingerprint string, reason string, expires_at timestamp, created_at timestamp, revoked_at timestamp")
    s = f.withColumn("status", F.lit("Suppressed"))
    assert {r.fingerprint: r.status for r in fnd.expired_waivers(s, w, now).collect()}["1"] == "Open"


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert sorted(r.node for r in graph.cycles(e).collect()) == ["a", "b", "c"]
    seeds = spark.createDataFrame([("b",)], "n string")
    assert sorted(r.node for r in graph.reachable_from(e, seeds).collect()) == ["a", "b", "c", "d"]
    assert {r.node: (r.fan_out, r.fan_in) for r in graph.degrees(e).collect()}["c"] == (2, 1)


def test_pattern_joins(spark):
    f = spark.createDataFrame([("gpt-5-mini-x",), ("gpt-5",), ("other",)], "model string")
    p = spark.createDataFrame([("^gpt-5-mini", 0, 1.0), ("^gpt-5", 1, 2.0)], "pattern string, ordinal int, price double")
    assert {r.model: r.price for r in matching.first_pattern(f, "model", p, "pattern", "ordinal", "price").collect()} == {"gpt-5-mini-x": 1.0, "gpt-5": 2.0, "other": None}


def test_modernization(spark):
    key = "k"
    f = spark.createDataFrame([("a", "dependency.migration-blocker.mb-007", "Modernization", 3, "p1", None), ("a", "quality.tests.none", "Quality", 2, None, None)], "k string, rule_id string, category string, severity int, file_path string, data map<string,string>")
    p = spark.createDataFrame([("a", "v4.7.2", False, None), ("a", "net48", False, "WebForms"), ("b", "net8.0", True, None)], "k string, target_framework string, is_sdk_style boolean, ui_framework string")
    e = spark.createDataFrame([("a", 20_000, 3.0, "Syntactic"), ("b", 1000, 1.0, "Full")], "k string, lines_of_code long, average_complexity double, tier string")
    prof = modernization.profile(f, p, e, key)
    row = {r.k: r for r in prof.collect()}
    assert row["a"].legacy == 2 and row["a"].high_blockers == 1 and row["a"].has_wcf and row["a"].test_deficit and row["b"].has_tests
    best = {r.k: r.strategy for r in modernization.strategies(prof, key).filter("recommended").collect()}
    assert best["b"] == "KeepStabilize" and best["a"] != "KeepStabilize"
    cost = {(r.k, r.strategy): r for r in modernization.costs(prof, key).collect()}
    assert all(r.optimistic < r.hours < r.conservative for r in cost.values())
    chosen = modernization.strategies(prof, key).filter("recommended").join(modernization.costs(prof, key), [key, "strategy"]).select(key, "strategy", "hours")
    shares = modernization.roadmap(prof, chosen, key).groupBy(key).agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 0.01 for r in shares)
    c = modernization.calibration(spark.createDataFrame([(100.0, 150.0), (100.0, 140.0), (100.0, 90.0)], "estimated_hours double, actual_hours double")).first()
    assert (c.points, c.median_ratio, c.advice) == (3, 1.4, "raise-rates")


@pytest.mark.parametrize("n, m, seed", [(12, 14, 1), (12, 60, 2), (40, 39, 3), (6, 36, 4)])
def test_reachable_against_brute_force(spark, n, m, seed):
    r = random.Random(seed)
    edges = {(i, i + 1) for i in range(m)} if n == m + 1 else {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    paths = set(edges)
    while more := {(a, d) for a, b in paths for c, d in edges if b == c} - paths:
        paths |= more
    got = [tuple(x) for x in graph.reachable(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()]
    assert sorted(got) == sorted(paths)


@pytest.mark.parametrize("n, m, seed, most", [(20, 24, 1, 10**9), (14, 20, 3, 60), (16, 12, 5, 12)])
def test_reach_counts_against_brute_force(spark, n, m, seed, most, monkeypatch):
    """Cycles, loops, a graph without long cycles, and nulls; all pairs at once and in blocks."""
    monkeypatch.setattr(graph, "ROUNDS", 2)
    r = random.Random(seed)
    edges = {tuple(r.sample(range(n), 2)) for _ in range(m)} | {(3, 3), (n, n), (None, 4), (5, None), (None, None)}
    if seed == 5:
        edges = {e if None in e else tuple(sorted(e)) for e in edges}
    paths = set(edges)
    while more := {(a, d) for a, b in paths for c, d in edges if b == c and b is not None} - paths:
        paths |= more
    e = spark.createDataFrame(list(edges), "src long, dst long")
    ahead = graph._weights_ahead
    monkeypatch.setattr(graph, "_weights_ahead", lambda dag, weights, _: ahead(dag, weights, most))
    got = {x.src: x.n for x in graph.reach_counts(e, most=most).collect()}
    assert got == {a: len({(d,) for s, d in paths if s == a}) for a, _ in paths}


def test_reach_counts_make_no_row_a_pair(spark, monkeypatch):
    """600 nodes on one cycle with 100 ends have 420,000 pairs; no table that is written holds more rows than the edges."""
    written = []
    monkeypatch.setattr(graph, "_cut", lambda df, cut=graph._cut: written.append(cut(df)) or written[-1])
    edges = spark.range(600).selectExpr("id as src", "explode(array((id + 1) % 600, id * 7 % 600, (id * 11 + 5) % 600)) as dst").unionByName(spark.range(100).selectExpr("id * 6 as src", "id + 1000 as dst"))
    got = graph.reach_counts(edges).collect()
    assert len(got) == 600 and {x.n for x in got} == {700}
    assert max(df.count() for df in written) <= edges.count()
