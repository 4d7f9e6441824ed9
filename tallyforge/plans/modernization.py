"""Modernization: profile of an estate, fit of six strategies, cost, savings, roadmap, calibration. One row an estate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ladder

# Fixed values of the model: hours a thousand lines, and the share of blocker work, of each strategy in order.
STRATEGIES = {
    "KeepStabilize": (2.0, 0.0),
    "UpgradeInPlace": (12.0, 1.0),
    "Incremental": (18.0, 1.0),
    "Strangler": (24.0, 1.0),
    "PartialRewrite": (0.0, 0.5),
    "FullRewrite": (60.0, 0.25),
}
# Default parameters; any may be given anew.
PARAMETERS = {
    "prerequisite_hours": 8.0, "high_hours": 80.0, "medium_hours": 24.0,
    "critical_security_hours": 16.0, "high_security_hours": 8.0, "medium_security_hours": 3.0, "secret_hours": 4.0, "package_hours": 4.0,
    "no_tests": 1.3, "low_coverage": 1.15, "unknown_coverage": 1.1, "high_complexity": 1.2, "coupling": 1.1,
    "optimistic": 0.75, "conservative": 1.5, "low_optimistic": 0.6, "low_conservative": 2.0,
    "team": 4.0, "hours_month": 120.0, "rate": 60.0,
    "hosting_year": 1200.0, "support_year": 800.0, "sql_year": 5000.0,
}
RISKS = ["Low", "Medium", "High", "Critical"]


def is_legacy(framework: Column) -> Column:
    f = F.lower(F.trim(framework))
    return F.coalesce(f.startswith("v") | f.rlike(r"^net[1-4][0-9]{1,2}$"), F.lit(False))


def profile(findings: DataFrame, projects: DataFrame, estates: DataFrame, key: str) -> DataFrame:
    """One row an estate from findings (key, rule_id, category, severity, file_path, data map), projects (key,
    target_framework, is_sdk_style, ui_framework) and estates (key, lines_of_code, average_complexity, tier)."""
    rule = F.col("rule_id")
    prefix = "dependency.migration-blocker."
    blocker = rule.startswith(prefix)
    code = F.regexp_extract(rule, r"(mb-\d+)$", 1)
    pre, high = blocker & code.isin("mb-001", "mb-002"), blocker & code.isin("mb-003", "mb-007", "mb-008", "mb-009", "mb-010")
    sev = lambda s: F.count_if((F.col("category") == "Security") & (F.col("severity") == s))
    per = findings.groupBy(key).agg(
        F.count_if(pre).alias("prerequisite_blockers"), F.count_if(high).alias("high_blockers"), F.count_if(blocker & ~pre & ~high).alias("medium_blockers"),
        F.countDistinct(F.when(high, code)).alias("high_blocker_rules"), F.countDistinct(F.when(blocker, code)).alias("blocker_rules"),
        F.countDistinct(F.when(blocker, F.lower(F.coalesce("file_path", "rule_id")))).alias("blocked_files"),
        sev(4).alias("critical_security"), sev(3).alias("high_security"), sev(2).alias("medium_security"),
        F.count_if(F.col("category") == "Secrets").alias("secrets"), F.count_if(rule == "dependency.package.vulnerable").alias("vulnerable_packages"),
        (~F.bool_or(rule == "quality.tests.none")).alias("has_tests"), F.max(F.when(rule == "quality.coverage.summary", F.try_element_at("data", F.lit("lineRate")).try_cast("double"))).alias("coverage"),
        F.count_if(rule == "quality.tests.project-uncovered").alias("untested_projects"), F.count_if(rule.isin("architecture.cycle.project", "architecture.cycle.namespace")).alias("cycles"),
        F.coalesce(F.bool_or(blocker & code.isin("mb-003", "mb-004")), F.lit(False)).alias("_web"), F.coalesce(F.bool_or(blocker & code.isin("mb-007", "mb-008", "mb-009", "mb-010")), F.lit(False)).alias("has_wcf"), F.coalesce(F.bool_or(blocker & (code == "mb-006")), F.lit(False)).alias("has_ef6"),
    )
    fw = F.col("target_framework")
    proj = projects.groupBy(key).agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(is_legacy(fw)).alias("legacy"), F.count_if(F.coalesce(F.trim(fw) == "", F.lit(True))).alias("unknown"),
        F.count_if(~F.col("is_sdk_style")).alias("legacy_format"), F.count_if(F.col("ui_framework").isin("WebForms", "AspNetMvc5")).alias("_web_projects"),
        F.count_if(F.col("ui_framework").isin("WebForms", "AspNetMvc5", "AspNetWebApi2", "Silverlight", "Wcf", "XamarinForms")).alias("no_upgrade_path"), F.count_if(F.col("ui_framework").isin("WinForms", "Wpf")).alias("desktop"),
    )
    df = estates.join(proj, key, "left").join(per, key, "left")
    numbers = [c for c, t in df.dtypes if t == "bigint" and c != key]
    df = df.fillna(0, numbers).fillna(True, ["has_tests"]).fillna(False, ["_web", "has_wcf", "has_ef6"])
    share = lambda c: F.coalesce(F.try_divide(c, F.col("projects")), F.lit(0.0))
    blocked = F.least(F.col("blocked_files"), F.greatest(F.lit(1), F.col("projects")))
    return df.withColumns({"modern": F.col("projects") - F.col("legacy") - F.col("unknown"), "unknown_share": share(F.col("unknown")), "blocked_share": share(blocked), "has_web": F.col("_web") | (F.col("_web_projects") > 0), "test_deficit": ~F.col("has_tests") | F.coalesce(F.col("coverage") < 0.3, F.lit(False))}).drop("_web", "_web_projects", "blocked_files")


def _fit(start: int, *terms: tuple[Column, object]) -> Column:
    total = sum((F.when(cond, F.lit(v) if not isinstance(v, Column) else v).otherwise(0) for cond, v in terms), F.lit(start))
    return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")


def strategies(p: DataFrame, key: str) -> DataFrame:
    """(key, strategy, place, fit, risk, recommended): additive integer fits within 0 to 100; the best fit, then the least
    risk, then the order of the strategies recommends."""
    c = F.col
    legacy, high, loc, n, web, deficit = c("legacy") > 0, c("high_blockers") > 0, c("lines_of_code"), c("projects"), c("has_web"), c("test_deficit")
    debt = c("critical_security") + c("high_security") > 0
    sound = (c("legacy") == 0) & (c("unknown_share") < 0.5)
    level = lambda *cases, default: ladder([(w, RISKS.index(v)) for w, v in cases], RISKS.index(default))
    rows = {
        "KeepStabilize": (_fit(20, (sound, 55), (~sound, -20), (~debt, 10), (c("blocker_rules") == 0, 10)), level((legacy, "High"), (debt, "Medium"), default="Low")),
        "UpgradeInPlace": (_fit(30, (c("no_upgrade_path") > 0, -F.least(F.lit(30), 10 * c("no_upgrade_path"))), ((c("desktop") > 0) & (c("no_upgrade_path") == 0), 5), (legacy, 25), (~high, 30), (high, -F.least(F.lit(40), 10 * c("high_blocker_rules") + F.floor(c("high_blockers") / 5) * 5)), (web, -15), (loc < 150_000, 10), (deficit, -10)), level((high, "High"), (deficit, "Medium"), default="Low")),
        "Incremental": (_fit(40, (legacy, 15), (high, 20), (n.between(5, 60), 15), (~deficit, 10), (c("cycles") > 0, 5)), level((deficit, "Medium"), default="Low")),
        "Strangler": (_fit(20, ((loc >= 300_000) | (n > 40), 30), (web | c("has_wcf"), 25), (c("high_blockers") >= 3, 10), (n < 5, -25)), level((loc >= 300_000, "High"), default="Medium")),
        "PartialRewrite": (_fit(15, (high & (c("blocked_share") > 0) & (c("blocked_share") <= 0.35), 45), (high & ~((c("blocked_share") > 0) & (c("blocked_share") <= 0.35)), 10), (web, 15), (deficit, -10)), F.lit(2)),
        "FullRewrite": (_fit(5, ((loc > 0) & (loc < 40_000) & high, 45), ((c("high_blockers") >= 4) & (c("blocked_share") > 0.6), 20), (loc >= 150_000, -30), (deficit, -15)), level((deficit, "Critical"), default="High")),
    }
    all_ = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(i).alias("place"), fit.alias("fit"), r.cast("int").alias("risk_level")) for i, (s, (fit, r)) in enumerate(rows.items())])
    df = p.select(key, F.inline(all_))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fit"), "risk_level", "place")) == 1
    return df.select(key, "strategy", "place", "fit", F.element_at(F.array(*map(F.lit, RISKS)), F.col("risk_level") + 1).alias("risk"), first.alias("recommended"))


def costs(p: DataFrame, key: str, parameters: dict | None = None) -> DataFrame:
    """(key, strategy, hours, optimistic, conservative, months, cost, confidence) of every strategy.

    Hours by thousand lines, blockers at the strategy's share and security debt, times multipliers for missing tests,
    complexity and cycles; floors of 8 and 40 hours; rounded to tens, half-even, and a range that never closes.
    """
    v = PARAMETERS | (parameters or {})
    c = F.col
    kloc = c("lines_of_code") / 1000.0
    table = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(h).alias("per_kloc"), F.lit(b).alias("blocker_share")) for s, (h, b) in STRATEGIES.items()])
    df = p.select("*", F.inline(table))
    rewritten = F.least(F.lit(0.7), F.greatest(F.lit(0.1), F.when(c("blocked_share") == 0, 0.3).otherwise(c("blocked_share"))))
    base = F.when(c("strategy") == "PartialRewrite", kloc * rewritten * STRATEGIES["FullRewrite"][0] + kloc * (1 - rewritten) * STRATEGIES["UpgradeInPlace"][0]).otherwise(kloc * c("per_kloc"))
    blockers = (c("prerequisite_blockers") * v["prerequisite_hours"] + c("high_blockers") * v["high_hours"] + c("medium_blockers") * v["medium_hours"]) * c("blocker_share")
    debt = c("critical_security") * v["critical_security_hours"] + c("high_security") * v["high_security_hours"] + c("medium_security") * v["medium_security_hours"] + c("secrets") * v["secret_hours"] + c("vulnerable_packages") * v["package_hours"]
    keep = c("strategy") == "KeepStabilize"
    tests = F.when(~c("has_tests"), v["no_tests"]).when(c("coverage") < 0.3, v["low_coverage"]).when(c("coverage").isNull(), v["unknown_coverage"]).otherwise(1.0)
    factor = tests * F.when(c("average_complexity") > 10, v["high_complexity"]).otherwise(1.0) * F.when((c("cycles") > 0) & (c("strategy") != "FullRewrite"), v["coupling"]).otherwise(1.0)
    df = df.withColumn("raw", F.greatest((base + blockers + debt) * F.when(keep, 1.0).otherwise(factor), F.when(keep, 8.0).otherwise(40.0)))
    low = (c("lines_of_code") == 0) | (c("projects") == 0) | (c("unknown_share") > 0.3)
    sure = c("tier").isin("SyntacticWithSymbols", "Full") & c("coverage").isNotNull() & (c("unknown_share") == 0)
    df = df.withColumn("confidence", F.when(low, "Low").when(sure, "High").otherwise("Medium"))
    tens = lambda x: F.bround(x / 10) * 10
    df = df.withColumn("hours", tens(c("raw")))
    opt, con = F.when(low, v["low_optimistic"]).otherwise(v["optimistic"]), F.when(low, v["low_conservative"]).otherwise(v["conservative"])
    df = df.withColumns({"optimistic": F.least(tens(c("raw") * opt), F.greatest(F.lit(5.0), c("hours") - 10)), "conservative": F.greatest(tens(c("raw") * con), c("hours") + 10)})
    month = max(1.0, v["team"]) * v["hours_month"]
    return df.select(key, "strategy", "hours", "optimistic", "conservative", F.greatest(F.lit(1.0), F.bround(c("hours") / month, 1)).alias("months"), F.bround(c("hours") * v["rate"], 0).alias("cost"), "confidence")


def savings(p: DataFrame, key: str, parameters: dict | None = None) -> DataFrame:
    """(key, hosting, support, sql_server, annual); annual is null where nothing legacy runs."""
    v = PARAMETERS | (parameters or {})
    legacy = F.col("legacy")
    sql = F.when(F.col("has_ef6"), v["sql_year"]).otherwise(0.0)
    total = legacy * (v["hosting_year"] + v["support_year"]) + sql
    return p.select(key, (legacy * v["hosting_year"]).alias("hosting"), (legacy * v["support_year"]).alias("support"), F.when(legacy > 0, sql).otherwise(0.0).alias("sql_server"), F.when((legacy > 0) & (total > 0), total).alias("annual"))


def payback_months(cost: Column, annual: Column, share: Column, most: int = 120) -> Column:
    """Cost over the month's share of the savings; null without savings, `most` at the longest."""
    return F.when(annual > 0, F.least(F.lit(float(most)), F.bround(F.try_divide(cost, annual * share / 12), 1)))


def roadmap(p: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, place, phase, share, hours) of the phases that the chosen strategy (key, strategy, hours) and the profile call
    for; shares add up to one."""
    c = F.col
    s = c("strategy")
    keep, full, upgrade = s == "KeepStabilize", s == "FullRewrite", s == "UpgradeInPlace"
    security = c("critical_security") * PARAMETERS["critical_security_hours"] + c("high_security") * PARAMETERS["high_security_hours"] + c("medium_security") * PARAMETERS["medium_security_hours"] + c("secrets") * PARAMETERS["secret_hours"] + c("vulnerable_packages") * PARAMETERS["package_hours"]
    ground = ~keep & ~full & ((c("legacy") > 0) | (c("legacy_format") > 0) | (c("prerequisite_blockers") > 0))
    phases = [
        ("baseline", F.lit(True), F.lit(0.04)),
        ("security", c("critical_security") + c("high_security") + c("secrets") + c("vulnerable_packages") > 0, F.least(F.lit(0.35), F.greatest(F.lit(0.05), security / F.greatest(F.lit(1.0), c("hours"))))),
        ("tests", c("test_deficit") & ~keep, F.lit(0.15)),
        ("foundation", ground, F.when(upgrade, 0.45).otherwise(0.20)),
        ("domain", s.isin("Incremental", "Strangler", "PartialRewrite", "FullRewrite") | (upgrade & (c("high_blockers") > 0)), F.when(upgrade, 0.20).otherwise(0.35)),
        ("data-integration", (c("has_ef6") | c("has_wcf")) & ~keep, F.lit(0.12)),
        ("retirement", s.isin("Strangler", "PartialRewrite", "FullRewrite"), F.lit(0.05)),
    ]
    array = F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("phase"), w.alias("weight"))) for name, cond, w in phases]), lambda x: x.isNotNull())
    df = p.join(chosen, key).select(key, "hours", F.posexplode(array).alias("place", "x")).select(key, "hours", "place", "x.phase", "x.weight")
    share = c("weight") / c("total")
    df = df.withColumn("total", F.sum("weight").over(Window.partitionBy(key)))
    return df.select(key, "place", "phase", F.bround(share, 3).alias("share"), (F.bround(c("hours") * share / 10) * 10).alias("hours"))


def calibration(points: DataFrame) -> DataFrame:
    """One row: points, mean and median of actual over estimated hours, and what to do from three points on."""
    r = F.col("actual_hours") / F.col("estimated_hours")
    df = points.filter("estimated_hours > 0").agg(F.count(F.lit(1)).alias("points"), F.bround(F.avg(r), 2).alias("mean_ratio"), F.bround(F.median(r), 2).alias("median_ratio"))
    advice = ladder([(F.col("points") == 0, "none"), (F.col("points") < 3, "too-few"), (F.col("median_ratio") > 1.25, "raise-rates"), (F.col("median_ratio") < 0.8, "lower-rates")], "ok")
    return df.withColumn("advice", advice)


def rule_candidates(methods: DataFrame, key: str, k: int) -> DataFrame:
    """Methods that most likely hold business rules: by complexity, literal comparisons, throws, arithmetic, domain names."""
    score = F.col("complexity") + 1.5 * F.col("comparisons") + F.col("throws") + 0.5 * F.least(F.col("arithmetic"), F.lit(6)) + F.when(F.col("is_domain"), 4).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "symbol")
    return methods.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
