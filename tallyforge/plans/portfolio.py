"""The portfolio: what assessments hold, who may change them, when they run, and what rules say over all of them.

`now` and `today` are columns; a row of `assessments` is one assessment, `key` its id column.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ladder, localized, path_normalize, repository_key, template_fill
from ..operators.latest import latest_per_key
from .health import benchmark, percentile_rank
from .modernization import is_legacy

OPEN = ("Open", "Regressed")
# Severities, risks, target states and categories in their order; roles; states of jobs from weak to strong.
SEVERITIES = ["Informational", "Low", "Medium", "High", "Critical"]
RISKS = ["Low", "Medium", "High", "Critical"]
TARGETS = ["None", "Met", "OnTrack", "AtRisk", "Missed"]
ACTIVE = ["Queued", "Leased", "Running"]
# Tokens an AI request takes for a method, for itself, and gives for a method.
TOKENS_IN, TOKENS_REQUEST, TOKENS_OUT = 1100, 650, 180
# Packages, assemblies and names that tell of a test project, and packages that only look like it.
TEST_PACKAGES = ["xunit", "nunit", "mstest", "microsoft.net.test.sdk"]
TEST_ASSEMBLIES = ["nunit.framework", "microsoft.visualstudio.qualitytools", "xunit"]
TEST_NAME = r"(?i)(\.|^)(Unit|Integration)?Tests?$"
NOT_TEST = ["xunit.abstractions", "xunit.extensibility", "nunit.engine"]


# Predicates


def has_tag(tags: Column, tag: str) -> Column:
    """tags: an array, or null; letters of either case agree, blanks around the wanted tag do not count."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag.strip().lower()), F.lit(False))


def window_days(days: Column, most: int = 400, default: int = 30) -> Column:
    return F.least(F.when(days <= 0, default).otherwise(days), F.lit(most))


def in_window(day: Column, today: Column, days: Column) -> Column:
    """day lies in the window of days that ends today, both ends in."""
    return day.between(F.date_sub(today, window_days(days).cast("int")), today)


def is_due(every_days: Column, status: Column, completed: Column, created: Column, now: Column) -> Column:
    """Whole days since the last completion, or the creation, reach every_days; what never ran or runs is not due."""
    last = F.coalesce(completed, created)
    due = now >= F.timestamp_add("DAY", every_days.cast("int"), last)
    return F.coalesce((every_days > 0) & ~status.isin("Created", "Running") & due, F.lit(False))


def is_test_project(name: Column, packages: Column, assemblies: Column) -> Column:
    none = F.array().cast("array<string>")
    begins = lambda v, words: F.greatest(*[v.startswith(w) for w in words], F.lit(False))
    package = lambda p: ~begins(F.lower(p), NOT_TEST) & (F.lower(p).isin(TEST_PACKAGES) | begins(F.lower(p), [f"{m}." for m in TEST_PACKAGES]))
    assembly = lambda a: begins(F.lower(a), TEST_ASSEMBLIES)
    return name.rlike(TEST_NAME) | F.exists(F.coalesce(packages, none), package) | F.exists(F.coalesce(assemblies, none), assembly)


def next_run(now: Column, hour: int) -> Column:
    """The next time that it is `hour` o'clock, later than now."""
    today = F.timestamp_add("HOUR", F.lit(hour), F.date_trunc("day", now))
    return F.when(today > now, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))


def access(assessments: DataFrame, entries: DataFrame, key: str, subject: str | None, admin: bool = False) -> DataFrame:
    """(key, restricted, role, can_manage, can_edit) of every assessment for a subject, by entries (key, subject, role)."""
    mine = F.col("subject") == F.lit((subject or "").strip().lower())
    per = entries.groupBy(key).agg(F.first(F.when(mine, F.col("role")), ignorenulls=True).alias("role"), F.lit(True).alias("has"))
    df = assessments.select(key).join(per, key, "left").withColumn("restricted", F.coalesce("has", F.lit(False)))
    role = F.col("role")
    manage = F.lit(admin) | F.coalesce(role == "Owner", F.lit(False))
    edit = F.lit(admin) | ~F.col("restricted") | F.coalesce(role.isin("Owner", "Editor"), F.lit(False))
    return df.select(key, "restricted", "role", manage.alias("can_manage"), edit.alias("can_edit"))


def already_scanned(wanted: DataFrame, scans: DataFrame) -> DataFrame:
    """wanted (assessment_id, scanner_id, commit) that a succeeded scan covers."""
    return wanted.join(scans.filter("status = 'Succeeded'"), ["assessment_id", "scanner_id", "commit"], "left_semi")


def collectable(workspaces: DataFrame, now: Column) -> DataFrame:
    """Workspaces to clear: released, failed, or ready with a lease that has run out."""
    return workspaces.filter(F.col("state").isin("Released", "Failed") | ((F.col("state") == "Ready") & (F.col("lease_expires") < now)))


def orphaned(archives: DataFrame, assessments: DataFrame, now: Column, retention_days: int) -> DataFrame:
    """Archives (id, written) that no assessment's locator names and that are older than the retention."""
    used = assessments.select(F.lower(F.replace("locator", F.lit("-"), F.lit(""))).alias("used")).distinct()
    old = archives.filter(now >= F.timestamp_add("DAY", F.lit(retention_days), F.col("written")))
    return old.join(used, F.lower("id") == F.col("used"), "left_anti")


# Counts and lookups


def with_rule_texts(findings: DataFrame, rules: DataFrame, language: str) -> DataFrame:
    """findings (rule_id, title, message, remediation, data map) with localized texts: the rule's template in the language
    filled from data, else what the finding says, else what the rule says, else the rule's id.

    rules: rule_id, rule_title, rule_remediation, titles and messages and remediations (maps from language to text).
    """
    df = findings.join(rules, "rule_id", "left")
    text = lambda c: F.when(F.col(c).isNotNull(), localized(F.col(c), language, language))
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    said = text("titles")
    return df.select(
        *findings.columns,
        F.coalesce(template_fill(said, data), "title", "rule_title", "rule_id").alias("shown_title"),
        F.coalesce(template_fill(text("messages"), data), "message").alias("shown_message"),
        F.coalesce(text("remediations"), "remediation", "rule_remediation").alias("shown_remediation"),
    )


def project_counts(runs: DataFrame, inventories: DataFrame, key: str) -> DataFrame:
    """(key, project_count): what the run found, else the latest inventory's projects, else a project for twenty files, one
    at least where there are files. runs: key, projects, files; inventories: key, project_count."""
    known = inventories.groupBy(key).agg(F.sum("project_count").alias("known"))
    guess = F.when(F.col("files") > 0, F.greatest(F.lit(1), F.bround(F.col("files") / 20.0))).otherwise(0).cast("long")
    return runs.join(known, key, "left").select(key, F.coalesce(F.nullif("projects", F.lit(0)), F.nullif("known", F.lit(0)), guess).cast("long").alias("project_count"))


def rule_catalog(catalog: DataFrame, overrides: DataFrame, open_: DataFrame) -> DataFrame:
    """catalog (rule_id, category, severity) with the tenant's severity and live counts from open_ (assessment_id, rule_id, n)."""
    live = open_.groupBy("rule_id").agg(F.sum("n").alias("n"), F.countDistinct("assessment_id").alias("assessments"))
    tuned = overrides.select("rule_id", F.col("severity").alias("tuned"))
    return catalog.join(tuned, "rule_id", "left").join(live, "rule_id", "left").fillna(0, ["n", "assessments"])


def summary(assessments: DataFrame, projects: DataFrame, inventories: DataFrame, open_: DataFrame, key: str) -> DataFrame:
    """(section, item, value) of the whole portfolio.

    assessments: key, score, risk, target; projects: key, target_framework; inventories: key, lines, files; open_: key,
    severity, category, n. Each section is one aggregate; sections with a fixed list show all of its items.
    """
    spark = assessments.sparkSession
    row = lambda section, item, value: F.struct(F.lit(section).alias("section"), (item if isinstance(item, Column) else F.lit(item)).alias("item"), value.cast("double").alias("value"))
    one = lambda df, rows: df.select(F.inline(F.array(*rows)))

    def listed(section: str, items: list[str], df: DataFrame, column: Column, value: Column) -> DataFrame:
        got = df.groupBy(column.alias("item")).agg(value.cast("double").alias("value"))
        return spark.createDataFrame([(section, i) for i in items], "section string, item string").join(got, "item", "left").select("section", "item", F.coalesce("value", F.lit(0.0)).alias("value"))

    n = F.count(F.lit(1))
    assessed = assessments.filter("score is not null")
    framework = F.coalesce(F.nullif(F.lower(F.trim("target_framework")), F.lit("")), F.lit("unknown"))
    kinds = projects.select(framework.alias("f"), is_legacy(F.col("target_framework")).alias("old"))
    parts = [
        one(assessments.agg(n.alias("n"), F.count("score").alias("assessed"), F.bround(F.avg("score"), 1).alias("mean")), [row("count", "assessments", F.col("n")), row("count", "assessed", F.col("assessed")), row("score", "average", F.col("mean"))]),
        one(inventories.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("l"), F.coalesce(F.sum("files"), F.lit(0)).alias("f")), [row("count", "lines", F.col("l")), row("count", "files", F.col("f"))]),
        one(kinds.agg(F.count_if("old").alias("o"), F.count_if(~F.col("old") & (F.col("f") == "unknown")).alias("u"), n.alias("n")), [row("projects", "legacy", F.col("o")), row("projects", "unknown", F.col("u")), row("projects", "modern", F.col("n") - F.col("o") - F.col("u")), row("projects", "all", F.col("n"))]),
        kinds.groupBy(F.lit("framework").alias("section"), F.col("f").alias("item")).agg(n.cast("double").alias("value")),
        listed("risk", RISKS, assessed, F.col("risk"), n),
        listed("target", TARGETS, assessments, F.col("target"), n),
        listed("severity", SEVERITIES, open_, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity") + 1), F.sum("n")),
        open_.groupBy(F.lit("category").alias("section"), F.col("category").alias("item")).agg(F.sum("n").cast("double").alias("value")),
        one(open_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), [row("count", "open", F.col("n"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows(assessments: DataFrame, projects: DataFrame, inventories: DataFrame, key: str) -> DataFrame:
    """assessments (key, score and whatever else) with lines, projects, legacy_projects and percentile, the mid-rank of its score among
    those that have one; lowest scores first, those without one last. projects: key, target_framework; inventories: key, lines."""
    n = projects.groupBy(key).agg(F.count(F.lit(1)).alias("projects"), F.count_if(is_legacy(F.col("target_framework"))).alias("legacy_projects"))
    lines = inventories.groupBy(key).agg(F.sum("lines").alias("lines"))
    ranks = percentile_rank(assessments.filter("score is not null").select(key, "score"), "score").select(key, F.col("pct_rank").alias("percentile"))
    df = assessments.join(lines, key, "left").join(n, key, "left").join(ranks, key, "left")
    return df.fillna(0, ["lines", "projects", "legacy_projects"]).orderBy(F.asc_nulls_last("score"), key)


def dimension_benchmark(snapshots: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, n, p25, p50, p75, best, worst) of the whole portfolio: Overall, then each dimension. snapshots: score, score_<name>.

    Scores are whole numbers from 0 to 100, so counts of them by value are all that a group holds."""
    columns = [("Overall", "score"), *[(d, f"score_{d.lower()}") for d in dimensions]]
    each = snapshots.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in columns])))
    return benchmark(each.filter("value is not null"), "dimension", "value")


def report(summary_: DataFrame, trend: DataFrame) -> DataFrame:
    """(section, item, value): the summary and the trend (day, mean_score, open_findings) in one table, ready to be written."""
    rows = F.array(*[F.struct(F.lit(f"trend.{c}").alias("section"), F.date_format("day", "yyyy-MM-dd").alias("item"), F.col(c).cast("double").alias("value")) for c in ("mean_score", "open_findings")])
    return summary_.unionByName(trend.select(F.inline(rows)))


def project_risk(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, name, findings, critical, high, medium, low): open findings by the project whose folder is the longest above
    them; a project at the root owns the rest. projects: path, name; findings: file_path, severity.

    Files meet folders by their ancestors, so the join is one of equal keys. Of projects in one folder the first by path owns.
    """
    folder = F.lower(F.regexp_replace(F.regexp_replace(path_normalize(F.col("path")), r"(^|/)[^/]*$", ""), r"^/+|/+$", ""))
    owners = latest_per_key(projects.withColumn("folder", folder), ["folder"], [F.col("path")]).select("folder", F.col("path").alias("owner"))
    counts = findings.filter("file_path is not null").groupBy(path_normalize(F.col("file_path")).alias("file")).agg(*[F.count_if(F.col("severity") == s).alias(SEVERITIES[s].lower()) for s in range(5)])
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = counts.select("*", F.explode(above).alias("folder")).join(owners, "folder").groupBy("file").agg(F.max_by(F.struct("owner", *[s.lower() for s in SEVERITIES]), F.length("folder")).alias("m"))
    levels = [s.lower() for s in SEVERITIES]
    per = near.select("m.*").groupBy(F.col("owner").alias("path")).agg(*[F.sum(s).alias(s) for s in levels])
    out = projects.select("path", "name").join(per, "path", "left").fillna(0, levels)
    return out.select("path", "name", sum((F.col(s) for s in levels), F.lit(0)).alias("findings"), "critical", "high", "medium", "low")


def inventory_totals(snapshots: DataFrame, key: str) -> DataFrame:
    """Sums and maxima over an assessment's languages; complexity, resolution and tier are those of the one with most lines."""
    best = F.max_by(F.struct("language", "average_complexity", "resolution_rate", "tier"), F.struct("lines", "language"))
    out = snapshots.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("lines", "files", "types", "methods")], F.max("max_complexity").alias("max_complexity"), best.alias("b"))
    return out.select(key, "lines", "files", "types", "methods", "max_complexity", "b.language", "b.average_complexity", "b.resolution_rate", "b.tier")


def resolution_rate(resolved: Column, sampled: Column) -> Column:
    return F.coalesce(F.try_divide(resolved, sampled), F.lit(0.0))


def run_counters(scans: DataFrame, key: str) -> DataFrame:
    """Scanners run and failed, and findings by outcome, of each run from its scans (key, succeeded, created, recurring,
    resolved, regressed)."""
    return scans.groupBy(key).agg(F.count(F.lit(1)).alias("scanners_run"), F.count_if(~F.col("succeeded")).alias("scanners_failed"), *[F.sum(c).alias(c) for c in ("created", "recurring", "resolved", "regressed")])


def active_states(jobs: DataFrame, key: str) -> DataFrame:
    """(key, state): the strongest active state of each assessment's jobs; those without an active job are left out."""
    rank = ladder([(F.col("state") == s, i + 1) for i, s in enumerate(ACTIVE)])
    per = jobs.filter(F.col("state").isin(ACTIVE)).groupBy(key).agg(F.max(rank).alias("r"))
    return per.select(key, F.element_at(F.array(*map(F.lit, ACTIVE)), F.col("r")).alias("state"))


def next_run_number(assessments: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    top = runs.groupBy(key).agg(F.max("number").alias("n"))
    return assessments.select(key).join(top, key, "left").select(key, (F.coalesce("n", F.lit(0)) + 1).alias("number"))


def previous_run(runs: DataFrame, key: str) -> DataFrame:
    """runs (key, number, status) with the number of the completed run before; null for a first one."""
    w = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("previous", F.last(F.when(F.col("status") == "Completed", F.col("number")), ignorenulls=True).over(w))


def credential_usage(credentials: DataFrame, assessments: DataFrame) -> DataFrame:
    used = assessments.filter("credential_id is not null").groupBy("credential_id").agg(F.count(F.lit(1)).alias("assessments"))
    return credentials.select("credential_id").join(used, "credential_id", "left").fillna(0, ["assessments"])


def source_locators(assessments: DataFrame) -> DataFrame:
    return assessments.select("source_kind", "locator").distinct()


def find_by_locator(lookups: DataFrame, assessments: DataFrame, key: str) -> DataFrame:
    """lookups (lookup_id, source_kind, locator, branch) with the assessment of the same repository that fits best: that of the
    branch, else one without a branch, else any, the newest first each time; null where there is none."""
    a = assessments.select(F.col("source_kind"), repository_key(F.col("locator")).alias("repository"), F.col("branch").alias("has"), "created_at", key)
    df = lookups.withColumn("repository", repository_key(F.col("locator"))).join(a, ["source_kind", "repository"], "left")
    rank = ladder([(F.lower("branch") == F.lower("has"), 0), (F.col("has").isNull(), 1)], 2)
    return latest_per_key(df.withColumn("rank", rank), ["lookup_id"], [F.col("rank"), F.desc_nulls_last("created_at"), F.col(key)]).select("lookup_id", key)


def merged_candidates(sources: list[DataFrame], most: int) -> DataFrame:
    """The best of several sources of business-rule candidates (score, file_path, start_line, snippet)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(F.desc("score"), "file_path", "start_line").limit(max(1, most))


def batched(candidates: DataFrame, key: str, order: list[str], snippet: str = "snippet", most: int = 4, chars: int = 14_000) -> DataFrame:
    """candidates with `batch`, from 0, in order within a key: a batch takes `most` snippets and `chars` characters at most,
    and one snippet at least. The candidates of a key are those that merged_candidates left, so a key's list is short."""
    rows = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.length(snippet).alias("_n"), F.struct(*[c for c in candidates.columns if c != key]).alias("_row")))).alias("l"))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("k"), F.lit(0).alias("c"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["k"] > 0) & ((acc["k"] >= most) | (acc["c"] + x["_n"] > chars))
        b = acc["b"] + full.cast("int")
        return F.struct(b.alias("b"), F.when(full, 1).otherwise(acc["k"] + 1).alias("k"), F.when(full, x["_n"]).otherwise(acc["c"] + x["_n"]).alias("c"), F.concat(acc["out"], F.array(b)).alias("out"))

    numbers = F.aggregate("l", start, step, lambda acc: acc["out"])
    return rows.select(key, F.inline(F.arrays_zip(F.col("l").alias("r"), numbers.alias("batch")))).select(key, "r._row.*", "batch")


# Money and names


def with_cost_profile(estates: DataFrame, profiles: DataFrame, key: str, currency: str, hourly_rate: float, team_size: float, hosting: float, support: float, database: float) -> DataFrame:
    """estates (key, tenant_id) with the rates that hold for their tenant: profiles (tenant_id, currency, hourly_rate,
    team_size, hosting, support, database) replace the defaults. Savings in another currency count only with rates of the
    tenant's own, of which a missing one is 0."""
    p = profiles.select("tenant_id", *[F.col(c).alias(f"p_{c}") for c in ("currency", "hourly_rate", "team_size", "hosting", "support", "database")])
    df = estates.join(p, "tenant_id", "left")
    same = F.col("p_currency").isNull() | (F.lower("p_currency") == currency.lower())
    own = F.coalesce("p_hosting", "p_support", "p_database").isNotNull()
    rate = lambda c, default: F.coalesce(f"p_{c}", F.when(same, F.lit(default)).otherwise(0.0)).alias(c)
    return df.select(key, "tenant_id", F.coalesce("p_currency", F.lit(currency)).alias("currency"), F.coalesce("p_hourly_rate", F.lit(hourly_rate)).alias("hourly_rate"), F.coalesce("p_team_size", F.lit(team_size)).alias("team_size"), (same | own).alias("has_savings"), rate("hosting", hosting), rate("support", support), rate("database", database))


def ai_tokens(methods: Column, per_request: int) -> Column:
    """A struct of methods, requests, tokens in and tokens out of an analysis."""
    m = F.greatest(methods, F.lit(0)).cast("long")
    requests = F.ceil(m / max(1, per_request))
    return F.struct(m.alias("methods"), requests.alias("requests"), (m * TOKENS_IN + requests * TOKENS_REQUEST).alias("tokens_in"), (m * TOKENS_OUT).alias("tokens_out"))


def overlaid(overrides: DataFrame, catalog: DataFrame, order: str = "ordinal") -> DataFrame:
    """One price table in which all overrides come before the catalog, each in its own order."""
    before = overrides.withColumn(order, F.col(order).cast("long") - F.lit(2**40))
    return before.unionByName(catalog.withColumn(order, F.col(order).cast("long")))


def invalid_prices(prices: DataFrame) -> DataFrame:
    """Prices below zero, and those without a pattern; a table with any must not be used."""
    negative = F.greatest(*[F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("input", "output", "cache_read", "cache_write")])
    return prices.filter(negative | F.coalesce(F.trim("pattern") == "", F.lit(True)))


def failing_signatures(catalog: DataFrame) -> DataFrame:
    """(id, fixture, wanted) of signatures (id, pattern, hits, misses) that do not judge their own fixtures as told."""
    told = catalog.select("id", "pattern", F.explode(F.concat(F.transform("hits", lambda f: F.struct(f.alias("fixture"), F.lit(True).alias("wanted"))), F.transform("misses", lambda f: F.struct(f.alias("fixture"), F.lit(False).alias("wanted"))))).alias("f"))
    return told.filter(F.regexp_like("f.fixture", F.col("pattern")) != F.col("f.wanted")).select("id", "f.fixture", "f.wanted")


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a string column, as two nested digests; the padded keys are constants."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def pseudonym(actor: Column, is_service: Column, key: bytes, labels: bool = False, most: int = 120) -> Column:
    """Services keep their name; people get twelve digits of a keyed digest, unless the tenant wants labels."""
    person = F.left(actor, F.lit(most)) if labels else F.concat(F.lit("id-"), F.left(hmac_sha256(key, F.lower(F.trim(actor))), F.lit(12)))
    return F.when(is_service, F.left(F.concat(F.lit("svc:"), F.lower(actor)), F.lit(most))).otherwise(person)


def truncated(value: Column, most: int) -> Column:
    return F.left(F.trim(value), F.lit(most))


def clamped(value: Column, low: Column | int, high: Column | int) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.least(value, col(high)), col(low))


def json_value(document: Column, path: str, kind: str) -> Column:
    """The value at a path if it is of the kind (long, double, string, boolean), else null: a wrong type or a broken document
    is no error."""
    of = {"long": r"^(BIGINT|INT|SMALLINT|TINYINT)$", "double": r"^(DOUBLE|FLOAT|DECIMAL.*|BIGINT|INT|SMALLINT|TINYINT)$", "string": "^STRING$", "boolean": "^BOOLEAN$"}[kind]
    v = F.try_parse_json(document)
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).rlike(of), F.try_variant_get(v, path, kind))


def rule_ids(owned: DataFrame, declared: DataFrame) -> DataFrame:
    return owned.select("rule_id").union(declared.select("rule_id")).distinct()


def open_findings(findings: DataFrame) -> DataFrame:
    """Open findings and regressed ones, in one pass."""
    return findings.filter(F.col("status").isin("Open", "Regressed"))


def compiled(pattern: str) -> bool:
    """Whether a price's or a signature's pattern is a regular expression at all."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
