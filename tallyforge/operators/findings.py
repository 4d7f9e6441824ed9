"""Findings as keyed state: fingerprints, reconciliation with a scan, waivers and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import path_normalize
from .latest import latest_per_key


def fingerprint(rule_id: Column, major: Column, repository: Column, path: Column, symbol: Column) -> Column:
    """SHA-256 of rule, its major version, repository, normalized path and symbol, a line each."""
    parts = [F.lower(F.trim(rule_id)), major.cast("string"), F.lower(F.trim(repository)), path_normalize(path), F.trim(F.coalesce(symbol, F.lit("")))]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def undeclared(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates whose rule nobody declared; a run with any must fail."""
    return candidates.join(rules.select("rule_id"), "rule_id", "left_anti")


def with_fingerprints(candidates: DataFrame, rules: DataFrame, repository: str) -> DataFrame:
    """candidates (rule_id, severity, title, file_path, symbol, ordinal) with category, fingerprint and, from major 2 on,
    that of the major before."""
    df = candidates.join(rules.select("rule_id", "category", "major"), "rule_id")
    of = lambda major: fingerprint(F.col("rule_id"), major, F.lit(repository), F.col("file_path"), F.col("symbol"))
    return df.withColumns({"fingerprint": of(F.col("major")), "previous": F.when(F.col("major") > 1, of(F.col("major") - 1))})


def reconcile(existing: DataFrame, candidates: DataFrame, scan_id: str, succeeded: bool) -> DataFrame:
    """The new state of all findings, with `outcome`: new, recurring, regressed, resolved or unchanged.

    existing: fingerprint, rule_id, category, severity, title, status, first_seen, last_seen, resolved_in,
    predecessor. candidates: as with_fingerprints. A finding that exists takes its first candidate, then any more severe
    one of the scan; a new one starts from its first candidate alike. Sticky statuses stay. Unseen open findings resolve
    only when the scan succeeded. One aggregate of the candidates and one full outer join on the fingerprint.
    """
    worst = F.max_by(F.struct("severity", "title"), F.struct("severity", -F.col("ordinal")))
    first = candidates.groupBy("fingerprint").agg(worst.alias("w"), F.min_by(F.struct("rule_id", "category", "previous"), "ordinal").alias("f"), F.count(F.lit(1)).alias("occurrences"))
    seen = first.select("fingerprint", F.col("w.severity").alias("c_severity"), F.col("w.title").alias("c_title"), F.col("f.rule_id").alias("c_rule"), F.col("f.category").alias("c_category"), F.col("f.previous").alias("c_previous"), "occurrences")
    links = existing.select(F.col("fingerprint").alias("c_previous"), F.lit(True).alias("has_previous"))
    seen = seen.join(links, "c_previous", "left")
    df = existing.withColumn("known", F.lit(True)).join(seen, "fingerprint", "full_outer")
    here, known = F.col("occurrences").isNotNull(), F.coalesce("known", F.lit(False))
    gone = ~here & F.col("status").isin("Open", "Regressed") & F.lit(succeeded)
    back = here & (F.col("status") == "Resolved")
    scan = F.lit(scan_id)
    return df.select(
        "fingerprint",
        F.coalesce("rule_id", "c_rule").alias("rule_id"),
        F.coalesce("category", "c_category").alias("category"),
        F.coalesce("c_severity", "severity").alias("severity"),
        F.coalesce("c_title", "title").alias("title"),
        F.when(~known, "Open").when(back, "Regressed").when(gone, "Resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", scan).alias("first_seen"),
        F.when(here, scan).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(gone, scan).when(~back, F.col("resolved_in")).alias("resolved_in"),
        F.when(known, F.col("predecessor")).when(F.col("has_previous"), F.col("c_previous")).alias("predecessor"),
        F.when(~known, "new").when(back, "regressed").when(here, "recurring").when(gone, "resolved").otherwise("unchanged").alias("outcome"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
    )


def apply_overrides(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """A tenant's severity of a rule replaces the candidate's."""
    o = overrides.select("rule_id", F.col("severity").alias("_o"))
    return candidates.join(o, "rule_id", "left").withColumn("severity", F.coalesce("_o", "severity")).drop("_o")


def policy_pattern(glob: Column) -> Column:
    """A regular expression of a path glob: ** any depth, * and ? within a folder."""
    quoted = F.regexp_replace(glob, r"([.^$+(){}\[\]|\\])", r"\\$1")
    deep = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    one = F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(one, F.lit("\u0001"), F.lit("(.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def policy_matches(findings: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """findings that an unexpired policy covers. policies: rule (exact, prefix* or *), path_glob (null: any), expires_at.

    Distinct rules meet the policies first, so that only rules in reach are compared path by path.
    """
    p = policies.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.lower("rule").alias("p_rule"), "path_glob")
    rules = findings.select("rule_id").distinct().withColumn("r", F.lower("rule_id"))
    same = (F.col("r") == F.col("p_rule")) | (F.col("p_rule").endswith("*") & F.col("r").startswith(F.regexp_replace("p_rule", r"\*$", "")))
    pairs = rules.join(p, same).select("rule_id", F.when(F.col("path_glob").isNull(), F.lit("^")).otherwise(policy_pattern(F.col("path_glob"))).alias("pattern")).distinct()
    path = F.coalesce("file_path", F.lit(""))
    return findings.join(pairs, (findings.rule_id == pairs.rule_id) & F.rlike(path, F.col("pattern")), "left_semi")


def triage(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings after decisions (fingerprint, action, at): suppress, false-positive, reopen; the last of each counts.
    Only what was suppressed or called false can be reopened."""
    last = latest_per_key(decisions, ["fingerprint"], [F.desc("at")]).select("fingerprint", "action")
    sticky = F.col("status").isin("Suppressed", "FalsePositive")
    status = F.when(F.col("action") == "suppress", "Suppressed").when(F.col("action") == "false-positive", "FalsePositive").when((F.col("action") == "reopen") & sticky, "Open").otherwise(F.col("status"))
    return findings.join(last, "fingerprint", "left").withColumn("status", status).drop("action")


def expired_waivers(findings: DataFrame, waivers: DataFrame, now: Column) -> DataFrame:
    """findings reopened where their newest active waiver has run out."""
    newest = latest_per_key(waivers.filter("revoked_at is null"), ["fingerprint"], [F.desc("created_at")])
    out = newest.filter(F.col("expires_at") < now).select("fingerprint", F.lit(True).alias("_out"))
    status = F.when(F.col("_out") & F.col("status").isin("Suppressed", "FalsePositive"), "Open").otherwise(F.col("status"))
    return findings.join(out, "fingerprint", "left").withColumn("status", status).drop("_out")


def migrated_waivers(findings: DataFrame, waivers: DataFrame, now: Column) -> DataFrame:
    """(fingerprint, reason, expires_at) that findings take over from the finding they supersede; a past expiry is not kept."""
    newest = latest_per_key(waivers.filter("revoked_at is null"), ["fingerprint"], [F.desc("created_at")])
    w = newest.select(F.col("fingerprint").alias("predecessor"), "reason", "expires_at")
    return findings.filter("predecessor is not null and status in ('Open', 'Regressed')").join(w, "predecessor").filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("fingerprint", "reason", "expires_at")


def with_latest_occurrence(findings: DataFrame, occurrences: DataFrame) -> DataFrame:
    newest = occurrences.groupBy("finding_id").agg(F.max_by(F.struct("message", "file_path", "line_start"), "created_at").alias("occurrence"))
    return findings.join(newest, findings.id == newest.finding_id, "left").drop("finding_id")


def search(findings: DataFrame, severity: int | None = None, category: str | None = None, status: str | None = None, rule: str | None = None, text: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("category", category), ("status", status), ("rule_id", rule)):
        findings = findings.filter(F.col(name) == value) if value is not None else findings
    return findings.filter(F.col("title").ilike(f"%{text}%") | F.col("rule_id").ilike(f"%{text}%")) if text else findings


def tenant_rows(df: DataFrame, tenant_id: str) -> DataFrame:
    """The row filter that every table access passes."""
    return df.filter(F.col("tenant_id") == tenant_id)


def shared_with(assessments: DataFrame, shares: DataFrame, subject: str) -> DataFrame:
    """Assessments without any share, or shared with the subject."""
    mine = shares.filter(F.col("subject") == subject).select("assessment_id").distinct()
    others = shares.select("assessment_id").distinct().join(mine, "assessment_id", "left_anti")
    return assessments.join(others, "assessment_id", "left_anti")
