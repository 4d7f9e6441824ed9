"""Health of an estate: scores by dimension, contributors, risk, targets, benchmarks, gates and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ladder
from ..operators.store import cut

# Fixed values of the scoring model: points by severity, dimensions with weights and categories, risk bands.
POINTS = {4: 15, 3: 8, 2: 3, 1: 1, 0: 0}
DIMENSIONS = [
    ("Security", 0.30, ["Security", "Secrets", "Data"]),
    ("Modernization", 0.25, ["Modernization"]),
    ("Dependencies", 0.15, ["Dependencies"]),
    ("Architecture", 0.15, ["Architecture"]),
    ("Quality", 0.15, ["Quality", "Code"]),
]
BANDS = [(40, "Critical"), (60, "High"), (80, "Medium")]
OPEN = ["Open", "Regressed"]


def points(severity: Column) -> Column:
    return ladder([(severity == s, p) for s, p in POINTS.items()], 0)


def dimension_of(category: Column) -> Column:
    return ladder([(category.isin(c), name) for name, _, c in DIMENSIONS])


def risk(score: Column) -> Column:
    return ladder([(score < most, name) for most, name in BANDS], "Low")


def health(findings: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """(key, score_<dimension>..., score, risk, penalty) from findings (key, category, severity) and projects (key, project_count).

    One aggregate over the findings, a column for each dimension; a group without findings scores 100.
    """
    dim = dimension_of(F.col("category"))
    sums = findings.groupBy(key).agg(*[F.sum(F.when(dim == name, points(F.col("severity"))).otherwise(0)).alias(f"p_{name}") for name, _, _ in DIMENSIONS])
    df = projects.select(key, "project_count").join(sums, key, "left").withColumn("scale", F.lit(10.0) / F.greatest(F.lit(10), F.coalesce("project_count", F.lit(0))))
    for name, _, _ in DIMENSIONS:
        df = df.withColumn(f"score_{name.lower()}", F.bround(F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), F.coalesce(f"p_{name}", F.lit(0)) * F.col("scale")))).cast("int"))
    total = sum((F.col(f"score_{n.lower()}") * w for n, w, _ in DIMENSIONS[1:]), F.col(f"score_{DIMENSIONS[0][0].lower()}") * DIMENSIONS[0][1])
    df = df.withColumn("score", F.bround(F.round(total, 6)).cast("int"))
    penalty = sum((F.coalesce(f"p_{n}", F.lit(0)) for n, _, _ in DIMENSIONS[1:]), F.coalesce(f"p_{DIMENSIONS[0][0]}", F.lit(0)))
    return df.select(key, *[f"score_{n.lower()}" for n, _, _ in DIMENSIONS], "score", risk(F.col("score")).alias("risk"), F.bround(penalty * F.col("scale"), 1).alias("penalty"))


def contributors(findings: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, dimension, rule_id, n, points, rank): the k rules of most points in each dimension, ties by rule."""
    per = findings.withColumn("dimension", dimension_of(F.col("category"))).filter("dimension is not null").groupBy(key, "dimension", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum(points(F.col("severity"))).alias("points"))
    w = Window.partitionBy(key, "dimension").orderBy(F.desc("points"), "rule_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def target_status(score: Column, target: Column, due: Column, now: Column) -> Column:
    """None, Met, Missed (the UTC day is over), AtRisk (due within 30 days or over 20 points away), else OnTrack."""
    return ladder([
        (target.isNull(), "None"),
        (score >= target, "Met"),
        (F.to_date(now) > F.to_date(due), "Missed"),
        (due - now <= F.expr("interval 30 days"), "AtRisk"),
        (target - score > 20, "AtRisk"),
    ], "OnTrack")


def benchmark(scores: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, p25, p50, p75, best, worst), interpolated between ranks, one decimal half-even."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.groupBy(key).agg(F.count(value).alias("n"), q.alias("_q"), F.max(value).alias("best"), F.min(value).alias("worst")).select(key, "n", *[F.bround(F.col("_q")[i], 1).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "best", "worst")


def percentile_rank(scores: DataFrame, value: str) -> DataFrame:
    """scores with pct_rank, the midpoint rank of 0 to 100; ties count half.

    Distinct values are counted and dealt out by range; each range is ordered by itself, and a row a range tells how many
    rows lie in the ranges before it.
    """
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = scores.groupBy(value).agg(F.count(F.lit(1)).alias("_ties")).repartitionByRange(n, value)
    per = cut(per.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = per.groupBy("_range").agg(F.sum("_ties").alias("_n"))
    everything = F.sum("_n").over(Window.partitionBy())
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"), everything.alias("_all"))
    below = F.coalesce(F.sum("_ties").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("_below", below).join(before, "_range").select(value, F.bround((F.col("_before") + F.col("_below") + F.col("_ties") / 2) * 100.0 / F.col("_all")).cast("int").alias("pct_rank"))
    return scores.join(ranked, value)


def open_summary(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.filter(F.col("status").isin(OPEN)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def side_by_side(profiles: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(metric, value_a, value_b, delta): every numeric column of two rows of profiles, null where a side is missing; delta is b less a."""
    numbers = [f.name for f in profiles.schema.fields if f.name != key and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    each = profiles.filter(F.col(key).isin(a, b)).select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numbers)])))
    of = lambda side: F.max(F.when(F.col(key) == side, F.col("value")))
    per = each.groupBy("place", "metric").agg(of(a).alias("value_a"), of(b).alias("value_b"))
    return per.withColumn("delta", F.col("value_b") - F.col("value_a")).orderBy("place").drop("place")


# Fixed value: an id that was split into others, which estates that were never scanned again still hold.
RETIRED_RULES = ["dependency.migration-blocker"]


def top_rules(findings: DataFrame, k: int = 15) -> DataFrame:
    """(rule_id, max_severity, n, assessments), the k rules of the greatest severity, then of most findings; ties by rule. Retired
    rules are left out."""
    per = findings.filter(~F.col("rule_id").isin(RETIRED_RULES)).groupBy("rule_id").agg(F.max("severity").alias("max_severity"), F.count(F.lit(1)).alias("n"), F.countDistinct("assessment_id").alias("assessments"))
    return per.orderBy(F.desc("max_severity"), F.desc("n"), "rule_id").limit(k)


def refreshed(snapshots: DataFrame, findings: DataFrame, projects: DataFrame, changed: DataFrame, key: str, at: Column) -> DataFrame:
    """snapshots with a new row, of null run_id, for each key of `changed`, from the findings as they stand now.

    snapshots: key, run_id, commit, taken_at, project_count and the columns of health; findings: key, category, severity, status;
    projects: key, project_count; changed: keys of findings that a decision touched, repeated or not. Only those keys' findings
    and projects are read: the semi join stands below the aggregate, and prunes partitions where the table has them by key. A
    new row takes over the commit of the key's last one.
    """
    mine = changed.select(key).distinct()
    open_ = findings.filter(F.col("status").isin(OPEN)).join(mine, key, "left_semi")
    scores = health(open_, projects.join(mine, key, "left_semi"), key)
    last = snapshots.join(mine, key, "left_semi").groupBy(key).agg(F.max_by("commit", "taken_at").alias("commit"))
    new = scores.join(last, key, "left").withColumns({"run_id": F.lit(None).cast(snapshots.schema["run_id"].dataType), "taken_at": at})
    return snapshots.unionByName(new.select(*[new[c] if c in new.columns else F.lit(None).cast(snapshots.schema[c].dataType).alias(c) for c in snapshots.columns]))


def by_rule(findings: DataFrame, files: int = 5) -> DataFrame:
    """(rule_id, max_severity, n, files): up to `files` distinct paths, the least ones."""
    per_file = findings.groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("c"), F.max("severity").alias("s"))
    w = Window.partitionBy("rule_id").orderBy("file")
    few = per_file.filter("file is not null").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= files).groupBy("rule_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return per_file.groupBy("rule_id").agg(F.max("s").alias("max_severity"), F.sum("c").alias("n")).join(few, "rule_id", "left")


def heatmap(findings: DataFrame, depth: int) -> DataFrame:
    """(folder, critical, high, medium, low, info, files, weight) by the first `depth` folders of a path, heaviest first."""
    parts = F.split("file", "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    names = {4: "critical", 3: "high", 2: "medium", 1: "low", 0: "info"}
    per = findings.withColumn("folder", folder).groupBy("folder").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in names.items()], F.countDistinct("file").alias("files"), F.sum(points(F.col("severity"))).alias("weight"))
    return per.orderBy(F.desc("weight"), "folder")


def quality_gate(findings: DataFrame, latest: DataFrame, key: str, max_open: dict[int, int], max_new: dict[int, int], min_score: int) -> DataFrame:
    """(key, passed, reasons): fails closed where no run is known.

    findings: key, severity, status, is_new. latest: key and score of the last completed run.
    """
    opened = F.col("status").isin(OPEN)
    counts = findings.groupBy(key).agg(*[F.count_if(opened & (F.col("severity") == s)).alias(f"open_{s}") for s in max_open], *[F.count_if(opened & F.col("is_new") & (F.col("severity") == s)).alias(f"new_{s}") for s in max_new])
    df = latest.join(counts, key, "left")
    over = [F.when(F.coalesce(F.col(f"open_{s}"), F.lit(0)) > m, F.lit(f"open severity {s} over {m}")) for s, m in max_open.items()]
    over += [F.when(F.coalesce(F.col(f"new_{s}"), F.lit(0)) > m, F.lit(f"new severity {s} over {m}")) for s, m in max_new.items()]
    over += [F.when(F.col("score").isNull(), F.lit("no completed run")).when(F.col("score") < min_score, F.lit(f"score under {min_score}"))]
    reasons = F.filter(F.array(*over), lambda r: r.isNotNull())
    return df.select(key, (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def run_diff(findings: DataFrame, before: str, after: str) -> DataFrame:
    """(rule_id, n_new, n_resolved, n_regressed) between the scans named, from findings' scan ids and status."""
    return findings.groupBy("rule_id").agg(
        F.count_if(F.col("first_seen_scan_id") == after).alias("n_new"),
        F.count_if(F.col("resolved_scan_id") == after).alias("n_resolved"),
        F.count_if((F.col("status") == "Regressed") & (F.col("last_seen_scan_id") == after) & (F.col("first_seen_scan_id") != after)).alias("n_regressed"),
    ).filter("n_new + n_resolved + n_regressed > 0")


def rule_deltas(findings: DataFrame, scans: list[str], samples: int = 5) -> DataFrame:
    """(kind, rule_id, category, max_severity, n, locations) of what the scans of one run changed, by rule: kind is new, resolved or
    regressed.

    findings: rule_id, category, severity, status, first_seen_scan_id, last_seen_scan_id, resolved_scan_id, file, line, symbol. locations
    are the `samples` least places, 'file:line', the file alone, or the symbol where there is no file. A task keeps no
    more than that many of a rule before they meet, so no rule's findings are sorted whole.
    """
    of = lambda c: F.col(c).isin(scans)
    kinds = F.array_compact(F.array(
        F.when(of("first_seen_scan_id"), "new"),
        F.when(of("resolved_scan_id"), "resolved"),
        F.when((F.col("status") == "Regressed") & of("last_seen_scan_id") & ~of("first_seen_scan_id"), "regressed"),
    ))
    place = F.when(F.col("file").isNull(), F.col("symbol")).otherwise(F.concat_ws(":", "file", F.col("line").cast("string")))
    touched = findings.withColumn("kind", F.explode(kinds)).withColumn("place", F.nullif(place, F.lit("")))
    per = touched.groupBy("kind", "rule_id").agg(F.min("category").alias("category"), F.max("severity").alias("max_severity"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind", "rule_id").orderBy("place")
    few = touched.filter("place is not null").select("kind", "rule_id", "place").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
    few = few.groupBy("kind", "rule_id").agg(F.array_sort(F.collect_list("place")).alias("locations"))
    out = per.join(few, ["kind", "rule_id"], "left")
    return out.withColumn("locations", F.coalesce("locations", F.array().cast("array<string>"))).orderBy("kind", F.desc("max_severity"), F.desc("n"), "rule_id")


def severity_deltas(findings: DataFrame, scans: list[str]) -> DataFrame:
    """(severity, n_new, n_regressed) of the scans of one run; severities without either are left out."""
    new = F.col("first_seen_scan_id").isin(scans)
    back = (F.col("status") == "Regressed") & F.col("last_seen_scan_id").isin(scans) & ~new
    return findings.groupBy("severity").agg(F.count_if(new).alias("n_new"), F.count_if(back).alias("n_regressed")).filter("n_new + n_regressed > 0")


def dimension_deltas(snapshots: DataFrame, key: str) -> DataFrame:
    """(key, dimension, before, after, delta) of each key's last two runs. snapshots: key, run (a number), and the columns of health; a key
    with one run has null before and delta. Overall comes first."""
    from ..operators.latest import top_k

    two = top_k(snapshots, [key], [F.desc("run")], 2)
    names = ["Overall", *[n for n, _, _ in DIMENSIONS]]
    columns = ["score", *[f"score_{n.lower()}" for n, _, _ in DIMENSIONS]]
    each = two.select(key, "run", F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("dimension"), F.col(c).alias("value")) for i, (n, c) in enumerate(zip(names, columns))])))
    pair = each.groupBy(key, "place", "dimension").agg(F.max_by("value", "run").alias("after"), F.min_by("value", "run").alias("first"), F.count(F.lit(1)).alias("runs"))
    before = F.when(F.col("runs") > 1, F.col("first"))
    return pair.select(key, "place", "dimension", before.alias("before"), "after", (F.col("after") - before).alias("delta")).orderBy(key, "place").drop("place")


def inventory_deltas(inventories: DataFrame, key: str) -> DataFrame:
    """(key, lines_before, lines_after, files_before, ...) of each key's last two runs that have an inventory; keys with one are left
    out. inventories: key, run, lines, files, projects, several rows a run."""
    from ..operators.latest import top_k

    sums = ["lines", "files", "projects"]
    per_run = inventories.groupBy(key, "run").agg(*[F.sum(c).alias(c) for c in sums])
    pair = top_k(per_run, [key], [F.desc("run")], 2).groupBy(key).agg(*[x for c in sums for x in (F.min_by(c, "run").alias(f"{c}_before"), F.max_by(c, "run").alias(f"{c}_after"))], F.count(F.lit(1)).alias("_n"))
    return pair.filter("_n > 1").drop("_n")


def rule_differences(findings: DataFrame, side: str, a: str, b: str, k: int = 12) -> DataFrame:
    """(rule_id, n_a, n_b): rules whose counts differ between two sides, the k largest differences."""
    per = findings.filter(F.col(side).isin(a, b)).groupBy("rule_id").agg(F.count_if(F.col(side) == a).alias("n_a"), F.count_if(F.col(side) == b).alias("n_b")).filter("n_a <> n_b")
    return per.orderBy(F.desc(F.abs(F.col("n_a") - F.col("n_b"))), "rule_id").limit(k)


def trend(points_: DataFrame, cuts: DataFrame) -> DataFrame:
    """(day, assessments, mean_score, open_findings): each assessment's last run at each cut, averaged over assessments."""
    from ..operators.latest import as_of

    held = as_of(points_, cuts, ["assessment_id"], "finished_at", "day", "health_score", "open_findings")
    return held.groupBy("day").agg(F.count(F.lit(1)).alias("assessments"), F.bround(F.avg("health_score"), 1).alias("mean_score"), F.sum("open_findings").alias("open_findings"))


def sampled_days(runs: DataFrame, today: Column, weeks: int = 26, most: int = 104) -> DataFrame:
    """(day) of a trend up to today: every day where the first run (finished_at) is less than two weeks old, else the days a week apart,
    counted back from today, that aren't before the first run. weeks is held between 2 and `most`. Without runs there are none."""
    weeks = min(max(weeks, 2), most)
    first = runs.agg(F.min(F.to_date("finished_at")).alias("first")).filter("first is not null").withColumn("today", today)
    daily = F.sequence("first", "today", F.expr("interval 1 day"))
    weekly = F.filter(F.transform(F.sequence(F.lit(weeks - 1), F.lit(0), F.lit(-1)), lambda i: F.date_sub("today", i * 7)), lambda day: day >= F.col("first"))
    age = F.datediff("today", "first")
    days = F.when(age < 0, F.array("today")).when(age < 14, daily).otherwise(weekly)
    return first.select(F.explode(F.array_distinct(F.concat(days, F.array("today")))).alias("day"))


def sampled_trend(runs: DataFrame, today: Column, weeks: int = 26) -> DataFrame:
    """(day, average_score, open_findings, assessed, average_<dimension>...) at the sampled days, from each assessment's last run that ended
    on the day or before. runs: assessment_id, finished_at, health_score, open_findings, score_<dimension>...; a run with neither
    score nor findings doesn't count."""
    from ..operators.latest import as_of

    usable = runs.filter(F.col("health_score").isNotNull() | F.col("open_findings").isNotNull())
    parts = [c for c in runs.columns if c.startswith("score_")]
    end = F.col("day").cast(runs.schema["finished_at"].dataType) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    cuts = sampled_days(usable, today, weeks).select(end.alias("cut"))
    held = as_of(usable, cuts, ["assessment_id"], "finished_at", "cut", "health_score", "open_findings", *parts)
    mean = lambda c: F.bround(F.avg(c), 1)
    return held.groupBy(F.to_date("cut").alias("day")).agg(mean("health_score").alias("average_score"), F.sum(F.coalesce("open_findings", F.lit(0))).alias("open_findings"), F.count("health_score").alias("assessed"), *[mean(c).alias(f"average_{c.removeprefix('score_')}") for c in parts])


def movers(points_: DataFrame, now: Column, k: int = 5, days: int = 7) -> DataFrame:
    """(assessment_id, score_before, score_now, change): the k largest moves between two cuts, in one pass over the runs."""
    at = F.col("finished_at")
    early = at <= now - F.expr(f"interval {days} days")
    per = points_.filter(at <= now).groupBy("assessment_id").agg(F.max_by("health_score", at).alias("score_now"), F.max_by(F.when(early, F.col("health_score")), F.when(early, at)).alias("score_before")).filter("score_before is not null and score_now <> score_before")
    per = per.withColumn("change", F.col("score_now") - F.col("score_before"))
    return per.orderBy(F.desc(F.abs("change")), "assessment_id").limit(k)
