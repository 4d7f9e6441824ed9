"""The portfolio's operators on the driver's tables, each with the SQL that gives the same rows.

Nations stand in for assessments, customers for projects, orders for findings, runs and scans, suppliers for subjects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scalar import sensitive_category
from .functions.versions import in_segment, version_key
from .operators import graph, matching
from .plans import health, modernization, portfolio
from .queries import ESTATES, FINDINGS, PRICES, estates, order_findings, query, table

KEY = "assessment_id"


def nations(spark, d):
    """assessment_id, k: one row an assessment."""
    return table(spark, d, "nation").select(F.col("n_name").alias(KEY), F.col("n_nationkey").cast("long").alias("k"))


@query("select assessment_id from (select n_name as assessment_id, n_nationkey as k from nation) where (k % 3 = 0 or k % 5 = 0) and k % 7 <> 6")
def tag_filter(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("k") % 3 == 0, "Core"), F.when(F.col("k") % 5 == 0, "CORE"), F.when(F.col("k") % 2 == 0, "edge")))
    return nations(spark, d).filter(portfolio.has_tag(F.when(F.col("k") % 7 != 6, tags), " core ")).select(KEY)


@query("select o_orderkey from orders where o_orderdate::date between date '1997-12-31' - 90 and date '1997-12-31'")
def date_window(spark, d):
    return table(spark, d, "orders").filter(portfolio.in_window(F.to_date("o_orderdate"), F.to_date(F.lit("1997-12-31")), F.lit(90))).select("o_orderkey")


@query("""
select o_orderkey, o_orderkey % 9 > 0 and o_orderstatus <> 'P' and timestamp '1998-01-01 12:00:00' >= o_orderdate + to_days((o_orderkey % 9 * 40)::int) as due from orders
""")
def schedule_due(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "Running").otherwise("Completed"))
    done = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp_ntz"))
    due = portfolio.is_due(F.col("o_orderkey") % 9 * 40, F.col("status"), done, F.col("o_orderdate").cast("timestamp_ntz"), F.expr("timestamp_ntz '1998-01-01 12:00:00'"))
    return o.select("o_orderkey", due.alias("due"))


@query("""
with e as (select n_name as assessment_id, s_suppkey % 4 as who, (['Owner', 'Editor', 'Viewer'])[s_suppkey % 3 + 1] as role from supplier join nation on s_nationkey = n_nationkey where n_nationkey % 2 = 0),
p as (select assessment_id, min(case when who = 1 then role end) as role from (select distinct assessment_id, who, first_value(role) over (partition by assessment_id, who order by role) as role from e) group by 1)
select n_name as assessment_id, p.assessment_id is not null as restricted, role, coalesce(role = 'Owner', false) as can_manage, p.assessment_id is null or coalesce(role in ('Owner', 'Editor'), false) as can_edit
from nation left join p on n_name = p.assessment_id
""")
def access_view(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation").filter("n_nationkey % 2 = 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    role = F.element_at(F.array(*map(F.lit, ["Owner", "Editor", "Viewer"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    entries = s.groupBy(F.col("n_name").alias(KEY), F.concat(F.lit("user-"), (F.col("s_suppkey") % 4).cast("string")).alias("subject")).agg(F.min(role).alias("role"))
    return portfolio.access(nations(spark, d), entries, KEY, " User-1 ")


@query("select s_suppkey from supplier where s_suppkey % 7 in (0, 1, 3, 5)")
def test_projects(spark, d):
    kind = F.col("s_suppkey") % 7
    name = F.concat(F.when(kind == 6, "Latest").otherwise(F.concat(F.lit("Shop"), F.col("s_suppkey").cast("string"))), F.when(kind == 0, ".Tests").when(kind == 1, ".UnitTest").when(kind == 2, "Contest.Api").otherwise(""))
    packages = F.when(kind == 2, F.array(F.lit("Dapper"))).when(kind == 3, F.array(F.lit("NUnit.ConsoleRunner"))).when(kind == 4, F.array(F.lit("xunit.abstractions"), F.lit("nunit.engine.api")))
    assemblies = F.when(kind == 5, F.array(F.lit("Microsoft.VisualStudio.QualityTools.UnitTestFramework")))
    return table(spark, d, "supplier").filter(portfolio.is_test_project(name, packages, assemblies)).select("s_suppkey")


@query("select distinct l_orderkey from lineitem l where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F' and o_custkey % 5 = l_suppkey % 5)")
def semi_join_scans(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("assessment_id"), (F.col("l_suppkey") % 5).alias("scanner_id"), F.lit("c").alias("commit"))
    scans = table(spark, d, "orders").select(F.col("o_orderkey").alias("assessment_id"), (F.col("o_custkey") % 5).alias("scanner_id"), F.lit("c").alias("commit"), F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Failed").alias("status"))
    return portfolio.already_scanned(wanted, scans).select(F.col("assessment_id").alias("l_orderkey")).distinct()


@query(f"""
with {FINDINGS}
select id, case rule_id when 'building' then 'Construction in ' || assessment_id when 'machinery' then 'Machines' when 'household' then 'finding ' || id else 'furniture rule' end as shown_title
from f where rule_id <> 'automobile' union all select id, 'automobile' from f where rule_id = 'automobile'
""")
def localized_findings(spark, d):
    f = order_findings(spark, d).select("id", "rule_id", F.when(F.col("rule_id").isin("building", "machinery", "household"), F.concat(F.lit("finding "), F.col("id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("remediation"), F.create_map(F.lit("where"), F.col(KEY)).alias("data"))
    none = "map<string,string>"
    rules = spark.createDataFrame([("building", "b", {"en": "Construction in {where}"}), ("machinery", "m", {"en": "Machines", "pt": "Maquinas"}), ("household", "h", {"pt": "Casa"}), ("furniture", "furniture rule", None)], f"rule_id string, rule_title string, titles {none}")
    rules = rules.select("*", F.lit(None).cast("string").alias("rule_remediation"), F.lit(None).cast(none).alias("messages"), F.lit(None).cast(none).alias("remediations"))
    return portfolio.with_rule_texts(f, rules, "en").select("id", "shown_title")


@query("""
select n_name as assessment_id, (case when n_nationkey % 4 = 1 then n_nationkey when n_nationkey % 4 = 2 then 2 * n_nationkey when n_nationkey % 4 = 3 then greatest(1, round_even(n_nationkey / 20.0::double, 0)) else 0 end)::bigint as project_count from nation
""")
def project_count_fallback(spark, d):
    n = nations(spark, d)
    r = n.select(KEY, F.when(F.col("k") % 4 == 1, F.col("k")).otherwise(0).alias("projects"), F.when(F.col("k") % 4 == 3, F.col("k")).otherwise(0).alias("files"))
    i = n.filter("k % 4 = 2").select(KEY, F.explode(F.array(F.col("k"), F.col("k"))).alias("project_count"))
    return portfolio.project_counts(r, i, KEY)


@query(f"""
with {FINDINGS}, l as (select rule_id, count(*) as n, count(distinct assessment_id) as assessments from f where status <> 'Resolved' group by 1),
c as (select unnest(['automobile', 'building', 'furniture', 'household', 'machinery', 'unused']) as rule_id)
select c.rule_id, case when c.rule_id = 'building' then 4 end as tuned, coalesce(n, 0) as n, coalesce(assessments, 0) as assessments from c left join l on c.rule_id = l.rule_id
""")
def rule_catalog(spark, d):
    catalog = spark.createDataFrame([(r, "Quality", 2) for r in ("automobile", "building", "furniture", "household", "machinery", "unused")], "rule_id string, category string, severity int")
    overrides = spark.createDataFrame([("building", 4)], "rule_id string, severity int")
    return portfolio.rule_catalog(catalog, overrides, health.open_summary(order_findings(spark, d), KEY, "rule_id", "category", "severity")).select("rule_id", "tuned", "n", "assessments")


def _summary(spark, d):
    n = nations(spark, d)
    score = F.when(F.col("k") % 6 != 0, F.col("k") * 4)
    risk = F.when(score < 40, "Critical").when(score < 60, "High").when(score < 80, "Medium").when(score.isNotNull(), "Low")
    a = n.select(KEY, score.alias("score"), risk.alias("risk"), F.when(F.col("k") % 2 == 0, "Met").otherwise("Missed").alias("target"))
    c = table(spark, d, "customer")
    framework = F.when(F.col("c_custkey") % 3 == 0, " V4.8 ").when(F.col("c_custkey") % 3 == 1, "net9.0").when(F.col("c_custkey") % 2 == 0, "")
    projects = c.select(F.col("c_nationkey").alias(KEY), framework.alias("target_framework"))
    inventories = n.select(KEY, (F.col("k") * 1000).alias("lines"), (F.col("k") + 1).alias("files"))
    open_ = health.open_summary(order_findings(spark, d), KEY, "category", "severity")
    return portfolio.summary(a, projects, inventories, open_, KEY)


SUMMARY = f"""
{FINDINGS},
a as (select n_name, n_nationkey as k, case when n_nationkey % 6 <> 0 then n_nationkey * 4 end as score from nation),
o as (select * from f where status <> 'Resolved'),
fw as (select case when c_custkey % 3 = 0 then 'v4.8' when c_custkey % 3 = 1 then 'net9.0' else 'unknown' end as f from customer),
s as (
  select 'count' as section, 'assessments' as item, count(*)::double as value from a union all select 'count', 'assessed', count(score) from a union all select 'score', 'average', round_even(avg(score), 1) from a
  union all select 'count', 'lines', sum(k * 1000) from a union all select 'count', 'files', sum(k + 1) from a
  union all select 'projects', 'legacy', count(*) from fw where f = 'v4.8' union all select 'projects', 'unknown', count(*) from fw where f = 'unknown'
  union all select 'projects', 'modern', count(*) from fw where f = 'net9.0' union all select 'projects', 'all', count(*) from fw
  union all select 'framework', f, count(*) from fw group by f
  union all select 'risk', r, count(*) filter (score is not null and case when score < 40 then 'Critical' when score < 60 then 'High' when score < 80 then 'Medium' else 'Low' end = r) from a, (select unnest(['Low', 'Medium', 'High', 'Critical']) as r) group by r
  union all select 'target', t, count(*) filter (case when k % 2 = 0 then 'Met' else 'Missed' end = t) from a, (select unnest(['None', 'Met', 'OnTrack', 'AtRisk', 'Missed']) as t) group by t
  union all select 'severity', t, count(*) filter (severity = i) from o, (select unnest(['Informational', 'Low', 'Medium', 'High', 'Critical']) as t, unnest([0, 1, 2, 3, 4]) as i) group by t
  union all select 'category', category, count(*) from o group by 2 union all select 'count', 'open', count(*) from o)
"""


@query(f"with {SUMMARY} select * from s")
def portfolio_summary(spark, d):
    return _summary(spark, d)


@query(f"""
with {SUMMARY}, t as (select o_orderdate::date as day, sum(round(o_totalprice * 100)::bigint) // count(*) as m, count(*) as n from orders group by 1)
select * from s union all select 'trend.open_findings', day::varchar, n from t union all select 'trend.mean_score', day::varchar, m from t
""")
def portfolio_report(spark, d):
    t = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.expr("sum(cast(round(o_totalprice * 100) as long)) div count(1)").alias("mean_score"), F.count(F.lit(1)).alias("open_findings"))
    return portfolio.report(_summary(spark, d), t)


@query(f"""
with {FINDINGS}, w as (select case when file like 'src/building/%' then 'src/building/b.csproj' when file like 'src/%' then 'src/all.csproj' end as path, severity from f where status <> 'Resolved'),
p as (select unnest(['src/building/b.csproj', 'src/all.csproj', 'tools/t.csproj']) as path)
select p.path, count(severity) as findings, count(*) filter (severity = 4) as critical, count(*) filter (severity = 3) as high, count(*) filter (severity = 2) as medium, count(*) filter (severity = 1) as low
from p left join w on p.path = w.path group by 1
""")
def project_risk(spark, d):
    p = spark.createDataFrame([("src/building/b.csproj", "b"), ("src/all.csproj", "all"), ("tools/t.csproj", "t")], "path string, name string")
    f = order_findings(spark, d).filter("status <> 'Resolved'").select(F.col("file").alias("file_path"), "severity")
    return portfolio.project_risk(p, f).drop("name")


@query("""
select c_nationkey as k, sum(c_custkey)::bigint as lines, count(*) as files, max(c_custkey % 40)::bigint as max_complexity, arg_max(c_mktsegment, c_custkey) as language from customer group by 1
""")
def inventory_totals(spark, d):
    one = F.lit(1).cast("long")
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("language"), F.col("c_custkey").alias("lines"), one.alias("files"), one.alias("types"), one.alias("methods"), (F.col("c_custkey") % 40).alias("max_complexity"), F.lit(1.0).alias("average_complexity"), F.lit(0.5).alias("resolution_rate"), F.lit("Semantic").alias("tier"))
    return portfolio.inventory_totals(s, "k").select("k", "lines", "files", "max_complexity", "language")


@query("""
select o_custkey as run, count(*) as scanners_run, count(*) filter (o_orderstatus = 'P') as scanners_failed, sum(o_orderkey % 5)::bigint as created, sum(o_orderkey % 7)::bigint as recurring,
       sum(o_orderkey % 3)::bigint as resolved, sum(o_orderkey % 2)::bigint as regressed from orders group by 1
""")
def run_counters(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderstatus") != "P").alias("succeeded"), *[(F.col("o_orderkey") % m).alias(c) for c, m in (("created", 5), ("recurring", 7), ("resolved", 3), ("regressed", 2))])
    return portfolio.run_counters(s, "run")


@query("""
with j as (select o_custkey as k, (['Queued', 'Leased', 'Running', 'Done'])[o_orderkey % 4 + 1] as state, o_orderkey % 4 as r from orders)
select k, arg_max(state, r) as state from j where r < 3 group by 1
""")
def active_jobs(spark, d):
    state = F.element_at(F.array(*map(F.lit, ["Queued", "Leased", "Running", "Done"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), state.alias("state"))
    return portfolio.active_states(j, "k")


@query("select p_partkey, case when p_size % 5 = 0 then 0.0::double else (p_size % 3)::double / (p_size % 5) end as rate from part")
def resolution_rate(spark, d):
    return table(spark, d, "part").select("p_partkey", portfolio.resolution_rate((F.col("p_size") % 3).cast("double"), F.col("p_size") % 5).alias("rate"))


@query("select c_custkey, coalesce(max(o_orderkey), 0) + 1 as number from customer left join orders on c_custkey = o_custkey group by 1")
def next_run_number(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("number"))
    return portfolio.next_run_number(table(spark, d, "customer"), r, "c_custkey")


@query("""
select o_custkey, o_orderkey, max(case when o_orderstatus = 'F' then o_orderkey end) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as previous from orders
""")
def previous_run(spark, d):
    r = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed").alias("status"))
    return portfolio.previous_run(r, "o_custkey").select("o_custkey", F.col("number").alias("o_orderkey"), "previous")


@query("select s_suppkey as credential_id, count(c_custkey) as assessments from supplier left join customer on s_suppkey = c_custkey // 2 and c_custkey % 2 = 0 group by 1")
def credential_usage(spark, d):
    a = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.floor(F.col("c_custkey") / 2)).alias("credential_id"))
    return portfolio.credential_usage(table(spark, d, "supplier").select(F.col("s_suppkey").alias("credential_id")), a)


@query("select distinct c_mktsegment as source_kind, 'https://host/' || c_nationkey as locator from customer")
def source_locators(spark, d):
    return portfolio.source_locators(table(spark, d, "customer").select(F.col("c_mktsegment").alias("source_kind"), F.concat(F.lit("https://host/"), F.col("c_nationkey").cast("string")).alias("locator")))


@query("""
with a as (select c_custkey as id, 'git' as source_kind, c_nationkey as repo, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'main' else 'dev' end as has from customer),
l as (select n_nationkey as lookup_id, case when n_nationkey % 2 = 0 then 'MAIN' when n_nationkey % 3 = 0 then 'x' end as branch from nation)
select lookup_id, arg_min(id, (case when lower(branch) = has then 0 when has is null then 1 else 2 end, -id)) as id from l left join a on lookup_id = repo group by 1
""")
def find_by_locator(spark, d):
    branch = F.when(F.col("c_custkey") % 3 == 1, "main").when(F.col("c_custkey") % 3 == 2, "dev")
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("git").alias("source_kind"), F.concat(F.lit("HTTPS://host/r"), F.col("c_nationkey").cast("string"), F.lit(".git/")).alias("locator"), branch.alias("branch"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"))
    n = nations(spark, d)
    wanted = F.when(F.col("k") % 2 == 0, "MAIN").when(F.col("k") % 3 == 0, "x")
    return portfolio.find_by_locator(n.select(F.col("k").alias("lookup_id"), F.lit("git").alias("source_kind"), F.concat(F.lit("https://host/r"), F.col("k").cast("string")).alias("locator"), wanted.alias("branch")), a, "id")


@query("select p_partkey, p_size from (select p_partkey, p_size from part union all select p_partkey, length(p_name)::int from part) order by p_size desc, p_partkey limit 40")
def merged_candidates(spark, d):
    p = table(spark, d, "part")
    one = lambda score: p.select(score.alias("score"), F.format_string("%012d", "p_partkey").alias("file_path"), F.lit(0).alias("start_line"), "p_partkey")
    return portfolio.merged_candidates([one(F.col("p_size").cast("int")), one(F.length("p_name"))], 40).select("p_partkey", F.col("score").alias("p_size"))


@query("""
with recursive r as (select o_custkey as k, o_orderkey as id, (o_orderkey * 37 % 900)::int as n, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
w as (select k, id, n, i, 0 as batch, 1 as c, n as chars from r where i = 1
      union all select r.k, r.id, r.n, r.i, w.batch + (w.c >= 4 or w.chars + r.n > 1400)::int, case when w.c >= 4 or w.chars + r.n > 1400 then 1 else w.c + 1 end, case when w.c >= 4 or w.chars + r.n > 1400 then r.n else w.chars + r.n end
      from w join r on r.k = w.k and r.i = w.i + 1)
select k, id, batch from w
""")
def greedy_batches(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.repeat(F.lit("x"), (F.col("o_orderkey") * 37 % 900).cast("int")).alias("snippet"))
    return portfolio.batched(o, "k", ["id"], chars=1400).select("k", "id", "batch")


@query(ESTATES + """
select assessment_id, case when k % 3 = 0 then 'BRL' when k % 3 = 1 then 'usd' else 'USD' end as currency, case when k % 3 = 2 then 60.0::double else k::double end as hourly_rate, case when k % 3 = 0 and k % 2 = 0 then 2.0::double else 4.0::double end as team_size,
  k % 3 <> 0 or k % 4 = 0 as has_savings, case when k % 3 <> 2 and k % 4 = 0 then 7.0::double when k % 3 = 0 then 0.0::double else 1200.0::double end as hosting, case when k % 3 = 0 then 0.0::double else 800.0::double end as support, case when k % 3 = 0 then 0.0::double else 5000.0::double end as database from q
""")
def tenant_costs(spark, d):
    n = nations(spark, d)
    p = n.filter("k % 3 <> 2").select(F.col("k").alias("tenant_id"), F.when(F.col("k") % 3 == 0, "BRL").otherwise("usd").alias("currency"), F.col("k").cast("double").alias("hourly_rate"), F.when((F.col("k") % 3 == 0) & (F.col("k") % 2 == 0), 2.0).alias("team_size"), F.when(F.col("k") % 4 == 0, 7.0).alias("hosting"), F.lit(None).cast("double").alias("support"), F.lit(None).cast("double").alias("database"))
    m = modernization.PARAMETERS
    e = estates(spark, d).select(KEY).join(n, KEY).select(KEY, F.col("k").alias("tenant_id"))
    return portfolio.with_cost_profile(e, p, KEY, "USD", m["rate"], m["team"], m["hosting_year"], m["support_year"], m["sql_year"]).drop("tenant_id")


@query("select p_partkey, greatest(p_size - 5, 0)::bigint as methods, ceil(greatest(p_size - 5, 0) / 4.0)::bigint as requests, (greatest(p_size - 5, 0) * 1100 + ceil(greatest(p_size - 5, 0) / 4.0) * 650)::bigint as tokens_in, (greatest(p_size - 5, 0) * 180)::bigint as tokens_out from part")
def ai_token_estimate(spark, d):
    return table(spark, d, "part").select("p_partkey", portfolio.ai_tokens(F.col("p_size") - 5, 4).alias("t")).select("p_partkey", "t.*")


@query("select event_id, strftime(case when ts::date + interval 3 hour > ts then ts::date + interval 3 hour else ts::date + interval 27 hour end, '%Y-%m-%d %H:%M:%S') as next_at from events")
def next_sync(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(portfolio.next_run(F.col("ts").cast("timestamp_ntz"), 3), "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("select distinct lower(c_mktsegment) as rule_id from customer union select 'declared-only'")
def rule_id_union(spark, d):
    owned = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("rule_id"))
    return portfolio.rule_ids(owned, spark.createDataFrame([("declared-only",), ("building",)], "rule_id string"))


@query(f"with {FINDINGS} select id, status from f where status <> 'Resolved'")
def open_union(spark, d):
    return portfolio.open_findings(order_findings(spark, d)).select("id", "status")


@query("""
select event_id, case when event_id % 4 = 0 then 9.0::double when event_id % 4 = 1 then 3.0::double when event_id % 4 = 2 then null else 2.0::double end as input from events
""")
def price_overlay(spark, d):
    catalog = spark.createDataFrame(PRICES, "ordinal int, pattern string, input double, output double, cache_read double, cache_write double")
    ours = spark.createDataFrame([(0, "^gpt-5-mini$", 9.0, 9.0, None, None), (1, "^gpt-5", 8.0, 8.0, None, None)], catalog.schema)
    model = F.element_at(F.array(*map(F.lit, ["gpt-5-mini", "claude-sonnet-4", "in-house", "o3"])), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", model.alias("model"))
    names = e.select("model").distinct()
    return e.join(matching.first_pattern(names, "model", portfolio.overlaid(ours, catalog), "pattern", "ordinal", "input"), "model", "left").select("event_id", "input")


@query("select p_partkey from part where p_partkey % 5 = 0 or p_size < 2 or p_size % 7 = 0")
def price_validation(spark, d):
    rate = F.col("p_size").cast("double")
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")).alias("pattern"), (rate - 2).alias("input"), F.col("p_retailprice").cast("double").alias("output"), F.when(F.col("p_size") % 7 == 0, -0.5).alias("cache_read"), F.lit(0.0).alias("cache_write"))
    return portfolio.invalid_prices(p).select("p_partkey")


@query("""
with p as (select p_partkey as id, lower(p_brand) as b, lower(p_type) as m, p_size from part)
select id, m as fixture, true as wanted from p where not starts_with(m, b) union all select id, b, false from p where p_size % 2 = 0
""")
def signature_selftest(spark, d):
    brand = F.lower("p_brand")
    misses = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("x"), brand), brand)).otherwise(F.array(F.concat(F.lit("x"), brand)))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("^"), brand).alias("pattern"), F.array(F.concat(brand, F.lit(".com")), F.lower("p_type")).alias("hits"), misses.alias("misses"))
    return portfolio.failing_signatures(c)


@query("""
select event_id, case when event_id % 9 <> 0 and event_id % 4 <> 0 then regexp_extract(props, '[0-9]+')::bigint end as v,
       case when event_id % 9 <> 0 and event_id % 4 = 0 then regexp_extract(props, '[0-9]+') end as s from events
""")
def json_getters(spark, d):
    props = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).otherwise(F.col("props"))
    j = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("broken"), "props")).otherwise(props).alias("n"))
    return j.select("event_id", portfolio.json_value(F.col("n"), "$.k", "long").alias("v"), portfolio.json_value(F.col("n"), "$.k", "string").alias("s"))


@query("select c_custkey, trim(c_name)[1:12] as short, least(greatest(c_acctbal::double, 0), 5000) as bal from customer")
def truncate_clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", portfolio.truncated(F.col("c_name"), 12).alias("short"), portfolio.clamped(F.col("c_acctbal").cast("double"), 0.0, 5000.0).alias("bal"))


TENANT_KEY = b"a tenant's key"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in TENANT_KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""
select event_id, case when event_id % 10 = 0 then 'svc: user-' || user_id
  else 'id-' || sha256('{_PADS[1]}'::blob || unhex(sha256('{_PADS[0]}'::blob || encode('user-' || user_id))))[1:12] end as actor from events
""")
def actor_pseudonyms(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit(" User-"), F.col("user_id").cast("string")).alias("actor"))
    return e.select("event_id", portfolio.pseudonym(F.col("actor"), F.col("event_id") % 10 == 0, TENANT_KEY).alias("actor"))


@query("select o_orderkey from orders where o_orderstatus = 'F' or (o_orderstatus = 'O' and o_orderdate < timestamp '1997-01-01')")
def workspace_collection(spark, d):
    w = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Released").when(F.col("o_orderstatus") == "O", "Ready").otherwise("Leased").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("lease_expires"))
    return portfolio.collectable(w, F.expr("timestamp_ntz '1997-01-01'")).select("o_orderkey")


@query("select o_orderkey::varchar as id from orders where o_orderdate <= timestamp '1998-01-01' - interval 30 day and not exists (select 1 from customer where c_custkey = o_orderkey)")
def orphaned_uploads(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("written"))
    used = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("locator"))
    return portfolio.orphaned(a, used, F.expr("timestamp_ntz '1998-01-01'"), 30).select("id")


@query("""
with s as (select * from (values ('small', 1, 5, 21), ('small', 2, 35, null), ('medium', 3, null, 10), ('large', 4, 12, 45), ('promo', 5, 30, 31)) v(k, id, lo, hi))
select p_partkey, id from part join s on lower(split_part(p_type, ' ', 1)) = k where (lo is null or p_size >= lo) and (hi is null or p_size < hi)
""")
def version_segments(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower(F.split("p_type", " ")[0]).alias("k"), F.concat(F.lit("v"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0")).alias("version"))
    s = spark.createDataFrame([("small", 1, "0.5", "2.1-rc1+x"), ("small", 2, "3.5", None), ("medium", 3, None, "1.0"), ("large", 4, "1.2.0.0", "4.5"), ("promo", 5, "3", "3.1")], "k string, id int, lo string, hi string")
    keys = p.select("version").distinct().withColumn("key", version_key("version"))
    s = s.withColumns({"lo": version_key("lo"), "hi": version_key("hi")})
    hit = p.join(keys, "version").join(s, "k").filter(in_segment(F.col("key"), F.col("lo"), F.col("hi"), F.lit(None).cast("string")))
    return hit.select("p_partkey", "id")


@query("select c_custkey, case c_custkey % 8 when 0 then 'identifier' when 1 then 'contact' when 2 then 'financial' when 3 then 'health' when 4 then 'credential' when 5 then 'birth' end as category from customer")
def personal_data_names(spark, d):
    names = ["CustomerCPF", "home_address", "CardNumber", "blood-type", "[SenhaHash]", "DateOfBirth", "pinCode", "Address"]
    n = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", sensitive_category(n).alias("category"))


@query("""
with e as (select distinct l_suppkey as a, l_partkey % 60 as b from lineitem where l_suppkey <> l_partkey % 60),
n as (select a as x from e union select b from e)
select case when x in (select a from e) and x in (select b from e) then 'inner' else 'edge' end as place, count(*) as nodes, sum((x in (select a from e))::int)::bigint as sources from n group by 1
""")
def graph_places(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 60).alias("dst")).filter("src <> dst")
    g = graph.degrees(e)
    place = F.when((F.col("fan_in") > 0) & (F.col("fan_out") > 0), "inner").otherwise("edge")
    return g.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("fan_out") > 0).alias("sources"))


@query("""
with recursive e as (select distinct c_nationkey as src, c_custkey % 37 as dst from customer where c_nationkey <> c_custkey % 37),
p as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src),
m as (select a.src as node, least(min(a.dst), a.src) as component from p a join p b on a.src = b.dst and a.dst = b.src group by a.src)
select component, node from m qualify count(*) over (partition by component) > 1
""")
def graph_cycles(spark, d):
    e = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 37).cast("long").alias("dst"))
    return graph.cycles(e)
