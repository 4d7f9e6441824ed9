"""The library's operators on the driver's tables, each with the SQL that gives the same rows.

The tables stand in for an estate: orders are findings (nation: assessment, market segment: rule, priority: severity,
status: category), events are usage reports, lineitem and orders bill and estimate, documents and pages are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .operators import findings as fnd
from .operators import graph, latest, matching
from .plans import health, modernization, usage
from .rules import text_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    """assessment_id, rule_id, category, severity, status, file, seen_at, id."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    category = scalar.ladder([(F.col("o_orderstatus") == "F", "Security"), (F.col("o_orderstatus") == "O", "Quality")], "Modernization")
    status = F.when(F.col("o_orderkey") % 5 == 0, "Resolved").when(F.col("o_orderkey") % 7 == 0, "Regressed").otherwise("Open")
    return o.select(F.col("n_name").alias("assessment_id"), F.lower("c_mktsegment").alias("rule_id"), category.alias("category"), (5 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("severity"), status.alias("status"), F.concat_ws("/", F.lit("src"), F.lower("c_mktsegment"), (F.col("o_custkey") % 13).cast("string")).alias("file"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))


FINDINGS = """
f as (
  select n_name as assessment_id, lower(c_mktsegment) as rule_id,
         case o_orderstatus when 'F' then 'Security' when 'O' then 'Quality' else 'Modernization' end as category,
         5 - substr(o_orderpriority, 1, 1)::int as severity,
         case when o_orderkey % 5 = 0 then 'Resolved' when o_orderkey % 7 = 0 then 'Regressed' else 'Open' end as status,
         'src/' || lower(c_mktsegment) || '/' || (o_custkey % 13) as file, o_orderdate as seen_at, o_orderkey as id, o_custkey as cust
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""
POINTS = "case severity when 4 then 15 when 3 then 8 when 2 then 3 when 1 then 1 else 0 end"


@query(f"""
with {FINDINGS},
p as (select n_name as assessment_id, (20 * n_nationkey + 10)::bigint as project_count from nation),
s as (
  select assessment_id, sum(case when category = 'Security' then {POINTS} else 0 end)::bigint as ps,
         sum(case when category = 'Modernization' then {POINTS} else 0 end)::bigint as pm,
         sum(case when category = 'Quality' then {POINTS} else 0 end)::bigint as pq
  from f where status <> 'Resolved' group by 1),
x as (select p.assessment_id, 10.0::double / greatest(10, project_count) as scale, coalesce(ps, 0) as ps, coalesce(pm, 0) as pm, coalesce(pq, 0) as pq
      from p left join s on p.assessment_id = s.assessment_id),
y as (
  select *, round_even(greatest(0.0, 100 - least(100.0, ps * scale)), 0)::int as score_security,
         round_even(greatest(0.0, 100 - least(100.0, pm * scale)), 0)::int as score_modernization,
         100 as score_dependencies, 100 as score_architecture,
         round_even(greatest(0.0, 100 - least(100.0, pq * scale)), 0)::int as score_quality
  from x),
z as (select *, round_even(round(score_security * 0.30::double + score_modernization * 0.25::double + score_dependencies * 0.15::double
                           + score_architecture * 0.15::double + score_quality * 0.15::double, 6), 0)::int as score from y)
select assessment_id, score_security, score_modernization, score_dependencies, score_architecture, score_quality, score,
       case when score < 40 then 'Critical' when score < 60 then 'High' when score < 80 then 'Medium' else 'Low' end as risk,
       round_even((ps + pm + pq) * scale, 1) as penalty
from z
""")
def health_by_nation(spark, d):
    f = order_findings(spark, d).filter(F.col("status").isin(health.OPEN))
    projects = table(spark, d, "nation").select(F.col("n_name").alias("assessment_id"), (F.col("n_nationkey") * 20 + 10).cast("long").alias("project_count"))
    return health.health(f, projects, "assessment_id")


@query(f"""
with {FINDINGS},
g as (select assessment_id, case category when 'Quality' then 'Quality' when 'Security' then 'Security' else 'Modernization' end as dimension, rule_id,
             count(*) as n, sum({POINTS})::bigint as points from f group by 1, 2, 3)
select *, row_number() over (partition by assessment_id, dimension order by points desc, rule_id)::int as rank from g
qualify rank <= 3
""")
def health_contributors(spark, d):
    return health.contributors(order_findings(spark, d), "assessment_id", 3)


@query("""
select r_name as region, count(*) as n, round_even(quantile_cont(c_acctbal, 0.25), 1) as p25, round_even(quantile_cont(c_acctbal, 0.5), 1) as p50,
       round_even(quantile_cont(c_acctbal, 0.75), 1) as p75, max(c_acctbal) as best, min(c_acctbal) as worst
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1
""")
def benchmark_by_region(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return health.benchmark(c.select(F.col("r_name").alias("region"), "c_acctbal"), "region", "c_acctbal")


@query("""
select s_suppkey, round_even((rank() over (order by s_acctbal) - 1 + count(*) over (partition by s_acctbal) / 2.0::double) * 100.0::double / count(*) over (), 0)::int as pct_rank
from supplier
""")
def percentile_rank(spark, d):
    return health.percentile_rank(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", "pct_rank")


@query(f"with {FINDINGS} select assessment_id, rule_id, category, severity, count(*) as n from f where status <> 'Resolved' group by all")
def open_summary(spark, d):
    return health.open_summary(order_findings(spark, d), "assessment_id", "rule_id", "category", "severity")


@query(f"with {FINDINGS} select rule_id, max(severity) as max_severity, count(*) as n, count(distinct assessment_id) as assessments from f group by 1 order by max_severity desc, n desc, rule_id limit 15")
def top_rules(spark, d):
    return health.top_rules(order_findings(spark, d))


@query(f"""
with {FINDINGS}, p as (select rule_id, file, count(*) as c, max(severity) as s from f group by all),
k as (select *, row_number() over (partition by rule_id order by file) as r from p)
select rule_id, max(s) as max_severity, sum(c)::bigint as n, string_agg(case when r <= 5 then file end, ',' order by file) as files from k group by 1
""")
def by_rule_files(spark, d):
    return health.by_rule(order_findings(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"""
with {FINDINGS}
select array_to_string(list_slice(string_split(file, '/'), 1, least(2, len(string_split(file, '/')) - 1)), '/') as folder,
       count(*) filter (severity = 4) as critical, count(*) filter (severity = 3) as high, count(*) filter (severity = 2) as medium,
       count(*) filter (severity = 1) as low, count(*) filter (severity = 0) as info, count(distinct file) as files, sum({POINTS})::bigint as weight
from f group by 1
""")
def folder_heatmap(spark, d):
    return health.heatmap(order_findings(spark, d), 2)


@query(f"""
with {FINDINGS},
c as (select assessment_id, count(*) filter (status <> 'Resolved' and severity = 4) as o4, count(*) filter (status <> 'Resolved' and severity = 3 and id % 11 = 0) as n3 from f group by 1),
l as (select n_name as assessment_id, case when n_nationkey % 6 = 0 then null else n_nationkey * 4 end as score from nation)
select l.assessment_id, not (coalesce(o4, 0) > 110 or coalesce(n3, 0) > 9 or score is null or score < 30) as passed,
       (coalesce(o4, 0) > 110)::int + (coalesce(n3, 0) > 9)::int + (score is null or score < 30)::int as reasons
from l left join c on l.assessment_id = c.assessment_id
""")
def quality_gate(spark, d):
    latest_runs = table(spark, d, "nation").select(F.col("n_name").alias("assessment_id"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") * 4).alias("score"))
    f = order_findings(spark, d).withColumn("is_new", F.col("id") % 11 == 0)
    return health.quality_gate(f, latest_runs, "assessment_id", {4: 110}, {3: 9}, 30).withColumn("reasons", F.size("reasons"))


@query("select o_custkey, max(o_orderdate) as o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def latest_per_key(spark, d):
    o = table(spark, d, "orders")
    return latest.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


RUNS = """
r as (select c_nationkey::varchar as assessment_id, o_orderdate as finished_at, max(o_orderkey % 100)::int as health_score, count(*) as open_findings
      from orders join customer on o_custkey = c_custkey group by all)
"""


def runs(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("string").alias("assessment_id"), F.col("o_orderdate").alias("finished_at")).agg(F.max((F.col("o_orderkey") % 100)).cast("int").alias("health_score"), F.count(F.lit(1)).alias("open_findings"))


@query(f"""
with {RUNS}, cuts as (select unnest(generate_series(timestamp '1995-01-01', timestamp '1996-12-29', interval 7 day)) as day),
h as (select day, assessment_id, arg_max(health_score, finished_at) as s, arg_max(open_findings, finished_at) as o
      from cuts join r on finished_at <= day group by all)
select day, count(*) as assessments, round_even(avg(s), 1) as mean_score, sum(o)::bigint as open_findings from h group by 1
""")
def portfolio_trend(spark, d):
    cuts = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz '1995-01-01', timestamp_ntz '1996-12-29', interval 7 days)")).alias("day"))
    r = runs(spark, d).withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    return health.trend(r.filter("finished_at <= timestamp_ntz '1996-12-29'"), cuts)


@query(f"""
with {RUNS},
m as (select assessment_id, arg_max(health_score, finished_at) as score_now,
             arg_max(health_score, finished_at) filter (finished_at <= timestamp '1999-12-25') as score_before
      from r where finished_at <= timestamp '2000-01-01' group by 1)
select assessment_id, score_now, score_before, score_now - score_before as change from m
where score_before is not null and score_now <> score_before order by abs(score_now - score_before) desc, assessment_id limit 5
""")
def digest_movers(spark, d):
    return health.movers(runs(spark, d).withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz")), F.expr("timestamp_ntz '2000-01-01'"))


@query(f"""
with {FINDINGS}
select rule_id, count(*) filter (year(seen_at) = 1996) as n_a, count(*) filter (year(seen_at) = 1997) as n_b from f
where year(seen_at) in (1996, 1997) group by 1 having n_a <> n_b order by abs(n_a - n_b) desc, rule_id limit 12
""")
def rule_differences(spark, d):
    return health.rule_differences(order_findings(spark, d).withColumn("side", F.year("seen_at").cast("string")), "side", "1996", "1997")


@query("""
select s_suppkey, case when s_acctbal is null then 'None' when s_acctbal::int % 100 >= 60 then 'Met'
       when date '2024-06-15' > date '2024-01-01' + (s_suppkey * 7 % 300)::int then 'Missed'
       when (date '2024-01-01' + (s_suppkey * 7 % 300)::int) - date '2024-06-15' <= 30 then 'AtRisk'
       when 60 - s_acctbal::int % 100 > 20 then 'AtRisk' else 'OnTrack' end as status
from supplier
""")
def target_status(spark, d):
    s = table(spark, d, "supplier").withColumns({"score": F.round("s_acctbal").cast("int") % 100, "due": F.expr("cast(date_add(date '2024-01-01', cast(s_suppkey * 7 % 300 as int)) as timestamp_ntz)")})
    return s.select("s_suppkey", health.target_status(F.col("score"), F.lit(60), F.col("due"), F.expr("timestamp_ntz '2024-06-15'")).alias("status"))


# Usage


def usage_facts(spark, d):
    e = table(spark, d, "events")
    model = F.element_at(F.array(*map(F.lit, ["gpt-5-mini", "claude-sonnet-4", "in-house", "o3"])), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("tool"), F.to_date("ts").alias("period"), model.alias("model"), F.round(F.col("value") * 100).cast("long").alias("input_tokens"), (F.col("event_id") % 7 * 10).alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), F.lit(1).cast("long").alias("requests"), (F.col("event_id") % 3).alias("sessions"), F.when(F.col("event_id") % 50 != 0, F.col("value").cast("decimal(18,2)")).alias("estimated_cost"), F.lit(None).cast("string").alias("provider"), F.col("ts").alias("reported_at"))


USAGE = """
u as (
  select 'user-' || user_id as actor, event_type as tool, ts::date as period, ['gpt-5-mini', 'claude-sonnet-4', 'in-house', 'o3'][event_id % 4 + 1] as model,
         round(value * 100)::bigint as input_tokens, event_id % 7 * 10 as output_tokens, 1 as requests, event_id % 3 as sessions,
         case when event_id % 50 <> 0 then value::decimal(18, 2) end as cost, ts as reported_at, round(value * 100)::bigint + event_id % 7 * 10 as tokens
  from events)
"""
PROVIDER = "case when model like 'gpt-%' or model like 'o3%' then 'openai' when model like 'claude%' then 'anthropic' else 'unknown' end"


@query(f"""
with {USAGE}, y as (select actor, period, max(sessions) as s from u group by all), z as (select actor, sum(s)::bigint as sessions from y group by 1)
select u.actor, list_aggregate(list_sort(list_distinct(list(tool))), 'string_agg', ',') as tools, any_value(z.sessions) as sessions, sum(requests)::bigint as requests,
       sum(tokens)::bigint as tokens, sum(coalesce(cost, 0))::double as estimated_cost, sum(case when cost is null then tokens else 0 end)::bigint as unpriced_tokens, max(period)::varchar as last_day
from u join z on u.actor = z.actor group by 1
""")
def usage_by_actor(spark, d):
    return usage.by_actor(usage_facts(spark, d)).withColumns({"tools": F.array_join("tools", ","), "estimated_cost": F.col("estimated_cost").cast("double"), "last_day": F.col("last_day").cast("string")}).drop("last_report")


@query(f"with {USAGE} select model, sum(tokens)::bigint as tokens, case when count(*) = count(cost) then sum(cost)::double end as estimated_cost, count(distinct actor) as actors from u group by 1")
def usage_by_model(spark, d):
    return usage.by_model(usage_facts(spark, d)).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@query(f"with {USAGE} select period::varchar as period, sum(tokens)::bigint as tokens, sum(coalesce(cost, 0))::double as estimated_cost, count(distinct actor) as actors from u group by 1")
def usage_by_day(spark, d):
    return usage.by_day(usage_facts(spark, d)).withColumns({"estimated_cost": F.col("estimated_cost").cast("double"), "period": F.col("period").cast("string")})


@query(f"""
with {USAGE} select {PROVIDER} as provider, sum(tokens)::bigint as tokens, sum(coalesce(cost, 0))::double as estimated_cost,
       sum(case when cost is null then tokens else 0 end)::bigint as unpriced_tokens, count(distinct actor) as actors, count(distinct model) as models from u group by 1
""")
def usage_by_provider(spark, d):
    return usage.by_provider(usage_facts(spark, d)).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@query(f"with {USAGE} select tool, sum(tokens)::bigint as tokens, sum(coalesce(cost, 0))::double as estimated_cost, count(distinct actor) as actors from u group by 1")
def usage_by_tool(spark, d):
    return usage.by_tool(usage_facts(spark, d)).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@query(f"with {USAGE} select model, sum(tokens)::bigint as tokens, count(distinct actor) as actors, max(period)::varchar as last_seen from u where cost is null group by 1")
def unpriced_models(spark, d):
    return usage.unpriced_models(usage_facts(spark, d)).withColumn("last_seen", F.col("last_seen").cast("string"))


PRICES = [(0, "^gpt-5-mini", 0.25, 2.0, 0.025, None), (1, "^gpt-5", 1.25, 10.0, 0.125, None), (2, "^claude-sonnet-4", 3.0, 15.0, 0.3, 3.75), (3, "^o3", 2.0, 8.0, 0.5, None)]


@query(f"""
with {USAGE}, p as (select * from (values ('gpt-5-mini', 2500, 20000), ('claude-sonnet-4', 30000, 150000), ('o3', 20000, 80000)) p(m, i, o)),
t as (select model, input_tokens * i + output_tokens * o as t from u left join p on m = model),
q as (select model, t // 1000000 + case when t % 1000000 > 500000 or (t % 1000000 = 500000 and t // 1000000 % 2 = 1) then 1 else 0 end as q from t)
select model, sum(q)::bigint / 10000 as estimated_cost, count(*) as n from q group by 1
""")
def price_first_match(spark, d):
    prices = spark.createDataFrame(PRICES, "ordinal int, pattern string, input double, output double, cache_read double, cache_write double")
    out = usage.priced(usage_facts(spark, d).drop("estimated_cost"), prices)
    return out.groupBy("model").agg(F.sum("estimated_cost").cast("double").alias("estimated_cost"), F.count(F.lit(1)).alias("n"))


TEAMS = [("ones", ["user-1*"], 0), ("odd", ["USER-*7", "user-23"], 1)]


@query(f"""
with {USAGE}, t as (select *, case when actor like 'user-1%' then 'ones' when actor like 'user-%7' or actor = 'user-23' then 'odd' else '(unassigned)' end as team from u)
select team, count(distinct actor) as members, sum(case when period > date '2023-12-21' then tokens else 0 end)::bigint as tokens, sum(coalesce(cost, 0))::double as estimated_cost,
       sum(coalesce(cost, 0))::double as month_to_date, round_even(sum(coalesce(cost, 0))::double / 20 * 31, 2) as projected
from t where period <= date '2024-01-20' group by 1
""")
def usage_by_team(spark, d):
    teams = spark.createDataFrame(TEAMS, "name string, members array<string>, ordinal int")
    f = usage_facts(spark, d).withColumn("estimated_cost", F.col("estimated_cost"))
    out = usage.by_team(f, teams, F.to_date(F.lit("2024-01-20")))
    return out.withColumns({c: F.col(c).cast("double") for c in ("estimated_cost", "month_to_date", "projected")})


@query(f"""
with {USAGE}, day as (select tool, period, sum(coalesce(cost, 0))::double as cost, sum(tokens)::bigint as tokens, sum(case when cost is null then tokens else 0 end)::bigint as unpriced from u where period <= date '2024-01-20' group by all),
spine as (select t.tool, (date '2024-01-20' - g.a::int) as period, g.a as ago from (select distinct tool from day) t, (select unnest(range(28)) as a) g),
s as (select spine.tool, ago, coalesce(cost, 0) as c from spine left join day on spine.tool = day.tool and spine.period = day.period),
agg as (select tool, sum(case when period >= date '2024-01-01' then cost else 0 end) as mtd, sum(case when period > date '2024-01-13' then cost else 0 end) / 7 as avg7,
               sum(cost) / 30 as avg30, sum(tokens)::bigint as month_tokens, sum(unpriced)::bigint as month_unpriced from day group by 1),
fut as (select unnest(range(1, 12)) as dd),
med as (select s.tool, dd, median(c) as m from s, fut where (ago + dd) % 7 = 0 and ago + dd <= 28 group by all),
sea as (select tool, sum(m) as extra from med group by 1),
st as (select tool, avg(c) as mean, stddev_samp(c) as sd from s group by 1)
select agg.tool, round(round(mtd, 6)::decimal(28, 6), 2)::double as month_to_date, round(round(mtd / 20 * 31, 6)::decimal(28, 6), 2)::double as projected, round(round(mtd + extra, 6)::decimal(28, 6), 2)::double as seasonal,
       round(round(greatest(mtd, mtd + 11 * greatest(0, mean - sd)), 6)::decimal(28, 6), 2)::double as low, round(round(greatest(mtd + 11 * (mean + sd), mtd + extra), 6)::decimal(28, 6), 2)::double as high,
       round(round(avg7, 6)::decimal(28, 6), 2)::double as avg7, round(round(avg30, 6)::decimal(28, 6), 2)::double as avg30, round(round(avg7 * 30, 6)::decimal(28, 6), 2)::double as next30, round(round((avg7 - avg30) / avg30 * 100, 6)::decimal(28, 6), 2)::double as trend_pct, month_tokens, month_unpriced, null::double as calibrated
from agg join sea on agg.tool = sea.tool join st on agg.tool = st.tool
""")
def usage_forecast(spark, d):
    return usage.forecast(usage_facts(spark, d), "2024-01-20", ["tool"])


@query(f"""
with {USAGE}, s as (select unnest(generate_series(date '2024-01-01', date '2024-01-20', interval 1 day))::date as period), c as (select period, sum(coalesce(cost, 0))::double as c from u group by 1)
select s.period::varchar as period, round(sum(coalesce(c, 0)) over (order by s.period), 2) as spent from s left join c on s.period = c.period
""")
def usage_cumulative(spark, d):
    return usage.cumulative(usage_facts(spark, d), "2024-01-20").withColumn("period", F.col("period").cast("string"))


@query(f"""
with {USAGE}, day as (select period, sum(coalesce(cost, 0))::double as cost from u where event_mark group by 1),
b as (select a.period, list_sort(list(p.cost)) as cs from day a join day p on p.period < a.period and p.period >= a.period - 7 and p.cost > 0 group by 1)
select day.period::varchar as period, day.cost, cs[len(cs) // 2 + 1] as median from day join b on day.period = b.period where len(cs) >= 4 and cost >= 5 and cost > 1.1 * cs[len(cs) // 2 + 1]
""".replace("round(value * 100)::bigint + event_id % 7 * 10 as tokens", "round(value * 100)::bigint + event_id % 7 * 10 as tokens, event_type = 'purchase' as event_mark"))
def usage_anomalies(spark, d):
    return usage.anomalies(usage_facts(spark, d).filter("tool = 'purchase'"), 5.0, 1.1).withColumn("period", F.col("period").cast("string"))


BUDGETS = [("b1", "tenant", None, 200000.0, True), ("b2", "team", "Ones", 80000.0, True), ("b3", "provider", "openai", 90000.0, True), ("b4", "model", "claude", 20000.0, True), ("b5", "tool", "view", 30000.0, True), ("b6", "actor", "user-3", 3000.0, True), ("b7", "tool", "click", 1.0, False)]
BUDGET_SQL = f"""
with {USAGE}, t as (select *, case when actor like 'user-1%' then 'ones' else 'x' end as team, {PROVIDER} as prov from u where period <= date '2024-01-20'),
b as (select * from (values ('b1', 200000.0::double, 'tenant', ''), ('b2', 80000.0, 'team', 'ones'), ('b3', 90000.0, 'provider', 'openai'), ('b4', 20000.0, 'model', 'claude'), ('b5', 30000.0, 'tool', 'view'), ('b6', 3000.0, 'actor', 'user-3')) v(id, amount, scope, k)),
s as (select id, amount, coalesce(sum(cost), 0)::double as spent from b left join t on scope = 'tenant' or (scope = 'team' and team = k) or (scope = 'provider' and prov = k)
      or (scope = 'model' and starts_with(model, k)) or (scope = 'tool' and tool = k) or (scope = 'actor' and actor = k) group by all),
q as (select *, round_even(spent / amount * 100, 1) as percent, round_even(spent / 20 * 31, 2) as projected from s),
z as (select *, round_even(projected / amount * 100, 1) as projected_percent from q)
"""


@query(BUDGET_SQL + "select id, spent, percent, projected, projected_percent, case when percent >= 100 then 'over' when percent >= 80 or projected_percent >= 100 then 'warn' else 'ok' end as state from z")
def budget_status(spark, d):
    teams = spark.createDataFrame(TEAMS, "name string, members array<string>, ordinal int")
    budgets = spark.createDataFrame(BUDGETS, "id string, scope string, scope_key string, monthly_amount double, enabled boolean")
    return usage.budget_status(usage_facts(spark, d), budgets, teams, "2024-01-20")


@query(BUDGET_SQL + "select 'threshold:' || id || ':2024-01:' || t as key, id, t as threshold, percent from z, (select unnest([50, 80, 100])::int as t) where percent >= t and not (id = 'b1' and t = 50)")
def budget_alerts(spark, d):
    raised = spark.createDataFrame([("threshold:b1:2024-01:50",)], "key string")
    return usage.budget_alerts(budget_status(spark, d), raised, "2024-01-20")


def usage_events(spark, d):
    e = table(spark, d, "events").filter("ts >= timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-11'")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("tool"), F.to_date("ts").alias("period"), F.col("ts").cast("timestamp").alias("reported_at"), F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("tokens_today"), F.sum(F.col("value").cast("decimal(18,2)")).over(w).alias("estimated_cost_today"), F.count(F.lit(1)).over(w).cast("long").alias("requests_today"))


EVENTS = """
e as (select 'user-' || user_id as actor, event_type as tool, ts as reported_at, (sum(round(value * 100)::bigint) over w)::bigint as tokens_today, sum(value::decimal(18, 2)) over w as cost_today, count(*) over w as requests_today
      from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11' window w as (partition by user_id, event_type order by ts rows unbounded preceding))
"""


@query(f"""
with {EVENTS}, p as (select actor, tool, arg_max(tokens_today, reported_at) as t, arg_max(cost_today, reported_at) as c, arg_max(requests_today, reported_at) as r, max(reported_at) as l,
  arg_max(tokens_today, reported_at) filter (reported_at <= timestamp '2024-01-10 22:00:00') as b from e group by all)
select actor, string_agg(tool, ',' order by tool) as tools, max(l) >= timestamp '2024-01-10 22:00:00' as active_now, sum(t)::bigint as tokens_today, sum(c)::double as cost_today, sum(r)::bigint as requests_today,
  greatest(0, sum(t) - sum(coalesce(b, 0)))::bigint as tokens_last_hour from p group by 1
""")
def usage_live(spark, d):
    out = usage.live(usage_events(spark, d), "2024-01-10 23:00:00")
    return out.withColumns({"tools": F.array_join("tools", ","), "cost_today": F.col("cost_today").cast("double")}).drop("last_report")


@query(f"""
with {EVENTS}, cuts as (select unnest(generate_series(timestamp '2024-01-10 00:15:00', timestamp '2024-01-10 23:00:00', interval 15 minute)) as cut_at),
h as (select cut_at, actor, tool, arg_max(tokens_today, reported_at) as t, arg_max(cost_today, reported_at) as c from cuts join e on reported_at <= cut_at group by all)
select strftime(cut_at, '%Y-%m-%d %H:%M:%S') as at_time, sum(t)::bigint as tokens, sum(c)::double as cost from h group by 1
""")
def usage_live_curve(spark, d):
    out = usage.live_curve(usage_events(spark, d), "2024-01-10 23:00:00")
    return out.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "tokens", F.col("cost").cast("double").alias("cost"))


@query("""
with e as (select o_orderpriority as provider, o_orderdate as day, sum(o_totalprice::decimal(18, 2))::double as est from orders where o_orderkey % 3 <> 0 group by all),
r as (select o_orderpriority as provider, o_orderdate as day, sum((o_totalprice * 1.2)::decimal(18, 2))::double as rep from orders where o_orderkey % 4 <> 0 group by all),
j as (select lower(coalesce(e.provider, r.provider)) as provider, est, rep from e full join r on e.provider = r.provider and e.day = r.day),
g as (select provider, round_even(sum(coalesce(est, 0)), 2) as estimated, round_even(sum(coalesce(rep, 0)), 2) as reported, count(*) filter (est is not null and rep is not null) as overlap_days,
  count(*) filter (rep is null) as only_estimated, count(*) filter (est is null) as only_reported, sum(case when est is not null and rep is not null then est else 0 end) as eo, sum(case when est is not null and rep is not null then rep else 0 end) as ro from j group by 1)
select provider, estimated, reported, overlap_days, only_estimated, only_reported, round_even(ro / eo, 3) as ratio, overlap_days >= 7 as usable, round_even(eo, 2) as est_overlap, round_even(ro, 2) as rep_overlap from g
""")
def reconcile_sources(spark, d):
    o = table(spark, d, "orders")
    est = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderpriority").alias("provider"), F.lit("m").alias("model"), F.to_date("o_orderdate").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("estimated_cost"))
    rep = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderpriority").alias("provider"), F.lit("provider-reported").alias("basis"), F.to_date("o_orderdate").alias("period"), (F.col("o_totalprice") * 1.2).cast("decimal(18,2)").alias("amount"))
    return usage.reconciliation(est, rep)


@query("""
with g as (select n_name as provider, c_mktsegment as k, sum(c_acctbal::decimal(18, 2)) as a from customer join nation on c_nationkey = n_nationkey group by all),
r as (select *, row_number() over (partition by provider order by a desc, k) as r from g)
select provider, 'reported' as basis, 'USD' as currency, sum(a)::double as amount, string_agg(case when r <= 3 then k end, ',' order by r) as details from r group by 1
""")
def cost_summary(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("provider"), F.lit("reported").alias("basis"), F.lit("USD").alias("currency"), F.col("c_mktsegment").alias("dimension_key"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))
    return usage.cost_summary(c, 3).withColumns({"amount": F.col("amount").cast("double"), "details": F.array_join(F.transform("details", lambda x: x["dimension_key"]), ",")})


@query("""
with x as (select user_id % 20 as k, event_id, ts, round(value * 100)::bigint as v, lag(round(value * 100)::bigint) over (partition by user_id % 20 order by ts, event_id) as p from events)
select k, count(*) as n, sum(greatest(0, case when p is null or v < p then v else v - p end))::bigint as delta from x group by 1
""")
def counter_delta(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("k"), "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))
    return latest.counter_deltas(e, ["k"], ["ts", "event_id"], "v").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"))


@query("""
select conv_id, turn, coalesce(last_value(case when role = 'user' then length(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), 0)::int as asked from conversations
""")
def role_forward_fill(spark, d):
    c = table(spark, d, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.length("text")))
    return latest.forward_fill(c, ["conv_id"], ["turn"], "asked").select("conv_id", "turn", F.coalesce("asked", F.lit(0)).alias("asked"))


# Findings as state


@query("select doc_id, sha256('rule-' || (doc_id % 5) || chr(10) || '1' || chr(10) || 'acme/shop' || chr(10) || 'src/' || source || '.cs' || chr(10) || trim(lang)) as fingerprint from documents")
def fingerprint(spark, d):
    t = table(spark, d, "documents")
    fp = fnd.fingerprint(F.concat(F.lit("Rule-"), (F.col("doc_id") % 5).cast("string")), F.lit(1), F.lit("ACME/shop"), F.concat(F.lit(".\\src\\"), F.col("source"), F.lit(".cs")), F.col("lang"))
    return t.select("doc_id", fp.alias("fingerprint"))


@query("""
with e as (select doc_id::varchar as fingerprint, case when doc_id % 4 = 0 then 'Resolved' when doc_id % 9 = 0 then 'Suppressed' else 'Open' end as status from documents where doc_id % 3 <> 0),
s as (select doc_id::varchar as fingerprint, count(*) as occurrences, max(n_chars % 5)::int as severity from (select doc_id, n_chars from documents where doc_id % 2 = 0 union all select doc_id, n_chars + 1 from documents where doc_id % 6 = 0) group by 1)
select coalesce(e.fingerprint, s.fingerprint) as fingerprint,
       case when e.fingerprint is null then 'Open' when s.fingerprint is not null and status = 'Resolved' then 'Regressed'
            when s.fingerprint is null and status = 'Open' then 'Resolved' else status end as status,
       case when e.fingerprint is null then 'new' when s.fingerprint is not null and status = 'Resolved' then 'regressed' when s.fingerprint is not null then 'recurring'
            when status = 'Open' then 'resolved' else 'unchanged' end as outcome,
       coalesce(occurrences, 0) as occurrences, coalesce(severity, 1) as severity
from e full join s on e.fingerprint = s.fingerprint
""")
def reconcile_runs(spark, d):
    t = table(spark, d, "documents").withColumn("fingerprint", F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    status = F.when(F.col("doc_id") % 4 == 0, "Resolved").when(F.col("doc_id") % 9 == 0, "Suppressed").otherwise("Open")
    existing = t.filter("doc_id % 3 <> 0").select("fingerprint", F.lit("r").alias("rule_id"), F.lit("Quality").alias("category"), F.lit(1).alias("severity"), F.lit("t").alias("title"), status.alias("status"), F.lit("s0").alias("first_seen"), F.lit("s0").alias("last_seen"), none.alias("resolved_in"), none.alias("predecessor"))
    cand = lambda x, o, plus: x.select("fingerprint", F.lit("r").alias("rule_id"), F.lit("Quality").alias("category"), ((F.col("n_chars") + plus) % 5).cast("int").alias("severity"), F.lit("t").alias("title"), F.lit(o).alias("ordinal"), none.alias("previous"))
    candidates = cand(t.filter("doc_id % 2 = 0"), 0, 0).unionByName(cand(t.filter("doc_id % 6 = 0"), 1, 1))
    return fnd.reconcile(existing, candidates, "s1", True).select("fingerprint", "status", "outcome", "occurrences", "severity")


@query("""
with p as (select unnest(['%/machinery/1%', '%/build%']) as pat)
select id, file from (select o_orderkey as id, 'src/' || lower(c_mktsegment) || '/' || (o_custkey % 13) as file from orders join customer on o_custkey = c_custkey) f
where not exists (select 1 from p where f.file like pat)
""")
def policy_filter(spark, d):
    policies = spark.createDataFrame([("machinery/1",), ("/build",)], "pattern string")
    return matching.unmatched(order_findings(spark, d).select("id", "file"), "file", policies, "pattern")


@query("""
with c as (select o_orderkey as id, 'a' || (o_custkey % 3) || '/b' || (o_custkey % 5) || '/f' || o_custkey as path from orders),
o as (select unnest(['a0', 'a0/b1', 'a1', 'a2/b4']) as folder)
select id, arg_max(folder, length(folder)) as folder from c left join o on starts_with(path, folder || '/') group by 1
""")
def longest_prefix_owner(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string"), F.lit("/b"), (F.col("o_custkey") % 5).cast("string"), F.lit("/f"), F.col("o_custkey").cast("string")).alias("path"))
    owners = spark.createDataFrame([("a0",), ("a0/b1",), ("a1",), ("a2/b4",)], "folder string")
    return matching.longest_prefix(f, "path", owners, "folder").select("id", "folder")


@query("""
with r as (select * from (values ('small', 1, 10, 30), ('small', 2, 40, null), ('MEDIUM', 3, null, 20), ('LARGE', 4, 5, 25), ('PROMO', 5, 10, 12)) v(k, id, lo, hi))
select p_partkey, id as range_id from part join r on upper(p_type) = upper(k) where (lo is null or p_size >= lo) and (hi is null or p_size < hi)
""")
def version_range(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.upper("p_type").alias("k"), "p_size")
    r = spark.createDataFrame([("SMALL", 1, 10, 30), ("SMALL", 2, 40, None), ("MEDIUM", 3, None, 20), ("LARGE", 4, 5, 25), ("PROMO", 5, 10, 12)], "k string, range_id int, lo int, hi int")
    return matching.in_ranges(p, r, "k", "p_size", "lo", "hi").select("p_partkey", "range_id")


# Text


@query("""
with r as (select doc_id, text, regexp_replace(text, '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]', 'g') as t,
  len(regexp_extract_all(text, '\\bAKIA[0-9A-Z]{16}\\b')) as c from documents),
s as (select doc_id, regexp_replace(text, '(?i)\\b(password|passwd|pwd|secret|token|api[_-]?key)(\\s*[:=]\\s*)["'']?[^\\s"'';,]+["'']?', '\\1\\2[REDACTED]', 'g') as t,
  len(regexp_extract_all(text, '(?i)\\b(password|passwd|pwd|secret|token|api[_-]?key)(\\s*[:=]\\s*)["'']?[^\\s"'';,]+["'']?')) + c as n from r)
select doc_id, md5(regexp_replace(t, '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]', 'g')) as digest, n::int as replaced from s
""")
def redact(spark, d):
    text, count = scalar.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), count.cast("int").alias("replaced"))


@query("""
with a as (select doc_id, string_split(text, chr(10)) as a from documents),
r as (select doc_id, generate_subscripts(a, 1) as line, unnest(a) as raw from a),
l as (select doc_id, line, regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g') as raw from r),
n as (select *, row_number() over (partition by doc_id order by line) as n from l where raw <> ''),
b as (select doc_id, line, n, list(raw) over w as block, count(*) over w as size from n window w as (partition by doc_id order by n rows between current row and 7 following)),
t as (select block from b where size = 8 group by 1 having count(*) > 1),
c as (select distinct doc_id, unnest(generate_series(n, n + 7)) as n from b where size = 8 and block in (select block from t)),
i as (select *, n - row_number() over (partition by doc_id order by n) as g from c),
u as (select doc_id, min(n) as lo, max(n) as hi from i group by doc_id, g having hi - lo + 1 >= 12)
select u.doc_id, x.line::int as first_line, y.line::int as last_line from u join n x on x.doc_id = u.doc_id and x.n = lo join n y on y.doc_id = u.doc_id and y.n = hi
""")
def duplicate_blocks(spark, d):
    return text_rules.duplicate_blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""
with e as (select p_partkey, ['MIT', 'MIT OR GPL-3.0-only', '(Apache-2.0 AND LGPL-2.1)', 'GPL-2.0 WITH Classpath-exception-2.0', 'Mystery', 'AGPL-3.0-or-later OR Mystery', 'MIT AND Mystery', 'SSPL-1.0 and MIT', 'see license in EULA.txt', 'CC-BY-NC-2.5', 'gpl-1.0+'][p_partkey % 11 + 1] as expression from part)
select p_partkey, case expression when 'MIT' then 'Permissive' when 'MIT OR GPL-3.0-only' then 'Permissive' when '(Apache-2.0 AND LGPL-2.1)' then 'WeakCopyleft'
  when 'GPL-2.0 WITH Classpath-exception-2.0' then 'WeakCopyleft' when 'AGPL-3.0-or-later OR Mystery' then 'StrongCopyleft' when 'SSPL-1.0 and MIT' then 'Restricted' when 'see license in EULA.txt' then 'Restricted'
  when 'CC-BY-NC-2.5' then 'Restricted' when 'gpl-1.0+' then 'StrongCopyleft' else 'Unknown' end as class from e
""")
def license_classify(spark, d):
    e = F.element_at(F.array(*map(F.lit, ["MIT", "MIT OR GPL-3.0-only", "(Apache-2.0 AND LGPL-2.1)", "GPL-2.0 WITH Classpath-exception-2.0", "Mystery", "AGPL-3.0-or-later OR Mystery", "MIT AND Mystery", "SSPL-1.0 and MIT", "see license in EULA.txt", "CC-BY-NC-2.5", "gpl-1.0+"])), (F.col("p_partkey") % 11 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalar.license_class(e).alias("class"))


@query("""
select page_id, count(*) as links, count(distinct h) as targets from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) as h from pages) group by 1
""")
def page_links(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("h"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("h").alias("targets"))


@query("""
with s as (select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as s from pages)
select page_id, trim(s[1:60], '-') as slug from s
""")
def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.slug(F.col("url")).alias("slug"))


@query("select doc_id, len(text[1:n_chars // 2]) - len(replace(text[1:n_chars // 2], chr(10), '')) + 1 as line from documents")
def line_of_offset(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.line_of_offset(F.col("text"), F.floor(F.col("n_chars") / 2)).cast("long").alias("line"))


# Graphs


@query("""
with recursive e as (select distinct l_suppkey as src, l_partkey % (select count(*) from supplier) as dst from lineitem),
p as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src)
select src, count(*) as n from p group by 1
""")
def graph_closure(spark, d):
    n = table(spark, d, "supplier").count()
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst"))
    return graph.reach_counts(e)


@query("""
with e as (select distinct l_suppkey as a, l_partkey % 50 as b from lineitem)
select node, sum(o)::bigint as fan_out, sum(i)::bigint as fan_in from (select a as node, 1 as o, 0 as i from e union all select b, 0, 1 from e) group by 1
""")
def graph_degrees(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"))
    return graph.degrees(e)


# Modernization


def estates(spark, d):
    key = "assessment_id"
    f = order_findings(spark, d)
    rules = F.array(*map(F.lit, ["dependency.migration-blocker.mb-002", "dependency.migration-blocker.mb-006", "dependency.migration-blocker.mb-008", "quality.tests.none", "architecture.cycle.project", "dependency.package.vulnerable"]))
    f = f.select(key, F.element_at(rules, (F.col("id") / 40 % 6 + 1).cast("int")).alias("rule_id"), "category", "severity", F.col("file").alias("file_path"), F.lit(None).cast("map<string,string>").alias("data"))
    n = table(spark, d, "nation").select(F.col("n_name").alias(key), F.col("n_nationkey").cast("long").alias("k"))
    p = n.select(key, F.explode(F.sequence(F.lit(0), (F.col("k") % 7).cast("int"))).alias("i"), "k").select(key, F.when(F.col("i") % 3 == 0, "v4.7.2").when(F.col("i") % 3 == 1, "net8.0").otherwise("net48").alias("target_framework"), (F.col("i") % 3 == 1).alias("is_sdk_style"), F.lit(None).cast("string").alias("ui_framework"))
    e = n.select(key, (F.col("k") * 20000 + 5000).alias("lines_of_code"), (F.col("k") / 2).alias("average_complexity"), F.lit("Syntactic").alias("tier"))
    return modernization.profile(f, p, e, key)


ESTATES = f"""
with {FINDINGS},
x as (select assessment_id, category, severity, file, (id // 40) % 6 as r from f),
g as (select assessment_id, count(*) filter (r = 0) as pre, count(*) filter (r = 2) as high, count(*) filter (r = 1) as medium, count(distinct case when r < 3 then r end) as rules, count(distinct case when r < 3 then file end) as files,
  count(*) filter (category = 'Security' and severity = 4) as c4, count(*) filter (category = 'Security' and severity = 3) as c3, count(*) filter (category = 'Security' and severity = 2) as c2,
  count(*) filter (r = 3) = 0 as tests, count(*) filter (r = 4) as cycles, count(*) filter (r = 5) as packages, count(*) filter (r = 1) > 0 as ef6 from x group by 1),
n as (select n_name as assessment_id, n_nationkey as k, n_nationkey % 7 + 1 as projects from nation),
q as (select n.*, (k * 20000 + 5000)::bigint as loc, k / 2 as cx, projects - (projects + 1) // 3 as legacy, coalesce(pre, 0) as pre, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(rules, 0) as rules,
  least(coalesce(files, 0), projects) / projects as share, coalesce(c4, 0) as c4, coalesce(c3, 0) as c3, coalesce(c2, 0) as c2, coalesce(tests, true) as tests, coalesce(cycles, 0) as cycles, coalesce(packages, 0) as packages, coalesce(ef6, false) as ef6
  from n left join g on n.assessment_id = g.assessment_id)
"""


FITS = """
, t as (select *, high > 0 as has_high, high > 0 as wcf, c4 + c3 > 0 as debt, not tests as deficit from q),
fits as (
  select assessment_id, 'KeepStabilize' as strategy, 0 as place, 20 + case when legacy = 0 then 55 else -20 end + case when debt then 0 else 10 end + case when rules = 0 then 10 else 0 end as fit,
    case when legacy > 0 then 2 when debt then 1 else 0 end as risk_level from t
  union all select assessment_id, 'UpgradeInPlace', 1, 30 + case when legacy > 0 then 25 else 0 end + case when has_high then -least(40, 10 * 1 + high // 5 * 5) else 30 end + case when loc < 150000 then 10 else 0 end - case when deficit then 10 else 0 end,
    case when has_high then 2 when deficit then 1 else 0 end from t
  union all select assessment_id, 'Incremental', 2, 40 + case when legacy > 0 then 15 else 0 end + case when has_high then 20 else 0 end + case when projects between 5 and 60 then 15 else 0 end + case when deficit then 0 else 10 end + case when cycles > 0 then 5 else 0 end,
    case when deficit then 1 else 0 end from t
  union all select assessment_id, 'Strangler', 3, 20 + case when loc >= 300000 or projects > 40 then 30 else 0 end + case when wcf then 25 else 0 end + case when high >= 3 then 10 else 0 end - case when projects < 5 then 25 else 0 end,
    case when loc >= 300000 then 2 else 1 end from t
  union all select assessment_id, 'PartialRewrite', 4, 15 + case when has_high and share > 0 and share <= 0.35 then 45 when has_high then 10 else 0 end - case when deficit then 10 else 0 end, 2 from t
  union all select assessment_id, 'FullRewrite', 5, 5 + case when loc > 0 and loc < 40000 and has_high then 45 else 0 end + case when high >= 4 and share > 0.6 then 20 else 0 end - case when loc >= 150000 then 30 else 0 end - case when deficit then 15 else 0 end,
    case when deficit then 3 else 2 end from t),
clamped as (select assessment_id, strategy, place, greatest(0, least(100, fit))::int as fit, risk_level from fits)
"""


@query(ESTATES + FITS + """
select assessment_id, strategy, fit, (['Low', 'Medium', 'High', 'Critical'])[risk_level + 1] as risk, row_number() over (partition by assessment_id order by fit desc, risk_level, place) = 1 as recommended from clamped
""")
def strategy_fit(spark, d):
    return modernization.strategies(estates(spark, d), "assessment_id").drop("place")


HOURS = """
, rates as (select * from (values ('KeepStabilize', 2.0::double, 0.0::double), ('UpgradeInPlace', 12.0, 1.0), ('Incremental', 18.0, 1.0), ('Strangler', 24.0, 1.0), ('PartialRewrite', 0.0, 0.5), ('FullRewrite', 60.0, 0.25)) v(strategy, per_kloc, blocker_share)),
w as (select q.*, rates.*, loc / 1000.0::double as kloc, least(0.7::double, greatest(0.1::double, case when share = 0 then 0.3::double else share end)) as rewritten,
        c4 * 16.0::double + c3 * 8.0::double + c2 * 3.0::double + packages * 4.0::double as security from q, rates),
y as (select *, case when strategy = 'PartialRewrite' then kloc * rewritten * 60.0::double + kloc * (1 - rewritten) * 12.0::double else kloc * per_kloc end
        + (pre * 8.0::double + high * 80.0::double + medium * 24.0::double) * blocker_share + security as base,
        case when not tests then 1.3::double else 1.1::double end * case when cx > 10 then 1.2::double else 1.0::double end * case when cycles > 0 and strategy <> 'FullRewrite' then 1.1::double else 1.0::double end as factor from w),
z as (select *, case when strategy = 'KeepStabilize' then greatest(base, 8.0::double) else greatest(base * factor, 40.0::double) end as raw from y),
hours as (select assessment_id, strategy, raw, round_even(raw / 10, 0) * 10 as hours from z)
"""


@query(ESTATES + HOURS + """
select assessment_id, strategy, hours, least(round_even(raw * 0.75::double / 10, 0) * 10, greatest(5.0::double, hours - 10)) as optimistic, greatest(round_even(raw * 1.5::double / 10, 0) * 10, hours + 10) as conservative,
  greatest(1.0::double, round_even(hours / 480.0::double, 1)) as months, round_even(hours * 60.0::double, 0) as cost, 'Medium' as confidence from hours
""")
def strategy_costs(spark, d):
    return modernization.costs(estates(spark, d), "assessment_id")


@query(ESTATES + HOURS + "select assessment_id, hours, round_even(hours * 60.0::double, 0) as cost from hours where strategy = 'UpgradeInPlace'")
def upgrade_cost(spark, d):
    return modernization.costs(estates(spark, d), "assessment_id").filter("strategy = 'UpgradeInPlace'").select("assessment_id", "hours", "cost")


@query(ESTATES + "select assessment_id, case when legacy > 0 then legacy * 2000.0::double + case when ef6 then 5000.0::double else 0.0::double end end as annual from q")
def annual_savings(spark, d):
    return modernization.savings(estates(spark, d), "assessment_id").select("assessment_id", "annual")


@query(ESTATES + FITS + HOURS + """
, best as (select assessment_id, strategy from clamped qualify row_number() over (partition by assessment_id order by fit desc, risk_level, place) = 1),
b as (select z.*, h.hours from z join best on z.assessment_id = best.assessment_id and z.strategy = best.strategy join hours h on h.assessment_id = z.assessment_id and h.strategy = z.strategy),
phases as (
  select assessment_id, hours, 0 as o, 'baseline' as phase, 0.04::double as weight from b
  union all select assessment_id, hours, 1, 'security', least(0.35::double, greatest(0.05::double, security / greatest(1.0::double, hours))) from b where c4 + c3 + packages > 0
  union all select assessment_id, hours, 2, 'tests', 0.15::double from b where not tests and strategy <> 'KeepStabilize'
  union all select assessment_id, hours, 3, 'foundation', case when strategy = 'UpgradeInPlace' then 0.45::double else 0.20::double end from b where strategy not in ('KeepStabilize', 'FullRewrite') and (legacy > 0 or pre > 0)
  union all select assessment_id, hours, 4, 'domain', case when strategy = 'UpgradeInPlace' then 0.20::double else 0.35::double end from b where strategy in ('Incremental', 'Strangler', 'PartialRewrite', 'FullRewrite') or (strategy = 'UpgradeInPlace' and high > 0)
  union all select assessment_id, hours, 5, 'data-integration', 0.12::double from b where (ef6 or high > 0) and strategy <> 'KeepStabilize'
  union all select assessment_id, hours, 6, 'retirement', 0.05::double from b where strategy in ('Strangler', 'PartialRewrite', 'FullRewrite')),
placed as (select *, row_number() over (partition by assessment_id order by o)::int - 1 as place, weight / sum(weight) over (partition by assessment_id) as s from phases)
select assessment_id, place, phase, round_even(s, 3) as share, round_even(hours * s / 10, 0) * 10 as hours from placed
""")
def modernization_roadmap(spark, d):
    p = estates(spark, d)
    best = modernization.strategies(p, "assessment_id").filter("recommended").join(modernization.costs(p, "assessment_id"), ["assessment_id", "strategy"]).select("assessment_id", "strategy", "hours")
    return modernization.roadmap(p, best, "assessment_id")


# Set operations


@query("select period, (a and b) as in_both from (select o_orderdate::date::varchar as period, bool_or(o_orderkey % 3 <> 0) as a, bool_or(o_orderkey % 5 = 0) as b from orders group by 1) where a or b")
def days_in_sources(spark, d):
    o = table(spark, d, "orders").withColumn("period", F.to_date("o_orderdate").cast("string"))
    both = latest.full_outer_keyed(o.filter("o_orderkey % 3 <> 0").select("period").distinct(), o.filter("o_orderkey % 5 = 0").select("period").distinct(), ["period"])
    return both.select("period", (F.col("in_left") & F.col("in_right")).alias("in_both"))


@query("select p_name from (select lower(p_name) as k, arg_min(p_name, p_partkey) as p_name from part group by 1)")
def distinct_ordered(spark, d):
    return latest.distinct_ordered(table(spark, d, "part"), "p_name", "p_partkey").select("p_name")


@query("select o_orderkey, o_orderpriority from orders order by o_orderpriority, o_orderdate desc, o_orderkey offset 40 limit 25")
def pagination(spark, d):
    return latest.page(table(spark, d, "orders"), [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")], 40, 25).select("o_orderkey", "o_orderpriority")
