"""Runs, triage, usage and manifests on the driver's tables, each with the SQL that gives the same rows.

As in queries: nations stand in for assessments, orders for findings, years for runs, events for telemetry, lines of an order for a
nested lockfile.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import findings as fnd
from .operators import graph
from .plans import health, portfolio, usage
from .portfolio_queries import KEY, nations
from .queries import FINDINGS, POINTS, RUNS, order_findings, query, runs, table
from .rules import duplication, estate_rules
from .sources import manifests


def _pick(items: list, at):
    return F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))


@query()
def copied_blocks(spark, d):
    """No SQL: the fold that ends a block where no common file is left is tested against a plain walk."""
    b = duplication.copied_blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return b.withColumns({"doc_id": F.col("doc"), "others": F.to_json("others")}).drop("doc")


def _health_sql(name: str, source: str) -> str:
    """CTEs that end in `name`: health of every nation from the findings in `source`."""
    part = lambda c: f"sum(case when category = '{c}' then {POINTS} else 0 end)::bigint"
    score = lambda p: f"round_even(greatest(0.0, 100 - least(100.0, {p} * scale)), 0)::int"
    return f"""
{name}_s as (select assessment_id, {part('Security')} as ps, {part('Modernization')} as pm, {part('Quality')} as pq from {source} where status in ('Open', 'Regressed') group by 1),
{name}_x as (select n_name as assessment_id, n_nationkey as k, n_regionkey as region, 10.0::double / greatest(10, 20 * n_nationkey + 10) as scale, coalesce(ps, 0) as ps, coalesce(pm, 0) as pm, coalesce(pq, 0) as pq
  from nation left join {name}_s on n_name = assessment_id),
{name}_y as (select *, {score('ps')} as s, {score('pm')} as m, {score('pq')} as q from {name}_x),
{name} as (select assessment_id, k, region, s as score_security, m as score_modernization, q as score_quality,
  round_even(round(s * 0.30::double + m * 0.25::double + 100 * 0.15::double + 100 * 0.15::double + q * 0.15::double, 6), 0)::int as score from {name}_y)"""


@query(f"""
with {FINDINGS}, g as (select f.* replace (case when id % 3 = 0 then 'FalsePositive' else status end as status) from f),
{_health_sql('before', 'f')}, {_health_sql('after', 'g')}
select assessment_id, 1::bigint as run_id, 'c' || k as commit, score, score_security, score_modernization, score_quality from before
union all select assessment_id, null, 'c' || k, score, score_security, score_modernization, score_quality from after where region = 2
""")
def health_after_triage(spark, d):
    """Decisions on findings of one region's nations: only those get a new snapshot, of no run."""
    f = order_findings(spark, d)
    n = nations(spark, d)
    projects = n.select(KEY, (F.col("k") * 20 + 10).alias("project_count"))
    first = health.health(f.filter(F.col("status").isin(health.OPEN)), projects, KEY).join(n, KEY)
    snapshots = first.select("*", F.lit(1).cast("long").alias("run_id"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("commit"), F.expr("timestamp_ntz '1998-01-01'").alias("taken_at")).drop("k")
    asia = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias(KEY))
    decisions = f.filter("id % 3 = 0").join(asia, KEY).select("id", KEY)
    triaged = f.join(decisions.select("id", F.lit("FalsePositive").alias("decided")), "id", "left").withColumn("status", F.coalesce("decided", "status"))
    out = health.refreshed(snapshots, triaged, projects, decisions, KEY, F.expr("timestamp_ntz '1998-02-01'"))
    return out.select(KEY, "run_id", "commit", "score", "score_security", "score_modernization", "score_quality")


@query("""
with p as (select n_name as k, count(*) as projects, sum(c_acctbal)::decimal(18, 2)::double as balance, (count(*) filter (c_mktsegment = 'BUILDING'))::double as building from customer join nation on c_nationkey = n_nationkey group by 1),
u as (select k, unnest(['projects', 'balance', 'building']) as metric, unnest([projects::double, balance, building]) as v from p)
select metric, max(case when k = 'NATION_1' then v end) as value_a, max(case when k = 'NATION_2' then v end) as value_b, round(max(case when k = 'NATION_2' then v end) - max(case when k = 'NATION_1' then v end), 2) as delta
from u where k in ('NATION_1', 'NATION_2') group by 1
""")
def assessment_comparison(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy(F.col("n_name").alias("k")).agg(F.count(F.lit(1)).alias("projects"), F.sum("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))
    return health.side_by_side(p, "k", "NATION_1", "NATION_2").withColumn("delta", F.round("delta", 2))


_TOUCHED = f"""
{FINDINGS},
t as (select *, year(seen_at)::varchar as first_seen, case when id % 4 <> 0 then '1997' else '1998' end as last_seen, case when id % 5 = 0 then (1992 + id % 7)::varchar end as resolved,
  case when id % 6 = 0 then null else file end as path, case when id % 12 = 0 then '' when id % 6 = 0 then 'S' || id % 9 else 'x' end as symbol, id % 40 as line from f)
"""


def _touched(spark, d):
    f = order_findings(spark, d).withColumnRenamed("file", "path_")
    return f.select(
        "rule_id",
        "category",
        "severity",
        "status",
        F.year("seen_at").cast("string").alias("first_seen_scan_id"),
        F.when(F.col("id") % 4 != 0, "1997").otherwise("1998").alias("last_seen_scan_id"),
        F.when(F.col("id") % 5 == 0, (F.col("id") % 7 + 1992).cast("string")).alias("resolved_scan_id"),
        F.when(F.col("id") % 6 != 0, F.col("path_")).alias("file"),
        (F.col("id") % 40).alias("line"),
        F.when(F.col("id") % 12 == 0, "").when(F.col("id") % 6 == 0, F.concat(F.lit("S"), (F.col("id") % 9).cast("string"))).otherwise("x").alias("symbol"),
    )


@query(f"""
with {_TOUCHED},
e as (select 'new' as kind, * from t where first_seen = '1997' union all select 'resolved', * from t where resolved = '1997'
      union all select 'regressed', * from t where status = 'Regressed' and last_seen = '1997' and first_seen <> '1997'),
w as (select *, nullif(case when path is null then symbol else path || ':' || line end, '') as place from e),
r as (select kind, rule_id, place, row_number() over (partition by kind, rule_id order by place) as r from (select distinct kind, rule_id, place from w where place is not null)),
l as (select kind, rule_id, string_agg(place, ',' order by place) as locations from r where r <= 5 group by all)
select w.kind, w.rule_id, min(category) as category, max(severity) as max_severity, count(*) as n, coalesce(any_value(l.locations), '') as locations from w left join l on l.kind = w.kind and l.rule_id = w.rule_id group by all
""")
def run_rule_deltas(spark, d):
    return health.rule_deltas(_touched(spark, d), ["1997"]).withColumn("locations", F.array_join("locations", ","))


@query(f"""
with {_TOUCHED}
select severity, count(*) filter (first_seen in ('1996', '1997')) as n_new, count(*) filter (status = 'Regressed' and last_seen in ('1996', '1997') and first_seen not in ('1996', '1997')) as n_regressed
from t group by 1 having n_new + n_regressed > 0
""")
def run_severity_deltas(spark, d):
    return health.severity_deltas(_touched(spark, d), ["1996", "1997"])


_SCORES = ["score", *[f"score_{n.lower()}" for n, _, _ in health.DIMENSIONS]]


@query(f"""
with r as (select o_custkey as k, o_orderkey as run, row_number() over (partition by o_custkey order by o_orderkey desc) as r, {', '.join(f'(o_orderkey * {i + 3} % 101)::int as {c}' for i, c in enumerate(_SCORES))} from orders),
l as (unpivot (select * from r where r <= 2) on {', '.join(_SCORES)} into name dimension value v)
select k, case dimension when 'score' then 'Overall' else upper(dimension[7:7]) || dimension[8:] end as dimension, max(case when r = 2 then v end) as before, max(case when r = 1 then v end) as after,
  max(case when r = 1 then v end) - max(case when r = 2 then v end) as delta from l group by 1, 2
""")
def run_dimension_deltas(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("run"), *[(F.col("o_orderkey") * (i + 3) % 101).cast("int").alias(c) for i, c in enumerate(_SCORES)])
    return health.dimension_deltas(o, "k")


@query("""
with s as (select o_custkey as k, year(o_orderdate) as run, sum(o_orderkey)::bigint as lines, sum(o_orderkey % 9)::bigint as files, sum(o_orderkey % 2)::bigint as projects from orders group by all),
r as (select *, row_number() over (partition by k order by run desc) as r, count(*) over (partition by k) as n from s)
select k, max(case when r = 2 then lines end) as lines_before, max(case when r = 1 then lines end) as lines_after, max(case when r = 2 then files end) as files_before, max(case when r = 1 then files end) as files_after,
  max(case when r = 2 then projects end) as projects_before, max(case when r = 1 then projects end) as projects_after from r where n > 1 group by 1
""")
def run_inventory_deltas(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("run"), F.col("o_orderkey").alias("lines"), (F.col("o_orderkey") % 9).alias("files"), (F.col("o_orderkey") % 2).alias("projects"))
    return health.inventory_deltas(o, "k")


@query("""
with s as (select ts::date as period, 'user-' || user_id as actor, event_type as tool, 'm' || event_id % 3 as model, event_id // 50 as export_id, case when event_id % 4 <> 0 then 's' || event_id % 6 end as session,
  round(value * 100)::bigint as i, event_id % 7 as o, event_id % 2 as r, case when event_id % 5 = 0 then event_id % 90 end as c from events),
e as (select actor, tool, period, model, export_id, sum(i) as i, sum(o) as o, sum(r) as r, count(distinct session) as s, sum(c) as c from s group by all)
select actor, tool, period::varchar as period, model, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, sum(r)::bigint as requests, max(s) as sessions, sum(c)::double as reported_cost from e group by all
""")
def telemetry_fold(spark, d):
    """Every export comes once, and every third one again."""
    e = table(spark, d, "events")
    sample = e.select(
        F.col("ts").alias("at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("tool"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.floor(F.col("event_id") / 50).cast("string").alias("export_id"),
        (F.col("event_id") % 50).alias("sample"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string"))).alias("session_id"),
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"),
        (F.col("event_id") % 7).alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_read_tokens"),
        F.lit(0).cast("long").alias("cache_write_tokens"),
        (F.col("event_id") % 2).alias("requests"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 90).cast("double")).alias("reported_cost"),
    )
    again = sample.unionByName(sample.filter("export_id % 3 = 0"))
    return usage.folded(again).withColumn("period", F.col("period").cast("string")).drop("cache_read_tokens", "cache_write_tokens")


@query("""
with m as (select o_orderkey as k, o_orderkey % 4 as av, o_orderkey % 3 as pr, o_orderkey % 2 as ui, o_custkey % 3 as c, (o_orderkey // 4) % 3 as i, (o_orderkey // 12) % 4 as a from orders),
s as (select *, c + i + least(a, 2) as impact from m)
select k, case when c + i + a = 0 and k % 10 = 0 then null when impact >= 5 and av = 0 and pr = 0 and ui = 0 then 9.5 when impact >= 4 and av = 0 then 8.0 when impact >= 3 then 6.5 when impact >= 1 then 4.0 else 1.0 end::double as score from s
""")
def cvss_v4_scores(spark, d):
    """Vectors whose metrics follow from the keys; where no impact is given at all there is no score."""
    o, level = F.col("o_orderkey"), lambda at: _pick(["N", "L", "H"], at)
    impacts = [F.col("o_custkey") % 3, F.floor(o / 4) % 3, F.least(F.floor(o / 12) % 4, F.lit(2))]
    bare = (impacts[0] + impacts[1] + F.floor(o / 12) % 4 == 0) & (o % 10 == 0)
    given = F.concat(F.lit("/VC:"), level(impacts[0]), F.lit("/VI:"), level(impacts[1]), F.lit("/VA:"), level(impacts[2]))
    vector = F.concat(F.lit("CVSS:4.0/AV:"), _pick(["N", "A", "L", "P"], o % 4), F.lit("/AC:L/AT:N/PR:"), _pick(["N", "L", "H"], o % 3), F.lit("/UI:"), _pick(["N", "P"], o % 2), F.when(bare, "").otherwise(given))
    return table(spark, d, "orders").select(o.alias("k"), scalar.cvss_score(vector).alias("score"))


@query("""
select l_orderkey || '/package-lock.json' as path, 'part-' || l_partkey as name, (l_linenumber || '.' || l_suppkey % 3) as version, bool_and(l_returnflag = 'R') as is_dev from lineitem group by all
""")
def lockfile_depths(spark, d):
    """Each order's lines as a lockfile of version 1, every line nested in the one before it."""
    one = F.struct("l_linenumber", F.concat(F.lit('"Part-'), F.col("l_partkey").cast("string"), F.lit('":{"version":"'), F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 3).cast("string")), F.lit('","dev":'), (F.col("l_returnflag") == "R").cast("string")).alias("head"))
    lines = F.sort_array(F.collect_list(one), asc=False)
    nested = F.aggregate(lines, F.lit(""), lambda inner, x: F.concat(F.lit(',"dependencies":{'), x["head"], inner, F.lit("}}")))
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(nested.alias("inner"))
    content = F.concat(F.lit('{"lockfileVersion":1'), "inner", F.lit("}"))
    return manifests.npm_packages(files.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/package-lock.json")).alias("path"), content.alias("content")))


_ESTATE = """
s as (select n_name as k, s_suppkey, s_suppkey % 4 as kind, s_suppkey % 3 as approved from supplier join nation on s_nationkey = n_nationkey),
p as (select k, 'p' || s_suppkey % 7 as id, min(kind) as kind from s group by all),
c as (select n_name as k, n_nationkey as nk from nation),
held as (select c.k, nk, (select count(*) from p where p.k = c.k) as np from c where nk % 9 <> 8),
kept as (select * from held where np > 0 or nk % 5 > 0 or nk % 2 = 0)
"""


def _estate(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = s.groupBy(F.col("n_name").alias("k"), F.concat(F.lit("p"), (F.col("s_suppkey") % 7).cast("string")).alias("id")).agg(F.min(F.col("s_suppkey") % 4).alias("kind"))
    kind = F.when(F.col("kind") == 0, "external-api").when(F.col("kind") == 1, "gateway").otherwise("local-runtime")
    listed = p.groupBy("k").agg(F.collect_list(F.struct("id", F.concat(F.lit("Name "), "id").alias("name"), kind.alias("kind"))).alias("providers"))
    nk = F.col("n_nationkey")
    server = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.lit("x").alias("name"), (i == 1).alias("remote")))
    c = table(spark, d, "nation").join(listed, F.col("n_name") == F.col("k"), "left").select(
        F.col("n_name").alias("k"),
        F.to_json(F.struct(
            F.coalesce("providers", F.array().cast("array<struct<id:string,name:string,kind:string>>")).alias("providers"),
            F.when(nk % 2 == 0, F.array(F.struct(F.lit("LangKit").alias("name")))).alias("frameworks"),
            F.slice(server, 1, (nk % 5).cast("int")).alias("mcp"),
            (nk % 5).alias("secretsInMcp"),
            F.struct(F.slice(F.array(F.struct(F.lit("old").alias("model"))), 1, (nk % 2).cast("int")).alias("retired")).alias("models"),
            F.struct((nk % 3 == 0).alias("configured"), F.when(nk % 3 == 0, F.array(F.lit("p1"), F.lit("p2"))).alias("unapproved")).alias("allowlist"),
        )).alias("estate"),
        nk.alias("nk"),
    )
    data = F.when(F.col("nk") % 9 == 8, F.lit('{"estateJson": 7}')).otherwise(F.to_json(F.struct(F.col("estate").alias("estateJson"))))
    records = estate_rules.estate_records(c.select("k", data.alias("data")), "k")
    f = order_findings(spark, d).filter("status <> 'Resolved'").groupBy(F.col(KEY).alias("k"), "rule_id", "category").agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("rule_id") == "building", "privacy.pii.contact").when(F.col("rule_id") == "machinery", "ai.mcp.secret-in-config").otherwise(F.col("rule_id"))
    open_ = f.select("k", rule.alias("rule_id"), F.when(F.col("category") == "Security", "Secrets").otherwise(F.col("category")).alias("category"), "n")
    return records, estate_rules.estate_rows(records, open_, "k")


_MARKS = f"""
{FINDINGS}, o as (select assessment_id as k, bool_or(rule_id = 'building') as pii, bool_or(category = 'Security' and rule_id not in ('machinery')) as leaks from f where status <> 'Resolved' group by 1),
{_ESTATE},
m as (select kept.*, coalesce((select bool_or(kind = 0) from p where p.k = kept.k), false) as external, coalesce(pii, false) as pii, coalesce(leaks, false) as leaks from kept left join o on o.k = kept.k)
"""


@query(f"""
with {_MARKS}
select m.k, coalesce((select string_agg('Name ' || id, ',' order by id) from p where p.k = m.k), '') as providers, case when nk % 2 = 0 then 'LangKit' else '' end as frameworks, nk % 5 as mcp,
  case when nk % 3 = 0 then 2 else 0 end as unapproved, nk % 2 as retired, (nk % 5)::bigint as secrets_in_mcp, external and pii as pii_co_located, external and leaks as secrets_co_located from m
""")
def ai_estate_rows(spark, d):
    return _estate(spark, d)[1].withColumns({c: F.array_join(c, ",") for c in ("providers", "frameworks")})


@query(f"""
with {_MARKS},
u as (
  select 'count' as section, 'with_ai' as item, count(*)::bigint as value, null as detail from m union all select 'count', 'mcp', sum(nk % 5), null from m union all select 'count', 'remote_mcp', count(*) filter (nk % 5 > 0), null from m
  union all select 'count', 'secrets_in_mcp', sum(nk % 5), null from m union all select 'count', 'retired', sum(nk % 2), null from m union all select 'count', 'allowlist', max((nk % 3 = 0)::int), null from m
  union all select 'count', 'scanned', count(*), null from held union all select 'count', 'ai_with_pii', count(*) filter (external and pii), null from m union all select 'count', 'ai_with_secrets', count(*) filter (external and leaks), null from m
  union all select 'provider', id, count(*), min(case kind when 0 then 'external-api' when 1 then 'gateway' else 'local-runtime' end) from p where k in (select k from m) group by id
  union all select 'framework', 'LangKit', count(*), null from m where nk % 2 = 0 having count(*) > 0
  union all select 'unapproved', x, count(*), null from m, (select unnest(['p1', 'p2']) as x) where nk % 3 = 0 group by x)
select section, item, value::bigint as value, detail from u
""")
def ai_estate_totals(spark, d):
    return estate_rules.estate_totals(*_estate(spark, d))


@query("""
with a as (select n_name as assessment_id, n_nationkey as k, case when n_nationkey % 6 <> 0 then n_nationkey * 4 end as score from nation),
c as (select c_nationkey as k, count(*) as projects, count(*) filter (c_custkey % 3 = 0) as legacy_projects, sum(c_custkey)::bigint as lines from customer group by 1),
r as (select assessment_id, round_even((rank() over (order by score) - 1 + count(*) over (partition by score) / 2.0::double) * 100.0::double / count(*) over (), 0)::int as percentile from a where score is not null)
select a.assessment_id, score, coalesce(lines, 0) as lines, coalesce(projects, 0) as projects, coalesce(legacy_projects, 0) as legacy_projects, percentile from a left join c on a.k = c.k left join r on r.assessment_id = a.assessment_id
""")
def portfolio_rows(spark, d):
    n = nations(spark, d)
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("k"))
    projects = c.select(KEY, F.when(F.col("c_custkey") % 3 == 0, "net48").otherwise("net9.0").alias("target_framework"))
    return portfolio.rows(n.select(KEY, F.when(F.col("k") % 6 != 0, F.col("k") * 4).alias("score")), projects, c.select(KEY, F.col("c_custkey").alias("lines")), KEY)


@query("""
with s as (select 'Overall' as dimension, (o_orderkey % 101)::int as v from orders union all select 'Security', (o_custkey % 97)::int from orders union all select 'Quality', case when o_orderkey % 3 <> 0 then (o_orderkey % 89)::int end from orders)
select dimension, count(*) as n, round_even(quantile_cont(v, 0.25), 1) as p25, round_even(quantile_cont(v, 0.5), 1) as p50, round_even(quantile_cont(v, 0.75), 1) as p75, max(v) as best, min(v) as worst from s where v is not null group by 1
""")
def portfolio_benchmark(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 101).cast("int").alias("score"), (F.col("o_custkey") % 97).cast("int").alias("score_security"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 89).cast("int")).alias("score_quality"))
    return portfolio.dimension_benchmark(o, ["Security", "Quality"])


@query(f"""
with {RUNS}, n as (select assessment_id, finished_at, case when open_findings % 7 <> 6 then health_score end as health_score, open_findings, health_score * 3 % 101 as q from r where finished_at < timestamp '1998-03-01'),
cuts as (select day, day + interval 1 day - interval 1 microsecond as cut from (select (date '1998-02-03' - (i * 7)::int)::timestamp as day from range(0, 104) t(i)) where day >= (select min(finished_at)::date from n)),
h as (select day, assessment_id, arg_max(coalesce(health_score, -1), finished_at) as s, arg_max(open_findings, finished_at) as o, arg_max(q, finished_at) as q from cuts join n on finished_at <= cut group by all)
select day::date::varchar as day, round_even(avg(s) filter (s >= 0), 1) as average_score, sum(o)::bigint as open_findings, count(*) filter (s >= 0) as assessed, round_even(avg(q), 1) as average_quality from h group by 1
""")
def portfolio_trend_sampled(spark, d):
    """Two years, a week apart."""
    r = runs(spark, d).withColumns({"finished_at": F.col("finished_at").cast("timestamp_ntz"), "score_quality": F.col("health_score") * 3 % 101, "health_score": F.when(F.col("open_findings") % 7 != 6, F.col("health_score"))})
    return health.sampled_trend(r.filter("finished_at < timestamp_ntz '1998-03-01'"), F.expr("date '1998-02-03'"), 500).withColumn("day", F.col("day").cast("string"))


# Findings as keyed state


@query("""
with d as (select o_orderkey as id, (['suppress', 'false-positive', 'reopen'])[x.i + 1] as action, x.i as n from orders, (select unnest([0, 1, 2]) as i) x where (o_orderkey + x.i) % 4 = 0),
l as (select id, arg_max(action, n) as action from d group by 1),
s as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'Suppressed' when o_orderkey % 3 = 1 then 'Open' else 'Resolved' end as status from orders)
select s.id, case action when 'suppress' then 'Suppressed' when 'false-positive' then 'FalsePositive' when 'reopen' then case when status = 'Suppressed' then 'Open' else status end else status end as status from s left join l on s.id = l.id
""")
def triaged_findings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fingerprint"))
    f = o.withColumn("status", _pick(["Suppressed", "Open", "Resolved"], F.col("fingerprint") % 3))
    made = o.select("fingerprint", F.inline(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(i + 1).alias("at"), F.lit(i).alias("i")) for i, a in enumerate(["suppress", "false-positive", "reopen"])]))).filter("(fingerprint + i) % 4 = 0")
    return fnd.triage(f, made.select("fingerprint", "action", "at")).select(F.col("fingerprint").alias("id"), "status")


@query("""
with w as (select o_custkey as f, o_orderkey as c, o_orderdate as e from orders where o_orderkey % 5 <> 0), n as (select f, arg_max(e, c) as e from w group by 1)
select c_custkey as id, case when e < timestamp '1996-01-01' and c_custkey % 3 in (0, 1) then 'Open' else (['Suppressed', 'FalsePositive', 'Resolved'])[c_custkey % 3 + 1] end as status from customer left join n on f = c_custkey
""")
def waivers_expired(spark, d):
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("fingerprint"), _pick(["Suppressed", "FalsePositive", "Resolved"], F.col("c_custkey") % 3).alias("status"))
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("created_at"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).alias("revoked_at"))
    return fnd.expired_waivers(f, w, F.expr("timestamp_ntz '1996-01-01'")).select(F.col("fingerprint").alias("id"), "status")


@query("""
with w as (select o_custkey as p, o_orderkey as c, case when o_orderkey % 4 <> 0 then o_orderdate end as e, 'r' || o_orderkey as reason from orders where o_orderkey % 5 <> 0),
n as (select p, arg_max(reason, c) as reason, arg_max(case when e is null then timestamp '9999-01-01' else e end, c) as e from w group by 1)
select c_custkey as id, reason from customer join n on p = c_custkey + 1 where c_custkey % 2 = 0 and c_custkey % 3 < 2 and e > timestamp '1996-01-01'
""")
def waivers_migrated(spark, d):
    c = F.col("c_custkey")
    f = table(spark, d, "customer").select(c.alias("fingerprint"), _pick(["Open", "Regressed", "Resolved"], c % 3).alias("status"), F.when(c % 2 == 0, c + 1).alias("predecessor"))
    o = F.col("o_orderkey")
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("fingerprint"), o.alias("created_at"), F.when(o % 4 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("expires_at"), F.concat(F.lit("r"), o.cast("string")).alias("reason"), F.when(o % 5 == 0, F.lit(1)).alias("revoked_at"))
    return fnd.migrated_waivers(f, w, F.expr("timestamp_ntz '1996-01-01'")).select(F.col("fingerprint").alias("id"), "reason")


@query("""
select c_custkey as id, max_by(o_orderkey, o_orderkey) as occurrence from customer left join orders on o_custkey = c_custkey group by 1
""")
def latest_occurrences(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("finding_id"), F.col("o_orderkey").cast("string").alias("message"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.col("o_orderkey").alias("created_at"))
    return fnd.with_latest_occurrence(c, o).select("id", F.col("occurrence.message").cast("long").alias("occurrence"))


@query(f"with {FINDINGS} select id, case rule_id when 'building' then 4 when 'machinery' then 0 else severity end as severity from f")
def severity_overrides(spark, d):
    o = spark.createDataFrame([("building", 4), ("machinery", 0)], "rule_id string, severity int")
    return fnd.apply_overrides(order_findings(spark, d), o).select("id", "severity")


@query(f"with {FINDINGS} select id from f where rule_id not in (select lower(c_mktsegment) from customer where c_custkey % 5 = 0 and c_mktsegment < 'G')")
def undeclared_candidates(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 5 = 0 and c_mktsegment < 'G'").select(F.lower("c_mktsegment").alias("rule_id")).distinct()
    return fnd.undeclared(order_findings(spark, d), known).select("id")


@query(f"with {FINDINGS} select id from f where severity = 3 and status = 'Open' and (file ilike '%ACHIN%' or rule_id ilike '%ACHIN%')")
def finding_search(spark, d):
    return fnd.search(order_findings(spark, d).withColumnRenamed("file", "title"), severity=3, status="Open", text="ACHIN").select("id")


@query("""
select n_name as assessment_id from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_suppkey % 3 = 0)
  or exists (select 1 from supplier where s_nationkey = n_nationkey and s_suppkey % 3 = 0 and s_suppkey % 4 = 1)
""")
def shared_assessments(spark, d):
    n = table(spark, d, "nation")
    shares = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias(KEY), F.concat(F.lit("u"), (F.col("s_suppkey") % 4).cast("string")).alias("subject"))
    return fnd.shared_with(n.select(F.col("n_name").alias(KEY)), shares, "u1")


@query("select l_suppkey % 20 as src, l_partkey % 20 as dst, sum(l_linenumber)::bigint as weight from lineitem group by all")
def namespace_edges(spark, d):
    return graph.merged_edges(table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.col("l_linenumber").cast("long").alias("weight")))


# Usage


@query("""
with s as (select o_orderpriority as provider, case when o_orderkey % 6 <> 0 then o_orderdate end as seen, o_orderkey % 10 = 0 as pending, o_orderstatus as plan from orders)
select provider, count(*) as total, count(*) filter (seen >= timestamp '1996-06-01' - interval 60 day) as active, count(*) filter (seen is null or seen < timestamp '1996-06-01' - interval 60 day) as idle, count(*) filter (pending) as pending,
  (select plan from s t where t.provider = s.provider group by plan order by count(*) desc, plan limit 1) as plan from s group by provider
""")
def seats_by_provider(spark, d):
    o = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.when(o % 6 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("last_activity_at"), (o % 10 == 0).alias("pending_cancellation"), F.col("o_orderstatus").alias("plan"))
    return usage.seat_summary(s, F.expr("timestamp_ntz '1996-06-01'"))


@query("""
select o_orderpriority as provider, o_orderstatus as dimension_key, avg(case when o_orderkey % 4 <> 0 then (o_orderkey % 50)::double end) as average from orders where o_orderkey % 4 <> 0 group by all
""")
def activity_averages(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("dimension_key"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 50).cast("double")).alias("quantity"))
    return usage.activity_average(c)


@query("""
with v as (select event_type as kind, 'm' || user_id % 5 as model, event_id % 5 - 2 as vote from events)
select kind, model, count(*) filter (vote > 0) as up, count(*) filter (vote < 0) as down, count(*) filter (vote > 0)::double / nullif(count(*) filter (vote <> 0), 0) as helpful from v group by all
""")
def feedback_votes(spark, d):
    v = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), (F.col("event_id") % 5 - 2).alias("vote"))
    return usage.feedback(v)


@query("""
with u as (select user_id % 40 as actor, ts::date as period, event_type as model, round(value)::bigint as i, event_id % 3 as s, case when event_id % 20 <> 0 then (event_id % 100)::decimal(18, 2) end as c from events)
select actor, period::varchar as period, model, sum(i)::bigint as input_tokens, count(*) as requests, max(s) as sessions, case when count(*) = count(c) then sum(c)::double end as estimated_cost from u group by all
""")
def merged_usage(spark, d):
    zero = F.lit(0).cast("long")
    e = F.col("event_id")
    u = table(spark, d, "events").select((F.col("user_id") % 40).alias("actor"), F.to_date("ts").alias("period"), F.col("event_type").alias("model"), F.round("value").cast("long").alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens"), F.lit(1).cast("long").alias("requests"), (e % 3).alias("sessions"), F.when(e % 20 != 0, (e % 100).cast("decimal(18,2)")).alias("estimated_cost"))
    out = usage.merged(u, ["actor", "period", "model"])
    return out.select("actor", F.col("period").cast("string").alias("period"), "model", "input_tokens", "requests", "sessions", F.col("estimated_cost").cast("double").alias("estimated_cost"))
