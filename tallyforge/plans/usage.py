"""AI usage, cost, forecast, budgets and billing reconciliation. today and now are always arguments.

Usage facts: tenant_id, actor, tool, period date, model, input_tokens, output_tokens, cache_read_tokens,
cache_write_tokens, requests, sessions, estimated_cost (null: unpriced), provider, reported_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import provider_guess
from ..operators.latest import as_of
from ..operators.matching import first_pattern, wildcard_member

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def cost() -> Column:
    return F.coalesce("estimated_cost", F.lit(0))


def provider() -> Column:
    return F.coalesce(F.lower("provider"), provider_guess(F.col("model")), F.lit("unknown"))


def priced(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """facts with estimated_cost by the first price pattern (ordinal) that finds the model, null without one.

    Prices are per million tokens; cache tokens without a price of their own cost as input. Four decimals, half-even.
    """
    rates = ["input", "output", "cache_read", "cache_write"]
    df = first_pattern(facts, "model", prices, "pattern", "ordinal", *rates)
    money = lambda tokens, price: F.col(tokens).cast("decimal(16,0)") * price.cast("decimal(12,4)")
    total = money("input_tokens", F.col("input")) + money("output_tokens", F.col("output")) + money("cache_read_tokens", F.coalesce("cache_read", "input")) + money("cache_write_tokens", F.coalesce("cache_write", "input"))
    return df.withColumn("estimated_cost", F.bround(total * F.lit("0.000001").cast("decimal(7,6)"), 4).cast("decimal(18,4)")).drop(*rates)


def repriced(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """priced facts with `changed`, whether the cost differs from before (nulls equal)."""
    before = facts.withColumnRenamed("estimated_cost", "_before")
    return priced(before, prices).withColumn("changed", ~F.col("estimated_cost").eqNullSafe(F.col("_before"))).drop("_before")


def unpriced_models(facts: DataFrame) -> DataFrame:
    return facts.filter("estimated_cost is null").groupBy("model").agg(F.sum(total_tokens()).alias("tokens"), F.countDistinct("actor").alias("actors"), F.max("period").alias("last_seen"))


def merged(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates of a key as one: tokens and requests add up, sessions take the most, one unpriced part unprices all."""
    sums = [F.sum(c).alias(c) for c in (*TOKENS, "requests")]
    return facts.groupBy(*keys).agg(*sums, F.max("sessions").alias("sessions"), F.when(~F.bool_or(F.col("estimated_cost").isNull()), F.sum("estimated_cost")).alias("estimated_cost"))


#: What a fact of usage is known by, and what of it adds up.
FACT, SUMS = ["actor", "tool", "period", "model"], [*TOKENS, "requests"]


def folded(samples: DataFrame) -> DataFrame:
    """(actor, tool, period, model, the token counts, requests, sessions, reported_cost) of telemetry samples: at, actor, tool, model,
    export_id, sample, session_id, the token counts, requests, reported_cost.

    An export that comes again, told by export_id and the sample's place in it, counts once. Tokens, requests and costs add up over
    exports; sessions are the most that one export tells of, as exports repeat those still open. A cost is null where no sample has one.
    The order of exports doesn't matter. telemetry.usage_fold gives the same facts from a stream.
    """
    once = samples.withColumn("period", F.to_date("at")).dropDuplicates(["export_id", "sample"])
    per = once.groupBy(*FACT, "export_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.countDistinct("session_id").alias("sessions"), F.sum("reported_cost").alias("reported_cost"))
    return per.groupBy(*FACT).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("sessions").alias("sessions"), F.sum("reported_cost").alias("reported_cost"))


def valid_entries(facts: DataFrame, today: Column) -> DataFrame:
    """facts with `reject`, the reason an entry is refused, or null."""
    reason = F.when(F.col("period") > F.date_add(today, 1), "future").when(F.col("period") < F.date_add(today, -400), "too old").when(F.trim("model") == "", "no model").when(F.least(*TOKENS, "requests") < 0, "negative")
    return facts.withColumn("reject", reason)


def by_actor(facts: DataFrame) -> DataFrame:
    """Sessions are the day's most, added over days; hence two levels, of which the first combines in the map tasks."""
    daily = facts.groupBy("actor", "period").agg(F.collect_set("tool").alias("tools"), F.max("sessions").alias("sessions"), F.sum("requests").alias("requests"), F.sum(total_tokens()).alias("tokens"), F.sum(cost()).alias("cost"), F.sum(F.when(F.col("estimated_cost").isNull(), total_tokens()).otherwise(0)).alias("unpriced"), F.max("reported_at").alias("last_report"))
    return daily.groupBy("actor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"), F.sum("sessions").alias("sessions"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.bround(F.sum("cost"), 2).alias("estimated_cost"), F.sum("unpriced").alias("unpriced_tokens"), F.max("last_report").alias("last_report"), F.max("period").alias("last_day"))


def by_model(facts: DataFrame) -> DataFrame:
    """One unpriced row makes the model's cost null."""
    return facts.groupBy(F.lower("model").alias("model")).agg(F.sum(total_tokens()).alias("tokens"), F.when(~F.bool_or(F.col("estimated_cost").isNull()), F.bround(F.sum("estimated_cost"), 2)).alias("estimated_cost"), F.countDistinct("actor").alias("actors"))


def by_day(facts: DataFrame) -> DataFrame:
    return facts.groupBy("period").agg(F.sum(total_tokens()).alias("tokens"), F.bround(F.sum(cost()), 2).alias("estimated_cost"), F.countDistinct("actor").alias("actors"))


def by_provider(facts: DataFrame) -> DataFrame:
    return facts.groupBy(provider().alias("provider")).agg(F.sum(total_tokens()).alias("tokens"), F.bround(F.sum(cost()), 2).alias("estimated_cost"), F.sum(F.when(F.col("estimated_cost").isNull(), total_tokens()).otherwise(0)).alias("unpriced_tokens"), F.countDistinct("actor").alias("actors"), F.countDistinct(F.lower("model")).alias("models"))


def by_tool(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.lower("tool").alias("tool")).agg(F.sum(total_tokens()).alias("tokens"), F.bround(F.sum(cost()), 2).alias("estimated_cost"), F.countDistinct("actor").alias("actors"))


def by_team(facts: DataFrame, teams: DataFrame, today: Column, window_days: int = 30) -> DataFrame:
    """(team, members, tokens, estimated_cost, month_to_date, projected) with a straight-line projection of the month."""
    df = wildcard_member(facts, "actor", teams)
    start = F.trunc(today, "month")
    inside, month = (F.col("period") > F.date_add(today, -window_days)) & (F.col("period") <= today), (F.col("period") >= start) & (F.col("period") <= today)
    spent = F.sum(F.when(month, cost()).otherwise(0))
    return df.filter(inside | month).groupBy("team").agg(F.countDistinct("actor").alias("members"), F.sum(F.when(inside, total_tokens()).otherwise(0)).alias("tokens"), F.bround(F.sum(F.when(inside, cost()).otherwise(0)), 2).alias("estimated_cost"), F.bround(spent, 2).alias("month_to_date"), F.bround(spent / F.greatest(F.lit(1), F.dayofmonth(today)) * F.dayofmonth(F.last_day(today)), 2).alias("projected"))


def known_actors(facts: DataFrame, today: Column) -> DataFrame:
    return facts.filter(F.col("period") > F.date_add(today, -90)).groupBy("actor").agg(F.max("period").alias("last_day"))


def forecast(facts: DataFrame, today: str, keys: list[str], ratio: Column | None = None) -> DataFrame:
    """One row a key: month to date, straight and seasonal projections, band, averages, trend, unpriced tokens.

    Facts become one row a key and day; the 28 days before today, zero-filled, then live in one array, from which the
    medians of a weekday (over the last four weeks, middle values averaged) and the band come. Two decimals, half up.
    """
    t = F.to_date(F.lit(today))
    days, elapsed = F.dayofmonth(F.last_day(t)), F.dayofmonth(t)
    day = facts.filter(F.col("period") <= t).groupBy(*keys, "period").agg(F.sum(cost()).alias("cost"), F.sum(total_tokens()).alias("tokens"), F.sum(F.when(F.col("estimated_cost").isNull(), total_tokens()).otherwise(0)).alias("unpriced"))
    ago = F.datediff(t, F.col("period"))
    month = F.col("period") >= F.trunc(t, "month")
    sum_if = lambda c, v="cost": F.coalesce(F.sum(F.when(c, F.col(v).cast("double"))), F.lit(0.0))
    df = day.groupBy(*keys).agg(
        sum_if(month).alias("mtd"), (sum_if(ago < 7) / 7).alias("avg7"), (sum_if(ago < 30) / 30).alias("avg30"),
        F.bool_or((ago >= 7) & (ago < 30)).alias("baseline"), F.bool_or(ago >= 7).alias("history"),
        F.map_from_entries(F.collect_list(F.when(ago < 28, F.struct(ago.alias("k"), F.col("cost").cast("double").alias("v"))))).alias("_by_ago"),
        F.sum(F.when(month, F.col("tokens")).otherwise(0)).alias("month_tokens"), F.sum(F.when(month, F.col("unpriced")).otherwise(0)).alias("month_unpriced"),
    )
    df = df.withColumn("_series", F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.coalesce(F.try_element_at("_by_ago", i), F.lit(0.0))))
    # a future day d days from today has its weekday 7w - d days ago
    same = lambda d: F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda w: 7 * w - d), lambda a: (a >= 0) & (a < 28))
    values = lambda d: F.array_sort(F.transform(same(d), lambda a: F.element_at("_series", a + 1)))
    n = lambda d: F.size(same(d))
    median = lambda d: (F.element_at(values(d), F.floor((n(d) + 1) / 2).cast("int")) + F.element_at(values(d), (F.floor(n(d) / 2) + 1).cast("int"))) / 2
    left = F.when(days > elapsed, F.sequence(F.lit(1), days - elapsed)).otherwise(F.array().cast("array<int>"))
    expected = F.transform(left, lambda d: F.when((n(d) < 2) | ~F.col("history"), F.col("avg7")).otherwise(median(d)))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("seasonal", F.col("mtd") + add(expected)).withColumn("_mean", add(F.col("_series")) / 28)
    df = df.withColumn("_sd", F.sqrt(add(F.transform("_series", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))) / 27))
    rest = days - elapsed
    # by way of a decimal, so that a half of the last digit rounds up whatever its binary form
    r = lambda c: F.round(F.round(c, 6).cast("decimal(28,6)"), 2).cast("double")
    return df.select(
        *keys, r(F.col("mtd")).alias("month_to_date"), r(F.col("mtd") / elapsed * days).alias("projected"), r(F.col("seasonal")).alias("seasonal"),
        r(F.greatest(F.col("mtd"), F.col("mtd") + rest * F.greatest(F.lit(0.0), F.col("_mean") - F.col("_sd")))).alias("low"),
        r(F.greatest(F.col("mtd") + rest * (F.col("_mean") + F.col("_sd")), F.col("seasonal"))).alias("high"),
        r(F.col("avg7")).alias("avg7"), r(F.col("avg30")).alias("avg30"), r(F.col("avg7") * 30).alias("next30"),
        F.when(F.col("baseline") & (F.col("avg30") > 0), r(F.try_divide(F.col("avg7") - F.col("avg30"), "avg30") * 100)).alias("trend_pct"),
        "month_tokens", "month_unpriced",
        (r(F.col("seasonal") * ratio) if ratio is not None else F.lit(None).cast("double")).alias("calibrated"),
    )


def cumulative(facts: DataFrame, today: str) -> DataFrame:
    """(period, spent) running through every day of the month so far, days without facts included."""
    t = F.to_date(F.lit(today))
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(t, "month"), t)).alias("period"))
    day = facts.groupBy("period").agg(F.sum(cost()).alias("c"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(day, "period", "left").select("period", F.round(F.sum(F.coalesce("c", F.lit(0)).cast("double")).over(w), 2).alias("spent"))


def anomalies(facts: DataFrame, least: float = 5.0, times: float = 3.0) -> DataFrame:
    """(period, cost, median) of days that spend `least` or more and over `times` the upper median of the non-zero ones
    among the seven days before, of which there must be four."""
    day = facts.groupBy("period").agg(F.sum(cost()).cast("double").alias("cost"))
    # each day is sent to the seven days after it; days are few and meet by equality
    sent = day.filter("cost > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.date_add("period", i))).alias("period"), F.col("cost").alias("c"))
    before = sent.groupBy("period").agg(F.array_sort(F.collect_list("c")).alias("cs")).filter(F.size("cs") >= 4).select("period", F.element_at("cs", (F.floor(F.size("cs") / 2) + 1).cast("int")).alias("median"))
    return day.join(before, "period").filter((F.col("cost") >= least) & (F.col("cost") > times * F.col("median"))).select("period", "cost", "median")


def budget_status(facts: DataFrame, budgets: DataFrame, teams: DataFrame, today: str) -> DataFrame:
    """(id, spent, percent, projected, projected_percent, state) of each budget this month.

    Scopes: tenant, team, provider, model (a prefix), actor, tool. Facts are first summed by the columns that scopes
    look at; each sum is then exploded into its scope keys, which meet the budgets by equality, but for prefixes.
    """
    t = F.to_date(F.lit(today))
    month = facts.filter((F.col("period") >= F.trunc(t, "month")) & (F.col("period") <= t))
    sums = wildcard_member(month.groupBy("actor", "tool", "model", provider().alias("provider")).agg(F.sum(cost()).alias("c")), "actor", teams)
    key = lambda s, c: F.struct(F.lit(s).alias("scope"), F.lower(c).alias("scope_key"))
    scoped = sums.select("c", F.explode(F.array(key("tenant", F.lit("")), key("team", F.col("team")), key("provider", F.col("provider")), key("actor", F.col("actor")), key("tool", F.col("tool")))).alias("k")).groupBy("k.scope", "k.scope_key").agg(F.sum("c").alias("c"))
    models = sums.groupBy(F.lower("model").alias("model")).agg(F.sum("c").alias("c"))
    b = budgets.filter("enabled").withColumn("scope_key", F.coalesce(F.lower("scope_key"), F.lit("")))
    exact = b.filter("scope <> 'model'").join(scoped, ["scope", "scope_key"], "left").select("id", "monthly_amount", "c")
    prefix = b.filter("scope = 'model'").join(models, models.model.startswith(b.scope_key), "left").groupBy("id", "monthly_amount").agg(F.sum("c").alias("c"))
    spent = F.bround(F.coalesce("c", F.lit(0)), 2)
    df = exact.unionByName(prefix).withColumn("spent", spent.cast("double"))
    df = df.withColumn("projected", F.bround(F.col("spent") / F.dayofmonth(t) * F.dayofmonth(F.last_day(t)), 2))
    amount = F.col("monthly_amount").cast("double")
    df = df.withColumns({"percent": F.bround(F.col("spent") / amount * 100, 1), "projected_percent": F.bround(F.col("projected") / amount * 100, 1)})
    state = F.when(F.col("percent") >= 100, "over").when((F.col("percent") >= 80) | (F.col("projected_percent") >= 100), "warn").otherwise("ok")
    return df.select("id", "spent", "percent", "projected", "projected_percent", state.alias("state"))


def budget_alerts(status: DataFrame, raised: DataFrame, today: str, thresholds: tuple[int, ...] = (50, 80, 100)) -> DataFrame:
    """(key, id, threshold, percent) of thresholds reached that were not raised before; one for each budget and month."""
    df = status.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("percent") >= F.col("threshold"))
    df = df.withColumn("key", F.concat_ws(":", F.lit("threshold"), "id", F.lit(today[:7]), F.col("threshold").cast("string")))
    return df.join(raised.select("key"), "key", "left_anti").select("key", "id", "threshold", "percent")


def live(events: DataFrame, now: str, active_minutes: int = 60) -> DataFrame:
    """(actor, tools, last_report, active_now, tokens_today, cost_today, requests_today, tokens_last_hour) of today.

    Each (actor, tool) reports running totals; its newest row counts, less its newest row an hour ago.
    """
    t = F.to_timestamp(F.lit(now))
    todays = events.filter(F.col("period") == F.to_date(t))
    at = F.col("reported_at")
    early = at <= t - F.expr("interval 1 hour")
    per = todays.groupBy("actor", "tool").agg(F.max_by(F.struct("tokens_today", "estimated_cost_today", "requests_today"), at).alias("n"), F.max_by(F.when(early, F.col("tokens_today")), F.when(early, at)).alias("before"), F.max(at).alias("last"))
    return per.groupBy("actor").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.max("last").alias("last_report"), (F.max("last") >= t - F.expr(f"interval {active_minutes} minutes")).alias("active_now"), F.sum("n.tokens_today").alias("tokens_today"), F.bround(F.sum(F.coalesce("n.estimated_cost_today", F.lit(0))), 2).alias("cost_today"), F.sum("n.requests_today").alias("requests_today"), F.greatest(F.lit(0), F.sum("n.tokens_today") - F.sum(F.coalesce("before", F.lit(0)))).alias("tokens_last_hour"))


def live_curve(events: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """(at, tokens, cost): every `minutes` from midnight, and now, the sum of the newest report of each (actor, tool)."""
    t = F.to_timestamp(F.lit(now))
    start = F.date_trunc("day", t)
    cuts = events.sparkSession.range(1).select(F.explode(F.array_distinct(F.concat(F.filter(F.sequence(start, t, F.expr(f"interval {minutes} minutes")), lambda c: (c > start) & (c < t)), F.array(t)))).alias("at"))
    held = as_of(events.filter((F.col("period") == F.to_date(t)) & (F.col("reported_at") <= t)), cuts, ["actor", "tool"], "reported_at", "at", "tokens_today", "estimated_cost_today")
    return held.groupBy("at").agg(F.sum("tokens_today").alias("tokens"), F.bround(F.sum(F.coalesce("estimated_cost_today", F.lit(0))), 2).alias("cost"))


def reconciliation(usage: DataFrame, costs: DataFrame, least_days: int = 7) -> DataFrame:
    """(provider, estimated, reported, overlap_days, only_estimated, only_reported, ratio, usable, est_overlap, rep_overlap).

    usage and costs are summed by provider and day and meet in one full outer join; ratio is reported over estimated
    on the days that both have, three decimals, and usable from least_days days on.
    """
    est = usage.filter("estimated_cost is not null").groupBy(provider().alias("provider"), "period").agg(F.sum("estimated_cost").cast("double").alias("est"))
    rep = costs.filter("basis = 'provider-reported'").groupBy(F.lower("provider").alias("provider"), "period").agg(F.sum("amount").cast("double").alias("rep"))
    both = F.col("est").isNotNull() & F.col("rep").isNotNull()
    per = est.join(rep, ["provider", "period"], "full_outer").groupBy("provider").agg(
        F.bround(F.sum(F.coalesce("est", F.lit(0.0))), 2).alias("estimated"), F.bround(F.sum(F.coalesce("rep", F.lit(0.0))), 2).alias("reported"),
        F.count_if(both).alias("overlap_days"), F.count_if(F.col("rep").isNull()).alias("only_estimated"), F.count_if(F.col("est").isNull()).alias("only_reported"),
        F.coalesce(F.sum(F.when(both, F.col("est"))), F.lit(0.0)).alias("eo"), F.coalesce(F.sum(F.when(both, F.col("rep"))), F.lit(0.0)).alias("ro"),
    )
    ratio = F.when((F.col("overlap_days") > 0) & (F.col("eo") > 0), F.bround(F.try_divide("ro", "eo"), 3))
    per = per.withColumn("ratio", ratio)
    usable = F.coalesce((F.col("overlap_days") >= least_days) & (F.col("ratio") > 0), F.lit(False))
    return per.select("provider", "estimated", "reported", "overlap_days", "only_estimated", "only_reported", "ratio", usable.alias("usable"), F.bround("eo", 2).alias("est_overlap"), F.bround("ro", 2).alias("rep_overlap"))


def blended_ratio(reconciled: DataFrame) -> DataFrame:
    """One row: the ratio over usable providers, null without any."""
    return reconciled.filter("usable").agg(F.bround(F.try_divide(F.sum("rep_overlap"), F.sum("est_overlap")), 3).alias("ratio"))


def cost_summary(costs: DataFrame, details: int = 8) -> DataFrame:
    """(provider, basis, currency, amount, details): bases and currencies never mix; the largest detail keys as an array."""
    keys = ["provider", "basis", "currency"]
    per = costs.groupBy(*keys, "dimension_key").agg(F.sum("amount").alias("amount"))
    w = Window.partitionBy(*keys).orderBy(F.desc("amount"), "dimension_key")
    top = per.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= details).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dimension_key", "amount"))), lambda x: F.struct(x["dimension_key"], x["amount"])).alias("details"))
    return per.groupBy(*keys).agg(F.bround(F.sum("amount"), 2).alias("amount")).join(top, keys)


def seat_summary(seats: DataFrame, now: Column) -> DataFrame:
    """(provider, total, active, idle, pending, plan): idle is no activity for 60 days or none known; plan the commonest."""
    idle = F.col("last_activity_at").isNull() | (F.col("last_activity_at") < now - F.expr("interval 60 days"))
    return seats.groupBy("provider").agg(F.count(F.lit(1)).alias("total"), F.count_if(~idle).alias("active"), F.count_if(idle).alias("idle"), F.count_if("pending_cancellation").alias("pending"), F.mode("plan", True).alias("plan"))


def activity_average(costs: DataFrame) -> DataFrame:
    return costs.filter("quantity is not null").groupBy("provider", "dimension_key").agg(F.avg("quantity").alias("average"))


def feedback(votes: DataFrame) -> DataFrame:
    """(kind, model, up, down, helpful)."""
    return votes.groupBy("kind", "model").agg(F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down")).withColumn("helpful", F.try_divide("up", F.col("up") + F.col("down")))
