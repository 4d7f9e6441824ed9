"""Latest-per-key, as-of, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Map tasks pass on one row a key (a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_value(df: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """As latest_per_key for a few columns, by a partial aggregate instead of a sort. Columns: keys and columns."""
    newest = F.max_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their place as `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def day_spine(df: DataFrame, start: Column, end: Column, step: str = "1 day", name: str = "day") -> DataFrame:
    """One row for each step from start to end, made from a one-row frame."""
    return df.select(F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias(name))


def as_of(facts: DataFrame, cuts: DataFrame, keys: list[str], at: str, cut: str, *columns: str) -> DataFrame:
    """For each key and cut, the columns of the newest fact with at <= cut.

    Facts and the cuts of each key form one table, ordered by time within the key, cuts behind facts of the same moment; a
    window carries the newest fact forward. The rows of cuts are those of the result, and the ones before a key's first fact.
    """
    row = F.struct(*columns)
    marks = facts.select(*keys).distinct().crossJoin(cuts.select(F.col(cut).alias("_at")).distinct())
    both = facts.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_cut"), row.alias("_row")).unionByName(marks.select(*keys, "_at", F.lit(1).alias("_cut"), F.lit(None).cast(facts.select(row.alias("r")).schema["r"].dataType).alias("_row")))
    w = Window.partitionBy(*keys).orderBy("_at", "_cut")
    held = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter("_cut = 1 and _row is not null")
    return held.select(*keys, F.col("_at").alias(cut), *[F.col(f"_row.{c}").alias(c) for c in columns])


def distinct_ordered(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """Distinct values regardless of case; the first spelling and its place stay."""
    first = F.min(F.struct(ordinal, value)).alias("_first")
    return df.groupBy(F.lower(value).alias("_key")).agg(first).select(F.col(f"_first.{value}").alias(value), F.col(f"_first.{ordinal}").alias(ordinal))


def full_outer_keyed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys with in_left and in_right marks."""
    return left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), keys, "full_outer").fillna(False, ["in_left", "in_right"])


def page(df: DataFrame, order: list[Column], skip: int, take: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(take)


def counter_deltas(points: DataFrame, keys: list[str], order: list[str], value: str, start: str | None = None) -> DataFrame:
    """Deltas of running counters: the rise since the last point; the whole value on first sight, when it drops, or when
    the counter's start time changes. Never below zero."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lag(value).over(w)
    fresh = last.isNull() | (F.col(value) < last)
    if start:
        fresh |= ~F.col(start).eqNullSafe(F.lag(start).over(w))
    return points.withColumn("delta", F.greatest(F.lit(0).cast(points.schema[value].dataType), F.when(fresh, F.col(value)).otherwise(F.col(value) - last)))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))
