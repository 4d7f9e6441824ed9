"""Joins on patterns, prefixes and ranges. The rule side is a small table of rules; facts are matched by distinct value first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_pattern(facts: DataFrame, value: str, rules: DataFrame, pattern: str, ordinal: str, *columns: str) -> DataFrame:
    """facts with the columns of the first rule (by ordinal) whose regular expression finds the value; null if none does.

    Only distinct values meet the rules, so the pattern join grows with the vocabulary and not with the facts.
    """
    values = facts.select(value).distinct()
    hit = values.join(rules, F.rlike(F.col(value), F.col(pattern))).groupBy(value).agg(F.min_by(F.struct(*columns), ordinal).alias("_hit"))
    return facts.join(hit, value, "left").select(*facts.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns])


def longest_prefix(facts: DataFrame, path: str, owners: DataFrame, folder: str) -> DataFrame:
    """facts with the deepest owner folder that holds the path ('' owns everything).

    A path's ancestors are exploded and joined by equality, so no prefix comparison crosses the two sides.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    paths = facts.select(path).distinct().withColumn("_folder", F.explode(ancestors))
    owned = paths.join(owners.select(F.col(folder).alias("_folder")).distinct(), "_folder").groupBy(path).agg(F.max_by("_folder", F.length("_folder")).alias(folder))
    return facts.join(owned, path, "left")


def unmatched(facts: DataFrame, value: str, policies: DataFrame, pattern: str) -> DataFrame:
    """facts that no policy pattern finds."""
    hit = facts.select(value).distinct().join(policies, F.rlike(F.col(value), F.col(pattern)), "left_semi")
    return facts.join(hit, value, "left_anti")


def in_ranges(facts: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str) -> DataFrame:
    """facts with each range of the same key that holds the value: low <= value < high, a null bound being open."""
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return facts.join(ranges, key).filter(inside)


def wildcard_member(facts: DataFrame, actor: str, teams: DataFrame) -> DataFrame:
    """facts with the first team (name, members, ordinal) that has the actor; members may hold *; '(unassigned)' if none."""
    quoted = F.regexp_replace("member", r"([.^$+?()\[\]{}|\\])", r"\\$1")
    rules = teams.select("name", "ordinal", F.explode("members").alias("member")).withColumn("_pattern", F.concat(F.lit("(?i)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$")))
    return first_pattern(facts, actor, rules, "_pattern", "ordinal", "name").withColumn("team", F.coalesce("name", F.lit("(unassigned)"))).drop("name")
