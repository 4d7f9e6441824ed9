"""Filter interaction audit: the trie of filter orders, walked depth first over persisted survivors."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, dealt_join, materialize, scratch

#: White space between words, as a pattern of runs.
_BLANK = r"[\x20\x09-\x0D]+"
#: The filters of the contract, by what a document that fails them looks like. A null condition counts as passed.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n_words, n_distinct, n_upper, n_chars, has_symbol, is_copy, good, toxic) of every row of docs: one pass over the texts, which
    then stay behind.

    is_copy: a row of smaller doc_id has the same text, wherever it stands; texts meet by their SHA-256, and a text that
    many rows share is dealt over parts. good and toxic: any label row of the doc_id says so.
    """
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    words = F.filter(F.split("text", _BLANK), lambda w: w != "")
    rows = docs.select(column(docs, "doc_id", "long").cast("long").alias("doc_id"), F.coalesce(column(docs, "source", "string"), F.lit("")).alias("part"), text.alias("text"))
    # Generators keep the split from being repeated for each of its counts.
    rows = rows.select("*", F.inline(F.array(F.struct(words.alias("words")))))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("key"),
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_upper"),
        F.length("text").alias("n_chars"),
        F.col("text").rlike(r"[#$%&*|]").alias("has_symbol"),
    )
    rows = materialize(rows, "audit-measures")
    rows = dealt_join(rows, rows.groupBy("key").agg(F.min("doc_id").alias("first")), "key", "doc_id", "audit")
    rows = rows.withColumn("is_copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("key", "first")
    quality, toxic = column(labels, "quality", "int"), column(labels, "toxic", "int")
    known = labels.select(column(labels, "doc_id", "long").cast("long").alias("doc_id"), (quality == 1).alias("good"), (toxic == 1).alias("toxic"))
    known = materialize(known.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "audit-labels")
    marked = rows.join(known, "doc_id", "left")
    return materialize(marked.drop("doc_id").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}), "audit-rows")


def edges(rows: DataFrame, filters: dict[str, str], part: str, marks: list[str]) -> DataFrame:
    """(part, state, filter, n, removed, one sum of removed rows a mark) of every edge of the trie, where rows are left.

    state is the set of filters already applied, as bits; filter the number of the next one; n the survivors before it. Orders
    that share an unordered prefix share its survivors: each state is entered once, depth first, and its survivors are
    persisted while its subtree is walked, so that at most as many frames as there are filters are held. Survivors come
    from rows by the filters alone, so those of a lost executor are made again. Counts go to a table as they arise.
    """
    fails = [F.coalesce(F.expr(f), F.lit(False)) for f in filters.values()]
    full, seen = (1 << len(fails)) - 1, set()
    path = scratch(rows.sparkSession, "audit-edges")

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        rest = [i for i in range(len(fails)) if not state >> i & 1]
        counts = {"n": F.count(F.lit(1))}
        for i in rest:
            counts |= {f"removed_{i}": F.count_if(fails[i])} | {f"{m}_{i}": F.count_if(fails[i] & F.col(m)) for m in marks}
        each = [F.struct(F.lit(i).alias("filter"), "n", F.col(f"removed_{i}").alias("removed"), *[F.col(f"{m}_{i}").alias(m) for m in marks]) for i in rest]
        counted = survivors.groupBy(F.col(part).alias("part")).agg(*[c.alias(k) for k, c in counts.items()])
        counted.select("part", F.inline(F.array(*each))).write.mode("overwrite").parquet(f"{path}/state={state}")
        for i in rest:
            if state | 1 << i != full and state | 1 << i not in seen:
                left = survivors.filter(~fails[i]).persist()
                visit(state | 1 << i, left)
                left.unpersist()

    root = rows.persist()
    visit(0, root)
    root.unpersist()
    kinds = ", ".join(f"{c} long" for c in ("n", "removed", *marks))
    return rows.sparkSession.read.schema(f"part string, filter int, {kinds}, state int").parquet(path)


def report(found: DataFrame, names: str, marks: list[str]) -> DataFrame:
    """Every order and step of every part from the edges, zeros included; see audit."""
    k = len(names)
    orders = [{"filter_order": "".join(names[i] for i in o), "step": s + 1, "state": sum(1 << i for i in o[:s]), "filter": o[s]} for o in permutations(range(k)) for s in range(k)]
    key = lambda state, i: state * k + i
    entry = F.struct((F.col("state") * k + F.col("filter")).alias("key"), F.struct("n", "removed", *marks).alias("value"))
    # At most 2^k * k entries a part.
    per_part = found.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))

    def of(at: Column | int, field: str) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.coalesce(F.try_element_at("edges", at)[field], F.lit(0)).cast("long")

    full = (1 << k) - 1
    shapley = [sum((of(key(s, i), "removed") * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(1 << k) if not s >> i & 1), F.lit(0).cast("long")) for i in range(k)]
    per_part = per_part.select(
        "part",
        "edges",
        F.array(*shapley).alias("shapleys"),
        F.array(*[of(key(0, i), "removed") for i in range(k)]).alias("fails"),
        F.array(*[of(key(full ^ 1 << i, i), "removed") for i in range(k)]).alias("uniques"),
    )
    rows = per_part.select("*", F.inline(F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order string, step int, state int, filter int>>")))
    at, i = F.col("state") * k + F.col("filter"), F.col("filter")
    removed = of(at, "removed")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (of(at, "n") - removed).alias("kept"),
        removed.alias("removed"),
        (F.get("fails", i) - removed).alias("redundant"),
        F.get("uniques", i).alias("unique_fails"),
        *[of(at, m).alias(f"{m}_lost") for m in marks],
        F.get("shapleys", i).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): what each filter
    removes at each place of every order, for each source value.

    filters: name (one letter) -> failure condition over the columns of measured, FILTERS by default; k filters make k!
    orders, so a handful at most. kept counts documents after the step, removed those that go in it, redundant those that
    fail its filter but went earlier, unique_fails those that fail no other; good_lost and toxic_lost are removed
    documents so labelled; shapley sums a filter's removals over all orders.

    A null text is empty; an empty text has no words. A null source is part ''. A row without doc_id has no labels and is
    nobody's copy; rows that repeat a doc_id are counted each and aren't copies of one another; of several label rows any that says 1 counts, and null
    labels say nothing. Extra columns are ignored; an empty table has no parts and gives no rows. Texts are read whole.
    """
    filters = filters or FILTERS
    marks = ["good", "toxic"]
    return report(edges(measured(docs, labels), filters, "part", marks), "".join(filters), marks)


_MASKS = " + ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(FILTERS.values()))
AUDIT_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
measures AS (
  SELECT part, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, length(t) AS n_chars,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         regexp_matches(t, '[#$%&*|]') AS has_symbol, coalesce(first < doc_id, false) AS is_copy,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, {_MASKS} AS mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM measures GROUP BY ALL),
letters AS (SELECT i AS f, substr('ABCDE', i + 1, 1) AS name FROM range(5) r(i)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s AS step, fs[s] AS f,
         coalesce(list_sum(list_transform(fs[1:s - 1], lambda x: 1 << x)), 0)::INT AS state
  FROM orders, range(1, 6) r(s)),
counts AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (mask & state = 0 AND mask & (1 << f) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & state = 0 AND mask & (1 << f) <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & state <> 0 AND mask & (1 << f) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = (1 << f)), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & state = 0 AND mask & (1 << f) <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & state = 0 AND mask & (1 << f) <> 0), 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""
