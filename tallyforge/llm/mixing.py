"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, materialize

#: Bins of the rank that are counted per source before the one bin that holds the cut is ordered exactly.
BINS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_source(df: DataFrame) -> DataFrame:
    """Null and empty sources differ: (s_null, s) is a join key without nulls."""
    return df.withColumns({"s_null": F.col("source").isNull(), "s": F.coalesce("source", F.lit(""))})


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(s_null, s, n, source_size, target) from (s_null, s, size).

    Sources by code point, null last, weigh cycle[0], cycle[1], ..., repeating; together they share all sizes. A
    target stops at most times its source's size; what is over goes to the others by weight. In order of limit over
    weight, the sources that reach their limit come first, so one pass over the few source rows finds them. That pass is
    one task over a row a source: some millions of sources at most, whatever the number of documents.
    """
    per = sizes.groupBy("s_null", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(Window.orderBy("s_null", "s")) - 1) % len(cycle) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "s_null", "s")
    per = per.withColumns({
        "total": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
        "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("full", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("w"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "used": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything),
        "free": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything),
    })
    share = ((F.col("total") - F.col("used")) * F.col("w")).cast("double") / F.col("free")
    return per.select("s_null", "s", "n", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _ranked(sizes: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds q, the document's random odds over its inclusion odds, and its bin."""
    df = sizes.join(plan, ["s_null", "s"])
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0
    a = F.floor(F.try_divide(1000 * F.col("size") * F.col("n"), F.col("size") * F.col("n") + F.col("source_size")))
    df = df.withColumn("u", u).withColumn("p", F.when(F.col("part") > 0, F.col("part") + F.col("part") * (1 - F.col("part")) * ((a - F.col("lean")) / 1000.0)))
    df = df.withColumn("q", (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p")))
    return df.withColumn("bin", F.least(F.floor(F.col("q") / (F.col("q") + 1) * BINS), F.lit(BINS - 1)))


def mix_plan(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:") -> DataFrame:
    """One row a source: its target, certain copies (whole), and the cut of the Pareto ranking.

    sizes: (s_null, s, key_id, size). A document's expected copies are target / source_size = whole + part. Every
    document gets `whole` copies. One copy more is sampled with inclusion odds p that lean to longer documents and
    are calibrated: sum(p * size) is exactly the words still missing. Ranked by q = odds(u) / odds(p), documents are
    taken until the missing words are filled to the nearest document; the sample's size is fixed in words. Rank bins
    are summed per source first, so only the one bin that holds the cut is ordered, however large the source.
    """
    target = source_targets(sizes, cycle, most)
    ratio = F.col("target") / F.col("source_size")
    plan = target.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(most))).otherwise(0).cast("long"))
    plan = plan.withColumn("part", F.when(F.col("source_size") > 0, ratio - F.col("whole")).otherwise(0.0))
    plan = materialize(plan, "mix-targets")
    a = F.floor(F.try_divide(1000 * F.col("size") * F.col("n"), F.col("size") * F.col("n") + F.col("source_size")))
    lean = sizes.join(plan.select("s_null", "s", "n", "source_size"), ["s_null", "s"]).groupBy("s_null", "s").agg((F.sum(a * F.col("size")).cast("double") / F.nullif(F.max("source_size"), F.lit(0))).alias("lean"))
    plan = materialize(plan.join(lean, ["s_null", "s"]).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    ranked = _ranked(sizes, plan, seed).filter("part > 0")
    bins = ranked.groupBy("s_null", "s", "bin").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
    upto = F.sum("words").over(Window.partitionBy("s_null", "s").orderBy("bin"))
    cross = bins.withColumn("upto", upto).filter("upto > missing").groupBy("s_null", "s").agg(F.min(F.struct("bin", F.expr("upto - words").alias("before"))).alias("c"))
    cross = materialize(cross.select("s_null", "s", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("cut_before")), "mix-cross")
    near = ranked.join(cross, ["s_null", "s"]).filter("bin = cut_bin").groupBy("s_null", "s", "q", "key_id", "size").agg((F.sum("size")).alias("words"), F.max("missing").alias("missing"), F.max("cut_before").alias("cut_before"))
    upto = F.sum("words").over(Window.partitionBy("s_null", "s").orderBy("q", "key_id", "size"))
    cut = near.withColumn("before", F.col("cut_before") + upto - F.col("words")).filter("2 * before + words <= 2 * missing").groupBy("s_null", "s").agg(F.max(F.struct("q", "key_id", "size")).alias("cut"))
    plan = plan.join(cross, ["s_null", "s"], "left").join(cut, ["s_null", "s"], "left")
    return materialize(plan, "mix-cut")


def apply_plan(sizes: DataFrame, plan: DataFrame, seed: str = "mix:") -> DataFrame:
    """Adds source_size, target, copies and taken to rows with (s_null, s, key_id, size)."""
    df = _ranked(sizes, plan, seed)
    key, cut = F.struct("q", "key_id", "size"), F.col("cut")
    extra = F.coalesce((F.col("part") > 0) & ((F.col("bin") < F.coalesce("cut_bin", F.lit(BINS))) | ((F.col("bin") == F.col("cut_bin")) & (key <= cut))), F.lit(False))
    return df.withColumn("copies", F.col("whole") + extra.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    doc_id = column(docs, "doc_id", "long")
    base = docs.select(doc_id.alias("doc_id"), column(docs, "source", "string").alias("source"), words(column(docs, "text", "string")).alias("size"), *[docs[c].alias(f"kept_{c}") for c in keep])
    return with_source(base).withColumn("key_id", F.coalesce("doc_id", F.lit(-(2**63))))


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs.

    A null text counts no words; a null source is a source of its own, apart from ''. Rows that repeat a doc_id are
    documents of their own; those that agree in id and size are taken together or not at all. Extra columns are
    ignored; an empty table gives no rows. A source without words has target 0. The random number of a document
    comes from its doc_id alone, so reruns agree.
    """
    sizes = materialize(sized(docs), "mix-sizes")
    plan = mix_plan(sizes.select("s_null", "s", "key_id", "size"), cycle, most, seed)
    return apply_plan(sizes, plan, seed).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:") -> DataFrame:
    """docs with each row as often as the mix takes it (0 to most times); columns unchanged."""
    slim = materialize(sized(docs), "mix-sizes")
    plan = mix_plan(slim.select("s_null", "s", "key_id", "size"), cycle, most, seed)
    full = apply_plan(sized(docs, *docs.columns), plan, seed).filter("copies > 0")
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


MIX_SQL = """
with d as (
  select doc_id, source is null as s_null, coalesce(source, '') as s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         coalesce(doc_id, (-9223372036854775807)::bigint - 1) as key_id
  from documents),
per as (
  select s_null, s, count(*) as n, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
         ((row_number() over (order by s_null, s) - 1) % 3 + 1)::bigint as w
  from d group by s_null, s),
ord as (
  select *, (sum(source_size) over ())::bigint as total,
         (sum(cap) over (order by cap::double / w, s_null, s rows unbounded preceding))::bigint - cap as before,
         (sum(w) over (order by cap::double / w, s_null, s rows between current row and unbounded following))::bigint as rest
  from per),
ful as (select *, cap * rest <= (total - before) * w as is_full from ord),
tgt as (
  select *, case when is_full then cap::double
                 else ((total - (sum(case when is_full then cap else 0 end) over ())::bigint) * w)::double
                      / (sum(case when is_full then 0 else w end) over ())::bigint end as target
  from ful),
pln as (
  select s_null, s, n, source_size, target,
         case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as whole
  from tgt),
prt as (
  select *, case when source_size > 0 then target / source_size - whole else 0.0 end as part,
         target - whole * source_size as missing
  from pln),
x as (
  select d.*, prt.* exclude (s_null, s),
         floor((1000 * size * n)::double / (size * n + source_size)) as a
  from d join prt on d.s_null = prt.s_null and d.s = prt.s),
ln as (select s_null, s, sum(a::bigint * size)::bigint::double / nullif(max(source_size), 0) as lean from x group by s_null, s),
pr as (
  select x.*, part + part * (1 - part) * ((a - lean) / 1000.0::double) as p,
         (('0x' || substr(md5('mix:' || key_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from x join ln on x.s_null = ln.s_null and x.s = ln.s),
rk as (select *, (u * (1 - p)) / ((1 - u) * p) as q from pr),
cum as (select *, (sum(size) over (partition by s_null, s order by q, key_id, size range unbounded preceding))::bigint as upto,
               (sum(size) over (partition by s_null, s, q, key_id, size))::bigint as same from rk)
select doc_id, size, source_size, target,
       (whole + case when part > 0 and 2 * (upto - same) + same <= 2 * missing then 1 else 0 end) * size as taken
from cum
"""
