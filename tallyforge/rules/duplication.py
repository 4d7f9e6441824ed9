"""Copied blocks of lines with the files that hold them too."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.store import cut

# Lines that say nothing about copying.
_BARE = ["", "{", "}", "};", "});", "})", "[", "]", "else", "try", "finally"]
_OPENINGS = ["//", "#", "using ", "namespace "]
#: Files of one window from which its holders are told by classes of files instead of one by one.
HOT = 1000


def code_lines(files: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, line, code): lines that count, numbered from 0 in n and by their place in the file, from 1, in line.

    Runs of blanks are one blank. Blank lines, comment lines, block comments from a line that begins one to the line that
    ends it, imports, namespaces and lone brackets don't count.
    """
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    rows = files.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("at", "raw")).select("doc", (F.col("at") + 1).alias("line"), trimmed.alias("t"))
    by_line = Window.partitionBy("doc").orderBy("line")
    # The last line that opens or ends a block comment tells whether one is open.
    mark = F.when(F.col("t").contains("*/"), False).when(F.col("t").startswith("/*"), True)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    opening = F.lit(False)
    for o in ["/*", *_OPENINGS]:
        opening |= F.col("t").startswith(o)
    kept = rows.withColumn("inside", inside).filter(~F.col("inside") & ~opening & ~F.col("t").isin(_BARE))
    return kept.select("doc", (F.row_number().over(by_line) - 1).alias("n"), "line", F.regexp_replace("t", " +", " ").alias("code"))


def _least(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, least): the k least docs of each key, of which every task keeps no more before they meet."""
    w = Window.partitionBy(key).orderBy("doc")
    few = rows.select(key, "doc").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return few.groupBy(key).agg(F.array_sort(F.collect_list("doc")).alias("least"))


class _Holders:
    """The other files that hold a window, or several: docs one by one, or classes of docs where they are many."""

    def __init__(self, docs: dict | None, classes: dict | None):
        self.docs, self.classes = docs, classes

    def __and__(self, other: _Holders) -> _Holders:
        if self.docs is None and other.docs is None:
            return _Holders(None, {c: x for c, x in self.classes.items() if c in other.classes})
        few, rest = (self, other) if self.docs is not None else (other, self)
        return _Holders({d: c for d, c in few.docs.items() if (d in rest.docs if rest.docs is not None else c in rest.classes)}, None)

    def least(self, k: int, but: object) -> list:
        found = self.docs if self.docs is not None else {d for x in self.classes.values() for d in x}
        return sorted(d for d in found if d != but)[:k]


def _fold(doc: object, windows: list, lines: list[int], sets: dict, window: int, least: int, k: int) -> Iterator[tuple]:
    """The blocks of one file. windows: (n, h, set, mixed) of the duplicated ones in order; sets: set -> (least docs, holders)."""
    own: dict[str, list[int]] = defaultdict(list)
    for n, h, _, _ in windows:
        own[h].append(n)
    at = 0
    while at < len(windows):
        start, shared, within, line, last = windows[at][0], None, False, None, None
        j = at
        while j < len(windows) and windows[j][0] == start + j - at:
            n, h, held, mixed = windows[j]
            # Places in this file count as long as they lie outside the block so far.
            before, after = own[h][0] < start, own[h][-1] >= n + window
            here = shared if held == last else (sets[held] if mixed else held)
            if shared is None:
                within = before or after
            else:
                here = here if held == last else shared & here
                if not (before or after) or not within:
                    if not (here.least(1, doc) if isinstance(here, _Holders) else sets[here][1:]):
                        break
                within = within and (before or after)
            shared, last = here, held
            if within:
                place = lines[own[h][0] if before else own[h][bisect_left(own[h], n + window)]]
                line = place if line is None else min(line, place)
            j += 1
        others = shared.least(k, doc) if isinstance(shared, _Holders) else [d for d in sets[shared] if d != doc][:k]
        partners = sorted([*others, *([doc] if within else [])])[:k]
        count = j - at
        if count + window - 1 >= least and partners:
            end = start + count + window - 2
            yield doc, start, count, windows[at][1], lines[start], lines[end] - lines[start] + 1, partners, line if within else None
        at = j


def copied_blocks(files: DataFrame, doc: str = "path", text: str = "content", window: int = 8, least: int = 12, partners: int = 5, hot: int = HOT) -> DataFrame:
    """(doc, first_line, lines, hash, others) of the blocks of at least `least` lines that other places hold too.

    Windows of `window` code lines that stand in two places or more are duplicated. A block is a run of them that grows while at least
    one file holds all of its windows, and a new one begins where no file is left; the same file counts by places that lie outside the
    block. others: up to `partners` such files in order, each with the first line of what it shares: (doc, line). lines
    spans from the first to the last line of the block, and hash is the first window's.

    Windows meet by hash, and each distinct set of holders is told by a fingerprint of it, so a run with one set is a block without its
    members being brought along. Where sets change within a run, members come with it: one by one, or from `hot` files on
    as classes of files that hold the same hot sets, so that a window of very many files costs as many rows as there are such
    classes. Files are folded one by one, each whole. Null texts have no lines; doc must be unique.
    """
    numbered = cut(code_lines(files, doc, text), "code-lines")
    ahead = Window.partitionBy("doc").orderBy("n").rowsBetween(0, window - 1)
    spans = numbered.select("doc", "n", "line", F.collect_list("code").over(ahead).alias("w")).filter(F.size("w") == window)
    windows = cut(spans.select("doc", "n", "line", F.upper(F.left(F.sha2(F.concat(F.array_join("w", "\n"), F.lit("\n")), 256), F.lit(16))).alias("h")), "windows")
    holders = windows.groupBy("h", "doc").agg(F.count(F.lit(1)).alias("c"))
    prints = [F.hex(F.bit_xor(F.xxhash64(F.lit(i), "doc"))) for i in (1, 2)]
    twice = holders.groupBy("h").agg(F.sum("c").alias("places"), F.count(F.lit(1)).alias("files"), F.concat(F.count(F.lit(1)), F.lit("-"), *prints).alias("held")).filter("places > 1")
    twice = cut(twice.select("h", "held", "files"), "duplicated")
    dup = windows.join(twice, "h")
    dup = dup.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("doc").orderBy("n")))
    span = Window.partitionBy("doc", "run")
    dup = cut(dup.withColumn("mixed", F.min("held").over(span) != F.max("held").over(span)), "runs")

    first = twice.groupBy("held").agg(F.min("h").alias("h"), F.max("files").alias("files"))
    members = cut(windows.select("h", "doc").distinct().join(first, "h").select("held", "doc", "files"), "members")
    mixed = dup.filter("mixed").select("held").distinct()
    sought = members.join(mixed, "held", "left_semi")
    classes = sought.filter(F.col("files") >= hot).groupBy("doc").agg(F.xxhash64(F.array_sort(F.collect_set("held"))).alias("class"))
    sought = cut(sought.join(classes, "doc", "left"), "sought")
    # A set's holders as one value: fewer than `hot` docs, or the classes of the others.
    few = sought.filter(F.col("files") < hot).groupBy("held").agg(F.collect_list(F.struct("doc", "class")).alias("docs"))
    per_class = _least(sought.filter("class is not null"), "class", partners + 1)
    many = sought.filter(F.col("files") >= hot).select("held", "class").distinct().join(per_class, "class").groupBy("held").agg(F.collect_list(F.struct("class", "least")).alias("classes"))
    told = _least(members, "held", partners + 1).join(few, "held", "left").join(many, "held", "left")
    told = cut(told, "holders")

    uses = dup.select("doc", "held", "mixed").groupBy("doc", "held").agg(F.max("mixed").alias("mixed")).join(told, "held")
    whole = F.struct("held", "least", F.when(F.col("mixed"), F.col("docs")).alias("docs"), F.when(F.col("mixed"), F.col("classes")).alias("classes"))
    sets = uses.groupBy("doc").agg(F.collect_list(whole).alias("sets"))
    per_file = dup.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "h", "held", "mixed"))).alias("windows")).join(sets, "doc")
    lines = numbered.join(per_file.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, found, at, held in zip(b["doc"], b["windows"], b["at"], b["sets"]):
                known: dict = {}
                for s in held:
                    known[s["held"]] = list(s["least"])
                    if s["docs"] is not None:
                        known["all", s["held"]] = _Holders({x["doc"]: x["class"] for x in s["docs"]}, None)
                    elif s["classes"] is not None:
                        known["all", s["held"]] = _Holders(None, {x["class"]: list(x["least"]) for x in s["classes"]})
                steps = [(w["n"], w["h"], ("all", w["held"]) if w["mixed"] else w["held"], w["mixed"]) for w in found]
                rows += _fold(d, steps, list(at), known, window, least, partners)
            yield pd.DataFrame(rows, columns=["doc", "n", "m", "hash", "first_line", "lines", "partners", "own_line"]).astype({"own_line": "Int32"})

    kind = files.schema[doc].dataType
    schema = StructType([StructField("doc", kind), StructField("n", LongType()), StructField("m", LongType()), StructField("hash", StringType()), StructField("first_line", IntegerType()), StructField("lines", IntegerType()), StructField("partners", ArrayType(kind)), StructField("own_line", IntegerType())])
    blocks = cut(per_file.join(lines, "doc").mapInPandas(run, schema), "blocks")

    # First lines in the partners: each window of a block looks up its places there.
    each = blocks.filter(F.array_except("partners", F.array("doc")) != F.array().cast(ArrayType(kind))).select("doc", F.col("n").alias("start"), F.explode(F.array_except("partners", F.array("doc"))).alias("partner"), F.explode(F.expr("sequence(n, n + m - 1)")).alias("n"))
    placed = each.join(dup.select("doc", "n", "h"), ["doc", "n"])
    first_at = windows.groupBy(F.col("doc").alias("partner"), "h").agg(F.min("line").alias("line"))
    found = placed.join(first_at, ["partner", "h"]).groupBy("doc", "start", "partner").agg(F.min("line").alias("line"))
    found = found.groupBy("doc", F.col("start").alias("n")).agg(F.collect_list(F.struct(F.col("partner").alias("doc"), "line")).alias("found"))
    out = blocks.join(found, ["doc", "n"], "left")
    own = F.when(F.col("own_line").isNotNull() & F.array_contains("partners", F.col("doc")), F.array(F.struct("doc", F.col("own_line").alias("line"))))
    empty = F.array().cast(f"array<struct<doc:{kind.simpleString()},line:int>>")
    return out.select("doc", "first_line", "lines", "hash", F.array_sort(F.concat(F.coalesce("found", empty), F.coalesce(own, empty))).alias("others"))


def duplication_findings(blocks: DataFrame) -> DataFrame:
    """copied_blocks as candidates: (rule_id, severity, file_path, line, symbol)."""
    where: Column = F.array_join(F.transform("others", lambda o: F.concat(o["doc"].cast("string"), F.lit(":"), o["line"].cast("string"))), ", ")
    return blocks.select(F.lit("quality.duplication.block").alias("rule_id"), F.lit(1).alias("severity"), F.col("doc").cast("string").alias("file_path"), F.col("first_line").alias("line"), F.concat_ws(" ", "hash", where).alias("symbol"))
