"""Reachability, cycles and degrees over edge tables, by joins to a fixpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, "graph")


def _steps(new: DataFrame, edges: DataFrame, at: str, end: str) -> int:
    """How many rows new join edges on new[at] = edges[end] has, before repeated ones go. Counted by node, without the join."""
    ends = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("m"))
    return new.groupBy(F.col(at).alias("node")).agg(F.count(F.lit(1)).alias("n")).join(ends, "node").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def reachable(edges: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame | None:
    """(src, dst) of all paths of one edge or more. Paths double in length each round; safe on cycles.

    A round joins the pairs that the last one found to all pairs: the first half of a new shortest path is always among
    them. Sources that reach every node with an edge in have nothing left to find and drop out of the joins. Pairs may be
    the square of the nodes; where only their numbers matter, reach_counts makes far fewer. None as soon as the next
    round might make more than `most` pairs.
    """
    paths = new = _cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    ends = paths.select("dst").distinct().count()
    while True:
        if most is not None and _steps(new, paths, "dst", "src") > most:
            return None
        done = paths.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == ends).select("src")
        longer = new.join(done, "src", "left_anti").alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new = _cut(longer.subtract(paths))
        if not new.take(1):
            return paths
        paths = paths.unionByName(new)


#: Pairs of parts that are held at a time, and rounds of a block between two writes of all its pairs.
PAIRS, ROUNDS = 20_000_000, 8


def _pairs_into(dag: DataFrame, ends: DataFrame, most: int, folder: str) -> DataFrame | None:
    """(src, dst) of all paths whose last edge is in ends, a step back each round; None where a round might make more than `most`.
    Tables lie in numbered folders that the next block overwrites."""
    seen = new = cut(ends, f"{folder}-0", again=True)
    n = 0
    while True:
        if _steps(new, dag, "src", "dst") > most:
            return None
        n += 1
        step = dag.alias("a").join(new.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new = cut(step.subtract(seen), f"{folder}-{n}", again=True)
        if not new.take(1):
            return seen
        seen = seen.unionByName(new)
        if n % ROUNDS == 0:
            seen = cut(seen, f"{folder}-all-{n // ROUNDS % 2}", again=True)


def _weights_ahead(dag: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """(part, ahead): the weights of all nodes that a node of a graph without cycles reaches; weights (node, weight) are 1 where
    not given.

    All pairs at once where they are no more than `most`; else the nodes reached are taken in blocks, halved until one
    fits, and only sums stay. A node alone in its block is never halved; it has a pair a node at most.
    """
    summed = lambda pairs: pairs.join(weights, pairs.dst == weights.node, "left").groupBy(F.col("src").alias("part")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("ahead"))
    pairs = reachable(dag, most=most)
    if pairs is not None:
        return _cut(summed(pairs))
    folder, total, turn = uuid.uuid4().hex, None, 0
    blocks = [(2, 1), (2, 0)]
    while blocks:
        n, i = blocks.pop()
        ends = dag.filter(F.pmod(F.xxhash64("dst"), F.lit(n)) == i)
        alone = ends.select("dst").distinct().limit(2).count() < 2
        pairs = _pairs_into(dag, ends, 2**63 if alone else most, folder)
        if pairs is None:
            blocks += [(2 * n, i + n), (2 * n, i)]
            continue
        sums = summed(pairs)
        both = sums if total is None else total.unionByName(sums).groupBy("part").agg(F.sum("ahead").alias("ahead"))
        total, turn = cut(both, f"{folder}-sums-{turn}", again=True), 1 - turn
    return total


def reach_counts(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = PAIRS) -> DataFrame:
    """(src, n): how many nodes each node with an edge out reaches by paths of one edge or more; itself counts where it is on a cycle.

    Nodes on one cycle reach the same, so components become single weighted nodes, and pairs are made only between those, at
    most `most` or one a node or edge at a time. In a large graph without cycles there may still be as many as the square of
    its nodes, one block after another. A null leads nowhere and comes from nowhere, but counts as an end.
    """
    edges = _cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    parts = _cut(cycles(edges))
    sizes = parts.groupBy(F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    part_of = lambda end: parts.select(F.col("component").alias(f"{end}_part"), F.col("node").alias(end))
    dag = edges.join(part_of("src"), "src", "left").join(part_of("dst"), "dst", "left").select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    dag = _cut(dag.filter("src is null or dst is null or src <> dst").distinct())
    ahead = _weights_ahead(dag, sizes, max(most, dag.count()))
    out = edges.groupBy("src").agg(F.max(F.coalesce(F.col("src") == F.col("dst"), F.lit(False)).cast("long")).alias("loop"))
    out = out.join(part_of("src"), "src", "left").withColumn("part", F.coalesce("src_part", "src"))
    out = out.join(sizes, out.part == sizes.node, "left").join(ahead.withColumnRenamed("part", "of"), F.col("part").eqNullSafe(F.col("of")), "left")
    return out.select("src", (F.coalesce("weight", "loop") + F.coalesce("ahead", F.lit(0))).alias("n"))


def reachable_from(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of seeds and all that they reach: a frontier join, round by round."""
    edges = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    seen = frontier = _cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct())
    while True:
        frontier = _cut(frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not frontier.take(1):
            return seen
        seen = _cut(seen.unionByName(frontier))


#: Layers of nodes that are peeled off between two writes.
LAYERS = 4


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that no cycle can hold: into nodes that nothing leaves, or out of nodes that nothing enters."""
    n = edges.count()
    while n:
        inner = edges
        for _ in range(LAYERS):
            leaving, entered = inner.select(F.col("src").alias("dst")).distinct(), inner.select(F.col("dst").alias("src")).distinct()
            inner = inner.join(entered, "src", "left_semi").join(leaving, "dst", "left_semi").select("src", "dst")
        inner = _cut(inner)
        now = inner.count()
        if now == n:
            break
        edges, n = inner, now
    return edges


def _least_before(edges: DataFrame) -> DataFrame:
    """(node, color): the least node from which each node can be reached, itself included.

    A round passes colours along each edge, then from each node's colour to the node: what reaches the colour reaches the node. So
    colours travel twice as far each round along a chain.
    """
    color = _cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")))
    while True:
        passed = edges.join(color, edges.src == color.node).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("new"))
        near = color.join(passed, "node", "left").select("node", F.col("color").alias("old"), F.least("color", F.coalesce("new", "color")).alias("via"))
        near = _cut(near)
        further = near.select(F.col("node").alias("via"), F.col("via").alias("color"))
        new = _cut(near.join(further, "via").select("node", "color", (F.col("color") < F.col("old")).alias("moved")))
        color = new.select("node", "color")
        if not new.filter("moved").take(1):
            return color


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, node) of strongly connected components of two nodes or more; component is the least node.

    Each round colours every node by the least node before it; what can go back to the node that gave the colour, within
    the colour, is that node's component, and leaves the graph. A table holds one row a node or an edge at any time, never
    all pairs.
    """
    rest = _cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst").distinct())
    found = []
    while True:
        rest = _trimmed(rest)
        if not rest.take(1):
            break
        color = _least_before(rest)
        within = rest.join(color.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c")), ["dst", "c"]).select("src", "dst")
        within = _cut(within)
        seen = _cut(reachable_from(within, color.filter("node = color").select("node"), "dst", "src"))
        found.append(color.join(seen, "node").select(F.col("color").alias("component"), "node"))
        rest = _cut(rest.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if not found:
        return edges.select(F.col(src).alias("component"), F.col(src).alias("node")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = _cut(out)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("component")
    return out.join(sizes, "component").select("component", "node")


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_out, fan_in) over distinct edges."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
