"""MinHash near-duplicate detection with sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, dealt_join, hash_segments, materialize, mix64, parts_of, text_chunks

#: Signature values are compared this many at a time.
BATCH = 16
#: Members of a group that meet as one block in the last round, and the shingles of their sets; a larger group becomes pairs of blocks.
BLOCK, BLOCK_VOLUME = 1024, 1 << 22


def banding(similarity: float, miss: float, rows: int = 6) -> int:
    """Bands of `rows` values so that a pair at the threshold shares none with probability miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct k-word shingles, ordered by both; a shorter text is one shingle as a whole."""
    h, doc = w.hash, w.doc
    first = np.cumsum(w.count) - w.count
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    n = len(h) - k + 1
    if n > 0:
        s = h[:n].copy()
        for j in range(1, k):
            s = s * U64(0x9E3779B97F4A7C15) + h[j : n + j]
        whole = doc[:n] == doc[k - 1 :]
        s, d = mix64(s[whole] + U64(k)), doc[:n][whole]
    else:
        s, d = np.empty(0, U64), np.empty(0, np.int64)
    if len(short):
        s = np.concatenate([s, hash_segments(h, first[short], w.count[short])])
        d = np.concatenate([d, short])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return d[keep], s[keep]


def _set_key(d: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each document's set, and the sets' sizes."""
    size = np.bincount(d, minlength=n)
    key = np.zeros((n, 2), U64)
    at = np.flatnonzero(size)
    if len(at):
        first = (np.cumsum(size) - size)[at]
        key[at, 0] = np.add.reduceat(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)), first)
        key[at, 1] = np.add.reduceat(mix64(s + U64(0x1234567)), first)
    return key, size


def _minima(d: np.ndarray, s: np.ndarray, size: np.ndarray, hashes: int) -> np.ndarray:
    """(documents with shingles, hashes) minima of 32-bit hashes."""
    at = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[at]
    out = np.empty((len(at), hashes), np.uint32)
    mul = mix64(np.arange(1, hashes + 1, dtype=U64)) | U64(1)
    add = mix64(np.arange(10_001, 10_001 + hashes, dtype=U64))
    x = np.empty_like(s)
    for j in range(hashes):
        np.multiply(s, mul[j], out=x)
        x += add[j]
        x ^= x >> U64(29)
        out[:, j] = np.minimum.reduceat((x >> U64(16)).astype(np.uint32), first)
    return out


def _sketcher(k: int, hashes: int, longs: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                d, s = _shingles(Words(data, offsets, lower), k)
                key, size = _set_key(d, s, j - i)
                sig: list = [None] * (j - i)
                bits = np.zeros((j - i, longs), np.int64)
                if len(s):
                    m = _minima(d, s, size, hashes)
                    low = m.astype("<u2")
                    for at, row in enumerate(np.flatnonzero(size)):
                        sig[row] = low[at].tobytes()
                    bits[size > 0] = np.packbits((m[:, : 64 * longs] >> 20 & 1).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("text_hash").slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(bits.tolist(), pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig", "bits"],
                )

    return run


def fewest_matches(n: int, agree: float, miss: float) -> int:
    """The fewest matches m of n with P(p >= agree | m of n) >= miss for a match probability p under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its upper tail at p equals P(Binomial(n + 1, p) <= m).
    """
    tail, m = 0.0, -1
    while tail < miss:
        m += 1
        tail += math.comb(n + 1, m) * agree**m * (1 - agree) ** (n + 1 - m)
    return m


def posterior_bounds(similarity: float, miss: float, hashes: int) -> list[int]:
    """fewest_matches at each batch end."""
    return [fewest_matches(n, similarity, miss) for n in range(BATCH, hashes + 1, BATCH)]


def _pruner(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for t, least in enumerate(bounds):
                span = slice(t * BATCH, (t + 1) * BATCH)
                matches += (x[alive, span] == y[alive, span]).sum(axis=1)
                stay = matches >= least
                alive, matches = alive[stay], matches[stay]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return run


def _verifier(k: int, percent: int, lower: bool):
    """Exact comparison of the full shingle sets of two texts."""

    def sets(texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        d, s = _shingles(Words(data, offsets, lower), k)
        return np.split(s, np.cumsum(np.bincount(d, minlength=len(texts)))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ta, tb = ([t.encode() for t in part.column(c).to_pylist()] for c in ("text_a", "text_b"))
                good = []
                for i, (x, y) in enumerate(zip(sets(ta), sets(tb))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both) and both:
                        good.append(i)
                yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


_GROUP = ("bucket", "block_a", "block_b")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group as one table; rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy() for k in _GROUP])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]]).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and any(held[-1].column(k)[-1] != b.column(k)[lo] for k in _GROUP):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _block_pruner(bounds: list[int], percent: int, rows: int):
    """Pairs of the blocks that meet in one group. A row is a member of one side: those of side 0 lie outside the group's largest
    component. A group is no more than two blocks. Of the pairs that are left, a row (kind 1) for each first member lists the second
    ones (others), and a row (kind 0) names each member whose set they need: never a row a pair."""

    def pairs(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        out = [np.empty((2, 0), np.int64)]
        step = max(1, (1 << 18) // max(1, len(y)))
        for lo in range(0, len(x), step):
            i = x[lo : lo + step][:, None]
            n, m = g["n_shingles"][i], g["n_shingles"][y]
            # Two members outside the largest component meet twice: the lower class leads.
            once = (g["component"][y] == g["largest"][y]) | (g["rep"][i] < g["rep"][y])
            a, b = np.nonzero(once & (g["component"][i] != g["component"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            a, b = i[a, 0], y[b]
            matches = np.zeros(len(a), np.int64)
            for t, least in enumerate(bounds):
                span = slice(t * BATCH, (t + 1) * BATCH)
                matches += (g["sig"][a, span] == g["sig"][b, span]).sum(axis=1)
                stay = matches >= least
                a, b, matches = a[stay], b[stay], matches[stay]
            # A pair counts in the first group that it shares.
            for band in range(int(g["band"].max(initial=0))):
                span = slice(band * rows, (band + 1) * rows)
                first = (band >= g["band"][a]) | (g["sig"][a, span] != g["sig"][b, span]).any(axis=1)
                a, b = a[first], b[first]
            out.append(np.stack([a, b]))
        found = np.concatenate(out, axis=1)
        order = np.argsort(found[0], kind="stable")
        return found[0][order], found[1][order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            g = {k: table.column(k).to_numpy() for k in ("side", "band", "rep", "n_shingles", "component", "largest")}
            g["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            a, b = pairs(g)
            if not len(a):
                continue
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            _, wanted = np.unique(g["rep"][np.concatenate([a, b])], return_index=True)
            wanted = np.concatenate([a, b])[wanted]
            at = np.concatenate([wanted, a[first]])
            kind = np.repeat([0, 1], [len(wanted), len(first)])
            bounds_ = np.concatenate([np.zeros(len(wanted), np.int64), first, [len(a)]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds_), pa.array(g["rep"][b]))
            same = [pa.array(np.full(len(at), table.column(k)[0].as_py(), np.int64)) for k in _GROUP]
            yield pa.RecordBatch.from_arrays([*same, pa.array(kind.astype(np.int32)), pa.array(g["rep"][at]), pa.array(g["component"][at]), lists], [*_GROUP, "kind", "rep", "component", "others"])

    return run


def _set_writer(k: int, lower: bool):
    """A text's whole set, 8 bytes a shingle in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                d, s = _shingles(Words(data, offsets, lower), k)
                ends = np.cumsum(np.bincount(d, minlength=j - i))[:-1]
                yield pa.RecordBatch.from_arrays([b.column("rep").slice(i, j - i), pa.array([x.tobytes() for x in np.split(s, ends)], pa.binary())], ["rep", "members"])

    return run


def _block_verifier(percent: int):
    """The links that join the components of a group, from the rows of _block_pruner and the sets that they need: each pair of two
    components is compared on full sets, until a link has joined them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            sets: dict[int, np.ndarray] = {}
            root: dict[int, int] = {}
            of: dict[int, int] = {}
            lists: list[tuple[int, list[int]]] = []
            for kind, rep, component, others, members in zip(*(table.column(c).to_pylist() for c in ("kind", "rep", "component", "others", "members"))):
                if kind:
                    lists.append((rep, others))
                else:
                    sets[rep], of[rep] = np.frombuffer(members, U64), component

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            links = []
            for a, others in sorted(lists):
                mine = sets[a]
                for lo in range(0, len(others), 256):
                    apart = [b for b in others[lo : lo + 256] if find(of[b]) != find(of[a])]
                    if not apart:
                        continue
                    size = np.array([len(sets[b]) for b in apart])
                    every = np.concatenate([sets[b] for b in apart])
                    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                    both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(size) - size)
                    for i in np.flatnonzero(100 * both >= percent * (len(mine) + size - both)).tolist():
                        x, y = find(of[a]), find(of[apart[i]])
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            links.append((a, apart[i]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(id, component) for every id in links, component the smallest id reachable.

    Alternating large-star and small-star steps: every id points at the least id around it until only stars are left.
    Each step is a grouped minimum and a join, both of which Spark splits; what is written each round cuts lineage.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, name)
    while True:
        roots = edges.select(F.col("v").alias("u")).distinct()
        ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if not ends.join(roots.withColumn("root", F.lit(True)), "u", "left").filter("n > 1 or root").take(1):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _a_part(per_group: DataFrame) -> DataFrame:
    """Rows of (bucket, m, ...) once for each part of their group."""
    return per_group.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts_of(F.col("m")) - 1))).drop("m")


def _hubs(active: DataFrame, place: int) -> DataFrame:
    """One row a group and part: its first or second member, by set size and class."""
    member = F.struct(F.col("n_shingles").alias("n"), F.col("rep"), F.col("component"), F.col("bits"))
    first = _a_part(active.groupBy("bucket").agg(F.min(member).alias("hub"), F.max("m").alias("m")))
    if not place:
        return first
    rest = active.join(first, ["bucket", "part"]).filter(F.col("rep") != F.col("hub.rep")).drop("hub")
    return _a_part(rest.groupBy("bucket").agg(F.min(member).alias("hub"), F.max("m").alias("m")))


def _classified(docs: DataFrame, shingle: int, percent: int, lower: bool, miss: float, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, linked, lead) of every row of docs: linked tells whether its set is not empty, lead is
    the first (no_id, doc_id, text_hash) of its component. See near_duplicates."""
    t = percent / 100
    bands = banding(t, miss, rows)
    hashes = -(-bands * rows // BATCH) * BATCH
    longs = max(1, hashes // 64)
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = materialize(docs.mapInArrow(_sketcher(shingle, hashes, longs, lower), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig binary, bits array<long>"), "neardup-sketch")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    classes = sketch.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min(first).alias("first"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    # A class's number is its own, whatever ids its rows have; once written it stays.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "neardup-classes")

    spans = [F.xxhash64(F.lit(i), F.substring("sig", i * rows * 2 + 1, rows * 2)) for i in range(bands)]
    banded = classes.select("rep", "n_shingles", F.posexplode(F.array(*spans)).alias("band", "bucket"))
    crowded = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "neardup-crowded")
    heavy = crowded.filter(parts_of(F.col("m")) > 1).select("bucket", parts_of(F.col("m")).alias("parts"))
    spread = banded.join(heavy, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))).drop("parts")
    members = materialize(spread.join(_a_part(crowded.withColumn("size", F.col("m"))), ["bucket", "part"]).withColumnRenamed("size", "m"), "neardup-groups")
    reps = materialize(classes.join(members.select("rep").distinct(), "rep").select("rep", "first", "sig", "bits"), "neardup-reps")
    members = materialize(members.join(reps.select("rep", "bits"), "rep"), "neardup-members")
    no_id = F.lit(-(2**63))
    sought = reps.select("rep", F.coalesce("first.doc_id", no_id).alias("key"), F.col("first.text_hash").alias("text_hash"))
    needed = docs.filter("text is not null").select(F.coalesce("doc_id", no_id).alias("key"), "text_hash", "text").join(sought, ["key", "text_hash"])
    needed = materialize(needed.groupBy("key", "text_hash", "rep").agg(F.first("text").alias("text")).select("rep", "text"), "neardup-texts")

    def bits_apart(n: int):
        return sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_a")[i])) for i in range(1, n)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_a")[0])))

    reach = (F.col("component") != F.col("c_a")) & (100 * F.least("n_a", "n_shingles") >= percent * F.greatest("n_a", "n_shingles"))
    for n in range(1, longs + 1):
        reach &= bits_apart(n) <= 64 * n - fewest_matches(64 * n, (1 + t) / 2, miss)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs: the values' batches, then the full sets."""
        signed = pairs.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        close = dealt_join(signed, reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a", "b")
        close = materialize(close.mapInArrow(_pruner(posterior_bounds(t, miss, hashes)), "a long, b long").distinct(), "neardup-close")
        texts = needed.join(close.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
        worded = close.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        exact = dealt_join(worded, texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a", "b")
        return materialize(exact.mapInArrow(_verifier(shingle, percent, lower), "a long, b long").distinct(), "neardup-links")

    def joined(found: DataFrame, known: DataFrame) -> DataFrame:
        return materialize(components(found.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))), "neardup-known")

    def still_open(known: DataFrame) -> DataFrame:
        """Members of groups that hold several components."""
        active = members.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ = active.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("m").alias("m")).filter("lo <> hi").select("bucket", "m")
        return materialize(active.join(_a_part(open_), ["bucket", "part"]), "neardup-open")

    known, active = None, members.withColumn("component", F.col("rep"))
    for place in (0, 1):
        hubs = _hubs(active, place).select("bucket", "part", F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.component").alias("c_a"), F.col("hub.bits").alias("bits_a"))
        pairs = active.join(hubs, ["bucket", "part"]).filter((F.col("rep") != F.col("a")) & reach).select("a", F.col("rep").alias("b")).distinct()
        found = confirmed(materialize(pairs, "neardup-pairs"))
        known = materialize(components(found), "neardup-known") if known is None else joined(found, known)
        active = still_open(known)

    # The rest: outside the largest component of each open group, against all of the group, block by block.
    sizes = active.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.sum("n_shingles").alias("volume"))
    per_group = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("m").alias("m"), F.sum("volume").alias("volume"))
    # A block is a bounded number of members, and of shingles in their sets.
    largest = _a_part(per_group.withColumn("blocks", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("volume") / BLOCK_VOLUME))))
    # Members come with their sizes and values alone; sets, each worked out once, go to the blocks whose pairs are left.
    full = active.join(largest.drop("m"), ["bucket", "part"]).join(reps.select("rep", "sig"), "rep")
    full = materialize(full.select("bucket", "band", "rep", "n_shingles", "component", "largest", "sig", "blocks"), "neardup-full")
    own, any_ = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    row = ["band", "rep", "n_shingles", "component", "largest", "sig"]
    outside = full.filter("component <> largest").select("bucket", own.alias("block_a"), any_.alias("block_b"), F.lit(0).alias("side"), *row)
    inside = full.select("bucket", any_.alias("block_a"), own.alias("block_b"), F.lit(1).alias("side"), *row)
    met = outside.unionByName(inside).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    schema = "bucket long, block_a long, block_b long, kind int, rep long, component long, others array<long>"
    rest = materialize(met.mapInArrow(_block_pruner(posterior_bounds(t, miss, hashes), percent, rows), schema), "neardup-rest")
    wanted = rest.filter("kind = 0")
    texts = needed.join(wanted.select("rep").distinct(), "rep", "left_semi")
    sets = materialize(texts.mapInArrow(_set_writer(shingle, lower), "rep long, members binary"), "neardup-sets")
    ready = wanted.join(sets, "rep").unionByName(rest.filter("kind = 1"), allowMissingColumns=True)
    ready = ready.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "kind", "rep")
    known = joined(materialize(ready.mapInArrow(_block_verifier(percent), "a long, b long"), "neardup-last-links"), known)

    # The first row of each component; a component may be large, so its rows are dealt over parts.
    placed = materialize(known.select(F.col("id").alias("rep"), "component").join(classes.select("rep", "first"), "rep"), "neardup-placed")
    leads = placed.groupBy("component").agg(F.min("first").alias("lead"))
    led = dealt_join(placed.select("rep", "component"), leads, "component", "rep").select("rep", "lead")
    per_class = classes.select("rep", "set_a", "set_b", "n_shingles", "first").join(led, "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("lead", "first").alias("lead"))
    keyed = sketch.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(per_class, ["set_a", "set_b", "n_shingles"], "left")
    return keyed.select("doc_id", "text_hash", "n_shingles", F.col("lead").isNotNull().alias("linked"), "lead")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, lower: bool = True, miss: float = 2e-5, rows: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents whose sets of word shingles overlap by percent of their union or more are linked; component_id is the
    least doc_id reachable. Equal sets are one class from the start. Bands of MinHash values bring candidate classes
    together in groups. Verification is sequential: the posterior probability that a pair reaches the threshold is
    bounded from batches of one bit a value while pairs are joined, then from batches of the values; a pair whose
    probability falls below miss is dropped, and survivors are confirmed on their full sets.

    A group of copies costs its size, not its square: two rounds compare each member with the group's first, then its
    second (by set size), and find the components so far. A third round takes the groups that still hold several
    components: their members outside the group's largest component meet all members of other components, block by block,
    each pair in the first group that it shares, on sizes and batches of the values; what is left is compared on full sets,
    which go once to each pair of blocks that needs them, and only links that join components leave it. So no pair of the groups
    is left out, and no step makes a row a pair. Large groups are dealt over parts in the first two rounds and over pairs of
    blocks in the third, so no group lands in one task.

    A null or wordless text has an empty set, links with nothing and is its own component. Rows that repeat a doc_id are
    placed by their own texts: each text is a document of its own. A row without doc_id links like any other; its
    component_id is the least doc_id reachable or null, and it is kept only where that is null. Texts of any length are
    read whole. Extra columns are ignored; an empty table gives no rows.
    """
    out = _classified(docs, shingle, percent, lower, miss, rows)
    component = F.when(F.col("linked"), F.col("lead.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True, miss: float = 2e-5, rows: int = 6) -> DataFrame:
    """docs with one row of each component of near_duplicates: that of the least doc_id (none last), then of the least hash
    of its text. Columns stay as they are.

    Rows that repeat a doc_id count by their own texts, so one that resembles nothing stays; of rows that repeat both
    doc_id and text one stays. Null and wordless texts resemble nothing and stay all, however often they come.
    """
    key = lambda id_, hash_: [F.coalesce(id_, F.lit(-(2**63))).alias("near_key"), hash_.alias("near_hash")]
    placed = _classified(docs, shingle, percent, lower, miss, rows).filter("linked")
    mine = placed.select(*key(F.col("doc_id"), F.col("text_hash")), (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("leads"))
    # A row a (doc_id, text) that goes, or that leads but comes more than once.
    known = materialize(mine.groupBy("near_key", "near_hash").agg(F.max("leads").alias("leads"), F.count(F.lit(1)).alias("n")).filter("not leads or n > 1"), "neardup-verdicts")
    rows_ = docs.select(F.struct(*docs.columns).alias("row"), *key(column(docs, "doc_id", "long"), F.xxhash64(column(docs, "text", "string"))))
    single = rows_.join(known.select("near_key", "near_hash"), ["near_key", "near_hash"], "left_anti").select("row.*")
    repeated = rows_.join(known.filter("leads").select("near_key", "near_hash"), ["near_key", "near_hash"])
    once = repeated.groupBy("near_key", "near_hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(once)
