"""Telemetry folded from a stream and from a table: late, repeated and disordered exports end in one state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.plans import usage
from tallyforge.streaming import telemetry

SCHEMA = "at timestamp, actor string, tool string, model string, export_id string, sample int, session_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, requests long, reported_cost double"


def samples(seed=0, exports=14):
    r = np.random.default_rng(seed)
    rows = []
    for e in range(exports):
        for i in range(int(r.integers(1, 6))):
            at = dt.datetime(2025, 3, 1 + int(r.integers(0, 3)), int(r.integers(0, 24)))
            rows.append((at, f"a{r.integers(0, 3)}", "cli", f"m{r.integers(0, 2)}", f"e{e}", i, None if r.random() < 0.2 else f"s{r.integers(0, 4)}", *[int(x) for x in r.integers(0, 50, 4)], 1, float(r.integers(1, 9)) if e % 2 else None))
    return rows


def plain(rows):
    seen, facts = set(), {}
    for r in rows:
        if (r[4], r[5]) in seen:
            continue
        seen.add((r[4], r[5]))
        f = facts.setdefault((r[1], r[2], r[0].date(), r[3]), {"sums": [0] * 5, "sessions": {}, "cost": None})
        f["sums"] = [a + b for a, b in zip(f["sums"], r[7:12])]
        f["sessions"].setdefault(r[4], set()).update({r[6]} - {None})
        f["cost"] = f["cost"] if r[12] is None else (f["cost"] or 0) + r[12]
    return sorted((*k, *f["sums"], max(len(s) for s in f["sessions"].values()), f["cost"]) for k, f in facts.items())


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*usage.FACT, *usage.SUMS, "sessions", "reported_cost").collect())


def test_fold_of_a_table(spark):
    rows = samples()
    twice = spark.createDataFrame(rows + rows[:9] + rows[-4:], SCHEMA)
    assert as_rows(usage.folded(twice)) == plain(rows)
    assert usage.folded(twice.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_of_a_stream(spark, tmp_path, seed):
    rows = samples(seed)
    exports = sorted({r[4] for r in rows})
    r = np.random.default_rng(seed)
    order = [*r.permutation(exports), *r.choice(exports, 5)]
    batches = [[x for x in rows if x[4] in order[i : i + 4]] for i in range(0, len(order), 4)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        table = str(tmp_path / "facts")
        write = telemetry.upsert_by(table, usage.FACT, "tokens_at", "period")
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = telemetry.usage_fold(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "30 days")
            stamped = stream.withColumn("tokens_at", F.lit(i))
            q = stamped.writeStream.foreachBatch(lambda b, n: write(b, n)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
            q.awaitTermination(120)
        kept = spark.read.parquet(table)
        assert as_rows(kept) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
