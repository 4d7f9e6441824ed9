"""Streaming telemetry: counter deltas with keyed state, and daily usage kept up by foreachBatch."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.latest import latest_per_key
from ..operators.store import cut
from ..plans.usage import FACT, SUMS

#: Idle streams are forgotten after three days.
TTL_MS = 3 * 24 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget: bool) -> Iterator[pd.DataFrame]:
    """Remembers a stream's last value and start; a lower value or a new start is a reset and counts whole."""
    if state.hasTimedOut:
        state.remove()
        return
    value, started = state.get if state.exists else (None, None)
    out = []
    for pdf in batches:
        for at, v, s in zip(pdf["at"], pdf["value"], pdf["started"]):
            fresh = value is None or v < value or (s != 0 and s != started)
            out.append((key[0], at, max(0.0, v if fresh else v - value)))
            value, started = float(v), int(s)
    state.update((value, started))
    if forget:
        state.setTimeoutDuration(TTL_MS)
    yield pd.DataFrame(out, columns=["stream_key", "at", "delta"])


def counter_deltas(points: DataFrame, forget: bool = True) -> DataFrame:
    """(stream_key, at, delta) of a stream of (stream_key, at, value, started), in the order of arrival.

    forget: idle streams leave the state after TTL_MS. Such a query never runs dry, so bounded runs turn it off.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return points.groupBy("stream_key").applyInPandasWithState(lambda k, b, s: _advance(k, b, s, forget), "stream_key string, at timestamp, delta double", "value double, started long", "append", timeout)


def daily_usage(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(day, actor, tool, tokens) of a stream of (at, actor, tool, tokens), a row again for each change within the lateness."""
    w = events.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("w"), "actor", "tool")
    return w.agg(F.sum("tokens").alias("tokens")).select(F.to_date("w.start").alias("day"), "actor", "tool", "tokens")


_DAY_MS = 24 * 3600 * 1000
_FACT_SCHEMA = "actor string, tool string, period date, model string, " + ", ".join(f"{c} long" for c in SUMS) + ", sessions long, reported_cost double"


class _UsageFold(StatefulProcessor):
    """The state of one fact: its sums, and the exports that they hold. A timer at the end of the fact's day, in event time, drops
    both: what comes later is older than the watermark and doesn't get here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", ", ".join(f"{c} long" for c in SUMS) + ", sessions long, reported_cost double")
        self.exports = handle.getMapState("exports", "export_id string", "sessions long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).drop_duplicates(["export_id", "sample"])
        state = self.total.get() if self.total.exists() else None
        sums, sessions, cost = list(state[: len(SUMS)]) if state else [0] * len(SUMS), state[-2] if state else 0, state[-1] if state else None
        for export, part in batch.groupby("export_id", dropna=False):
            name = "" if pd.isna(export) else str(export)
            if self.exports.containsKey((name,)):
                continue
            here = int(part["session_id"].nunique())
            self.exports.updateValue((name,), (here,))
            sums = [a + int(part[c].fillna(0).sum()) for a, c in zip(sums, SUMS)]
            sessions = max(sessions, here)
            if part["reported_cost"].notna().any():
                cost = (cost or 0.0) + float(part["reported_cost"].sum())
        if state is None:
            day = pd.Timestamp(key[FACT.index("period")])
            self.handle.registerTimer(int(day.timestamp() * 1000) + _DAY_MS)
        self.total.update((*sums, sessions, cost))
        row = dict(zip(FACT, key)) | dict(zip(SUMS, sums)) | {"sessions": sessions, "reported_cost": cost}
        out = pd.DataFrame([row])
        yield out.astype({"reported_cost": "float64"})

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.total.clear()
        self.exports.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def usage_fold(samples: DataFrame, lateness: str = "2 days") -> DataFrame:
    """usage.folded of a stream of samples: a fact again, as it stands, whenever a batch changes it.

    Late, repeated and disordered exports end in the state that they would have in order, as long as they come within the lateness; an
    export must arrive whole, in one batch. The state needs the RocksDB provider:
    spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
    Prices are applied to the facts (usage.priced), which upsert_by keeps by FACT.
    """
    keyed = samples.withWatermark("at", lateness).withColumn("period", F.to_date("at"))
    return keyed.groupBy(*FACT).transformWithStateInPandas(_UsageFold(), outputStructType=_FACT_SCHEMA, outputMode="Update", timeMode="EventTime")


def upsert(table: str, keys: list[str], order: str):
    """A foreachBatch sink that keeps the newest row of each key in a Parquet table, in two folders by turns: for small tables, as each
    batch writes the table anew; upsert_by is for large ones.

    The new state is written whole beside the old before the pointer file moves, so a lost batch leaves the old one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pointer = f"{table}/current"
        try:
            now = spark.read.text(pointer).first()[0]
            old = spark.read.schema(batch.schema).parquet(f"{table}/{now}")
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            now, old = "b", spark.createDataFrame([], batch.schema)
        to = "a" if now == "b" else "b"
        latest_per_key(old.unionByName(batch), keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{table}/{to}")
        spark.createDataFrame([(to,)], "v string").coalesce(1).write.mode("overwrite").text(pointer)

    return write


def upsert_by(table: str, keys: list[str], order: str, partition: str):
    """As upsert, in a table partitioned by a column: a batch reads and writes only the partitions that it touches.

    What a partition will hold is written aside first, then takes its place. Merging keeps the newest row of each key, so a
    batch that is run again, over partitions old or new, ends in the same state. A key stays in its partition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch, "upsert-batch")
        try:
            old = spark.read.schema(batch.schema).parquet(table)
            touched = batch.select(partition).distinct()
            state = old.join(touched, partition, "left_semi").select(*batch.columns).unionByName(batch)
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = batch
        new = cut(latest_per_key(state, keys, [F.desc(order)]), "upsert-state")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)

    return write


def read_upserted(spark, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(table, spark.read.text(f"{table}/current").first()[0]))
