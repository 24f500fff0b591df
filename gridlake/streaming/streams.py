"""Structured Streaming forms of the batch operators (STR1-STR4).

* STR1 -- WIN8 on a stream: the row of the lowest row id per (site_id, ts)
  (``sealed_first_rows``); ``dedup_stream`` keeps the row that arrives first.
* STR2 -- FLT1 / FLT5 / FLT6 rule flags and quarantine, stateless.
* STR3 -- tumbling generation totals per site (``sealed_totals``).
* STR4 -- per-site state: previous value (lag 1 / ramp rate) and the bounded
  battery energy of ST2 (``sealed_series``).

*Sealed results.*  STR1 and STR3 are aggregates in append mode: a key leaves the state
with its result when the watermark has passed it, so the state holds the keys of the
watermark's delay and of one trigger, whatever the length of the stream.  STR4 keeps each
site's rows in time buckets in a RocksDB state store; a timer at a bucket's end releases
them in order when the watermark gets there, and only the last value and the energy stay.
``run_sealed`` drives a stream over everything available, then closes it: a marker row in
a source of its own moves the watermark past every key, and the query goes on from its
checkpoint, so nothing is left open.  It returns the table and a ``Report`` of the state.

*Late rows.*  Spark drops rows that are later than the watermark from its aggregates.
``corrected`` compares the sealed counts with the source's, aggregates the keys that
differ anew and leaves the others as they are.  ``sealed_series`` gets the late rows (its
time column carries no watermark of Spark's) and writes them beside the released ones;
sites that have any are worked out again by the batch operators from those two.  So the
result equals the batch for any order of arrival, and a watermark that is wide enough
makes the correction empty.

Plain ``run_available_now`` and ``run_update`` raise ``LateRows`` when rows were dropped,
unless the caller allows them.

Streams read Parquet files with a fixed schema.  Event time must be
TIMESTAMP (not TIMESTAMP_NTZ) for a watermark; ``to_event_time`` maps the
wall clock to the instant with the same UTC reading and ``from_event_time``
maps back, so results do not depend on the session time zone.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from gridlake.config import scratch_path
from gridlake.functions.exprs import from_event_time, to_event_time
from gridlake.operators.stateful import soc_balance
from gridlake.operators.telemetry import PARAMS, GridParams
from gridlake.operators.validate import quarantine
from gridlake.plans.materialize import join_small, materialize
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, windowed


def stream_path(path: str) -> str:
    """``path`` as a pattern that matches it alone.  A file source takes the plain name of
    one file for a folder to find partitions in, and fails; a pattern is only listed, and
    matches a file as well as a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def read_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "ts",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream with ``ts`` turned into event time (``to_event_time``:
    the wall clock read as UTC, whatever the session time zone)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).withColumn(ts, to_event_time(ts))


class LateRows(RuntimeError):
    """A stream dropped rows that were later than its watermark."""


def _check_late(query, late: str) -> None:
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress
                  for op in (p["stateOperators"] if isinstance(p, dict) else []))
    if dropped and late != "allow":
        raise LateRows(f"{dropped} rows were later than the watermark; widen it or pass late='allow'")


def first_rows(df: DataFrame, key=("site_id", "ts"), order: str = "row_id") -> DataFrame:
    """STR1, complete: the row of the smallest ``order`` per key, as an updating
    aggregate (run it with ``run_update``)."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def dedup_stream(df: DataFrame, watermark: str = "2 hours", key=("site_id", "ts"), ts: str = "ts") -> DataFrame:
    """STR1."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))


def rule_stream(df: DataFrame, rules) -> DataFrame:
    """STR2: rows breaking a rule, with the names of the rules broken."""
    return quarantine(df, rules)


def window_totals(df: DataFrame, value_cols, window: str = "1 hour", watermark: str | None = "2 hours",
                  key=("site_id",), ts: str = "ts") -> DataFrame:
    """STR3: per key and tumbling window -- count, sum and mean of each value.
    Without a watermark every window stays open, so no row is ever too late."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in value_cols:
        aggs += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean")]
    timed = df.withWatermark(ts, watermark) if watermark else df
    return (timed
              .groupBy(*key, F.window(ts, window).alias("window"))
              .agg(*aggs)
              .select(*key, from_event_time(F.col("window.start")).alias("window_start"),
                      from_event_time(F.col("window.end")).alias("window_end"), "n",
                      *[f"{c}_{s}" for c in value_cols for s in ("sum", "mean")]))


# --- sealed results -----------------------------------------------------------

#: Event time of the row that closes a stream: later than any watermark will ask for.
END_OF_STREAM = "2200-01-01 00:00:00"


@dataclass(frozen=True)
class Report:
    """What a sealed run has to tell of its state: rows read, rows that Spark dropped as
    late, and the largest and the last number of rows in the state."""

    rows: int
    dropped: int
    largest_state: int
    last_state: int


class Markers:
    """A source beside a stream that holds nothing until the stream is closed."""

    def __init__(self, spark: SparkSession, schema: StructType, ts: str = "ts"):
        self.spark, self.schema, self.ts, self.path = spark, schema, ts, scratch_path(spark, "stream-end")
        spark.createDataFrame([], schema).write.parquet(self.path)

    def beside(self, rows: DataFrame) -> DataFrame:
        return rows.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def close(self) -> None:
        end = [F.lit(END_OF_STREAM).cast(f.dataType).alias(f.name) if f.name == self.ts
               else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*end).write.mode("append").parquet(self.path)


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_sealed(rows: DataFrame, seal: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts") -> tuple[DataFrame, Report]:
    """Drive ``seal(rows)`` over everything available, close the stream and drive it to its
    end; returns the sealed table and the report."""
    spark = rows.sparkSession
    out, markers = scratch_path(spark, f"stream-{name}"), Markers(spark, rows.schema, ts)
    read = dropped = largest = last = 0
    with rocksdb(spark):
        for closing in (False, True):
            if closing:
                markers.close()
            query = (seal(markers.beside(rows)).writeStream.format("parquet").outputMode("append")
                     .option("checkpointLocation", out + "/_checkpoint").option("path", out + "/data")
                     .trigger(availableNow=True).start())
            query.awaitTermination()
            for p in query.recentProgress:
                state = p["stateOperators"][0]
                read += p["numInputRows"]
                dropped += state["numRowsDroppedByWatermark"]
                largest, last = max(largest, state["numRowsTotal"]), state["numRowsTotal"]
    return spark.read.parquet(out + "/data"), Report(read - 1, dropped, largest, last)


def corrected(sealed: DataFrame, report: Report, source: DataFrame, key: list[str],
              whole: Callable[[DataFrame], DataFrame], n: str = "n") -> DataFrame:
    """The sealed rows, with those keys worked out again from ``source`` (``whole``) whose
    number of rows is not the source's.  Without dropped rows there are none."""
    if not report.dropped:
        return sealed
    def names(df):
        return df.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(n).alias("_n"))
    counts = source.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"))
    known = names(sealed)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    wrong = materialize(counts.join(known, on, "left").where("_n is null or _n <> _all").select(*key), "late-keys")
    wrong = wrong.select(*[F.col(k).alias(f"_{k}") for k in key])
    again = whole(source.join(wrong, on, "left_semi"))
    return sealed.join(wrong, on, "left_anti").unionByName(again)


def _first_rows(df: DataFrame, key, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return (df.groupBy(*key).agg(first, F.count(F.lit(1)).alias("n"))
              .select(*key, "n", *[F.col(f"_row.{c}").alias(c) for c in rest]))


def sealed_first_rows(rows: DataFrame, source: DataFrame, watermark: str = "2 hours", key=("site_id", "ts"),
                      order: str = "row_id", ts: str = "ts") -> tuple[DataFrame, Report]:
    """STR1: per key the row of the smallest ``order``, and the number ``n`` of its rows.
    ``source`` are the stream's rows as a table, read only if rows came late."""
    key = list(key)
    sealed, report = run_sealed(rows, lambda df: _first_rows(df.withWatermark(ts, watermark), key, order), "first", ts)
    return corrected(sealed, report, source, key, lambda df: _first_rows(df, key, order)), report


def _totals(df: DataFrame, value_cols, window: str, key, ts: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in value_cols:
        aggs += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean")]
    return (df.groupBy(*key, F.window(ts, window).alias("window")).agg(*aggs)
              .select(*key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n",
                      *[f"{c}_{s}" for c in value_cols for s in ("sum", "mean")]))


def sealed_totals(rows: DataFrame, source: DataFrame, value_cols, window: str = "1 hour", watermark: str = "2 hours",
                  key=("site_id",), ts: str = "ts") -> tuple[DataFrame, Report]:
    """STR3: per key and tumbling window -- count, sum and mean of each value, emitted when
    the watermark has passed the window and corrected for late rows."""
    key = list(key)
    sealed, report = run_sealed(rows, lambda df: _totals(df.withWatermark(ts, watermark), value_cols, window, key, ts),
                                "totals", ts)
    placed = source.withColumn("window_start", F.window(ts, window)["start"])
    out = corrected(sealed, report, placed, [*key, "window_start"],
                    lambda df: _totals(df.drop("window_start"), value_cols, window, key, ts))
    return (out.withColumn("window_start", from_event_time("window_start"))
               .withColumn("window_end", from_event_time("window_end"))), report


def bounded_sums(steps: np.ndarray, lo: float, hi: float, start: float) -> np.ndarray:
    """``x = clip(x + step, lo, hi)`` after every step: each step is a shift and two bounds,
    and two of them one after the other are again such a map."""
    shift, low, high = steps.astype(float), np.full(len(steps), lo), np.full(len(steps), hi)
    width = 1
    while width < len(steps):
        s, a, b = shift[width:], low[width:], high[width:]
        low[width:], high[width:], shift[width:] = (np.clip(low[:-width] + s, a, b), np.clip(high[:-width] + s, a, b),
                                                    shift[:-width] + s)
        width *= 2
    return np.clip(start + shift, low, high)


_ROW = np.dtype([("t", "<i8"), ("row_id", "<i8"), ("value", "<f8"), ("power", "<f8")])


class SeriesState(StatefulProcessor):
    """One site: its rows by time bucket until the watermark has passed the bucket, then
    the last value and the energy after its last released row."""

    def __init__(self, bucket_ms: int, p: GridParams):
        self.bucket_ms, self.p = bucket_ms, p

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.last = handle.getValueState("last", "value double, energy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # the marker of the stream's end (a null key may come as NaN)
            for _ in rows:
                pass
            return
        sealed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            new = np.empty(len(frame), _ROW)
            for c in _ROW.names:
                new[c] = frame[c]
            bucket = new["t"] // (1000 * self.bucket_ms)
            late = (bucket + 1) * self.bucket_ms <= sealed
            if late.any():
                yield self._frame(key[0], new[late], "late")
            for b in np.unique(bucket[~late]).tolist():
                held = self.waiting.getValue((b,)) if self.waiting.containsKey((b,)) else (b"",)
                self.waiting.updateValue((b,), (bytes(held[0]) + new[bucket == b].tobytes(),))
                self.handle.registerTimer((b + 1) * self.bucket_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = (expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms - 1,)
        rows = np.sort(np.frombuffer(bytes(self.waiting.getValue(bucket)[0]), _ROW), order=["t", "row_id"])
        self.waiting.removeKey(bucket)
        p, known = self.p, self.last.exists()
        value, energy = self.last.get() if known else (None, p.soc_initial * p.battery_kwh)
        x, power = rows["value"], rows["power"]
        charge = np.where(np.isnan(power), p.battery_kw, np.minimum(-power, p.battery_kw)) * p.dt_hours * p.efficiency
        steps = np.where(power > 0, -(np.minimum(power, p.battery_kw) * p.dt_hours / p.efficiency), charge)
        level = bounded_sums(steps, p.soc_min * p.battery_kwh, p.soc_max * p.battery_kwh, energy)
        before = np.concatenate([[np.nan if value is None else value], x[:-1]])
        self.last.update((None if np.isnan(x[-1]) else float(x[-1]), float(level[-1])))
        yield self._frame(key[0], rows, "row", before, x - before, level)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(site, rows, kind, lag=np.nan, ramp=np.nan, energy=np.nan) -> pd.DataFrame:
        out = pd.DataFrame({c: rows[c] for c in _ROW.names})
        out.insert(0, "site_id", np.int32(site))
        return out.assign(kind=kind, lag_1=lag, ramp=ramp, energy_kwh=energy)


_SERIES = ("site_id int, t long, row_id long, value double, power double, kind string, lag_1 double, ramp double, "
           "energy_kwh double")


def sealed_series(rows: DataFrame, value: str, power: str, watermark: str = "2 hours", bucket_minutes: int = 60,
                  p: GridParams = PARAMS, spec: SeriesSpec = DEFAULT_SPEC, ts: str = "ts") -> tuple[DataFrame, Report]:
    """STR4: ``{value}_lag_1``, ``{value}_ramp`` and the battery energy of ST2 per site."""

    def seal(df):
        # a number, not the column of the watermark: late rows are to come through
        timed = df.withWatermark(ts, watermark).select("site_id", F.unix_micros(ts).alias("t"),
                                                       F.coalesce("row_id", F.lit(-1)).alias("row_id"),
                                                       F.col(value).alias("value"), F.col(power).alias("power"))
        return timed.groupBy("site_id").transformWithStateInPandas(
            SeriesState(bucket_minutes * 60_000, p), _SERIES, "Append", "EventTime")

    out, report = run_sealed(rows, seal, "series", ts)
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    out = out.select("site_id", from_event_time(F.timestamp_micros("t")).alias("ts"), "row_id", "kind",
                     *[nan(c) for c in ("value", "power", "lag_1", "ramp", "energy_kwh")])
    late = materialize(out.where("kind = 'late'").groupBy("site_id").agg(F.count(F.lit(1)).alias("n_late")), "late-sites")
    n_late = late.agg(F.sum("n_late")).first()[0] or 0
    if n_late:
        marked = join_small(out, late, "site_id", name="late-sites")
        whole = marked.where("n_late is not null").select("site_id", "ts", "row_id", "value", "power")
        whole = windowed(whole, lambda w: {"lag_1": F.lag("value", 1).over(w)}, halo=1, spec=spec)
        whole = soc_balance(whole.withColumn("ramp", F.col("value") - F.col("lag_1")), "power", p, spec)
        out = marked.where("n_late is null").unionByName(whole, allowMissingColumns=True)
    out = out.select("site_id", "ts", "row_id", F.col("value").alias(value), F.col("power").alias(power),
                     F.col("lag_1").alias(f"{value}_lag_1"), F.col("ramp").alias(f"{value}_ramp"), "energy_kwh")
    return out, Report(report.rows, n_late, report.largest_state, report.last_state)


def run_available_now(df: DataFrame, name: str, output_mode: str = "append",
                      fmt: str = "parquet", late: str = "error") -> DataFrame:
    """Drive a stream over everything available now into a table below
    ``spark.checkpoint.dir`` (with its own checkpoint location, so a restart
    resumes exactly-once) and return the table as a batch DataFrame."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.format(fmt).outputMode(output_mode)
           .option("checkpointLocation", out + "/_checkpoint")
           .option("path", out + "/data")
           .trigger(availableNow=True).start())
    q.awaitTermination()
    _check_late(q, late)
    return spark.read.format(fmt).load(out + "/data")


def run_update(df: DataFrame, key: list[str], name: str, late: str = "error") -> DataFrame:
    """Drive an aggregating stream in update mode (the watermark evicts
    closed windows from state) over everything available now.  Every
    micro-batch appends its changed rows with the batch id; the final table
    keeps the latest version of each key -- append-only writes plus one
    aggregate, no driver-side collection."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out + "/data")

    q = (df.writeStream.outputMode("update").foreachBatch(write)
           .option("checkpointLocation", out + "/_checkpoint")
           .trigger(availableNow=True).start())
    q.awaitTermination()
    _check_late(q, late)
    versions = spark.read.parquet(out + "/data")
    cols = [c for c in versions.columns if c != "_epoch"]
    latest = versions.groupBy(*key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols if c not in key]), F.col("_epoch")).alias("_v"))
    return latest.select(*key, "_v.*")
