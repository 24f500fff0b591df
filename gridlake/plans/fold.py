"""Recurrences along a series, evaluated chunk-parallel.

A bounded running balance ``x_t = clamp(x_{t-1} + a_t, lo_t, hi_t)`` is a
composition of clamp maps, and clamp maps compose into clamp maps:

    (a1, lo1, hi1) then (a2, lo2, hi2)
      = (a1 + a2, clamp(lo1 + a2, lo2, hi2), clamp(hi1 + a2, lo2, hi2))

Affine maps ``x -> m x + b`` (low-pass filters) compose as well.  So:

1. every chunk of at most ``chunk_rows`` rows folds its steps into one map;
2. the maps of one key, a table of rows / chunk_rows rows, are scanned in
   order to give each chunk its starting state;
3. every chunk replays its rows from that state, in parallel.

Steps 1 and 3 read the sorted rows of a partition batch by batch
(``mapInArrow``) and carry the chunk's state from batch to batch, so Python
holds one Arrow batch whatever the chunk's size and the skew; columns that
the recurrence does not use pass through as they are.
A recurrence that does not compose but is monotone with a bounded state
(the ramp-limited follower) runs chunk-parallel by coupling from both ends
(``monotone_scan``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridlake.plans.materialize import join_small, materialize
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, known_largest, number_rows


def clamp_prefixes(a, lo, hi):
    """Maps of all prefixes of clamp steps, ``x -> clip(x + A, L, H)``, by doubling:
    log2(n) vector passes."""
    A, L, H = (np.array(v, dtype=float) for v in (a, lo, hi))
    d = 1
    while d < len(A):
        L[d:], H[d:], A[d:] = (np.clip(L[:-d] + A[d:], L[d:], H[d:]), np.clip(H[:-d] + A[d:], L[d:], H[d:]),
                               A[:-d] + A[d:])
        d *= 2
    return A, L, H


def affine_prefixes(m, b):
    """Maps of all prefixes of affine steps, ``x -> M x + B``, by doubling."""
    M, B = np.array(m, dtype=float), np.array(b, dtype=float)
    d = 1
    while d < len(M):
        B[d:], M[d:] = M[d:] * B[:-d] + B[d:], M[d:] * M[:-d]
        d *= 2
    return M, B


def _states_before(after, x0: float):
    """State before each step: the one after the step before."""
    return np.concatenate([[x0], after[:-1]]) if len(after) else after


def _chunked(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, bool]:
    """``(rows with rn, _chunk and _first, every series is one chunk)``.  Rows are numbered
    here whatever number they came with; with one chunk per series the compose and
    scan passes are skipped.  Numbers are dense, so each chunk has one ``_first`` row."""
    numbered = number_rows(df, spec)
    bound = known_largest(numbered, spec)
    n = F.lit(spec.chunk_rows)
    if bound is not None and bound <= spec.chunk_rows:
        return (numbered.withColumn("_chunk", F.lit(0).cast("bigint"))
                        .withColumn("_first", F.col("rn") == 0)), True
    return (numbered.withColumn("_chunk", F.floor(F.col("rn") / n).cast("bigint"))
                    .withColumn("_first", F.col("rn") % n == 0)), False


def _in_order(d: DataFrame, key: list[str], one_chunk: bool = False) -> DataFrame:
    """The rows of a chunk next to each other in one partition, by ``rn``; the sort
    spills in the JVM.  One chunk per series is already dealt by the numbering window."""
    if not one_chunk:
        d = d.repartition(*key, "_chunk")
    return d.sortWithinPartitions(*key, "_chunk", "rn")


def _doubles(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    """Columns as floats, NULL as NaN."""
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, opens its chunk)`` of the batch's stretches of one chunk each."""
    first = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
    cuts = first[first > 0].tolist() + [batch.num_rows]
    start, opens = 0, bool(len(first) and first[0] == 0)
    for end in cuts:
        yield start, end, opens
        start, opens = end, True


def _summaries(rows: DataFrame, key: list[str], inputs: list[str], names: list[str],
               fold: Callable[[tuple | None, list[np.ndarray]], tuple], close: Callable = tuple) -> DataFrame:
    """One row per chunk: its key, ``_chunk`` and the values ``names`` (doubles) of
    ``close(state)``, where ``fold(state, columns)`` takes the state (None at first)
    over each stretch of the chunk's rows in turn."""
    ids = [*key, "_chunk"]
    narrow = _in_order(rows.select(*ids, "rn", "_first", *inputs), key)
    fields = [rows.schema[k] for k in ids] + [StructField(n, DoubleType()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tags, states):
            t = pa.Table.from_batches(tags).combine_chunks()
            for i, n in enumerate(names):
                t = t.append_column(n, pa.array([s[i] for s in states], pa.float64(), from_pandas=True))
            return t.to_batches()

        tag, state = None, None  # of the chunk that is not ended yet
        for batch in batches:
            if not batch.num_rows:
                continue
            tags, states = [], []
            cols, key_cols = _doubles(batch, inputs), batch.select(ids)
            for start, end, opens in _stretches(batch):
                if opens and tag is not None:
                    tags.append(tag)
                    states.append(close(state))
                state = fold(None if opens else state, [v[start:end] for v in cols])
                tag = key_cols.slice(end - 1, 1)
            if tags:
                yield from out(tags, states)
            # a copy of the one row: a slice would keep its whole batch
            tag = tag.take(pa.array([0]))
        if tag is not None:
            yield from out([tag], [close(state)])

    return narrow.mapInArrow(run, StructType(fields))


def _replay(rows: DataFrame, key: list[str], one_chunk: bool, inputs: list[str], names: list[str],
            states: Callable[[float, list[np.ndarray]], tuple[list[np.ndarray], float]], drop: list[str]) -> DataFrame:
    """``rows`` without ``drop``, with the columns ``names``: ``states(x, columns)`` gives
    them over a stretch that begins in state ``x``, and the state after it.  A chunk's
    first row carries its ``_start``."""
    kept = [f for f in rows.schema.fields if f.name not in drop]
    fields = kept + [StructField(n, DoubleType()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            start_col, *cols = _doubles(batch, ["_start", *inputs])
            parts = []
            for start, end, opens in _stretches(batch):
                if opens:
                    x = float(start_col[start])
                values, x = states(x, [v[start:end] for v in cols])
                parts.append(values)
            made = [pa.array(np.concatenate(v), pa.float64(), from_pandas=True) for v in zip(*parts)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made,
                                             [f.name for f in fields])

    return _in_order(rows, key, one_chunk).mapInArrow(run, StructType(fields))


def _scan_chunks(summary: DataFrame, key: list[str], x0: float) -> DataFrame:
    """Starting state of every chunk from the per-chunk maps (one small group
    per key: rows / chunk_rows entries)."""
    fields = [summary.schema[k] for k in key] + [StructField("_chunk", summary.schema["_chunk"].dataType),
                                                 StructField("_start", DoubleType())]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        A, L, H = clamp_prefixes(pdf["_A"], pdf["_L"], pdf["_H"])
        starts = _states_before(np.clip(x0 + A, L, H), x0)
        out = pdf[key + ["_chunk"]].copy()
        out["_start"] = starts
        return out

    return summary.groupBy(*key).applyInPandas(scan, StructType(fields))


def clamp_scan(df: DataFrame, step: str, lo, hi, x0: float, spec: SeriesSpec = DEFAULT_SPEC,
               out: str = "state") -> DataFrame:
    """``out = clamp(prev + step, lo, hi)`` along each series, starting from
    ``x0``; also returns ``{out}_before``.  ``lo`` / ``hi`` are constants or
    column names; NULL steps count as 0."""
    key = list(spec.key)
    lo_c = F.col(lo) if isinstance(lo, str) else F.lit(float(lo))
    hi_c = F.col(hi) if isinstance(hi, str) else F.lit(float(hi))
    rows, one_chunk = _chunked(df, spec)
    d = (rows
         .withColumn("_a", F.coalesce(F.col(step).cast("double"), F.lit(0.0)))
         .withColumn("_lo", lo_c.cast("double")).withColumn("_hi", hi_c.cast("double")))

    def compose(state, values):
        a, lo, hi = (v[-1] for v in clamp_prefixes(*values))
        if state is None:
            return a, lo, hi
        A, L, H = state
        return A + a, np.clip(L + a, lo, hi), np.clip(H + a, lo, hi)

    if one_chunk:
        j = d.withColumn("_start", F.lit(float(x0)))
    else:
        summary = _summaries(d, key, ["_a", "_lo", "_hi"], ["_A", "_L", "_H"], compose)
        starts = _scan_chunks(summary, key, x0)
        j = join_small(d, starts, key + ["_chunk"], "left", name="fold_starts")

    def states(x, values):
        A, L, H = clamp_prefixes(*values)
        after = np.clip(x + A, L, H)
        return [_states_before(after, x), after], float(after[-1])

    return _replay(j, key, one_chunk, ["_a", "_lo", "_hi"], [f"{out}_before", out], states,
                   ["_chunk", "_first", "_a", "_lo", "_hi", "_start"])


def affine_scan(df: DataFrame, mult: str, add: str, x0_col: str | None = None, x0: float = 0.0,
                spec: SeriesSpec = DEFAULT_SPEC, out: str = "state") -> DataFrame:
    """``out = mult * prev + add`` along each series.  The start is ``x0``,
    or the value of ``x0_col`` on the first row of the series."""
    key = list(spec.key)
    rows, one_chunk = _chunked(df, spec)
    d = (rows
         .withColumn("_m", F.col(mult).cast("double")).withColumn("_b", F.col(add).cast("double")))
    if x0_col is not None:
        # only read on the first row; a series without a key has no start
        keyed = reduce(and_, [F.col(k).isNotNull() for k in key])
        d = (d.withColumn("_x0", F.when(keyed, F.col(x0_col).cast("double")))
              .select(*key, *[c for c in d.columns if c not in key], "_x0"))
    else:
        d = d.withColumn("_x0", F.lit(float(x0)))

    def compose(state, values):
        m, b, first = values
        m, b = (v[-1] for v in affine_prefixes(m, b))
        if state is None:
            return m, b, first[0]
        M, B, X0 = state
        return m * M, m * B + b, X0

    fields = [d.schema[k] for k in key] + [StructField("_chunk", d.schema["_chunk"].dataType),
                                           StructField("_start", DoubleType())]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        x = float(pdf["_X0"].iloc[0])
        M, B = affine_prefixes(pdf["_M"], pdf["_B"])
        starts = _states_before(M * x + B, x)
        res = pdf[key + ["_chunk"]].copy()
        res["_start"] = starts
        return res

    if one_chunk:
        j = d.withColumn("_start", F.col("_x0"))
    else:
        summary = _summaries(d, key, ["_m", "_b", "_x0"], ["_M", "_B", "_X0"], compose)
        starts = summary.groupBy(*key).applyInPandas(scan, StructType(fields))
        j = join_small(d, starts, key + ["_chunk"], "left", name="fold_starts")

    def states(x, values):
        M, B = affine_prefixes(*values)
        after = M * x + B
        return [after], float(after[-1])

    return _replay(j, key, one_chunk, ["_m", "_b"], [out], states,
                   ["_chunk", "_first", "_m", "_b", "_start", "_x0"])


def follow(step: Callable, cols: dict, x0: float, lo: float, hi: float) -> np.ndarray:
    """All states of a monotone recurrence with states in [lo, hi], started at ``x0``.

    The rows are laid out as about sqrt(n) stretches that are stepped side by side, from
    ``lo`` and from ``hi``; where the two meet, a stretch's end is known without its
    start.  Only stretches that do not meet are run one after the other.  Then all
    stretches are stepped side by side from their true starts.  ``step`` takes arrays."""
    n = len(next(iter(cols.values())))
    size = max(1, int(np.sqrt(n)))
    m = -(-n // size)
    grid = {c: np.concatenate([v, np.full(m * size - n, np.nan)]).reshape(m, size) for c, v in cols.items()}
    low, high = np.full(m, float(lo)), np.full(m, float(hi))
    for j in range(size):
        row = {c: v[:, j] for c, v in grid.items()}
        low, high = step(low, row), step(high, row)
    starts = np.empty(m)
    x = float(x0)
    for i in range(m):
        starts[i] = x
        if low[i] == high[i]:
            x = low[i]
        elif i + 1 < m:
            y = np.array([x])
            for j in range(size):
                y = step(y, {c: v[i:i + 1, j] for c, v in grid.items()})
            x = float(y[0])
    out = np.empty((m, size))
    state = starts
    for j in range(size):
        state = step(state, {c: v[:, j] for c, v in grid.items()})
        out[:, j] = state
    return out.ravel()[:n]


def monotone_scan(df: DataFrame, step: Callable[[np.ndarray, dict], np.ndarray], inputs: list[str],
                  x0: float, lo: float, hi: float, spec: SeriesSpec = DEFAULT_SPEC,
                  out: str = "state", holds: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Chunk-parallel evaluation of ``x = step(x, row)`` when every step is
    monotone (order-preserving in ``x``) and keeps the state in [lo, hi].

    Coupling from both ends: each chunk runs the trajectories that start at
    ``lo`` and at ``hi`` (chunks in parallel).  The
    true trajectory lies between them; where they meet it is known exactly,
    whatever the chunk's start, and so is the chunk's end state.  Only a
    chunk whose two trajectories never meet needs its true start before its
    end is known; such chunks are replayed in rounds (each round resolves
    the first unresolved chunk of every run of them), then every chunk
    replays its rows from its exact start.  ``holds`` (columns -> mask) tells
    which rows leave any state as it is; a chunk of such rows only passes its
    start on and needs no round.  Rounds go on until nothing is pending: each
    resolves at least one chunk of every run.  Typical series meet within a few
    steps of each chunk, so one round suffices; Python holds one batch of
    rows and the driver only sees per-chunk summaries.
    """
    key = list(spec.key)
    d, one_chunk = _chunked(df, spec)
    keep = key + ["_chunk", "rn", "_first"] + list(inputs)
    chunk_t = d.schema["_chunk"].dataType

    def run(x, values):
        after = follow(step, dict(zip(inputs, values)), x, lo, hi)
        return [after], float(after[-1])

    def couple(state, values):
        """Ends of the trajectories from both bounds; whether all rows so far hold."""
        low, high, passes = state or (float(lo), float(hi), True)
        if holds is not None and holds(dict(zip(inputs, values))).all():
            return low, high, passes
        met = low == high
        low = run(low, values)[1]
        return low, low if met else run(high, values)[1], False

    def summarise(state):
        low, high, passes = state
        met = low == high
        return (-1.0, np.nan) if passes else (float(met), low if met else np.nan)

    if one_chunk:
        return _replay(d.withColumn("_start", F.lit(float(x0))), key, True, inputs, [out], run,
                       ["_chunk", "_first", "_start"])

    data = materialize(d.select(*keep), "monotone_input")
    summary = materialize(_summaries(data, key, inputs, ["_met", "_end"], couple, summarise),
                          "monotone_summary")

    start_fields = [d.schema[k] for k in key] + [StructField("_chunk", chunk_t),
                                                 StructField("_start", DoubleType()),
                                                 StructField("_pending", DoubleType())]

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        """Starts known so far; ``_pending`` marks an unmet chunk whose start
        is known but whose end still needs a replay."""
        pdf = pdf.sort_values("_chunk")
        x, starts, pending = x0, [], []
        for met, end, known_end in zip(pdf["_met"], pdf["_end"], pdf["_known_end"]):
            starts.append(x)
            if met < 0:  # passes its start on
                pending.append(0.0)
            elif met:
                pending.append(0.0)
                x = end
            elif not np.isnan(known_end):
                pending.append(0.0)
                x = known_end
            else:
                pending.append(0.0 if np.isnan(x) else 1.0)
                x = np.nan
        res = pdf[key + ["_chunk"]].copy()
        res["_start"] = starts
        res["_pending"] = pending
        return res

    end_fields = [d.schema[k] for k in key] + [StructField("_chunk", chunk_t),
                                               StructField("_known_end", DoubleType())]

    def replay_end(state, values):
        start, *values = values  # the chunk's start, on every row
        return (run(start[0] if state is None else state[0], values)[1],)

    spark = df.sparkSession
    known = spark.createDataFrame([], StructType(end_fields))
    while True:
        table = summary.join(known, key + ["_chunk"], "left").fillna(np.nan, ["_known_end"])
        starts = materialize(table.groupBy(*key).applyInPandas(resolve, StructType(start_fields)),
                             "monotone_starts")
        pending = starts.where(F.col("_pending") > 0)
        if pending.limit(1).count() == 0:
            break
        todo = join_small(data, pending.select(*key, "_chunk", "_start"), key + ["_chunk"], "inner",
                          name="monotone_pending")
        ends = _summaries(todo, key, ["_start", *inputs], ["_known_end"], replay_end)
        known = materialize(known.unionByName(ends), "monotone_known")

    j = join_small(d, starts.select(*key, "_chunk", "_start"), key + ["_chunk"], "left",
                   name="monotone_final")
    return _replay(j, key, False, inputs, [out], run, ["_chunk", "_first", "_start"])
