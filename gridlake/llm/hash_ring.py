"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of the ring.  A key belongs to the shard of
the first point at or after its hash; when that shard is full the key walks on
clockwise to the next shard with room.  Capacities are the shard quotas, so the
balance is exact: row counts differ by at most one.

The walk needs only how many keys lie on each arc (shards x virtual counters, whatever the
data): that plan is computed once and comes back as a table of rank ranges per arc, and
each row finds its range by its rank in the arc.  Ranks come from a range sort over all
rows, with their place in the table as the last criterion, so that one key may hold any
share of them.  DataFrame functions only on the rows.

Defined results: a null text has size 16 and CRC 0; a null key is placed by its
text; repeated rows are placed one by one; an empty table gives an empty result;
extra columns pass through ``assign``, those called ``shard`` or ``slot`` (or like a column
of the numbering) as ``<name>_in``.  Rows are ordered in their arc by (hash, key, text checksum, size), so a row
moves only when its arc's quota changes; among rows equal in all of these the order is free.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.llm.tables import cut, fresh, set_aside, table
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import SeriesSpec, number_rows

SHARDS, VIRTUAL = 40, 64
SPACE = 1 << 32


def ring_points(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    nodes = (spark.range(shards).select(F.col("id").alias("shard"),
                                        F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
                  .select(position(F.lit("node"), "shard", "v").alias("p"), "shard"))
    return sorted((r.p, r.shard) for r in nodes.collect())  # shards x virtual rows


def position(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SPACE))


def bounded_walk(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges ``(arc, first, last, shard, slot)``.

    First every arc fills its own shard in ring order; what does not fit then
    continues clockwise from its arc to shards with room.  ``slot`` is the shard's
    row number of the range's first row.
    """
    room, filled, plan, rest = list(capacity), [0] * len(capacity), [], []

    def place(arc, first, n, shard):
        take = min(n, room[shard])
        if take:
            plan.append((arc, first, first + take - 1, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
        return take

    for arc, owner in enumerate(owners):
        n = counts.get(arc, 0)
        took = place(arc, 0, n, owner)
        if took < n:
            rest.append((arc, took, n - took))
    for arc, first, n in rest:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            took = place(arc, first, n, owners[at])
            first, n = first + took, n - took
    return plan


def assign(rows: DataFrame, key: Column, weight: Column, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """``rows`` plus ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``key`` places a row on the ring, ``weight`` only breaks ties.
    """
    spark = rows.sparkSession
    points = ring_points(spark, shards, virtual)
    own = h, tie, at, edges, arc, rank, first, last, start = fresh(
        rows, "_h", "_tie", "_at", "_points", "_arc", "_rank", "_first", "_last", "_start")
    # the caller's expressions read the columns as they were named
    located = rows.withColumns({h: position(key), tie: weight, at: F.monotonically_increasing_id(),
                                edges: F.array(*[F.lit(p).cast("bigint") for p, _ in points])})
    located, _ = set_aside(located, ["shard", "slot", "_mid", "_pid", "_pos", "_bpid", "_shift"])  # names of number_rows
    # the first point at or after the hash, by halving; past the last point the ring starts again
    search = (f"aggregate(sequence(1, {max(1, len(points).bit_length())}), struct(0 as lo, size({edges}) as hi), (s, i) -> "
              "case when s.lo >= s.hi then s "
              f"when {edges}[cast((s.lo + s.hi) div 2 as int)] < {h} then "
              "struct(cast((s.lo + s.hi) div 2 as int) + 1 as lo, s.hi as hi) "
              "else struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi) end, s -> s.lo)")
    located = cut(located.withColumn(arc, F.pmod(F.expr(search), F.lit(len(points)))).drop(edges), "ring-rows")
    counts = {r[0]: r[1] for r in located.groupBy(arc).agg(F.count(F.lit(1))).collect()}  # a row per arc
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    plan = bounded_walk(counts, [s for _, s in points], capacity)
    # arcs + shards x ranges: a bounded table, whatever the number of rows
    ranges = spark.createDataFrame(pd.DataFrame(plan, columns=[arc, first, last, "shard", start]).astype("int64"),
                                   f"{arc} bigint, {first} bigint, {last} bigint, shard bigint, {start} bigint")
    ranges = ranges.withColumn(arc, F.col(arc).cast("int")).withColumn("shard", F.col("shard").cast("int"))
    ranked = number_rows(located, SeriesSpec((arc,), (h, tie, at), chunk_rows=0), rn=rank, largest=1 << 62)
    return (join_small(ranked, ranges, arc, "inner", name="ring-plan")
            .where(F.col(rank).between(F.col(first), F.col(last)))
            .withColumn("slot", F.col(start) + F.col(rank) - F.col(first)).drop(*own))


def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("bigint").alias("size"),
                       F.crc32(data).cast("bigint").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id"), F.col("text_crc32"))
    placed = assign(rows, key, F.struct("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
