"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes its set of word shingles (64-bit hashes).  Equal sets are one
   class, represented by its smallest id; everything below sees classes only, so any
   number of exact copies costs one representative.
2. Each representative's signature is read in several orders (the trees).  The rows of
   each order are sorted by their signature prefix over range partitions; rows that
   share at least ``depth`` values form a region.  Candidates are the longest-common-
   prefix neighbours in the sorted order, and every row of a region with the region's
   pivots: the smallest ids on its most frequent full prefixes.  They are what copies of
   one original agree on, so large groups connect through few pairs; the deeper values
   of the prefix order large regions by themselves.  A region that crosses range
   partitions has its pivots chosen over all its pieces.
3. Candidates whose two-bit sketches are far apart are dropped; ``sketch_bound`` keeps
   a pair at the threshold except with probability ``MISS``.  The rest is confirmed on
   the full sets, and the confirmed links make components.
4. The forest is read twice: first with one neighbour and one pivot a row, then, for rows
   of different components only, with all pairs of the small regions.  The depth of that
   search adapts to the region: one of up to ``SECOND[0] + 1`` rows is compared whole, a
   larger one is read deeper, up to ``EXTRA_LEVELS`` values, where its parts are small.
5. A large region has other pairs too.  The rows of large regions, and of those that
   cross partitions, that still hold several components are finished exactly: every pair
   of different components that can reach the similarity is found by a prefix join on rare
   shingles (``_exact_pairs``), which compares the sketches as it joins, and confirmed.
   So a pair that meets in a region is not lost by the region's size, and a large region
   costs no list of its rows' pairs.

A pair at the threshold is so lost with ``2 * MISS`` at most: the forest's miss and the
sketch's.  ``depth`` and the number of trees follow from the number of documents and the
wanted miss probability of a pair at the threshold (``forest_shape``), so chance
neighbours stay few at any size.

Defined results: a text with fewer words than a shingle is one shingle (the whole word
sequence); null, empty and word-less texts have no shingle, link with nothing and are
kept; rows with a null id link with nothing (component null, kept); rows of one id
are judged as the same document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import bytes_of as B
from gridlake.llm.graph import connected_components
from gridlake.llm.tables import cut, free_shuffles, table
from gridlake.plans.materialize import broadcast_if_small, join_small

SHINGLE, SIMILARITY = 5, 80
MISS = 1e-6
#: Similarity (chance agreement) of unrelated texts that ``forest_shape`` allows for.
CHANCE = 0.04
EXTRA_LEVELS = 3
#: Neighbours in sorted order and pivots of a region: first for all rows, then within small
#: regions and between components only.
FIRST, SECOND = (1, 1), (10, 0)

#: Counters that order the shingles of the exact join from rare to common.
COUNTERS = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def forest_shape(n: int, similarity: int = SIMILARITY) -> tuple[int, int]:
    """``(depth, trees)`` for ``n`` documents: chance neighbours of a row stay
    about one per tree, and a pair at the threshold shares ``depth`` values in no tree
    with probability ``MISS`` at most."""
    depth = max(4, math.ceil(math.log(max(n, 2)) / -math.log(CHANCE)))
    trees = math.ceil(math.log(MISS) / math.log(1 - (similarity / 100) ** depth))
    return depth, trees


def sketch_bound(n: int, similarity: int = SIMILARITY) -> int:
    """Least number of equal two-bit values, of ``n``, of a pair to confirm: a pair at
    the threshold, whose values are equal with ``s + (1 - s) / 4``, has fewer with
    probability ``MISS`` at most."""
    equal = (1 + 3 * similarity / 100) / 4
    below = 0.0
    for k in range(n + 1):
        ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        below += math.exp(ways + k * math.log(equal) + (n - k) * math.log(max(1 - equal, 1e-300)))
        if below > MISS:
            return k
    return n


def shingle_sets(content: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each row."""
    low = B.LOWER[content]
    starts, ends, row = B.words(low, offsets, IS_WORD)
    each = B.word_hashes(low, starts, ends)
    windows = B.window_hashes(each, size)
    first = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(windows[a:b - size + 1])
        elif b > a:
            yield B.window_hashes(each[a:b], b - a) + np.uint64(b - a)
        else:
            yield each[:0]


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of a non-empty set."""
    best = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[i:i + 1024, None] * multipliers).min(0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def documents_as_sets(docs: DataFrame, id_col: str, text_col: str, size: int, n_values: int) -> DataFrame:
    """``(id, n_shingles, set_a, set_b, sig)``: a 128-bit name of each row's shingle set
    and its signature (``n_values`` 32-bit values; null for an empty set)."""

    def run(batches):
        multipliers = _multipliers(n_values)
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for _, content, offsets in B.text_blocks(batch.column(1)):
                for s in shingle_sets(content, offsets, size):
                    n.append(len(s))
                    a.append(int(np.add.reduce(s)) & (1 << 63) - 1)
                    b.append(int(np.bitwise_xor.reduce(B.mix(s * np.uint64(B.STEP)))) & (1 << 63) - 1)
                    sig.append(signature(s, multipliers).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(sig, pa.binary())], ["id", "n_shingles", "set_a", "set_b", "sig"])

    return (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
                .mapInArrow(run, "id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary"))


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the given ids; the id list is broadcast only behind a size check."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.join(broadcast_if_small(ids, name="near-ids"), "id", "left_semi")


def _forest_rows(reps: DataFrame, depth: int, trees: int) -> DataFrame:
    """``(key, id, sketch)``, a row per tree of ``reps(id, sig)``: the key is the tree and
    the signature values in the tree's order, the sketch two bits of every value."""
    n = depth * trees
    levels = depth + EXTRA_LEVELS

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, n)
                pairs = np.pad((values & np.uint32(3)).astype(np.uint8), ((0, 0), (0, -n % 4)))
                sketch = np.bitwise_or.reduce([pairs[:, j::4] << (2 * j) for j in range(4)])
                sketch = pa.array([s.tobytes() for s in sketch], pa.binary())
                for t in range(trees):
                    order = (t * depth + np.arange(levels)) % n
                    key = np.concatenate([np.full((len(values), 1), t, ">u4"), values[:, order].astype(">u4")], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()),
                                                      part.column(0), sketch], ["key", "id", "sketch"])

    return reps.select("id", "sig").mapInArrow(run, "key binary, id bigint, sketch binary")


PAIRS = "kind string, region binary, a bigint, b bigint, n bigint"


def _equal(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Number of equal two-bit values."""
    d = x ^ y
    return n - np.bitwise_count((d | d >> 1) & np.uint8(0x55)).sum(1, dtype=np.int64)


def _candidates(forest: DataFrame, depth: int, trees: int, neighbours: int, n_pivots: int, least: int) -> DataFrame:
    """Candidate pairs between components (without pivots: only of rows whose region, at
    its own depth, has at most ``neighbours + 1`` rows); of the regions whose pairs the neighbours do
    not reach all, the rows (``rest``); and, for the first and last region of each
    partition (which may go on in another one), their pivots and members (``a`` the id,
    ``b`` its component, ``n`` of members the partition)."""
    n, prefix = depth * trees, 4 * (depth + 1)

    def run(batches):
        keys, ids, sketches, comps, state = [], [], [], [], {"first": True}

        def small_parts(key):
            """A number per row that it shares with the rows of its region at the least
            depth that leaves ``neighbours + 1`` of them; -1 if none does."""
            part = np.full(len(key), -1)
            changed = np.zeros(len(key), np.int64)  # first byte in which a row differs from the one before
            changed[1:] = (key[1:] != key[:-1]).argmax(1)
            changed[1:][(key[1:] == key[:-1]).all(1)] = key.shape[1]
            for end in range(prefix, key.shape[1] + 1, 4):
                first = np.flatnonzero(changed < end)
                size = np.diff(np.append(first, len(key)))
                found = np.repeat(np.where(size <= neighbours + 1, first, -1), size)
                part = np.where(part < 0, found, part)
            return part

        def regions(last: bool):
            """Settle all whole regions held; keep the open one unless it is the last."""
            key = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
            who, comp = np.array(ids, np.int64), np.array(comps, np.int64)
            sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1)
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:, :prefix] == key[:-1, :prefix]).all(1)
            start = np.flatnonzero(~same)
            stop = len(key) if last else int(start[-1])
            if stop == 0:
                return 0, []
            key, who, comp, sketch, same = key[:stop], who[:stop], comp[:stop], sketch[:stop], same[:stop]
            start = np.flatnonzero(~same)
            region = np.cumsum(~same) - 1
            # the most frequent full key of each region, its smallest id first
            leaf_new = ~same
            leaf_new[1:] |= (key[1:] != key[:-1]).any(1)
            leaf = np.flatnonzero(leaf_new)
            length = np.diff(np.append(leaf, stop))
            order = np.lexsort((who[leaf], -length, region[leaf]))
            of = region[leaf][order]
            head = np.searchsorted(of, np.arange(len(start)))
            place = np.arange(len(of)) - head[of]  # 0: the region's most frequent full key
            left, right, pivots = [], [], []
            for k in range(n_pivots):
                pivot = np.full(len(start), -1)
                pivot[of[place == k]] = order[place == k]
                at = np.flatnonzero(pivot[region] >= 0)
                left.append(leaf[pivot[region[at]]])
                right.append(at)
                pivots.append(pivot)
            near = region if n_pivots else small_parts(key)
            for lag in range(1, neighbours + 1):
                at = np.flatnonzero((near[lag:] == near[:-lag]) & (near[lag:] >= 0)) + lag if stop > lag else np.zeros(0, int)
                left.append(at - lag)
                right.append(at)
            x, y = np.concatenate(left), np.concatenate(right)
            keep = comp[x] != comp[y]
            x, y = x[keep], y[keep]
            keep = _equal(sketch[x], sketch[y], n) >= least
            x, y = x[keep], y[keep]
            out = []
            if len(x):
                pairs = np.unique(np.sort(np.stack([who[x], who[y]], 1), axis=1), axis=0)
                out.append(_rows("pair", pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)))
            stops = np.append(start[1:], stop)
            mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
            for r in np.flatnonzero(mixed & (stops - start > neighbours + 1)):
                i, j = start[r], stops[r]
                out.append(_rows("rest", who[i:j], comp[i:j], np.zeros(j - i, np.int64), key[i, :prefix].tobytes()))
            ends = ([0] if state["first"] else []) + ([len(start) - 1] if last else [])
            for r in sorted(set(ends)):
                i, j = start[r], stops[r]
                name = key[i, :prefix].tobytes()
                own = [p[r] for p in pivots if p[r] >= 0]
                out.append(_rows("pivot", who[leaf[own]], comp[leaf[own]], length[own], name))
                out.append(_rows("member", who[i:j], comp[i:j], np.full(j - i, TaskContext.get().partitionId()), name))
            state["first"] = False
            return stop, out

        for batch in batches:
            keys += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
            sketches += batch.column(2).to_pylist()
            comps += batch.column(3).to_pylist()
            if len(keys) >= 50_000:
                done, out = regions(False)
                yield from out
                del keys[:done], ids[:done], sketches[:done], comps[:done]
        if keys:
            yield from regions(True)[1]

    return forest.mapInArrow(run, PAIRS)


def _rows(kind, a, b, n, region=None):
    size = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.string()), pa.array([region] * size, pa.binary()), pa.array(a, pa.int64()),
         pa.array(b, pa.int64()), pa.array(n, pa.int64())],
        ["kind", "region", "a", "b", "n"])


def _across_partitions(found: DataFrame, n_pivots: int) -> DataFrame:
    """Pairs of regions in several partitions: every member with the pivots of all
    pieces.  There are at most two pieces per partition, with ``n_pivots`` pivots each:
    that bounds the broadcast."""
    leaf = F.struct(F.col("n"), (-F.col("a")).alias("neg"), F.col("b").alias("c"))
    pieces = (found.where("kind = 'pivot'").groupBy("region")
                   .agg(F.slice(F.sort_array(F.collect_set(leaf), asc=False), 1, 2 * n_pivots).alias("best"))
                   .select("region", F.explode("best").alias("p"))
                   .select("region", (-F.col("p.neg")).alias("pivot"), F.col("p.c").alias("pivot_comp")))
    return (found.where("kind = 'member'").join(F.broadcast(pieces), "region").where("b != pivot_comp")
                 .select(F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b")))


def _search(forest: DataFrame, depth: int, trees: int, breadth: tuple[int, int], least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs ``(a, b)`` of different components, and the rows
    ``(region, id)`` of the regions that have other pairs too."""
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = forest.select("key", "id", "sketch", "comp").repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    found = cut(_candidates(rows, depth, trees, *breadth, least), "near-found")
    pairs = found.where("kind = 'pair'").select("a", "b").union(_across_partitions(found, breadth[1]))
    members = found.where("kind = 'member'")
    crossing = (members.groupBy("region").agg(F.min("n").alias("from"), F.max("n").alias("to"))
                       .where(F.col("from") < F.col("to")).select("region"))
    rest = (found.where("kind = 'rest'").select("region", F.col("a").alias("id"))
                 .union(join_small(members, crossing, "region", "left_semi", name="near-crossing")
                        .select("region", F.col("a").alias("id"))))
    return cut(pairs.distinct(), "near-pairs", pairs.count()), rest


def _placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows(id, ...)`` with their component, which is the id itself if unlinked."""
    return (rows.join(comp.withColumnRenamed("node", "id"), "id", "left")
                .withColumn("comp", F.coalesce("component", "id")).drop("component"))


def _unfinished(rest: DataFrame, comp: DataFrame) -> DataFrame:
    """``(id, comp)``: the rows of those regions that still hold several components."""
    rows = cut(_placed(rest, comp), "near-rest")
    mixed = (rows.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                 .where(F.col("low") < F.col("high")).select("region"))
    return join_small(rows, mixed, "region", "left_semi", name="near-mixed").select("id", "comp").distinct()


def _sketch_words(sig: np.ndarray) -> np.ndarray:
    """Two bits of every value of each signature, 32 values to a 64-bit word."""
    two = np.pad((sig & np.uint32(3)).astype(np.uint64), ((0, 0), (0, -sig.shape[1] % 32)))
    shifts = np.uint64(2) * np.arange(32, dtype=np.uint64)
    return np.bitwise_or.reduce(two.reshape(len(sig), -1, 32) << shifts, axis=2).view(np.int64)


def _unequal(x: str, y: str, words: int):
    """Number of different two-bit values of two sketches (columns of words)."""
    total = F.lit(0)
    for k in range(words):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _with_sketches(classes: DataFrame, ids: DataFrame, n_values: int) -> DataFrame:
    """``(id, sketch)`` of the given representatives."""
    rows = join_small(classes.select(F.col("rep").alias("id"), "sig"), ids, "id", "left_semi", name="near-sketched")

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, n_values)
            words = _sketch_words(sig)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]),
                                             pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "sketch"])

    return rows.mapInArrow(run, "id bigint, sketch array<bigint>")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (B.mix(shingles.view(np.uint64)) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _exact_pairs(sets: DataFrame, similarity: int, n_values: int) -> DataFrame:
    """All pairs ``(a, b)`` of ``sets(id, comp, shingles, sketch)`` with different components
    that can reach the similarity, by a prefix join.

    In one order of all shingles, two sets that reach it share one of the first
    ``n - ceil(similarity * n) + 1`` shingles of each.  The order goes by counters, from
    rare to common: shared counters make prefixes less rare, never wrong.  At each
    shingle the rows of its largest component are only searched from the others, so a
    large linked group costs its size times what is left over, not its square; adaptive
    execution splits the hot shingles of the join.  The pairs are compared inside the join:
    a shared shingle alone makes no row, only sketches of ``n_values`` values that are as
    near as those of a pair at the threshold (``sketch_bound``) do."""

    def lists(batch):
        column = batch.column(batch.schema.get_field_index("shingles"))
        at = np.asarray(column.offsets)
        return np.asarray(column.values), at

    def count(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            values, at = lists(batch)
            seen += np.bincount(_slot(values[at[0]:at[-1]]), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    got = sets.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        counts = shared.value
        for batch in batches:
            values, at = lists(batch)
            rows, tokens, places = [], [], []
            for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = values[i:j]
                n = counts[_slot(own)]
                first = np.lexsort((own, n))[:j - i + similarity * (i - j) // 100 + 1]
                place = np.flatnonzero(n[first] > 1)  # 1: no other row has it
                rows.append(np.full(len(place), r))
                tokens.append(own[first[place]])
                places.append(place)
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens) if tokens else [], pa.int64()),
                 batch.column(batch.schema.get_field_index("id")).take(pa.array(rows)),
                 batch.column(batch.schema.get_field_index("comp")).take(pa.array(rows)),
                 batch.column(batch.schema.get_field_index("size")).take(pa.array(rows)),
                 pa.array(np.diff(at)[rows].astype(np.int64)),
                 pa.array(np.concatenate(places) if places else [], pa.int64()),
                 batch.column(batch.schema.get_field_index("sketch")).take(pa.array(rows))],
                ["token", "id", "comp", "size", "n", "place", "sketch"])

    sizes = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    tokens = cut(join_small(sets, sizes, "comp", "inner", name="near-sizes")
                 .mapInArrow(prefixes, "token bigint, id bigint, comp bigint, size bigint, n bigint, place bigint, sketch array<bigint>"),
                 "near-tokens")
    group = F.struct("size", "comp")
    top = tokens.groupBy("token").agg(F.max(group).alias("top"))
    x = tokens.join(top, "token").where(group < F.col("top")).select(
        "token", F.col("id").alias("x"), group.alias("gx"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("sketch").alias("sx"))
    y = tokens.select("token", F.col("id").alias("y"), group.alias("gy"), F.col("n").alias("ny"), F.col("place").alias("py"),
                      F.col("sketch").alias("sy"))
    # what can be common from the shared shingle on
    common = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    reach = (100 + similarity) * common >= similarity * (F.col("nx") + F.col("ny"))
    near = _unequal("sx", "sy", -(-n_values // 32)) <= n_values - sketch_bound(n_values, similarity)
    return (x.join(y, (x["token"] == y["token"]) & (F.col("gx") < F.col("gy")) & reach & near)
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets reach the similarity.  Each side's set is joined by
    its id, so a pivot's set travels once however many pairs it has."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return (both.withColumn("common", common)
                .where(100 * F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")))
                .select("a", "b"))


def _sets_of(texts: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, content, offsets in B.text_blocks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(content, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)),
                                                  pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, a row per document row."""
    spark = docs.sparkSession
    depth, trees = forest_shape(docs.count(), similarity)
    named = cut(documents_as_sets(docs, id_col, text_col, size, depth * trees), "near-sets")
    classes = cut(named.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles")
                       .agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "near-classes")
    forest = cut(_forest_rows(classes.select(F.col("rep").alias("id"), "sig"), depth, trees), "near-forest")
    links = comp = rest = None

    def sets_of(ids, *most):
        return cut(_sets_of(_texts_of(docs, ids, id_col, text_col), size).dropDuplicates(["id", "shingles"]), "near-full", *most)

    def link(pairs, sets):
        nonlocal links, comp
        new = cut(_confirm(pairs, sets, similarity), "near-links", pairs.count(), 2_000)
        links = new if links is None else links.union(new)
        comp = cut(connected_components(links, "near"), "near-comp", 2 * links.count())
        free_shuffles(spark)

    for breadth in (FIRST, SECOND):
        rows = forest.withColumn("comp", F.col("id")) if comp is None else _placed(forest, comp)
        pairs, rest = _search(rows, depth, trees, breadth, sketch_bound(depth * trees, similarity))
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        link(pairs, sets_of(wanted, 2 * pairs.count(), 5_000))
    left = cut(_unfinished(rest, comp), "near-left")
    if n_left := left.count():
        sets = sets_of(left.select("id"), n_left, 5_000)
        whole = sets.join(left, "id").join(_with_sketches(classes, left.select("id"), depth * trees), "id")
        pairs = _exact_pairs(whole, similarity, depth * trees)
        link(cut(pairs, "near-pairs"), sets)
    placed = classes.drop("sig").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = named.drop("sig").join(placed, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stand for their component; columns as given."""
    decided = near_duplicates(docs, id_col, **options)
    gone = decided.where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
