"""Benchmark decontamination.

The benchmark becomes a broadcast hash set of normalised n-grams (windows of
``WINDOW`` words; a shorter item is one window).  Training texts are scanned window
by window; a hash that hits is verified word for word, and the words covered by
verified windows are the hits: remove those spans, or the documents that have any.

The broadcast is bounded: the benchmark is cut into blocks of ``BLOCK_CHARS`` and
every block is one scan that extends the hits of the scans before, so a benchmark
of any size keeps the memory of one block.  No shuffle.

Defined results: null or empty texts have no words and no hits; an empty benchmark
hits nothing; repeated rows and items are judged one by one (an item id is listed
once); items without words have no window; a null item id is listed as ``null``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import bytes_of as B
from gridlake.llm.tables import cut, set_aside, table

WINDOW = 10
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 2_000_000

#: Words are runs of 0-9, a-z (after lower-casing A-Z) and bytes outside ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _tokens(content: np.ndarray, offsets: np.ndarray):
    low = B.LOWER[content]
    starts, ends, row = B.words(low, offsets, IS_WORD)
    return low, starts, ends, row, B.word_hashes(low, starts, ends)


def _spelled(low: np.ndarray, starts, ends) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist()))


def window_set(items, window: int = WINDOW) -> dict:
    """``{n_words: (sorted hashes, {spelling: item ids})}`` of ``(item_id, text)`` pairs."""
    hashes, spellings = defaultdict(list), defaultdict(dict)
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        low, starts, ends, _, each = _tokens(data, np.array([0, len(data)]))
        n = min(window, len(starts))
        if n:
            hashes[n].append(B.window_hashes(each, n))
            for i in range(len(starts) - n + 1):
                spellings[n].setdefault(_spelled(low, starts[i:i + n], ends[i:i + n]), set()).add(item_id)
    return {n: (np.unique(np.concatenate(hashes[n])), spellings[n]) for n in hashes}


def hits_of(content: np.ndarray, offsets: np.ndarray, sets: dict):
    """Per row: words, hit word ranges and their byte ranges, item ids."""
    low, starts, ends, row, each = _tokens(content, offsets)
    n_rows = len(offsets) - 1
    counts = np.bincount(row, minlength=n_rows)
    items = [set() for _ in range(n_rows)]
    covered = np.zeros(len(starts) + 1, np.int64)
    for n, (known, spellings) in sets.items():
        found = B.window_hashes(each, n)
        if not len(found):
            continue
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        for i in np.flatnonzero((known[at] == found) & (row[:len(found)] == row[n - 1:])).tolist():
            ids = spellings.get(_spelled(low, starts[i:i + n], ends[i:i + n]))
            if ids:
                covered[i] += 1
                covered[i + n] -= 1
                items[row[i]] |= ids
    hit = np.cumsum(covered[:-1]) > 0
    spans: list[list] = [[] for _ in range(n_rows)]
    base = np.cumsum(counts) - counts
    previous = -1
    for i in np.flatnonzero(hit).tolist():
        r = row[i]
        if spans[r] and previous == i - 1:
            spans[r][-1][1], spans[r][-1][3] = i + 1 - int(base[r]), int(ends[i] - offsets[r])
        else:
            spans[r].append([i - int(base[r]), i + 1 - int(base[r]), int(starts[i] - offsets[r]), int(ends[i] - offsets[r])])
        previous = i
    return counts, spans, items


def _merged(spans: list) -> list:
    out: list = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3])]
        else:
            out.append(list(s))
    return out


#: What a scan adds: words, flat hit ranges (first word, word after, first byte, byte after), item ids.
STATE = "bench_words bigint, bench_spans array<bigint>, bench_items array<string>"


STATE_NAMES = [f.split()[0] for f in STATE.split(", ")]


def _scan(docs: DataFrame, text_col: str, block: list, window: int, again: bool) -> DataFrame:
    """One block's scan; ``again``: ``docs`` has the state of the scans before."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = docs.schema.fields[:-len(STATE_NAMES)] if again else docs.schema.fields
    names = [f.name for f in fields]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [STATE])
    cache: dict = {}

    def run(batches):
        if "sets" not in cache:
            cache["sets"] = window_set(shared.value, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            text = batch.column(batch.schema.get_field_index(text_col))
            for first, content, offsets in B.text_blocks(text):
                c, s, i = hits_of(content, offsets, cache["sets"])
                n_words += c.tolist()
                spans += s
                items += [{"null" if x is None else str(x) for x in ids} for ids in i]
            if again:
                for k, old in enumerate(batch.column("bench_spans").to_pylist()):
                    spans[k] = _merged(spans[k] + [old[j:j + 4] for j in range(0, len(old), 4)])
                for k, old in enumerate(batch.column("bench_items").to_pylist()):
                    items[k] |= set(old)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:len(names)] + [pa.array(n_words, pa.int64()),
                        pa.array([[x for s in row for x in s] for row in spans], pa.list_(pa.int64())),
                        pa.array([sorted(ids) for ids in items], pa.list_(pa.string()))],
                names + STATE_NAMES)

    return docs.mapInArrow(run, out_schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` plus ``bench_words``, ``bench_spans`` and ``bench_items``; a column of such a
    name is kept as ``<name>_in``."""
    docs, (text_col,) = set_aside(docs, STATE_NAMES, [text_col])
    out, block, size, blocks = docs, [], 0, 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        if block and size + len(row.t or "") > block_chars:
            out = cut(_scan(out, text_col, block, window, blocks > 0), "bench-scan")
            block, size, blocks = [], 0, blocks + 1
        block.append((row.i, row.t))
        size += len(row.t or "")
    return _scan(out, text_col, block, window, blocks > 0)


def span_words():
    """Hit words of a row of ``find_overlaps``."""
    return F.expr("aggregate(transform(sequence(0, cast(size(bench_spans) / 4 as int)), k -> "
                  "coalesce(try_element_at(bench_spans, k * 4 + 2) - try_element_at(bench_spans, k * 4 + 1), 0L)), "
                  "0L, (a, x) -> a + x)")


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the hit spans cut out of the text (a blank in their place)
    and without the columns of ``find_overlaps``; untouched texts stay as they are."""
    @F.pandas_udf("string")
    def clean(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and len(s):
                data, parts, at = t.encode(), [], 0
                for j in range(0, len(s), 4):
                    parts.append(data[at:s[j + 2]])
                    at = s[j + 3]
                t = b" ".join([*parts, data[at:]]).decode()
            out.append(t)
        import pandas as pd
        return pd.Series(out, dtype=object)

    return (found.withColumn(text_col, F.when(F.size("bench_spans") > 0, clean(F.col(text_col), F.col("bench_spans")))
                                        .otherwise(F.col(text_col)))
                 .drop(*STATE_NAMES))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts, columns as given."""
    named = set_aside(docs, STATE_NAMES, [text_col])[1][0]
    found = find_overlaps(docs, benchmark, text_col, **options)
    return remove_spans(found, named).toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    n_hit = span_words()
    return found.select(
        "doc_id", F.col("bench_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("bench_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (F.size("bench_items") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
