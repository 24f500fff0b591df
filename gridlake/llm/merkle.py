"""Merkle manifest of a dataset: one root, a subroot per group, and a proof per row.

A node's parent is the SHA-256 of up to ``FAN`` consecutive nodes' digests, concatenated as
hex text.  A level of the tree is kept as such text: each aligned block of ``FAN ** HEIGHT``
nodes is one string, a row of a table.  Fixed-width substrings of a level are the runs to
hash, and their digests in order are the block's next level; the substrings to the left and
right of a node inside its run are that node's part of a proof.  A block ends in one
digest, and the blocks' digests are the nodes of the next round, until one is left per
group; the groups' subroots are climbed in the same way.

Only digests are shuffled, never texts.  Rows are numbered by a range sort, so that a group
of any size is spread over all tasks; a block holds a fixed number of rows; every round is
written to shared storage.  The driver gets one number per tree, the size of the largest
group.

Defined results: a null field is hashed as ``-``, any other as its UTF-8 byte count, ``:``
and the value, so that an empty text differs from a null one.  Rows of a group ascend by
the order column (null first), rows of equal order by leaf; repeated rows are leaves of
their own.  A null group is a group and comes first.  An empty table has no rows and no
root.  Input columns that are not named are ignored, also when they are called like an
output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.llm.tables import cut, table
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import SeriesSpec, number_rows

FAN = 3
HEIGHT = 5
WIDTH = 64  # characters of a digest


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its proof."""
    return F.aggregate(path, start, lambda node, at: sha(F.concat(at["before"], node, at["after"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a proof as one text, from the leaf up, left to right."""
    return F.aggregate(path, F.lit(""), lambda text, at: F.concat(text, at["before"], at["after"]))


def _parents(level: Column) -> Column:
    """The next level of a level's text."""
    run = FAN * WIDTH
    starts = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
    return F.array_join(F.transform(starts, lambda k: sha(F.substring(level, k * run + 1, F.lit(run)))), "")


def _flanks(level: Column, node: Column) -> Column:
    """What stands before and after a node in its run."""
    inside = node % FAN
    return F.struct(F.substring(level, (node - inside) * WIDTH + 1, inside * WIDTH).alias("before"),
                    F.substring(level, (node + 1) * WIDTH + 1, (FAN - 1 - inside) * WIDTH).alias("after"))


def _levels_of(nodes: Column) -> Column:
    """Levels above so many nodes, ``HEIGHT`` at most."""
    return sum([F.when(nodes > FAN ** k, 1).otherwise(0) for k in range(HEIGHT)], F.lit(0))


PATH = "array<struct<before:string,after:string>>"


def _climb(nodes: DataFrame, largest: int, payload: list[str], name: str, above=None, sizes=None) -> DataFrame:
    """``nodes(key, idx, size, digest, *payload)`` -- places from 0 inside keys of ``size``
    nodes, the largest with ``largest`` -- as ``(key, digest, *payload, path, top, ...)``.

    The sizes may come apart, as ``sizes(key, size)``.  ``above(tops)`` may extend the tops ``(key, digest)`` of the whole trees by a path on;
    it returns them with ``path`` and ``top``."""
    width = FAN ** HEIGHT
    known = ["size"] if sizes is None else []
    blocks = (nodes.groupBy("key", *known, F.floor(F.col("idx") / width).alias("block"))
                   .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *[c for c in payload if c != "idx"]))).alias("members")))
    if sizes is not None:
        blocks = join_small(blocks, sizes, "key", "inner", name=f"{name}-sizes")
    blocks = blocks.withColumn("levels", _levels_of(F.col("size")))
    blocks = blocks.withColumn("level0", F.array_join(F.col("members")["digest"], ""))
    for k in range(1, HEIGHT + 1):
        below = F.col(f"level{k - 1}")
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("levels") >= k, _parents(below)).otherwise(F.lit("")))
    digest = F.element_at(F.array(*[F.col(f"level{k}") for k in range(HEIGHT + 1)]), F.col("levels") + 1)
    blocks = cut(blocks.withColumn("digest", digest).drop(f"level{HEIGHT}"), f"{name}-blocks")
    tops = blocks.select("key", F.col("block").alias("idx"), F.ceil(F.col("size") / width).cast("bigint").alias("size"), "digest")
    if largest > width:
        up = _climb(tops, -(-largest // width), ["idx"], f"{name}-up", above).withColumnRenamed("idx", "block")
        blocks = blocks.join(up.drop("digest"), ["key", "block"])
    elif above is not None:
        blocks = blocks.join(above(tops.select("key", "digest")).drop("digest"), "key")
    else:
        blocks = blocks.withColumns({"path": F.array().cast(PATH), "top": F.col("digest")})
    more = [c for c in ("subtop",) if c in blocks.columns]

    def member(m):
        place = (m["idx"] % width).cast("int")
        steps = [F.when(F.col("levels") > k, F.array(_flanks(F.col(f"level{k}"), (place / FAN ** k).cast("int"))))
                  .otherwise(F.array().cast(PATH)) for k in range(HEIGHT)]
        return F.struct(m["digest"].alias("digest"), *[m[c].alias(c) for c in payload],
                        F.concat(*steps, F.col("path")).alias("path"))

    return (blocks.select("key", "top", *more, F.explode(F.transform("members", member)).alias("m"))
                  .select("key", "top", *more, "m.*"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Places inside keys by a range sort, whatever the keys' sizes."""
    return number_rows(rows, SeriesSpec(("key",), tuple(order), chunk_rows=0), rn="idx", largest=1 << 62)


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``(order, group, leaf, path, subroot, root, *keep)``.

    ``path`` has the siblings of every level up to the root; ``keep`` are further small
    values per row, such as digests of other versions of it."""
    keep = keep or {}
    rows = docs.select(F.col(group).alias("group_value"), F.col(order).alias("order_value"),
                       leaf([F.col(c) for c in fields]).alias("digest"), *[v.alias(k) for k, v in keep.items()])
    # null before all other groups, the others by their bytes
    key = F.coalesce(F.concat(F.lit("="), F.col("group_value").cast("string")), F.lit(""))
    rows = cut(rows.withColumn("key", key), "merkle-leaves")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    numbered = _numbered(rows, ["order_value", "digest"])

    def whole(subroots):
        subroots = cut(subroots.select(F.col("key").alias("name"), "digest", F.lit("").alias("key")), "merkle-subroots")
        n = subroots.count()
        nodes = _numbered(subroots, ["name"]).withColumn("size", F.lit(n).cast("bigint"))
        return _climb(nodes, n, ["name"], "merkle-root").select(F.col("name").alias("key"), "digest", "path", "top",
                                                                F.col("digest").alias("subtop"))

    out = _climb(numbered, largest, ["order_value", "group_value", *keep], "merkle", whole, sizes)
    return out.select(F.col("order_value").alias(order), F.col("group_value").alias(group), F.col("digest").alias("leaf"),
                      "path", F.col("subtop").alias("subroot"), F.col("top").alias("root"), *keep)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = leaf([F.col(c) if c != "text" else F.replace("text", F.lit("\n"), F.lit("")) for c in FIELDS])
    rows = manifest(docs, "source", "doc_id", FIELDS, {"changed": F.when(tampered, changed)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return (rows.withColumn("folded_root", folded)
                .select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified")))


#: The recursion of DuckDB stands for the rounds; the CRC-32 of an id's digits is worked out
#: bit by bit (fixed value: the reversed polynomial 0xEDB88320).
OP13_SQL = """
WITH RECURSIVE
field_rows AS (
  SELECT doc_id, source, text, coalesce('=' || source, '') AS key,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         replace(text, chr(10), '') AS flat,
         list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1),
                                                             lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
                     lambda crc, byte: list_reduce([xor(crc, byte)] || range(8),
                       lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 AND contains(text, chr(10))
              THEN sha256(head || strlen(flat) || ':' || flat) END AS changed
  FROM field_rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY key) AS size, row_number() OVER () AS rid
  FROM leaves),
tree AS (
  SELECT key, 0 AS lvl, idx, size, leaf AS digest FROM placed
  UNION ALL
  SELECT key, lvl + 1, idx // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM tree WHERE size > 1 GROUP BY key, lvl, idx // 3, size),
subroots AS (
  SELECT key, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS size
  FROM tree WHERE size = 1),
crown AS (
  SELECT 0 AS lvl, idx, size, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM crown WHERE size > 1 GROUP BY lvl, idx // 3, size),
steps AS (
  SELECT p.rid, t.lvl AS step, t.idx < p.idx // pow(3, t.lvl)::BIGINT AS ahead, t.idx AS place, t.digest
  FROM placed p JOIN tree t ON t.key = p.key AND t.idx // 3 = p.idx // pow(3, t.lvl + 1)::BIGINT
                            AND t.idx <> p.idx // pow(3, t.lvl)::BIGINT AND t.size > 1
  UNION ALL
  SELECT p.rid, s.height + c.lvl, c.idx < s.idx // pow(3, c.lvl)::BIGINT, c.idx, c.digest
  FROM placed p JOIN subroots s ON s.key = p.key
  JOIN crown c ON c.idx // 3 = s.idx // pow(3, c.lvl + 1)::BIGINT AND c.idx <> s.idx // pow(3, c.lvl)::BIGINT AND c.size > 1),
flanks AS (
  SELECT rid, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE ahead), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT ahead), '') AS r
  FROM steps GROUP BY rid, step),
heights AS (
  SELECT p.rid, s.subroot, s.height + (SELECT max(lvl) FROM crown) AS height, coalesce(p.changed, p.leaf) AS start
  FROM placed p JOIN subroots s ON s.key = p.key),
climb AS (
  SELECT rid, 0 AS step, height, start AS node FROM heights
  UNION ALL
  SELECT c.rid, c.step + 1, c.height, sha256(coalesce(f.l, '') || c.node || coalesce(f.r, ''))
  FROM climb c LEFT JOIN flanks f ON f.rid = c.rid AND f.step = c.step WHERE c.step < c.height),
proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY step) AS siblings FROM flanks GROUP BY rid)
SELECT p.doc_id, p.leaf, h.subroot, r.digest AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
       c.node AS folded_root, c.node = r.digest AS verified
FROM placed p JOIN heights h ON h.rid = p.rid JOIN climb c ON c.rid = p.rid AND c.step = c.height
JOIN (SELECT digest FROM crown WHERE size = 1) r ON true LEFT JOIN proofs q ON q.rid = p.rid
"""
