"""Rule bitmask ledger.

Every rule is evaluated once per document.  The ledger row keeps the
measurements and one bit per failed rule; policies are versioned masks over
those bits, so a new policy version or an ablation ("what would the policy keep
without rule r?") is a bitwise aggregation over the ledger and never reads a
text again.  DataFrame functions only.

Defined results: a null or empty text has no words (all measurements 0, ratio
rules do not fail, ``too_few_words`` does); documents are judged row by row, so
repeated rows get equal rows; an empty table gives an empty ledger; columns that
are not named in a signature pass through ``apply_policy`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.llm.tables import cut, table

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """Words of a text: runs of anything but blank, \\t, \\n, \\v, \\f, \\r."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: str | None = None) -> DataFrame:
    """One row per document with every measurement the rules use; ``carry`` names a
    struct column that takes the whole document along.

    ``n_repeat_words`` counts the words covered by 3-word windows that occur at
    least twice.  Documents whose windows are all different (the common case)
    are settled by one hash-based ``array_distinct``; only the others sort their
    windows to find the repeated ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    row = [carry] if carry else []
    base = docs.select(
        F.col(id_col).alias(id_col), *([F.struct(*docs.columns).alias(carry)] if carry else []), word_array(F.col(text_col)).alias("_w"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, SEPARATORS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    sized = base.withColumn("n_words", F.size("_w").cast("bigint"))
    windows = F.when(F.col("n_words") >= 3, F.expr(
        "transform(slice(_w, 1, size(_w) - 2), (w, i) -> concat(w, ' ', _w[i + 1], ' ', _w[i + 2]))")
    ).otherwise(F.array().cast("array<string>"))
    with_windows = sized.select(
        id_col, *row, "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_t"))
    # positions of repeated windows: sort (window, position), keep those equal to a neighbour
    marked = with_windows.withColumn("_s", F.when(
        F.size(F.array_distinct("_t")) < F.size("_t"),
        F.expr("sort_array(transform(_t, (x, i) -> struct(x, i)))")))
    positions = marked.withColumn("_p", F.when(F.col("_s").isNotNull(), F.expr(
        "sort_array(transform(filter(transform(_s, (p, j) -> struct(p.i as i, "
        "(j > 0 and _s[j - 1].x = p.x) or (j + 1 < size(_s) and _s[j + 1].x = p.x) as r)), "
        "q -> q.r), q -> q.i))")))
    covered = F.when(F.size("_p") > 0, F.expr(
        "3 + aggregate(transform(slice(_p, 1, size(_p) - 1), (p, j) -> least(3, _p[j + 1] - p)), "
        "0, (a, x) -> a + x)")).otherwise(0)
    # The row number times 0 keeps the optimizer from moving a caller's filter below the
    # measurements, where it would spell each of them out once per use.
    fixed = F.monotonically_increasing_id() * 0
    return positions.select(id_col, *row, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                            (F.coalesce(covered, F.lit(0)) + fixed).cast("bigint").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurement columns."""

    name: str
    fails: str


#: Bit i of the ledger belongs to RULES[i]; append only, so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "25 * n_symbols > 2 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected when one of ``reject_on`` failed, or at least
    ``suspicion`` of ``suspects`` (0: suspects are ignored)."""

    name: str
    version: int
    reject_on: tuple[str, ...]
    suspects: tuple[str, ...] = ()
    suspicion: int = 0


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard", 2, ("too_few_words", "repeated_windows", "symbols",
                                  "duplicate_lines"), ("short_words", "long_words"), 1)
POLICIES = (BASE, STANDARD)


def mask(names, rules=RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def ledger(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
           carry: str | None = None) -> DataFrame:
    """Measurements plus ``failed`` (bigint, bit i set when rules[i] fails)."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measurements(docs, id_col, text_col, carry).withColumn("failed", bits)


def rejected(policy: Policy, failed: Column, rules=RULES, without: str | None = None) -> Column:
    """The policy's decision over a bit column, optionally with one rule left out."""
    drop = ~mask([without], rules) if without else -1
    out = failed.bitwiseAND(F.lit(mask(policy.reject_on, rules) & drop)) != 0
    if policy.suspicion:
        out = out | (F.bit_count(failed.bitwiseAND(F.lit(mask(policy.suspects, rules) & drop)))
                     >= policy.suspicion)
    return out


def apply_policy(rows: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    return rows.withColumn("kept", ~rejected(policy, F.col("failed"), rules))


def keep_good(docs: DataFrame, policy: Policy = STANDARD, rules=RULES, **names) -> DataFrame:
    """The documents that the policy keeps, columns as given; no shuffle."""
    return (apply_policy(ledger(docs, rules, carry="_document", **names), policy, rules)
            .where("kept").select("_document.*"))


def ablations(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: documents rejected, rejected without the rule, and
    rejected by this rule alone.  One aggregate over the distinct bit patterns
    (2^rules at most), whatever the size of the ledger."""
    patterns = cut(rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n")), "patterns")
    out = None
    for p in policies:
        used = [r.name for r in rules if r.name in p.reject_on + p.suspects]
        for name in used:
            now, then = rejected(p, F.col("failed"), rules), rejected(p, F.col("failed"), rules, name)
            part = patterns.agg(
                F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"),
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(mask([name], rules))) != 0,
                                        F.col("n"))), F.lit(0)).alias("failing"),
                F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("rejected"),
                F.coalesce(F.sum(F.when(now & ~then, F.col("n"))), F.lit(0)).alias("only_by_rule"))
            out = part if out is None else out.unionByName(part)
    return out


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), STANDARD)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected(BASE, F.col("failed")).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


#: The same result in DuckDB.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
      regexp_extract_all(text, '[^\n]*[^\x20\x09-\x0D][^\n]*') AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM t),
p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n USING (r)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 25 * n_symbols > 2 * word_chars THEN 4 ELSE 0 END)
  + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""
