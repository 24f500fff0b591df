"""Language identification with interpolated Kneser-Ney character models.

Texts become symbols: letters in lower case, everything else one blank (runs of blanks
are one).  Per language, trigram counts over all training rows give an interpolated
Kneser-Ney model (absolute discounts from the counts of counts, continuation counts for
the lower orders, a uniform base), kept as sorted arrays of hashed grams.  A text gets
the language of the lowest cross-entropy per symbol; it is rejected when that entropy
is far above what the language's own training texts have.

Symbols are 7-bit codes (a-z, the letters U+00DF-U+00FF, 60 hashed classes for all other
letters and 8 for the marks that belong to letters, such as vowel signs), so a model has at
most 2^21 trigrams per language whatever the corpus: that is the bound of what is collected
and broadcast.  The counts cover all training rows; tasks count sparsely, in memory that
does not depend on the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows
with a null language are not learned from; without any training row all is ``und``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.llm import bytes_of as B
from gridlake.llm.tables import cut, fresh, set_aside, table

ORDER, BITS, BLANK = 3, 7, 0
#: The first symbol of a mark; letters are the symbols below.
MARKS = 120
GRAMS = 1 << (ORDER * BITS)
UNKNOWN = "und"
#: Counted grams that a task holds before it hands them on.
HELD_GRAMS = 2_000_000
#: A text is rejected above mean + REJECT * deviation of its language's training entropies.
REJECT = 6.0
#: Symbols after which more text does not sharpen the score.
SCORE_SYMBOLS = 200


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()) if len(s.lower()) == 1 else c
            if 97 <= low <= 122:
                out[c] = low - 96
            elif 0xDF <= low <= 0xFF:
                out[c] = 27 + low - 0xDF
            else:
                out[c] = 60 + (low * 2654435761 >> 7) % 60
        elif unicodedata.category(s)[0] == "M":
            out[c] = MARKS + (c * 2654435761 >> 7) % (1 << BITS) % 8
    return out


_TABLE: list[np.ndarray] = []


def gram_codes(content: np.ndarray, offsets: np.ndarray):
    """``(code, row)`` of every trigram: the symbol in the low bits, its history above.
    A text's history starts with blanks."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    points = np.frombuffer(content.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((content & 0xC0) != 0x80)])[offsets]
    symbols = _TABLE[0][points].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    # one blank stands for a run of them, and none for those at the start of a text
    keep = symbols != BLANK
    if len(keep):
        keep[1:] |= (symbols[:-1] != BLANK) & (row[1:] == row[:-1])
    symbols, row = symbols[keep], row[keep]
    code = symbols.copy()
    for lag in range(1, ORDER):
        back = np.zeros_like(symbols)
        back[lag:] = np.where(row[lag:] == row[:-lag], symbols[:-lag], BLANK) if lag else symbols
        code |= back << np.uint32(BITS * lag)
    return code, row


# ---------------------------------------------------------------- training


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, code, n)`` over all rows: counted in each task, summed by Spark."""

    def count(batches):
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []  # language and gram in one number, count

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n).astype(np.int64)

        def handed(keys, n):
            names = pa.array(list(number), pa.string())
            return pa.RecordBatch.from_arrays([names.take(pa.array(keys >> ORDER * BITS)),
                                               pa.array((keys & GRAMS - 1).astype(np.int32)), pa.array(n)], ["lang", "code", "n"])

        for batch in batches:
            langs = np.array([number.setdefault(x, len(number)) for x in batch.column(0).to_pylist()], np.int64)
            for first, content, offsets in B.text_blocks(batch.column(1)):
                code, row = gram_codes(content, offsets)
                held.append(np.unique(langs[first + row] << ORDER * BITS | code, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_GRAMS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_GRAMS // 2:
                        yield handed(*held.pop())
        if held:
            yield handed(*merged())

    return (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
                .mapInArrow(count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


class KneserNey:
    """One language: for each order the sorted gram hashes with their probabilities, and
    the sorted contexts with the weight of the order below."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        codes, counts = codes[order].astype(np.uint32), counts[order].astype(np.float64)
        levels = [(codes, counts)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols precede the shorter gram
            levels.append(np.unique(levels[-1][0] & np.uint32((1 << k * BITS) - 1), return_counts=True))
        levels.reverse()
        self.base = 1.0 / (1 << BITS)
        self.grams: list = []
        self.contexts: list = []
        for k, (grams, n) in enumerate(levels, 1):
            n = np.asarray(n, np.float64)
            d = _discount(n)
            history = grams >> np.uint32(BITS)
            first = np.concatenate([[True], history[1:] != history[:-1]]) if len(history) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            total, kinds = np.add.reduceat(n, at), np.diff(np.append(at, len(n)))
            which = np.cumsum(first) - 1
            weight = d * kinds / total
            p = np.maximum(n - d, 0) / total[which] + weight[which] * self.lower(grams & np.uint32((1 << (k - 1) * BITS) - 1), k - 1)
            self.grams.append((B.mix(grams.astype(np.uint64)), p))
            self.contexts.append((B.mix(history[at].astype(np.uint64)), weight))
            for store in (self.grams, self.contexts):
                keys, values = store[-1]
                by_hash = np.argsort(keys)
                store[-1] = keys[by_hash], values[by_hash]

    @staticmethod
    def _find(store, codes):
        keys, values = store
        wanted = B.mix(codes.astype(np.uint64))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def lower(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Probability of the last symbol given the ``k - 1`` before it."""
        if k == 0:
            return np.full(len(codes), self.base)
        seen, p = self._find(self.grams[k - 1], codes)
        left = np.flatnonzero(~seen)
        if len(left):
            missing = codes[left]
            known, weight = self._find(self.contexts[k - 1], missing >> np.uint32(BITS))
            p = p.copy()
            p[left] = np.where(known, weight, 1.0) * self.lower(missing & np.uint32((1 << (k - 1) * BITS) - 1), k - 1)
        return p

    def bits(self, codes: np.ndarray) -> np.ndarray:
        return -np.log2(self.lower(codes, ORDER))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, KneserNey]:
    """Models of all languages of ``docs`` (rows with a null language or text are left
    out).  The collected table has at most 2^21 rows per language."""
    counts = gram_counts(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), text_col, lang_col)
    got = counts.toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    codes, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    return {lang: KneserNey(codes[langs == lang], n[langs == lang]) for lang in sorted(set(langs))}


# ---------------------------------------------------------------- scoring


def entropies(docs: DataFrame, models: dict[str, KneserNey], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``n_symbols``, ``n_letters`` and ``entropy`` (bits per
    symbol, one entry per language in the order of ``models``).  An input column of such a
    name is kept as ``<name>_in``."""
    spark = docs.sparkSession
    docs, (text_col,) = set_aside(docs, ["n_symbols", "n_letters", "entropy"], [text_col])
    shared = spark.sparkContext.broadcast(list(models.values()))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["n_symbols bigint, n_letters bigint, entropy array<double>"])

    def run(batches):
        own = shared.value
        for batch in batches:
            n, letters, scores = [], [], []
            for _, content, offsets in B.text_blocks(batch.column(batch.schema.get_field_index(text_col))):
                code, row = gram_codes(content, offsets)
                rows = len(offsets) - 1
                size = np.bincount(row, minlength=rows)
                seen, at = np.unique(code, return_inverse=True)
                out = np.empty((rows, len(own)))
                for j, model in enumerate(own):
                    out[:, j] = np.bincount(row, model.bits(seen)[at], minlength=rows) / np.maximum(size, 1)
                n.append(size)
                symbol = code & np.uint32((1 << BITS) - 1)
                letters.append(np.bincount(row[(symbol != BLANK) & (symbol < MARKS)], minlength=rows))
                scores.append(out)
            flat = np.concatenate(scores) if scores else np.zeros((0, len(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (n, letters)]
                + [pa.array(list(flat), pa.list_(pa.float64()))],
                [f.name for f in kept] + ["n_symbols", "n_letters", "entropy"])

    return docs.mapInArrow(run, schema)


def classify(scored: DataFrame, langs: list[str], training: Column, lang_col: str = "lang") -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    The rejection bound comes from the entropies that the ``training`` rows have in
    their own language (one aggregate, a row per language).  Columns that have one of these
    names are kept as ``<name>_in``."""
    (own_training,) = fresh(scored, "_training")
    scored = scored.withColumn(own_training, training)
    scored, (lang_col,) = set_aside(scored, ["lang_pred", "score", "cross_entropy", "rejected"], [lang_col])
    index = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    own = F.try_element_at(F.col("entropy"), index[F.col(lang_col)] + 1)
    stats = {r.lang: r.m + REJECT * (r.s or 0.0) for r in
             scored.where(F.col(own_training) & F.col(lang_col).isNotNull() & (F.col("n_letters") > 0))
                   .groupBy(F.col(lang_col).alias("lang")).agg(F.avg(own).alias("m"), F.stddev_pop(own).alias("s")).collect()}
    bound = F.array(*[F.lit(float(stats.get(lang, 0.0))) for lang in langs])
    best = F.array_min("entropy")
    at = F.array_position("entropy", best).cast("int")
    # posterior under equal priors, over at most SCORE_SYMBOLS symbols
    sharp = F.least(F.col("n_symbols"), F.lit(SCORE_SYMBOLS))
    others = F.aggregate("entropy", F.lit(0.0), lambda a, h: a + F.pow(F.lit(2.0), (best - h) * sharp))
    none = F.col("n_letters") == 0
    return (scored.withColumn("lang_pred", F.when(none, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, langs)), at)))
                  .withColumn("score", F.when(none, 0.0).otherwise(1.0 / others))
                  .withColumn("cross_entropy", F.when(~none, best))
                  .withColumn("rejected", none | (best > F.element_at(bound, at))).drop(own_training))


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    models = train(docs.where(~held_out))
    rows = docs.select("doc_id", "lang", held_out.alias("held_out"), "text")
    if not models:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    scored = cut(entropies(rows, models), "language")
    return (classify(scored, list(models), ~F.col("held_out"))
            .select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"))
