"""Toxicity as multiple-instance learning.

A document is a bag of sentences.  A sentence scores s = sigmoid(bias + weights of its
features), and exactly 0 without a feature; the document combines them by noisy-or,
p = 1 - prod(1 - s): one bad sentence is enough, any number of featureless ones is not.
In scoring, of the sentences below ``WEAK`` only the strongest enters the product.
Weights are trained from
document labels only, through the noisy-or; the trained sentence scores then locate the
offending sentences.

Features are hashed words and word beginnings (``PREFIXES`` bytes).  The classifier is
fitted on a bounded sample of labelled rows: the ``SAMPLE`` rows of each label with the
smallest hash of their id among texts of at most ``SAMPLE_TEXT`` characters.  Features
are screened by their document frequencies in the sample; at most ``FEATURES`` remain.
Scoring covers every whole text and shuffles nothing.

Defined results: null and empty texts have no sentence, so score 0; labels of null,
and labels other than 0 and 1, are not learned from; several labels of one id count
as toxic if one is; without both labels in the sample every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import bytes_of as B
from gridlake.llm.language import fold
from gridlake.llm.tables import cut, set_aside, table

SAMPLE, SAMPLE_TEXT, FEATURES = 6000, 50_000, 20_000
PREFIXES = (4, 5, 6)
BUCKET_BITS = 20
#: Screening: least toxic documents of a feature, least log odds against the harmless ones.
MIN_TOXIC, MIN_ODDS = 4, 1.5
EPOCHS, RATE, L2, BIAS = 300, 0.5, 1e-4, -12.0
THRESHOLD = 0.3
#: Sentences that score less than this count by the strongest of them alone, or any number
#: of them would make a long text toxic.
WEAK = 0.01

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
ENDS = np.zeros(256, bool)
ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True  # line end, ! . ?


def features_of(content: np.ndarray, offsets: np.ndarray):
    """``(buckets, sentence, rows, bounds)``: hashed features of every word (a row per
    word), the sentence of each word, the document of each sentence, and the sentences'
    byte ranges.  Only sentences with a word count."""
    low = B.LOWER[content]
    starts, ends, row = B.words(low, offsets, IS_WORD)
    sums = B.prefix_hash(B._CODES[low], B.BASE)
    keys = [B.range_hash(sums, starts, ends, B.BASE)]
    for n in PREFIXES:
        keys.append(B.range_hash(sums, starts, np.minimum(starts + n, ends), B.BASE) + np.uint64(n))
    buckets = np.stack([(B.mix(k) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for k in keys], 1)
    stop = np.concatenate([[0], np.cumsum(ENDS[content])])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (stop[1:] != stop[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    return buckets, sentence, row[at], (starts[at] - offsets[row[at]], ends[last] - offsets[row[at]])


def _screen(sample: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Buckets that stand out in toxic documents, and the sample's size by label."""

    def count(batches):
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        docs = [0, 0]
        for batch in batches:
            label = np.array(batch.column("toxic").to_pylist(), np.int64)
            for first, content, offsets in B.text_blocks(batch.column("text")):
                buckets, sentence, rows, _ = features_of(content, offsets)
                own = label[first:first + len(offsets) - 1]
                for y in (0, 1):
                    docs[y] += int((own == y).sum())
                pairs = np.unique((rows[sentence][:, None] << BUCKET_BITS | buckets).ravel())
                r, b = pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1
                for y in (0, 1):
                    seen[y] += np.bincount(b[own[r] == y], minlength=1 << BUCKET_BITS).astype(np.int32)
        at = np.flatnonzero(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(np.append(at, -1).astype(np.int64)),
            "toxic": pa.array(np.append(seen[1][at], docs[1]).astype(np.int64)),
            "harmless": pa.array(np.append(seen[0][at], docs[0]).astype(np.int64))})

    both = sample.mapInArrow(count, "bucket bigint, toxic bigint, harmless bigint")
    got = (both.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("harmless").alias("h")))
    size = got.where("bucket = -1").first()
    n = {1: int(size.t or 0), 0: int(size.h or 0)} if size else {0: 0, 1: 0}
    if not n[0] or not n[1]:
        return np.zeros(0, np.int64), n
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("h") + 0.5) / (n[0] + 1))
    best = (got.where("bucket >= 0").where(F.col("t") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
               .orderBy(F.desc(F.col("odds") * F.col("t")), "bucket").limit(FEATURES).select("bucket").collect())
    return np.sort(np.array([r.bucket for r in best], np.int64)), n


def _instances(sample: DataFrame, known: np.ndarray) -> pa.Table:
    """The sentences of the sample that have a screened feature, and each document's
    number of sentences."""
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        for batch in batches:
            label = batch.column("toxic").to_pylist()
            out = []
            for first, content, offsets in B.text_blocks(batch.column("text")):
                buckets, sentence, rows, _ = features_of(content, offsets)
                at = np.minimum(np.searchsorted(known, buckets), max(len(known) - 1, 0))
                hit = known[at] == buckets
                pairs = np.unique(sentence.repeat(buckets.shape[1])[hit.ravel()] * len(known) + at[hit])
                s, f = pairs // len(known), pairs % len(known)
                counts = np.bincount(rows, minlength=len(offsets) - 1)
                first_sentence = np.concatenate([[0], np.cumsum(counts)])
                cut = np.searchsorted(rows[s], np.arange(len(offsets)))
                out += [(label[first + r], int(counts[r]), (s[a:b] - first_sentence[r]).tolist(), f[a:b].tolist())
                        for r, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
            if out:
                y, n, s, f = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int32())),
                     pa.array(f, pa.list_(pa.int32()))], ["y", "n", "s", "f"])

    return sample.mapInArrow(run, "y int, n bigint, s array<int>, f array<int>").toArrow()


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: pa.Table, n_features: int, share: float) -> tuple[np.ndarray, float]:
    """Weights by gradient descent on the log loss of the noisy-or.

    A sentence without features scores 0.  ``share`` is the toxic share of
    all labelled rows: it weighs the sample's labels back to it."""
    y = rows.column("y").to_numpy().astype(np.float64)
    s_lists, f_lists = rows.column("s").combine_chunks(), rows.column("f").combine_chunks()
    lengths = np.diff(np.asarray(s_lists.offsets))
    s_flat, f = np.asarray(s_lists.flatten()).astype(np.int64), np.asarray(f_lists.flatten()).astype(np.int64)
    doc_of = np.repeat(np.arange(len(y)), lengths)
    _, sentence = np.unique(doc_of << 32 | s_flat, return_inverse=True)
    n_sentences = int(sentence.max()) + 1 if len(sentence) else 0
    doc = np.zeros(n_sentences, np.int64)
    doc[sentence] = doc_of
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
    w, bias = np.zeros(n_features), BIAS
    m, v = np.zeros(n_features), np.zeros(n_features)
    for step in range(1, EPOCHS + 1):
        s = sigmoid(bias + np.bincount(sentence, w[f], minlength=n_sentences))
        clean = np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(y))
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: s for a harmless document, -s (1 - p) / p for a toxic one
        pull = np.where(y == 1, -(1 - p) / p, 1.0) * weight
        g = np.bincount(f, (s * pull[doc])[sentence], minlength=n_features) + L2 * w / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-12)
        w = np.clip(w, -4, 20)
    return w, bias


class Model:
    """Feature buckets with weights, and the bias of a sentence."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on the bounded sample of the labelled rows of ``docs``.

    Only ids and lengths are joined with the labels; the texts of the sample (at most
    ``2 * SAMPLE`` ids, a proven bound of the broadcast) are fetched afterwards, of an id
    with several texts the first in order."""
    known = (labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id"))
                   .agg(F.max("toxic").cast("int").alias("toxic")))
    sized = docs.groupBy(F.col(id_col).alias("id")).agg(F.max(F.length(text_col)).alias("n"))
    rows = cut(sized.join(known, "id"), "toxic-labels")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    short = rows.where(F.col("n") <= SAMPLE_TEXT)
    parts = [short.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "toxic")
             for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    sample = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_TEXT)
                     .join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"),
                 "toxic-sample")
    buckets, n = _screen(sample)
    if not len(buckets):
        return None
    weights, bias = fit(_instances(sample, buckets), len(buckets), counts[1] / (counts[0] + counts[1]))
    return Model(buckets, weights, bias)


#: What scoring adds: the noisy-or score, and of sentences at ``THRESHOLD`` or above the
#: byte ranges (start, end, start, end, ...) with their scores.
ADDED = "score double, n_sentences bigint, offending array<bigint>, offending_scores array<double>"


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``ADDED`` (an input column of such a name is kept as
    ``<name>_in``)."""
    docs, (text_col,) = set_aside(docs, [f.split()[0] for f in ADDED.split(", ")], [text_col])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    if model is None:
        model = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [ADDED])
    cache: dict = {}

    def run(batches):
        if "w" not in cache:
            cache["w"] = shared.value.table()
        w, bias = cache["w"], shared.value.bias
        for batch in batches:
            scores, sizes, spans, span_scores = [], [], [], []
            for _, content, offsets in B.text_blocks(batch.column(batch.schema.get_field_index(text_col))):
                buckets, sentence, rows, (start, end) = features_of(content, offsets)
                n_rows, n = len(offsets) - 1, len(rows)
                each = w[buckets]
                # a feature counts once in a sentence, as in training
                hit = np.flatnonzero(each.ravel())
                key = np.unique(sentence.repeat(buckets.shape[1])[hit] << BUCKET_BITS | buckets.ravel()[hit])
                logit = bias + np.bincount(key >> BUCKET_BITS, w[key & (1 << BUCKET_BITS) - 1], minlength=n)
                # none of its own: 0, or length alone would make a text toxic
                s = np.where(np.bincount(key >> BUCKET_BITS, minlength=n) > 0, sigmoid(logit), 0.0)
                clean = np.bincount(rows, np.where(s < WEAK, 0.0, np.log1p(-np.minimum(s, 1 - 1e-12))), minlength=n_rows)
                faint = np.zeros(n_rows)
                np.maximum.at(faint, rows, np.where(s < WEAK, s, 0.0))
                scores.append(1 - (1 - faint) * np.exp(clean))
                sizes.append(np.bincount(rows, minlength=n_rows))
                bad = np.flatnonzero(s >= THRESHOLD)
                cut = np.searchsorted(rows[bad], np.arange(n_rows + 1))
                flat = np.stack([start[bad], end[bad]], 1)
                spans += [flat[a:b].ravel().tolist() for a, b in zip(cut[:-1], cut[1:])]
                span_scores += [s[bad[a:b]].tolist() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                   pa.array(np.concatenate(sizes).astype(np.int64) if sizes else [], pa.int64()),
                   pa.array(spans, pa.list_(pa.int64())), pa.array(span_scores, pa.list_(pa.float64()))],
                [f.name for f in kept] + ["score", "n_sentences", "offending", "offending_scores"])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                                     "n_sentences", "offending")
