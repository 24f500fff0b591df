"""Runs of repeated words: maximal periodic stretches of every text, found by longest
common extensions over a difference cover.

A *run* is a stretch of consecutive words with smallest period q that no neighbouring word
extends; it is reported from ``MIN_COPIES`` periods and ``MIN_WORDS`` words on.

*Extensions.*  How far the words from i and from j agree is asked many times.  Only
suffixes that start in a difference cover (``COVER`` modulo ``MODULUS``) are sorted: for
any i and j some shift below ``MODULUS`` moves both into the cover.  So a question
compares a few words up to that shift and takes the rest from the sorted sample: the
smallest common prefix between the two ranks, by a sparse table.  The same over the
reversed words extends to the left.

*Enumeration.*  A run of period q agrees with itself q words on over at least
``(MIN_COPIES - 1) q`` places, so it covers a point of the grid of that width.  For every q
the grid's points are asked; over all q these are harmonically many, n log n for n words.

Consecutive rows form blocks of bounded size that are handled in one go (words of
different texts never agree); a longer text is a block of its own.  Work is NumPy inside
tasks; nothing is shuffled and no row needs another.

Defined results: a null or empty text, or one of white space, has no words and no runs;
repeated rows are independent; an empty table gives an empty one; a null id is kept (and
in the query rearranges nothing).  Further columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlake.llm.bytes_of import text_blocks
from gridlake.llm.tables import table

MIN_WORDS = 6
MIN_COPIES = 4
#: A perfect difference set: every number below 13 is a difference of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)

_IN_COVER = np.isin(np.arange(MODULUS), COVER)


def _shifts() -> np.ndarray:
    """The smallest shift that moves residues a and b into the cover, for each (a, b)."""
    out = np.empty((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS])
    return out


SHIFT = _shifts()


class Extensions:
    """Longest common extensions to the right over an array of numbers.

    The last ``MODULUS`` entries must differ from all others (the caller's padding)."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        at = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        at = at[at + MODULUS <= n]  # whole first stretches; what is cut off is padding
        place = np.full(n, -1, np.int64)  # of each sampled position in ``at``
        place[at] = np.arange(len(at))
        # names of the first MODULUS words of each sampled suffix, then of twice as many ...
        name = np.zeros(len(at), np.int64)
        size = int(words.max(initial=0)) + 1
        for k in range(MODULUS):
            name = name * size + words[at + k]
            if k == MODULUS - 1 or (int(name.max(initial=0)) + 1) * size >= 1 << 62:
                name = np.unique(name, return_inverse=True)[1]
        self.names, steps = [name], [MODULUS]
        while len(at) and int(name.max()) + 1 < len(at):
            step = steps[-1]
            far = np.where(at + step < n, place[np.minimum(at + step, n - 1)], -1)
            name = np.unique(name * (len(at) + 1) + np.where(far >= 0, name[far] + 1, 0), return_inverse=True)[1]
            self.names.append(name)
            steps.append(2 * step)
        order = np.empty(len(at), np.int64)
        order[name] = np.arange(len(at))
        self.rank, self.place, self.n = name, place, n
        # common prefixes of neighbours in order: whole stretches by names, then single words
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for names, step in zip(self.names[::-1], steps[::-1]):
            pa_, pb_ = self._place(a + common), self._place(b + common)
            same = (pa_ >= 0) & (pb_ >= 0) & (names[pa_] == names[pb_])
            common[same] += step
        common += self._few(a + common, b + common, np.full(len(a), MODULUS))
        self.tables = [common.astype(np.int32)]
        while 2 << len(self.tables) - 1 <= len(common):
            half, last = 1 << len(self.tables) - 1, self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))
        del self.names

    def _place(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.n, self.place[np.minimum(at, self.n - 1)], -1)

    def _few(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and j agree, ``limit`` at most."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(limit > 0)
        for k in range(MODULUS):
            x, y = i[live] + k, j[live] + k
            ok = (x < self.n) & (y < self.n)
            ok[ok] = self.words[x[ok]] == self.words[y[ok]]
            live = live[ok]
            out[live] = k + 1
            live = live[limit[live] > k + 1]
            if not len(live):
                break
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension from each i and j (i != j)."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._few(i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = self._place(i[far] + shift[far]), self._place(j[far] + shift[far])
        known = (x >= 0) & (y >= 0)
        far, x, y = far[known], self.rank[x[known]], self.rank[y[known]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            pick = level == k
            t = self.tables[k]
            out[far[pick]] += np.minimum(t[low[pick]], t[high[pick] - (1 << int(k))])
        return out


def _grid(starts: np.ndarray, counts: np.ndarray, copies: int):
    """``(i, q)``: for every text and period q, the places i from its first word on, every
    ``(copies - 1) q`` words, where a word q further still belongs to the text."""
    periods = counts // copies
    text = np.repeat(np.arange(len(starts)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (copies - 1) * q
    points = -(-(counts[text] - q) // step)
    which = np.repeat(np.arange(len(q)), points)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(points) - points, points)
    return starts[text][which] + nth * step[which], q[which]


def find_runs(words: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS,
              min_copies: int = MIN_COPIES) -> np.ndarray:
    """All runs in texts that lie one after the other in ``words`` (a number from 0 per
    distinct word): rows (start, end, period), by start and period; starts count from the
    first text's first word."""
    n, starts = len(words), np.cumsum(counts) - counts
    none = np.zeros((0, 3), np.int64)
    i, q = _grid(starts, counts, min_copies)
    same = words[i] == words[i + q]
    i, q = i[same], q[same]
    if not len(i):
        return none
    # a mark of its own after each text and at both ends keeps extensions inside
    text = np.repeat(np.arange(len(counts)), counts)
    top = int(words.max()) + 1
    marks = np.arange(top, top + len(counts) + 2 * MODULUS)
    long = np.empty(n + len(marks), np.int64)
    at = np.arange(n) + MODULUS + text
    long[:MODULUS], long[MODULUS + n + len(counts):] = marks[:MODULUS], marks[MODULUS:2 * MODULUS]
    long[MODULUS + starts + counts + np.arange(len(counts))] = marks[2 * MODULUS:]
    long[at] = words
    x = at[i]
    right = Extensions(long)(x, x + q)
    left = Extensions(long[::-1].copy())(len(long) - x, len(long) - x - q)
    length = left + right + q
    keep = length >= np.maximum(min_words, min_copies * q)
    found = np.stack([i - left, i - left + length, q], 1)[keep]
    if not len(found):
        return none
    # a stretch with periods q and a divisor of q is the divisor's run
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def rearranged(words: list[bytes], doc_id) -> list[bytes]:
    """The query's test data: every tenth document, chosen by its id's CRC, repeats a
    stretch of its words from some place on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * times)[:n - a]


def _blocks(batches, change):
    """``(ids, words of all texts, counts)`` of consecutive rows."""
    for batch in batches:
        ids = batch.column(0)
        for first, content, offsets in text_blocks(batch.column(1)):
            part = ids.slice(first, len(offsets) - 1)
            words, counts = [], np.zeros(len(part), np.int64)
            for k, doc in enumerate(part.to_pylist()):
                own = content[offsets[k]:offsets[k + 1]].tobytes().split()  # ASCII white space
                own = change(own, doc) if change else own
                words += own
                counts[k] = len(own)
            yield part, words, counts


def _runs_of(words, counts, **limits):
    if not len(words):
        return np.zeros((0, 3), np.int64), np.zeros(len(counts) + 1, np.int64)
    runs = find_runs(word_numbers(words), counts, **limits)
    return runs, np.searchsorted(runs[:, 0], np.append(np.cumsum(counts) - counts, len(words)))


def _copies_dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each word goes when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS,
         min_copies: int = MIN_COPIES, change=None) -> DataFrame:
    """One row per run: ``id, start, length, period`` (in words of the text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for ids, words, counts in _blocks(batches, change):
            found, of = _runs_of(words, counts, min_words=min_words, min_copies=min_copies)
            text = np.repeat(np.arange(len(counts)), np.diff(of))
            begin = (np.cumsum(counts) - counts)[text]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text)), pa.array(found[:, 0] - begin), pa.array(found[:, 1] - found[:, 0]),
                 pa.array(found[:, 2])], ["id", "start", "length", "period"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start bigint, length bigint, period bigint")


def collapse(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", change=None) -> DataFrame:
    """Per row: ``id`` and its ``text`` with the first period of every run only, words
    joined by one blank (a null text becomes an empty one)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for ids, words, counts in _blocks(batches, change):
            found, _ = _runs_of(words, counts)
            keep = ~_copies_dropped(found, len(words))
            ends = np.cumsum(counts)
            texts = [b" ".join([words[k] for k in np.flatnonzero(keep[e - c:e]) + (e - c)]).decode()
                     for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["id", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, text string")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", change=None) -> DataFrame:
    """Per row: number of runs, the run of the greatest exponent (ties: smallest start, then
    period) and hashes of all runs and of the collapsed text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")

    def digest(words, first, found, dropped):
        if not len(found):
            return 0, None, None, None, None, no_runs, hashlib.sha256(b" ".join(words)).hexdigest()
        best, lines = None, []
        for start, end, q in found.tolist():
            start, length = start - first, end - start
            lines.append(f"{start},{length},{q}\n")
            if best is None or length * best[2] > best[1] * q:  # runs come by start, then period
                best = start, length, q
        kept = b" ".join([w for w, gone in zip(words, dropped.tolist()) if not gone])
        return (len(found), *best, 1000 * best[1] // best[2], hashlib.sha256("".join(lines).encode()).hexdigest(),
                hashlib.sha256(kept).hexdigest())

    no_runs = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for ids, words, counts in _blocks(batches, change):
            found, of = _runs_of(words, counts)
            dropped = _copies_dropped(found, len(words))
            rows, at = [], 0
            for k, n in enumerate(counts.tolist()):
                rows.append(digest(words[at:at + n], at, found[of[k]:of[k + 1]], dropped[at:at + n]))
                at += n
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]],
                [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), change=rearranged)
