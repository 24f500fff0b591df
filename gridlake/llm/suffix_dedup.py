"""Removal of byte strings that repeat across documents, by column-wise construction of
the sorted suffixes (positional Burrows-Wheeler transform with common prefixes).

A string of ``LENGTH`` bytes repeats when it also starts in a document with a smaller
id.  Building one suffix order over a whole corpus takes as many rounds as the longest
text has bytes, so the collection is first cut into bounded aligned pieces that cannot
lose a repeat:

1. Anchors.  The anchor of a ``LENGTH``-byte window is the ``ANCHOR``-byte string of the
   smallest hash in it; equal windows have equal anchors at equal places.  Anchors that
   occur in one document only are dropped together with their windows: those cannot
   repeat.  Each task settles the anchors it sees in several of its documents by
   itself and asks about the others by hash bucket, so a passage of very many
   documents costs one question per block of text.
2. Columns.  The pieces around each remaining anchor (``LENGTH - ANCHOR`` bytes to
   either side) are the collection of their bucket, aligned at the anchor.  Each round
   inserts one symbol per piece, from the last column to the first, read from a
   sequential file: a stable counting sort by that symbol gives the new suffix order,
   and the common-prefix array follows from range minima of the old one.  Suffixes
   with a common prefix of ``LENGTH`` or more are equal windows; the smallest document
   of such a run covers them in all others.
3. Equal pieces within one block of text enter once, with their smallest document; an
   anchor with more than ``HOT`` occurrences is not gathered in one bucket: its windows
   are dealt out by their own hashes instead, with the same rule.  Nothing is dropped.

Covered ranges come back per document; the texts are joined with them by id.

Defined results: texts are UTF-8 bytes, null is empty; texts shorter than ``LENGTH``
lose nothing; documents of equal id do not cover each other; rows with a null id are
neither removed from nor cover others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import bytes_of as B
from gridlake.llm.tables import cut, free_shuffles, fresh, set_aside, table

LENGTH, ANCHOR = 50, 24
#: Bytes of text that a task handles as one block, and anchors per hash bucket.
BLOCK, PER_BUCKET = 8 << 20, 400_000
#: Occurrences from which an anchor's windows are dealt out one by one.
HOT = 200_000
SEGMENT = 1 << 19
SPOOL = 32 << 20


# ---------------------------------------------------------------- columns


def column_rounds(pieces: np.ndarray):
    """``(column, order, lcp)`` after each round, from the last column to the first.

    ``order`` lists the pieces by their suffix from the column on, ``lcp[i]`` is the
    common prefix of the suffixes at ``order[i - 1]`` and ``order[i]`` (255 at most).
    The symbols of the next column in this order are the column's part of the transform.
    """
    n, width = pieces.shape
    with tempfile.SpooledTemporaryFile(SPOOL) as columns:
        columns.write(np.ascontiguousarray(pieces.T[::-1]).tobytes())
        columns.seek(0)
        order = np.arange(n)
        lcp = np.zeros(n + 1, np.uint8)  # no symbol yet: nothing in common
        fresh = True
        for column in range(width - 1, -1, -1):
            symbols = np.frombuffer(columns.read(n), np.uint8)[order]
            by_symbol = np.argsort(symbols, kind="stable")
            same = np.zeros(n, bool)
            ranked = symbols[by_symbol]
            same[1:] = ranked[1:] == ranked[:-1]
            new = np.zeros(n + 1, np.uint8)
            at = np.flatnonzero(same)
            if len(at):
                if fresh:
                    new[at] = 1
                else:
                    ends = np.empty(2 * len(at), np.int64)
                    ends[0::2], ends[1::2] = by_symbol[at - 1] + 1, by_symbol[at] + 1
                    least = np.minimum.reduceat(lcp, ends)[0::2]
                    new[at] = np.minimum(least, 254) + 1
            order, lcp, fresh = order[by_symbol], new, False
            yield column, order, lcp[:n]


def repeated_windows(pieces: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray,
                     length: int = LENGTH) -> np.ndarray:
    """Bit c of a piece: its window from column c is one that a piece of a smaller
    document has at the same column.  Only columns ``first`` to ``last`` of a piece
    start windows."""
    out = np.zeros(len(pieces), np.uint32)
    limit = np.iinfo(np.int64).max
    for column, order, lcp in column_rounds(pieces):
        if column > pieces.shape[1] - length:
            continue
        valid = ((first <= column) & (column <= last))[order]
        own = np.where(valid, docs[order], limit)
        start = np.flatnonzero(lcp < length)
        size = np.diff(np.append(start, len(order)))
        least = np.repeat(np.minimum.reduceat(own, start), size)
        hit = valid & (least < own)
        out[order[hit]] |= np.uint32(1 << column)
    return out


# ---------------------------------------------------------------- anchors


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(content: np.ndarray, offsets: np.ndarray):
    """``(hash, position)`` of the anchors of all windows that lie in one text: the
    leftmost place of the smallest 40-bit hash in each window."""
    reach = LENGTH - ANCHOR
    places, hashes = [], []
    for begin in range(0, max(len(content) - LENGTH + 1, 0), SEGMENT):
        part = content[begin:begin + SEGMENT + LENGTH - 1]
        sums = B.prefix_hash(B._CODES[part], B.BASE)
        at = np.arange(len(part) - ANCHOR + 1)
        each = B.range_hash(sums, at, at + ANCHOR, B.BASE)
        low = np.uint64((1 << 24) - 1)
        place = (_sliding_min(each & ~low | at.astype(np.uint64), reach + 1) & low).astype(np.int64)
        row = np.searchsorted(offsets, begin + np.arange(len(place)), "right")
        whole = begin + np.arange(len(place)) + LENGTH <= offsets[row]
        place = place[whole]
        place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
        places.append(begin + place)
        hashes.append(each[place])
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, value = np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]  # a segment may repeat the last place of the one before
    return value[new], place[new]


# ---------------------------------------------------------------- blocks and blobs


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; equal bytes of the numbers lie side by side."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
                     if a.itemsize > 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    at, out = 8 * len(types), []
    for n, kind in zip(raw[:at].view(np.int64).tolist(), types):
        size = np.dtype(kind).itemsize
        columns = raw[at:at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(columns.T).reshape(-1).view(kind))
        at += n * size
    return out


def _joined(blobs: list, *types) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*[_unpack(b, *types) for b in blobs])]


def _by_document(doc: np.ndarray, tag: np.ndarray, *values: np.ndarray):
    """``(doc, tag, slices of values)`` per document."""
    order = np.lexsort((tag, doc))
    doc, tag, values = doc[order], tag[order], [v[order] for v in values]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else []
    for a, b in zip(start, np.append(start[1:], len(doc)) if len(doc) else []):
        yield int(doc[a]), int(tag[a]), [v[a:b] for v in values]


def _list_rows(doc, tag, payload):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(payload, pa.binary())],
                                      ["id", "tag", "payload"])


ROUTED = "bucket int, kind int, payload binary"
LISTED = "id bigint, tag bigint, payload binary"
REFS, KNOWN, PIECES, WINDOWS, SPANS, LISTS, HEAVY = range(7)


def _route(kind: int, bucket, payload):
    n = len(payload)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * n, pa.int32()),
                                       pa.array(payload, pa.binary())], ["bucket", "kind", "payload"])


def _buckets(value: np.ndarray, n: int):
    """``(bucket, order slices)`` of hashes."""
    bucket = (B.mix(value) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut_at = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.unique(bucket).tolist():
        yield b, order[cut_at[b]:cut_at[b + 1]]


def _blocks(batches, text_index: int):
    """Groups of ``(batch slices)`` with about ``BLOCK`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        text = batch.column(text_index)
        for first, content, offsets in B.text_blocks(text):
            held.append((batch.slice(first, len(offsets) - 1), content, offsets))
            size += len(content)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


# ---------------------------------------------------------------- step 1: anchors in several documents


def _ask(docs: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches):
        for block in _blocks(batches, 2):
            parts = []
            for rows, content, offsets in block:
                value, place = anchors(content, offsets)
                row = np.searchsorted(offsets, place, "right") - 1
                parts.append((value, rows.column(0).to_numpy()[row], rows.column(1).to_numpy()[row].astype(np.uint32),
                              (place - offsets[row]).astype(np.uint32)))
            h, doc, tag, pos = map(np.concatenate, zip(*parts))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            ranked, by = h[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            size = np.diff(np.append(start, len(h)))
            several = np.minimum.reduceat(by, start) < np.maximum.reduceat(by, start)
            known = np.empty(len(h), bool)
            known[order] = np.repeat(several, size)
            if several.any():  # settled here; the buckets learn only that the anchor is shared, and how often
                yield _route(KNOWN, [int(doc[0] % n_buckets)], [_pack(doc[known], tag[known], pos[known])])
            shared, often = ranked[start[several]], size[several]
            h, doc, tag, pos = h[~known], doc[~known], tag[~known], pos[~known]  # in document order
            told = dict(_buckets(shared, n_buckets))
            for b, at in _buckets(h, n_buckets):
                mine = told.pop(b, np.zeros(0, np.int64))
                yield _route(REFS, [b], [_pack(h[at], doc[at], tag[at], pos[at], shared[mine], often[mine])])
            for b, mine in told.items():
                yield _route(REFS, [b], [_pack(h[:0], doc[:0], tag[:0], pos[:0], shared[mine], often[mine])])

    return docs.mapInArrow(run, ROUTED)


def _groups(batches):
    """``(bucket, {kind: blobs})`` of rows sorted by bucket."""
    bucket, held = None, {}
    for batch in batches:
        for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield bucket, held


def _emit(parts: list, n_groups: int):
    """Gathered ``(doc, tag, value...)`` arrays, a routed row per group of documents."""
    doc, tag, *values = map(np.concatenate, zip(*parts))
    out = [(b, _pack(doc[at], tag[at], *[v[at] for v in values]))
           for b, at in _buckets(doc.view(np.uint64), n_groups)]
    for i in range(0, len(out), 500):
        yield _route(LISTS, *map(list, zip(*out[i:i + 500])))


def _per_document(routed: DataFrame, *types) -> DataFrame:
    """``(id, tag, payload)``: the values of each document together."""
    parts = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for _, held in _groups(batches):
            doc, tag, *values = _joined(held[LISTS], np.int64, np.uint32, *types)
            rows = [(d, t, np.stack(v, 1).tobytes()) for d, t, v in _by_document(doc, tag, *values)]
            for i in range(0, len(rows), 5000):
                yield _list_rows(*map(list, zip(*rows[i:i + 5000])))

    return routed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, LISTED)


def _answer(asked: DataFrame, hot: int, n_groups: int) -> DataFrame:
    """Anchor places by groups of documents, and the hashes of hot anchors."""

    def run(batches):
        parts, size = [], 0
        for _, held in _groups(batches):
            for blob in held.get(KNOWN, ()):
                parts.append(_unpack(blob, np.int64, np.uint32, np.uint32))
                size += len(parts[-1][0])
            if REFS in held:
                h, doc, tag, pos, shared, often = _joined(held[REFS], np.uint64, np.int64, np.uint32, np.uint32, np.uint64, np.int64)
                every = np.concatenate([h, shared])
                names, which = np.unique(every, return_inverse=True)
                mine, theirs = which[:len(h)], which[len(h):]
                least = np.full(len(names), np.iinfo(np.int64).max)
                most = np.full(len(names), np.iinfo(np.int64).min)
                np.minimum.at(least, mine, doc)
                np.maximum.at(most, mine, doc)
                repeats = least < most
                repeats[theirs] = True
                count = np.bincount(mine, minlength=len(names))
                count += np.bincount(theirs, often, minlength=len(names)).astype(np.int64)
                keep = repeats[mine]
                parts.append([doc[keep], tag[keep], pos[keep]])
                size += int(keep.sum())
                heavy = names[count > hot]
                if len(heavy):
                    yield _route(HEAVY, [-1], [_pack(heavy)])
            if size > 1_000_000:
                yield from _emit(parts, n_groups)
                parts, size = [], 0
        if parts:
            yield from _emit(parts, n_groups)

    return asked.mapInArrow(run, ROUTED)


# ---------------------------------------------------------------- step 2: pieces, columns, covered ranges


def _cut_pieces(content: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes around each place; what lies outside of its text (low, high) is 0."""
    reach = LENGTH - ANCHOR
    padded = np.zeros(len(content) + 2 * LENGTH, np.uint8)
    padded[reach:reach + len(content)] = content
    out = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + reach)[place].copy()
    short = np.flatnonzero((place - reach < low) | (place + LENGTH > high))
    column = place[short, None] + np.arange(-reach, LENGTH)
    out[short] = np.where((column >= low[short, None]) & (column < high[short, None]), out[short], 0)
    return out


def _piece_names(pieces: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 128-bit name of each piece and its window columns."""
    random = np.random.default_rng(11).integers(1, 1 << 63, (2, 256 + pieces.shape[1]), np.uint64) | np.uint64(1)
    out = np.empty((len(pieces), 2), np.uint64)
    for k in range(2):
        weights = random[k, 256:]
        for i in range(0, len(pieces), 1 << 14):
            out[i:i + (1 << 14), k] = (random[k, :256][pieces[i:i + (1 << 14)]] * weights).sum(1, dtype=np.uint64)
        out[:, k] = B.mix(out[:, k] + first.astype(np.uint64) * np.uint64(131) + last.astype(np.uint64) * np.uint64(8191))
    return out


def _runs(mask: np.ndarray, columns: int):
    """``(piece, first column, last column)`` of the runs of set bits."""
    bits = np.zeros((len(mask), columns + 2), bool)
    bits[:, 1:-1] = (mask[:, None] >> np.arange(columns, dtype=np.uint32)) & np.uint32(1)
    piece, begin = np.nonzero(bits[:, 1:] & ~bits[:, :-1])
    _, end = np.nonzero(bits[:, :-1] & ~bits[:, 1:])
    return piece, begin, end - 1


def _send(texts: DataFrame, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """Pieces and hot windows by bucket, and what equal pieces of a block settle."""
    reach = LENGTH - ANCHOR
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        heavy = shared.value
        for block in _blocks(batches, 2):
            found = []
            for rows, content, offsets in block:
                refs = rows.column(3).to_pylist()
                place, row = [], []
                for r, packed in enumerate(refs):
                    if packed:
                        p = np.unique(np.frombuffer(packed, np.uint32)).astype(np.int64) + offsets[r]
                        place.append(p)
                        row.append(np.full(len(p), r))
                if not place:
                    continue
                place, row = np.concatenate(place), np.concatenate(row)
                low, high = offsets[row], offsets[row + 1]
                ok = place + ANCHOR <= high  # places of another text of the same id
                place, row, low, high = place[ok], row[ok], low[ok], high[ok]
                first = np.maximum(0, low + reach - place)
                last = np.minimum(reach, high - ANCHOR - place)
                pos = place - low
                ok = first <= last
                found.append((_cut_pieces(content, place[ok], low[ok], high[ok]), rows.column(0).to_numpy()[row[ok]],
                              rows.column(1).to_numpy()[row[ok]].astype(np.uint32), pos[ok].astype(np.int64),
                              first[ok].astype(np.uint8), last[ok].astype(np.uint8)))
            if not found:
                continue
            pieces, doc, tag, pos, first, last = map(np.concatenate, zip(*found))
            del found
            _, same = np.unique(_piece_names(pieces, first, last), axis=0, return_inverse=True)
            same = same.ravel()
            least = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, doc)
            inner = doc > least[same]
            if inner.any():  # an equal piece of a smaller document: every window is covered
                b, e = pos[inner] - reach + first[inner], pos[inner] - reach + last[inner] + LENGTH
                yield _route(SPANS, [int(doc[0] % n_buckets)], [_pack(doc[inner], tag[inner], b, e)])
            keep = ~inner
            pieces, doc, tag, pos, first, last = (x[keep] for x in (pieces, doc, tag, pos, first, last))
            weights = B.powers(B.BASE, ANCHOR)
            h = np.empty(len(pieces), np.uint64)
            for i in range(0, len(pieces), 1 << 15):
                h[i:i + (1 << 15)] = B.mix((B._CODES[pieces[i:i + (1 << 15), reach:LENGTH]] * weights).sum(1, dtype=np.uint64))
            often = np.isin(h, heavy) if len(heavy) else np.zeros(len(h), bool)
            if often.any():
                at = np.flatnonzero(often)
                column = np.arange(reach + 1)
                use = (column >= first[at, None]) & (column <= last[at, None])
                piece, col = np.nonzero(use)
                names = np.empty(len(piece), np.uint64)
                weights = B.powers(B.BASE, LENGTH)
                windows = np.lib.stride_tricks.sliding_window_view(pieces[at], LENGTH, axis=1)
                for i in range(0, len(piece), 1 << 14):
                    some = windows[piece[i:i + (1 << 14)], col[i:i + (1 << 14)]]
                    names[i:i + (1 << 14)] = B.mix((B._CODES[some] * weights).sum(1, dtype=np.uint64))
                who = at[piece]
                begin = pos[who] - reach + col
                for b, m in _buckets(names, n_buckets):
                    yield _route(WINDOWS, [b], [_pack(names[m], doc[who[m]], tag[who[m]], begin[m])])
            at = np.flatnonzero(~often)
            for b, m in _buckets(h[at], n_buckets):
                m = at[m]
                yield _route(PIECES, [b], [_pack(pieces[m].ravel(), doc[m], tag[m], pos[m], first[m], last[m])])

    return texts.mapInArrow(run, ROUTED)


def _cover(sent: DataFrame, n_groups: int) -> DataFrame:
    """Covered byte ranges by groups of documents."""
    reach = LENGTH - ANCHOR

    def run(batches):
        parts, size = [], 0
        for _, held in _groups(batches):
            for blob in held.get(SPANS, ()):
                parts.append(_unpack(blob, np.int64, np.uint32, np.int64, np.int64))
            if PIECES in held:
                flat, doc, tag, pos, first, last = _joined(held[PIECES], np.uint8, np.int64, np.uint32, np.int64, np.uint8, np.uint8)
                mask = repeated_windows(flat.reshape(len(doc), -1), doc, first, last)
                piece, a, b = _runs(mask, reach + 1)
                parts.append([doc[piece], tag[piece], pos[piece] - reach + a, pos[piece] - reach + b + LENGTH])
            if WINDOWS in held:
                name, doc, tag, begin = _joined(held[WINDOWS], np.uint64, np.int64, np.uint32, np.int64)
                _, which = np.unique(name, return_inverse=True)
                least = np.full(which.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, which, doc)
                hit = doc > least[which]
                parts.append([doc[hit], tag[hit], begin[hit], begin[hit] + LENGTH])
            size = sum(len(p[0]) for p in parts)
            if size > 500_000:
                yield from _emit(parts, n_groups)
                parts = []
        if parts and size:
            yield from _emit(parts, n_groups)

    return sent.mapInArrow(run, ROUTED)


# ---------------------------------------------------------------- the operator


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(id, tag, spans)``: the covered byte ranges (packed int64 pairs, not merged) of
    every document that has any; ``tag`` is the CRC-32 of the text."""
    spark = docs.sparkSession
    rows = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
                .where("id is not null and octet_length(text) >= %d" % LENGTH))
    rows = rows.select("id", F.crc32(F.col("text").cast("binary")).alias("tag"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4 * parts, size // 14 // PER_BUCKET)

    def dealt(df):
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    found = cut(_answer(dealt(_ask(rows, n_buckets)), hot, parts), "anchors")
    free_shuffles(spark)
    # at most (all anchors / hot) of them
    heavy = [_unpack(r.payload, np.uint64)[0] for r in found.where(F.col("kind") == HEAVY).select("payload").collect()]
    heavy = np.concatenate(heavy) if heavy else np.zeros(0, np.uint64)
    lists = _per_document(found.where(F.col("kind") == LISTS), np.uint32)
    texts = rows.join(lists, ["id", "tag"]).select("id", "tag", "text", "payload")
    spans = cut(_cover(dealt(_send(texts, heavy, n_buckets)), parts), "repeats")
    free_shuffles(spark)
    return _per_document(spans, np.int64, np.int64).withColumnRenamed("payload", "spans")


def _merge(spans: bytes) -> np.ndarray:
    """Maximal ranges of packed ones."""
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    start = np.flatnonzero(new)
    return np.stack([pairs[start, 0], np.append(reach[start[1:] - 1], reach[-1])], 1)


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False) -> DataFrame:
    """``docs`` with the covered bytes cut out of the text (characters that lose a part
    of their bytes are left out), or with ``digest`` the columns of ``RESULT`` (an input
    column of such a name is kept as ``<name>_in``)."""
    if digest:
        docs, (id_col, text_col) = set_aside(docs, RESULT_NAMES, [id_col, text_col])
    found = repeated_ranges(docs, id_col, text_col)
    tag = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own_id, own_tag, own_spans = fresh(docs, "_id", "_tag", "_spans")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("bigint"), own_tag: tag})
    joined = keyed.join(found.select(F.col("id").alias(own_id), F.col("tag").alias(own_tag), F.col("spans").alias(own_spans)),
                        [own_id, own_tag], "left").drop(own_id, own_tag)
    kept = [f for f in docs.schema.fields if not (digest and f.name == text_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ([RESULT] if digest else []))

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            rows, texts = [], []
            for t, spans in zip(text, batch.column(own_spans).to_pylist()):
                value = t.as_py()
                if not spans:
                    texts.append(value)
                    if digest:
                        data = (value or "").encode()
                        rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                data, ranges, at, left = value.encode(), _merge(spans).tolist(), 0, []
                for a, b in ranges:
                    left.append(data[at:a])
                    at = b
                left = b"".join([*left, data[at:]])
                rows.append((len(data), len(data) - len(left), len(ranges), hashlib.sha256(left).hexdigest()))
                texts.append(left.decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in kept]
            names = [f.name for f in kept]
            if digest:
                n, removed, spans, sha = zip(*rows) if rows else ((), (), (), ())
                columns += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
                names += RESULT_NAMES
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
