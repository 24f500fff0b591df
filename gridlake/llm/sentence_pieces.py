"""SentencePiece BPE encoding through a table of prefixes, and decoding.

Merging by score is local: a sequence of pieces is the encoding of its text exactly when
every two neighbours are the encoding of theirs.  So each prefix of a text has one last
piece, and it follows from shorter prefixes: of the pieces that end there (matches of an
Aho-Corasick automaton) it is the one that is *compatible* with the last piece of the
prefix before it.  The table of last pieces is filled left to right; the ids are read off
it backwards.  Whether two pieces are compatible is found once by merging the two alone
and watching for a merge across their border, then remembered.

Texts are split where no piece of the model can reach across, which its vocabulary tells,
so the table is as long as a word; a word of any length costs time and memory in
proportion to it.  Ids of short words are remembered in two generations of bounded size.

Works for model files of the ``sentencepiece`` library of kind BPE with byte fallback, the
identity normaliser and no user-defined or unused pieces; others raise ``ValueError``.
The file is read on the driver and broadcast (its size is fixed by the vocabulary).

Defined results: a null or empty text has the end id alone and decodes to an empty text;
characters outside the vocabulary become their UTF-8 bytes; strings of control pieces in a
text are ordinary text; rows are independent and keep their number, repeated or not; an
empty table gives an empty one.  A column of the input that is named like an output column
is kept as ``<name>_in``.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlake.llm.bytes_of import text_blocks
from gridlake.llm.tables import set_aside, table

BLANK = "▁"
CACHE_WORDS = 300_000
CACHE_PAIRS = 1_000_000
LONGEST_CACHED = 64
FOREVER = float("inf")

#: Kinds of pieces and numbers of fields in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, BPE = 3, 35, 2
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5


def _fields(data: bytes):
    """``(field, value)`` of one protocol-buffer message: numbers, floats, byte strings."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        elif kind == 2:
            size = number()
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        yield tag >> 3, value


def _bytes_each(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("gridlake-each", _bytes_each)


class Pieces:
    """A model: scores, the automaton, and what is remembered of pairs and words."""

    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for field, value in _fields(data):
            if field == PIECES:
                pieces.append({1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normal = dict(_fields(value))
        kinds = [p[3] for p in pieces]
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("not a BPE model with byte fallback and plain pieces")
        if normal.get(CHARSMAP) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE, 1):
            raise ValueError("not the identity normaliser")
        self.prefix = BLANK if normal.get(DUMMY_PREFIX, 1) else ""
        self.piece = [p[1].decode() for p in pieces]
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.end = self.piece.index("</s>")
        self.byte_id = {int(self.piece[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        #: lower is merged first; pieces of equal score are merged from the left
        self.rank = {self.piece[i]: -p[2] for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.spelled = [str(i) for i in range(len(pieces))]
        self.raw = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE
                    else " ⁇ ".encode() if k == UNKNOWN else t.replace(BLANK, " ").encode()
                    for t, k in zip(self.piece, kinds)]
        #: piece -> symbols that stand at its left and right end while it is merged, each
        #: with the ranks of the merges that make it and that use it up
        self.ends: dict[int, tuple[list, list]] = {}
        for i, k in enumerate(kinds):
            if k == NORMAL and (ends := self._alone(self.piece[i])):
                self.ends[i] = ends
        usable = list(self.ends)
        self.unknown = kinds.index(UNKNOWN)
        self.ends[self.unknown] = [], []  # nothing is merged with a character outside
        self.shift = [len(t) - 1 for t in self.piece]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in usable:
            self.automaton.add_word(self.piece[i], i)
        self.automaton.make_automaton()
        self.split = self._splitter([self.piece[i] for i in usable])
        self.pairs: dict[int, bool] = {}
        #: ids of words as packed 32-bit numbers: the words met lately, and those before them
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _splitter(pieces: list[str]) -> re.Pattern | None:
        """Stretches that no piece reaches out of.  They end before a blank that follows no
        blank, and before a *mark* that follows no mark and no blank.  Marks are what is no
        ASCII letter, and all characters from which a piece steps to a mark."""
        steps = {(a, b) for t in pieces for a, b in zip(t, t[1:])}
        if any(b == BLANK != a for a, b in steps):
            return None
        marks = {chr(c) for c in range(128) if not chr(c).isalpha()}
        while more := {a for a, b in steps if b in marks and a != BLANK} - marks:
            marks |= more
        some = "".join(map(re.escape, sorted(marks)))
        return re.compile(f"{BLANK}*[{some}]*[^{BLANK}{some}]+|{BLANK}*[{some}]+|{BLANK}+")

    def _alone(self, piece: str) -> tuple[list, list] | None:
        """The ends of a piece over time when its characters are merged alone; ``None`` if
        that does not give the piece back (it is then in no encoding)."""
        rank, parts = self.rank, list(piece)
        left, right = [[parts[0], -FOREVER, FOREVER]], [[parts[-1], -FOREVER, FOREVER]]
        latest = -FOREVER
        while len(parts) > 1:
            best, at = FOREVER, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], FOREVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            if best < latest:
                raise ValueError("a merge of the model makes an earlier one possible")
            latest = best
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left[-1][2] = best
                left.append([parts[0], best, FOREVER])
            if at == len(parts) - 1:
                right[-1][2] = best
                right.append([parts[-1], best, FOREVER])
        return left, right

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of two pieces side by side gives the two.

        It does not if an end u of the left one and an end v of the right one that exist at
        one time can be merged before either is used up.  Of equal ranks the left comes first."""
        rank, starts = self.rank, self.ends[b][0]
        out = True
        for u, made, used in self.ends[a][1]:
            for v, made_v, used_v in starts:
                if made <= used_v and made_v < used:
                    r = rank.get(u + v)
                    if r is not None and r < used and r <= used_v:
                        out = False
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a * len(self.piece) + b] = out
        return out

    def last_pieces(self, word: str) -> list[int]:
        """For each prefix of ``word``, the last piece of its encoding: entry i belongs to
        the first i characters; the unknown piece stands for a character without one."""
        shift, known, n = self.shift, self.pairs.get, len(self.piece)
        last = [self.unknown] * (len(word) + 1)
        done = -1
        for end, piece in self.automaton.iter(word):
            if end == done:
                continue
            start = end - shift[piece]
            if start:
                before = last[start]
                fits = known(before * n + piece)
                if fits is None:
                    fits = self.compatible(before, piece)
                if not fits:
                    continue
            last[end + 1] = piece
            done = end
        return last

    def word(self, word: str) -> bytes:
        """Ids, packed, of a stretch of text that no piece reaches out of."""
        out = self.older.get(word)
        if out is None:
            last, at, ids, shift = self.last_pieces(word), len(word), [], self.shift
            while at:
                piece = last[at]
                if piece == self.unknown:
                    ids += [self.byte_id[b] for b in reversed(word[at - 1].encode())]
                    at -= 1
                else:
                    ids.append(piece)
                    at -= shift[piece] + 1
            ids.reverse()
            out = array("i", ids).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> array:
        """Ids of a text, the end id last."""
        ids = array("i")
        if text:
            text = self.prefix + text.replace(" ", BLANK)
            known, word = self.words.get, self.word
            ids.frombytes(b"".join([known(w) or word(w) for w in (self.split.findall(text) if self.split else [text])]))
        ids.append(self.end)
        return ids

    def decode(self, ids) -> str:
        """Text of ids: bytes of byte pieces form characters with their neighbours, each
        byte that forms none becomes U+FFFD; the blank put before a text is taken off."""
        if len(ids) and ids[-1] == self.end:
            ids = ids[:-1]
        if not self.control.isdisjoint(ids):  # no character reaches over a control piece
            parts, part = [], []
            for i in ids:
                if i in self.control:
                    parts.append(part)
                    part = []
                else:
                    part.append(i)
            parts = [p for p in [*parts, part] if p]
        else:
            parts = [ids] if len(ids) else []
        raw, out = self.raw, []
        for part in parts:
            data = b"".join([raw[i] for i in part])
            if self.prefix and not out and self.piece[part[0]].startswith(BLANK):
                data = data[1:]
            out.append(data.decode("utf-8", "gridlake-each"))
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(data: bytes) -> Pieces:
    """The model of a file's content, once per Python process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(data)
    return _LOADED[key]


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a file of the driver's installation
        return spark.sparkContext.broadcast(f.read())


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` plus an ``array<int>`` column of ids."""
    model = _shared(docs.sparkSession, path)
    docs, (text_col,) = set_aside(docs, [ids_col], [text_col])
    names = docs.columns

    def run(batches):
        pieces = load(model.value)
        for batch in batches:
            column = batch.column(names.index(text_col))
            for first, _, offsets in text_blocks(column):
                rows = batch.slice(first, len(offsets) - 1)
                flat, ends = array("i"), [0]
                for text in column.slice(first, len(offsets) - 1).to_pylist():
                    flat.extend(pieces.encode(text))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*names, ids_col])

    return docs.mapInArrow(run, _schema(docs, f"`{ids_col}` array<int>"))


def decode(rows: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` plus the text of their ids (a null list has none)."""
    model = _shared(rows.sparkSession, path)
    rows, (ids_col,) = set_aside(rows, [out_col], [ids_col])
    names = rows.columns

    def run(batches):
        pieces = load(model.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = [pieces.decode(ids or []) for ids in part.column(names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, out_col])

    return rows.mapInArrow(run, _schema(rows, f"`{out_col}` string"))


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, number of ids, SHA-256 of the ids and of the text decoded from them."""
    model = _shared(docs.sparkSession, path)
    docs = docs.select(id_col, text_col)

    def run(batches):
        pieces = load(model.value)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = pieces.encode(text.as_py())
                spelled = pieces.spelled
                n.append(len(ids))
                ids = ids.tolist()
                of_ids.append(hashlib.sha256(" ".join([spelled[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, _schema(docs.select(id_col), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_file())
