"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding
with an incremental byte-to-text state machine.

A text is fed in chunks.  A pre-token is encoded when its end is known; inside a
pre-token of any length, a window of symbols is merged and its tokens are emitted as
far as no continuation can change them.  How far that is follows from the merge list
(``sufficient_lookahead``), so memory is one chunk plus one window and does not grow
with the text or with its longest word.

Works for tokenizer files of the ``tokenizers`` library with a BPE model, a byte-level
alphabet and an optional end-of-word suffix.  The file is read on the driver and
broadcast (a few MB, fixed by the vocabulary).

Defined results: a null or empty text has no tokens and decodes to an empty text;
strings of special tokens in a text become those tokens; rows are independent and keep
their number, repeated or not; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlake.llm.bytes_of import text_blocks
from gridlake.llm.tables import set_aside, table

CHUNK = 1 << 16
CACHE_WORDS = 250_000
LONGEST_CACHED = 64

#: White space, and the contractions that are pre-tokens of their own.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
UNSURE = re.compile("'[rvlRVL]$")

#: What the library's Unicode tables have beyond the version 15.1 of this
#: Python -- letters and numbers of 16.0, capitals of 16.0 and 17.0 with their small
#: letters, and the one pair that its older composition table leaves apart.
LETTERS_16 = ("\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
              "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1"
              "\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
              "\U0001e5d0-\U0001e5ed\U0001e5f0")
NUMBERS_16 = ("\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139"
              "\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa")
SMALL_17 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
            0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
APART = "\U00011935\U00011930"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    in Latin-1, else the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


@lru_cache(None)
def _class(major: str) -> str:
    """Regex ranges of the code points whose general category starts with ``major``."""
    out, start = [{"L": LETTERS_16, "N": NUMBERS_16}[major]], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(None)
def _capitals() -> re.Pattern:
    return re.compile("[" + "".join(map(chr, SMALL_17)) + "]")


@lru_cache(None)
def _kinds() -> tuple[re.Pattern, re.Pattern]:
    return re.compile(f"[{_class('L')}]"), re.compile(f"[{_class('N')}]")


def _until(ranges: str, last: int) -> str:
    """The regex ranges ``a-b`` up to a code point."""
    out = []
    for first, end in re.findall("(.)(?:-(.))?", ranges, re.S):
        if ord(first) <= last:
            out.append(f"{first}-{chr(min(ord(end or first), last))}")
    return "".join(out)


@lru_cache(None)
def _pattern(last: int) -> re.Pattern:
    """Pre-tokens of texts without code points beyond ``last``."""
    letters, numbers = (_until(_class(m), last) for m in "LN")
    # the first characters of letters and contractions differ, so their order is free
    return re.compile(f"[{letters}]+|{'|'.join(CONTRACTIONS)}|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a normalised text.  Classes of code points that a text lacks would
    only be searched in vain, so there is a pattern for ASCII and one for the first plane."""
    if text.isascii():
        return _pattern(0x7F).findall(text)
    wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return _pattern(sys.maxunicode if wide else 0xFFFF).findall(text)


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols after a position that can still move a token boundary before it.

    Take a word known up to some position, with two continuations.  Merging by
    priority, the two agree up to a boundary, and a rule (u, v) can move that boundary
    left only by u, by merging the last agreed token u with a v that one of the two has
    there.  The next rule (x, y) that does so comes later in the list and its y starts
    where u starts, so u is on the left spine of y.  The longest such chain, weighted by
    the lengths of the left parts, bounds the way; one more token completes the bound.
    """
    left = {a + b: a for a, b in merges}
    best: dict[str, int] = {}
    bound = 0
    for a, b in reversed(merges):
        reach = length[a] + best.get(a, 0)
        bound = max(bound, reach)
        spine = b
        while spine is not None:
            if best.get(spine, 0) < reach:
                best[spine] = reach
            spine = left.get(spine)
    return bound + max(length.values(), default=1)


NONE = 1 << 62


class Merges:
    """A BPE model over token ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE model")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.spelled = {i: str(i) for i in self.token}
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        self.alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        #: ids of the 256 bytes inside a word, and at its end
        self.inner = [vocab[c] for c in self.alphabet]
        self.final = [vocab[c + self.suffix] for c in self.alphabet]
        size = {}
        for t in vocab:
            size[t] = max(1, len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t))
        seen = {a for a in size if size[a] == 1}
        for a, b in pairs:  # every part of a rule must come from earlier rules: then no merge unlocks an earlier one
            if a not in seen or b not in seen:
                raise ValueError("the merge list is not in order")
            seen.add(a + b)
        self.lookahead = sufficient_lookahead(pairs, size)
        self.size = {vocab[t]: n for t, n in size.items()}
        #: (left id, right id) -> (priority, merged id), each packed into one number
        self.shift = shift = max(vocab.values(), default=1).bit_length()
        self.rule = {vocab[a] << shift | vocab[b]: i << shift | vocab[a + b] for i, (a, b) in enumerate(pairs)}

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = APART.join([unicodedata.normalize("NFC", t) for t in text.split(APART)])
        if self.lower:  # letter by letter: no final form of sigma
            text = text.replace("Σ", "σ").lower()
            if not _latin(text) and _capitals().search(text):
                text = text.translate(SMALL_17)
        return text

    def symbols(self, pretoken: str) -> list[int]:
        return [self.inner[b] for b in pretoken.encode("utf-8", "surrogatepass")]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list, best rule first, leftmost first."""
        n = len(ids)
        if n > 48:
            return self._merge_long(ids)
        get, shift = self.rule.get, self.shift
        low = (1 << shift) - 1
        found = [get(a << shift | b, NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NONE:
                break
            i = found.index(best)
            ids[i] = new = best & low
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << shift | new, NONE)
            if i < len(found):
                found[i] = get(new << shift | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for long windows."""
        n, get, shift = len(ids), self.rule.get, self.shift
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), ids[:]

        def push(i, j):
            rule = get(alive[i] << shift | alive[j])
            if rule is not None:
                heapq.heappush(heap, (rule >> shift, i, alive[i], alive[j], rule & (1 << shift) - 1))

        heap: list = []
        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] == a else n
            if j >= n or alive[j] != b:
                continue
            alive[i], alive[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [t for t in alive if t >= 0]

    def close(self, ids: list[int], last_byte: int) -> list[int]:
        """Symbols of a pre-token with the last one marked as its end."""
        ids[-1] = self.final[last_byte]
        return ids

    def word(self, pretoken: str) -> list[int]:
        data = pretoken.encode("utf-8", "surrogatepass")
        inner = self.inner
        return self.merge(self.close([inner[b] for b in data], data[-1]))


class Encoder:
    """The transducer: ``feed`` chunks, take the ids that are final, then ``finish``.

    ``emit(ids)`` is called with the ids of whole pre-tokens or stable parts."""

    def __init__(self, merges: Merges, entry, emit_special, emit_part, chunk: int = CHUNK):
        self.m, self.entry, self.special, self.part, self.chunk = merges, entry, emit_special, emit_part, chunk
        self.held = ""  # text that is not settled
        self.run: list[int] = []  # symbols of a long pre-token that are not settled
        self.marks = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) \
            if merges.special else None
        self.cut = re.compile(f"[{SPACE}]")
        #: characters from which on something may go on behind the held text: a special
        #: token but for its last character, or a contraction
        self.tail = max([len(mark) - 1 for mark in merges.special] + [max(map(len, CONTRACTIONS))])

    def feed(self, text: str) -> None:
        self.held += text
        if len(self.held) >= self.chunk:
            self._settle(False)

    def finish(self) -> None:
        self._settle(True)
        self._close_run()

    def _settle(self, last: bool) -> None:
        held = self.held
        if last:
            done = len(held)
        else:
            # a blank ends every pre-token, special token and composed character
            spaces = list(self.cut.finditer(held, max(0, len(held) - self.chunk)))
            done = spaces[-1].end() if spaces else 0
        if done:
            self._segment(held[:done])
        self.held = held[done:]
        if not last and len(self.held) >= 2 * self.chunk:
            self._long()

    def _segment(self, text: str) -> None:
        for part, _ in self._between_marks(text):
            self._plain(part)

    def _between_marks(self, text: str):
        """``(part, is the last)`` around special tokens, which are emitted on the way."""
        at = 0
        marked = any(mark in text for mark in self.m.special)
        for hit in self.marks.finditer(text) if marked else ():
            yield text[at:hit.start()], False
            self._close_run()
            self.special(self.m.special[hit.group()])
            at = hit.end()
        yield text[at:], True

    def _plain(self, text: str) -> None:
        if not text:
            return
        text = self.m.normalise(text)
        if self.run:
            text = self._continue(text)
        self.entry(pretokens(text))

    def _kind(self, c: str) -> str:
        letter, number = _kinds()
        return "L" if letter.match(c) else "N" if number.match(c) else " " if self.cut.match(c) else "other"

    def _long(self) -> None:
        """No blank in two chunks: settle all but the last pre-token, which is open,
        unless a special token or a composed character may reach over the end."""
        text = self.held
        end = len(text) - self.tail
        while end > 0 and (unicodedata.combining(text[end]) or not unicodedata.is_normalized("NFC", text[end - 1:end + 1])):
            end -= 1
        if self.marks:
            for hit in self.marks.finditer(text):
                if hit.start() < end < hit.end():
                    end = hit.start()
        while end > 0 and ("'" in text[end - 1:end] or UNSURE.search(text[max(0, end - 2):end])):
            end -= 1  # what may become a contraction stays open
        if end > 0:
            self.held = text[end:]
            self._open(text[:end])

    def _open(self, text: str) -> None:
        """Settle a segment whose last pre-token goes on."""
        for part, last in self._between_marks(text):
            if not last:
                self._plain(part)
        text = part
        if not text:
            return
        text = self.m.normalise(text)
        if self.run:
            text = self._continue(text)
        words = pretokens(text)
        if words and not self.cut.match(text[-1]) and self._kind(words[-1][-1]) != "N" and words[-1] not in CONTRACTIONS:
            self.entry(words[:-1])
            self._last = words[-1][-1]
            self._run(words[-1])
        else:
            self.entry(words)

    def _continue(self, text: str) -> str:
        """Let ``text`` go on with the open pre-token as far as it is of its kind."""
        kind, n = self._kind(self._last), 0
        while n < len(text) and self._kind(text[n]) == kind:
            n += 1
        if n:
            self._run(text[:n])
            self._last = text[n - 1]
        if n < len(text):
            self._close_run()
        return text[n:]

    def _run(self, letters: str) -> None:
        step = 4 * self.m.lookahead
        for i in range(0, len(letters), step):
            data = letters[i:i + step].encode("utf-8", "surrogatepass")
            self.run += [self.m.inner[b] for b in data]
            self.final_byte = data[-1]
            while len(self.run) > step:
                self._stable(step)

    def _stable(self, n: int) -> None:
        """Emit the tokens of the first ``n`` symbols that no continuation can change."""
        used, ids = 0, []
        for t in self.m.merge(self.run[:n]):
            if used + self.m.size[t] > n - self.m.lookahead:
                break
            ids.append(t)
            used += self.m.size[t]
        self.part(ids)
        del self.run[:used]

    def _close_run(self) -> None:
        if self.run:
            self.part(self.m.merge(self.m.close(self.run, self.final_byte)))
            self.run = []


class Decoder:
    """Ids to text, one at a time.  ``style`` "tokens" spells the tokens, separated by
    blanks (what a file without a decoder asks for); "bytes" turns tokens into bytes and
    bytes into text with an incremental UTF-8 state machine (the suffix is a blank)."""

    def __init__(self, merges: Merges, style: str = "tokens"):
        self.m, self.style, self.begun = merges, style, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        """Text of the next ids: all that is settled by them."""
        token = self.m.token
        if self.style == "tokens":
            out = " ".join([token[i] for i in ids])
            out = f" {out}" if self.begun and out else out
            self.begun = self.begun or bool(out)
            return out
        return "".join([self._bytes(token[i]) for i in ids])

    def _bytes(self, token: str) -> str:
        if token in self.m.special:
            return self.machine.decode(b"", True) + token
        suffix = self.m.suffix
        ends = bool(suffix) and token.endswith(suffix)
        data = bytes(self.m.byte[c] for c in (token[:-len(suffix)] if ends else token))
        return self.machine.decode(data + (b" " if ends else b""))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Cache:
    """Ids of pre-tokens as packed 32-bit numbers, in two generations of bounded size: the
    pre-tokens met lately, and those before them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[int]:
        known, miss = self.words.get, self._miss
        out = array("i")
        for i in range(0, len(words), 50_000):
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
                known = self.words.get
            out.frombytes(b"".join([known(w) or miss(w) for w in words[i:i + 50_000]]))
        return out.tolist()

    def _miss(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = array("i", self.merges.word(word)).tobytes()
        if len(word) <= LONGEST_CACHED:
            self.words[word] = out
        return out


_LOADED: dict[str, tuple[Merges, Cache]] = {}


def load(text: str) -> tuple[Merges, Cache]:
    """The model of a tokenizer file's content, once per Python process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        merges = Merges(json.loads(text))
        _LOADED[key] = merges, Cache(merges)
    return _LOADED[key]


def feed_all(text: str | None, merges: Merges, put, words=None, chunk: int = CHUNK) -> None:
    """Run a text through the transducer; ``put`` gets the ids as they become final, those
    of whole pre-tokens from ``words``."""
    words = words or (lambda pretokens: [i for w in pretokens for i in merges.word(w)])
    e = Encoder(merges, lambda pretokens: put(words(pretokens)), lambda i: put([i]), put, chunk)
    for i in range(0, len(text or ""), chunk):
        e.feed(text[i:i + chunk])
    e.finish()


def encode_text(text: str | None, merges: Merges, chunk: int = CHUNK) -> list[int]:
    """Ids of one text."""
    ids: list[int] = []
    feed_all(text, merges, ids.extend, chunk=chunk)
    return ids


def decode_ids(ids, merges: Merges, style: str = "tokens") -> str:
    """Text of a list of ids."""
    d = Decoder(merges, style)
    return d.feed(ids) + d.finish()


def digest_text(text: str, merges: Merges, cache: Cache) -> tuple[int, str, str]:
    """Tokens, SHA-256 of the ids and of the text decoded from them: ids are hashed and
    decoded as they become final, and never held together."""
    n, ids_hash, text_hash, decoder, spelled = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges), merges.spelled

    def put(ids):
        nonlocal n
        if ids:
            ids_hash.update(((" " if n else "") + " ".join([spelled[i] for i in ids])).encode())
            text_hash.update(decoder.feed(ids).encode())
            n += len(ids)

    feed_all(text, merges, put, cache.ids)
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shared(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # a file of the driver's installation
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids",
           sha_col: str = "decoded_sha256") -> DataFrame:
    """``docs`` plus an ``array<int>`` column of ids and the SHA-256 of the text that they
    decode to.  A column that is called like one of the two is kept as ``<name>_in``."""
    model = _shared(docs.sparkSession, path)
    docs, (text_col,) = set_aside(docs, [ids_col, sha_col], [text_col])
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{ids_col}` array<int>, `{sha_col}` string"])

    def run(batches):
        merges, cache = load(model.value)
        for batch in batches:
            column = batch.column(names.index(text_col))
            for first, _, offsets in text_blocks(column):
                rows = batch.slice(first, len(offsets) - 1)
                flat, ends, sha = array("i"), [0], []
                for t in column.slice(first, len(offsets) - 1):
                    feed_all(t.as_py(), merges, flat.extend, cache.ids)
                    decoded = decode_ids(flat[ends[-1]:], merges)
                    ends.append(len(flat))
                    sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(sha, pa.string())],
                                                 [*names, ids_col, sha_col])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded",
           style: str = "bytes") -> DataFrame:
    """``rows`` plus the text of their ids (a column of that name is kept as ``<name>_in``)."""
    model = _shared(rows.sparkSession, path)
    rows, (ids_col,) = set_aside(rows, [out_col], [ids_col])
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{out_col}` string"])

    def run(batches):
        merges, _ = load(model.value)
        for batch in batches:
            texts = [decode_ids(ids or [], merges, style)
                     for ids in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out_col])

    return rows.mapInArrow(run, schema)


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, tokens, and the hashes of ids and decoded text, in one pass that
    never holds a text's ids together."""
    model = _shared(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        merges, cache = load(model.value)
        for batch in batches:
            rows = [digest_text(t.as_py() or "", merges, cache) for t in batch.column(1)]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {DIGEST}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_file())
