"""Piece encoding, periodic runs and Merkle manifests against the library, brute force and
independent folds."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridlake.llm import merkle, periodic_runs, sentence_pieces
from gridlake.llm.tables import set_aside


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_set_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, b_in int")
    out, names = set_aside(df, ["b"], ["b", "A"])
    assert out.columns == ["a", "B_in_in", "b_in"] and names == ["B_in_in", "a"]
    assert set_aside(df, ["x"], ["B"])[1] == ["B"]


# ---------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def pieces():
    with open(sentence_pieces.model_file(), "rb") as f:
        return sentence_pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_file())


PARTS = ["a", "b", "e", "t", "h", " ", "▁", "\n", "é", "日", "本", "😀", "\0", "<0x41>", "<s>", "</s>", "  ", "    ", "ing",
         "the", "́", "ß", "\t", "\r", "한", "�", "﻿", ".", ",", "का", "»", "1", "_"]


def test_pieces_equal_the_library(pieces, library):
    rnd = random.Random(4)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40)))
        ids = pieces.encode(text).tolist()
        assert ids == library.encode(text, add_eos=True), text
        assert pieces.decode(ids) == library.decode(ids), text
    for c in range(1, 0x11000, 7):
        if not 0xD800 <= c < 0xE000:
            assert pieces.encode(chr(c)).tolist() == library.encode(chr(c), add_eos=True)


def test_any_ids_decode_like_the_library(pieces, library):
    rnd = random.Random(5)
    for _ in range(4000):
        ids = [rnd.choice([rnd.randint(0, 31999), rnd.randint(0, 270), rnd.randint(128, 258), 28705, 259, 1, 2])
               for _ in range(rnd.randint(0, 12))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_long_words_and_small_caches(pieces, library, monkeypatch):
    for text in ("a" * 20_000, "ab" * 10_000, "日本" * 5_000, " " * 10_000, "x " * 500 + "\n" * 5_000):
        assert pieces.encode(text).tolist() == library.encode(text, add_eos=True)
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "CACHE_PAIRS", 5)
    text = "the quick brown fox jumps over the lazy dog, the end"
    assert pieces.encode(text).tolist() == library.encode(text, add_eos=True)


def test_table_of_last_pieces(pieces, library):
    word = "▁internationalisation"
    last = pieces.last_pieces(word)
    for i in range(2, len(word) + 1):
        assert last[i] == library.encode(word[1:i])[-1]


def test_pieces_of_documents(spark, sf_small, library):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in sentence_pieces.op11_sentencepiece(spark, sf_small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_piece_columns(spark, odd_rows, docs_of, library):
    docs = docs_of(odd_rows).withColumn("piece_ids", F.lit("mine")).withColumn("Decoded", F.lit(7))
    ids = sentence_pieces.encode(docs, sentence_pieces.model_file())
    rows = sentence_pieces.decode(ids, sentence_pieces.model_file()).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.piece_ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
        assert r.piece_ids_in == "mine" and r.Decoded_in == 7
    # the text column itself may be called like the output
    named = docs_of([(1, "a b")]).select("doc_id", F.col("text").alias("piece_ids"))
    assert sentence_pieces.encode(named, sentence_pieces.model_file(), "piece_ids").first().piece_ids == \
        library.encode("a b", add_eos=True)


def test_models_it_cannot_follow():
    with pytest.raises(ValueError):
        sentence_pieces.Pieces(b"\x12\x02\x18\x01")


# ---------------------------------------------------------------- 12


def brute_runs(words):
    """Every period's stretches of equal words, compared one by one."""
    out, n = [], len(words)
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, n // 4 + 1):
        edges = np.diff(np.concatenate([[0], x[q:] == x[:-q], [0]]).astype(int))
        for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            part = words[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a, original = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                words[i] = original[a + (i - a) % p]
    runs = brute_runs(words)
    keep = [True] * len(words)
    for start, length, q in runs:
        keep[start + q:start + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-(r[1] * 10 ** 9 // r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    kept = b" ".join(w for w, k in zip(words, keep) if k)
    return (doc_id, len(runs), *best, milli, sha(lines), hashlib.sha256(kept).hexdigest())


def periodic_texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        letters, words = rnd.choice([1, 2, 2, 3, 20]), []
        for _ in range(rnd.randint(0, 6)):
            words += [chr(97 + rnd.randint(0, letters)) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 7)
            words = words[:-1] if rnd.random() < .3 else words
        yield words


def test_runs_against_brute_force():
    texts = list(periodic_texts(5, 1200))
    for i in range(0, len(texts), 5):
        block = texts[i:i + 5]
        counts, flat = np.array([len(t) for t in block]), [w.encode() for t in block for w in t]
        got = periodic_runs.find_runs(periodic_runs.word_numbers(flat), counts).tolist() if flat else []
        want, at = [], 0
        for t in block:
            want += [[s + at, s + ln + at, q] for s, ln, q in brute_runs(t)]
            at += len(t)
        assert got == want


def test_extensions_against_direct_comparison():
    rnd = np.random.default_rng(2)
    for size in (1, 5, 40, 300):
        words = np.concatenate([rnd.integers(0, 2, size), np.arange(10, 10 + periodic_runs.MODULUS)])
        n = len(words)
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        got = periodic_runs.Extensions(words)(i, j)
        for a, b, k in zip(i.tolist(), j.tolist(), got.tolist()):
            want = 0
            while max(a, b) + want < n and words[a + want] == words[b + want]:
                want += 1
            assert k == want


def test_other_limits():
    words = np.array([0, 1, 0, 1, 0, 1, 7, 7, 7, 3])
    got = periodic_runs.find_runs(words, np.array([10]), min_words=3, min_copies=2)
    assert got.tolist() == [[0, 6, 2], [6, 9, 1]]


def test_runs_of_documents(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in periodic_runs.op12_periodic_runs(spark, sf_small).collect())
    assert got == sorted(brute_digest(r.doc_id, r.text) for r in rows)
    assert any(r[1] for r in got)


def test_runs_of_odd_rows(spark, odd_rows, docs_of, write_tables):
    rows = odd_rows + [(50 + i, " ".join(t)) for i, t in enumerate(periodic_texts(6, 60))]
    rows += [(200, "a\x1cb " * 9), (201, "a\x85b " * 9), (202, "ab\x0b" * 9)]
    docs = docs_of(rows).withColumn("start", F.lit(1)).withColumn("n_runs", F.lit("x"))
    folder = write_tables(documents=docs)
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, folder).collect()]
    assert sorted(got, key=str) == sorted([brute_digest(d, t) for d, t in rows], key=str)


def test_run_rows_and_collapsed_texts(spark, docs_of):
    docs = docs_of([(1, "x " + "a b " * 4 + "y"), (2, "z " * 6), (3, None), (4, "a a a a a")])
    got = sorted(tuple(r) for r in periodic_runs.runs(docs).collect())
    assert got == [(1, 1, 8, 2), (2, 0, 6, 1)]
    texts = {r.id: r.text for r in periodic_runs.collapse(docs).collect()}
    assert texts == {1: "x a b y", 2: "z", 3: "", 4: "a a a a a"}


# ---------------------------------------------------------------- 13


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def brute_manifest(rows):
    def h(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, h(*r)))
    trees, order = {}, sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = brute_tree([leaf for _, leaf in groups[s]])
    crown = brute_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (r, leaf) in enumerate(groups[s]):
            node, proof = leaf, ""
            d, text = r[0], r[4]
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
                node = h(*r[:4], text.replace("\n", ""))
            for at, levels in ((i, trees[s]), (k, crown)):
                for level in levels[:-1]:
                    low = at // 3 * 3
                    before, after = "".join(level[low:at]), "".join(level[at + 1:low + 3])
                    proof += before + after
                    node, at = sha(before + node + after), at // 3
            root = crown[-1][0]
            out.append((d, leaf, trees[s][-1][0], root, sha(proof), node, node == root))
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_against_brute_force(spark, write_tables, odd_rows, height, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)  # low blocks need many rounds
    rnd = random.Random(height)
    rows = [(i, rnd.choice([None, "", "hot", "hot", "hot", "é", "z", "=", "one" if i == 7 else "hot"]),
             rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice(["a\nb", "c", "\n\n", None, "ß\n" * 9])) for i in range(90)]
    rows += [(d, "odd", None, None, t) for d, t in odd_rows] + [(10 ** 12, "alone", "x", 1, "1:2-\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("key", F.lit("k")).repartition(4)
    folder = write_tables(documents=df)
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_proofs_fold_to_the_root(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(30)]).withColumn("source", F.col("doc_id") % 4)
    rows = merkle.manifest(docs, "source", "doc_id", ["doc_id", "text"], {"size": F.length("text")})
    got = rows.withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 30 and len({r.root for r in got}) == 1 and all(r.again == r.root for r in got)
    assert {r.source for r in got} == {0, 1, 2, 3} and all(r["size"] in (6, 7) for r in got)
    one = merkle.manifest(docs.limit(1), "source", "doc_id", ["doc_id"]).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
