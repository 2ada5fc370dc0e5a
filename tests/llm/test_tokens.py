"""Operators 11 to 13 against plain Python: whole texts through the tokenizers, exact round trips, integer brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from kilngraph.llm import alignment, queries, token_files, vector_codes
from kilngraph.llm.vocabularies import AT_SPACES, BEFORE_SPACES, byte_alphabet, spaced_chunks, word_tokenizer, words_of
from tests.llm.conftest import EDGE, SCHEMA

ODD = ["", " ", "  two  blanks ", "tab\tand\nline \n end", "don't we'll I'VE", "a <|endoftext|> b<|startoftext|>c", "x▁y", "<0x0A> bytes", "é ́combining ́", "İstanbul ǅ ﬁ", "漢字 かな 🙂🙂", "　wide space\x1cx", "nul\x00 in", "   lead", "trail   ", "12 345,6", "᠎ a ᠎b", "a  b", "﻿bom", "ΑΣ σς", " '", "' s", "▁ ▁▁"]


@pytest.fixture(scope="module")
def docs(spark, sf, edge):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(5000 + k, t, "en", "a", 1) for k, t in enumerate(ODD)], SCHEMA)
    return own.selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars").unionByName(edge).unionByName(odd).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def words():
    return word_tokenizer(read(token_files.VOCABULARY))


@pytest.fixture(scope="module")
def both():
    return alignment.Pair(read(alignment.A_VOCABULARY), read(alignment.B_VOCABULARY))


# ---- 11 ---------------------------------------------------------------------------------------------------------------


def test_cuts_change_no_token(rows, words, both):
    quick = words_of(read(token_files.VOCABULARY), words)
    assert quick.plain_words is not None is not both.words.plain_words
    rng = random.Random(5)
    mixed = ["".join(rng.choice(" 　\n\taBst.'1éÉßÿ×Àẞ▁漢́<|\x1c\x7f\x85\xa0") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in [*ODD, *mixed, *(t for _, t in rows if t and len(t) < 3000)]:
        assert [i for c in AT_SPACES.split(text) for i in quick.ids(c)] == words.encode(text, add_special_tokens=False).ids
        cut = list(both.ids(BEFORE_SPACES.split(" " + text)))
        assert spaced_chunks(" " + text) == [c for c, _, _ in cut]
        assert [i for _, a, _ in cut for i in a] == both.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for _, _, b in cut for i in b] == both.b.encode(text) or "▁" in text or not text


@pytest.mark.parametrize("files", [{}, {"file_ids": 500, "block": 64, "checkpoint": 1}, {"file_ids": 1, "block": 96, "checkpoint": 2}])
def test_op11_gives_back_every_document(docs, rows, words, files):
    each = [(i, np.array([*words.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows]
    got = token_files.store_tokens(docs, **files).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in each)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        assert last is None or r["doc_id"] >= last
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last


def test_op11_asks_once_for_each_chunk_of_a_batch(words):
    memo = token_files.packed_ids(read(token_files.VOCABULARY))
    asked, results = [], memo.results
    memo.results = lambda chunks: asked.extend(chunks) or results(chunks)
    texts = [*ODD, "A word, a word", "", "word a", "é word" * 3] * 3
    got = token_files.encode_texts(pa.array(texts), memo, b"\2\0", AT_SPACES).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*words.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert Counter(asked) == Counter({c for t in texts for c in t.split(" ")})
    memo.limit = 0  # both generations are used up and begun anew
    for _ in range(4):
        assert token_files.encode_texts(pa.array(texts[:9]), memo, b"\2\0", AT_SPACES).to_pylist() == got[:9]
    assert token_files.encode_texts(pa.array(texts), memo, b"\2\0", None).to_pylist() == got
    assert token_files.encode_texts(pa.array([], pa.string()), memo, b"\2\0", AT_SPACES).to_pylist() == []


def test_op11_empty(empty):
    assert token_files.store_tokens(empty).collect() == []


@pytest.mark.parametrize("n", [1, 31, 32, 33, 4096, 10_000])
@pytest.mark.parametrize("kinds", [1, 2, 700, 49_408])
def test_op11_stretches(n, kinds):
    rng = np.random.default_rng(n * kinds)
    ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1).astype(np.uint32)
    counts = np.bincount(ids, minlength=kinds)
    table = token_files.Frequencies.scaled(counts * 10**12)
    assert table.freq.sum() == 1 << table.bits
    assert ((table.freq > 0) == (counts > 0)).all()
    cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
    sizes = np.diff(cuts).tolist()
    data = token_files.write_file(ids, sizes, [7, None, *range(len(sizes))][: len(sizes)], table, block=1024, checkpoint=5)
    file = token_files.TokenFile(data, table)
    assert (file.ids() == ids).all()
    for k in range(len(sizes)):
        assert (file.document(k) == ids[cuts[k] : cuts[k + 1]]).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (file.ids(a, b) == ids[a:b]).all()


def test_op11_damage_is_seen():
    ids = np.arange(3000, dtype=np.uint32) % 91
    table = token_files.Frequencies.scaled(np.bincount(ids))
    data = bytearray(token_files.write_file(ids, [3000], [1], table, block=1024, checkpoint=8))
    data[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(bytes(data), table).ids()
    with pytest.raises(ValueError, match="another table"):
        token_files.TokenFile(bytes(data), token_files.Frequencies.scaled(np.bincount(ids % 90)))


def test_op11_size_is_near_the_entropy():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 200_000) - 1, 40_000).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    size = len(token_files.write_file(ids, [len(ids)], [1], token_files.Frequencies.scaled(counts)))
    assert size < 1.03 * -(p * np.log2(p)).sum() * len(ids) / 8 + 2000


# ---- 12 ---------------------------------------------------------------------------------------------------------------


def brute_alignment(rows, both):
    """By bytes: the tokens that hold each byte, for whole texts."""
    alphabet = byte_alphabet()
    names = {i: t for t, i in both.a.get_vocab().items()}
    each, count = [], Counter()
    for i, text in rows:
        full = " " + (text or "")
        a, b = (both.a.encode(full, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        x = [bytes(alphabet[c] for c in names[k]) for k in a]
        y = [bytes([int(both.b.id_to_piece(k)[3:5], 16)]) if both.b.is_byte(k) else both.b.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(x) != full.encode() or b"".join(y) != full.encode():
            each.append((i, None))
            continue
        of_a, of_b = ([k for k, t in enumerate(s) for _ in t] for s in (x, y))
        links = sorted(set(zip(of_a, of_b, strict=True)))
        cut = [0, *(k for k in range(1, len(of_a)) if of_a[k] != of_a[k - 1] and of_b[k] != of_b[k - 1]), len(of_a)]
        groups = [(dict.fromkeys(of_a[p:q]), dict.fromkeys(of_b[p:q])) for p, q in zip(cut, cut[1:], strict=False)]
        text_ = ";".join(",".join(str(a[k]) for k in p) + "|" + ",".join(str(b[k]) for k in q) for p, q in groups)
        pairs = [(a[p], b[q]) for p, q in links]
        count.update(pairs)
        each.append((i, (len(a), len(b), len(groups), pairs, hashlib.sha256(text_.encode()).hexdigest())))
    most = Counter()
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    return Counter((i, *e[:3], len(e[3]), sum(count[p] == most[p[1]] for p in e[3]), sum(count[p] for p in e[3]), e[4]) if e else (i, 0, 0, 0, 0, 0, 0, "") for i, e in each)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 2000, 1])
def test_op12_links_and_groups(docs, rows, both, block):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(docs, block_bytes=block).collect())
    assert got == brute_alignment(rows, both)


def test_op12_without_cuts(spark, both):
    few = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(k, t, None, None, 1) for k, t in few], SCHEMA)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(df, split=None).collect()) == brute_alignment(few, both)


def test_op12_asks_once_for_each_chunk_of_a_block(rows, both):
    known = alignment.alignments(read(alignment.A_VOCABULARY), read(alignment.B_VOCABULARY))
    asked, results = [], known.memo.results
    known.memo.results = lambda chunks: asked.extend(chunks) or results(chunks)
    few = [(i, t) for i, t in rows if t is None or len(t) < 2000][:300]
    out = alignment.block_rows(7, [i for i, _ in few], [t or "" for _, t in few], known, BEFORE_SPACES).to_pylist()
    assert len(asked) == len(set(asked)) == len({c for _, t in few for c in spaced_chunks(" " + (t or ""))})
    whole = brute_alignment(few, both)
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out[:-1]) == Counter((*k[:5], k[7]) for k in whole.elements())
    pairs = Counter()
    for r in out[:-1]:
        pairs.update(dict(zip(r["at"], r["times"], strict=True)))
    assert [pairs[k] for k in range(len(out[-1]["pairs"]))] == out[-1]["links"] and out[-1]["n_a"] is None


def test_op12_empty(empty):
    assert alignment.align_tokens(empty).collect() == []


def test_op12_spans_by_hand():
    assert alignment.overlaps([2, 3, 1], [1, 1, 4]) == [(0, 1), (2, 2), (2, 2)]
    assert alignment.groups([(0, 1), (2, 2), (2, 2)]) == [(0, 1, 0, 2), (1, 3, 2, 3)]
    assert alignment.overlaps([], []) == [] == alignment.groups([])


# ---- 13 ---------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(np.float64(v) * 256)) for v in e], label) for i, e, label in rows if e and all(v is not None and np.isfinite(v) for v in e)]
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], rows and kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def near(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = {}
            for x in cut:
                members.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for k, xs in members.items():
                new[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out, labels = [], Counter()
    for (i, _, label), x in zip(kept, cut, strict=True):
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        labels[label] += out[-1][2]
    return Counter((i, c, e, labels[label], digest) for i, c, e, label in out)


KINDS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("broadcast_rows", [vector_codes.BROADCAST_ROWS, 0])
def test_op13_against_integers(spark, broadcast_rows):
    rng = random.Random(8)
    vectors = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.3)]) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(150)]
    vectors += [(3, vectors[3][1], 1), (None, vectors[4][1], 2), (900, None, 1), (901, [], 1), (902, [None] * 32, 1), (903, [float("nan")] + [0.0] * 31, 1), (904, [float("-inf")] + [0.0] * 31, None)]
    df = spark.createDataFrame(vectors, KINDS).repartition(3).selectExpr("*", "'x' as code", "1 as vector")
    got = vector_codes.compress(df, broadcast_rows=broadcast_rows)
    assert Counter(tuple(r) for r in got.collect()) == brute_codes([(i, e, la) for i, e, la in vectors])


def test_op13_screen_is_rigorous():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 10**5, vector_codes.LARGEST):
        x, c = rng.integers(-scale, scale + 1, (400, 4)), rng.integers(-scale, scale + 1, (60, 4))
        x[:60] = c
        x[60:120] = (c + c[::-1]) // 2
        exact = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        index, distance = vector_codes.nearest(x, c)
        assert index.tolist() == [min(range(60), key=lambda k, r=r: (r[k], k)) for r in exact]
        assert distance.tolist() == exact.min(1).tolist()


def test_op13_few_and_none(spark):
    one = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 16, None)], KINDS)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], KINDS)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 17, None)], KINDS))


def test_op13_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = queries.op13_vector_codes(spark, sf)
    rel = con.sql(queries.oracle_sql()["op13_vector_codes"])
    at = [rel.columns.index(c) for c in got.columns]
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_edge_rows_are_in_the_table(docs):
    assert docs.count() >= len(EDGE) + len(ODD)
