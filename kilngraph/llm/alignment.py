"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, in bytes, and how common each link is.

B's tokens are a static interval index (their ends, ascending).  Each A token is a stabbing query answered by bisection:
the first B token that ends behind its first byte and the one that holds its last byte; it is linked to all between.  A gap
between two B tokens that no A token spans is where tokens of both end: a group's boundary.

1.  Blocks of documents are tokenized chunk by chunk (see vocabularies), a block's different chunks are aligned side by side.  A block
    keeps its different id pairs with their numbers of links; a document keeps its own by their places in its block's list.  This is a
    written table.
2.  Pairs are summed over all blocks, and each B id's highest count is found.
3.  Each block gets the counts of its own pairs back, and its documents are evaluated beside them.  So a pair is joined once a block,
    not once a document, and a task holds one block.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import bounded, materialize
from kilngraph.llm.vocabularies import BEFORE_SPACES, Memo, byte_alphabet, different, loaded, shared_file, simply_spaced, word_tokenizer, words_of

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text of a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A pair is A's id by this, and B's id.
SHIFT = 1 << 20
#: What stands behind an id in a group's text.
SIGNS = ",|;"


def stabbed(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and last B token that it overlaps; sizes in bytes, with equal sums, none 0.

    Texts may stand one after the other: both have a token's end where a text ends, so no span leaves its text."""
    ends, a_ends = np.cumsum(b_sizes), np.cumsum(a_sizes)
    return np.searchsorted(ends, a_ends - a_sizes, "right"), np.searchsorted(ends, a_ends, "left")


def last_of_groups(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The last A token of every group: groups are cut at gaps between B tokens that no A token spans.

    Spans ascend, so the gap behind a span's last token is spanned only if the next span begins with that token."""
    return np.flatnonzero(np.append(lo[1:] > hi[:-1], True)[: len(lo)])


def overlaps(a_sizes: Sequence[int], b_sizes: Sequence[int]) -> list[tuple[int, int]]:
    """stabbed() as pairs."""
    lo, hi = stabbed(np.array(a_sizes, np.int64), np.array(b_sizes, np.int64))
    return [*zip(lo.tolist(), hi.tolist(), strict=True)]


def groups(spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first A, end A, first B, end B) of every group of spans."""
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    last = last_of_groups(lo, hi)
    a, b = last + 1, hi[last] + 1
    return [*zip([0, *a.tolist()], a.tolist(), [0, *b.tolist()], b.tolist(), strict=False)]


def running(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, as many as its size, one row after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def ended(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sum of sizes."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def flat_bytes(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all strings, one after the other, and where each begins (and the end)."""
    if not len(strings):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, raw = strings.buffers()
    at = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    return memoryview(raw or b"")[: at[-1]], at


class Aligned(NamedTuple):
    """Of a list of chunks: whether both tokenizers give back its bytes, n_a, n_b, n_groups and n_links (0 if not), where its pairs begin (and the
    end), the pairs, where its groups' text begins (and the end), and the texts, a ; behind each group."""

    good: np.ndarray
    numbers: np.ndarray
    pairs_at: np.ndarray
    pairs: np.ndarray
    text_at: np.ndarray
    text: memoryview


class Pair:
    """Both tokenizers, from their files' bytes."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a = word_tokenizer(a)
        self.a.encode_special_tokens = True
        self.words = words_of(a, self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        self.a_bytes: dict[int, bytes | None] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[[*self.a_bytes]] = [*map(len, self.a_bytes.values())]
        self.b_sizes = np.array([*map(len, self.b_bytes)], np.int64)
        self.a_names, self.b_names = pa.array([self.a_bytes.get(i) for i in range(len(self.a_sizes))], pa.binary()), pa.array(self.b_bytes, pa.binary())
        #: An id in decimal and what stands behind it: SIGNS[k] at 3 * id + k.
        self.written = pa.array([f"{i}{c}" for i in range(max(len(self.a_sizes), len(self.b_sizes))) for c in SIGNS], pa.string())

    def ids(self, chunks: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """chunks: texts with a space before them."""
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, y in zip(chunks, b, strict=True):
            yield chunk, self.words.ids(chunk), y

    def packed(self, chunks: list[str]) -> list[bytes]:
        """Of each chunk, without the space before it, how many ids A has, A's ids and B's (4 bytes each)."""
        return [struct.pack(f"<{1 + len(a) + len(b)}I", len(a), *a, *b) for _, a, b in self.ids([f" {c}" for c in chunks])]

    def aligned(self, chunks: list[str], packed: list[bytes]) -> Aligned:
        """chunks, without the space before them, beside what packed() gives for them; all are aligned side by side."""
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        at = ended([len(p) // 4 for p in packed])
        n_a = flat[at[:-1]]
        n_b = np.diff(at) - 1 - n_a
        a, b = flat[running(at[:-1] + 1, n_a)], flat[running(at[:-1] + 1 + n_a, n_b)]
        good = self.given_back(chunks, a, n_a, b, n_b)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        lo, hi = stabbed(self.a_sizes[a], self.b_sizes[b])
        last = last_of_groups(lo, hi)
        a_ends, b_ends = last + 1, hi[last] + 1
        links = hi - lo + 1
        pairs = np.repeat(a, links) * SHIFT + b[running(lo, links)]
        # a group's A ids and then its B ids, each before a sign
        in_a, in_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        behind = np.zeros(len(a) + len(b), np.int64)
        ends = np.cumsum(in_a + in_b)
        behind[ends - in_b - 1], behind[ends - 1] = SIGNS.index("|"), SIGNS.index(";")
        ids = np.empty(len(behind), np.int64)
        ids[running(ends - in_b - in_a, in_a)], ids[running(ends - in_b, in_b)] = a, b
        text, text_at = flat_bytes(self.written.take(pa.array(3 * ids + behind)))
        of_a, of_links = ended(n_a), ended(links)[ended(n_a)]
        n_groups = np.diff(np.searchsorted(a_ends, of_a, "right"))
        numbers = np.stack([n_a, n_b, n_groups, np.diff(of_links)], axis=1)
        return Aligned(good, numbers, of_links, pairs, text_at[ended(n_a + n_b)], text)

    def given_back(self, chunks: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether both tokenizers' bytes are the chunks'."""
        raw, whole = flat_bytes(pa.array([f" {c}" for c in chunks], pa.string()).cast(pa.binary()))
        good = np.ones(len(chunks), np.bool_)
        for ids, n, names in ((a, n_a, self.a_names), (b, n_b, self.b_names)):
            found, at = flat_bytes(names.take(pa.array(ids)))
            at = at[ended(n)]
            if found != raw or (at != whole).any():
                x, y = at.tolist(), whole.tolist()
                good &= [found[x[k] : x[k + 1]] == raw[y[k] : y[k + 1]] for k in range(len(chunks))]
        return good


class Known(NamedTuple):
    """Both tokenizers, and the ids of chunks that a worker has met."""

    pair: Pair
    memo: Memo


def alignments(a: bytes, b: bytes) -> Known:
    pair = Pair(a, b)
    return Known(pair, Memo(pair.packed))


FIELDS = [
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
]
FIELDS_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, links array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def list_array(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def cut(texts: list[str], split) -> tuple[list[int], pa.Array, np.ndarray]:
    """(order, pieces, n): the texts' chunks without the spaces before them, n a text; the texts in an order that is given back."""
    simple, plain, other, chunks = [], [], [], []
    usual = split is not None and split.pattern == BEFORE_SPACES.pattern
    for k, text in enumerate(texts):
        full = f" {text}"
        if usual and simply_spaced(full):
            plain.append(k)
            simple.append(text)
        else:
            other.append(k)
            chunks.append([c[1:] for c in ([full] if split is None else split.split(full))])
    kind = pa.list_(pa.string())
    lists = [pc.split_pattern(pa.array(simple, pa.string()), " "), pa.array(chunks, kind)]
    return plain + other, pa.concat_arrays([x.flatten() for x in lists]), np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.int64)


def block_rows(block: int, ids: list, texts: list[str], known: Known, split) -> pa.RecordBatch:
    """The documents' rows of a block and one row more with its pairs."""
    order, pieces, n_pieces = cut(texts, split)
    chunks, which = different(pieces)
    found = known.pair.aligned(chunks, known.memo.results(chunks))
    ends = ended(n_pieces)
    owner = np.repeat(np.arange(len(order)), n_pieces)
    bad = np.bincount(owner[~found.good[which]], minlength=len(order)) > 0
    bad |= np.array([not texts[k] for k in order], np.bool_)
    # groups' texts of all pieces, one after the other
    written = pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(found.text_at.astype(np.int32)), pa.py_buffer(found.text)])
    text, at = flat_bytes(written.take(pa.array(which)))
    at = at[ends].tolist()
    digests = ["" if no else hashlib.sha256(text[i : j - 1]).hexdigest() for no, i, j in zip(bad.tolist(), at, at[1:], strict=False)]
    # a document's different pieces, then its different pairs
    keep = ~bad[owner]
    key, times = np.unique(owner[keep] * max(1, len(chunks)) + which[keep], return_counts=True)
    document, piece = key // max(1, len(chunks)), key % max(1, len(chunks))
    numbers = np.stack([np.bincount(document, times * column[piece], len(order)) for column in found.numbers.T]).astype(np.int64)
    used = np.zeros(len(chunks), np.bool_)
    used[piece] = True
    n_pairs = np.diff(found.pairs_at)
    pairs = np.unique(found.pairs[np.repeat(used, n_pairs)])
    place = np.searchsorted(pairs, found.pairs)
    n = n_pairs[piece]
    key = np.repeat(document * max(1, len(pairs)), n) + place[running(found.pairs_at[piece], n)]
    key, where = np.unique(key, return_inverse=True)  # a document has a pair by several chunks
    total = np.bincount(where, np.repeat(times, n), len(key)).astype(np.int64)
    document, at = key // max(1, len(pairs)), key % max(1, len(pairs))
    links = np.bincount(at, total, len(pairs)).astype(np.int64)
    own = np.bincount(document, minlength=len(order)).tolist()
    size = len(order)
    columns = [
        pa.array([block] * (size + 1), pa.int64()), pa.array([*(ids[k] for k in order), None], pa.int64()), *(pa.array([*x.tolist(), None], pa.int64()) for x in numbers), pa.array([*digests, None], pa.string()),
        list_array(at, [*own, 0], pa.int32()), list_array(total, [*own, 0], pa.int32()), list_array(pairs, [0] * size + [len(pairs)], pa.int64()), list_array(links, [0] * size + [len(pairs)], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(FIELDS))


def align_blocks(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY, split=BEFORE_SPACES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A materialized table of documents' and blocks' rows (those with n_a null), see block_rows."""
    spark = docs.sparkSession
    a, b = shared_file(spark, a_vocabulary), shared_file(spark, b_vocabulary)
    rows = bounded(docs).select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded("alignments", alignments, a.value, b.value)
        part = n = size = 0
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):  # noqa: B007
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield block_rows(part << 32 | n, ids, texts, known, split)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield block_rows(part << 32 | n, ids, texts, known, split)

    return materialize(rows.mapInArrow(align, FIELDS_SQL))


def link_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, i, pair, n) of every block's pairs, and (a, b, pair, n, best): the links of each pair of ids, and whether no other A id has more
    with the B id."""
    own = blocks.where("n_a is null").select("block", F.posexplode(F.arrays_zip("pairs", "links")).alias("i", "x")).select("block", "i", "x.pairs", "x.links").toDF("block", "i", "pair", "n")
    counts = materialize(own.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % SHIFT))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    best = counts.join(most, "b").select(F.floor(F.col("pair") / SHIFT).alias("a"), "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return own, best


def align_tokens(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY, split=BEFORE_SPACES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Counts are over all rows, rows that repeat among them.  Texts that are null or empty, or that a tokenizer's bytes don't give back
    (with a space before), have zeros and ''.  split: as in token_files."""
    blocks = align_blocks(docs, a_vocabulary, b_vocabulary, split, block_bytes)
    own, best = link_counts(blocks)
    known = own.select("block", "i", "pair").join(best.select("pair", "n", "best"), "pair").select("block", "i", "n", "best")
    rows = blocks.where("n_a is not null").drop("pairs", "links")

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(right.num_rows, np.int64)
        top = np.zeros(right.num_rows, np.bool_)
        i = right.column("i").to_numpy()
        count[i], top[i] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        at, times = (left.column(c).combine_chunks() for c in ("at", "times"))
        owner = np.repeat(np.arange(left.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        n_best, sums = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        np.add.at(n_best, owner, times * top[at])
        np.add.at(sums, owner, times * count[at])
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in names), pa.array(n_best), pa.array(sums), left.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(evaluate, RESULT)
