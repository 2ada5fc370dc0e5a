"""Token ids in compressed files: a static range asymmetric numeral system over frequency tables that all blocks share.

1.  Documents are encoded once; ids are counted over the whole corpus (a row an id at most) and the counts are scaled to a
    power of two.  That table is shared by all files.
2.  Documents are ordered by ranges of doc_id.  A task writes its documents' ids, the end id behind each, to files of
    whole documents.  A file's ids are cut into blocks, which are encoded apart.  In a block LANES coders take turns, each with a
    64-bit state of its own; words of 32 bits leave a state that grows too large.  Every CHECKPOINT steps the states and the
    place in the words are noted, so a reader can begin there: all stretches between checkpoints are decoded side by side.
    A block has a CRC-32 of its words and one of its ids.
3.  Files are blobs in a table in the shared folder (a Python task can't open files in every store that Spark reads).  What
    stands before a file follows from sums over parts of the order and then within a part.

A file: HEAD, the shared table's checksum within; a document's id (8 bytes), whether it has one (1), its number of ids (8); a block's
ids, words, bytes before it and checksums; then each block's checkpoints (place, states) and words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm._util import bounded, materialize
from kilngraph.llm.vocabularies import AT_SPACES, Memo, different, loaded, shared_file, word_tokenizer, words_of

VOCABULARY = "word_bpe_49k.json"
#: Behind each document.
END = 2
LANES = 32
#: Ids of a block, steps between checkpoints, ids of a file before the document that ends it.
BLOCK = 1 << 16
CHECKPOINT = 512
FILE = 1 << 21
#: A lane's state is at least this and below it times 2 ** 32.
LOW = np.uint64(1 << 31)
MAGIC = b"KRAN"
#: Magic, version, bits of the table, its checksum, documents, ids, blocks, lanes, steps between checkpoints.
HEAD = struct.Struct("<4sBBxxIQQIII")
BLOCK_ROW = np.dtype([("ids", "<u4"), ("words", "<u4"), ("offset", "<u8"), ("words_crc", "<u4"), ("ids_crc", "<u4")])


class Frequencies:
    """Scaled counts of ids: freq sums to 2 ** bits, every id that occurs has 1 at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        if int(self.freq.sum()) != 1 << self.bits:
            raise ValueError("frequencies don't sum to a power of two")
        self.below = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Frequencies:
        """From counts of ids 0, 1, ...: shares of 2 ** bits by largest remainders (ties: the smaller id), 1 at least."""
        used = np.flatnonzero(counts)
        if not len(used):
            return cls(np.ones(1, np.int64))
        bits = max(12, int(len(used) - 1).bit_length() + 2)
        spare, total = (1 << bits) - len(used), int(counts.sum())
        exact = [int(c) * spare for c in counts[used]]  # beyond 64 bits
        low = np.array([x // total for x in exact], np.int64)
        rest = np.array([(x % total) / total for x in exact])
        low[np.argsort(-rest, kind="stable")[: spare - int(low.sum())]] += 1
        out = np.zeros(len(counts), np.int64)
        out[used] = low + 1
        return cls(out)

    def slots(self) -> np.ndarray:
        """The id of each of the 2 ** bits slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_blocks(ids: np.ndarray, table: Frequencies, checkpoint: int = CHECKPOINT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, places, states) of each row of ids (blocks x (steps * LANES)); the blocks are encoded side by side, from the end.

    places, states: at steps 0, checkpoint, 2 * checkpoint, ...: words before, and the lanes' states."""
    blocks, size = ids.shape
    steps = size // LANES
    at = ids.reshape(blocks, steps, LANES).transpose(1, 0, 2)
    bits = np.uint64(table.bits)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, out = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), np.bool_)
    states = np.zeros((-(-steps // checkpoint), blocks, LANES), np.uint64)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[at[t]], table.below[at[t]]
        over = x >= f << (np.uint64(63) - bits)
        out[t], words[t] = over, x  # the low 32 bits
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if t % checkpoint == 0:
            states[t // checkpoint] = x
    found = []
    for b in range(blocks):
        mask = out[:, b]
        places = np.concatenate([[0], np.cumsum(mask.sum(1))])[:-1:checkpoint] if steps else np.zeros(0, np.int64)
        found.append((words[:, b][mask], places.astype(np.uint32), states[:, b]))
    return found


def decode_stretches(words: np.ndarray, places: np.ndarray, states: np.ndarray, steps: np.ndarray, table: Frequencies, slots: np.ndarray) -> np.ndarray:
    """(stretches, most steps, LANES) ids of stretches that begin at places in words with states, side by side; beyond a stretch's own
    steps its ids have no meaning."""
    most = int(steps.max(initial=0))
    out = np.zeros((len(places), most, LANES), np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    x, at = states.astype(np.uint64), places.astype(np.int64)
    words = np.append(words, np.uint32(0))
    last = len(words) - 1
    for t in range(most):
        slot = x & mask
        ids = slots[slot]
        out[:, t] = ids
        x = table.freq[ids] * (x >> bits) + slot - table.below[ids]
        low = (x < LOW) & (t < steps)[:, None]
        rank = np.cumsum(low, axis=1)
        got = words[np.minimum(at[:, None] + rank - 1, last)]
        x = np.where(low, (x << np.uint64(32)) | got, x)
        at += rank[:, -1]
    return out


def write_file(ids: np.ndarray, sizes: list[int], keys: list[int | None], table: Frequencies, block: int = BLOCK, checkpoint: int = CHECKPOINT) -> bytes:
    """The file of documents `keys` with `sizes` ids each, of all their ids."""
    if block % LANES:
        raise ValueError("a block's ids must be a multiple of the lanes")
    rows, bodies, offset = [], [], 0
    whole = len(ids) // block
    groups = [ids[: whole * block].reshape(whole, block)] if whole else []
    if rest := len(ids) % block:
        padded = np.full(-(-rest // LANES) * LANES, ids[-1])  # an id that has a frequency
        padded[:rest] = ids[whole * block :]
        groups.append(padded[None])
    coded = [x for g in groups for x in encode_blocks(g, table, checkpoint)]
    for k, (words, places, states) in enumerate(coded):
        own = ids[k * block : (k + 1) * block]
        body = places.astype("<u4").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        rows.append((len(own), len(words), offset, zlib.crc32(words.astype("<u4").tobytes()), zlib.crc32(own.astype("<u4").tobytes())))
        bodies.append(body)
        offset += len(body)
    head = HEAD.pack(MAGIC, 1, table.bits, table.crc, len(keys), len(ids), len(coded), LANES, checkpoint)
    documents = [
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is not None for k in keys], np.uint8).tobytes(), np.array(sizes, "<u8").tobytes(),
    ]
    return b"".join([head, *documents, np.array(rows, BLOCK_ROW).tobytes(), *bodies])


class TokenFile:
    """A file that was read: its documents, and the ids of any stretch of it."""

    def __init__(self, data: bytes, table: Frequencies, slots: np.ndarray | None = None):
        magic, version, bits, crc, n, self.n_ids, blocks, lanes, self.checkpoint = HEAD.unpack_from(data)
        if (magic, version, lanes) != (MAGIC, 1, LANES):
            raise ValueError("no file of token ids")
        if (bits, crc) != (table.bits, table.crc):
            raise ValueError("the file was written with another table of frequencies")
        at = HEAD.size
        ids, has = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.keys = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.sizes = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.blocks = np.frombuffer(data, BLOCK_ROW, blocks, at + 17 * n)
        self.body = at + 17 * n + blocks * BLOCK_ROW.itemsize
        self.data, self.table, self.slots = data, table, table.slots() if slots is None else slots

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The file's ids from first to end; only stretches between checkpoints that hold some of them are decoded.

        ValueError where a checksum differs (that of a block's ids is checked if the whole block is decoded)."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        begins = np.cumsum(self.blocks["ids"].astype(np.int64)) - self.blocks["ids"]
        words, places, states, steps, spans, checks = [], [], [], [], [], []
        before = 0
        for k, (row, begin) in enumerate(zip(self.blocks, begins, strict=True)):
            n = int(row["ids"])
            a, b = max(first - int(begin), 0), min(end - int(begin), n)
            if a >= b:
                continue
            total = -(-n // LANES)
            marks = -(-total // self.checkpoint)
            at = self.body + int(row["offset"])
            place = np.frombuffer(self.data, "<u4", marks, at)
            state = np.frombuffer(self.data, "<u8", marks * LANES, at + 4 * marks).reshape(marks, LANES)
            word = np.frombuffer(self.data, "<u4", int(row["words"]), at + 4 * marks + 8 * marks * LANES)
            if zlib.crc32(word.tobytes()) != row["words_crc"]:
                raise ValueError(f"block {k} is damaged")
            stretch = self.checkpoint * LANES
            lo, hi = a // stretch, -(-b // stretch)
            words.append(word)
            places.append(place[lo:hi].astype(np.int64) + before)
            states.append(state[lo:hi])
            steps.append(np.minimum(self.checkpoint, total - np.arange(lo, hi) * self.checkpoint))
            spans += [(min(stretch, n - j * stretch), max(0, a - j * stretch), min(stretch, b - j * stretch)) for j in range(lo, hi)]
            checks.append((k, hi - lo if hi - lo == marks else 0, row["ids_crc"], hi - lo))
            before += len(word)
        if not spans:
            return np.zeros(0, np.uint32)
        found = decode_stretches(np.concatenate(words), np.concatenate(places), np.concatenate(states), np.concatenate(steps), self.table, self.slots)
        flat, at, out = found.reshape(len(found), -1), 0, []
        for k, whole, crc, n in checks:
            parts = [flat[at + j, : spans[at + j][0]] for j in range(n)]
            if whole and zlib.crc32(np.concatenate(parts).astype("<u4").tobytes()) != crc:
                raise ValueError(f"the ids of block {k} differ from their checksum")
            out += [p[a:b] for p, (_, a, b) in zip(parts, spans[at : at + n], strict=True)]
            at += n
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document number k, the end id with them."""
        start = int(self.sizes[:k].sum())
        return self.ids(start, start + int(self.sizes[k]))


def packed_ids(vocabulary: bytes) -> Memo:
    """chunk -> its ids' bytes, two an id where the vocabulary has no id beyond."""
    tokenizer = word_tokenizer(vocabulary)
    words, letter = words_of(vocabulary, tokenizer), "H" if id_kind(tokenizer) == "<u2" else "I"
    packs = [struct.Struct(f"<{n}{letter}").pack for n in range(64)]

    def encode(chunks: list[str]) -> list[bytes]:
        found = map(words.ids, chunks)
        return [packs[n](*ids) if (n := len(ids)) < 64 else struct.pack(f"<{n}{letter}", *ids) for ids in found]

    return Memo(encode)


def id_kind(tokenizer) -> str:
    return "<u2" if max(tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def cut(texts: pa.Array, split) -> tuple[pa.Array, np.ndarray]:
    """All texts' chunks, and how many there are up to the end of each text."""
    if split is None:
        return texts, np.arange(1, len(texts) + 1)
    lists = pc.split_pattern(texts, " ") if split == AT_SPACES else pa.array([split.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)


def encode_texts(texts: pa.Array, memo: Memo, last: bytes, split) -> pa.BinaryArray:
    """Each text's ids and the end id; the memo is asked once for each different chunk."""
    pieces, ends = cut(texts, split)
    chunks, which = different(pieces)
    which = np.insert(which, ends, len(chunks))  # the end id
    ids = pa.array([*memo.results(chunks), last], pa.binary()).take(pa.array(which))
    _, offsets, raw = ids.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(ids) + 1, 4 * ids.offset)[np.append(0, ends + np.arange(1, len(ends) + 1))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), raw])


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, split=AT_SPACES) -> tuple[DataFrame, str]:
    """(doc_id, ids) of every row of docs: its text's ids without special tokens and the end id, as little-endian integers of the kind that is
    given back too.  A null text is empty.

    split: where a text can be cut without a change to its tokens; None for tokenizers that allow it nowhere."""
    data = shared_file(docs.sparkSession, vocabulary)
    kind = id_kind(word_tokenizer(data.value))
    last = np.array([end], kind).tobytes()
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = loaded("ids", packed_ids, data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encode_texts(batch.column("text"), memo, last, split)], ["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id long, ids binary"), kind


def count_ids(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all of encoded; a row an id comes to the driver, as many as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                new = np.bincount(np.frombuffer(raw.as_buffer(), kind))
                if len(new) > len(total):
                    total = np.append(total, np.zeros(len(new) - len(total), np.int64))
                total[: len(new)] += new
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_files(encoded: DataFrame, kind: str, table: Frequencies, file_ids: int = FILE, block: int = BLOCK, checkpoint: int = CHECKPOINT) -> DataFrame:
    """A materialized table (part, before, n_ids, data) of encoded's documents in ascending order of doc_id, null first; rows of one doc_id by their
    ids.  Files hold whole documents: one is full when it has file_ids ids.  before: the part's ids in earlier files."""
    freq = encoded.sparkSession.sparkContext.broadcast(table.freq)
    laid = encoded.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    laid = laid.select(F.spark_partition_id().alias("part"), "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = Frequencies(freq.value), np.dtype(kind).itemsize
        keys, parts, size, before, part = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            data = write_file(ids, [len(p) // width for p in parts], keys, own, block, checkpoint)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "before", "n_ids", "data"])

        for batch in batches:
            for part, key, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):  # noqa: B007
                keys.append(key)
                parts.append(raw)
                size += len(raw) // width
                if size >= file_ids:
                    yield flush()
                    keys, parts, size, before = [], [], 0, before + size
        if keys:
            yield flush()

    return materialize(laid.mapInArrow(write, "part int, before long, n_ids long, data binary"))


def read_files(files: DataFrame, table: Frequencies) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from their decoded ids.

    start: the ids of all documents before it, in the files' order.  ValueError on damaged files."""
    freq = files.sparkSession.sparkContext.broadcast(table.freq)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition of the order
    earlier = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    placed = files.join(F.broadcast(earlier), "part").select((F.col("earlier") + F.col("before")).alias("start"), "data")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Frequencies(freq.value)
        slots = own.slots()
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist(), strict=True):
                file = TokenFile(data, own, slots)
                ids = file.ids().astype("<u4")
                ends = np.cumsum(file.sizes)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - file.sizes, ends, strict=True)]
                columns = [pa.array(file.keys, pa.int64()), pa.array(ends - file.sizes + start, pa.int64()), pa.array(file.sizes, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, split=AT_SPACES, file_ids: int = FILE, block: int = BLOCK, checkpoint: int = CHECKPOINT) -> DataFrame:
    """Per row of docs: doc_id, start, n_tokens, ids_crc32, as its ids come back from the files.

    Rows that repeat are documents of their own; rows of one doc_id stand in the order of their ids' hash.  A null text has the end id
    alone.  Empty docs give no row."""
    encoded, kind = encode_documents(docs, vocabulary, end, split)
    encoded = materialize(encoded)
    table = Frequencies.scaled(count_ids(encoded, kind))
    return read_files(write_files(encoded, kind, table, file_ids, block, checkpoint), table)
