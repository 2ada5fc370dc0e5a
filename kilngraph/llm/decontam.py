"""Benchmark decontamination by training suffix arrays.

Every task turns a shard of training text (about 1 MB of whole documents) into word numbers, builds the suffix array of
the shard's suffixes that can begin a match, binary-searches every benchmark window in it, and so gets the
longest verbatim matches and their places.  No shuffle: benchmark blocks of a fixed size go to the tasks, and a
benchmark larger than a block is handled block by block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import ALNUM, as_bytes, bounded, chunked, join_texts, mix, prefix_hash, span_hash, words_of

#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: A word number takes so many bytes of a suffix key, each from 1 to 128.
DIGITS = 4
SPANS = "array<struct<start:int,end:int>>"


def word_hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, start, end = words_of(joined, ALNUM)
    return low, start, end, span_hash(prefix_hash(low), start, end)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[j : len(words) - n + 1 + j]
    return mix(h)


def suffix_keys(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers (0: past the end) as byte strings that sort as the rows do; a shorter row sorts first."""
    out = np.zeros((*numbers.shape, DIGITS), np.uint8)
    rest = numbers - 1
    for d in range(DIGITS - 1, -1, -1):
        out[..., d] = np.where(numbers > 0, rest % 128 + 1, 0)
        rest = rest // 128
    width = numbers.shape[1] * DIGITS
    return out.reshape(len(numbers), width).view(f"S{width}").ravel()


class TestSuffixes:
    """The windows of a benchmark block as keys for binary search.

    An item of window words or more has a window at each word with enough words behind it; a shorter one is one window."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window = window
        words: list[np.ndarray] = []
        strings: list[list[bytes]] = []
        self.items: list[str | None] = []
        for item, text in items:
            joined, _ = join_texts([(text or "").encode()])
            low, start, end, hashes = word_hashes(joined)
            if len(hashes):
                raw = low.tobytes()
                words.append(hashes)
                strings.append([raw[a:b] for a, b in zip(start, end, strict=True)])
                self.items.append(None if item is None else str(item))
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        if len(self.vocabulary) >= 128**DIGITS:
            raise ValueError("a benchmark block holds too many different words; lower block_bytes")
        self.shortest = min([window, *map(len, words)])
        keys, self.of, self.at, self.length, self.string = [], [], [], [], []
        for i, w in enumerate(words):
            n = min(window, len(w))
            numbers = np.searchsorted(self.vocabulary, w) + 1
            for j in range(len(w) - n + 1):
                row = np.zeros(window, np.int64)
                row[:n] = numbers[j : j + n]
                keys.append(row)
                self.of.append(i)
                self.at.append(j)
                self.length.append(n)
                self.string.append(b" ".join(strings[i][j : j + n]))
        self.keys = suffix_keys(np.array(keys, np.int64).reshape(-1, window))
        self.above = np.array([k + b"\xff" * (window * DIGITS - n * DIGITS) for k, n in zip(self.keys.tolist(), self.length, strict=True)], self.keys.dtype)
        grams = [gram_hashes(w, self.shortest) for w in words]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 20, np.bool_)
        self.maybe[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]]]:
        """Words of each text, and for texts with matches the list of (first word, end word, item, word of the item)."""
        joined, bounds = join_texts(texts)
        low, start, end, hashes = word_hashes(joined)
        first = np.searchsorted(start, bounds)
        counts = np.diff(first)
        found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        grams = gram_hashes(hashes, self.shortest) if len(self.grams) else hashes[:0]
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        at = at[np.isin(grams[at], self.grams)]
        if len(at):
            text = np.searchsorted(first, at, "right") - 1
            last = first[text + 1]
            at, text, last = (x[at + self.shortest <= last] for x in (at, text, last))
        if not len(at):
            return counts, found
        # the shard's suffix array: its suffixes that can begin a match, sorted by their next words
        ahead = at[:, None] + np.arange(self.window)
        inside = ahead < last[:, None]
        h = hashes[np.where(inside, ahead, 0)]
        number = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        keys = suffix_keys(np.where(inside & (self.vocabulary[number] == h), number + 1, 0))
        order = np.argsort(keys, kind="stable")
        array, keys = at[order], keys[order]
        text = text[order]
        low_at, high_at = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.above, "right")
        raw = low.tobytes()
        for t in np.flatnonzero(high_at > low_at):
            n = self.length[t]
            for k in range(low_at[t], high_at[t]):
                p, doc = int(array[k]), int(text[k])
                if b" ".join(raw[a:b] for a, b in zip(start[p : p + n], end[p : p + n], strict=True)) == self.string[t]:
                    p -= int(first[doc])
                    found[doc].append((p, p + n, self.of[t], self.at[t]))
        return counts, found


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def longest(matches: list[tuple[int, int, int, int]]) -> int:
    """Words of the longest verbatim match: windows that follow each other in the document and in the item are one."""
    best, open_at = 0, {}
    for a, b, item, j in sorted(matches):
        begun = open_at.pop((item, j - 1, a - 1), a)
        open_at[item, j, a] = begun
        best = max(best, b - begun)
    return best


def benchmark_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's windows, block by block, for the tasks."""
    bench = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("words")).where(F.col("words").isNotNull())
    size = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for k in range(blocks):
        rows = [tuple(r) for r in bench.where(block == k).collect()]  # one block, of about block_bytes at most
        yield docs.sparkSession.sparkContext.broadcast(TestSuffixes(sorted(rows, key=str), window))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, row (a struct of the columns in carry), n_words, hits (merged word spans), items (sorted ids as strings), longest_match, per row of docs.

    Null and empty texts have no words and no hits.  Repeated rows each give a row.  An item without words has no
    window; an item with a null id marks words but is not listed; items that share an id count once.
    longest_match is in words, 0 without a match; a match that only spans several blocks' items counts by item.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in carry or ["doc_id"]])
    out = bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), row.alias("row"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest_match"),
    )
    schema = out.schema
    for held in benchmark_blocks(docs, benchmark, window, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tests = held.value
            for batch in batches:
                texts = as_bytes(batch.column("text"))
                words = np.zeros(len(texts), np.int64)
                had = {name: batch.column(name).to_pylist() for name in ("hits", "items", "longest_match")}
                for a, b in chunked(texts):
                    words[a:b], found = tests.search(texts[a:b])
                    for i, matches in found.items():
                        i += a
                        had["hits"][i] = [{"start": x, "end": y} for x, y in union([(h["start"], h["end"]) for h in had["hits"][i]] + [m[:2] for m in matches])]
                        had["items"][i] = sorted({*had["items"][i], *(tests.items[m[2]] for m in matches)} - {None})
                        had["longest_match"][i] = max(had["longest_match"][i], longest(matches))
                names = batch.schema.names
                columns = {n: batch.column(n) for n in names} | {"n_words": pa.array(words)} | {n: pa.array(v, batch.schema.field(n).type) for n, v in had.items()}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=batch.schema)

        out = out.mapInArrow(scan, schema)
    return out


def runs_of_windows(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, first word, first word in the item, words) of the verbatim matches that no longer one holds."""
    open_at: dict[tuple[int, int, int], tuple[int, int]] = {}  # the run whose last window is at (item, its place, the document's)
    ends: dict[tuple[int, int, int], int] = {}
    for a, b, item, j in sorted(matches):
        begun = open_at.pop((item, j - 1, a - 1), (a, j))
        open_at[item, j, a] = begun
        ends[item, *begun] = b
    return [(item, a, j, b - a) for (item, a, j), b in ends.items()]


def match_locations(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item, word, item_word, words): where the longest verbatim matches of items of window words or more (shorter: whole
    items) lie in documents and in items, words from 0.  Rows of docs that repeat give their matches again; an item with a
    null id gives rows with a null item."""
    out = None
    for held in benchmark_blocks(docs, benchmark, window, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
                for a, b in chunked(texts):
                    rows = [(ids[a + i], held.value.items[item], *rest) for i, matches in held.value.search(texts[a:b])[1].items() for item, *rest in runs_of_windows(matches)]
                    columns = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item", "word", "item_word", "words"])

        found = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, item string, word long, item_word long, words long")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document the words that occur inside any benchmark window: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = find_matches(docs, benchmark, window, block_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest_match",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark window.  All columns of docs stay; rows with null text stay."""
    carry = [n for n in docs.columns if n != "text"]
    found = find_matches(docs, benchmark, window, block_bytes, carry).where(F.size("hits") == 0)
    return found.select(*[F.col("text") if n == "text" else F.col(f"row.`{n}`") for n in docs.columns])
