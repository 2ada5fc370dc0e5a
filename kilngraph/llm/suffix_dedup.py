"""Suffix-array dedup: find and remove every byte covered by a long string that also starts elsewhere.

A suffix array of a whole corpus does not fit a task, so the corpus' suffixes are dealt to many small arrays such that
equal windows (strings of `length` bytes) always meet:

1.  Every window start is owned by its window's anchor, the 48-byte gram of least hash within the window (so equal
    windows have equal anchors).  A run is the consecutive starts that one anchor occurrence owns; its context is the
    run's bytes up to the end of its last window.  Only hashes, not text, are shuffled here, about 1.3 a 100 bytes.
2.  Anchors that occur once are dropped.  Equal contexts of an anchor are counted; all windows of a context that occurs
    twice are repeats.
3.  One copy of every context whose anchor has other contexts too goes, with its bytes, to its anchor's shard.  There a
    two-stage sort builds the suffix array of the run's suffixes: suffixes smaller than their successors are
    sorted directly, the rest is induced by bucket scans; adjacent common prefixes of `length` bytes or more are repeats.
4.  Anchors with more than `hot_contexts` different contexts would be too much for a shard; their windows are counted by
    128-bit fingerprint in an ordinary aggregation instead, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import CHUNK_BYTES, as_bytes, bounded, held, materialize, mix, prefix_hash, span_hash, text_key

LENGTH = 200
GRAM = 48
#: Different contexts of one anchor that a shard sorts together (at 276 bytes each, some 14 MB).
HOT_CONTEXTS = 50_000
#: Bytes of contexts that are sorted at once.
SORT_BYTES = 2 << 20
POSITION_BITS = np.uint64(24)
#: Runs of a block of runs, on average.
BLOCK = 8

RUNS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int16()), ("times", pa.int32()), ("block", pa.int64()), ("head", pa.int32()), ("pos", pa.int32()), ("offset", pa.int32())])
RUNS_SQL = "id long, key long, anchor long, context long, n short, times int, block long, head int, pos int, offset int"
RANGES = "array<struct<start:int,end:int>>"
RANGES_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every width consecutive values is (the first of those alike in their top 40 bits)."""
    mask = np.uint64((1 << int(POSITION_BITS)) - 1)
    low = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return (low & mask).astype(np.int64)


def pieces(texts: list[bytes], length: int, limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, first byte, end byte) with about limit bytes together; texts beyond that are cut into pieces
    that overlap by length - 1 bytes, so every window is in one piece."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), limit):
            b = min(len(t), a + limit + length - 1)
            if b - a < length:
                continue
            if group and size + b - a > limit:
                yield group
                group, size = [], 0
            group.append((i, a, b))
            size += b - a + 1
    if group:
        yield group


def runs_of(texts: list[bytes], group: list[tuple[int, int, int]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, context, n, times, block, head, pos, offset) of every run in a group of pieces.

    Equal runs that follow each other, as in text of a short period, are one run with their number as times.  Consecutive
    runs of a piece are cut into blocks where a context's hash says so; block is the hash of the contexts in it, head a
    part of the first's (96 bits together), pos the block's start and offset the run's within it, so equal passages have equal blocks."""
    joined = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), np.uint8)
    sizes = np.array([b - a for _, a, b in group])
    ends = np.cumsum(sizes)
    prefix = prefix_hash(joined)
    at = np.arange(len(joined) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    least = sliding_argmin(grams, length - gram + 1)  # one for each window start
    valid = np.ones(len(least), np.bool_)
    for e in ends[:-1]:
        valid[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(valid)
    anchor = least[starts]
    piece = np.searchsorted(ends, starts, "right")
    new = np.ones(len(starts), np.bool_)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin, of = starts[first], piece[first]
    context, gram_at = span_hash(prefix, begin, begin + n + length - 1), grams[anchor[first]]
    again = (context[1:] == context[:-1]) & (gram_at[1:] == gram_at[:-1]) & (n[1:] == n[:-1]) & (of[1:] == of[:-1])
    once = np.flatnonzero(np.append(True, ~again)) if len(first) else first
    times = np.diff(np.append(once, len(first)))
    first, n, begin, of, context, gram_at = (x[once] for x in (first, n, begin, of, context, gram_at))
    text = np.array([i for i, _, _ in group])[of]
    offset = np.array([a for _, a, _ in group])[of] - (ends - sizes)[of]
    cut = np.ones(len(first), np.bool_)
    cut[1:] = (of[1:] != of[:-1]) | (context[:-1] % np.uint64(BLOCK) == 0)
    heads = np.flatnonzero(cut)
    block = np.cumsum(cut) - 1
    place = np.arange(len(first)) - heads[block]
    total = np.add.reduceat(mix(context + (place + (times << 32)).astype(np.uint64)), heads) if len(heads) else context
    pos = begin[heads][block]
    return text, gram_at.view(np.int64), context.view(np.int64), n.astype(np.int16), times.astype(np.int32), mix(total)[block].view(np.int64), context[heads][block].view(np.int64).astype(np.int32), (pos + offset).astype(np.int32), (begin - pos).astype(np.int32)


def suffix_array(symbols: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes in the order of their first depth symbols, by two-stage sorting.

    symbols: uint8, with 0 after each string and in no other place.  wanted: a mask.  Ties beyond depth are in any order.
    """
    n = len(symbols)
    wide = symbols.astype(np.int16)
    # smaller[i]: suffix i is smaller than its successor; a run of equal symbols is as its end is
    change = np.flatnonzero(wide[:-1] != wide[1:])
    rise = wide[change] < wide[change + 1]
    smaller = np.zeros(n, np.bool_)
    smaller[: change[-1] + 1] = np.repeat(rise, np.diff(np.append(-1, change)))
    # the rest needs the next smaller suffix (or a string's end) behind it
    base = np.flatnonzero(smaller | (symbols == 0))
    after = wanted.copy()
    ends = np.flatnonzero(wanted[:-1] & ~wanted[1:])
    ends = ends[~smaller[ends] & (symbols[ends] != 0)]
    stop = base[np.searchsorted(base, ends)]
    lengths = stop - ends
    if len(ends):
        fill = np.repeat(ends, lengths) + 1 + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        after[fill] = True
    # 1. sort the smaller ones directly, eight symbols at a time, only where a tie is left
    padded = np.concatenate([symbols, np.zeros(depth + 16, np.uint8)])
    packed = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        packed = (packed << np.uint64(8)) | padded[j : j + n + depth + 8]
    direct = np.flatnonzero(after & (smaller | (symbols == 0)))
    direct = direct[np.argsort(packed[direct], kind="stable")]
    key = packed[direct]
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    live = np.arange(len(direct))
    for d in range(8, depth, 8):
        # in a group of its own, or at its string's end: settled
        ended = has_zero(key)
        same = np.zeros(len(live), np.bool_)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        keep = same & ~ended
        live, group = live[keep], group[keep]
        if not len(live):
            break
        at = direct[live]
        key = packed[at + d]
        order = np.lexsort((key, group))
        direct[live] = at[order]
        key, group = key[order], group[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        group = np.cumsum(new)
    # 2. induce the others: scan the buckets in order, a suffix puts its greater predecessor at the end of its bucket's front part
    front: list[list[np.ndarray]] = [[] for _ in range(257)]
    back = np.searchsorted(symbols[direct], np.arange(257))
    out = []
    for c in range(256):
        layers = front[c]
        layer = np.concatenate(layers) if layers else direct[:0]
        got = [layer]
        while len(layer):
            layer = layer[layer > 0] - 1
            layer = layer[after[layer] & ~smaller[layer] & (symbols[layer] == c)]
            got.append(layer)
        bucket = np.concatenate([*got, direct[back[c] : back[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[after[before] & ~smaller[before] & (symbols[before] > c)]
        if len(before):
            s = symbols[before]
            before, s = before[order := np.argsort(s, kind="stable")], s[order]
            cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            for x, y in zip(cuts, np.append(cuts[1:], len(s)), strict=True):
                front[s[x]].append(before[x:y])
    array = np.concatenate(out) if out else direct[:0]
    return array[wanted[array]]


def has_zero(packed: np.ndarray) -> np.ndarray:
    """Whether any of a word's eight bytes is 0."""
    return ((packed - np.uint64(0x0101010101010101)) & ~packed & np.uint64(0x8080808080808080)) != 0


def common_prefixes(symbols: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix but the first shares depth symbols with the one before it in the array."""
    padded = np.concatenate([symbols, np.zeros(depth + 8, np.uint8)])
    pair = np.arange(1, len(array))
    for d in [*range(0, depth - 7, 8), max(0, depth - 8)]:
        a, b = array[pair - 1], array[pair]
        same = np.ones(len(pair), np.bool_)
        for j in range(d, min(d + 8, depth)):
            x = padded[a + j]
            same &= (x == padded[b + j]) & (x != 0)
        pair = pair[same]
    out = np.zeros(max(0, len(array) - 1), np.bool_)
    out[pair - 1] = True
    return out


def repeated_starts(contexts: list[bytes], counts: list[int], length: int, owners: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """For each context a mask of its window starts whose window also starts in another place.

    owners: the least and largest text each context is of; then only windows of at least two texts count."""
    symbols = np.zeros(sum(map(len, contexts)) + len(contexts), np.uint8)
    wanted = np.zeros(len(symbols), np.bool_)
    at, begins = 0, []
    for c, n in zip(contexts, counts, strict=True):
        symbols[at : at + len(c)] = np.frombuffer(c, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        wanted[at : at + n] = True
        begins.append(at)
        at += len(c) + 1
    array = suffix_array(symbols, wanted, length)
    same = common_prefixes(symbols, array, length)
    marked = np.zeros(len(symbols), np.bool_)
    if owners is None:
        marked[array[1:][same]] = True
        marked[array[:-1][same]] = True
    elif len(array):
        of = np.searchsorted(np.array(begins), array, "right") - 1
        first, last = (np.array([o[k] for o in owners], np.int64)[of] for k in (0, 1))
        group = np.flatnonzero(np.append(True, ~same))
        several = np.minimum.reduceat(first, group) != np.maximum.reduceat(last, group)
        marked[array[np.repeat(several, np.diff(np.append(group, len(array))))]] = True
    return [marked[b : b + n] for b, n in zip(begins, counts, strict=True)]


def mask_ranges(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, scope: str | None = None, across: bool = False) -> DataFrame:
    """(id, key, starts): the starts of repeated windows of each text that has any, as half-open ranges.

    id and key are util.text_key's; rows that share both have equal texts and share the row here.  scope: a column;
    only texts of one scope are compared.  across: only windows that occur under two ids at least count as repeats.
    """
    id_, key_ = scoped_key(docs, scope)
    within = F.lit(0).cast("long") if scope is None else F.xxhash64(scope)
    texts = bounded(docs).select(id_.alias("id"), key_.alias("key"), within.alias("within"), "text").where(F.octet_length("text") >= length)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch.column("text"))
            ids, keys, within = (batch.column(c).to_numpy() for c in ("id", "key", "within"))
            for group in pieces(raw, length):
                text, anchor, context, n, times, block, head, pos, offset = runs_of(raw, group, length, gram)
                # blocks of different scopes are told apart, as their marks may differ
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], keys[text], anchor ^ within[text], context, n, times, block ^ within[text], head, pos, offset)], schema=RUNS)

    every = held(texts.mapInArrow(digest, RUNS_SQL))
    # tables of their own on both sides of the join, so that Spark can split the partition of an anchor that is everywhere
    twice = held(every.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"))
    runs = materialize(every.join(twice, "anchor", "left_semi").select(every.columns))  # what comes before it can go then
    every.unpersist()
    twice.unpersist()

    copy = F.min(F.struct("id", "key", (F.col("pos") + F.col("offset")).alias("start"))).alias("copy")
    contexts = runs.groupBy("anchor", "context").agg(F.sum("times").alias("times"), copy, F.max("n").cast("int").alias("n"), F.max("id").alias("last"))
    contexts = materialize(contexts.withColumn("whole", F.col("copy.id") < F.col("last") if across else F.col("times") > 1))  # every window repeats
    several = held(contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    asked = contexts.join(several, "anchor").groupBy("copy.id", "copy.key")
    asked = asked.agg(F.collect_list(F.struct("anchor", "context", "n", "kinds", F.col("copy.id").alias("first"), "last", "whole", "copy.start")).alias("asked"))  # a text's own runs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int32()), ("kinds", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("whole", pa.bool_()), ("bytes", pa.binary())])
        for batch in batches:
            for raw, wants in zip(as_bytes(batch.column("text")), batch.column("asked"), strict=True):
                wants = wants.as_py()
                columns = [[w[f] for w in wants] for f in ("anchor", "context", "n", "kinds", "first", "last", "whole")]
                columns.append([raw[w["start"] : w["start"] + w["n"] + length - 1] for w in wants])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    strings = texts.join(asked, ["id", "key"]).select("text", "asked")
    strings = strings.mapInArrow(cut, "anchor long, context long, n int, kinds long, first long, last long, whole boolean, bytes binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("ranges", RANGES_ARROW)])
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            owners = [(r[4], r[5]) for r in rows] if across else None
            masks = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length, owners)
            found = [(r[0], r[1], mask_ranges(m)) for r, m in zip(rows, masks, strict=True) if m.any() and not r[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 3, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "bytes", "first", "last", "whole")), strict=True):
                if size > SORT_BYTES and row[0] != rows[-1][0]:  # anchors are in order: all of an anchor's contexts are held
                    yield flush()
                    rows, size = [], 0
                if not rows or row[:2] != rows[-1][:2]:  # rows of docs that repeat bring a context twice
                    rows.append(row)
                    size += len(row[3])
        if rows:
            yield flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, context, n, raw, first, last, whole in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "bytes", "first", "last", "whole")), strict=True):
                prints = [hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(prints, pa.binary()), pa.array([first] * n, pa.int64()), pa.array([last] * n, pa.int64()), pa.array([whole] * n, pa.bool_())], ["anchor", "context", "at", "print", "first", "last", "whole"])

    crowded = bool(several.where(F.col("kinds") > hot_contexts).take(1))
    strings = materialize(strings) if crowded else strings
    shards = strings.where(F.col("kinds") <= hot_contexts).repartition("anchor").sortWithinPartitions("anchor", "context")
    sorted_ = shards.mapInArrow(sort, f"anchor long, context long, ranges {RANGES}")
    hot = strings.where(F.col("kinds") > hot_contexts).dropDuplicates(["anchor", "context"]).mapInArrow(windows, "anchor long, context long, at int, print binary, first long, last long, whole boolean")
    again = hot.groupBy("anchor", "print").agg(F.count("*").alias("times"), F.min("first").alias("first"), F.max("last").alias("last"))
    again = again.where("first < last" if across else "times > 1").select("anchor", "print")
    hot = hot.where(~F.col("whole")).join(again, ["anchor", "print"], "left_semi").groupBy("anchor", "context").agg(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"))).alias("ranges"))
    whole = contexts.where("whole").select("anchor", "context", F.lit(None).cast(RANGES).alias("ranges"))
    marks = whole.unionByName(sorted_)
    if crowded:
        marks = marks.unionByName(hot.select("anchor", "context", F.col("ranges").cast(RANGES)))
    # marks go to the different blocks first and from there to the texts: a passage that is everywhere is joined once
    members = runs.select("block", "head", "offset", "n", "times", "anchor", "context").distinct().join(marks, ["anchor", "context"])
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    turn = lambda k: F.transform("ranges", lambda r: span(r["start"] + F.col("offset") + k * F.col("n"), r["end"] + F.col("offset") + k * F.col("n")))
    moved = F.when(F.col("ranges").isNull(), F.array(span(F.col("offset"), F.col("offset") + F.col("n").cast("int") * F.col("times")))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.col("times") - 1), turn)))
    marked = materialize(members.groupBy("block", "head").agg(F.flatten(F.collect_list(moved)).alias("ranges")))  # a block's own runs
    places = runs.select("id", "key", "block", "head", F.col("pos").alias("start")).distinct()
    spans = places.join(marked, ["block", "head"]).groupBy("id", "key")
    return spans.agg(F.collect_list(F.struct("start", "ranges")).alias("starts"))  # a text's own blocks


def kept(raw: bytes, starts: list[dict] | None, length: int) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(maximal removed runs, remaining parts) of a text."""
    covered: list[tuple[int, int]] = []
    for a, b in sorted((s["start"] + r["start"], s["start"] + r["end"] + length - 1) for s in starts or () for r in s["ranges"]):
        if covered and a <= covered[-1][1]:
            if b > covered[-1][1]:
                covered[-1] = (covered[-1][0], b)
        else:
            covered.append((a, b))
    at, parts = 0, []
    for a, b in covered:
        parts.append(raw[at:a])
        at = b
    return covered, [*parts, raw[at:]]


def scoped_key(docs: DataFrame, scope: str | None) -> tuple[F.Column, F.Column]:
    id_, key_ = text_key(docs)
    return id_, key_ if scope is None else F.xxhash64(key_, docs[scope])


def with_starts(docs: DataFrame, repeats: DataFrame, carry: list[str], scope: str | None = None) -> DataFrame:
    id_, key_ = scoped_key(docs, scope)
    row = F.struct(*[F.col(f"`{n}`") for n in carry])
    keyed = bounded(docs).select(id_.alias("id"), key_.alias("key"), "text", row.alias("row"))
    return keyed.join(repeats, ["id", "key"], "left").select("row", "text", "starts")


def dedup_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of length bytes that also starts anywhere else (same text included, overlaps too) is
    removed; strings are judged on the input.  A null text is empty.  Rows that repeat count as documents of their own.
    """
    found = with_starts(docs, find_repeats(docs, length, gram, hot_contexts), ["doc_id"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, starts in zip(as_bytes(batch.column("text")), batch.column("starts"), strict=True):
                removed, parts = kept(raw, starts.as_py(), length)
                rest = hashlib.sha256()
                for p in parts:
                    rest.update(p)
                rows.append((len(raw), sum(b - a for a, b in removed), len(removed), rest.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "starts")
    return rows.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs with the repeated strings cut out of text; a character of which any byte goes, goes.  Null texts stay null."""
    carry = [n for n in docs.columns if n != "text"]
    found = with_starts(docs, find_repeats(docs, length, gram, hot_contexts), carry)
    schema = found.select("row", "text").schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if not there else "".join(p.decode("utf-8", "ignore") for p in kept(raw, starts.as_py(), length)[1])
                for raw, starts, there in zip(as_bytes(batch.column("text")), batch.column("starts"), batch.column("text").is_valid().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.schema.field("text").type)], ["row", "text"])

    out = found.mapInArrow(clean, schema)
    return out.select(*[F.col("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in docs.columns])
