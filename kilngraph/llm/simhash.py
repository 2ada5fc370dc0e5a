"""SimHash near-dedup: word-shingle fingerprints, tiled exact comparison, connected groups.

Fingerprints that differ in at most r of 64 bits agree in one of r + 1 blocks of bits, so only fingerprints of a bucket
(a block and its value) are compared: in tiles sorted by population count, with numpy exclusive-or and bit counts;
tile pairs whose population counts differ by more than r are skipped.  A bucket that is too large is
divided by blocks of its remaining bits, again and again; after four divisions it can hold no more than 2 ** 13
fingerprints, so no task ever holds more, and no link is lost.  A bucket's links go on as stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import NONSPACE, as_bytes, bounded, checkpointed, chunked, held, join_texts, mix, prefix_hash, span_hash, words_of

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a bucket that are compared together.
BUCKET = 4096
TILE = 512
#: Rows of a file that a step of the components' search writes.
EDGES = 500_000


def shingle_hashes(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of the texts (repeats included), and where each text's begin (and the end)."""
    joined, bounds = join_texts(texts)
    low, start, end = words_of(joined, NONSPACE)
    keep = low != 0
    keep[1:] |= keep[:-1]  # a word and one separator
    place = np.cumsum(keep) - keep
    plain = np.where(low == 0, np.uint8(0x20), low)[keep].tobytes()
    start, end = place[start], place[end - 1] + 1
    first = np.searchsorted(start, place[np.minimum(bounds, len(low) - 1)]) if len(low) else np.zeros(len(bounds), np.int64)
    first[-1] = len(start)
    words = np.diff(first)
    begin = np.arange(len(start))
    text = np.repeat(np.arange(len(texts)), words)
    behind = first[1:][text] - begin  # words from here on
    own = np.minimum(width, words)[text]
    begin = begin[behind >= own]
    stop = end[begin + own[begin] - 1]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(plain[a:b], seed) for a, b in zip(start[begin].tolist(), stop.tolist(), strict=True)), np.uint64, len(begin))
    counts = np.where(words > 0, np.maximum(words - width, 0) + 1, 0)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def fingerprints(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A bit is 1 if it is set in over half of the text's shingle hashes; no words: 0."""
    hashes, at = shingle_hashes(texts, width, seed)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > np.diff(at)[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_docs(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id (long), fingerprint (long) per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            parts = [fingerprints(texts[a:b], width, seed) for a, b in chunked(texts)]
            prints = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fingerprint long")


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def bucket_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of those it is linked to within the bucket), for fingerprints that are linked."""
    pop = np.bitwise_count(prints)
    order = np.argsort(pop, kind="stable")
    prints, pop = prints[order], pop[order].astype(np.int64)
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(0, len(prints), TILE):
        a = prints[i : i + TILE]
        for j in range(i, len(prints), TILE):
            if pop[j] - pop[min(i + TILE, len(prints)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ prints[None, j : j + TILE]) <= radius
            for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                p, q = find(i + x), find(j + y)
                if p != q:
                    root[max(p, q)] = min(p, q)
    least: dict[int, int] = {}
    values = prints.view(np.int64).tolist()
    for k, v in enumerate(values):
        least[r] = min(least.get(r := find(k), v), v)
    return [(v, least[find(k)]) for k, v in enumerate(values) if least[find(k)] != v]


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v), u > v, that connect all fingerprints within radius bits of each other.  prints: distinct (fingerprint)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for held in batch.column(0):
                found += bucket_links(held.values.to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    def keys(blocks: list[tuple[int, list[int]]]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for m, _ in blocks]))

    out = None
    # (fingerprint, mask) still to be dealt, by the masks whose buckets are divided
    blocks = [(mask(b), [x for x in range(64) if x not in b]) for b in split_bits(list(range(64)), radius + 1)]
    dealt = prints.select("fingerprint", keys(blocks).alias("key")).select("fingerprint", "key.*")
    for level in range(4):
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > bucket).select("mask", "value") if level < 3 else None
        more = large is not None and bool(large.take(1))
        small = dealt.join(sizes.where((F.col("n") > 1) & ((F.col("n") <= bucket) | F.lit(not more))), ["mask", "value"], "left_semi")
        found = small.groupBy("mask", "value").agg(F.collect_list("fingerprint").alias("held")).select("held").mapInArrow(compare, "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not more:
            break
        refined = {m: [(m | s, [x for x in rest if x not in part]) for part in split_bits(rest, radius + 1) for s in [mask(part)]] for m, rest in blocks}
        blocks = [b for new in refined.values() for b in new]
        rule = F.create_map(*[x for m, new in refined.items() for x in (F.lit(m), F.array(*[F.lit(n | m) for n, _ in new]))])
        dealt = dealt.join(large, ["mask", "value"], "left_semi").select("fingerprint", F.explode(rule[F.col("mask")]).alias("mask"))
        dealt = held(dealt.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask"))).distinct())
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that is larger than its root.  edges: (u, v), u > v.

    Alternating large and small stars, until nothing changes; every step is a join and an aggregation with map-side minima, and
    ends in a checkpoint of about EDGES rows a file.  A chain of n nodes takes about log n steps.
    """
    first = held(edges)
    now, last = (first.count(), None), None
    edges = checkpointed(first.coalesce(now[0] // EDGES + 1))
    first.unpersist()
    while now != last:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = checkpointed(small.distinct().coalesce(now[0] // EDGES + 1))  # never more edges than before, but for the stars' own
        last, now = now, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over
    links of radius bits or fewer, itself included).

    A null or blank text has fingerprint 0 and is linked like any other; a null doc_id is never a component's
    smallest unless all its ids are null.  Each row gives a row.
    """
    marked = held(fingerprint_docs(docs, width, seed))
    prints = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = components(links(prints.select("fingerprint"), radius, bucket))
    rooted = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = rooted.join(ids, "root").select("fingerprint", "component_id")
    return marked.join(groups, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity: wide fingerprints in tiles, with an exact check --------------------------------------

#: 64-bit words of a wide fingerprint.
WORDS = 8
#: A text is in so many buckets, each by so many of its set's least hashes.
BANDS, ROWS = 16, 4
#: Sets below this size are not told apart by their fingerprints, only by the exact check.
SMALL = 64
#: Shingles of a tile; a larger bucket is cut into several.
TILE_SHINGLES = 500_000
#: Text numbers, eight bytes each, that may be broadcast.
MOST_CLASHES = 1_000_000
SIMILARITY = 0.8
#: A shingle's number: so many bits of its hash.
ID_BITS = 52


def expected_share(similarity: float) -> float:
    """The share of SimHash bits in which two sets of that Jaccard similarity differ on average."""
    cosine = 2 * similarity / (1 + similarity)
    return float(np.arccos(cosine) / np.pi)


def within(bits: int, similarity: float, sigmas: float = 4.0) -> int:
    """Bits of a fingerprint in which sets of at least that similarity differ at most, but for a few in 30,000."""
    p = expected_share(similarity)
    return int(np.ceil(bits * p + sigmas * np.sqrt(bits * p * (1 - p))))


def distinct_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle numbers of each text, and where each text's begin (and the end).

    A text of fewer words is one shingle; one without words has none.  At most 4096 texts."""
    joined, bounds = join_texts(texts)
    low, start, end = words_of(joined, NONSPACE)
    words = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    text = np.repeat(np.arange(len(texts)), count)
    own = np.minimum(width, count)[text]
    begin = np.flatnonzero(first[1:][text] - np.arange(len(words)) >= own)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(begin), np.uint64)
    for j in range(width):
        total = np.where(j < own[begin], mix(total ^ padded[begin + j]), total)
    key = np.sort((text[begin].astype(np.uint64) << np.uint64(ID_BITS)) | (total >> np.uint64(64 - ID_BITS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    at = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(ID_BITS)) if len(texts) < 4096 else np.append(np.searchsorted(key, np.arange(len(texts), dtype=np.uint64) << np.uint64(ID_BITS)), len(key))
    return key & np.uint64((1 << ID_BITS) - 1), at


def wide_fingerprints(ids: np.ndarray, at: np.ndarray, words: int = WORDS) -> np.ndarray:
    """(text, word) SimHash fingerprints of the texts' shingle sets."""
    out = np.zeros((len(at) - 1, words), np.uint64)
    full = np.flatnonzero(np.diff(at))
    for j in range(words if len(full) else 0):
        bits = np.unpackbits(mix(ids + np.uint64(j << ID_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
        out[full, j] = np.packbits(2 * ones > np.diff(at)[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def bucket_keys(ids: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(text, band) keys of the buckets a text is in: sets of a similarity s share a band's with chance s ** rows."""
    salts = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(bands, rows, 2)
    out = np.zeros((len(at) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(at))
    for b in range(bands):
        key = np.full(len(at) - 1, b, np.uint64)
        for r in range(rows if len(full) else 0):
            key[full] = mix(key[full] ^ np.minimum.reduceat((ids ^ salts[b, r, 0]) * (salts[b, r, 1] | np.uint64(1)), at[full]))
        out[:, b] = mix(key + np.uint64(b))
    return out


def slices(ids: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen texts' shingles in one array, and where each text's begin (and the end)."""
    size = (at[1:] - at[:-1])[chosen]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids[np.arange(ends[-1]) + np.repeat(at[:-1][chosen] - ends[:-1], size)], ends


def similar_to(hub: int, others: np.ndarray, ids: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the others whose sets have the Jaccard similarity to the hub's."""
    own = ids[at[hub] : at[hub + 1]]
    held, ends = slices(ids, at, others)
    place = np.minimum(np.searchsorted(own, held), max(len(own) - 1, 0))
    common = np.diff(np.concatenate([[0], np.cumsum(own[place] == held if len(own) else np.zeros(len(held), np.bool_))])[ends])
    return others[common >= similarity * (len(own) + np.diff(ends) - common)]


def links_within(ids: np.ndarray, at: np.ndarray, prints: np.ndarray, group: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join all texts of a bucket whose sets have the similarity, at most one fewer than texts.

    group: texts of one group are joined already.  Fingerprints are compared in tiles in the order of their population counts;
    tile pairs whose counts differ beyond the radius are skipped.  Pairs within the radius are held against each other's whole
    sets, a text and all its partners at once, unless links found before join them."""
    size, radius = np.diff(at), within(64 * prints.shape[1], similarity)
    pop = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    small = size < SMALL
    order = np.lexsort((pop, ~small))
    group = np.unique(group, return_inverse=True)[1]
    found: list[tuple[int, int]] = []

    def join(hub: int, others: np.ndarray) -> None:
        others = others[(np.minimum(size[others], size[hub]) >= similarity * np.maximum(size[others], size[hub])) & (group[others] != group[hub])]
        good = similar_to(hub, others, ids, at, similarity) if len(others) else others
        if len(good):
            merged, once = np.unique(group[good], return_index=True)
            found.extend((hub, int(x)) for x in good[once])
            group[np.isin(group, merged)] = group[hub]

    if len(order) > TILE // 8:  # of many texts the one amid them first: what is like it needs no other link
        votes = np.unpackbits(prints.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * votes > len(prints), bitorder="little").view("<u8")
        join(int(np.bitwise_count(prints ^ middle).sum(axis=1, dtype=np.int64).argmin()), np.arange(len(order)))
    for i in range(0, len(order), TILE):
        a = order[i : i + TILE]
        for j in range(i, len(order), TILE):
            b = order[j : j + TILE]
            if not small[a].any() and pop[b[0]] - pop[a[-1]] > radius:
                break
            if group[a].min() == group[a].max() == group[b].min() == group[b].max():
                continue
            near = distances(prints[a], prints[b]) <= radius
            near |= small[a][:, None] | small[b][None, :]
            near &= group[a][:, None] != group[b][None, :]
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                join(int(a[x]), b[near[x]])
    return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint of a (row, word) and each of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def small_chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in chunked(texts):
        for c in range(a, b, 4096):
            yield c, min(b, c + 4096)


def first_number(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows (text, ...) with node, a 64-bit number of the text.  again: (node) of first numbers that several texts have; those
    texts get a second number.  At 10^11 texts a few hundred are expected; they are broadcast up to MOST_CLASHES."""
    rows = rows.withColumn("node", first_number(F.col("text")))
    if again is None:
        return rows
    again = again.withColumn("_again", F.lit(True))
    again = F.broadcast(again) if again.count() <= MOST_CLASHES else again
    return rows.join(again, "node", "left").withColumn("node", F.when(F.col("_again"), F.xxhash64(F.lit("again"), "text")).otherwise(F.col("node"))).drop("_again")


def fingerprint_texts(keyed: DataFrame, width: int) -> DataFrame:
    """(node, n, keys, clash) of each number of a text: its set's size, its buckets, and whether texts of different MD5 have
    that number (n and keys are of no use then).  keyed: (node, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in small_chunks(texts):
                ids, at = distinct_shingles(texts[a:b], width)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(bucket_keys(ids, at).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("node", "digest")), pa.array(np.diff(at)), keys], ["node", "digest", "n", "keys"])

    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    marked = keyed.select("node", "text", digest.alias("digest")).mapInArrow(scan, "node long, digest binary, n long, keys array<long>")
    clash = F.min("digest") != F.max("digest")
    return held(marked.groupBy("node").agg(F.max("n").alias("n"), F.max("keys").alias("keys"), clash.alias("clash")))


def shingle_sets(keyed: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, print, ids) of the asked nodes' texts: the wide fingerprint and the shingle numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in small_chunks(texts):
                ids, at = distinct_shingles(texts[a:b], width)
                prints = pa.FixedSizeListArray.from_arrays(pa.array(wide_fingerprints(ids, at).view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), prints, sets], ["node", "print", "ids"])

    whole = keyed.join(asked.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    return whole.select("node", "text").mapInArrow(scan, "node long, print array<long>, ids array<long>")


def pairs_similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("ids").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("ids").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def distinct_texts(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs as (text, node), fingerprint_texts of them, again for numbered): a number stands for one text only, as 128 more bits
    tell.  RuntimeError where even second numbers meet (a chance of some 10^-6 at 10^11 texts)."""
    texts = bounded(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    keyed = numbered(texts, None)
    found = fingerprint_texts(keyed, width)
    if not found.where("clash").count():
        return keyed, found, None
    again = held(found.where("clash").select("node"))
    keyed = numbered(texts, again)
    found = fingerprint_texts(keyed, width)
    if found.where("clash").count():
        raise RuntimeError("different texts have the same two hashes")
    return keyed, found, again


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY, tile: int = TILE_SHINGLES) -> DataFrame:
    """(node, root) for every distinct text: node = its number (see numbered), root = the group's smallest node.

    Texts are linked if they are equal or if the Jaccard similarity of their whole texts' sets of width-word shingles is at least
    `similarity`; a text of fewer words is one shingle, and texts without words are copies of each other.  Texts are compared
    that share a bucket: a band of their sets' least hashes (two texts of exactly 0.8 share one of 16 with a chance of
    0.9998), whose fingerprints in tiles are within the radius that the similarity allows, and whose sets then prove similar.

    Buckets with equal members are compared once.  A bucket gives links that join its texts, never all pairs.  A bucket of more
    than `tile` shingles is first held against one of its texts; what is like that one is dealt over its tiles, and only the rest
    goes to every tile.
    """
    keyed, texts, _ = distinct_texts(docs, width)
    return grouped(keyed, texts, width, similarity, tile)


def grouped(keyed: DataFrame, texts: DataFrame, width: int, similarity: float, tile: int) -> DataFrame:
    """near_copy_groups of distinct_texts."""
    sums = [F.sum(F.shiftright(F.xxhash64(F.lit(k), "node"), 20)).alias(f"sum{k}") for k in (1, 2)]
    rows = texts.select("node", (F.col("n") + 16).alias("n"), F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("total"), F.min("node").alias("hub"), F.max("node").alias("last"), *sums).where("texts > 1")
    once = buckets.groupBy("texts", "total", "hub", "last", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "hub", "total")
    members = held(rows.join(once, "key"))
    sets = shingle_sets(keyed, members, width)
    stars = None
    if members.where(F.col("total") > tile).take(1):
        sets = held(sets)
        stars = held(pairs_similar(sets, members.where(F.col("total") > tile).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), similarity))
        like = stars.select(F.col("u").alias("node"), F.col("v").alias("hub"), F.lit(True).alias("_like"))
        members = members.join(like, ["node", "hub"], "left").withColumn("settled", (F.col("total") > tile) & (F.coalesce("_like", F.lit(False)) | (F.col("node") == F.col("hub"))))
        parts = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / tile).cast("int")
        cuts = members.where(F.col("total") > tile).groupBy("key").agg(parts(F.col("settled")).alias("_with"), parts(~F.col("settled")).alias("_rest"))
        members = members.join(cuts, "key", "left").withColumns({"with": F.coalesce("_with", F.lit(0)), "rest": F.coalesce("_rest", F.lit(1))})
    else:
        members = members.withColumns({"settled": F.lit(False), "with": F.lit(0), "rest": F.lit(1)})
    # the rest's texts meet each other by pairs of tiles, and those that are like the hub in tiles of negative number
    count = lambda c: F.slice(F.sequence(F.lit(0), F.col(c)), 1, F.col(c))  # noqa: E731  0 to c - 1
    own = lambda c: F.pmod(F.xxhash64("node"), F.greatest(F.col(c), F.lit(1))).cast("int")
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(count("rest"), lambda k: place(F.least(k, own("rest")), F.greatest(k, own("rest"))))
    across = F.transform(count("with"), lambda k: place(-1 - k, own("rest")))
    tiles = F.when(F.col("settled"), F.transform(count("rest"), lambda k: place(-1 - own("with"), k))).otherwise(F.concat(among, across))
    dealt = members.select("key", "node", F.when(F.col("settled"), F.col("hub")).otherwise(F.col("node")).alias("grp"), F.explode(tiles).alias("tile"))
    tiles = dealt.join(sets, "node").groupBy("key", "tile").agg(F.collect_list(F.struct("node", "grp", "print", "ids")).alias("held")).where(F.size("held") > 1).select("held")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0):
                flat = bucket.values
                node, grp = (flat.field(k).to_numpy() for k in (0, 1))
                prints = flat.field(2).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                at = np.concatenate([[0], np.cumsum(flat.field(3).value_lengths().to_numpy())]).astype(np.int64)
                order = np.argsort(node, kind="stable")  # the same links whatever order rows come in
                ids, at = slices(flat.field(3).flatten().to_numpy().view(np.uint64), at, order)
                pairs = [sorted((int(node[order[x]]), int(node[order[y]])), reverse=True) for x, y in links_within(ids, at, prints[order], grp[order], similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    found = tiles.mapInArrow(compare, "u long, v long")
    if stars is not None:
        found = found.unionByName(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    joined = components(found.distinct())
    return texts.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY, tile: int = TILE_SHINGLES) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest doc_id (a null one only if there is no
    other, then that of the smallest text number).  Columns stay; rows that repeat are copies."""
    id_ = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id")
    keyed, texts, again = distinct_texts(docs, width)
    groups = grouped(keyed, texts, width, similarity, tile)
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    rows = numbered(whole.select("row", id_, F.coalesce("row.text", F.lit("")).alias("text")), again).drop("text")
    ids = rows.groupBy("node").agg(F.min("_id").alias("_id"))
    best = ids.join(groups, "node").groupBy("root").agg(F.min(F.struct("_id", "node")).alias("best")).select("best.*")
    return rows.join(best, ["_id", "node"]).dropDuplicates(["_id", "node"]).select(*[F.col(f"row.`{n}`").alias(n) for n in docs.columns])
