"""Each registered operator against brute force, over a real table with the edge cases added to it."""

import pytest
from pyspark.sql import functions as F

from kilngraph.llm import decontam, license_scan, media_ogg, mixing, quality, simhash, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import CLASHING, EDGE


@pytest.fixture(scope="module")
def docs(spark, sf, edge):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return own.limit(150).selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars").unionByName(edge).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


def same(df, wanted, columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted(wanted, key=key)


SPANS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_CONTEXTS, 1])
def test_op1_removes_repeated_bytes(docs, rows, hot):
    same(suffix_dedup.dedup_report(docs, hot_contexts=hot), brute.repeats(rows), SPANS)


def test_op1_other_lengths(edge):
    small = [(r[0], r[1]) for r in EDGE if len(r[1] or "") < 5000]
    df = edge.where("length(text) < 5000 or text is null")
    same(suffix_dedup.dedup_report(df, length=60, gram=16), brute.repeats(small, 60), SPANS)


def test_op1_cleaned_texts(spark):
    text = "é" + "ab" * 150
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text, "x"), (2, "z" + text, "y"), (3, None, "w"), (4, "kept", None)], "doc_id long, text string, row string"))
    assert {r["doc_id"]: (r["text"], r["row"]) for r in out.collect()} == {1: ("", "x"), 2: ("z", "y"), 3: (None, "w"), 4: ("kept", None)}


def test_op2_base_places(docs, rows):
    extra = [(2000, "Under the MIT license; under-the-mit license! Apache License, Version 2.0"), (2001, "CC-BY-NC cc by nc cc by"), (2002, "under the mit licenses")]
    df = docs.sparkSession.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    wanted = [(i, *brute.base_places(t, license_scan.BASE)) for i, t in [*rows, *extra]]
    same(license_scan.license_scan(df), wanted, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])


def test_op2_labels_of_changed_notices(spark):
    changed = "Permission is hereby granted, at no cost, to any person obtaining a copy of this software and its associated documentation files, the software, to deal in the software without restriction"
    out = license_scan.license_scan(spark.createDataFrame([(1, changed), (2, "all rights reserved"), (3, "nothing here")], "doc_id long, text string")).collect()
    found = {r["doc_id"]: r for r in out}
    assert found[1]["labels"] == "mit" and found[1]["base_labels"] == "" and 0.5 < found[1]["score"] <= 1
    assert found[2]["labels"] == "all-rights-reserved" and found[3]["labels"] == "" and found[3]["score"] == 0


def test_op2_spans_are_verified(spark):
    """Three-word grams of a notice in another order, or torn apart, are no notice."""
    words = next(t for t, x in license_scan.TEMPLATES.items() if x == "bsd-3").split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    backwards, torn, slip = " . ".join(reversed(grams)), " filler words between here and there ".join(grams), " ".join(words[:9] + ["indeed"] + words[9:])
    out = license_scan.license_scan(spark.createDataFrame([(1, backwards), (2, torn), (3, slip), (4, " ".join(words))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in out} == {1: "", 2: "", 3: "bsd-3", 4: "bsd-3"} and next(r["score"] for r in out if r["doc_id"] == 4) == 1


def test_op3_fingerprints_and_components(docs, rows):
    same(simhash.near_duplicates(docs), brute.simhash(rows), ["doc_id", "fingerprint", "component_id"])


def test_op3_small_buckets_lose_no_link(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(64) for _ in range(4)]
    prints = list({b ^ (1 << i) ^ (1 << j) for b in base for i in range(12) for j in range(12)})
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    found = simhash.components(simhash.links(df, 2, bucket=8))
    roots = {r["node"]: r["root"] for r in found.collect()}
    groups = {}
    for k, r in enumerate(brute.components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])):
        groups.setdefault(r, []).append(signed[k][0])
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_op4_windows(spark, sf, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, "one two"), (901, None), (902, "..."), (None, "no id here"), (900, brute.BLANK.pattern), (903, "word1 filler1 word2 filler2 word3 filler3 word4 filler4 word5 filler5 word6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute.contamination(rows, items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontam.contamination(docs, bench), wanted, columns)
    same(decontam.contamination(docs, bench, block_bytes=2000), wanted, columns)
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {w[0] for w in wanted if not w[5]} | ({None} & kept)


def test_op4_locations(spark):
    item = [f"b{k}" for k in range(30)]
    docs = [(1, " ".join(["x", "y", *item[3:20], "z", *item[3:13]])), (2, "nothing"), (None, " ".join(item)), (3, None)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "z b3"), (9, None)], "item_id long, text string")
    out = decontam.match_locations(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "7", 2, 3, 17), (1, "7", 20, 3, 10), (1, "8", 19, 0, 2), (None, "7", 0, 0, 30)], key=str)


def test_op6_packets_over_several_pages_and_damage(spark):
    payload = bytes(range(256)) * 45
    for segments in (1, 2, 4, 5, 255):
        media = media_ogg.write_ogg(payload, segments=segments)
        flags, at = [], 0
        while at < len(media):
            head = media_ogg.HEAD.unpack_from(media, at)
            flags.append(head[2])
            at += media_ogg.HEAD.size + head[7] + sum(media[at + media_ogg.HEAD.size : at + media_ogg.HEAD.size + head[7]])
        assert any(f & media_ogg.CONTINUED for f in flags) == (segments != 255)  # three values a packet
        got, about = media_ogg.read_ogg(media)
        assert got == payload and about["pages"] == len(flags) and about["packets"] == 20 and about["last_ms"] == 720
        with pytest.raises(ValueError, match="damaged"):
            media_ogg.read_ogg(media[: len(media) // 2] + bytes([media[len(media) // 2] ^ 1]) + media[len(media) // 2 + 1 :])
    pages, at = [], 0
    while at < len(media := media_ogg.write_ogg(payload, segments=4)):
        n = media[at + 26]
        size = 27 + n + sum(media[at + 27 : at + 27 + n])
        pages.append(media[at : at + size])
        at += size
    for lost in (1, 4, len(pages) - 1):
        with pytest.raises(ValueError):
            media_ogg.read_ogg(b"".join(p for k, p in enumerate(pages) if k != lost))
    df = spark.createDataFrame([(1, "t" * 10_000)], "doc_id long, text string")
    assert media_ogg.ogg_features(df, segments=4).first()["payload_sha256"] == media_ogg.ogg_features(df).first()["payload_sha256"]


def test_op6_round_trip(docs, rows):
    import hashlib
    import zlib

    wanted = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        wanted.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    same(media_ogg.ogg_features(docs), wanted, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])


def test_op7_targets_are_met(docs, rows):
    listed = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sizes = {}
    for _, t, s in listed:
        sizes[s] = sizes.get(s, 0) + len(brute.BLANK.findall(t or ""))
    target = brute.targets(sizes)
    out = mixing.mix_sources(docs).collect()
    same(mixing.mix_sources(docs), [(i, len(brute.BLANK.findall(t or "")), sizes[s], pytest.approx(target[s])) for i, t, s in listed], ["doc_id", "size", "source_size", "target"])
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    for s, t in target.items():
        assert taken[t] == pytest.approx(t, abs=1)
    assert sorted(map(tuple, out), key=key) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=key)


def test_op7_overlapping_sources(spark):
    rows = [(1, "w " * 100, ["a"]), (2, "w " * 50, ["a", "b"]), (3, "w " * 10, ["b"]), (4, "w", []), (5, "w", None), (6, "", ["b", "a", "a"])]
    out = {r["doc_id"]: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), "sources").collect()}
    assert len(out) == 6 and out[4]["taken"] == 0 and out[5]["taken"] == 0
    assert sum(r["taken"] for r in out.values()) <= 1.5 * (150 + 60) + 1


def test_op5_without_labels_of_both_classes_all_stay(spark, edge):
    for labels in ([], [(1, 1, 0), (4, 1, 0)], [(1, 0, 1), (4, 0, 1)]):
        out = quality.quality_scores(edge, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == len(EDGE) and all(r["keep"] for r in out)
        assert quality.keep_good(edge, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(EDGE)


def test_op5_sites_against_brute_force(spark):
    import math
    import random

    random.seed(2)
    rows = [(h, p, random.random() * (0.9 if h == "bad" else 0.3 if p == "x" else 0.1)) for h in ("a", "b", None, "bad") for p in ("x", "y", None) for _ in range(random.randrange(1, 9))]
    sites, prior = quality.site_sums(spark.createDataFrame(rows, "host string, path string, bad double"))
    n, rate = len(rows), sum(r[2] for r in rows) / len(rows)
    of = lambda *k: [r[2] for r in rows if r[: len(k)] == k]
    hosts, paths = {r[0] for r in rows}, {r[:2] for r in rows}
    mean = lambda x: sum(x) / len(x)
    variance = sum(sum((v - mean(of(*p))) ** 2 for v in of(*p)) for p in paths) / (n - len(paths))
    between = [(sum(len(of(h)) * (mean(of(h)) - rate) ** 2 for h in hosts) - (len(hosts) - 1) * variance) / n, (sum(len(of(*p)) * (mean(of(*p)) - mean(of(p[0]))) ** 2 for p in paths) - (len(paths) - len(hosts)) * variance) / n]
    strength = [min(max(variance / b, 1.0), 1e6) if b > 0 else 1e6 for b in between]
    assert (prior.rate, prior.host, prior.path) == pytest.approx((rate, *strength))
    from pyspark.sql import functions as F

    got = {(r["host"], r["path"]): r["shift"] for r in sites.select("host", "path", quality.site_shift(prior, F.lit(0.05)).alias("shift")).collect()}
    assert set(got) == paths
    for p in paths:
        host = (strength[0] * rate + sum(of(p[0])) - 0.05) / (strength[0] + len(of(p[0])) - 1)
        path = (strength[1] * host + sum(of(*p)) - 0.05) / (strength[1] + len(of(*p)) - 1)
        path = min(max(path, 1e-4), 1 - 1e-4)
        assert got[p] == pytest.approx(min(max(math.log(path / (1 - path)) - math.log(rate / (1 - rate)), -2), 2))


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.quality_scores(docs, labels.where("doc_id % 2 = 0"))
    held = scores.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad = [r for r in held if r["toxic"] or not r["quality"]]
    good = [r for r in held if not r["toxic"] and r["quality"]]
    assert sum(not r["keep"] for r in bad) >= 0.87 * len(bad)
    assert sum(r["keep"] for r in good) >= 0.97 * len(good)


def test_near_copies_by_similarity(spark):
    import random

    random.seed(5)
    base = [[f"w{random.randrange(5000)}" for _ in range(300)] for _ in range(6)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for changes in (1, 3, 40):
            c = list(b)
            for k in random.sample(range(300), changes):
                c[k] = f"new{random.randrange(10**6)}"
            texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if brute.jaccard(texts[i], texts[j]) >= 0.8]
    roots = brute.components(len(texts), links)
    assert kept == sorted(min(k for k, r in enumerate(roots) if r == g) for g in set(roots))


@pytest.mark.parametrize("most", [simhash.MOST_CLASHES, 0])
def test_near_copies_where_hashes_of_texts_meet(spark, monkeypatch, most):
    """Four different numbers for fifteen texts: each text is still a node of its own, and none goes for another's hash."""
    monkeypatch.setattr(simhash, "first_number", lambda text: F.pmod(F.xxhash64(text), F.lit(4)))
    monkeypatch.setattr(simhash, "MOST_CLASHES", most)
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "end"]) for w in words] + [" ".join(words[0]), "", None]
    df = spark.createDataFrame([(k, t, f"own {k}") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["node"]) for r in kept.collect()) == [*((k, f"own {k}") for k in range(6)), (13, "own 13")]


@pytest.mark.parametrize("tile", [simhash.TILE_SHINGLES, 20_000])
def test_near_copies_between_large_groups(spark, tile):
    """Groups of a hundred and twenty variants each, in pairs of groups that only one pair of texts links; also in many tiles."""
    import random

    random.seed(11)
    texts = []
    for _ in range(6):
        first = [f"w{random.randrange(50000)}" for _ in range(900)]
        second, places = list(first), [20 + 40 * k for k in range(21)]
        for k in places:
            second[k] = f"o{random.randrange(10**6)}"
        for base, other in ((first, second), (second, first)):
            for v in range(120):
                c = list(base)
                k = places[v % 20 + (base is second)]
                c[k] = other[k] if v == 60 else f"v{random.randrange(10**6)}"
                texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["node"]: r["root"] for r in simhash.near_copy_groups(df, tile=tile).collect()}
    nodes = [r["node"] for r in df.selectExpr("xxhash64(text) node").collect()]
    sets = [set(zip(*[w[k:] for k in range(5)])) for w in (t.split() for t in texts)]
    links = []
    for i in range(len(texts)):
        for j in range(i // 240 * 240, i):
            if (c := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                links.append((i, j))
    roots = brute.components(len(texts), links)
    parts = lambda labels: {tuple(i for i, x in enumerate(labels) if x == g) for g in set(labels)}
    assert parts([got[n] for n in nodes]) == parts(roots)


OPERATORS = {
    "op1": lambda d, s: suffix_dedup.dedup_report(d), "op1 texts": lambda d, s: suffix_dedup.remove_repeats(d), "op2": lambda d, s: license_scan.license_scan(d),
    "op3": lambda d, s: simhash.near_duplicates(d), "near copies": lambda d, s: simhash.keep_one(d),
    "op4": lambda d, s: decontam.contamination(d, s.createDataFrame([(1, "one two")], "item_id long, text string")),
    "op4 docs": lambda d, s: decontam.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    "op5": lambda d, s: quality.keep_good(d, s.createDataFrame([(1, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")),
    "op5 without labels": lambda d, s: quality.quality_scores(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    "op6": lambda d, s: media_ogg.ogg_features(d), "op6 column": lambda d, s: media_ogg.media_column(d), "op7": lambda d, s: mixing.mix_sources(d),
}
FEWER = {"near copies", "op4 docs", "op5", "op1 texts", "op6 column"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_names(spark, empty, clashing, name):
    assert OPERATORS[name](empty, spark).count() == 0
    out = OPERATORS[name](clashing, spark)
    if name in FEWER:
        kept = set(out.columns)
        assert kept == set(clashing.columns)
        assert all(r[f] == f"own {f}" for r in out.limit(3).collect() for f in CLASHING if f != "media")
    else:
        assert out.count() == len(EDGE)


def test_op1_text_of_a_short_period(spark):
    unit, other = "Is onhe. ", "Was it so? It was not. "
    rows = [(1, unit * 90), (2, "before " + unit * 60 + "after"), (3, unit * 21), (4, unit * 22 + "x"), (5, other * 9), (6, other * 8 + unit * 23), (7, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(suffix_dedup.dedup_report(df), brute.repeats(rows), SPANS)
    same(suffix_dedup.dedup_report(df, hot_contexts=1), brute.repeats(rows), SPANS)
    same(suffix_dedup.dedup_report(df, length=60, gram=16), brute.repeats(rows, 60), SPANS)
