"""Sparse encoders and encoders by kind of record, subgraphs of many focus nodes, scans by position."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from kilngraph.operators import encoders as E
from kilngraph.operators import subgraph as G
from kilngraph.sources import tables as S


def place(token, width):
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little") % width


def test_sparse_rows_are_the_dense_vector(spark):
    rows = [(1, "b|a|b|z"), (2, "A"), (3, None), (4, "  "), (5, "new|newer|b")]
    df = spark.createDataFrame(rows, "token long, l string").where("token < 5")
    for encoder in (E.MultiHot("l", counts=True), E.MultiHot("l"), E.OneHot("l"), E.MultiHot("l", counts=True, least=2)):
        vocab = E.vocabulary(df, encoder)
        both = spark.createDataFrame(rows, "token long, l string")  # the key may be named as the vocabulary's column
        found = E.sparse(both, "token", encoder, vocab)
        width = vocab.count() + 1
        dense = {r["token"]: r["features"] for r in E.dense(found, "token", width).collect()}
        want = {r["token"]: r["features"] for r in E.encode(both, encoder.fit(df)).collect()}
        assert {k: v for k, v in want.items() if any(v)} == dense and not any(want[3]) and not any(want[4])


def test_a_large_vocabulary_stays_a_table(spark, monkeypatch):
    df = spark.range(200_000).select("id", F.concat(F.lit("v"), "id").alias("c"))
    encoder = E.OneHot("c")
    with pytest.raises(ValueError):
        encoder.fit(df)
    with pytest.raises(ValueError):
        E.dense(df, "id", E.MOST_PLACES + 1)
    found = E.sparse(df, "id", encoder, E.vocabulary(df, encoder))
    assert found.agg(F.count("*"), F.count_distinct("place"), F.max("place"), F.sum("value")).first() == (200_000, 200_000, 199_999, 200_000)
    assert E.sparse(df, "id", encoder, E.vocabulary(df.limit(0), encoder)).agg(F.count("*"), F.max("place")).first() == (200_000, 0)


def test_node_encoders_against_hashlib(spark):
    fields = E.NODE_FIELDS["disease"]
    record = dict.fromkeys(fields) | {"DS_NAME": "Rare fever", "DS_DEFINITION": "A fever; rare.", "DS_PARENT_IDS": "P:1|P:2", "DS_SLIM_MAPPINGS": " "}
    df = spark.createDataFrame([tuple(record[f] for f in fields)], ", ".join(f"{f} string" for f in fields))
    encoder = E.node_encoder(" Diseases ")
    got = list(E.encode(df, encoder, "v").first()["v"])
    want = [0.0 if not (record[f] or "").strip() else 1.0 for f in fields]
    for field, width in (("DS_NAME", 64), ("DS_DEFINITION", 256)):
        words, counts = re.findall("[a-z0-9]+", record[field].lower()), [0.0] * width
        for gram in [*words, *("_".join(p) for p in zip(words, words[1:]))]:
            counts[place(gram, width)] += 1
        want += [c / math.sqrt(sum(x * x for x in counts)) for c in counts]
    for field, width in (("DS_OMIM_MESH_ID", 64), ("DS_PARENT_IDS", 128), ("DS_TREE_NUMBERS", 128), ("DS_PARENT_TREE_NUMBERS", 128), ("DS_SYNONYMS", 128), ("DS_SLIM_MAPPINGS", 64)):
        items = [x.strip().lower() for x in (record[field] or "").split("|") if x.strip()]
        want += [float(i in {place(x, width) for x in items}) for i in range(width)]
    assert got == pytest.approx(want) and len(encoder.names()) == len(want)
    assert len(E.node_encoder("gene", misc=8).names()) == 8 + 64 + 128 + 64 + 32 + 32 + 128 + 32 + 32 and len(E.node_encoder("chemicals").names()) == 7 + 64 + 256 + 64 + 128 + 128 + 128 + 128
    with pytest.raises(ValueError):
        E.node_encoder("pathway")


def test_metadata_records_and_their_encoder(spark):
    rows = [(1, ["red fox", None, " ", "hare"], [], "yes", "https://a.org/x"), (2, None, ["T1"], None, None)]
    df = spark.createDataFrame(rows, "k long, synonyms array<string>, xrefs array<string>, ctd string, ctd_url string")
    records = E.metadata_records(df)
    assert records.orderBy("k").first()["synonyms_text"] == "red fox hare"
    encoder = E.metadata_encoder(32, 32, 32, 16)
    a, b = (list(r["v"]) for r in E.encode(records, encoder, "v").orderBy("k").collect())
    assert len(a) == len(encoder.names()) == 7 + 5 * 32 + 1 + 23
    assert a[:7] == [1, 1, 0, 0, 0, 1, 1] and b[:7] == [0, 1, 0, 0, 0, 0, 0]
    grams = ["red", "fox", "hare", "red_fox", "fox_hare"]
    assert {i for i in range(32) if a[7 + i]} == {place(g, 32) for g in grams} and not any(a[39:71]) and b[39 + place("t1", 32)] == 1
    assert a[167] == 1 and a[168] == 1 and b[167] == 0 and not any(b[168:])


def test_focus_graph_against_loops(spark):
    sources = [(f, s) for f in range(5) for s in range(12) if (f * 7 + s * 5) % 4 < 2 and f != 3] * 2
    mids = [(f, m) for f in range(5) for m in range(9) if (f + m * 3) % 3]
    bridge = [(s, m, a) for s in range(12) for m in range(9) for a in "cab"[: (s * m) % 4]] + [(0, 1, None)]
    graph = G.focus_graph(
        spark.createDataFrame([(f,) for f in range(5)], "focus long"), spark.createDataFrame(sources, "focus long, src long"), spark.createDataFrame(mids, "focus long, mid long"),
        spark.createDataFrame(bridge, "src long, mid long, action string"), ("d", "c", "g"), ("cd", "dg", "cg"), (3, 2, 4),
    )
    edges, members = set(), set()
    for f in range(5):
        members.add((f, "d", f))
        found = [b for b in bridge if (f, b[0]) in set(sources) and (f, b[1]) in set(mids)]
        best = lambda rows, at, k: sorted({r[at] for r in rows}, key=lambda x: (-len({r[1 - at] for r in rows if r[at] == x}), -sum(r[at] == x for r in rows), x))[:k]
        top = best(found, 0, 3)
        held = [b for b in found if b[0] in top]
        reached = best(held, 1, 2)
        pairs = {}
        for s, m, a in held:
            if m in reached:
                pairs.setdefault((s, m), []).append(a)
        edges |= {(f, "cd", "c", s, "d", f, 1, "") for s in top} | {(f, "dg", "d", f, "g", m, 1, "") for m in reached}
        for (s, m), acts in sorted(pairs.items(), key=lambda p: (-len(p[1]), p[0]))[:4]:
            edges.add((f, "cg", "c", s, "g", m, len(acts), ", ".join(sorted({a for a in acts if a})[:2])))
        members |= {(f, "c", s) for s in top} | {(f, "g", m) for m in reached}
    rows = graph.edges.collect()
    assert {tuple(r) for r in rows} == edges and len(rows) == len(edges)
    assert {tuple(r) for r in graph.members.collect()} == members
    want = {(t, i): [f for f, a, b in members if (a, b) == (t, i)] for _, t, i in members}
    assert {tuple(r) for r in graph.nodes.collect()} == {(t, i, len(f), min(f)) for (t, i), f in want.items()} and any(len(f) > 1 for f in want.values())
    assert not [r for r in rows if r["focus"] == 3]


def test_focus_is_wanted_preferred_or_by_degree(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "k long, name string")
    links = [spark.createDataFrame([(i,) for i in ids], "k long") for ids in ([1, 1, 2, 3], [2, 2, 4, 4, 4, 4, 4])]
    pick = lambda **more: [r["k"] for r in G.pick_focus(nodes, "k", links, 2, **more).collect()]
    assert pick() == [2, 1] and pick(preferred=[5, 3, 0]) == [5, 3] and pick(preferred=[9, 3]) == [2, 1] and sorted(pick(wanted=[0, 4, 5])) == [0, 4, 5]
    with pytest.raises(ValueError, match="9"):
        pick(wanted=[1, 9])


def test_chunks_are_a_partition_without_an_exchange(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(1000).withColumn("x", F.col("id") * 2).repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    starts = S.file_starts(df).persist()
    assert [r["start"] for r in starts.orderBy("file").collect()][0] == 0 and starts.agg(F.sum("rows")).first()[0] == 1000
    seen, last = [], -1
    for offset in range(0, 1100, 150):
        one = S.chunk_by_position(df, starts, offset, 150, "at")
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        rows = one.orderBy("at").collect()
        assert [r["at"] for r in rows] == list(range(offset, min(offset + 150, 1000))) and all(r["x"] == 2 * r["id"] for r in rows)
        seen += [r["id"] for r in rows]
    assert sorted(seen) == list(range(1000)) and S.chunk_by_position(df, starts, 0, 0).columns == ["id", "x"]
    placed = S.positions(df).orderBy("position").collect()
    assert [r["id"] for r in placed] == seen
    with pytest.raises(ValueError):
        S.chunk_by_position(df, starts, -1, 5)
    starts.unpersist()


def test_a_chunk_opens_the_files_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(10).write.parquet(path)
    df = spark.read.parquet(path)
    one = S.chunk_by_position(df, S.file_starts(df), 0, 120)
    assert one.count() == 120 and len(one.select(F.input_file_name()).distinct().collect()) == 2
    plan = one._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 2


def test_positions_gather_no_file(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark takes the counted files for large
    try:
        placed = S.positions(spark.read.parquet(str(tmp_path / "t")))
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert sorted(r["position"] for r in placed.collect()) == list(range(100))
