"""Batches of links, prepared splits, and draws by weight."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilngraph.operators import batches as B
from kilngraph.operators import splits
from kilngraph.operators.graph import KnowledgeGraph

CD, GENE = ("chemical", "treats", "disease"), ("gene", "marks", "disease")


@pytest.fixture(scope="module")
def graph(spark):
    """Disease 0 is a hub of both relations; gene 90 marks nothing."""
    cd = [(c, 0) for c in range(60)] + [(c, 1 + (c * k) % 19) for c in range(60) for k in (1, 2, 5)]
    marks = [(g, 0) for g in range(90)] + [(g, 1 + g % 19) for g in range(90)]
    edges = lambda rows: spark.createDataFrame(sorted(set(rows)), "src long, dst long").repartition(3)
    return KnowledgeGraph({"chemical": spark.range(60), "disease": spark.range(20), "gene": spark.range(91)}, {CD: edges(cd), GENE: edges(marks)}).with_reverses()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def check(found: B.Batches, asked: set, edges: dict, size: int, fanouts: list[int]):
    """Every link once, dense local ids, real edges only, fanouts kept and used up, each node expanded when it is new."""
    links = rows(found.links, "batch", "src", "dst", "src_local", "dst_local")
    assert sorted((s, t) for _, s, t, _, _ in links) == sorted(asked)
    sizes = Counter(b for b, *_ in links)
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == size for b, n in sizes.items() if b < len(sizes) - 1)
    nodes = {}
    for b, kind, local, i in rows(found.nodes, "batch", "type", "local", "id"):
        nodes.setdefault((b, kind), {})[i] = local
    for own in nodes.values():
        assert [own[i] for i in sorted(own)] == list(range(len(own)))
    for b, s, t, a, z in links:
        assert (nodes[b, "chemical"][s], nodes[b, "disease"][t]) == (a, z)
    got = rows(found.edges, "batch", "hop", "relation", "src_type", "src", "src_local", "dst_type", "dst", "dst_local")
    assert len(got) == len({x[:5] + x[6:8] for x in got})
    new = {(b, k, i) for b, s, t, _, _ in links for k, i in (("chemical", s), ("disease", t))}
    seen = set(new)
    for hop, most in enumerate(fanouts, 1):
        taken = Counter((b, r, k, t) for b, h, r, _, _, _, k, t, _ in got if h == hop)
        wanted = {(b, "__".join(r), k, i): min(most, n) for b, k, i in new for r in edges if r[2] == k if (n := sum(t == i for _, t in edges[r]))}
        assert taken == wanted
        reached = {(b, k, s) for b, h, _, k, s, *_ in got if h == hop}
        new = reached - seen
        seen |= new
    assert {(b, k, i) for (b, k), own in nodes.items() for i in own} == seen
    for b, _, r, a, s, sl, z, t, tl in got:
        assert (s, t) in edges[tuple(r.split("__"))]
        assert (nodes[b, a][s], nodes[b, z][t]) == (sl, tl)


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="module")
def artifact(tmp_path_factory):
    return str(tmp_path_factory.mktemp("artifact") / "split")


@pytest.fixture(scope="module")
def prepared(graph, artifact):
    return B.prepare(graph, CD, 0.2, 0.2, seed=5, strategy=" Random ", cover=False, size=16, fanouts=[4, 3], save_path=artifact)


def parts_of(prepared):
    return {p: {(s, t) for s, t, x in rows(prepared.split, "src", "dst", "split") if x == p} for p in ("train", "val", "test")}


@pytest.mark.parametrize("phase", ["train", "val", "test"])
def test_phases_see_train_only(prepared, phase):
    part = parts_of(prepared)
    edges = {r: set(rows(df, "src", "dst")) for r, df in prepared.graph.relations.items()}
    assert edges[CD] == part["train"] == {(s, t) for t, s in edges["disease", "rev_treats", "chemical"]}
    check(prepared.batches[phase], part[phase], edges, 16, [4, 3])


def test_prepared_parts(spark, graph, prepared, artifact):
    part, everything = parts_of(prepared), set(rows(graph.relations[CD], "src", "dst"))
    assert set().union(*part.values()) == everything
    known = Counter(r["phase"] for r in prepared.known.collect())
    assert known == {"train": len(part["train"]), "val": len(part["train"]) + len(part["val"]), "test": len(everything)}
    assert dict(rows(prepared.degrees["dst"], "id", "degree")) == Counter(t for _, t in part["train"])
    again = B.prepare(graph, CD, seed=99, size=16, fanouts=[4], load_path=artifact)  # the artifact's seed counts
    assert again.metadata["strategy"] == "random"
    assert parts_of(again) == part
    assert Counter(again.batches["train"].links.select("batch", "src", "dst").collect()) == Counter(prepared.batches["train"].links.select("batch", "src", "dst").collect())
    with pytest.raises(ValueError, match="does not fit"):
        B.prepare(KnowledgeGraph(graph.nodes, {**graph.relations, CD: graph.relations[CD].where("src > 3")}), CD, load_path=artifact)
    with pytest.raises(ValueError, match="stratified or random"):
        B.prepare(graph, CD, strategy="other")


def test_sampled_places_are_even(spark, graph):
    """A hub's edges are taken about equally often by many batches."""
    edges = B.adjacency({GENE: graph.relations[GENE]})
    frontier = spark.range(600).select(F.col("id").alias("batch"), F.lit("disease").alias("type"), F.lit(0).cast("long").alias("id"))
    found = B.sampled(edges, frontier, 9, 1).groupBy("src").agg(F.count("*").alias("n")).collect()
    counts = np.array([r["n"] for r in found])
    assert len(counts) == 90
    assert ((counts - 60) ** 2 / 60).sum() < 130  # chi-square with 89 degrees, 0.3 %


def test_batches_without_hops_or_links(spark, graph):
    edges = B.adjacency({GENE: graph.relations[GENE]})
    alone = B.link_batches(graph.relations[CD], CD, edges, 50, [], shuffle=False)
    assert alone.edges.count() == 0
    assert [(b, s, t) for b, s, t in sorted(rows(alone.links, "batch", "src", "dst"))] == [(k // 50, *e) for k, e in enumerate(sorted(rows(graph.relations[CD], "src", "dst")))]
    assert B.link_batches(graph.relations[CD].limit(0), CD, edges).nodes.count() == 0
    with pytest.raises(ValueError, match="fanout"):
        B.link_batches(graph.relations[CD], CD, edges, 5, [0])


@pytest.mark.parametrize("n", [1, 7, 49, 103])
def test_every_draw_gets_one_id(spark, n):
    draws = spark.createDataFrame([(k, u) for k, u in enumerate([0.0, 0.5, 1 - 2.0**-53, 1 - 2.0**-40, 2.0**-53, 1 / 3])], "k long, u double")
    got = splits.weighted_draws(spark.range(n).withColumn("w", F.lit(0.1)), "id", "w", draws)
    assert sorted(rows(got, "k", "id")) == [(k, min(int(u * n), n - 1)) for k, u in enumerate([0.0, 0.5, 1 - 2.0**-53, 1 - 2.0**-40, 2.0**-53, 1 / 3])]
    assert got.columns == ["k", "u", "id"]


def test_draws_follow_the_weights(spark):
    weights = spark.createDataFrame([(0, 0.0), (1, 1e-3), (2, 5.0), (3, 1.0), (4, 0.25), (5, 3.75), *((k, 0.01) for k in range(6, 106))], "id long, w double")
    n = 40_000
    got = Counter(r["id"] for r in splits.weighted_draws(weights, "id", "w", spark.range(n).select(F.col("id").alias("k"), F.rand(3).alias("u"))).collect())
    assert sum(got.values()) == n
    assert 0 not in got
    wanted = {r["id"]: r["w"] for r in weights.collect() if r["w"] > 0.005}
    total = sum(r["w"] for r in weights.collect())
    chi = sum((got[k] - n * w / total) ** 2 / (n * w / total) for k, w in wanted.items())
    assert chi < 150  # 104 degrees, 0.3 %
    with pytest.raises(ValueError, match="positive"):
        splits.weighted_draws(weights.where("w = 0"), "id", "w", spark.range(1).withColumn("u", F.lit(0.5)))


def test_hard_and_uniform_counts(spark, graph):
    links = graph.relations[CD].limit(30)
    got = splits.hard_negatives(links, graph.relations[CD], 60, 20, k=5, ratio=0.5)
    found = rows(got, "src", "dst", "k", "neg_src", "neg_dst")
    assert Counter((s, t, k) for s, t, k, _, _ in found) == {(s, t, k): 1 for s, t in rows(links, "src", "dst") for k in range(5)}
    assert not {(a, b) for *_, a, b in found} & set(rows(graph.relations[CD], "src", "dst"))


def test_batches_move_codes_and_write_no_checkpoint(spark, graph, monkeypatch, tmp_path):
    """Rows that are shuffled name relations and kinds by numbers, and the rows of many tasks are those of few."""
    links = graph.relations[CD]
    few = B.link_batches(links, CD, B.adjacency(graph.relations), 16, [4, 3])
    monkeypatch.setattr(B, "TASK_LINKS", 20)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    many = B.link_batches(links, CD, B.adjacency(graph.relations), 16, [4, 3])
    for name in ("links", "nodes", "edges"):
        df = getattr(many, name)
        assert df.rdd.getNumPartitions() == -(-links.count() // 20) > 4
        assert Counter(df.collect()) == Counter(getattr(few, name).collect())
        assert all("type" not in line and "relation" not in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    spark.sparkContext.setCheckpointDir(before)


def test_missing_ends_and_batches_over_many_rows(spark):
    """A null end is a node, first among its kind, but its link is left out; a batch may go on over Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    links = spark.createDataFrame([(None, 5), (7, 5), (3, 6), (9, None), (2, 4), (1, 4), (8, 4)], "src long, dst long")
    found = B.link_batches(links, CD, B.adjacency({GENE: spark.createDataFrame([(70, 5), (60, 5), (None, 4)], "src long, dst long")}), 5, [2], shuffle=False)
    nodes = Counter(rows(found.nodes, "batch", "type", "local", "id"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [(None, 5), (1, 4), (2, 4), (3, 6), (7, 5), (8, 4), (9, None)]
    own = {(b, k): sorted({p[e] for p in order[5 * b : 5 * b + 5]}, key=lambda i: (i is not None, i)) for b in (0, 1) for e, k in ((0, "chemical"), (1, "disease"))}
    own |= {(0, "gene"): [None, 60, 70], (1, "gene"): [None]}
    assert nodes == Counter((b, k, at, i) for (b, k), ids in own.items() for at, i in enumerate(ids))
    want = [(k // 5, a, z, own[k // 5, "chemical"].index(a), own[k // 5, "disease"].index(z)) for k, (a, z) in enumerate(order) if a and z]
    assert sorted(rows(found.links, "batch", "src", "dst", "src_local", "dst_local")) == sorted(want)
    assert sorted(rows(found.edges, "batch", "src", "src_local", "dst", "dst_local")) == [(0, 60, 1, 5, 1), (0, 70, 2, 5, 1)]
