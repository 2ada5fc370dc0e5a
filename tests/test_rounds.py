"""Rounds of message passing against numpy, with hubs in pieces, and what moves in them."""

import numpy as np
import pytest

from kilngraph.operators import rounds as R

EDGES = [(s, d, ((s + d) % 5 + 1) / 7) for s in range(40) for d in range(30) if s == 3 or d == 4 or (s * d) % 11 == 1]


def frames(spark):
    h = np.random.default_rng(5).normal(size=(45, 3))
    return h, spark.createDataFrame([(i, [float(x) for x in h[i]]) for i in range(45)], "id long, z array<double>"), spark.createDataFrame([*EDGES, (None, 1, 1.0), (1, None, 1.0)], "src long, dst long, w double")


@pytest.mark.parametrize("hub_edges", [10**6, 7])
def test_three_rounds_equal_numpy(spark, hub_edges):
    h, df, edges = frames(spark)
    a = np.zeros((45, 45))
    for s, d, w in EDGES:
        a[d, s] += w
    states = [h]
    for _ in range(3):
        states.append(a @ states[-1])
    adjacency = R.laid(edges, hub_edges=hub_edges)
    assert adjacency.hubs.count() == (0 if hub_edges > 100 else len([s for s in range(40) if sum(e[0] == s for e in EDGES) > 7]))
    got = R.light_layers(df, adjacency, 3)
    rows = {r["id"]: r["z"] for r in got.z.collect()}
    assert sorted(rows) == list(range(45)) and np.allclose([rows[i] for i in range(45)], np.mean(states, axis=0))
    one = {r["id"]: r["z"] for r in R.sums(df, adjacency).collect()}
    assert set(one) == {d for _, d, _ in EDGES} and np.allclose([one[i] for i in sorted(one)], states[1][sorted(one)])
    got.free()
    adjacency.free()


def test_repeated_edges_null_vectors_and_nothing(spark):
    h = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "id long, z array<double>")
    edges = spark.createDataFrame([(0, 5, 1.0), (0, 5, 1.0), (1, 5, 9.0), (8, 6, 1.0)], "src long, dst long, w double")
    assert [tuple(r) for r in R.sums(h, R.laid(edges)).collect()] == [(5, [2.0, 4.0])]
    assert R.sums(h, R.laid(edges.limit(0))).count() == 0 and R.sums(h.limit(0), R.laid(edges)).count() == 0


def test_rounds_do_not_move_the_edges(spark):
    _, df, edges = frames(spark)
    adjacency = R.laid(edges, parts=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = R.sums(df, adjacency)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    side = []
    for line in lines[join + 1 :]:  # the first child, down to the kept edges
        side.append(line)
        if "InMemoryTableScan" in line:
            break
    assert "dst" in side[-1] and depth(side[-1]) > depth(lines[join]) and not [line for line in side if "Exchange" in line]
    adjacency.free()
