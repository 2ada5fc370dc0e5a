"""Best items of each query, in groups of queries and items: against all pairs scored one by one."""

import math

import pytest
from pyspark.sql import functions as F

from kilngraph.operators import ranking
from kilngraph.plans import queries as Q

VECTORS = [[0.5, 0.25, -1.0], [0.5, 0.25, -1.0], [1.0, math.nan, 0.0], [math.inf, 0.0, 1.0], None, [1.0, None, 2.0], [1.0, 2.0], [], [1e200, 1e200, -1e200]]


def wanted(v, known, k):
    out = set()
    for q, a in v.items():
        scored = []
        for i, b in v.items():
            if known(q, i):
                continue
            s = None if a is None or b is None or len(a) != len(b) or None in a or None in b else sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
            s = round(s, 6) if s is not None and math.isfinite(s) else s
            scored.append((s is None, s is None or not math.isnan(s), 0.0 if s is None or math.isnan(s) else -s, i, str(s)))
        out |= {(q, x[3], x[4], r + 1) for r, x in enumerate(sorted(scored)[: k or None])}
    return out


@pytest.mark.parametrize("k", [3, 40, 0])
def test_kin_and_known_are_left_out_of_groups(spark, monkeypatch, k):
    monkeypatch.setattr(ranking, "QUERIES", 20)
    monkeypatch.setattr(ranking, "ITEMS", 30)
    monkeypatch.setattr(ranking, "CELLS", 64)
    v = {i: VECTORS[i // 2 % 9] if i % 3 == 0 else [i % 4 / 4, math.sin(i) * 1e-6, 1e-7 * (i % 5)] for i in range(70)}
    z = spark.createDataFrame(list(v.items()), "id long, z array<double>").withColumn("kin", F.when(F.col("id") < 60, F.col("id") % 7))
    known = spark.createDataFrame([(q, i) for q in range(70) for i in range(0, 70, q + 2)] * 2, "query long, item long")
    out = ranking.top_links(z.withColumnRenamed("id", "query"), z.withColumnRenamed("id", "item"), None, known, k, kin="kin").collect()
    left_out = lambda q, i: i % (q + 2) == 0 or (q < 60 and i < 60 and q % 7 == i % 7)
    got = {(r["query"], r["item"], str(r["score"]), r["rank"]) for r in out}
    numbers = lambda rows: {(q, i, s if s in ("None", "nan", "inf", "-inf") else float(s) + 0.0, r) for q, i, s, r in rows}
    assert numbers(got) == numbers(wanted(v, left_out, k)) and len(out) == len(got)


def test_bilinear_top_joins_no_pairs(spark, sf):
    plan = Q.QUERIES["bilinear_top"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
