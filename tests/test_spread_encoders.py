"""Encoded rows are dealt to tasks by their number, whatever the file's; hashed counts token by token."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilngraph.operators import encoders as E
from kilngraph.plans import queries as Q


def test_one_file_is_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(E, "TASK_ROWS", 40)
    got = Q.QUERIES["encode_node_record"](spark, sf)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert got.rdd.getNumPartitions() == -(-n // 40) and got.count() == n


@pytest.mark.parametrize(("binary", "unit"), [(False, False), (True, False), (False, True)])
def test_hashed_counts_token_by_token(spark, binary, unit):
    rows = [["a", "b", "a"], [], ["é", "a b", ""], ["b"] * 9]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, t array<string>").coalesce(1)
    got = dict(df.select("id", E.hashed_counts(F.col("t"), 5, binary, unit)).collect())
    for i, r in enumerate(rows):
        v = np.zeros(5)
        for t in r:
            v[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % 5] += 1
        v = np.minimum(v, 1) if binary else v
        assert got[i] == list(v / np.sqrt(v @ v) if unit and v.any() else v)
