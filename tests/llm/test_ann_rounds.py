"""Rounds of the neighbour graph: what they shuffle, and that small and large tables give one graph."""

import numpy as np
import pytest

pytest.importorskip("scriptorium.llm")
from scriptorium.llm import ann


def test_rounds_on_small_tables_shuffle_twice(spark, monkeypatch):
    x = np.random.default_rng(2).integers(-127, 128, (600, 8)).astype(np.int8)
    codes = spark.createDataFrame([(i * 7919, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, q8 binary")
    cut, shuffles = ann.cut, []

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut(df)

    monkeypatch.setattr(ann, "cut", counted)
    edges = lambda graph: {(r.id, n) for r in graph.collect() for n in np.frombuffer(r.nbrs, np.int64).tolist()}
    small = edges(ann.build_graph(codes, len(x), 8, rounds=1))
    assert sum(shuffles) <= 4  # two for the start, two for the round
    monkeypatch.setattr(ann, "SMALL_BYTES", 0)
    large = edges(ann.build_graph(codes, len(x), 8, rounds=1))
    assert len(small) == len(large) == ann.K * len(x) and len(small & large) >= 0.99 * len(small)
