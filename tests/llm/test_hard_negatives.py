"""Hard negatives against a plain search of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"
TOP = (1 << 62) - 1


def plain(rows, every=100, k=5, low=80):
    """rows: (id, vector, label), labels as they count."""
    good = [(i, [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) if abs(x) < 1e300 else (1 << 62 if x > 0 else -(1 << 62)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, y) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w)))), j, z) for m, (j, w, z) in enumerate(good) if m != n and len(w) == len(v)]
        first = lambda x: (-x[0], x[1] is not None, x[1] or 0)
        for ps, j, _ in sorted([x for x in scored if x[2] == y], key=first)[:k]:
            fits = sorted([x for x in scored if x[2] != y and low * ps <= 100 * x[0] <= 100 * ps], key=first)[:k]
            out += [(i, j, r + 1, x[1], ps, x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def mined(df, every=100, **options):
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_query_equals_plain_search(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in queries.op11_hard_negatives(spark, SF).collect())
    assert got and got == plain(rows)


@pytest.mark.parametrize("scale", [0.01, 1e4, 1e8])
def test_groups_of_near_vectors_of_all_sizes(spark, scale, monkeypatch):
    """Wide scores take several digits and exact products, small ones make ties; small blocks and tiles."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "HELD", 30)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(k, [float(x) for x in scale * (base[k % 6] + 0.1 * rng.normal(size=12))], int(rng.integers(3))) for k in range(240)]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(5), 10)
    assert len(got) > 100 and got == plain(rows, 10)


def test_a_hot_vector_and_options(spark):
    rng = np.random.default_rng(6)
    hot = [0.25] * 8
    rows = [(k, hot if k % 3 == 0 else [float(x) for x in rng.normal(size=8)], k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert mined(df, 50) == plain(rows, 50)
    assert mined(df, 50, positives=2, negatives=3, low=50) == [x for x in plain(rows, 50, 5, 50) if x[2] <= 3 and x[1] in {y[1] for y in plain(rows, 50, 2, 50) if y[0] == x[0]}]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [0.9, 0.1], None), (7, [0.9, 0.1], 2), (7, [0.9, 0.1], 2), (8, [0.0, 0.0], 2), (9, [1.0], 2), (10, [], 1), (11, [], 2), (12, [], 1), (20, [-1.0, 0.0], 3), (21, [1.0, 0.0], 3), (30, [1e200, 1.0], 4), (31, [1e200, 1.0], 4), (32, [1e200, 0.5], 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", ID string, score int")
    got = mined(df, 10)
    assert got == plain(rows, 10) and {x[0] for x in got} == {0, 10, 30}
    assert mined(df.limit(0), 10) == [] and mined(df.where("vec_id = 1"), 10) == [] and mined(df.where("vec_id = 0").limit(1), 10) == []
    nameless = spark.createDataFrame([(None, [1.0], 1), (0, [1.0], 1), (None, [1.0], 2)], SCHEMA)
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in hard_negatives.mine(nameless, F.col("vec_id") == 0).collect()] == [(0, None, None)]
