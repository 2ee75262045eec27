"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import negatives, tables
from tessella.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def settings_of_text(spark):
    tables.prepared(spark)


def plain(rows, is_anchor, positives=5, count=5, low=80, high=100, scale=256):
    fine = [(i, label, v) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, _, v in fine]
    size = max(sorted(set(sizes)), key=sizes.count, default=0)
    first = {}
    for i, label, v in sorted((i, label, [math.floor(scale * x) for x in v]) for i, label, v in fine if len(v) == size):
        first.setdefault(i, (label, v))
    out = []
    for a, (label, v) in first.items():
        if not is_anchor(a):
            continue
        pairs = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in first.items() if i != a)
        for s, i, other in [p for p in pairs if p[2] == label][:positives]:
            found = [(t, j) for t, j, k in pairs if k != label and low * -s <= high * -t <= high * -s][:count]
            out += [(a, i, r, j, -s, -t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine_hard_negatives(df, F.col("vec_id") % 3 == 0, **more).collect()))


def test_any_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(i), int(r.integers(0, 3)), [float(x) for x in r.integers(-2, 9, 4) / 8]) for i in range(400)]
    rows += [(i, label, list(v)) for i, label, v in rows[:40]]  # repeated rows
    rows += [(7, 0, [1.0] * 4), (9, 2, [1.0] * 4), (9, 1, [0.5] * 4)]  # several rows of an id
    rows += [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (501, 1, None), (502, 1, [1.0, None, 1.0, 1.0]), (503, 1, [1.0, float("nan"), 0.0, 0.0]), (504, 1, [float("inf")] * 4), (505, 1, [1.0] * 3), (506, 1, [])]
    df = spark.createDataFrame([(*x, 1, 2, "m") for x in rows], "vec_id long, label int, embedding array<float>, q int, block int, `meta.url` string").repartition(5)
    want = plain(rows, lambda i: i % 3 == 0)
    assert mined(df) == want and len(want) > 1000
    assert mined(df, positives=2, negatives=3, low=50) == plain(rows, lambda i: i % 3 == 0, 2, 3, 50)
    monkeypatch.setattr(negatives, "ANCHORS", 16), monkeypatch.setattr(negatives, "ROWS", 32), monkeypatch.setattr(negatives, "HELD", 2)
    assert mined(df) == want  # many blocks
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0), monkeypatch.setattr(negatives, "CELL", 2000)
    assert mined(df) == want  # a grid of shuffled cells


def test_scores_beyond_exact_floats(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), int(i % 2), [float(x) for x in r.integers(1 << 18, 1 << 19, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == plain(rows, lambda i: i % 3 == 0)
    with pytest.raises(ValueError):
        mined(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (3, 2, [-1.0])], "vec_id long, label int, embedding array<double>")
    assert mined(df) == [] and mined(df.limit(0)) == []
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [1.0]), (4, 2, [0.79])], "vec_id long, label int, embedding array<double>")
    assert mined(one) == [(0, 1, 1, 2, 65536, 65536)]


def test_query(spark):
    ok, note = compare(QUERIES["op11_hard_negatives"], ORACLE["op11_hard_negatives"], spark, connect(SF), SF)
    assert ok, note
