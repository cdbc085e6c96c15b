"""Hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, d string"
MARK = lambda i: i % 5 == 0


def brute(rows, positives=5, count=3):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if max(map(abs, whole), default=0) < 2**31 and sum(x * x for x in whole) < 2**62:
            seen[i, label, whole] = None
    out = []
    for i, label, v in seen:
        if i % 5:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        same = sorted((-score(w), j) for j, m, w in seen if m == label and j != i and len(w) == len(v))[:positives]
        other = sorted((-score(w), j) for j, m, w in seen if m != label and len(w) == len(v))
        for p, j in same:
            fit = [(-s, n) for s, n in other if 50 * -p <= 100 * -s <= 95 * -p][:count]
            out += [(i, j, k, n, -p, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(table, MARK, **more).collect()))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 12))
    rows = [(i, (middles[i % 6] + 0.7 * rng.normal(size=12)).tolist(), i % 4) for i in range(150)]
    same = rows[3][1]
    rows += [(200 + i, same, i % 2) for i in range(40)]  # copies, with ties broken by id
    rows += [rows[5], rows[5], (10, rows[11][1], 2), (10, rows[12][1], 0)]  # repeated rows, and one id with other vectors
    rows += [(300, None, 1), (305, same, None), (None, same, 1), (310, [None] + same[1:], 1), (315, [float("nan")] + same[1:], 1), (320, [float("inf")] + same[1:], 1), (325, [0.0] * 12, 1), (330, [], 1), (331, [], 2), (335, [1.0, 2.0], 1), (336, [1.0, 2.1], 1), (337, [1.0, 1.0], 2)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block_rows,most_fit", [(4, 20_000), (8192, 30), (16, 1)])
def test_blocks_and_samples_change_nothing(spark, block_rows, most_fit):
    """Vectors of 3 and 9 components: with a small sample one length has no list of its own."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(9 if i % 7 else 3)], i % 3) for i in range(120)]
    assert found(spark, rows, block_rows=block_rows, most_fit=most_fit) == brute(rows)


def test_scores_of_62_bits(spark):
    """Beyond 53 bits whole numbers are multiplied, and windows are cut in decimals."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(1e6, 4e6) for _ in range(4)], i % 2) for i in range(40)] + [(41, [1e8, 0.0, 0.0, 0.0], 0)]
    assert found(spark, rows) == brute(rows) and any(r[4] > 2**56 for r in brute(rows))


def test_many_rounds(spark):
    """More lists than one round visits, far apart, so that bounds leave some out."""
    rng = np.random.default_rng(8)
    middles = 20 * rng.normal(size=(40, 6))
    rows = [(i, (middles[i % 40] + rng.normal(size=6)).tolist(), (i // 40) % 2) for i in range(400)]
    table = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    index = negatives.fit(table.select(F.col("vec_id").alias("id"), F.size("embedding").alias("d"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("v")), 30_000, 400)
    assert len(index[6]) > 36
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, [1.0], 1)], [(None, None, None)], [(5, [1.0], 1), (6, [1.0], 2)]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == []


def test_best_takes_smaller_ids_of_ties():
    row, score, ids = (np.array(x) for x in ([0, 0, 0, 0, 1, 1], [5, 7, 5, 5, 1, 1], [9, 4, 1, 12, 12, 4]))
    assert negatives.best(row, score, ids, 2).tolist() == [1, 2, 5, 4]


def test_exact_products():
    a = np.array([[2**30, 1]], np.int64)
    assert negatives.scores(a, a)[0, 0] == 2**60 + 1 and negatives.scores(a[:, 1:], a[:, 1:])[0, 0] == 1
