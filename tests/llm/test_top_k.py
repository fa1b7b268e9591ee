"""Exact top-k against brute force over rows: whatever the shards, with repeated rows and ids, lengths, and odd values."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import knn


def brute(rows, k):
    """Counts of (query_id, rank, vec_id, score): every row with an id divisible by 20 against every other row."""
    out = Counter()
    for a, (q, u) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-int(sum(x * y for x, y in zip(u, v))), i) for b, (i, v) in enumerate(rows) if a != b and len(u) == len(v))[:k]
            out.update((q, p, i, -s) for p, (s, i) in enumerate(best, 1))
    return out


def found(df):
    return Counter(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({"score": F.lit(0), "n": F.lit("x"), "copies": F.lit(None), "block": F.lit(1)})


@pytest.mark.parametrize(("n", "k", "sizes"), [(700, 20, (60, 10, 3)), (700, 20, (200, 10, 1)), (15, 20, (8192, 4096, 8)), (300, 1, (40, 4, 2))])
def test_equals_brute_force(spark, n, k, sizes):
    rng = random.Random(n)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(n)]  # few values: many ties
    rows += [(i, [float(i % 7), 1.0]) for i in range(0, 90, 5)] + [(i, []) for i in (20, 21, 40)]  # other lengths, ids with several
    rows += rows[:3] + rows[20:22] * 2 + [(1, rows[0][1])]  # repeated rows
    odd = [(n, None), (n + 20, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (n + 40, [float("nan")] * 6), (None, [1.0] * 6)]
    is_query = F.col("vec_id") % 20 == 0
    assert found(knn.top_k(frame(spark, rows + odd), is_query, k, *sizes)) == brute(rows, k)
    assert knn.top_k(frame(spark, []), is_query).count() == 0
    assert knn.top_k(frame(spark, odd), is_query).count() == 0


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)]
    assert found(knn.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, 50, 4, 2)) == brute(rows, 20)


def test_the_kth_score_goes_on_to_other_shards():
    rng = np.random.default_rng(3)
    near, far = rng.integers(50, 60, (400, 8)).astype(float), rng.integers(-60, -50, (400, 8)).astype(float)
    queries, ids = near[:5], np.arange(400)
    best = knn.Best(np.arange(5), queries, 20)
    assert best.reaches(far)
    best.visit(knn.Tree(ids, near, np.ones(400, np.int64)))
    assert not best.reaches(far)
    seeded = knn.Best(np.arange(5), queries, 20, best.kth)
    assert not seeded.reaches(far) and seeded.reaches(near)
    seeded.visit(knn.Tree(ids, near, np.ones(400, np.int64)))
    assert (seeded.score == best.score).all() and (seeded.found == best.found).all()


def test_the_query_floors_and_leaves_out_what_is_not_finite(spark, tmp_path):
    odd = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, [0.25 * (i % 5), 1.0 - 0.1 * i]) for i in range(0, 24)] + [(3, [0.5, 0.5]), (20, [0.1, 0.2]), (5, [0.0, 0.5])] * 2
    bad = [(60 + 20 * i, [1.0, x]) for i, x in enumerate(odd)] + [(30 + i, [x, 1.0]) for i, x in enumerate(odd)] + [(50, None), (None, [1.0, 1.0])]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    floored = [(i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows]
    assert found(knn.op9_exact_top_k(spark, str(tmp_path))) == brute(floored, 20)
