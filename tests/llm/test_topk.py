import math
import random

import numpy as np
import pytest
from loomhouse.llm import topk
from pyspark.sql import functions as F


def brute(rows, is_query, k):
    whole = {}
    some = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        some.append((i, [math.floor(64 * x) for x in v]))
        if is_query(i):
            whole[i] = min(whole.get(i, some[-1][1]), some[-1][1])
    out = []
    for q, a in whole.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in some if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("candidates", "queries", "grid"), [(4096, 512, None), (7, 3, None), (1, 1, None), (3, 1, (2, 3, 2))])
def test_against_brute_force(spark, candidates, queries, grid, monkeypatch):
    for name, value in zip(("QUERY_BLOCKS", "CANDIDATE_BLOCKS", "CELLS"), grid or ()):  # a grid of several rows and columns
        monkeypatch.setattr(topk, name, value)
    r = random.Random(7)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-1, 1), 0.5]) for _ in range(8)]) for i in range(60)]
    rows += [(100, [0.5] * 8), (101, [0.5] * 8), (102, [0.5] * 8), (40, [9.0] * 8), (40, [0.1] * 8)]  # ties, a repeated id
    rows += [(200, None), (201, []), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, [1.0] * 8), (220, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = topk.search(frame, F.col("vec_id") % 20 == 0, 5, candidates_a_block=candidates, queries_a_block=queries)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(single, lambda i: i % 20 == 0, 5)


def test_fewer_than_k_large_values_and_lengths(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [3e4]), (3, [1.0, 2.0, 3.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 20)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0, 20)


def test_fewer_than_k_others_in_the_block_of_a_query(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5]), (20, [2.0, 0.0]), (0, [3.0, 3.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1), F.col("vec_id") % 20 == 0, 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 4)


def test_extra_and_clashing_columns_and_nulls(spark):
    rows = [(0, [1.0, 2.0], "x", None), (20, [3.0, 1.0], None, 4), (None, None, None, None), (7, [1.0, 1.0], "y", 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, ids string, score int").withColumns({"r": F.lit(1), "c": F.lit(2), "id": F.lit(3), "weights": F.lit(4)})
    got = topk.search(frame, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute([r[:2] for r in rows], lambda i: i % 20 == 0, 20)


def test_empty_and_no_query(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.search(frame.limit(0), F.col("vec_id") == 1).collect() == []
    assert topk.search(frame, F.col("vec_id") == 5).collect() == []
    assert topk.search(frame, F.col("vec_id") == 1).collect() == []


def test_neither_side_is_broadcast(spark):
    rows = [(i, [i % 7 / 7, i % 5 / 5]) for i in range(100)]
    got = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 3)
    assert len(got.collect()) == 15
    plan = got._jdf.queryExecution().executedPlan().toString()  # copies are made after Spark estimates sizes, so it would take them for small
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize(("asked", "own", "cores"), [(1, 1, 6), (7, 16, 6), (60, 150, 6), (300, 750, 6), (2000, 250, 6), (3, 5000, 1000)])
def test_grid_copies_no_more_than_cores_need(asked, own, cores):
    down, across = topk.grid(asked, own, cores)
    assert topk.QUERY_BLOCKS * down >= asked >= down and topk.CANDIDATE_BLOCKS * across >= own >= across
    cells = max(4 * cores, -(-asked // topk.QUERY_BLOCKS) * -(-own // topk.CANDIDATE_BLOCKS))
    assert min(cells, topk.CELLS, asked * own) <= down * across < cells + down + across


def test_running_lists_that_go_out_early(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 12)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.5]) for _ in range(4)]) for i in range(90)]
    got = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 3 == 0, 4, candidates_a_block=5, queries_a_block=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 3 == 0, 4)
