import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import bsi_topk
from inkwell.llm.queries import OP5_SQL, op5_exact_topk
from tests.oracle import differences


@given(st.integers(1, 150), st.integers(1, 5), st.integers(0, 1000), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_block(n, dims, seed, k):
    rng = np.random.default_rng(seed)
    ids, values = rng.permutation(n * 2)[:n], rng.integers(-5, 5, (n, dims))
    index = bsi_topk.Index(ids, values)
    query, own = rng.integers(-300, 300, dims), int(ids[0])
    wanted = sorted((-int(v @ query), i) for i, v in zip(ids.tolist(), values, strict=True) if i != own)[:k]
    assert sorted((-int(index.values[p] @ query), int(index.ids[p])) for p in index.top(query, k, own)) == wanted


def answers(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, bsi_topk.top_k(table, **options).collect()))


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_table(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype("f4").tolist()) for i in range(100)] + [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    odd = [(900, None), (950, [1.0, None, 0.0, 0.0]), (901, [float("nan")] * 4), (902, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    wanted = bsi_topk.by_brute_force([r for r in rows], {i for i, _ in rows if i % 50 == 0}, 5)
    assert answers(spark, rows + odd, k=5, query_filter=lambda i: i % 50 == 0, block_rows=block_rows, block_queries=2) == wanted


def test_few_rows(spark):
    assert answers(spark, [(0, [1.0]), (1, [2.0])], query_filter=lambda i: i == 0) == [(0, 1, 1, 256 * 512)]
    assert answers(spark, [(0, [1.0])]) == []
    assert answers(spark, []) == []
    assert answers(spark, [(0, []), (1, []), (2, [1.0])], query_filter=lambda i: i == 0) == [(0, 1, 1, 0)]


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0001]), (1, [3.0, 2.0]), (2, [1.0, 4.0]), (2, [1.0, 4.0])]
    found = answers(spark, rows, k=2, query_filter=lambda i: i % 50 == 0)
    one, two = [(50, 1, 1, 3 << 16), (50, 2, 2, 1 << 16)], [(50, 1, 2, 4 << 16), (50, 2, 2, 4 << 16)]
    assert found == sorted(one + two)


def test_query(spark):
    assert differences(spark, "/root/testdata/sf0.001", op5_exact_topk, OP5_SQL) == []
