import math

import numpy as np
import pytest

from gridtide.llm import topk_search
from gridtide.llm.queries import nearest_vectors

SCHEMA = "vec_id bigint, embedding array<double>, own string, size string, score string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "o", "s", "c", "p") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, top=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, a) in enumerate(good):
        if query is None or query % every:
            continue
        scores = [(sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(good) if n != at and len(a) == len(b)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(query, rank, i, score) for rank, (score, i) in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def result(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert result(nearest_vectors(spark, small)) == plain(rows)


EDGES = [
    (0, [0.1, 0.2]), (50, [0.1, 0.2]), (50, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.1, 0.2]), (4, [-0.1, 7.0]),
    (100, None), (150, [None, 1.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, []), (5, []), (None, [0.1, 0.2]),
    (350, [1.0, 0.0, 0.0]), (6, [0.001, 0.0, -0.001]), (-50, [0.0, 0.0]), (400, [-5.0, -1000.25]), (7, [3e9, -3e9]), (None, None),
]


@pytest.mark.parametrize("sizes", [(65_536, 4_096), (3, 1), (1, 2)])
def test_edges_over_blocks(spark, sizes):
    found = topk_search.search(frame(spark, EDGES), block_rows=sizes[0], block_queries=sizes[1])
    assert result(found) == plain(EDGES)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_empty_and_few(spark):
    assert topk_search.search(frame(spark, EDGES).limit(0)).collect() == []
    assert topk_search.search(frame(spark, [(50, [1.0])])).collect() == []
    assert result(topk_search.search(frame(spark, [(50, [1.0]), (1, [2.0])]))) == [(50, 1, 1, 256 * 512)]
    assert result(topk_search.search(frame(spark, EDGES), "vec_id % 7 = 0", top=2)) == plain(EDGES, 2, 7)


def test_ties_at_the_boundary_take_the_smallest_ids(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(300)]
    found = topk_search.search(frame(spark, rows), block_rows=64, top=7)
    assert result(found) == plain(rows, 7)


def test_scores_beyond_64_bits_rank_exactly_and_saturate(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 2.0]), (2, [1e16, 1.0]), (3, [-1e16, 0.0]), (4, [0.0, 3.0]), (5, [1e300, 0.0])]
    found = result(topk_search.search(frame(spark, rows), top=9))
    most = 2**63 - 1
    assert [(r[1], r[3]) for r in found] == [(1, most), (2, most), (3, most), (4, 256 * 768), (5, -most - 1)]
    assert {r[2] for r in found[:3]} == {1, 2, 5}


@pytest.mark.parametrize("seed", range(4))
def test_slices_equal_plain_sums(seed):
    random = np.random.default_rng(seed)
    high = [3, 200, 70_000, 2**40][seed]
    entries = random.integers(-high, high + 1, size=(int(random.integers(1, 300)), 9))
    slices = topk_search.Slices.of(entries)
    query = random.integers(-high, high + 1, size=9).tolist()
    sums, constant = slices.scores(query)
    got = [constant + sum((int(b[r >> 6]) >> (r & 63) & 1) << w for w, b in enumerate(sums)) for r in range(len(entries))]
    true = [sum(int(x) * y for x, y in zip(row, query)) for row in entries]
    assert got == true
    best = sorted(range(len(true)), key=lambda r: (-true[r], r))
    assert slices.best(query, 5, best[0]) == [(r, true[r]) for r in best[1:6]]


@pytest.mark.parametrize("number", [0, 1, -1, 7, -7, 255, -256, 12345, -(2**70) + 3])
def test_signed_digits(number):
    digits = topk_search._signed_digits(number)
    assert sum(sign << place if sign > 0 else -(1 << place) for place, sign in digits) == number
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))
