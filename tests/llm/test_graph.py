import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridtide.llm.graph import components


def plain(links):
    label = {}
    for a, b in links:
        for n in (a, b):
            label.setdefault(n, n)
        old, new = label[a], label[b]
        if old != new:
            label = {n: new if g == old else g for n, g in label.items()}
    least = {}
    for n, g in label.items():
        least[g] = min(n, least.get(g, n))
    return {(n, least[g]) for n, g in label.items()}


def run(spark, links):
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    one, rounds = ({(r.node, r.component) for r in components(frame, small=small).collect()} for small in (200_000, 0))
    assert one == rounds
    return one


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)).filter(lambda p: p[0] != p[1]), max_size=40))
def test_components(spark, links):
    assert run(spark, links) == plain(links)


def test_chain_star_and_bad_links(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    links = [*chain, *star, *chain, (5, 5), (None, 3), (4, None), (77_000, 77_000)]
    assert run(spark, links) == plain([*chain, *star])


def test_millions_of_links(spark):
    """Pairs of neighbours; sums over the hashes of so many links must not overflow."""
    links = spark.range(2_000_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    found = components(links).agg(
        F.count("*").alias("n"), F.count_if(F.col("component") != F.col("node") - F.col("node") % 2).alias("wrong")
    )
    assert tuple(found.first()) == (4_000_000, 0)


@pytest.mark.parametrize("mixed", [False, True])
def test_a_long_path_in_one_task(spark, mixed):
    names = np.arange(100_000)
    if mixed:
        np.random.default_rng(1).shuffle(names)
    links = spark.createDataFrame(pd.DataFrame({"a": names[:-1], "b": names[1:]}))
    start = time.monotonic()
    found = components(links).agg(F.count("*"), F.max("component")).first()
    assert tuple(found) == (100_000, 0) and time.monotonic() - start < 30


def test_only_few_links_are_settled_in_one_task(spark):
    few, many = spark.range(10).selectExpr("id + 1 AS a", "id AS b"), spark.range(11).selectExpr("id + 1 AS a", "id AS b")
    plans = [components(frame, small=10)._jdf.queryExecution().optimizedPlan().toString() for frame in (few, many)]
    assert "Aggregate" not in plans[0] and "Aggregate" in plans[1]
