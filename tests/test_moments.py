import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridtide.operators.moments import merge_moment_sums, moment_sums

value = st.one_of(st.none(), st.just(float("nan")), st.just(0.0), st.floats(-50, 50))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4), value), min_size=1, max_size=40), st.booleans())
def test_any_split_equals_one_pass(spark, rows, exclude_zero):
    frame = spark.createDataFrame(rows, "g int, batch int, x double")
    parts = moment_sums(frame, ["g", "batch"], ["x"], exclude_zero)
    merged = {r["g"]: r for r in merge_moment_sums(parts, ["g"], ["x"]).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, _, v in rows if k == g and v is not None and not math.isnan(v) and not (exclude_zero and v == 0)]
        row, n = merged[g], len(values)
        assert row["x_n"] == n
        if not n:
            assert all(row[f"x_{k}"] is None for k in ("Mean", "Std", "SE", "Min", "Max"))
            continue
        mean = sum(values) / n
        std = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
        assert row["x_Mean"] == pytest.approx(mean, abs=1e-9)
        assert row["x_Std"] == pytest.approx(std, abs=1e-5)
        assert row["x_SE"] == pytest.approx(std / math.sqrt(n), abs=1e-5)
        assert (row["x_Min"], row["x_Max"]) == (min(values), max(values))


def test_saved_parts_merge_later(spark, folder):
    for batch in range(3):
        frame = spark.range(10).select(F.lit("k").alias("g"), (F.col("id") + 10 * batch).cast("double").alias("x"))
        moment_sums(frame, ["g"], ["x"]).write.parquet(f"{folder}/batch={batch}")
    row = merge_moment_sums(spark.read.parquet(folder), ["g"], ["x"]).first()
    assert (row["x_Mean"], row["x_n"], row["x_Min"], row["x_Max"]) == (15.0, 29, 1.0, 29.0)


def test_large_offsets_keep_their_deviation(spark):
    values = [1e9 + v for v in (0.0, 0.25, 0.5, 0.75)]
    frame = spark.createDataFrame([("k", i % 2, v) for i, v in enumerate(values)], "g string, batch int, x double")
    row = merge_moment_sums(moment_sums(frame, ["g", "batch"], ["x"]), ["g"], ["x"]).first()
    assert row["x_Std"] == pytest.approx(math.sqrt(0.078125), rel=1e-6)
