import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridtide import schema as S
from gridtide.functions.hazard import ead_weights
from gridtide.plans.risk import risk_output, run_risk, with_ead, with_risk

PERIODS = list(S.RETURN_PERIODS)
NAMES = [f"Hazard_Index_RP{t:03d}" for t in PERIODS]
NAN, INF = float("nan"), float("inf")


def hazards(spark, rows):
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in NAMES))


def trapezoid(values, periods=PERIODS):
    """Area under the hazard curve over exceedance probability, extended flat to 0 and 1."""
    curve = sorted(zip((1 / t for t in periods), values))
    p = np.array([0.0, *(x for x, _ in curve), 1.0])
    h = np.array([curve[0][1], *(y for _, y in curve), curve[-1][1]])
    return float(min(1.0, max(0.0, np.trapezoid(h, p))))


def test_golden_values(spark):
    row = with_ead(hazards(spark, [[0.20, 0.35, 0.50, 0.58, 0.65, 0.78, 0.92]])).first()
    assert row[S.HAZARD_EAD] == pytest.approx(0.220115, abs=1e-6)
    frame = spark.createDataFrame([(0.65, 0.80, 0.45)], f"{S.HAZARD_EAD} float, {S.EXPOSURE} double, {S.VULNERABILITY} double")
    assert with_risk(frame).first()[S.RISK] == pytest.approx(0.616224, abs=1e-6)


def test_weights():
    weights = ead_weights([(float(t), n) for t, n in zip(PERIODS, NAMES)])
    assert [n for n, _ in weights] == NAMES[::-1]
    assert [w for _, w in weights] == pytest.approx([0.0035, 0.004, 0.0041667, 0.005, 0.0183333, 0.04, 0.925], abs=1e-6)
    assert sum(w for _, w in ead_weights([(0.5, "a"), (3, "b")])) == pytest.approx(1.0)


@pytest.mark.parametrize("value,expected", [(None, 0), (NAN, 0), (INF, 1), (-INF, 0), (-0.5, 0), (1.5, 1), (0.0, 0), (1.0, 1), (0.37, 0.37)])
def test_constant_curve_is_clipped_value(spark, value, expected):
    assert with_ead(hazards(spark, [[value] * 7])).first()[S.HAZARD_EAD] == pytest.approx(expected, abs=1e-6)


def test_opposite_infinities_give_no_nan(spark):
    found = with_ead(hazards(spark, [[INF, -INF, INF, -INF, 0.0, 0.0, 0.0], [-INF, INF, 0.0, 0.0, 0.0, 0.0, 0.0]])).collect()
    assert [r[S.HAZARD_EAD] for r in found] == [1.0, 0.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-0.5, 1.5), min_size=7, max_size=7), min_size=1, max_size=25))
def test_matches_trapezoid(spark, rows):
    found = [r[S.HAZARD_EAD] for r in with_ead(hazards(spark, rows)).collect()]
    assert sorted(found) == pytest.approx(sorted(trapezoid(r) for r in rows), abs=1e-6)
    assert all(0 <= v <= 1 for v in found)


def test_mapping_order_and_short_periods(spark):
    frame = spark.createDataFrame([(0.9, 0.1, 0.4)], "a double, b double, c double")
    mapping = [(100.0, "a"), (0.5, "b"), (10.0, "c")]
    row = with_ead(frame, mapping).first()
    assert row[S.HAZARD_EAD] == pytest.approx(trapezoid([0.9, 0.1, 0.4], [100, 0.5, 10]), abs=1e-6)
    with pytest.raises(ValueError, match="does not exist"):
        with_ead(frame, [(10.0, "a"), (20.0, "zz")])
    for bad in ([], [(10.0, "a")], [(0.0, "a"), (10.0, "b")], [(5.0, "a"), (10.0, "a")]):
        with pytest.raises(ValueError):
            with_ead(frame, bad)
    with pytest.raises(ValueError, match="At least 2"):
        with_ead(frame)


def test_risk_missing_and_clip(spark):
    rows = [(None, 1.0, 1.0), (0.5, NAN, 1.0), (0.5, 2.0, 0.25), (0.5, -1.0, 1.0), (1.0, INF, 1.0)]
    frame = spark.createDataFrame(rows, f"{S.HAZARD_EAD} float, {S.EXPOSURE} double, {S.VULNERABILITY} double")
    found = [r[S.RISK] for r in with_risk(frame).collect()]
    assert found == pytest.approx([0, 0, 0.5, 0, 1], abs=1e-6)


def make_input(spark, path, rows=20, extra=""):
    frame = spark.range(rows).selectExpr(
        "cast(id AS int) AS Developed", "cast(NULL AS int) AS Country", "id",
        *(f"id / {t}D AS {n}" for t, n in zip(PERIODS, NAMES)),
        "0.5D AS Exposure_Index", "cast(1 AS float) AS Vulnerability_Index", *([extra] if extra else []),
    )
    frame.write.parquet(path)


def test_run_writes_the_output_schema(spark, folder):
    make_input(spark, f"{folder}/in", extra="cast(9 AS float) AS Risk_Index")
    run_risk(spark, f"{folder}/in", f"{folder}/out")
    out = spark.read.parquet(f"{folder}/out")
    kinds = dict(out.dtypes)
    assert out.columns[:3] == ["Developed", "Country", "id"] and out.columns[-2:] == [S.HAZARD_EAD, S.RISK]
    assert kinds["Developed"] == kinds["Country"] == "double" and kinds["id"] == "bigint"
    assert kinds[S.HAZARD_EAD] == kinds[S.RISK] == "float" and kinds["Vulnerability_Index"] == "float"
    assert out.count() == 20 and out.filter("Risk_Index = 9").count() == 0
    with pytest.raises(ValueError, match="overlaps"):
        run_risk(spark, f"{folder}/in", f"{folder}/in")
    assert spark.read.parquet(f"{folder}/in").count() == 20


def test_empty_input_gives_an_empty_table(spark, folder):
    make_input(spark, f"{folder}/in", rows=0)
    run_risk(spark, f"{folder}/in", f"{folder}/out")
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 0 and S.RISK in out.columns


def test_missing_inputs_are_named(spark, folder):
    make_input(spark, f"{folder}/in")
    frame = spark.read.parquet(f"{folder}/in").drop("Exposure_Index")
    with pytest.raises(ValueError, match="Exposure_Index"):
        risk_output(frame)
