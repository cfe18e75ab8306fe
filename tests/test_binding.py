import pytest

from gridtide import schema as S
from gridtide.sources import binding as B

HAZARDS = [f"Hazard_Index_RP{t:03d}" for t in S.RETURN_PERIODS]


def test_bind_all():
    assert B.bind_return_periods(reversed(HAZARDS)) == [(float(t), f"Hazard_Index_RP{t:03d}") for t in S.RETURN_PERIODS]


def test_bind_needs_the_whole_number():
    assert B.bind_return_periods(["h_RP100", "h_RP1000"], [10, 100]) == [(100.0, "h_RP100")]
    assert B.bind_return_periods(["x_rp_10", "x_rp010"], [10]) == [(10.0, "x_rp010")]
    assert B.bind_return_periods(["RP2.5_h"], [2.5]) == [(2.5, "RP2.5_h")]
    assert B.bind_return_periods(["other"], [10]) == []


@pytest.mark.parametrize(
    "rows,message",
    [
        ([("ten", "a"), (20, "b")], "not a valid number"),
        ([(0, "a"), (20, "b")], "positive"),
        ([(-5, "a"), (20, "b")], "positive"),
        ([("nan", "a"), (20, "b")], "positive"),
        ([("inf", "a"), (20, "b")], "positive"),
        ([(10, "zz"), (20, "b")], "does not exist"),
        ([(10, "a")], "At least 2"),
        ([(10, "a"), ("", "b"), (None, "c"), (20, None)], "At least 2"),
        ([(10, "a"), (20, "a")], "Duplicate"),
    ],
)
def test_mapping_errors(rows, message):
    with pytest.raises(ValueError, match=message):
        B.validate_mapping(rows, ["a", "b", "e", "v"], "e", "v")


def test_mapping_roles():
    rows = [("10", " a "), (20, "b")]
    assert B.validate_mapping(rows, ["a", "b", "e", "v"], "e", "v") == [(10.0, "a"), (20.0, "b")]
    with pytest.raises(ValueError, match="exposure"):
        B.validate_mapping(rows, ["a", "b", "e", "v"], None, "v")
    with pytest.raises(ValueError, match="vulnerability"):
        B.validate_mapping(rows, ["a", "b", "e", "v"], "e", "")
    with pytest.raises(ValueError, match="Missing"):
        B.validate_mapping(rows, ["a", "b", "e"], "e", "v")


def test_missing_columns_are_all_named():
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        B.require_columns(["a"], ["x", "a", "y"])


def test_flood_detection():
    assert B.detect_flood_column(["a", "Groundwater", "FLOOD_1"]) == "Groundwater"
    assert B.detect_flood_column(["Submerged"]) == "Submerged"
    assert B.detect_flood_column(["a"]) is None


def test_report_columns():
    have = ["junk", "DEM", S.AGE, "flag", "POP_Exposure_1990", "Country", "POP_Exposure_1991"]
    assert B.report_columns(have, "flag") == ["DEM", S.AGE, "flag", "POP_Exposure_1990", "Country"]
    assert "flag" not in B.report_columns(have, None)
    with pytest.raises(ValueError, match=S.AGE):
        B.report_columns(["DEM"], None)
