import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridtide import schema as S
from gridtide.operators import tables as T
from gridtide.operators.distinct import BITS, ODD, code_sets, merge_sets, set_size
from gridtide.operators.summary import summarise
from gridtide.plans import report as R
from tests.grid import make_cells

SCHEMA = f"{S.AGE} int, Country double, Sovereig double"
code = st.one_of(
    st.none(),
    st.sampled_from([0.0, -0.0, 1.0, -1.0, 32767.0, 32768.0, 32769.0, -32768.0, 0.5, 1e300, float("nan"), float("inf"), -(2.0**53), 2.0**53]),
    st.integers(-70_000, 70_000).map(float),
    st.floats(-10, 10),
)


def sizes(sets, *names):
    return tuple(sets.agg(*(F.expr(f"{set_size(n)} AS c{i}") for i, n in enumerate(names))).first())


def plain(rows, at):
    found = {r[at] for r in rows if r[0] in S.AGES and r[at] is not None and not math.isnan(r[at])}
    return len(found)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([5, 50, 7, None]), code, code), max_size=40), st.integers(1, 3))
def test_sets_built_apart_count_exactly(spark, rows, parts):
    whole = None
    for at in range(parts):
        sets = code_sets(spark.createDataFrame(rows[at::parts], SCHEMA), ["Country", "Sovereig", "Absent"])
        whole = sets if whole is None else whole.union(sets)
    merged = merge_sets(whole)
    assert sizes(merged, "Country", "Sovereig", "Absent") == (plain(rows, 1), plain(rows, 2), 0)


def test_a_million_dirty_codes_fold_in_the_state(spark):
    count = 1_000_000
    dirty = spark.range(count).selectExpr(
        f"cast(5 * (1 + id % 10) AS int) AS {S.AGE}", "cast(id % 3 AS double) + id * 1e-7 AS Developed", "id + 100000D AS Income_Classification",
        "cast(id AS double) AS Sovereig", "100 + id % 50 + id * 1e-7 AS Country", "1.0D AS Slope",
    )
    state = R.report_state(dirty)
    # Ages x (development codes that exactly hit a label) x 50 country labels, and no more.
    assert state.count() <= len(S.AGES) * 3 * 8 * 51
    sets = code_sets(dirty, R.COUNTED).cache()
    assert sizes(sets, "Income_Classification", "Sovereig") == (count, count)
    bitmaps = sets.filter(f"{ODD} IS NULL").agg(F.count("*"), F.max(F.octet_length(BITS))).first()
    assert bitmaps[0] < 100 and bitmaps[1] == 4096
    wanted = dirty.agg(F.countDistinct("Country")).first()[0]
    overview = T.run_summary(state, codes=sets).first()
    assert (overview["countries_count"], overview["continents_count"], overview["income_levels_count"]) == (wanted, count, count)
    sets.unpersist()


def test_overview_from_sets_equals_the_one_from_raw_codes(spark):
    cells = spark.createDataFrame(make_cells(500))
    dims = list(S.DIMENSIONS.values())
    raw = T.run_summary(summarise(cells, dims, keep_invalid=True), "f").first()
    folded = T.run_summary(R.report_state(cells, keep_invalid=True), "f", codes=code_sets(cells)).first()
    assert folded == raw
    assert R.build_report(cells)[R.OVERVIEW].first()[:6] == raw[:6]


def test_nothing_to_count(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sizes(code_sets(none), "Country") == (0,)
    assert sizes(merge_sets(code_sets(none)), "Country") == (0,)
    bare = spark.createDataFrame([(5,)], f"{S.AGE} int")
    assert code_sets(bare).count() == 0
    with pytest.raises(ValueError, match=S.AGE):
        code_sets(bare.withColumnRenamed(S.AGE, "x")).count()
