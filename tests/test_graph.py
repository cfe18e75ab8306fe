import math
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridtide.functions.expressions import ExpressionError
from gridtide.operators.fields import derive_field, derive_fields


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(2.0, 3.0, "x"), (5.0, -1.0, "y")], "a double, b double, t string")


def values(frame, *names):
    return [tuple(r) for r in frame.orderBy("t").select(*(f"`{n}`" for n in names)).collect()]


def test_fields_in_any_order(cells):
    out = derive_fields(cells, {"z": "[y] * 2", "y": "[x] + [a]", "x": "[b] - 1"})
    assert out.columns == ["a", "b", "t", "z", "y", "x"]
    assert values(out, "x", "y", "z") == [(2.0, 4.0, 8.0), (-2.0, 3.0, 6.0)]


def test_a_replaced_column_is_itself_only_in_its_own_expression(cells):
    out = derive_fields(cells, {"c": "[a] + 1", "a": "[a] * 10", " d ": "[a]"})
    assert out.columns == ["a", "b", "t", "c", "d"]
    assert values(out, "a", "c", "d") == [(20.0, 21.0, 20.0), (50.0, 51.0, 50.0)]
    swapped = derive_fields(cells, {"step1": "[b]", "STEP_": "[step1] / ([step1] + [a])"})
    assert values(swapped, "STEP_") == [(3.0 / 5.0,), (-1.0 / 4.0,)]


def test_cycles_and_unknown_names_are_refused(cells):
    with pytest.raises(ExpressionError, match="cycle: (x, y, z, x|y, z, x, y|z, x, y, z)"):
        derive_fields(cells, {"w": "[x]", "x": "[y]", "y": "[z] + 1", "z": "[x] * [a]"})
    with pytest.raises(ExpressionError, match="Unknown field"):
        derive_fields(cells, {"x": "[x] + 1"})
    with pytest.raises(ExpressionError, match="Unknown field"):
        derive_fields(cells, {"x": "[nope]"})
    with pytest.raises(ExpressionError, match="not numeric"):
        derive_fields(cells, {"x": "[t] + 1"})
    with pytest.raises(ExpressionError, match="Not allowed"):
        derive_fields(cells, {"x": "[a] if 1 else 2"})
    with pytest.raises(ValueError, match="twice"):
        derive_fields(cells, {"x": "1", " x": "2"})
    assert derive_fields(cells, {}).columns == cells.columns


def test_shared_parts_stand_once_in_the_plan(cells):
    out = derive_fields(
        cells,
        {
            "p": "exp([a] * 0.5) + sqrt([b] + 2)",
            "q": "sin(exp([a] * 0.5)) - [p]",
            "r": "([p] + [q]) / (sqrt([b] + 2) + 1)",
            "s": "exp([a] * 0.5) % sqrt([b] + 2)",
        },
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for part in ("EXP", "SQRT", "SIN"):
        assert len(re.findall(rf"\b{part}\(", plan)) == 1, plan
    a, b = 2.0, 3.0
    e, w = math.exp(a * 0.5), math.sqrt(b + 2)
    p = e + w
    q = math.sin(e) - p
    assert values(out, "p", "q", "r", "s")[0] == pytest.approx((p, q, (p + q) / (w + 1), math.fmod(e, w)))


def test_a_long_chain_grows_with_its_length(cells):
    sizes = []
    for length in (10, 20):
        chain = {f"c{i}": f"([c{i - 1}] + [c{i - 1}]) / ([c{i - 1}] + 1)" if i else "[a]" for i in reversed(range(length))}
        sizes.append(len(derive_fields(cells, chain)._jdf.queryExecution().optimizedPlan().toString()))
    # Every projection lists the columns before it.
    assert sizes[1] < 5 * sizes[0]


operators = st.sampled_from(["[{}] + [{}]", "[{}] * [{}]", "[{}] / ([{}] + 1)", "max([{}], [{}])", "sqrt(abs([{}])) - [{}]", "abs([{}]) ^ 0.5 + [{}]"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(operators, st.integers(0, 99), st.integers(0, 99)), min_size=1, max_size=8), st.randoms())
def test_equals_deriving_one_by_one(cells, parts, random):
    names = ["a", "b"]
    definitions = {}
    for at, (text, one, two) in enumerate(parts):
        definitions[f"n{at}"] = text.format(names[one % len(names)], names[two % len(names)])
        names.append(f"n{at}")
    one_by_one = cells
    for name, text in definitions.items():
        one_by_one = derive_field(one_by_one, name, text)
    mixed = list(definitions.items())
    random.shuffle(mixed)
    found = values(derive_fields(cells, dict(mixed)), *definitions)
    for got, wanted in zip(found, values(one_by_one, *definitions)):
        assert got == pytest.approx(wanted, rel=1e-12, nan_ok=True)
