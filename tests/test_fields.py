import pytest

from gridtide.operators import fields as P


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(1, 2.0, "x", True)], "b int, A double, c string, d boolean")


def test_derive_replaces_in_place(cells):
    out = P.derive_field(cells, " A ", "[b] * 10")
    assert out.columns == ["b", "A", "c", "d"] and out.first()["A"] == 10.0
    assert P.derive_field(cells, "n", "[d] + 1").columns[-1] == "n"
    with pytest.raises(ValueError, match="empty"):
        P.derive_field(cells, " ", "1")


def test_drop(cells):
    assert P.drop_fields(cells, ["A", "d"]).columns == ["b", "c"]
    with pytest.raises(ValueError, match="nope"):
        P.drop_fields(cells, ["nope"])


@pytest.mark.parametrize(
    "dtype,default,type_name,value",
    [
        ("Float64", "2.5", "double", 2.5),
        ("Float32", "0.5", "float", 0.5),
        ("Int64", "9000000000", "bigint", 9000000000),
        ("Int64", str(2**63), "bigint", None),
        ("Int32", "-7", "int", -7),
        ("Int32", "3000000000", "int", None),
        ("Int32", "3.7", "int", None),
        ("Float64", "abc", "double", None),
        ("Float64", "", "double", None),
        ("String", "NULL", "string", None),
        ("String", "hello", "string", "hello"),
        ("Boolean", "TRUE", "boolean", True),
        ("Boolean", "1", "boolean", True),
        ("Boolean", "yes", "boolean", False),
        ("Boolean", "null", "boolean", None),
        ("Decimal", "1.5", "double", 1.5),
    ],
)
def test_constants(cells, dtype, default, type_name, value):
    out = P.add_constant_field(cells, "k", dtype, default)
    assert out.schema["k"].dataType.simpleString() == type_name
    assert out.first()["k"] == value


def test_rename(cells):
    out = P.rename_fields(cells, {"b": "A", "A": "b"})
    assert out.columns == ["A", "b", "c", "d"] and tuple(out.first()) == (1, 2.0, "x", True)
    assert P.rename_fields(out, {"b": "A", "A": "b"}).columns == cells.columns
    with pytest.raises(ValueError, match="already exist"):
        P.rename_fields(cells, {"b": "A"})
    with pytest.raises(ValueError, match="empty"):
        P.rename_fields(cells, {"b": "  "})
    with pytest.raises(ValueError, match="Missing"):
        P.rename_fields(cells, {"z": "y"})


def test_orders(cells):
    assert P.order_fields_az(cells).columns == ["A", "b", "c", "d"]
    assert P.order_fields_by_type(cells).columns == ["A", "b", "c", "d"]
    assert P.reorder_fields(cells, ["d", "b"]).columns == ["d", "b"]
    assert P.manage_fields(cells, {"b": "z"}, ["z", "A"]).columns == ["z", "A"]
    with pytest.raises(ValueError, match="twice"):
        P.reorder_fields(cells, ["b", "b"])


@pytest.mark.parametrize(
    "name,where,order",
    [
        ("c", "top", "cbAd"), ("c", "up", "bcAd"), ("c", "down", "bAdc"), ("b", "bottom", "Acdb"),
        ("b", "up", "bAcd"), ("b", "top", "bAcd"), ("d", "down", "bAcd"), ("d", "bottom", "bAcd"),
    ],
)
def test_moves(cells, name, where, order):
    assert P.move_field(cells, name, where).columns == list(order)


def test_names_that_differ_in_case(spark, case_sensitive):
    cells = spark.createDataFrame([(1, 2)], "c int, C int")
    assert tuple(P.derive_field(cells, "C", "[c] + 10").first()) == (1, 11.0)
    assert P.drop_fields(cells, ["C"]).columns == ["c"]
    assert P.rename_fields(cells, {"c": "C", "C": "c"}).columns == ["C", "c"]


def test_case_clash_is_refused_where_spark_ignores_case(spark, cells):
    for make in (lambda: P.derive_field(cells, "a", "1"), lambda: P.rename_fields(cells, {"b": "a"})):
        with pytest.raises(ValueError, match="caseSensitive"):
            make()


def test_long_formulas_stay_in_methods_that_the_jvm_compiles(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    cells = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    try:
        for make in (lambda: P.derive_field(cells, "c", "([a] + 1) / ([b] + 1)"), lambda: P.derive_fields(cells, {"c": "([a] + 1) / ([b] + 1)"})):
            spark.conf.unset(limit)
            assert P.derive_field(cells, "c", "[a] + [b]").first().c == 5.0 and spark.conf.get(limit) == "65535"
            assert make().first().c == 0.75
            assert int(spark.conf.get(limit)) <= 8000
            spark.conf.set(limit, "60000")
            make()
            assert spark.conf.get(limit) == "60000"
    finally:
        spark.conf.set(limit, before)
