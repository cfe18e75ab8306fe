"""A grid-cell table derived from the order tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtide import schema as S

FLOOD = "Flood_Flag"

# Hazard column -> multiple of the discount.
HAZARD_FACTORS = {
    "Hazard_Index_RP010": 2.0,
    "Hazard_Index_RP020": 3.5,
    "Hazard_Index_RP050": 5.0,
    "Hazard_Index_RP075": 5.8,
    "Hazard_Index_RP100": 6.5,
    "Hazard_Index_RP200": 7.8,
    "Hazard_Index_RP500": 12.0,
}
_HAZARDS = {name: f"l_discount * {factor}D" for name, factor in HAZARD_FACTORS.items()}
CELLS = {
    S.AGE: "cast(5 * (1 + cast(l_quantity AS int) % 12) AS int)",
    "Developed": "if(c_custkey % 29 = 0, NULL, cast(1 + c_nationkey % 3 AS double))",
    "Income_Classification": "if(c_custkey % 31 = 0, NULL, cast(c_nationkey % 6 AS double))",
    "Sovereig": "cast(10 + c_nationkey % 8 AS double)",
    "Country": "if(c_custkey % 37 = 0, NULL, cast(CASE c_nationkey WHEN 24 THEN 999 WHEN 23 THEN 275"
    " ELSE 100 + c_nationkey * 10 END AS double))",
    **_HAZARDS,
    "Hazard_Index_RP500": f"if(l_partkey % 41 = 0, NULL, {_HAZARDS['Hazard_Index_RP500']})",
    S.EXPOSURE: "l_quantity / 45.0D",
    S.VULNERABILITY: "if(l_suppkey % 43 = 0, NULL, l_tax * 10.0D + 0.1D)",
    "Slope": "if(l_linenumber = 7, 0.0D, l_discount * 300.0D)",
    "DEM": "if(l_suppkey % 53 = 0, cast('NaN' AS double), l_extendedprice / 100.0D - 50.0D)",
    "Distance_from_River": "cast(l_partkey AS double)",
    FLOOD: "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '0' ELSE 'n/a' END",
    S.POPULATION: "cast(l_linenumber * 100 AS double)",
    **{
        S.exposure_column(year): f"if(l_suppkey % 47 = 0, NULL, cast(l_linenumber * {5 * (i + 1)} AS double))"
        for i, year in enumerate(S.YEARS)
    },
}


def grid_from(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One cell per line item; its order's customer gives the codes.

    Orders meet customers first, so that the large table is shuffled at most once.
    """
    places = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_custkey", "c_nationkey"
    )
    rows = lineitem.join(places, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr(*(f"{text} AS {name}" for name, text in CELLS.items()))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def demo_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid_from(*(table(spark, folder, name) for name in ("lineitem", "orders", "customer")))


def streaming_demo_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The same cells with line items read as a stream of files, joined to the static tables."""
    schema = table(spark, folder, "lineitem").schema
    # A glob also serves a table that is one single file; the stream source wants folders otherwise.
    lineitem = spark.readStream.schema(schema).parquet(f"{folder}/lineitem.parque[t]")
    return grid_from(lineitem, table(spark, folder, "orders"), table(spark, folder, "customer"))


def demo_country_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Country dictionary from the nation table; two nations stay without a label on purpose."""
    nations = table(spark, folder, "nation").filter(F.col("n_nationkey") < 23)
    return nations.select(
        (100 + F.col("n_nationkey") * 10).cast("bigint").alias("code"), F.col("n_name").alias("label")
    )
