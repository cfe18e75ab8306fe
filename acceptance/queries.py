"""One registered query per operator, over the grid derived from the test tables.

Results are shaped for comparison only here: floats rounded, float32 widened, and the kind of a
special value (null, NaN, infinity) in a text column beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtide import schema as S
from gridtide.functions.columns import INF, field, is_floating, number
from gridtide.functions.display import format_report_values
from gridtide.operators import fields as P, layout
from gridtide.operators import tables as T
from gridtide.operators.filters import filter_codes, matches, valid_age
from gridtide.operators.labels import with_label
from gridtide.operators.moments import merge_moment_sums, moment_sums
from gridtide.operators.summary import summarise
from gridtide.plans.report import CATALOGUE, OVERVIEW, build_report, display_text
from gridtide.plans.risk import risk_output, with_ead, with_risk
from gridtide.plans.work import work_folder
from gridtide.sources import profile, scan
from gridtide.sources.sinks import write_fields
from gridtide.sources.demo_grid import (
    FLOOD,
    demo_country_labels,
    demo_grid,
    grid_from,
    streaming_demo_grid,
    table,
)
from gridtide.streaming.incremental import (
    arrived_report,
    finish,
    latest_report_state,
    read_arriving,
    stream_report_state,
    stream_risk,
)

Query = Callable[[SparkSession, str], DataFrame]
# Added before rounding on both sides. Means of decimal data often end exactly halfway between two
# rounded values, and the engines' sums reach such a tie from different sides; this moves it away.
NUDGE = 1.2345678e-7



def _chain(step: str, depth: int = 8) -> str:
    """A formula nested ``depth`` times, the innermost over Slope."""
    text = "[Slope]"
    for level in range(1, depth + 1):
        text = step.format(text, level)
    return text


FEW = ("Built_Up_Age", "Slope", "Distance_from_River", "Exposure_Index", "Flood_Flag", "POP_2025")
DERIVED = {
    "derive_arith": {"r": "-([Slope] + 2) * [Exposure_Index] - [POP_2025] / 4 + +1.5"},
    "derive_div": {
        "r1": "[DEM] / [Slope]",
        "r2": "[Slope] / [Slope]",
        "r3": "[POP_Exposure_2025] / (-1 * [Slope])",
    },
    "derive_mod": {
        "r1": "[DEM] % 7",
        "r2": "[Distance_from_River] % -3",
        "r3": "[POP_2025] % [Slope]",
    },
    "derive_pow": {
        "r1": "[Exposure_Index] ^ 2",
        "r2": "-[Slope]^2",
        "r3": "2 ** [Exposure_Index] ** 0.5",
    },
    "derive_unary": {
        "r1": "ABS([DEM] - 500)",
        "r2": "sqrt([Slope] - 6)",
        "r3": "exp(-[Exposure_Index])",
        "r4": "sin([Slope]) + cos([Exposure_Index])",
        "r5": "Tan([Exposure_Index])",
        "r6": "sign([Slope] - 15)",
    },
    "derive_log": {
        "r1": "log([Slope])",
        "r2": "ln([Exposure_Index])",
        "r3": "log10([DEM] - 500)",
    },
    "derive_round": {
        "r1": "ceil([DEM])",
        "r2": "floor([DEM] - 700)",
        "r3": "round([Slope] / 2)",
    },
    "derive_minmax": {
        "r1": "min([Vulnerability_Index], [Exposure_Index])",
        "r2": "max([DEM], [Distance_from_River])",
    },
    "derive_nested": {
        "r1": _chain("({}) / ([Exposure_Index] + {})"),
        "r2": _chain("({} + 17.25) % ([Exposure_Index] + {})"),
        "r3": _chain("({} * 0.5 + 1) ^ (0.5 + [Exposure_Index] / (2 + {}))"),
        "r4": _chain("round({} * 1.5 + {})"),
        "r5": _chain("floor({} * 1.25 + {})"),
        "r6": _chain("log({} + 20 + {})"),
    },
    "derive_example_1": {"r": "[Hazard_Index_RP100] / max([Hazard_Index_RP100], 0.001)"},
    "derive_example_2": {
        "r": "([Hazard_Index_EAD] * 0.4) + ([Exposure_Index] * 0.3) + ([Vulnerability_Index] * 0.3)"
    },
    "derive_example_3": {"r": "# decay with distance\nexp(-[Distance_from_River] / 1000)"},
    "derive_example_4": {"r": "[Hazard_Index_EAD] * (1 + sin([Slope] * 3.14159 / 180))"},
}


# Ten fields that use one another, given in no order.
GRAPH = {
    "f1": "[f3] / ([f2] + 1)",
    "f2": "exp(-[Distance_from_River] / 1000)",
    "f3": "sqrt([f5]) + [f2]",
    "f4": "max([f1], [f3]) ^ 2",
    "f5": "abs([Distance_from_River] % 7) + [Slope]",
    "f6": "log([f4] + [f5] + 1)",
    "f7": "min([f6], [f10])",
    "f8": "[f7] - [f1] * [f2]",
    "f9": "([f8] + [f7]) / (exp(-[Distance_from_River] / 1000) + [f3] + 1)",
    "f10": "sin([f5]) * [f2] - sqrt([f5])",
}


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(
        *(
            F.round(number(f.name) + NUDGE, digits).alias(f.name) if is_floating(f.dataType) else field(f.name)
            for f in frame.schema
        )
    )


def special(frame: DataFrame, names: Sequence[str], digits: int | None = None) -> DataFrame:
    """Split each named double into its finite value and the kind of value it is."""
    split = []
    for name in names:
        value = number(name)
        kind = (
            F.when(value.isNull(), "null")
            .when(F.isnan(value), "nan")
            .when(value == INF, "+inf")
            .when(value == -INF, "-inf")
            .otherwise("finite")
        )
        shown = F.round(value + NUDGE, digits) if digits is not None else value
        # Adding zero turns -0.0 into 0.0.
        split += [F.when(kind == "finite", shown + 0.0).alias(name), kind.alias(f"{name}_kind")]
    kept = [field(name) for name in frame.columns if name not in names]
    return frame.select(*kept, *split)


def with_order(frame: DataFrame) -> DataFrame:
    """Make the column order visible to a comparison that sorts columns."""
    return frame.withColumn("column_order", F.lit(",".join(frame.columns)))


def few(spark: SparkSession, folder: str) -> DataFrame:
    return scan.scan_columns(demo_grid(spark, folder), FEW)


def _derive(expressions: dict[str, str]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        cells = demo_grid(spark, folder)
        if any(S.HAZARD_EAD in text for text in expressions.values()):
            cells = with_ead(cells)
        for name, text in expressions.items():
            cells = P.derive_field(cells, name, text)
        return special(cells.select(*expressions), list(expressions), 6)

    return run


def derive_graph(spark: SparkSession, folder: str) -> DataFrame:
    cells = P.derive_fields(demo_grid(spark, folder), GRAPH)
    return special(cells.select(*GRAPH), list(GRAPH), 6)


def scan_grid(spark: SparkSession, folder: str) -> DataFrame:
    return special(demo_grid(spark, folder), ["DEM"])


def scan_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return scan.scan_columns(scan.scan_grid(spark, f"{folder}/lineitem.parquet"), ["l_quantity", "l_partkey"])


def dataset_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dataset_profile(scan.scan_grid(spark, f"{folder}/lineitem.parquet"))


def file_profile(spark: SparkSession, folder: str) -> DataFrame:
    # SQL does not know the size of a table's files.
    found = profile.file_profile(scan.scan_grid(spark, f"{folder}/lineitem.parquet"))
    return found.select("file_count", "row_count", "column_count", "estimated_chunks")


def field_profile(spark: SparkSession, folder: str) -> DataFrame:
    # Which rows the samples show depends on the read order, so they stay out of the comparison.
    return profile.field_profile(demo_grid(spark, folder)).drop("sample_values")


def field_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of a table of one row, which leave no choice."""
    found = profile.field_profile(scan.preview(few(spark, folder), 1, FEW))
    return found.select("name", F.col("sample_values")[0].alias("sample"))


def field_profile_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Null counts of a stored table from its files' statistics."""
    return profile.stored_field_profile(spark, f"{folder}/lineitem.parquet").drop("sample_values")


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return scan.preview(few(spark, folder), 100, FEW)


def drop_fields(spark: SparkSession, folder: str) -> DataFrame:
    return with_order(P.drop_fields(few(spark, folder), ["Slope", "Flood_Flag"]))


def add_constant_field(spark: SparkSession, folder: str) -> DataFrame:
    cells = few(spark, folder).select(S.AGE, "Slope")
    for name, dtype, default in (
        ("c_double", "Float64", "2.5"),
        ("c_float", "Float32", "0.5"),
        ("c_long", "Int64", "7"),
        ("c_int", "Int32", "-3"),
        ("c_text", "String", "urban"),
        ("c_true", "Boolean", "True"),
        ("c_false", "Boolean", "yes"),
        ("c_none", "String", "NULL"),
        ("Slope", "Float64", "1.5"),
    ):
        cells = P.add_constant_field(cells, name, dtype, default)
    bad = P.add_constant_field(cells, "c_bad", "Int32", "3.7")
    return bad.withColumn("c_bad", F.col("c_bad").isNull()).withColumn("c_float", number("c_float"))


def rename_fields(spark: SparkSession, folder: str) -> DataFrame:
    swapped = {"Slope": "Distance_from_River", "Distance_from_River": "Slope", "POP_2025": "People"}
    return with_order(P.rename_fields(few(spark, folder), swapped))


def reorder_fields(spark: SparkSession, folder: str) -> DataFrame:
    return with_order(
        P.manage_fields(few(spark, folder), {"Slope": "Steepness"}, ["POP_2025", "Steepness", "Built_Up_Age"])
    )


def order_fields_az(spark: SparkSession, folder: str) -> DataFrame:
    return with_order(P.order_fields_az(few(spark, folder)))


def order_fields_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return with_order(P.order_fields_by_type(few(spark, folder)))


def move_field(spark: SparkSession, folder: str) -> DataFrame:
    cells = P.move_field(few(spark, folder), "POP_2025", "top")
    cells = P.move_field(cells, "Built_Up_Age", "bottom")
    cells = P.move_field(cells, "Slope", "down")
    return with_order(P.move_field(cells, "Flood_Flag", "up"))


def ead_output_schema(spark: SparkSession, folder: str) -> DataFrame:
    grid = demo_grid(spark, folder)
    whole_codes = P.put_columns(grid, {name: field(name).cast("int") for name in S.CODE_COLUMNS})
    output = risk_output(whole_codes)
    types = ",".join(f"{name}:{kind}" for name, kind in output.dtypes)
    return output.select(*S.CODE_COLUMNS, number(S.HAZARD_EAD).alias(S.HAZARD_EAD), number(S.RISK).alias(S.RISK)).withColumn(
        "output_types", F.lit(types)
    )


def filter_valid_age(spark: SparkSession, folder: str) -> DataFrame:
    return valid_age(few(spark, folder))


def filter_by_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Several filters in one pass: each cell is counted under every filter it meets."""
    filters = {
        "developed": {"Developed": 1},
        "middle_income": {"Income_Classification": [2, 3]},
        "asia": {"Sovereig": 10},
        "newest": {S.AGE: 5},
        "older_than_30": {S.AGE: (">=", 35)},
        "older_developing_low_or_high_income": {"Developed": 2, "Income_Classification": [1, 4], S.AGE: (">=", 35)},
    }
    met = F.array_compact(F.array(*(F.when(matches(test), name) for name, test in filters.items())))
    cells = demo_grid(spark, folder).select(S.POPULATION, F.explode(met).alias("name"))
    return cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(S.POPULATION).alias("population")
    )


def filter_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """The grid stored along a space-filling order of its codes, then one country and age of it."""
    path = f"{work_folder(spark)}/grid"
    write_fields(demo_grid(spark, folder), path, [folder], cluster_by=layout.CODES)
    found = filter_codes(scan.scan_grid(spark, path), {S.COUNTRY.column: [110, 200], S.AGE: 25})
    return found.select(*S.CODE_COLUMNS, "Slope", S.POPULATION)


def scan_versioned(spark: SparkSession, folder: str) -> DataFrame:
    """A table published twice; the scan reads the second version."""
    path = f"{work_folder(spark)}/grid"
    cells = few(spark, folder)
    write_fields(valid_age(cells), path, [folder], versioned=True)
    write_fields(P.reorder_fields(cells, FEW[:3]), path, [folder], versioned=True)
    return scan.scan_grid(spark, path)


def filter_older_developing(spark: SparkSession, folder: str) -> DataFrame:
    criteria = {"Developed": 2, "Income_Classification": [1, 4], S.AGE: (">=", 35)}
    return filter_codes(demo_grid(spark, folder), criteria).select(
        S.AGE, "Developed", "Income_Classification", "Slope", S.POPULATION
    )


def _label(dim: S.Dimension) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        labels = demo_country_labels(spark, folder) if dim is S.COUNTRY else None
        labelled = with_label(demo_grid(spark, folder), dim, labels)
        return labelled.groupBy(dim.column, "Label").agg(
            F.count(F.lit(1)).alias("cells"), F.sum(S.POPULATION).alias("population")
        )

    return run


def ead(spark: SparkSession, folder: str) -> DataFrame:
    cells = with_ead(demo_grid(spark, folder))
    return cells.select(S.AGE, "Hazard_Index_RP010", number(S.HAZARD_EAD).alias(S.HAZARD_EAD))


def risk_index(spark: SparkSession, folder: str) -> DataFrame:
    grid = demo_grid(spark, folder)
    given = P.put_columns(grid, {S.HAZARD_EAD: number("Hazard_Index_RP100").cast("float")})
    return with_risk(given).select(S.AGE, S.EXPOSURE, number(S.RISK).alias(S.RISK))


def ead_and_risk(spark: SparkSession, folder: str) -> DataFrame:
    values = [number(S.HAZARD_EAD), number(S.RISK)]
    grouped = risk_output(demo_grid(spark, folder)).groupBy(S.AGE).agg(
        F.count(F.lit(1)).alias("cells"),
        *(
            make(value).alias(f"{kind}_{name}")
            for name, value in zip(("ead", "risk"), values)
            for kind, make in (("mean", F.avg), ("min", F.min), ("max", F.max))
        ),
    )
    return rounded(grouped)


def area_by_development(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.area_table(summarise(demo_grid(spark, folder), [S.DEVELOPMENT])))


def _labels_for(dim: S.Dimension, spark: SparkSession, folder: str) -> DataFrame | None:
    return demo_country_labels(spark, folder) if dim is S.COUNTRY else None


def _flood(dim: S.Dimension) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        state = summarise(demo_grid(spark, folder), [dim], flood=FLOOD)
        return rounded(T.flood_table(state, dim, _labels_for(dim, spark, folder)))

    return run


def _environment(dim: S.Dimension, exclude_zero: bool = True) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        state = summarise(demo_grid(spark, folder), [dim], moments=S.ENVIRONMENT, exclude_zero=exclude_zero)
        return rounded(T.environment_table(state, dim, _labels_for(dim, spark, folder)))

    return run


def _exposure(dim: S.Dimension) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        state = summarise(demo_grid(spark, folder), [dim], totals=[S.POPULATION, S.EXPOSED_POPULATION])
        return rounded(T.exposure_table(state, dim, _labels_for(dim, spark, folder)))

    return run


def _risk(dim: S.Dimension) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        cells = with_risk(with_ead(demo_grid(spark, folder)))
        state = summarise(cells, [dim], moments=[S.RISK], exclude_zero=False, extremes=True)
        return rounded(T.risk_table(state, dim, _labels_for(dim, spark, folder)))

    return run


def exposure_global(spark: SparkSession, folder: str) -> DataFrame:
    state = summarise(demo_grid(spark, folder), totals=[S.POPULATION, S.EXPOSED_POPULATION])
    return rounded(T.exposure_global_table(state))


def _yearly_state(spark: SparkSession, folder: str, dim: S.Dimension) -> DataFrame:
    return summarise(demo_grid(spark, folder), [dim], totals=[S.exposure_column(y) for y in S.YEARS])


def exposure_country_year(spark: SparkSession, folder: str) -> DataFrame:
    return T.country_year_table(_yearly_state(spark, folder, S.COUNTRY), demo_country_labels(spark, folder))


def exposure_country_year_long(spark: SparkSession, folder: str) -> DataFrame:
    return T.years_to_rows(exposure_country_year(spark, folder), "Country")


def exposure_country_rank(spark: SparkSession, folder: str) -> DataFrame:
    return T.country_rank_table(_yearly_state(spark, folder, S.COUNTRY), demo_country_labels(spark, folder))


def exposure_income_year(spark: SparkSession, folder: str) -> DataFrame:
    return T.income_year_table(_yearly_state(spark, folder, S.INCOME))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    state = summarise(demo_grid(spark, folder), [S.COUNTRY, S.CONTINENT, S.INCOME], keep_invalid=True)
    return T.run_summary(state, FLOOD)


def _moment_parts(spark: SparkSession, folder: str) -> DataFrame:
    return moment_sums(valid_age(demo_grid(spark, folder)), ["Sovereig", S.AGE], ["Slope", "Distance_from_River"])


def moments_partial(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_moment_parts(spark, folder), 4)


def moments_merged(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_moment_sums(_moment_parts(spark, folder), [S.AGE], ["Slope", "Distance_from_River"])
    return rounded(merged, 5)


def stream_ead(spark: SparkSession, folder: str) -> DataFrame:
    base = work_folder(spark)
    query = stream_risk(streaming_demo_grid(spark, folder), f"{base}/risk", f"{base}/checkpoint")
    finish(query)
    output = spark.read.parquet(f"{base}/risk")
    return output.select(S.AGE, number(S.HAZARD_EAD).alias(S.HAZARD_EAD), number(S.RISK).alias(S.RISK))


def stream_flood_by_development(spark: SparkSession, folder: str) -> DataFrame:
    base = work_folder(spark)
    cells = streaming_demo_grid(spark, folder)
    only = {"environment": [], "dims": [S.DEVELOPMENT], "totals": []}
    finish(stream_report_state(cells, f"{base}/state", f"{base}/checkpoint", FLOOD, **only))
    return rounded(T.flood_table(latest_report_state(spark, f"{base}/state"), S.DEVELOPMENT))


def stream_env_by_income(spark: SparkSession, folder: str) -> DataFrame:
    base = work_folder(spark)
    cells = streaming_demo_grid(spark, folder)
    only = {"exclude_zero": False, "dims": [S.INCOME], "totals": []}
    finish(stream_report_state(cells, f"{base}/state", f"{base}/checkpoint", None, **only))
    return rounded(T.environment_table(latest_report_state(spark, f"{base}/state"), S.INCOME))


# Batches, and about how many rows one of their files holds at most: more rows make more files, not larger ones.
ARRIVALS, FILE_ROWS = 5, 2_000_000


def _arrived(spark: SparkSession, folder: str, **only) -> str:
    """The grid as files that arrive in five batches, taken by a stream that merges every two segments."""
    base = work_folder(spark)
    lines = table(spark, folder, "lineitem")
    files = max(1, -(-lines.count() // (ARRIVALS * FILE_ROWS)))
    lines.repartitionByRange(ARRIVALS * files, "l_orderkey").write.parquet(f"{base}/lines")
    arriving = read_arriving(spark, f"{base}/lines", lines.schema, files_per_batch=files)
    cells = grid_from(arriving, table(spark, folder, "orders"), table(spark, folder, "customer"))
    finish(stream_report_state(cells, f"{base}/state", f"{base}/checkpoint", FLOOD, fan=2, **only))
    return f"{base}/state"


def _arrived_table(name: str, **only) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        state = _arrived(spark, folder, **only)
        return rounded(arrived_report(spark, state, demo_country_labels(spark, folder), FLOOD)[name])

    return run


def stream_risk_named(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of other names, given with the stream."""
    base = work_folder(spark)
    names = {S.EXPOSURE: "Exposed", S.VULNERABILITY: "Fragile", "Hazard_Index_RP010": "h10", "Hazard_Index_RP100": "h100"}
    cells = P.rename_fields(streaming_demo_grid(spark, folder), names)
    mapping = [(10, "h10"), (100, "h100")]
    finish(stream_risk(cells, f"{base}/risk", f"{base}/checkpoint", mapping, "Exposed", "Fragile"))
    output = spark.read.parquet(f"{base}/risk")
    return output.select(S.AGE, number(S.HAZARD_EAD).alias(S.HAZARD_EAD), number(S.RISK).alias(S.RISK))


def format_values(spark: SparkSession, folder: str) -> DataFrame:
    state = summarise(
        demo_grid(spark, folder), [S.INCOME], totals=[S.POPULATION, S.EXPOSED_POPULATION]
    )
    shares = T.exposure_table(state, S.INCOME).withColumn(
        "Exposure_Share", F.col("Exposure_Ratio_Percent") / 1e7
    )
    # A share below 0.0001 and a missing value complete the display cases.
    return format_report_values(shares.withColumn("Missing", F.lit(float("nan"))))


def report_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return build_report(demo_grid(spark, folder), demo_country_labels(spark, folder))[CATALOGUE]


def _report_table(name: str, shown: bool = False) -> Query:
    """One table of the report, all of which come from one shared state."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = build_report(demo_grid(spark, folder), demo_country_labels(spark, folder))[name]
        return display_text(name, table) if shown else rounded(table)

    return run


def exposure_years_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Long rows to one column per year."""
    valid = valid_age(demo_grid(spark, folder))
    long = valid.unpivot(["Sovereig"], [S.exposure_column(y) for y in S.YEARS], "Name", "Total")
    long = long.select("Sovereig", F.substring_index("Name", "_", -1).cast("int").alias("Year"), "Total")
    return T.years_to_columns(long.groupBy("Sovereig", "Year").agg(F.sum("Total").alias("Total")), "Sovereig")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "scan_grid": scan_grid,
        "scan_pruned": scan_pruned,
        "dataset_profile": dataset_profile,
        "file_profile": file_profile,
        "field_profile": field_profile,
        "field_profile_stored": field_profile_stored,
        "field_samples": field_samples,
        "preview": preview,
        **{key: _derive(expressions) for key, expressions in DERIVED.items()},
        "derive_graph": derive_graph,
        "drop_fields": drop_fields,
        "add_constant_field": add_constant_field,
        "rename_fields": rename_fields,
        "reorder_fields": reorder_fields,
        "order_fields_az": order_fields_az,
        "order_fields_by_type": order_fields_by_type,
        "move_field": move_field,
        "ead_output_schema": ead_output_schema,
        "filter_valid_age": filter_valid_age,
        "filter_by_codes": filter_by_codes,
        "filter_older_developing": filter_older_developing,
        "filter_clustered": filter_clustered,
        "scan_versioned": scan_versioned,
        "ead": ead,
        "risk_index": risk_index,
        "ead_and_risk": ead_and_risk,
        "area_by_development": area_by_development,
        "env_by_development_with_zeros": _environment(S.DEVELOPMENT, exclude_zero=False),
        "exposure_global": exposure_global,
        "exposure_country_year": exposure_country_year,
        "exposure_country_year_long": exposure_country_year_long,
        "exposure_country_rank": exposure_country_rank,
        "exposure_income_year": exposure_income_year,
        "run_summary": run_summary,
        "moments_partial": moments_partial,
        "moments_merged": moments_merged,
        "stream_ead": stream_ead,
        "stream_flood_by_development": stream_flood_by_development,
        "format_report_values": format_values,
        "report_catalogue": report_catalogue,
        "stream_env_by_income": stream_env_by_income,
        "stream_risk_named": stream_risk_named,
        "stream_delta_report": _arrived_table("C4_Env_Country"),
        "stream_delta_overview": _arrived_table(OVERVIEW, environment=[]),
        "exposure_years_wide": exposure_years_wide,
        "report_area": _report_table("A_Area_Stats"),
        "report_env_by_country": _report_table("C4_Env_Country"),
        "report_country_rank": _report_table("D2_Exp_Country_Year"),
        "report_overview": _report_table(OVERVIEW),
        "report_display_country_year": _report_table("D2_Exp_Country_Year", shown=True),
    }
    for dim in S.DIMENSIONS.values():
        found[f"label_{dim.name}"] = _label(dim)
        found[f"flood_by_{dim.name}"] = _flood(dim)
        found[f"env_by_{dim.name}"] = _environment(dim)
        found[f"exposure_by_{dim.name}"] = _exposure(dim)
        found[f"risk_by_{dim.name}"] = _risk(dim)
    return found
