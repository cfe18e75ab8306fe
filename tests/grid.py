"""A small cell table with every edge case, and report results by plain loops over it."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd

from gridtide import schema as S

COUNTRIES = {100: "Indonesia", 108: "India", 109: "China", 200: "China"}
NAN = float("nan")


def make_cells(rows: int = 900, seed: int = 7, hot: bool = False) -> pd.DataFrame:
    """Random cells; with ``hot`` a third of them share all codes."""
    rng = np.random.default_rng(seed)
    cells = pd.DataFrame(
        {
            S.AGE: rng.choice([0, 5, 10, 25, 50, 55], rows),
            "Developed": rng.choice([1.0, 2.0, 3.0, NAN, 1.5], rows),
            "Income_Classification": rng.choice([0.0, 1.0, 2.0, 4.0, 5.0, NAN], rows),
            "Sovereig": rng.choice([10.0, 11.0, 16.0, 17.0, NAN], rows),
            "Country": rng.choice([100.0, 108.0, 109.0, 109.5, 200.0, 341.0, 999.7, NAN], rows),
            "Slope": rng.choice([0.0, 1.5, NAN, 7.25, -2.0], rows),
            "DEM": 1e6 + rng.normal(0, 0.01, rows),
            "Distance_from_River": np.where(rng.random(rows) < 0.2, NAN, rng.integers(0, 900, rows)),
            "Flooded_100": rng.choice(["1", " 1 ", "1.0", "0", "abc", "", "1d", "2"], rows),
            "POP_2025": rng.choice([0.0, 10.0, 25.0, NAN], rows),
        }
    )
    for year in S.YEARS:
        cells[S.exposure_column(year)] = rng.choice([0.0, 1.0, 8.0, NAN], rows)
    if hot:
        third = rows // 3
        for name, value in ((S.AGE, 5), ("Developed", 1.0), ("Income_Classification", 2.0), ("Sovereig", 10.0), ("Country", 109.0)):
            cells.loc[: third - 1, name] = value
    cells.loc[cells[S.AGE] == 50, ["POP_2025"]] = 0.0
    cells.loc[cells[S.AGE] == 50, ["Slope"]] = NAN
    return cells


def label_of(dim: S.Dimension, code: float) -> str | None:
    if math.isnan(code):
        return None
    if dim.labels is not None:
        return dim.labels.get(code)
    return COUNTRIES.get(int(code), f"Country_{int(code)}")


def groups(cells: pd.DataFrame, dim: S.Dimension) -> dict[tuple[bool, str, int], pd.DataFrame]:
    members = defaultdict(list)
    for at, (age, code) in enumerate(zip(cells[S.AGE], cells[dim.column])):
        if age in S.AGES:
            members[True, "All", age].append(at)
            label = label_of(dim, code)
            if label is not None:
                members[False, label, age].append(at)
    return {key: cells.iloc[rows] for key, rows in members.items()}


def is_flooded(text: str) -> bool:
    try:
        return float(text) == 1
    except ValueError:
        return False
