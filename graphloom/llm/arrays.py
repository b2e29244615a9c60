"""Bounded results on the driver, as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a result of bounded size; it comes by Arrow, without an object for each row."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}
