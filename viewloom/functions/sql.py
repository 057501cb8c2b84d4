"""Functions for use in SQL text: scalar ones that Catalyst inlines, and an aggregate over a pair's cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Name and arguments, and what is returned.
FUNCTIONS = {
    "n_log_n(n DOUBLE)": "CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END",
    "pairs_of(n DOUBLE)": "n * (n - 1) / 2",
    "mi_term(n DOUBLE, a DOUBLE, b DOUBLE, total DOUBLE)": "n / total * (ln(n) + ln(total) - ln(a) - ln(b))",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    spark.udf.register("mi_of_cells", mi_of_cells)


def _mi(i: pd.Series, j: pd.Series, n: pd.Series) -> float:
    n = n.to_numpy(float)
    (_, x), (_, y) = (np.unique(v.to_numpy(), return_inverse=True) for v in (i, j))
    of = lambda t: t[t > 0] @ np.log(t[t > 0])
    total = n.sum()
    return float((of(n) - of(np.bincount(x, n)) - of(np.bincount(y, n))) / total + np.log(total)) if total else None


@F.pandas_udf(DoubleType())
def mi_of_cells(i: pd.Series, j: pd.Series, n: pd.Series) -> float:
    """MI of a contingency table, one row per cell (i, j, n): GROUP BY over counted cells, of which a pair has centroids squared at most."""
    return _mi(i, j, n)
