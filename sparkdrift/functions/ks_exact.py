"""Two-sample Kolmogorov-Smirnov p-values, asymptotic or counted, one aggregated row per feature."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdrift.functions.numeric import ks_asymptotic_p

def lattice_tail_function():
    """Build the tail function with everything it needs inside, so that it can be shipped by value
    and executors need nothing but NumPy."""
    import math

    import numpy as np

    def lattice_tail(stat: float, n: int, m: int) -> float:
        """P(D >= stat) when both samples share one law.

        Every merged ordering is a lattice path from (0,0) to (n,m) and all paths are equally likely.
        Row by row we keep, scaled, the weight of paths that stay strictly inside the band
        |i/n - j/m| < stat; one row is a running sum, so the loop is vectorised over j.
        """
        common = math.lcm(n, m)
        step_i, step_j = common // n, common // m
        band = round(stat * common)
        if band <= 0:
            return 1.0
        j = np.arange(m + 1, dtype=np.int64) * step_j
        row = (np.abs(j) < band).astype(float)
        for i in range(1, n + 1):
            shrink = i / (i + m)
            inside = np.abs(i * step_i - j) < band
            row = np.cumsum(np.where(inside, shrink * row, 0.0)) * inside
        return float(min(1.0, max(0.0, 1.0 - row[-1])))

    return lattice_tail


def _exact_p_udf():
    tail = lattice_tail_function()

    def exact(stat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series(
            [
                None if pandas.isna(d) else tail(float(d), int(a), int(b))
                for d, a, b in zip(stat, n, m)
            ],
            dtype="float64",
        )

    return F.pandas_udf(exact, "double")


def ks_p_value(stat: str, n: str, m: str, mode: str = "asymptotic") -> Column:
    """P-value from columns holding the statistic and both sizes, by the one method that ``mode`` names.

    ``asymptotic`` stays JVM-side. ``exact`` counts lattice paths for samples of any size; its work grows
    with the product of both sizes, so it is for small samples.
    """
    if mode == "asymptotic":
        return ks_asymptotic_p(stat, n, m)
    if mode != "exact":
        raise ValueError("mode must be 'asymptotic' or 'exact'")
    inside = F.expr(f"{stat} > 0 AND {stat} < 1")
    counted = _exact_p_udf()(F.when(inside, F.col(stat)), F.when(inside, F.col(n)), F.when(inside, F.col(m)))
    return F.when(inside, counted).otherwise(ks_asymptotic_p(stat, n, m))
