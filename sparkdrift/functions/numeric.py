"""Numeric expressions: cleaning, binning, probability tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(c: Column) -> Column:
    """Cast to double and turn NaN into NULL (Spark NaN would poison avg and sort last)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (ANSI division would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``value`` over [lo, hi]: the last edge ``lo + i*width`` that is <= value.

    The arithmetic guess is corrected against its neighbouring edges, so the result equals a search
    in the edge list bit for bit. The last bin is closed; a degenerate range is the single bin 0.
    """
    width = (hi - lo) / F.lit(float(bins))
    guess = F.floor(F.try_divide(value - lo, width)).cast("int")
    corrected = (
        F.when(value < lo + guess * width, guess - 1)
        .when(value >= lo + (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    return F.when(hi <= lo, F.lit(0)).otherwise(
        F.least(F.greatest(corrected, F.lit(0)), F.lit(bins - 1))
    )


def bin_edge(index: Column, lo: Column, hi: Column, bins: int) -> Column:
    return lo + index * ((hi - lo) / F.lit(float(bins)))


# Upper tail of the Kolmogorov distribution at z.lam; each branch uses the series that converges fast.
_KOLMOGOROV = f"""least(1D, greatest(0D, CASE
  WHEN z.lam <= 0.02D THEN 1D
  WHEN z.lam < 0.3D THEN 1D - {math.sqrt(2 * math.pi)!r}D / z.lam * aggregate(sequence(1, 100), 0D,
    (acc, k) -> acc + exp(-(2 * k - 1) * (2 * k - 1) * {math.pi**2 / 8!r}D / (z.lam * z.lam)))
  ELSE 2D * aggregate(sequence(1, 100), 0D,
    (acc, k) -> acc + if(k % 2 = 1, 1D, -1D) * exp(-2D * k * k * z.lam * z.lam)) END))"""


def ks_asymptotic_p(stat: str, n: str, m: str) -> Column:
    """Large-sample two-sided p-value with the published 1/sqrt(N) correction of the argument.

    The arguments are column names.
    """
    size = f"greatest(round(CAST({n} AS DOUBLE) * {m} / ({n} + {m})), 1D)"
    root = f"sqrt({size})"
    lam = f"{root} * {stat} + 1D / (6D * {root}) + ({root} * {stat} - 1D) / (4D * {size})"
    tail = f"transform(array(named_struct('lam', {lam})), z -> {_KOLMOGOROV})[0]"
    return F.expr(f"CASE WHEN {stat} <= 0 THEN 1D WHEN {stat} >= 1 THEN 0D ELSE {tail} END")


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: power series below 2.5, continued fraction above."""
    root_pi = F.lit(math.sqrt(math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda a, k: F.struct(
            (a["term"] * F.lit(2.0) * z * z / (F.lit(2.0) * k + 1)).alias("term"),
            (a["total"] + a["term"] * F.lit(2.0) * z * z / (F.lit(2.0) * k + 1)).alias("total"),
        ),
        lambda a: a["total"],
    )
    small = F.lit(1.0) - F.lit(2.0) / root_pi * F.exp(-z * z) * series
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda a, k: z + (k / F.lit(2.0)) / a
    )
    large = F.exp(-z * z) / root_pi / fraction
    return F.when(z < F.lit(2.5), small).otherwise(large)


def chi2_sf(stat: Column, dof: Column) -> Column:
    """P(X > stat) for integer dof, as the finite sum of the regularised upper gamma function.

    Terms are carried as logarithms and summed relative to the largest one so far, so neither a large
    statistic nor many degrees of freedom underflow.
    """
    half = stat / F.lit(2.0)
    even = dof % 2 == 0
    # First term of the sum and the denominators of the following ones: i for even dof, i + 1/2 else.
    first = F.when(even, -half).otherwise(
        -half + F.log(half) / 2 - F.lit(math.log(math.sqrt(math.pi) / 2))
    )
    last = F.when(even, dof / 2 - 1).otherwise((dof - 1) / 2 - 1).cast("int")
    shift = F.when(even, F.lit(0.0)).otherwise(F.lit(0.5))
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log(half / (i + shift))
        top = F.greatest(a["top"], term)
        return F.struct(
            term.alias("term"),
            top.alias("top"),
            (a["total"] * F.exp(a["top"] - top) + F.exp(term - top)).alias("total"),
        )

    total = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("top"), F.lit(1.0).alias("total")),
        add,
        lambda a: F.exp(a["top"] + F.log(a["total"])),
    )
    odd_tail = erfc(F.sqrt(half)) + F.when(dof > 1, total).otherwise(F.lit(0.0))
    tail = F.when(even, total).otherwise(odd_tail)
    return F.when(stat <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
