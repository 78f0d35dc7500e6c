"""Number rules that differ between report writers and Spark defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column) -> Column:
    """Round to a whole number with ties towards positive infinity."""
    return F.floor(value + F.lit(0.5))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division: x/0 is Infinity, 0/0 is NaN, never an error."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return (
        F.when((d == 0) & (n == 0), F.lit(float("nan")))
        .when(d == 0, F.lit(float("inf")))
        .otherwise(n / F.nullif(d, F.lit(0.0)))
    )


def at_least(factor: Column, threshold: float) -> Column:
    """``factor >= threshold``; NaN, which Spark sorts last, is never at least anything."""
    return (factor >= F.lit(threshold)) & ~F.isnan(factor)


# Bound values: a = |x|, high = its fraction cut at 26 bits, shifted = high in
# units of the last digit plus a half, units = the rounded fraction.
_FIXED = """
x -> CASE
  WHEN isnan(x) THEN 'NaN'
  WHEN abs(x) = double('Infinity') THEN if(x < 0, '-Infinity', 'Infinity')
  WHEN abs(x) >= {whole} THEN concat(if(x < 0, '-', ''), cast(cast(abs(x) AS decimal(38,0)) AS string), '.{zeros}')
  ELSE concat(if(x < 0, '-', ''),
    get(transform(array(abs(x)), a ->
    get(transform(array(floor((a - floor(a)) * {split}) / {split}), high ->
    get(transform(array(high * {scale}D + 0.5D), shifted ->
    get(transform(array(floor(shifted)
                        + if((a - floor(a) - high) * {scale}D >= 1D - (shifted - floor(shifted)), 1, 0)), units ->
      concat(cast(floor(a) + if(units >= {scale}, 1, 0) AS string), '.',
             lpad(cast(units % {scale} AS string), {digits}, '0'))
    ), 0)), 0)), 0)), 0))
END
"""
# A double from 2^53 on has no fraction.
_WHOLE = "9007199254740992D"
# Splitting a fraction at 26 bits leaves parts whose products are exact.
_SPLIT = "67108864D"


def to_fixed(value: Column, digits: int) -> Column:
    """Decimal text of the exact binary value with one to three digits, ties away from zero.

    The built-in formats round the shortest decimal text of a double, which
    turns values just below a tie into ties.  Here the fraction is split into a
    high and a low part, so scaling either is exact and the low part decides
    what the high part leaves open.
    """
    text = _FIXED.format(scale=10**digits, digits=digits, zeros="0" * digits, whole=_WHOLE, split=_SPLIT)
    shown = F.call_function("transform", F.array(value.cast("double")), F.expr(text))
    return F.when(value.isNotNull(), F.get(shown, F.lit(0)))
