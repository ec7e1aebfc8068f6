"""Scalar helpers shared by the rules."""

from pyspark.sql import Column, functions as F

from plantwatch.functions.times import as_column


def clamp(value, low, high) -> Column:
    """`value` held between two bounds; NULL stays NULL, which greatest() would skip."""
    value = as_column(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def real(value) -> Column:
    """NaN as NULL: both engines rank NaN above every number, a threshold must not."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def first_text(*columns) -> Column:
    """First alias that holds a non-blank text."""
    return F.coalesce(*[F.nullif(F.trim(as_column(c)), F.lit("")) for c in columns])


def first_number(*columns, default=None, limit: float = 2.0 ** 63) -> Column:
    """First alias that holds a number other than zero, cut to a whole number.

    The last alias counts even when it is zero. NaN and numbers of `limit` or more
    count as absent, so that one broken record can't end a stream.
    """
    texts = [as_column(c).try_cast("double") for c in columns]
    numbers = [F.when(F.abs(n) < limit, n) for n in texts]  # NaN is above every limit
    found = [F.nullif(n, F.lit(0.0)) for n in numbers[:-1]] + numbers[-1:]
    if default is not None:
        found.append(F.lit(float(default)))
    return F.coalesce(*found).cast("long")


def zero_if_null(value) -> Column:
    return F.coalesce(as_column(value), F.lit(0.0))


def percent(value) -> Column:
    return F.format_string("%.0f%%", as_column(value) * 100)


def rounded(value, places: int) -> Column:
    """Half up on the decimal digits. Going through a decimal first drops the binary
    noise of computed numbers, so that 0.125 held as 0.12499999999999 rounds up too.
    Numbers too large for that have no digits to round."""
    value = as_column(value)
    exact = F.round(value.try_cast("decimal(28,10)"), places).cast("double")
    return F.coalesce(exact, real(value.cast("double")))
