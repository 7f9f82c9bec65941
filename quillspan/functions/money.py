"""Exact sums over two-decimal amounts stored as doubles.

A double sum depends on the order rows are added in, so it changes with the
partitioning and loses cents once totals pass about 1e13. A decimal sum is exact
but leaves the fast path of code generation. Here each amount becomes an integer
count of ten-thousandths, held as two bigint columns that are summed apart: the
whole units and the remainder below one unit. Neither total can overflow below
9.2e14 rows (remainder) or a sum of 9.2e18 whole units, where one bigint of
ten-thousandths would overflow after some 1e10 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cent is 1/100 and a cent times a percent is 1/10000.
CENTS = 100
SCALE = 10_000


#: Largest price whose count of ten-thousandths fits a bigint.
MOST = 9.2e14
#: Below this two neighbouring doubles are less than a hundredth apart, so a double names one hundredth.
FINE = float(1 << 46)


def hundredths(value: Column, low: float, high: float, name: str) -> Column:
    """``value`` as an exact bigint count of hundredths.

    Raises on NaN, infinity, values outside ``low`` to ``high`` and values that aren't a
    whole hundredth, in the expression itself, whatever ``spark.sql.ansi.enabled`` says.
    From ``FINE`` on only whole numbers are taken.
    """
    nearest = F.rint(value * CENTS)
    fine = F.abs(value) < FINE
    exact = F.when(fine, nearest / CENTS == value).otherwise(F.rint(value) == value)
    count = F.when(fine, nearest.cast("bigint")).otherwise(value.cast("bigint") * CENTS)
    told = F.concat(F.lit(f"{name} is not a whole hundredth from {low:g} to {high:g}: "), value.cast("string"))
    # NaN compares above every number, so it fails the range.
    valid = value.between(low, high) & exact
    return F.when(value.isNull(), F.lit(None).cast("bigint")).when(valid, count).otherwise(F.raise_error(told).cast("bigint"))


def discounted(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` as a bigint count of ten-thousandths, exactly.

    Prices go up to ``MOST`` either way, discounts from 0 to 1, both in whole hundredths; others raise.
    """
    return hundredths(price, -MOST, MOST, "price") * (F.lit(CENTS) - hundredths(discount, 0.0, 1.0, "discount"))


def whole_units(amount: Column) -> Column:
    """Whole units of a ten-thousandths amount, cut towards zero."""
    return F.call_function("div", amount, F.lit(SCALE))


def remainder(amount: Column) -> Column:
    """Ten-thousandths left over by :func:`whole_units`, with the amount's sign."""
    return amount % SCALE


def to_decimal(whole: Column, rest: Column) -> Column:
    """Put summed whole units and summed remainders together, exactly."""
    return (whole.cast("decimal(20,0)") + rest.cast("decimal(20,0)") / SCALE).cast("decimal(26,4)")
