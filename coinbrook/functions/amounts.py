"""Amounts: from text to double, and sums that do not depend on row order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"

# Amounts below the limit are added as whole millionths, so a sum of money is exact and the same
# whatever the task order. What the millionths leave over (exactly nothing for amounts of up to six
# decimal places) and the amounts beyond the limit, infinities among them, are added as doubles.
PER_ONE = 1_000_000
UNIT_LIMIT = 1e9

# A long could overflow in the sum of 10^12 rows. The low bits are summed on their own.
_LOW_BITS = 20


def nan_to_null(amount: Column) -> Column:
    return F.when(~F.isnan(amount), amount)


def parse_amount(text: Column) -> Column:
    """Text (or number) to double; NULL where it is no number, NaN included."""
    text = text.cast("string")
    number = text.try_cast("double")
    # A finite literal too large for a double is no number either.
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.when(text.rlike(NUMBER_PATTERN), finite).when(text.rlike(INFINITY_PATTERN), number)


def coerce_amount(text: Column) -> Column:
    """Text to double, with 0.0 for everything that is no number."""
    return F.coalesce(parse_amount(text), F.lit(0.0))


def is_finite(amount: Column) -> Column:
    """True for a number that is neither NaN nor infinite; False for NULL."""
    return F.coalesce(F.abs(amount) < float("inf"), F.lit(False))


def units(amount: Column) -> Column:
    """The amount in millionths as a long, NULL for one beyond the limit."""
    return F.rint(F.when(F.abs(amount) < UNIT_LIMIT, amount) * PER_ONE).cast("bigint")


def beyond_units(amount: Column) -> Column:
    """What ``units`` leaves of the amount: the rest below a millionth, or all of an amount beyond
    the limit (NaN gives NULL)."""
    rest = amount - units(amount) / F.lit(float(PER_ONE))
    return F.when(F.abs(amount) < UNIT_LIMIT, rest).when(~F.isnan(amount), amount)


def join_units(total_units: Column, total_beyond: Column) -> Column:
    """Both parts of a sum as one double; a missing part counts as nothing."""
    exact = (total_units * F.lit(Decimal(1) / PER_ONE)).cast("double")
    return F.coalesce(exact, F.lit(0.0)) + F.coalesce(total_beyond, F.lit(0.0))


def money_parts(amount: Column) -> tuple[Column, Column, Column]:
    """What is to be summed, each part on its own, for ``money_total``. Sums of longs and doubles
    run several times faster than sums of decimals."""
    whole = units(amount)
    low = whole.bitwiseAND(F.lit(2**_LOW_BITS - 1))
    return F.shiftright(whole, _LOW_BITS), low, beyond_units(amount)


def money_total(high: Column, low: Column, beyond: Column) -> Column:
    """The sum as a double, from the sums of the parts."""
    whole = high.cast("decimal(30,0)") * F.lit(2**_LOW_BITS) + low
    return join_units(whole.cast("decimal(31,0)"), beyond)


def money_sum(amount: Column) -> Column:
    """Aggregate: NULL and NaN are skipped, a group without any amount gives 0.0."""
    return money_total(*[F.sum(part) for part in money_parts(amount)])


def money_mean(amount: Column) -> Column:
    """Aggregate: mean of the amounts present, NULL for a group without any."""
    present = F.count(nan_to_null(amount))
    return F.when(present > 0, money_sum(amount) / present)
