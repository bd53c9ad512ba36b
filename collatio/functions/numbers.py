"""Rounding as the exports need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """A double to some decimals: the nearer one, and the even one at a tie.

    Nearness is that of the exact binary value, so 0.15 (which lies a little
    below) gives 0.1 and 2.675 gives 2.67, unlike round and bround.  For values
    below 2 ** 30 and at most 4 digits; nulls stay.
    """
    size = F.abs(value)
    whole = F.floor(size * float(1 << 20))
    # multiples of 2 ** -72 hold every value that does not round to 0
    rest = F.floor((size * float(1 << 20) - whole) * float(1 << 52))
    number = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    units = (whole.cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(17,0)") + rest.cast("decimal(17,0)")).cast("decimal(34,0)")
    scaled = (units * F.lit(10**digits).cast("decimal(5,0)")).cast("decimal(38,0)")
    down = F.floor(scaled / number(1 << 72)).cast("long")
    # division rounds: the remainder tells the true quotient
    over = (scaled - (F.lit(1 << 36).cast("decimal(12,0)") * (down.cast("decimal(18,0)") * F.lit(1 << 36).cast("decimal(12,0)")).cast("decimal(30,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")
    half = number(1 << 71)
    up = F.when(over > half, 1).when(over < half, 0).otherwise(F.pmod(down, F.lit(2)))
    return F.signum(value) * (down + up) / float(10**digits)
