"""Number columns: rounding rules, clamping, sizes, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Value, low: Value, high: Value) -> Column:
    """x held between low and high; where they cross, low wins."""
    return F.greatest(F.least(col(x), col(high)), col(low))


def half_even(x: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("bigint")


def half_up(x: Column) -> Column:
    """The nearest integer, halves towards plus infinity."""
    return F.floor(x.cast("double") + 0.5)


def halved(x: Column) -> Column:
    """x // 2 for integers, rounded down."""
    return F.floor(x / F.lit(2.0))


def lerp(a: Value, b: Value, t: Value) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def palette_slot(ident: Column, size: int = 12) -> Column:
    """0-based slot of a 1-based id; null, 0 and negative ids take the first."""
    n = F.coalesce(F.nullif(ident, F.lit(0)), F.lit(1))
    return F.pmod(F.greatest(n - 1, F.lit(0)), F.lit(size)).cast("int")


def caption_um(width: Column) -> Column:
    """A width to the nearest 50."""
    return half_even(width / 50) * 50


#: Unit names in order of powers of 1024.
UNITS = ("B", "KB", "MB", "GB", "TB")


def bytes_human(n: Column) -> Column:
    """1536 -> 1.5 KB: one decimal below 10 of a unit, none for bytes; null and 0 are 0 B."""
    n = n.cast("double")
    out = F.format_string("%.0f B", n)
    for i, unit in enumerate(UNITS[1:], start=1):
        v = n / float(1024**i)
        # printf halves to even on the binary value, as a fixed-point rendering of the double does
        shown = F.when(v >= 10, F.format_string(f"%.0f {unit}", v)).otherwise(F.format_string(f"%.1f {unit}", v))
        out = F.when(n >= float(1024**i), shown).otherwise(out)
    return F.when(n.isNull() | (n == 0), "0 B").otherwise(out)


def finite(text: Column) -> Column:
    """A finite number from any value, or null."""
    n = text.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n)
