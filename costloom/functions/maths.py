"""Numeric expressions with the engine's null rules: an undefined ratio is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0)) if isinstance(a, str) else a / F.nullif(b, F.lit(0.0))


def pct(new: Column, old: Column) -> Column:
    """Change in percent; null where old is null or 0."""
    return (new / F.nullif(old, F.lit(0.0)) - 1) * 100


def shown(value: Column, suffix: str = "") -> Column:
    """Two decimals and a suffix; null is a dash."""
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string("%.2f", value), F.lit(suffix)))


def from_percent(text: Column) -> Column:
    """"12.3%" as 12.3; null where it isn't a number."""
    return F.regexp_replace(text, "%+$", "").try_cast("double")


def signed(v: Column, places: int = 1, suffix: str = "") -> Column:
    """The number with its sign, "+3.2%"; a dash for null."""
    return F.when(v.isNull(), "—").otherwise(F.concat(F.format_string(f"%+.{places}f", v.cast("double")), F.lit(suffix)))


def general(v: Column) -> Column:
    """Six significant digits without trailing zeros, as a price is written; from a million or under 0.0001 on with a power.

    Halves of the shortest decimal are rounded away from zero, as the JVM does.
    """
    x = v.cast("double")
    size = F.abs(x)
    exponent = F.floor(F.log10(F.when(size > 0, size)))
    exponent = F.when(F.round(size / F.pow(F.lit(10.0), exponent), 5) >= 10, exponent + 1).otherwise(exponent)
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    fixed = F.lit(None).cast("string")
    for e in range(-4, 6):
        fixed = F.when(exponent == e, trimmed(F.format_string(f"%.{5 - e}f", x))).otherwise(fixed)
    power = F.format_string("%s%s%02d", trimmed(F.format_string("%.5f", x / F.pow(F.lit(10.0), exponent))), F.when(exponent < 0, "e-").otherwise("e+"), F.abs(exponent))
    return F.when(x.isNull(), F.lit(None)).when(x == 0, "0").when(exponent.between(-4, 5), fixed).otherwise(power)
