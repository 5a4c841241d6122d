"""Text helpers as Column expressions; all stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Stripped, in lower case, white space made one space."""
    return F.regexp_replace(strip(F.lower(x)), r"(?U)\s+", " ")


def is_blank(x: Column) -> Column:
    return F.coalesce(~x.rlike(r"(?U)\S"), F.lit(True))


def tokens(x: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def python_float(x: Column) -> Column:
    """A double as Python's repr writes it (up to the digits that a plain decimal below 1e16 needs)."""
    big = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    digits = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", "")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    raw = x.cast("string")
    small = (F.abs(x) < 1e-3) & (F.abs(x) >= 1e-4) & (x != 0)
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.lower(raw), r"\.0e", "e"), r"e(-?)(\d)$", "e$10$2")
    exponent = F.regexp_replace(exponent, r"e(\d)", "e+$1")
    return F.when(big, digits).when(small, plain).when(raw.contains("E"), exponent).otherwise(raw)


def general(x: Column) -> Column:
    """A double with six significant digits, as printf's %g writes it."""
    raw = F.format_string("%.5e", x)
    power = F.regexp_extract(raw, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"^(.*)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    wide = F.concat(mantissa, F.lit("e"), F.regexp_extract(raw, r"e([+-]\d+)$", 1))
    fixed = F.concat(*[F.when(power == p, F.format_string(f"%.{5 - p}f", x)).otherwise(F.lit("")) for p in range(-4, 6)])
    fixed = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")).otherwise(fixed)
    return F.when(x == 0, F.when(x.cast("string").startswith("-"), F.lit("-0")).otherwise(F.lit("0"))).when((power < -4) | (power >= 6), wide).otherwise(fixed)
