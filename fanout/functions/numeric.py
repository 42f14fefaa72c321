"""Integer arithmetic and byte-size expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncating_div(a: Column, b: Column) -> Column:
    """Integer division rounding toward zero: -7 div 2 is -3."""
    return F.call_function("div", a, b)


def exact(c: Column) -> Column:
    """DECIMAL(38,0): sums of 64-bit values never overflow and never round."""
    return c.cast("decimal(38,0)")


# Size letters in steps of 1024, as a JVM prints them and as caps are written.
JVM_LETTERS = "BKMGT"
CAP_LETTERS = " kmg"


def jvm_size(token: Column) -> Column:
    """Bytes from text like ``256M``; the unit is mandatory, anything else is null."""
    text = F.trim(token)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)[BKMGT]$", 1).try_cast("double")
    step = F.instr(F.lit(JVM_LETTERS), F.right(text, F.lit(1))) - 1
    return F.floor(number * F.pow(F.lit(1024.0), step)).cast("long")


def cap_bytes(token: Column) -> Column:
    """Bytes from a container cap like ``24g`` or a bare count; null if it is neither or too big."""
    pattern = r"^([0-9]+)\s*([kmg]?)$"
    text = F.lower(F.trim(token))
    number = F.regexp_extract(text, pattern, 1).try_cast("long")
    step = F.greatest(F.instr(F.lit(CAP_LETTERS), F.regexp_extract(text, pattern, 2)) - 1, F.lit(0))
    return F.try_multiply(number, F.pow(F.lit(1024.0), step).cast("long"))
