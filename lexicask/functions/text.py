"""Tokenising and byte formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: runs of alphabetic or numeric characters are tokens.
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Array of the tokens of a text in order; case is kept. Null: no tokens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB of 1024, two decimals above B: of the exact quotient, halves to the even digit, as C's printf has them."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for bits, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= 1 << bits, F.concat(_two_decimals(n, bits), F.lit(f" {unit}"))).otherwise(out)
    return out


def _two_decimals(n: Column, bits: int) -> Column:
    """n / 2**bits for n >= 0, as text. format_string would round halves up; n is rounded to a double first, as by the division of doubles."""
    size, whole = 1 << bits, n.cast("double").cast("long")
    scaled = whole.bitwiseAND(F.lit(size - 1)) * 100  # hundredths of what is left of the whole units, in 2**bits parts
    odd = F.shiftright(scaled, bits).bitwiseAND(F.lit(1))
    hundredths = F.shiftright(whole, bits) * 100 + F.shiftright(scaled + (size // 2 - 1) + odd, bits)
    return F.format_string("%d.%02d", F.call_function("div", hundredths, F.lit(100)), hundredths % 100)
