"""Security and entity identifiers: check digits and validity as column expressions, and builders of operational ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(code: Column) -> Column:
    """Digits as 0-9, letters as 10-35, * @ # as 36-38, one for each character."""
    return F.transform(F.filter(F.split(F.upper(code), ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.locate("*", c) * 36 + F.locate("@", c) * 37 + F.locate("#", c) * 38))


def _fold(values: Column, step) -> Column:
    """Sum of step(value, index) over an array."""
    pairs = F.transform(values, lambda v, i: step(v, i))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v.cast("int"))


def _expanded(code: Column) -> Column:
    """Letters written out as two digits."""
    return F.array_join(F.transform(_values(code), lambda v: v.cast("string")), "")


def isin_check_digit(body: Column) -> Column:
    """Luhn over the expansion of the first eleven characters."""
    d = F.reverse(F.filter(F.split(_expanded(body), ""), lambda c: c != ""))
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda a, v: a + v)
    return (F.lit(10) - total % 10) % 10


def cusip_check_digit(body: Column) -> Column:
    def step(v: Column, i: Column) -> Column:
        w = F.when(i % 2 == 1, v * 2).otherwise(v)
        return F.floor(w / 10) + w % 10

    return (F.lit(10) - _fold(_values(body), step) % 10) % 10


def sedol_check_digit(body: Column) -> Column:
    weights = F.array(*map(F.lit, (1, 3, 1, 7, 3, 9)))
    return (F.lit(10) - _fold(_values(body), lambda v, i: v * F.get(weights, i)) % 10) % 10


def lei_remainder(code: Column) -> Column:
    """The expansion modulo 97, digit by digit: 1 for a valid code."""
    d = F.filter(F.split(_expanded(code), ""), lambda c: c != "")
    return F.aggregate(d, F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def lei_check_digits(body: Column) -> Column:
    return F.lpad((F.lit(98) - lei_remainder(F.concat(body, F.lit("00")))).cast("string"), 2, "0")


def _ends(code: Column, pattern: str, n: int, digit: Column) -> Column:
    return code.rlike(pattern) & (F.substring(code, n, 1) == digit.cast("string"))


def is_isin(code: Column) -> Column:
    return _ends(code, "^[A-Z]{2}[A-Z0-9]{9}[0-9]$", 12, isin_check_digit(F.substring(code, 1, 11)))


def is_cusip(code: Column) -> Column:
    return _ends(code, "^[A-Z0-9*@#]{8}[0-9]$", 9, cusip_check_digit(F.substring(code, 1, 8)))


def is_sedol(code: Column) -> Column:
    return _ends(code, "^[B-DF-HJ-NP-TV-Z0-9]{6}[0-9]$", 7, sedol_check_digit(F.substring(code, 1, 6)))


def is_lei(code: Column) -> Column:
    return code.rlike("^[A-Z0-9]{18}[0-9]{2}$") & (lei_remainder(code) == 1)


def base36(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 36)


# Formats of statements, in order.
FORMATS = ("MT940", "MT950", "CAMT053")


def feed_id(source: Column, data_type: Column) -> Column:
    return F.concat_ws("-", F.lit("FD"), source, data_type)


def delivery_id(source: Column, data_type: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lit("DLV"), feed_id(source, data_type), F.date_format(day, "yyyyMMdd"))


def statement_format(source: Column) -> Column:
    return F.get(F.array(*map(F.lit, FORMATS)), (F.substring(source, 4, 20).cast("int") % len(FORMATS)))


def numbered(prefix: str, width: int, base: int, index: Column) -> Column:
    """An id that goes on after `base` others: index 0 gives base + 1."""
    return F.concat(F.lit(prefix), F.lpad((index + base + 1).cast("string"), width, "0"))
