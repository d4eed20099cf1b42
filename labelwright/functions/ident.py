"""Product identifiers: EAN-13, SKU and digit cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presence import col, let, text


def only_digits(x) -> Column:
    return F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "[^0-9]", "")


def digits(x) -> Column:
    """Digits of a value; missing marks give ''; a trailing .0 of a number read as float goes. [F1]"""
    return only_digits(F.regexp_replace(text(x), r"^([0-9]+)\.0$", "$1"))


def check_digit(prefix) -> Column:
    """EAN-13 check digit of twelve digits, as text; null for anything else. [F2]"""
    # by the codes of the digits, as a cast of text costs more: 48 for each, 24 times
    total = lambda p: sum((F.ascii(F.substring(p, i, 1)) * (1 if i % 2 else 3) for i in range(2, 13)), F.ascii(F.substring(p, 1, 1))) - 24 * 48
    return let(prefix, lambda p: F.when(p.rlike("^[0-9]{12}$"), F.substring(F.lit("09876543210"), total(p) % 10 + 1, F.lit(1))))


def ean_valid(code) -> Column:
    """Thirteen digits whose last is the check digit of the others. [F2]"""
    return let(code, lambda c: F.coalesce(c.rlike("^[0-9]{13}$") & (check_digit(F.substring(c, 1, 12)) == F.substring(c, 13, 1)), F.lit(False)))


def _single_fix(d: Column) -> Column:
    """The first valid code that differs in one digit, by place, then by digit."""
    made = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.substring(d, F.lit(1), i - 1), k.cast("string"), F.substring(d, i + 1, F.lit(13)))))
    return F.get(F.filter(F.flatten(made), lambda c: ean_valid(c)), 0)


def repair_ean(raw, append_12: bool = True, drop_14: bool = True, one_digit: bool = False) -> Column:
    """Valid code; else 12 digits and their check digit; 14 digits without the last, then without the first; one digit changed. '' if none. [F3]"""

    def fix(d: Column) -> Column:
        ways = [F.when(ean_valid(d), d)]
        if append_12:
            ways.append(F.when(F.length(d) == 12, F.concat(d, check_digit(d))))
        if drop_14:
            ways += [F.when((F.length(d) == 14) & ean_valid(cut), cut) for cut in (F.substring(d, 1, 13), F.substring(d, 2, 13))]
        if one_digit:
            ways.append(F.when(F.length(d) == 13, _single_fix(d)))
        return F.coalesce(*ways, F.lit(""))

    return let(digits(raw), fix)


def normal_ean(raw, repair: bool = False, append_12: bool = False, drop_14: bool = True, one_digit: bool = False) -> Column:
    """Valid EAN-13 or ''; repairs only if asked. [F3]"""
    if repair:
        return repair_ean(raw, append_12, drop_14, one_digit)
    return let(digits(raw), lambda d: F.when(ean_valid(d), d).otherwise(""))


def repair_ean_legacy(raw) -> Column:
    """The older order: 14 digits without the first, then without the last; then one digit changed; null if none. [F4]"""

    def fix(d: Column) -> Column:
        return F.coalesce(
            F.when(ean_valid(d), d),
            F.when(F.length(d) == 12, F.concat(d, check_digit(d))),
            *(F.when((F.length(d) == 14) & ean_valid(cut), cut) for cut in (F.substring(d, 2, 13), F.substring(d, 1, 13))),
            F.when(F.length(d) == 13, _single_fix(d)),
        )

    return let(only_digits(raw), fix)


def scanner_barcode(raw, strict: bool = False, repair: bool = False) -> Column:
    """Digits with 12 or 14 of them repaired if possible; strict: a valid EAN-13 or ''. [F5]"""
    if strict:
        return normal_ean(only_digits(raw), repair, append_12=repair)
    return let(only_digits(raw), lambda d: F.when(F.length(d).isin(12, 14), F.coalesce(repair_ean_legacy(d), d)).otherwise(d))


def sku_valid(raw) -> Column:
    """Twelve digits that begin with 2. [F6]"""
    return digits(raw).rlike("^2[0-9]{11}$")


def normal_sku(raw) -> Column:
    return F.regexp_extract(digits(raw), "^2[0-9]{11}$", 0)


def loose_sku(raw) -> Column:
    """Ten to thirteen digits, as catalogs hold them. [F6]"""
    return F.regexp_extract(only_digits(raw), "^[0-9]{10,13}$", 0)


def truth_barcode(raw, drop_trailing_zero: bool = True) -> Column:
    """Digits padded with zeros to 13; 14 digits that end in 0 lose it if the rest is valid. [F7]"""

    def fix(d: Column) -> Column:
        padded = F.when((d != "") & (F.length(d) < 13), F.lpad(d, 13, "0")).otherwise(d)
        if not drop_trailing_zero:
            return padded
        return F.when((F.length(d) == 14) & d.endswith("0") & ean_valid(F.substring(d, 1, 13)), F.substring(d, 1, 13)).otherwise(padded)

    return let(digits(raw), fix)


def long_digits(raw, least: int = 8) -> Column:
    """The digits of a value if there are at least `least`, else ''. [F8]"""
    d = only_digits(raw)
    return F.when(F.length(d) >= least, d).otherwise("")
