"""Text cleaning and the six presence predicates, each by name (they disagree on purpose)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x, f) -> Column:
    """f of a value that is worked out and planned once, however often f names it."""
    return F.get(F.transform(F.array(col(x)), f), 0)


#: What Unicode calls white space, as (?U)\\s does.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.btrim(col(x), F.lit(BLANKS))


def whole(x, kind: str = "int") -> Column:
    """A number of digits, null for ''. A cast that fails throws and catches an exception each time, so '' never gets there."""
    return F.nullif(col(x), F.lit("")).try_cast(kind)


def text(x) -> Column:
    """Null and NaN text as '', else stripped text. [F33]"""
    v = F.coalesce(col(x).cast("string"), F.lit(""))
    # most values are stripped once: only what holds the mark is stripped to be compared with it
    return F.when(v.contains("NaN") & (strip(v) == "NaN"), "").otherwise(strip(v))


def _any_case(*words: str) -> list[str]:
    """The words in all mixtures of case: one lookup in a set, where a pattern would search each value."""
    return ["".join(w) for word in words for w in product(*((c, c.upper()) for c in word))]


def missing_default(x) -> Column:
    """Empty for defaults: '', nan, none, null; the absent mark is present. [P4]"""
    return F.lower(text(x)).isin("", "nan", "none", "null")


def missing_derive(x) -> Column:
    """Empty for derivation: as for defaults, and the absent mark. [P5]"""
    return F.lower(text(x)).isin("", "nan", "none", "null", ABSENT)


def missing_optimise(x, absent: bool = False) -> Column:
    """Missing for the row optimiser: '', nan, none, and the absent mark if asked. [P9]"""
    return F.lower(text(x)).isin("", "nan", "none", *([ABSENT] if absent else []))


def present_vote(x) -> Column:
    """Present for voting: not '', nan, none, nor the absent mark. [A1]"""
    return ~text(x).isin("", ABSENT, *_any_case("nan", "none"))


def empty_plain(x) -> Column:
    """Empty for merge, dedup and catalog: null, '' or the absent mark, exactly. [P6]"""
    return F.coalesce(col(x).isin("", ABSENT), F.lit(True))


def present_eval(x) -> Column:
    """Present for evaluation: not '', nan, nor the absent mark. [A12]"""
    return ~text(x).isin("", ABSENT, *_any_case("nan"))


def present_ceiling(x) -> Column:
    """As present_eval; none and zero are absent, too."""
    return ~text(x).isin("", ABSENT, "0", "0.0", *_any_case("nan", "none"))
