"""Prices as text and as numbers. The parsers differ in what they accept; each keeps its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT
from .presence import col, empty_plain, let, missing_derive, text, whole

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
# Letters that are read in place of digits, and the digits meant.
LOOKALIKES = ("OoОоIl|SsBЗз", "000011155833")
#: A lookalike in one token with what makes it a number.
MIXED = rf"(?U)[{LOOKALIKES[0]}]\S*[0-9.,:%₽]|[0-9.,:%₽]\S*[{LOOKALIKES[0]}]"
#: A number with grouped or plain whole part and at most two decimals.
PRICE = r"(?<![0-9])([0-9]{1,3}(?:[\s ]?[0-9]{3})+|[0-9]{1,6})(?:[,.\-]([0-9]{1,2}))?(?![0-9])"
DATE = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})\s+([0-9]{1,2})[:.]([0-9]{2})"
CODE = r"(?U)\b[0-9]{2}\s*_\s*[0-9]{3,6}(?:\s*[-–]\s*[0-9]{3,6})?\b"


def number(x) -> Column:
    """A plain decimal number, or null (so no exponent, no underscore, no trailing letter). [F12]"""
    return F.nullif(F.regexp_extract(col(x), NUMBER, 0), F.lit("")).try_cast("double")


def compact(x) -> Column:
    """Stripped, without spaces, a comma read as a dot."""
    return F.translate(F.regexp_replace(text(x), "[  ]", ""), ",", ".")


def two(x) -> Column:
    """Two decimals, by the exact value of the double. [F13]"""
    return F.call_function("format_number", col(x).cast("double"), F.lit("0.00"))


def comma_format(x) -> Column:
    """Two decimals after a comma. [F13]"""
    return F.translate(two(x), ".", ",")


def code_format(x) -> Column:
    """Two decimals after a dot, none for a whole number. [F13]"""
    return F.regexp_replace(two(x), r"\.00$", "")


def price_any(x) -> Column:
    """Any number; null for '' and the absent mark. [F12]"""
    return number(compact(x))


def price_positive(x) -> Column:
    """Any number over 0. [F12]"""
    return let(number(F.translate(F.regexp_replace(text(x), " ", ""), ",", ".")), lambda v: F.when(v > 0, v))


def price_bounded(x) -> Column:
    """Over 0 and at most 99999.99. [F12]"""
    return let(number(compact(x)), lambda v: F.when((v > 0) & (v <= 99999.99), v))


def price_stripped(x) -> Column:
    """What is left of digits and dots, if it is a number over 0; missing marks give null. [F12]"""
    v = number(F.regexp_replace(F.translate(text(x), ",", "."), "[^0-9.]", ""))
    return let(v, lambda v: F.when(~missing_derive(x) & (v > 0), v))


def price_found(x) -> Column:
    """The first price-like part, from 1 to 99999.99. [F12]"""

    def found(m: Column) -> Column:
        roubles = F.regexp_replace(F.regexp_extract(m, PRICE, 1), "[^0-9]", "")
        cents = F.coalesce(F.substring(F.rpad(F.nullif(F.regexp_extract(m, PRICE, 2), F.lit("")), 2, "0"), 1, 2).try_cast("int"), F.lit(0))
        return let(F.when(F.length(roubles) <= 6, whole(roubles) + cents / F.lit(100.0)), lambda v: F.when(v.between(1.0, 99999.99), v))

    return let(F.regexp_extract(compact(x), PRICE, 0), lambda m: F.when(m != "", found(m)))


def number_or(x, default: float = 0.0) -> Column:
    """A number, else the default. [F12]"""
    return F.coalesce(price_any(x), F.lit(default))


def price_text(x, comma: bool) -> Column:
    """A bounded price with two decimals, else ''. [F12]"""
    v = price_bounded(x)
    return F.coalesce(comma_format(v) if comma else two(v), F.lit(""))


def comma_text(x) -> Column:
    """Two decimals after a comma; text that is no number stays. [F13]"""
    return F.coalesce(comma_format(price_any(x)), text(x))


def code_text(x) -> Column:
    """Dot decimals, none for whole numbers; text that is no number stays. [F13]"""
    return F.coalesce(code_format(price_any(x)), text(x))


def payload_price(raw) -> Column:
    """A price of a scanned code: digits and dots, decimals kept as two if they were there, else whole numbers stay whole. [F12]"""

    def form(t: Column) -> Column:
        # only the last of several dots is a decimal one
        s = F.regexp_replace(F.regexp_replace(F.translate(t, ",", "."), "[^0-9.]", ""), r"\.(?=.*\.)", "")
        made = lambda v: F.when(v.isNull(), F.when(s == "", "").otherwise(t)).when(t.rlike(r"(?U)[,.][0-9]{1,2}\b"), two(v)).otherwise(code_format(v))
        return let(number(s), made)

    return let(text(raw), form)


def dot_price(x) -> Column:
    """A comma decimal as a dot decimal; anything else stays. [P1]"""
    return let(text(x), lambda t: F.when(number(F.translate(t, ",", ".")).isNotNull(), F.translate(t, ",", ".")).otherwise(t))


def coordinate(x) -> Column:
    """One decimal; '' stays ''. [F13]"""
    return let(text(x), lambda t: F.coalesce(F.call_function("format_number", number(t), F.lit("0.0")), t))


def percent_off(card, default) -> Column:
    """Whole percent by which card is under default, by the floor of the double."""
    return F.floor((F.lit(1.0) - col(card) / col(default)) * 100).cast("int")


def discount_text(card, default) -> Column:
    """-N% for 1 to 99 percent, else the whole difference in roubles, else the absent mark. [P9]"""
    both = F.struct(percent_off(card, default).alias("pct"), F.floor(col(default) - col(card)).cast("int").alias("diff"))
    return let(both, lambda b: _discount(b["pct"], b["diff"]))


def _discount(pct: Column, diff: Column) -> Column:
    return F.when(pct.between(1, 99), F.concat(F.lit("-"), pct.cast("string"), F.lit("%"))).when(diff > 0, F.concat(F.lit("-"), diff.cast("string"), F.lit("р"))).otherwise(ABSENT)


def numeric_text(x) -> Column:
    """Lookalike letters as digits, in tokens that hold a digit or one of . , : % ₽ only. [F10]"""
    tokens = lambda v: F.regexp_extract_all(v, F.lit(r"(?U)(\S+|\s+)"), F.lit(1))
    made = lambda v: F.array_join(F.transform(tokens(v), lambda t: F.when(t.rlike(r"[0-9.,:%₽]"), F.translate(t, *LOOKALIKES)).otherwise(t)), "")
    # most texts have no such token, which one search tells
    return let(F.coalesce(col(x), F.lit("")), lambda v: F.when(v.rlike(MIXED), made(v)).otherwise(v))


def is_date_or_code(t: Column) -> Column:
    """looks_like_date_or_code of what numeric_text has read already."""
    return t.rlike(f"(?U){DATE}") | t.rlike(CODE)


def looks_like_date_or_code(x) -> Column:
    return let(numeric_text(x), is_date_or_code)


def prices(x) -> Column:
    """All prices in a text, ascending: no percents, dates, codes or item counts, from 1 to 99999.99. [F9]"""
    # a count is a number, then at most four characters in which a unit stands alone
    no_counts = r"(?!\s*(?i:шт|кг|г|л)(?![\p{L}0-9_]))"

    def found(t: Column) -> Column:
        clean = F.regexp_replace(t, r"[-–−]?\s*[0-9]{1,3}\s*%", " ")
        parts = F.regexp_extract_all(clean, F.lit(f"(?U){PRICE}{no_counts}"), F.lit(0))
        value = lambda m: whole(F.regexp_replace(F.regexp_extract(m, PRICE, 1), "[^0-9]", ""), "double") + F.coalesce(F.rpad(F.regexp_extract(m, PRICE, 2), 2, "0").try_cast("double"), F.lit(0.0)) / 100.0
        out = F.array_sort(F.filter(F.transform(parts, value), lambda v: v.between(1.0, 99999.99)))
        return F.when(t.rlike(f"(?U){DATE}") | t.rlike(CODE), F.array().cast("array<double>")).otherwise(out)

    return let(numeric_text(x), found)


def discount(texts) -> Column:
    """The first percent from 1 to 99 as -N%; else roubles of a line with a minus or 'скид' as -Nр; else the absent mark. [F11]"""

    def find(t: Column) -> Column:
        percent = F.filter(F.transform(t, lambda x: whole(F.regexp_extract(x, r"[-–−]?\s*([0-9]{1,2})\s*%", 1))), lambda p: p.between(1, 99))
        lines = F.filter(t, lambda x: x.contains("-") | x.contains("−") | F.lower(x).contains("скид"))
        roubles = F.filter(F.transform(lines, lambda x: whole(F.regexp_extract(x, r"(?i)(?:[-–−]\s*)?([0-9]{1,5})\s*(?:р|руб\.?|₽)", 1))), lambda p: p.between(1, 99999))
        mark = lambda n, unit: F.concat(F.lit("-"), n.cast("string"), F.lit(unit))
        return F.coalesce(mark(F.get(percent, 0), "%"), mark(F.get(roubles, 0), "р"), F.lit(ABSENT))

    return let(F.transform(col(texts), numeric_text), find)


def unglue(default, card) -> Column:
    """A default price over five times the card price that fits, 1.01 to 4 times, once a digit is taken off. [F14]"""
    d, c = col(default), col(card)
    return F.when((c > 0) & (d > c * 5) & (d / 10 >= c * 1.01) & (d / 10 <= c * 4.0), d / 10).otherwise(d)


def context_weight(text_, context, value) -> Column:
    """How much the words around a price speak for it. [F16]"""
    v = col(value)
    factor = lambda c, k: F.when(c, F.lit(k)).otherwise(F.lit(1.0))

    def weight(x: Column) -> Column:
        has = lambda p: x.rlike("(?U)" + p)
        return (
            factor(has(r"₽|\bруб"), 1.15)
            * factor(has(r"по\s+карт|карт[аеуы]") & ~has(r"без\s+карт"), 1.45)
            * factor(has("акци|скид|выгод"), 1.30)
            * factor(has(r"без\s+карт|обыч|регуляр|старая"), 1.25)
            * factor((v <= 10) & has(r"\bот\s+[0-9]+|опт|шт\.?"), 0.25)
            * factor((v <= 10) & has(r"\b(шт|кг|г|л)\b"), 0.25)
        )

    return let(F.translate(F.lower(F.concat_ws(" ", col(text_), col(context))), "ё", "е"), weight)


def card_signal(text_, context) -> Column:
    x = F.translate(F.lower(F.concat_ws(" ", col(text_), col(context))), "ё", "е")
    return x.rlike(r"(?U)по\s+карт|карт[аеуы]|акци|выгод") & ~x.rlike(r"(?U)без\s+карт")


def default_signal(text_, context) -> Column:
    x = F.translate(F.lower(F.concat_ws(" ", col(text_), col(context))), "ё", "е")
    return x.rlike(r"(?U)без\s+карт|обыч|регуляр|старая|цена\s+без")


def choose_prices(candidates, all_prices) -> Column:
    """(card, default) as text from candidates (value, score, card, dflt: whether words speak for either) and bare prices. [F15]

    Values under 10 don't count. Words decide first; else one candidate that outdoes the next by 1.35; else the
    least and the greatest value.
    """

    def facts(c: Column) -> Column:
        by_score = F.reverse(F.array_sort(F.transform(c, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("i"), x["value"].alias("value"), x["card"].alias("card"), x["dflt"].alias("dflt")))))
        bare = F.array_sort(F.array_distinct(F.transform(F.filter(col(all_prices), lambda p: p >= 10.0), lambda p: F.round(p, 2))))
        return F.struct(by_score.alias("by_score"), F.array_sort(F.array_distinct(F.transform(c, lambda x: F.round(x["value"], 2)))).alias("values"), bare.alias("bare"))

    def signals(f: Column) -> Column:
        return F.struct(f.alias("f"), F.get(F.filter(f["by_score"], lambda x: x["card"]), 0)["value"].alias("card"), F.get(F.filter(f["by_score"], lambda x: x["dflt"]), 0)["value"].alias("dflt"))

    return let(let(let(F.filter(col(candidates), lambda x: x["value"] >= 10.0), facts), signals), _decide)


def _decide(s: Column) -> Column:
    by_score, values, bare, card, dflt = s["f"]["by_score"], s["f"]["values"], s["f"]["bare"], s["card"], s["dflt"]
    top, second, low, none = F.get(by_score, 0), F.get(by_score, 1), F.array_min(values), F.lit("")
    above = lambda v: F.array_max(F.filter(values, lambda x: x > v + 0.009))
    pair = lambda a, b: F.struct(a.alias("price_card"), b.alias("price_default"))
    several = F.size(values) >= 2
    by_card = F.coalesce(dflt, above(card), F.when(several, F.array_max(values)).otherwise(card))
    under = F.coalesce(F.array_min(F.filter(values, lambda x: x < dflt - 0.009)), low)
    outdone = (F.size(by_score) > 1) & (top["score"] > second["score"] * 1.35)
    unglued = lambda v, c: let(v, lambda d: comma_format(unglue(d, c)))
    return (
        F.when(card.isNotNull(), pair(comma_format(card), let(by_card, lambda d: F.when(F.abs(d - card) > 0.009, comma_format(d)).otherwise(none))))
        .when(dflt.isNotNull() & several, pair(comma_format(under), comma_format(dflt)))
        .when(several & outdone, pair(comma_format(top["value"]), F.coalesce(unglued(above(top["value"]), top["value"]), none)))
        .when(several, pair(comma_format(low), unglued(F.coalesce(above(low), F.array_max(values)), low)))
        .when(F.size(by_score) > 0, pair(comma_format(top["value"]), none))
        .when(F.size(bare) >= 2, pair(comma_format(F.array_min(bare)), comma_format(F.array_max(bare))))
        .when(F.size(bare) == 1, pair(comma_format(F.get(bare, 0)), none))
        .otherwise(pair(none, none))
    )


def fill_empty(target, value) -> Column:
    return F.when(empty_plain(target), value).otherwise(col(target))
