"""Names, dates, codes, symbols and similarity of texts."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT
from .ident import ean_valid, normal_sku, only_digits, repair_ean_legacy
from .money import CODE, DATE, numeric_text
from .presence import col, let, strip, text, whole

# Patterns of what is no part of a name, service words, symbols.
NAME_DATE = r"[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}(?:\s+[0-9]{1,2}[:.][0-9]{2})?"
NAME_PRICE = r"(?iU)(?<!\w)[0-9]{1,5}(?:[,.\-][0-9]{1,2})?\s*(?:руб\.?|₽)(?!\w)"
NOT_A_NAME = r"(?iU)^(?:[0-9]{2}[.\-/][0-9]{2}[.\-/][0-9]{2,4}|[0-9]{8,}|\b[0-9]+[,.]?[0-9]*\s*(?:руб|₽|%|шт|кг|г)\b)$"
SERVICE = r"(?iU)\b(?:qr|ean|barcode|штрих\s*код|артикул|id[_\s-]*sku)\b"
SERVICE_MORE = r"(?iU)\b(?:qr|ean|barcode|штрих\s*код|артикул|id[_\s-]*sku|цена|карта|без\s+карты|по\s+карте)\b"
ONLY_NUMBERS = r"(?iU)^[0-9\s,.\-%₽руб]+$"
EDGE = r"^[ \-|•\t\n]+|[ \-|•\t\n]+$"
SYMBOL = "^[КкKkЛлLlШш]$"


def collapse(x) -> Column:
    return F.regexp_replace(col(x), r"(?U)\s+", " ")


def trim_marks(x) -> Column:
    """Without blanks, hyphens, bars and bullets at the ends."""
    return F.regexp_replace(col(x), EDGE, "")


def letters(x) -> Column:
    return F.regexp_count(F.lower(col(x)), F.lit("[a-zа-яё]"))


def date_time(x, keep_invalid: bool = False) -> Column:
    """dd.mm.yyyy h:mm of the first date and time; '' if there is none or it isn't a real one (the text found, if kept). [F17]"""
    p = f"(?U){DATE}"
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")

    def form(t: Column) -> Column:
        day, month, year, hour, minute = (whole(F.regexp_extract(t, p, i)) for i in range(1, 6))
        year = F.when(F.length(F.regexp_extract(t, p, 3)) == 2, 2000 + year).otherwise(year)
        # the calendar written out: making a timestamp of what is no date throws an exception for each row
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        real = month.between(1, 12) & (day >= 1) & (day <= last) & (hour < 24) & (minute < 60) & (year > 0)
        made = F.concat(pad(day), F.lit("."), pad(month), F.lit("."), year.cast("string"), F.lit(" "), hour.cast("string"), F.lit(":"), pad(minute))
        return F.when(F.coalesce(real, F.lit(False)), made).otherwise(t if keep_invalid else F.lit(""))

    # what isn't a date at all is told by one search; the parts are read from the match alone
    return let(F.regexp_extract(F.coalesce(col(x).cast("string"), F.lit("")), p, 0), lambda t: F.when(t == "", "").otherwise(form(t)))


def print_code(x) -> Column:
    """NN_NNN with an optional second number, without blanks; '' if none. [F22]"""
    return F.translate(F.regexp_replace(F.regexp_extract(F.coalesce(col(x), F.lit("")), f"({CODE})", 1), r"(?U)\s", ""), "–", "-")


def first_code(texts) -> Column:
    """The first code of several texts, else the absent mark. [F22]"""
    return F.coalesce(F.get(F.filter(F.transform(col(texts), lambda t: print_code(numeric_text(t))), lambda c: c != ""), 0), F.lit(ABSENT))


def symbol(x) -> Column:
    """One of the three marks in capitals, Latin lookalikes included; '' for others. [F23]"""
    t = text(x)
    return F.when(t.rlike(SYMBOL), F.translate(F.upper(t), "KL", "КЛ")).otherwise("")


def box_symbol(boxes) -> Column:
    """The mark of the first short, well-read box that holds nothing else. [F23]"""
    ok = F.filter(col(boxes), lambda b: (b["conf"] >= 0.35) & (F.length(strip(b["text"])) <= 2) & (symbol(b["text"]) != ""))
    return F.coalesce(symbol(F.get(ok, 0)["text"]), F.lit(ABSENT))


def catalog_symbol(x) -> Column:
    """К, Ш, the absent mark or '', from any case and Latin lookalikes. [F23]"""
    t = text(x)
    return F.when(t.isin("", ABSENT, "К", "Ш"), t).when(F.upper(t).isin("К", "K"), "К").when(F.upper(t) == "Ш", "Ш").when(F.lower(t).isin(ABSENT, "net", "no"), ABSENT).otherwise("")


def text_barcode(texts) -> Column:
    """The first valid EAN-13 among digit runs of 12 to 20 characters; 14 digits may lose one. [F24]"""
    run = r"(?<![0-9])([0-9][0-9\s ]{10,18}[0-9])(?![0-9])"
    found = F.flatten(F.transform(col(texts), lambda t: F.regexp_extract_all(numeric_text(t), F.lit(run), F.lit(1))))
    fixed = F.transform(F.transform(found, only_digits), lambda d: F.when(ean_valid(d), d).when(F.length(d) == 14, repair_ean_legacy(d)))
    return F.coalesce(F.get(F.filter(fixed, lambda d: d.isNotNull()), 0), F.lit(""))


def text_sku(texts, barcode) -> Column:
    """The first SKU that is not the barcode nor a part of it. [F25]"""
    run = r"(?<![0-9])([0-9][0-9\s ]{8,16}[0-9])(?![0-9])"
    bc = only_digits(barcode)
    found = F.flatten(F.transform(col(texts), lambda t: F.regexp_extract_all(numeric_text(t), F.lit(run), F.lit(1))))
    return F.coalesce(F.get(F.filter(F.transform(found, normal_sku), lambda s: (s != "") & ~F.contains(bc, s)), 0), F.lit(""))


def name_part(x) -> Column:
    """A fragment without dates, long digit runs, prices and service words; '' if no name is left. [F26]"""
    t = F.translate(F.coalesce(col(x), F.lit("")), " ", " ")
    for p in (f"(?U){NAME_DATE}", "[0-9]{8,}", NAME_PRICE, SERVICE):
        t = F.regexp_replace(t, p, " ")

    def kept(t: Column) -> Column:
        bad = lambda c: (c["n"] < 2) | (c["d"] > F.greatest(F.lit(6), c["n"] * 2)) | t.rlike(ONLY_NUMBERS)
        return let(F.struct(letters(t).alias("n"), F.regexp_count(t, F.lit("[0-9]")).alias("d")), lambda c: F.when((F.length(t) < 2) | bad(c), "").otherwise(t))

    # the cleaned text is named many times and worked out once
    return let(trim_marks(collapse(t)), kept)


def distinct_parts(parts) -> Column:
    """Parts in order, each once whatever its case, joined by a blank. [O4]"""

    def once(p: Column) -> Column:
        first = lambda keys: F.filter(p, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.when(F.size(p) > 1, F.array_join(let(F.transform(p, lambda x: F.lower(collapse(x))), first), " ")).otherwise(F.array_join(p, " "))

    return let(parts, once)


def product_name(x) -> Column:
    """Parts between bars, each cleaned, each once, at most 300 characters. [F26]"""
    t = trim_marks(collapse(F.coalesce(col(x), F.lit(""))))
    parts = F.filter(F.transform(F.split(t, r"\|"), name_part), lambda p: p != "")
    return F.substring(distinct_parts(parts), 1, 300)


def vote_name(x) -> Column:
    """A stricter cleaning for voting: codes and price words go, too. [F27]"""
    t = F.translate(F.coalesce(col(x).cast("string"), F.lit("")), " ", " ")
    for p in (f"(?U){NAME_DATE}", CODE, "[0-9]{8,}", NAME_PRICE, SERVICE_MORE):
        t = F.regexp_replace(t, p, " ")

    def fits(p: Column) -> Column:
        return (F.length(p) >= 3) & ~p.rlike(NOT_A_NAME) & let(letters(p), lambda n: (n >= 2) & (F.regexp_count(p, F.lit("[0-9]")) <= F.greatest(F.lit(8), n * 2)))

    def whole_name(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\|"), trim_marks), fits)
        return F.when((F.length(t) < 3) | t.rlike(NOT_A_NAME), "").otherwise(F.substring(distinct_parts(parts), 1, 300))

    return let(trim_marks(collapse(t)), whole_name)


def vote_name_score(name, weight) -> Column:
    """Letters, share of Cyrillic ones and tokens speak for a name, digits against it. [A7]"""
    return clean_name_score(vote_name(name), weight)


def clean_name_score(name, weight) -> Column:
    """vote_name_score of a name that vote_name has cleaned already."""
    return score_of(name_facts(name), weight)


def name_facts(name) -> Column:
    """What a cleaned name's score is made of but the weight: a struct (plus, keep); null for ''."""
    t = col(name)
    low = F.lower(t)
    n, cyr = F.regexp_count(low, F.lit("[a-zа-яё]")), F.regexp_count(low, F.lit("[а-яё]"))
    d, tokens = F.regexp_count(t, F.lit("[0-9]")), F.regexp_count(low, F.lit("[a-zа-яё0-9]+"))
    noise = d / F.greatest(F.lit(1), n + d)
    share = cyr / F.greatest(F.lit(1), n)
    return F.when(t != "", F.struct((n + share * 8.0 + tokens * 3.0).alias("plus"), F.greatest(F.lit(0.25), 1.0 - noise).alias("keep")))


def score_of(facts, weight) -> Column:
    """The score of a name by its facts; 0 without any."""
    f = col(facts)
    return F.when(f.isNull(), 0.0).otherwise(f["plus"] * col(weight) * f["keep"])


def catalog_name(x) -> Column:
    """Collapsed, trimmed, at most 300 characters; '' under three or for missing marks. [F31]"""
    t = trim_marks(collapse(F.translate(F.coalesce(col(x), F.lit("")), " ", " ")))
    return F.when((F.length(t) < 3) | F.lower(t).isin("nan", ABSENT), "").otherwise(F.substring(t, 1, 300))


def fuzzy_name(x) -> Column:
    """Lower case, word characters and single blanks only. [F31]"""
    return strip(collapse(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[^\w\s]", " ")))


def _quality(x, cyrillic: float, token: float, digit: float) -> Column:
    t = text(x)
    low = F.lower(t)
    return F.regexp_count(low, F.lit("[a-zа-яё]")) + cyrillic * F.regexp_count(low, F.lit("[а-яё]")) + token * F.regexp_count(low, F.lit("[a-zа-яё0-9]+")) - digit * F.regexp_count(t, F.lit("[0-9]"))


def catalog_quality(x) -> Column:
    return _quality(x, 0.0, 2.0, 0.5)


def optimise_quality(x) -> Column:
    return _quality(x, 1.0, 1.5, 0.6)


def replaces_name(current, name) -> Column:
    """A catalog name replaces an empty or poor one, or one it outdoes by a quarter. [F28]"""
    q = catalog_quality(current)
    return (col(current).isin("", ABSENT)) | (q < 12) | (catalog_quality(name) > q * 1.25)


def optimise_replaces_name(current, name) -> Column:
    from .presence import missing_optimise

    q = optimise_quality(current)
    return missing_optimise(current, absent=True) | (q < 12) | (optimise_quality(name) > q * 1.20)


def words(x, least: int = 5) -> Column:
    """Distinct lower-case words of letters. [J6]"""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(f"([а-яёa-z]{{{least},}})"), F.lit(1)))


def tokens(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("([0-9a-zа-яё]+)"), F.lit(1)))


def token_overlap(a, b) -> Column:
    """Shared tokens by all tokens; 0 if either has none. [F30]"""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def mechanic(x) -> Column:
    """What kind of offer a text speaks of. [P15]"""
    t = col(x)
    return (
        F.when(t.rlike(r"(?iU)[23]\s*[=+]\s*[12]|при покупке|бесплатно"), "bogof")
        .when(t.rlike(r"(?iU)от\s*[0-9]+"), "from_n")
        .when(t.rlike(r"-\s*[0-9]+\s*%"), "discount_pct")
        .when(t.rlike(r"-\s*[0-9]+\s*[р₽Р]"), "discount_rub")
        .when(t.rlike("(?iU)карт"), "regular_with_card")
        .otherwise("regular")
    )


def template(x, red=None, orange=None) -> Column:
    """Layout template by words, else by shares of red and orange, else regular; unknown without either. [P16]"""
    t = F.translate(F.lower(F.coalesce(col(x), F.lit(""))), "ё", "е")
    by_words = (
        F.when(t.rlike(r"(?U)bogof|богоф|набор|2\s*цена|цена\s*2"), "bogof")
        .when(t.rlike(r"(?U)\bот\s*[0-9]+|опт|порог|до\s*[0-9]+"), "wholesale")
        .when(t.rlike(r"(?U)[-−–]\s*[0-9]{1,3}\s*(?:%|р|руб)"), "discount")
        .when(t.rlike("акци|скид|выгод|карт"), "promo")
    )
    if red is None:
        return F.coalesce(by_words, F.lit("unknown"))
    by_colour = F.when(col(red).isNull(), "unknown").when(col(red) > 0.035, "discount").when(col(orange) > 0.07, "promo").otherwise("regular")
    return F.coalesce(by_words, by_colour)


def ratio_udf():
    """Ratcliff-Obershelp similarity (no built-in gives it), in Arrow batches. [F29]"""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return ratio


@lru_cache(maxsize=200_000)
def token_set(a: str, b: str) -> float:
    """Token-set similarity, 0 to 100, by its public definition: best normalised indel similarity among shared tokens and shared plus own. [J5]"""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0

    def indel(p: str, q: str) -> float:
        # longest common subsequence, a row of the table in the bits of one number
        at: dict[str, int] = {}
        for i, c in enumerate(p):
            at[c] = at.get(c, 0) | 1 << i
        row = every = (1 << len(p)) - 1
        for d in q:
            shared = row & at.get(d, 0)
            row = (row + shared | row - shared) & every
        total = len(p) + len(q)
        return 100.0 * 2 * (len(p) - row.bit_count()) / total if total else 100.0

    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    ways = [indel(one, two)]
    if both:
        ways += [indel(both, one), indel(both, two)]
    return max(ways)


def token_set_udf():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return similarity
