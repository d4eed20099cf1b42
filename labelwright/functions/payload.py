"""Scanned payloads: query strings to tag fields. [F35, F36]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QR_COLUMNS, QR_PRICE_COLUMNS
from .ident import only_digits, scanner_barcode
from .money import payload_price
from .presence import col, let, strip

# Keys of a payload, in lower case, and the fields they mean.
KEYS = {
    "b": "qr_code_barcode", "barcode": "qr_code_barcode", "p1": "price1_qr", "price1": "price1_qr", "p2": "price2_qr", "price2": "price2_qr", "p3": "price3_qr", "price3": "price3_qr",
    "p4": "price4_qr", "price4": "price4_qr", "wl1c": "wholesale_level_1_count", "wholesalelevel1count": "wholesale_level_1_count", "wl1p": "wholesale_level_1_price",
    "wholesalelevel1price": "wholesale_level_1_price", "wl2c": "wholesale_level_2_count", "wholesalelevel2count": "wholesale_level_2_count", "wl2p": "wholesale_level_2_price",
    "wholesalelevel2price": "wholesale_level_2_price", "ap": "action_price_qr", "actionprice": "action_price_qr", "ac": "action_code_qr", "actioncode": "action_code_qr",
}


def decode(x) -> Column:
    """Percent and plus decoding; a text that can't be decoded has its pluses read as blanks only."""
    return let(x, lambda v: F.coalesce(F.try_url_decode(v), F.translate(v, "+", " ")))


def _pairs(t: Column) -> Column:
    """Lower-case keys and values of a decoded payload: a full URL, ?query or a bare query; blank values go."""
    full = lambda t: F.when(t.rlike("^https?://"), t).when(t.startswith("?"), F.concat(F.lit("https://x"), t)).otherwise(F.concat(F.lit("https://x?"), t))
    query = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), F.lit("")), F.regexp_replace(u, r"^https?://[^/?#]*", ""))
    pair = lambda p: F.struct(F.lower(strip(decode(F.substring_index(p, "=", 1)))).alias("k"), strip(decode(F.regexp_replace(p, "^[^=]*=", ""))).alias("v"))
    parts = F.filter(F.split(let(let(t, full), query), "&"), lambda p: p.contains("="))
    return F.filter(F.transform(parts, pair), lambda p: p["v"] != "")


def payload_fields(raw, strict: bool = False) -> Column:
    """Struct of the eleven fields of a payload (null where it has none): full URL, ?query or bare query; keys in any case; the last of a key counts. [F35]"""

    def field(name: str, pairs: Column) -> Column:
        keys = [k for k, f in KEYS.items() if f == name]
        raws = F.transform(F.filter(pairs, lambda p: p["k"].isin(keys)), lambda p: p["v"])
        if name == "qr_code_barcode":
            raws = F.transform(raws, lambda v: scanner_barcode(v, strict))
        elif name in QR_PRICE_COLUMNS:
            raws = F.transform(raws, payload_price)
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(raws, lambda v: v != "")), -1)

    t = strip(decode(strip(F.coalesce(col(raw), F.lit("")))))
    return let(_pairs(t), lambda ps: F.struct(*(field(c, ps).alias(c) for c in QR_COLUMNS)))


def payload_map(raw, strict: bool = False) -> Column:
    """The same as a map without the missing fields."""
    return let(payload_fields(raw, strict), lambda s: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), s[c].alias("value")) for c in QR_COLUMNS)), lambda e: e["value"].isNotNull())))


def route(raw) -> Column:
    """Fields of any scanned text: 8 to 15 bare digits are a barcode; else a query; else 12 to 14 digits somewhere. [F36]"""

    def pick(both: Column) -> Column:
        t, parsed = both["t"], both["parsed"]
        some = F.coalesce(*(parsed[c] for c in QR_COLUMNS)).isNotNull()
        d = only_digits(t)
        bare = t.rlike("^[0-9]{8,15}$")
        code = F.when(bare | (~some & F.length(d).between(12, 14)), F.nullif(scanner_barcode(d, True), F.lit("")))
        return F.struct(*(F.when(bare | ~some, code if c == "qr_code_barcode" else F.lit(None).cast("string")).otherwise(parsed[c]).alias(c) for c in QR_COLUMNS))

    t = strip(F.coalesce(col(raw), F.lit("")))
    return let(F.struct(t.alias("t"), payload_fields(t, strict=True).alias("parsed")), pick)
