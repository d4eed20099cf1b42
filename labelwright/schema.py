"""Tag rows: column names, order, defaults and types."""

from __future__ import annotations

from pyspark.sql import types as T

# Output columns in order, sentinels, aliases, defaults.
TAG_COLUMNS = [
    "filename", "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "print_datetime", "code",
    "additional_info", "color", "special_symbols", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", "qr_code_barcode", "price1_qr", "price2_qr",
    "price3_qr", "price4_qr", "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price", "action_price_qr", "action_code_qr",
]
ABSENT = "нет"
UNREAD = ""
ALIASES = {"wholesale_level_1_coun": "wholesale_level_1_count"}
BOX_COLUMNS = ["x_min", "y_min", "x_max", "y_max"]
NUMERIC_COLUMNS = ["frame_timestamp", *BOX_COLUMNS]
PLACE_COLUMNS = ["filename", *NUMERIC_COLUMNS]
TEXT_COLUMNS = [c for c in TAG_COLUMNS if c not in NUMERIC_COLUMNS]
CONTENT_COLUMNS = [c for c in TAG_COLUMNS if c not in PLACE_COLUMNS]
UNREAD_COLUMNS = ["filename", "product_name", "price_default", "price_card", "barcode", "id_sku", "print_datetime", "color"]
DEFAULTS = {c: UNREAD if c in UNREAD_COLUMNS else ABSENT for c in TEXT_COLUMNS}
COMPACT_COLUMNS = ["product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "qr_code_barcode", "price1_qr", "price2_qr", "price4_qr"]
STRUCTURAL_COLUMNS = ["price_discount", "action_price_qr", "action_code_qr", "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price"]
QR_COLUMNS = [c for c in TAG_COLUMNS[18:]]
QR_PRICE_COLUMNS = ["price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_price", "wholesale_level_2_price", "action_price_qr"]
PRINTED_PRICE_COLUMNS = ["price_default", "price_card", "price_discount"]

TAG_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in NUMERIC_COLUMNS else T.StringType()) for c in TAG_COLUMNS])
SINK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TAG_COLUMNS])
CATALOG_COLUMNS = ["barcode", "id_sku", "product_name", "price_default", "price_card", "price_discount", "price2_qr", "special_symbols", "code", "print_datetime", "additional_info"]
CATALOG_PRICES = ["price_default", "price_card", "price_discount", "price2_qr"]
CATALOG_TEXTS = ["special_symbols", "code", "print_datetime", "additional_info"]
BOX_TYPE = "array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double>>"


def validate_columns(columns: list[str]) -> None:
    """Raise if columns are not exactly TAG_COLUMNS in order; names what is missing and extra. [P3]"""
    if list(columns) != TAG_COLUMNS:
        missing = [c for c in TAG_COLUMNS if c not in columns]
        extra = [c for c in columns if c not in TAG_COLUMNS]
        raise ValueError(f"columns differ from the tag schema; missing {missing}, extra {extra}")
