"""Golden values of the scalar functions, all in a few jobs."""

from pyspark.sql import functions as F

from labelwright.functions import ident, money, payload
from labelwright.functions import text as names
from labelwright.schema import TAG_COLUMNS, validate_columns


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_identifiers(spark):
    L = F.lit
    got = one(
        spark, ok=ident.normal_ean(L("4607124143901")), bad=ident.normal_ean(L("4607124143900")), sku=ident.normal_sku(L("270108726573")), sku_no_code=ident.normal_ean(L("270108726573"), repair=True), float_=ident.digits(L("4607124143901.0")),
        cut=ident.normal_ean(L("46071241439010"), repair=True), fixed=ident.repair_ean(L("4607124143900"), one_digit=True), absent=ident.digits(L("нет")), truth=ident.truth_barcode(L("123")), null=ident.normal_ean(L(None)),
    )
    assert got["ok"] == "4607124143901" and got["bad"] == "" and got["sku"] == "270108726573" and got["sku_no_code"] == "" and got["float_"] == "4607124143901"
    assert got["cut"] == "4607124143901" and len(got["fixed"]) == 13 and got["absent"] == "" and got["truth"] == "0000000000123" and got["null"] == ""


def test_prices(spark):
    L = F.lit
    got = one(
        spark, p=money.prices(L("-48%, 129.99, 252,63")), dash=money.prices(L("129-99")), group=money.prices(L("1 299,99")), count=money.prices(L("от 2 шт")), concat=money.unglue(L(26312.0), L(1899.99)), off=money.discount_text(L(80.0), L(100.0)),
        two=money.two(L(0.125)), printed=money.comma_format(L(2.675)), comma=money.price_text(L("1 299.5"), True), junk=money.price_any(L("5d")), found=money.price_found(L("цена 129,9 руб")), payload=money.payload_price(L("1.299,50")), disc=money.discount(F.array(L("скидка -48%"))),
    )
    assert got["p"] == [129.99, 252.63] and got["dash"] == [129.99] and got["group"] == [1299.99] and got["count"] == []
    assert got["concat"] == 2631.2 and got["off"] == "-19%" and got["two"] == "0.12" and got["printed"] == "2,67" and got["comma"] == "1299,50"
    assert got["junk"] is None and got["found"] == 129.9 and got["payload"] == "1299.50" and got["disc"] == "-48%"


def test_texts_and_payloads(spark):
    L = F.lit
    p = payload.payload_map(L("?b=4670025474665&p1=252.63&p2=239.99&p4=129.99&zz=1"))
    got = one(
        spark, name=names.product_name(L("Молоко питьевое 3.2% 4607124143901 129,99 руб 03.04.2026 3:08")), date=names.date_time(L("03/04/26 03:08")), no_date=names.date_time(L("45.13.2026 10:00")), code=names.print_code(L("12 _ 3456 – 789")), sym=names.symbol(L("k")),
        payload=p, bare=payload.route(L("4607124143901"))["qr_code_barcode"], last=payload.payload_map(L("https://x/y?P1=1&p1=2,50")), over=names.token_overlap(L("a b c"), L("b c d")),
    )
    assert got["name"] == "Молоко питьевое 3.2%" and got["date"] == "03.04.2026 3:08" and got["no_date"] == "" and got["code"] == "12_3456-789" and got["sym"] == "К"
    assert got["payload"] == {"qr_code_barcode": "4670025474665", "price1_qr": "252.63", "price2_qr": "239.99", "price4_qr": "129.99"}
    assert got["bare"] == "4607124143901" and got["last"] == {"price1_qr": "2.50"} and got["over"] == 0.5


def test_schema_check():
    validate_columns(TAG_COLUMNS)
    try:
        validate_columns(TAG_COLUMNS[1:])
        raise AssertionError
    except ValueError as e:
        assert "filename" in str(e)


def test_token_set_definition():
    assert names.token_set("a b c", "c b a d") == 100.0 and names.token_set("", "x") == 0.0 and 0 < names.token_set("milk one", "milk two") < 100
