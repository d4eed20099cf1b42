"""Work that is done once, or not at all: what made queries fail by time."""

from pyspark.sql import functions as F

from labelwright.functions import money, presence, text as names
from labelwright.operators import vote as V
from labelwright.plans import carriers as K


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_field_is_voted_on_alone_and_alike(spark, sf):
    o = K.observations(spark, sf).where("track % 20 = 0")
    whole = V.decisions(o, ["track"])[1].where("field = 'barcode'")
    one = V.decisions(o, ["track"], fields=["barcode"])[1]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, whole.collect())) and "print_datetime" not in plan(one)


def test_names_are_cleaned_once(spark):
    df = spark.createDataFrame([("milk 2,5% | MILK 2,5% | 12.03.2026 10:20 | qr 12345678 x",), ("",), (None,), ("a|bb|Bb|cc",)], "x string")
    for f, want in ((names.product_name, ["milk 2,5%", "", "", "bb cc"]), (names.vote_name, ["milk 2,5%", "", "", ""])):
        out = df.select(f("x").alias("x"))
        assert [r.x for r in out.collect()] == want
        assert plan(out).count("[.\\-/][0-9]{2,4}(?:\\s+[0-9]") == 1


def test_values_that_are_no_numbers_are_never_cast(spark):
    odd = ["", None, "NaN", "  x \n", "нет", "12,5", "31.04.2026 10:20", "29.02.2024 9:05", "29.02.2023 9:05", "1.1.26 23:59", "1.1.26 24:00", "0.1.26 1:00", "01.01.0000 1:00", "O1.O2.2026"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, x string").repartition(1)
    rows = df.select("i", presence.strip("x").alias("s"), names.date_time("x").alias("d"), names.date_time("x", True).alias("kept"), money.price_found("x").alias("p"), money.numeric_text("x").alias("n"), money.discount(F.array("x")).alias("off")).orderBy("i").collect()
    assert [r.s for r in rows[:4]] == ["", None, "NaN", "x"]
    assert [r.d for r in rows[6:13]] == ["", "29.02.2024 9:05", "", "01.01.2026 23:59", "", "", ""] and rows[6].kept == "31.04.2026 10:20" and rows[5].p == 12.5 and rows[0].p is None and rows[13].n == "01.02.2026" and rows[0].off == "нет"
    assert "try_make_timestamp" not in plan(df.select(names.date_time("x"))).lower()


def test_all_ways_of_a_key_go_through_one_join_for_whole_keys_and_one_for_parts(spark):
    from labelwright.operators import catalog as C
    from labelwright.schema import CATALOG_COLUMNS

    keys = [("barcode", "4600000000015"), ("barcode", "4600000000022"), ("barcode", "4006381333931"), ("sku", "200000000001"), ("sku", "200000000002")]
    catalog = spark.createDataFrame([(kind, key, *(key if c == "barcode" else "" for c in CATALOG_COLUMNS)) for kind, key in keys], "key_kind string, key string, " + ", ".join(f"{c} string" for c in CATALOG_COLUMNS))
    rows = [(1, "4600000000015", "4006381333931", ""), (2, "40063813", "", "200000000001"), (3, "46000000", "", "x 00000002"), (4, "нет", None, "200000000002"), (5, "", "0063813339", "20000000"), (6, "994600000000022", "", ""), (7, None, "", None)]
    df = spark.createDataFrame(rows, "row_id long, barcode string, qr_code_barcode string, id_sku string")
    out = C.lookup_key(df, catalog)
    assert {r.row_id: (r.entry.barcode, r.branch) for r in out.collect()} == {1: ("4006381333931", "exact_qr_barcode"), 2: ("4006381333931", "prefix_barcode"), 3: ("200000000002", "prefix_sku"), 4: ("200000000002", "exact_sku"), 5: ("4006381333931", "prefix_qr_barcode"), 6: ("4600000000022", "prefix_barcode")}
    report = C.lookup_key(df, catalog, order="report")
    assert {r.row_id: r.branch for r in report.collect()} == {1: "exact_barcode", 2: "prefix_barcode", 3: "prefix_sku", 4: "exact_sku", 5: "prefix_qr_barcode", 6: "prefix_barcode"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) <= 5 and "transform" not in plan
