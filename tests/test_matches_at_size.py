"""Lookups and scores whose work grew with pairs or with columns that nobody reads."""

from labelwright.functions.text import token_set
from labelwright.operators import catalog as C
from labelwright.operators import evaluate as E
from labelwright.schema import CATALOG_COLUMNS


def test_price_and_name_are_looked_up_without_pairs(spark, monkeypatch):
    """Two thousand equal rows and entries would be four million pairs; names that entries share are not compared at all."""
    row = "row_id long, filename string, price_card string, price_default string, product_name string"
    many = [(1000 + i, "v1.mp4", "80,00", "100,00", "black tea strong") for i in range(2000)]
    rows = [(1, "v1.mp4", "10,00", "нет", "x"), (2, "v1.mp4", "20,00", "", "green tea 100g"), (3, "a/v1.mp4", "21,49", "", "GREEN  tea, 100g"), (4, "v1.mp4", "", "60,00", "any"), (5, "v2.mp4", "10,00", "", "x"), (6, "v1.mp4", "20,00", "90,00", "green tea 100g"), (7, "v1.mp4", "20,00", "", "tea"), (8, None, "10,00", "", "x")]
    data = spark.createDataFrame(many + rows, row)
    cells = lambda key, name, card, dflt: ("barcode", key, ["v1.csv"], {**dict.fromkeys(CATALOG_COLUMNS, ""), "barcode": key, "product_name": name, "price_card": card, "price_default": dflt})
    entries = [cells(f"k{i:04}", "Black tea, strong", "80,00", "100,00") for i in range(2000)]
    entries += [cells("m", "alone", "10,50", "15,00"), cells("n", "Green tea 100g", "20,50", "30,00"), cells("o", "sunflower oil", "19,50", "30,00"), cells("p", "bread", "", "61,00")]
    table = spark.createDataFrame([(kind, key, files, *(e[c] for c in CATALOG_COLUMNS)) for kind, key, files, e in entries], "key_kind string, key string, source_files array<string>, " + ", ".join(f"{c} string" for c in CATALOG_COLUMNS))
    cut, written = C.cut, {}

    def note(df, folder=None, name="rows"):
        written[name] = cut(df, folder, name)
        return written[name]

    monkeypatch.setattr(C, "cut", note)
    out = C.lookup_price_name(data, table)
    assert {r.row_id: r.entry.barcode for r in out.collect()} == {1: "m", 2: "n", 3: "n", 4: "p"}
    assert written["answers"].where("clean = 'black tea strong'").count() == 1 and "_band" not in C.lookup_price_name.__code__.co_names


def test_similarity_is_that_of_the_plain_table():
    def plain(p, q):
        row = [0] * (len(q) + 1)
        for c in p:
            last = 0
            for j, d in enumerate(q, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return 100.0 * 2 * row[-1] / (len(p) + len(q))

    for a, b in (("kitten", "sitting"), ("молоко", "молочко"), ("abcabba", "cbabac"), ("x" * 70, "xy" * 50)):
        assert token_set(a, b) == plain(a, b)


def test_columns_that_nobody_asks_for_are_not_made(spark):
    side = "video string, {0} long, barcode string, code string"
    truth, pred = spark.createDataFrame([("v", 1, "1", "a"), ("v", 2, "2", "b")], side.format("gt_id")), spark.createDataFrame([("v", 7, "1", "x")], side.format("pred_id"))
    found = spark.createDataFrame([("v", 1, 7, "barcode", 100.0)], "video string, gt_id long, pred_id long, matched_by string, score double")
    whole = E.score(found, pred, truth, ["barcode", "code"])
    few = E.score(found, pred, truth, ["barcode", "code"], columns=["video", "matched_by", "field_score", "pass80"])
    assert few.columns == ["video", "matched_by", "field_score", "pass80"] and sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(few.columns).collect()))
    made = few._jdf.queryExecution().analyzed().toString()
    assert "to_json" not in made and "zip_with" not in made


def test_videos_are_dealt_over_more_parts_than_cores(spark):
    box = "x_min double, y_min double, x_max double, y_max double"
    one = spark.createDataFrame([(str(i), i, 0.0, 1.0, 1.0, 2.0, 2.0) for i in range(40)], f"video string, gt_id long, t double, {box}")
    assert E._by_video([one], "video").rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism
