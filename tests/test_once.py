"""What is read several times is worked out once, and what needs no work gets none."""

from pyspark.sql import functions as F

from labelwright.functions import presence
from labelwright.operators import evaluate as E
from labelwright.plans import queries as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_worked_out_once_for_both_counts(spark):
    scores = spark.createDataFrame([("v", ["a", "b"]), ("v", []), ("w", ["a"])], "video string, right array<string>").withColumn("right", F.transform("right", lambda x: F.concat(x, F.lit("_costly"))))
    out = E.field_accuracy(scores)
    assert "_costly" not in plan(out)
    assert {(r.video, r.field, r.hits, r.n_gt) for r in out.collect()} == {("v", "a_costly", 1, 2), ("v", "b_costly", 1, 2), ("w", "a_costly", 1, 1), (None, "a_costly", 2, 3), (None, "b_costly", 1, 3)}


def test_equal_values_are_right_uncleaned_and_others_as_before(spark):
    rows = [(None, None), ("", "нет"), ("x", None), (None, "x"), ("NaN", "NaN"), (" A ", "a"), ("1,5 ", "2.9"), ("a", "b"), ("нет", "нет"), ("nan", "5")]
    df = spark.createDataFrame(rows, "p string, g string")
    ok = E.field_matches("p", "g", "price_default")
    assert [r.ok for r in df.select(ok.alias("ok")).collect()] == [True, True, True, False, True, True, True, False, True, False]
    assert "(p#" in plan(df.select(ok)) and "<=> g#" in plan(df.select(ok))


def test_text_keeps_its_marks(spark):
    df = spark.createDataFrame([(None,), ("NaN",), (" NaN\n",), ("NaNa",), (" x ",), ("nan",)], "x string")
    assert [r.t for r in df.select(presence.text("x").alias("t")).collect()] == ["", "", "", "NaNa", "x", "nan"]
    assert [r.t for r in spark.createDataFrame([(float("nan"),), (1.5,)], "x double").select(presence.text("x").alias("t")).collect()] == ["", "1.5"]


def test_ceiling_reads_written_scores_without_json(spark, sf):
    p = plan(Q.QUERIES["a15_a16_ceiling_and_near_misses"](spark, sf))
    assert "to_json" not in p and "Join" not in p


def test_a_name_read_many_times_is_cleaned_once(spark):
    from labelwright.operators import vote as V

    rows = [(1, 1, 1.0, "Milk 2,5% fresh"), (1, 2, 0.5, "milk 12345678 fresh"), (1, 3, 1.0, "Milk 2,5% fresh"), (2, 1, 1.0, None), (2, 2, 1.0, ""), (2, 3, 1.0, "12.03.2026 10:20"), (3, 1, 1.0, None), (3, 2, 0.75, "Milk 2,5% fresh")]
    out = V.choose_names(spark.createDataFrame(rows, "track long, cand long, weight double, product_name string"), ["track"])
    got = {r.track: (r.value, round(r.confidence, 6)) for r in out.collect()}
    assert got.keys() == {1, 3} and got[1][0] == got[3][0] == "Milk 2,5% fresh" and 0 < got[1][1] < 0.5 and got[3][1] == 1.0
    text = plan(out)
    assert "Join" in text and text.index("Join") < text.index("штрих") and "Aggregate [_name" in text


def test_pieces_encoded_as_one_text_are_as_alone():
    import public_tokenizers

    from labelwright.llm import token_files as T

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = ["plain", "Größe", "don't", "x...", "<|endoftext|>", "a<|endoftext|>b", "a\tb", " x", "a\x0b", "日本語", "\U0001f600!", "1,234.5%", "a b", "Ġx", "_", "é́", "x" * 60, "'s", "﻿z", "a\r"]
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["", " ", "  a  b ", "\n\n a\n b", "a\n b \n"]
    T._open(path)
    alone = [x.ids for x in T._worker["tokenizer"].encode_batch(texts, add_special_tokens=False)]
    import numpy as np

    assert [np.frombuffer(b, "<u2").tolist() for b in T.encode_texts(texts, path, 2)] == alone

    made = {}
    left = T._Pieces._encode_joined(["one", "two", "t o", "<|x"], T._worker["starts"], made, T._worker["tokenizer"], "<u2")
    assert left == ["t o", "<|x"] and made.keys() == {"one", "two"}


def test_number_boxes_are_read_once_for_both_sides(spark):
    from labelwright.operators import boxes as B

    box = "struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([([("129", 0.9, 0.1, 0.6, 0.4, 0.8), ("90", 0.9, 0.42, 0.6, 0.5, 0.7), ("12.03.2026 10:20", 0.9, 0.1, 0.9, 0.5, 0.95)],)], f"b array<{box}>")
    out = df.select(B.price_candidates("b", F.transform("b", lambda x: x["text"])).alias("c"))
    assert [c.value for c in out.first().c] == [129.0, 90.0, 129.9]
    assert plan(out).count("[a-zа-яё]") == 1
