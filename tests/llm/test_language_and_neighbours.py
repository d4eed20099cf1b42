import math
import zlib

import numpy as np

from labelwright.llm import language_id as L
from labelwright.llm.neighbours import cell_search, nearest, quantise

from .helpers import documents


def test_held_out_accuracy_and_rejection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs)
    out = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert model.predict("") == model.predict("12 34 !!") == ("und", 0.0, True)
    # und is for texts without letters only: others get the nearest language, and the rejection besides
    for text in ("OK", "xqzj", "漢字かな交じり文", "Привет, как дела сегодня"):
        lang, _, rejected = model.predict(text)
        assert lang in model.languages
    assert model.predict("漢字かな交じり文")[2]
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_of_one_script_are_told_apart():
    import random

    draw = random.Random(8)
    words = {"ru": ["привет", "сегодня", "что", "это", "была", "ночь", "мы", "ещё", "объект"], "uk": ["привіт", "сьогодні", "що", "це", "була", "ніч", "ми", "ще", "її"], "bg": ["здравей", "днес", "какво", "това", "беше", "нощ", "ние", "още", "път"], "ja": ["今日", "は", "とても", "寒い", "です"], "zh": ["今天", "非常", "冷", "我们", "还"]}
    make = lambda la: " ".join(draw.choice(words[la]) for _ in range(draw.randint(3, 30)))
    model = L.fit([(la, *L.trigrams(make(la).encode())) for la in words for _ in range(60)])
    tried = [(la, make(la)) for la in words for _ in range(40)]
    assert sum(model.predict(t)[0] == la for la, t in tried) / len(tried) > 0.97


def test_one_repeated_row_still_teaches_its_language(spark):
    docs = spark.createDataFrame([(1, "the same words again", "en")] * 3000 + [(3, "altro testo qui scritto", "it")] * 2000, "doc_id long, text string, lang string")
    docs = docs.where(~L.held_out())
    assert set(L.train(docs, sample=2).languages) == {r.lang for r in docs.select("lang").distinct().collect()}


def test_held_out_rows_and_labels_are_not_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = L.train(docs), L.train(spoiled)
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids)


def test_awkward_documents(spark):
    docs = documents(spark)
    model = L.train(docs)
    got = L.predict(docs, model).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 8)} == {"und"}
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns and 1 in [r.doc_id for r in kept.collect()] and 8 not in [r.doc_id for r in kept.collect()]
    empty = docs.limit(0)
    nothing = L.train(empty)
    assert nothing.languages == [] and {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"} and L.predict(empty, model).count() == 0


def test_bounds_hold():
    x = np.random.default_rng(1).normal(size=(200, 64)) * np.exp(np.random.default_rng(2).normal(size=(200, 1)) * 3)
    q, s, rest = quantise(x)
    assert (np.sqrt(((x - q * s[:, None]) ** 2).sum(1)) <= rest).all() and np.abs(q).max() <= 127


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r, i, round(s, 9)) for r, (s, i) in enumerate(d[:k], 1)}
    return out


def test_neighbours_equal_brute_force(spark):
    from pyspark.sql import functions as F

    g = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=6)]) for i in range(420)]
    rows += [(i, [1.0] * 6) for i in range(500, 560)] + [(600, [1.0] * 6), (700, None), (701, [0.0] * 6), (702, [float("nan")] + [1.0] * 5), (703, [None] + [1.0] * 5), (800, []), (900, [1.0, 2.0]), (901, [3.0, 2.0]), (None, [1.0] * 6), (1000, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string" if False else "vec_id long, embedding array<double>, score string")
    rows = [r for r in rows if r[0] != 1000]
    got = nearest(df.where("vec_id is null or vec_id <> 1000"), F.col("vec_id") % 100 == 0)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()} == brute(rows, 10)
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest(df, F.col("vec_id") % 100 == 0).count() == got.count() + 10


def test_cells_of_ties_and_tiny_numbers():
    y = np.array([[1e-200, 0.0], [2e-200, 0.0], [2e-200, 0.0], [3e-200, 0.0]])
    found = cell_search(y[:1], np.array([0]), y, np.arange(4), 2)
    assert [i for _, i in found[0]] == [1, 2]
