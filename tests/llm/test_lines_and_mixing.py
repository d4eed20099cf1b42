from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelwright.llm import line_dedup, mixing
from labelwright.llm.line_dedup import drop_boilerplate
from labelwright.llm.mixing import equal_cycle, in_mix_order, mix, schedule

from .helpers import documents


def pages(spark):
    rows = [(i, "http://u@Site.example:80/a?x", f"<p>Menu</p><p>own {i} text<br>Shared</p><!-- <p>x</p> --><script>var a='<p>no</p>'</script>") for i in range(10)]
    rows += [(20, "https://other.example/", "<p>Menu</p>"), (21, None, None), (22, "odd", ""), (None, "https://other.example/", "plain"), (9, "http://site.example/", "<div>Menu</div><div>Menu</div>")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, kept_text string")


def test_boilerplate_goes_and_own_lines_stay(spark):
    got = drop_boilerplate(pages(spark)).collect()
    assert len(got) == 15
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert (by[3][0].host, by[3][0].kept_text, by[3][0].n_lines, by[3][0].n_dropped) == ("site.example", "own 3 text", 3, 2)
    assert sorted(r.kept_text for r in by[9]) == ["", "own 9 text"]
    assert by[20][0].kept_text == "Menu" and by[21][0].n_lines == 0 and by[None][0].kept_text == "plain"
    assert drop_boilerplate(pages(spark).limit(0)).count() == 0


def test_large_boilerplate_is_joined_by_salted_keys(spark, monkeypatch):
    want = sorted(map(str, drop_boilerplate(pages(spark)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(str, drop_boilerplate(pages(spark)).collect())) == want


@pytest.mark.parametrize("shares", [[1], [1, 1], [3, 1, 2], [7, 5, 3, 1, 1], [1] * 9 + [23], [2, 3, 5, 7, 11, 13]])
def test_schedule_deviates_by_less_than_a_block(spark, shares):
    w = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(shares)], "source string, share long")
    rows = schedule(w).orderBy("slot").collect()
    q = sum(shares)
    assert [r.slot for r in rows] == list(range(q))
    done = Counter()
    for t, r in enumerate(rows, 1):
        assert r.turn == done[r.source]
        done[r.source] += 1
        for i, s in enumerate(shares):
            assert abs(done[f"s{i:02}"] - t * s / q) < 1
    assert [done[f"s{i:02}"] for i in range(len(shares))] == shares


def test_every_row_gets_one_place(spark):
    docs = documents(spark).withColumnRenamed("row", "mix_slot")
    out = mix(docs, equal_cycle(docs), block=2)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_order"]
    assert len({r.mix_order for r in rows}) == len(rows)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    laid = in_mix_order(docs, equal_cycle(docs), block=2)
    assert laid.columns == docs.columns and laid.count() == docs.count()
    empty = docs.limit(0)
    assert mix(empty, equal_cycle(docs)).count() == 0


def test_bad_weights_raise(spark):
    docs = documents(spark)
    w = lambda rows: spark.createDataFrame(rows, "source string, share long")
    for rows in ([("a", 0)], [("a", 1), ("a", 2)]):
        with pytest.raises(ValueError):
            mix(docs, w(rows))
    with pytest.raises(Exception, match="no weight"):
        mix(docs, w([("a", 1)])).collect()


@pytest.mark.parametrize(("shares", "segment"), [([7, 5, 3, 1, 1] * 3, 8), ([1] * 40 + [23, 5], 16), ([1 + i % 5 for i in range(5000)], None)])
def test_segments_of_a_long_period_keep_the_deviation(spark, shares, segment):
    w = spark.createDataFrame([(f"s{i:05}", s) for i, s in enumerate(shares)], "source string, share long")
    rows = schedule(w, segment).orderBy("slot").collect()
    q, number = sum(shares), {f"s{i:05}": i for i in range(len(shares))}
    assert [r.slot for r in rows] == list(range(q))
    if q < 4096:
        assert [tuple(r) for r in rows] == [tuple(r) for r in schedule(w, 4096).orderBy("slot").collect()]
    done = Counter()
    for t, r in enumerate(rows):
        s = shares[number[r.source]]
        k = done[r.source]
        # block k runs from its release on and before it is due: less than one block off at any time
        assert r.turn == k and k * q // s <= t < -(-(k + 1) * q // s)
        done[r.source] += 1
    assert [done[f"s{i:05}"] for i in range(len(shares))] == shares


def test_more_sources_than_a_segment_has_slots(spark):
    docs = spark.range(6000).select("id", (F.col("id") % 3000).cast("string").alias("source")).withColumnRenamed("id", "doc_id")
    rows = mix(docs, equal_cycle(docs), block=1).collect()
    assert len({r.mix_order for r in rows}) == 6000


def test_one_id_for_all_rows_is_dealt_over_buckets(spark, monkeypatch):
    docs = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("n"))
    want = {r.n: r.mix_order for r in mix(docs, equal_cycle(docs)).collect()}
    monkeypatch.setattr(mixing, "LARGE_BUCKET", 40)
    assert {r.n: r.mix_order for r in mix(docs, equal_cycle(docs)).collect()} == want and sorted(want.values()) == list(range(4000))


def test_columns_with_the_names_of_the_mix_come_back(spark):
    docs = documents(spark).withColumnRenamed("row", "mix_slot").withColumnRenamed("n_tokens", "own_mix_slot")
    laid = in_mix_order(docs, equal_cycle(docs), block=2)
    assert laid.columns == docs.columns and sorted(map(str, laid.collect())) == sorted(map(str, docs.collect()))
