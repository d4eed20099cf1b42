import re

from labelwright.llm import decontamination as D

from .helpers import documents, frame, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - n + 1)) if v else []:
                x = v[k : k + n]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        ids.add(str(item) if item is not None else "")
        out.append((i is not None, i or 0, len(w), len(hit), sorted(ids)))
    return sorted(out)


ITEMS = [(1, "the quick brown FOX jumps over the lazy dog while seven"), (2, "lazy dog"), (2, "lazy dog"), (3, None), (4, "..."), (None, "small grey mouse"), (6, "lorem ipsum lorem ipsum lorem ipsum lorem ipsum lorem ipsum"), (7, "never seen words")]


def result(out):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r.items)) for r in out.collect())


def test_equals_brute_force_and_blocks_change_nothing(spark):
    docs = documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(texts(docs), ITEMS, 10)
    assert result(D.find_contamination(docs, items, 10)) == want
    assert result(D.find_contamination(docs, items, 10, block_bytes=200)) == want


def test_phrases_never_cross_documents(spark):
    docs = frame(spark, [(1, "alpha beta", "en", "a", 0), (2, "gamma delta", "en", "a", 0)])
    items = spark.createDataFrame([(1, "beta gamma"), (2, "alpha beta gamma")], "item_id long, text string")
    assert all(not r.spans and not r.near_spans for r in D.find_contamination(docs, items, 10).collect())


def test_proximity_allows_slop_words(spark):
    docs = frame(spark, [(1, "one two extra three four", "en", "a", 0), (2, "one two a b c d three four", "en", "a", 0)])
    items = spark.createDataFrame([(9, "one two three four")], "item_id long, text string")
    got = {r.doc_id: r for r in D.find_contamination(docs, items, 4, slop=2).collect()}
    assert got[1].near_items == ["9"] and not got[1].items
    assert not got[2].near_items


def test_empty_inputs_and_filter(spark):
    docs = documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_contamination(docs.limit(0), items).count() == 0
    assert all(not r.spans for r in D.find_contamination(docs, items.limit(0)).collect())
    kept = D.decontaminate(docs, items.where("item_id = 2"), 10)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 3} & set(left) and {4, 5, 7, 8, 9, 10, 12} <= set(left)


def test_two_benchmarks_share_one_index(spark):
    docs = documents(spark)
    one, two = (spark.createDataFrame(x, "item_id long, text string") for x in (ITEMS[:3], ITEMS[3:]))
    index = D.written_index(docs)
    words = {w for _, t in texts(docs) for w in D.words_of(t.encode())}
    assert {r.term.encode() for r in index.where("term is not null").collect()} == words
    for items, rows in ((one, ITEMS[:3]), (two, ITEMS[3:])):
        assert result(D.find_contamination(docs, items, 10, index=index)) == brute(texts(docs), rows, 10)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 50)
    long = [t for _, t in texts(documents(spark)) if t]
    for t in [*long, "x" * 200, " ".join(long), ""]:
        terms, ends, differences, first, n = D._postings([b"a b", t.encode(), b"c"])
        words_ = D.words_of(t.encode())
        assert n.tolist() == [2, len(words_), 1]
        start = 0
        for term, end in zip(terms, ends.tolist(), strict=True):
            at = [int(x) for x in differences[start:end].cumsum()]
            assert [p - int(first[1]) for p in at if first[1] <= p < first[1] + n[1]] == [i for i, w in enumerate(words_) if w == term]
            start = end


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    docs = frame(spark, [(None, "the lazy dog", "en", "a", 0), (None, "clean", "en", "a", 0), (7, "a lazy dog", "en", "a", 0), (7, "clean too", "en", "a", 0)]).withColumnRenamed("component_id", "file")
    kept = D.decontaminate(docs, spark.createDataFrame([(2, "lazy dog")], "item_id long, text string"), 10)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["clean", "clean too"]


def test_near_matches_at_the_start_stay_in_their_document(spark):
    docs = frame(spark, [(1, "zz zz zz", "en", "a", 0), (2, "two rare four", "en", "a", 0)])
    got = {r.doc_id: r for r in D.find_contamination(docs, spark.createDataFrame([(9, "two x rare four"), (8, "two two rare four")], "item_id long, text string"), 4, slop=2).collect()}
    assert got[2].near_items == ["8"] and [(s.start, s.end) for s in got[2].near_spans] == [(0, 3)] and not got[1].near_spans
