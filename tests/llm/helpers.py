"""Small awkward inputs, shared by the tests of this folder."""

LONG = "lorem ipsum " * 9000


def frame(spark, rows, extra=""):
    """documents with columns that clash with results."""
    out = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id int, row string")
    return out


def documents(spark):
    p = "The quick brown fox jumps over the lazy dog while seven wise owls look on and say nothing at all to the small grey mouse below. "
    rows = [
        (1, p + "one", "en", "a"), (2, p + "one", "en", "a"), (3, p + "two", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (None, "no id here " + p, "en", "b"),
        (7, LONG, "en", "a"), (8, "   \n\t ", "de", "a"), (9, "\U0001f600 é 漢字 ▁ x  y", "fr", "c"), (10, "short", "en", "c"), (10, "short", "en", "c"), (None, None, None, None), (12, "<|endoftext|> a\n\nb \r\n", "en", "a"),
    ]
    return frame(spark, [(i, t, la, s, len(t or "")) for i, t, la, s in rows])


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same(a, b):
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
