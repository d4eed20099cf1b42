import hashlib
import random

from labelwright.llm import suffix_dedup as S

from .helpers import documents, texts


def brute(docs, w=100):
    """docs: (id, bytes) in order."""
    seen, out = set(), []
    for i, b in docs:
        n, k, cov = len(b), 0, bytearray(len(b))
        for s in range(n - w + 1):
            x = b[s : s + w]
            if x in seen:
                a = max(s, k)
                cov[a : s + w] = b"\1" * (s + w - a)
                k = s + w
            else:
                seen.add(x)
        kept = bytes(c for c, f in zip(b, cov, strict=True) if not f)
        spans = sum(1 for j in range(n) if cov[j] and (j == 0 or not cov[j - 1]))
        out.append((i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in S.remove_repeats(df).collect())
    assert got == sorted(brute(sorted((i, (t or "").encode()) for i, t in rows)))


def test_shared_passages_and_near_copies(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    base = " ".join(word() for _ in range(400))
    rows = []
    for i in range(40):
        w = base.split(" ")
        for _ in range(draw.randint(0, 12)):
            w[draw.randrange(len(w))] = word()
        own = " ".join(word() for _ in range(draw.randint(0, 80)))
        rows.append((i, draw.choice([" ".join(w), own + passage, passage + own, own, passage[50:250] + own + passage[:120], base[13:]])))
    check(spark, rows)


def test_periodic_and_edge_lengths(spark):
    draw = random.Random(9)
    x = "".join(draw.choice("xyz01") for _ in range(300))
    rows = [(1, "ab" * 200), (2, "a" * 500), (3, "a" * 99), (4, "a" * 100), (5, "abc" * 60 + "ab" * 60), (6, x[:100]), (7, x[:101]), (8, x[1:101]), (9, x[:99]), (10, x + x), (11, None), (12, ""), (13, "\0" * 150), (14, "\0" * 120 + "é" * 80), (15, "b" * 130 + "\0"), (16, "b" * 130)]
    check(spark, rows)


def test_awkward_documents(spark):
    docs = documents(spark)
    got = sorted((r.doc_id is not None, r.doc_id or 0, *tuple(r)[1:]) for r in S.remove_repeats(docs).collect())
    order = sorted(((i is not None, i or 0), t.encode()) for i, t in texts(docs))
    assert got == sorted((*i, *rest) for i, *rest in brute(order))
    assert S.remove_repeats(docs.limit(0)).count() == 0
    out = S.remove_repeats(docs, want_text=True).where("doc_id = 2").first()
    assert out.n_removed == sum(x.end - x.start for x in out.removed) and len(out.kept) == out.n_bytes - out.n_removed


def test_loser_tree_merges_and_tells_prefix_lengths():
    draw = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        runs = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 30))) for _ in range(k)]
        coded = [S.front_code(r) for r in runs]
        for r, c in zip(runs, coded, strict=True):
            assert [t for t, _ in S.read_run(*c)] == r
        who, shared, out = S.merge_runs([S.read_run(*c) for c in coded])
        flat = sorted(t for r in runs for t in r)
        assert out == flat and len(who) == len(flat)
        for i in range(1, len(flat)):
            a, b = flat[i - 1], flat[i]
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert shared[i] == n


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    import numpy as np

    draw = random.Random(12)
    x = "".join(draw.choice("abcde ") for _ in range(5000))
    data = np.frombuffer(x.encode(), np.uint8)
    ends = np.array([len(x)])
    windows = lambda a: {(int(p), w) for s, p, e in zip(*a[3:], strict=True) for w in range(int(s), int(e) + 1)}
    whole = windows(S.anchors(data, np.array([0]), ends, 5))
    monkeypatch.setattr(S, "PIECE_BYTES", 333)
    assert windows(S.piecewise(data, np.array([0]), ends, 5)) == whole and len(whole) == 5000 - 99
    # the driver's pieces, in one process: workers read the module anew
    keys = S.piecewise(data, np.array([0]), ends, 5)
    again = S.piecewise(np.concatenate([data, data]), np.array([0, 5000]), np.array([5000, 10000]), 5)
    assert len(again[0]) == 2 * len(keys[0]) and windows(again) == whole | {(p + 5000, w + 5000) for p, w in whole}


def test_one_line_in_every_document(spark):
    draw = random.Random(13)
    line = "this very line of some hundred and forty bytes stands in every document of the table, at the same or at another place, and so it fills one group"
    word = lambda: "".join(draw.choice("abcde") for _ in range(4))
    check(spark, [(i, " ".join([word() for _ in range(draw.randint(0, 30))] + [line] + [word() for _ in range(20)])) for i in range(150)])


def test_a_task_sends_one_anchor_for_each_content():
    import numpy as np

    n = 1000
    a = {"h": np.repeat(np.uint64(7), n), "full": np.arange(n, dtype=np.uint64) % 3, "more": np.zeros(n, np.uint64), "doc": np.arange(n)[::-1], "p": np.zeros(n, np.int64), "row": np.zeros(n, np.int64), "chunk": np.zeros(n, np.int64)}
    first, told = S.combine(a)
    assert sorted(first["doc"].tolist()) == [0, 1, 2] and len(told["doc"]) == n - 3
