import random

import numpy as np
import pytest

import corpus_pipeline
from labelwright.llm import near_copies as N
from labelwright.llm import simhash as S

from .helpers import documents, frame, texts


def shingles(t, k=5):
    w = t.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(all_texts):
    sets, parent = [shingles(t) for t in all_texts], list(range(len(all_texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def planted():
    """Texts, copies of them with one to six words changed, a common line, and a large group of near copies."""
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    line, out = words(9), []
    for _ in range(40):
        own = words(draw.randint(4, 200))
        out.append(own)
        for _ in range(2):
            copy = list(own)
            for _ in range(draw.randint(1, 6)):
                copy[draw.randrange(len(copy))] = "changed"
            out.append(copy)
    out += [line + words(draw.randint(5, 40)) for _ in range(70)]
    base = words(120)
    for _ in range(70):
        copy = list(base)
        for at in draw.sample(range(120), draw.randint(1, 2)):
            copy[at] = words(1)[0]
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("large", "hot"), [(48, 500), (4, 20)])
def test_stage_keeps_one_of_each_planted_group(spark, sf, monkeypatch, large, hot):
    monkeypatch.setattr(N, "LARGE", large)
    monkeypatch.setattr(N, "HOT", hot)
    t = planted()
    docs = frame(spark, [(i, x, "en", "a", len(x)) for i, x in enumerate(t)])
    g = groups(t)
    assert len(set(g)) < len(t) - 80
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = [r.doc_id for r in stage(spark, docs, sf).collect()]
    assert sorted(kept) == sorted({c: i for i, c in reversed(list(enumerate(g)))}.values())


def test_awkward_rows(spark):
    docs = documents(spark)
    t = texts(docs)
    least = {}
    for (i, _), c in zip(t, g := groups([x for _, x in t]), strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    got = S.similar(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, least.get(c, -1)) for (i, _), c in zip(t, g, strict=True))
    assert S.similar(docs.limit(0)).count() == 0


def test_wide_fingerprints_count_bits_part_by_part():
    import numpy as np

    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(-(1 << 63), 1 << 63, n)) for n in (0, 1, 2, 7, 500, 150_000, 3, 0, 70_000)]
    for s, got in zip(sets, N.wide_fingerprints(sets), strict=True):
        w = s.view(np.uint64)
        x = (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        for half, word in zip((w, x ^ (x >> np.uint64(32))), got, strict=True):
            ones = [int(((half >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
            assert int(word) & (1 << 64) - 1 == sum(1 << b for b, c in enumerate(ones) if 2 * c > len(s))


def test_radius_loses_no_pair_at_the_limit():
    """Random pairs of sets of similarity 0.8 and a little more, of many sizes, are far inside the radius; two bits are not."""
    import numpy as np

    draw, far = np.random.default_rng(6), []
    for n in (5, 10, 18, 40, 200, 1000):
        for _ in range(400):
            both = draw.integers(-(1 << 63), 1 << 63, n)
            gone = n // 10
            a = np.unique(both[: n - gone]) if gone else np.unique(both)
            b = np.unique(np.concatenate([both[gone:], draw.integers(-(1 << 63), 1 << 63, 0 if gone else 1)]))
            if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
                w = N.wide_fingerprints([a, b]).view(np.uint64)
                far.append((sum(int(x).bit_count() for x in (w[0] ^ w[1]).tolist()), min(len(a), len(b))))
    assert len(far) > 1500 and all(d < (N.SMALL_RADIUS if n < N.SMALL_SET else N.RADIUS) for d, n in far) and np.mean([d > 4 for d, _ in far]) > 0.9


def test_long_texts_are_taken_in_pieces(monkeypatch):
    t = [x.encode() for _, x in [(0, "a b c d e f g " * 40), (1, "lone"), (2, "x y"), (3, ""), (4, "A b\tc\nd " * 9)]]
    want = S.fingerprint_batch(t), [s.tolist() for s in N.shingle_sets(t)]
    monkeypatch.setattr(S, "PIECE_BYTES", 3)
    monkeypatch.setattr(N, "PIECE_BYTES", 3)
    assert S.fingerprint_batch(t).tolist() == want[0].tolist() and [s.tolist() for s in N.shingle_sets(t)] == want[1]


def test_one_text_for_all_rows_and_rows_without_ids(spark):
    docs = frame(spark, [(i if i % 3 else None, "the same text again and again in every row", "en", "a", 0) for i in range(60)])
    kept = S.keep_one_similar(docs).collect()
    assert [r.doc_id for r in kept] == [1] and S.keep_one(docs).collect()[0].doc_id == 1
    assert S.keep_one_similar(docs.limit(0)).count() == 0 and {r.component_id for r in S.near_duplicates(docs).collect()} == {1}


def test_sketches_differ_in_no_more_bits_than_the_sets_in_hashes():
    draw = random.Random(5)
    sets, tight = [[], [], [7]], 0
    for _ in range(60):
        own = {draw.getrandbits(64) for _ in range(draw.choice([1, 9, 150, 3000]))}
        sets += [own, {draw.getrandbits(64) if draw.random() < 0.1 else h for h in own}]
    arrays = [np.array(sorted(s), np.uint64).view(np.int64) for s in sets]
    sketches = N.odd_sketches(arrays)
    assert sketches.shape == (len(sets), N.ODD)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(sketches[i], sketches[j], strict=True))
            assert bits <= len(set(a) ^ set(b))
            tight += 0 < len(set(a) ^ set(b)) <= bits + 4
    assert tight > 60


def test_a_group_around_a_text_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with up to four words changed: many are near copies of the text only, and not of each other."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(9000)}" for _ in range(150)]
    t = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        for at in draw.sample(range(150), draw.randint(1, 4)):
            copy[at] = f"n{i}-{at}"
        t.append(" ".join(copy))
    made, possible = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: (made.append(pairs.count()), possible(pairs, *a))[1])
    docs = frame(spark, [(i, x, "en", "a", len(x)) for i, x in enumerate(t)])
    rows = S.similar(docs).collect()
    got, want = {r.doc_id: r.component_id for r in rows}, groups(t)
    first = {}
    for i, g in enumerate(want):
        assert got[i] == got[first.setdefault(g, i)]
    assert len(set(got.values())) == len(set(want))
    assert sum(made) < 20 * len(t)
