import random

from xxhash import xxh64_intdigest

from labelwright.llm import simhash as S
from labelwright.llm.common import work_folder
from labelwright.llm.components import components

from .helpers import documents, texts


def fingerprint(t):
    w = t.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    hs = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, most=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    docs = documents(spark)
    want = sorted((i is not None, i or 0, signed(fingerprint(t))) for i, t in texts(docs))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fp) for r in S.fingerprints(docs).collect()) == want


def test_links_miss_nothing_in_small_and_large_groups(spark):
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(150)}
    base = draw.getrandbits(64)
    for _ in range(150):  # over LARGE share each block with the base
        fps.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    folder = work_folder(spark)
    got = {r.node: r.root for r in components(S.links(df, folder), folder).collect()}
    want = groups(fps)
    for i, x in enumerate(fps):
        for j in range(i):
            linked = got.get(signed(x), x) == got.get(signed(fps[j]), fps[j])
            assert linked == (want[i] == want[j])


def test_components_are_smallest_ids(spark):
    docs = documents(spark)
    t = texts(docs)
    g = groups([fingerprint(x) for _, x in t])
    least = {}
    for (i, _), c in zip(t, g, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i is not None, i or 0, least.get(c, -1)) for (i, _), c in zip(t, g, strict=True))
    got = S.near_duplicates(docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, -1 if r.component_id is None else r.component_id) for r in got.collect()) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 10 in ids
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(edges, work_folder(spark)).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == 303
