import random
import re
import time
from itertools import product

import numpy as np

from labelwright.llm import pii

from .helpers import documents, texts

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    o = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    o += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    o += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    o += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(o)]


def test_patterns_equal_plain_search():
    draw = random.Random(1)
    parts = ["a", "1", "2", "255", "300", ".", "@", "@", "-", " ", "+", "(", ")", "%", "_", "4111111111111111", "é", "\n", "a@b.c", "1.2.3.4", "+1 (131) 555-7634", ".com", "٣"]
    for _ in range(20000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert pii.base_spans(t) == brute(t)


def test_patterns_are_linear_in_the_text():
    t = time.time()
    for x in ("a" * 300000 + "@", "1" * 300000, "@a" * 100000, "+1 " * 60000, "1." * 100000):
        pii.base_spans(x)
    assert time.time() - t < 20


def test_viterbi_is_the_best_path():
    field = pii.train(pii.labelled_table(120, 5), rounds=25)
    draw = np.random.default_rng(2)
    runs = [[draw.integers(0, len(field.names), 8).tolist() for _ in range(n)] for n in (1, 2, 3, 3, 4)]
    for run, got in zip(runs, pii.viterbi(field, runs), strict=True):
        e = [field.emission[r].sum(0) for r in run]

        def total(path, e=e):
            full = (0, *path, 0)
            return sum(field.transition[a, b] for a, b in zip(full, full[1:], strict=False)) + sum(x[y] for x, y in zip(e, path, strict=True))

        best = max(total(p) for p in product(range(len(pii.LABELS)), repeat=len(run)))
        assert abs(total(got) - best) < 1e-9


def test_field_generalises_to_new_sentences():
    field = pii.train()
    right = n = 0
    for tokens, labels in pii.labelled_table(200, seed=77):
        text, at, want = " ".join(tokens), 0, []
        for w, la in zip(tokens, labels, strict=True):
            if la[0] == "B":
                want.append([at, la[2:], at + len(w)])
            elif la[0] == "I":
                want[-1][2] = at + len(w)
            at += len(w) + 1
        _, got = pii.find_batch([text], field)[0]
        right += [list(x) for x in got] == want
        n += 1
    assert right / n > 0.93


def test_added_spans_and_redaction():
    field = pii.train()
    base, both = pii.find_batch(["call (131) 555-7634 today or mail bo.x@mail1.example.com ok"], field)[0]
    assert [k for _, k, _ in base] == ["email"] and [k for _, k, _ in both] == ["phone", "email"]
    assert pii.redact("x a@b.c y", [(2, "email", 7)]) == "x <email> y"


def test_the_tail_of_a_long_token_decides():
    head = "x" * 190
    one, other = ([head + tail, "5"] for tail in ("7@site.de", "-7-------"))
    assert pii.features(one, 0) != pii.features(other, 0) and pii._shape(one[0])[0].endswith("7@x.x"[1:] + "~")
    # a field that goes by the whole shape alone tells the two apart
    field = pii.train([(one, ["B-email", "O"]), (other, ["O", "O"])] * 30, rounds=80)
    spans = [pii.find_batch([" ".join(t)], field)[0][1] for t in (["a " + one[0] + "!"], ["a " + other[0] + "!"])]
    assert [k for _, k, _ in spans[0]] == ["email"] and not spans[1]


def test_awkward_documents(spark):
    docs = documents(spark)
    out = pii.find_personal_data(docs, pii.train(pii.labelled_table(60), rounds=5))
    spell = lambda t: ",".join(f"{k}:{s}:{e}" for s, k, e in brute(t))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.base) for r in out.collect()) == sorted((i is not None, i or 0, spell(t)) for i, t in texts(docs))
    assert pii.find_personal_data(docs.limit(0), pii.train(pii.labelled_table(60), rounds=2)).count() == 0
