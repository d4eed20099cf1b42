"""Personal data: pattern spans, and more by a linear-chain conditional random field over word-shape features.

The patterns are matched left to right without overlaps, each kind by itself, in time linear in the text.
The field labels white-space tokens with O or B-/I- of a kind. It is trained from a small labelled table (by
default one made by the rule `labelled_table`) and decoded by Viterbi, in numpy batches over many texts.
A token without digit and @ can only be O, in training as in decoding; so a text's best path splits into
runs of the other tokens between two O, and decoding those runs is decoding the whole text. Spans that the
field adds are kept if they overlap no pattern span; pattern spans always stay.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_caches, slices, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_ANY = re.compile("[0-9@]")
_LOCAL = re.compile("[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile("[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'!,.;:%&$#*<>[]{}?|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ can belong to one match only: its local part begins at the run before it, or at the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the patterns, ascending by start, then by kind as listed; code points, end exclusive."""
    if not _ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


# ---- features


def _shape(token: str) -> tuple[str, str]:
    """A token's shape with the lengths of its digit runs, and without lengths; validity marks after either."""
    full, short, digits, run, last = [], [], [], 0, ""
    for c in token:
        kind = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if kind == "9":
            run += 1
            digits.append(c)
        elif run:
            full.append(f"9{min(run, 9)}")
            run = 0
        if kind != "9" and not (kind in "xX" and kind == last):
            full.append(kind)
        if kind != last or kind not in "9xX":
            short.append(kind)
        last = kind
    if run:
        full.append(f"9{min(run, 9)}")
    marks = ""
    if 13 <= len(digits) <= 19:
        marks = "L" if luhn("".join(digits)) else "l"
    elif token.count(".") == 3 and (p := token.split(".")) and all(x.isdecimal() and len(x) < 4 for x in p):
        marks = "Q" if all(int(x) <= 255 for x in p) else "q"
    if len(token) > 64:
        marks += "~"
    return "".join(full) + marks, "".join(short) + marks


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without marks at its edges."""
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    while start < end and text[start] in _EDGE:
        start += 1
    return start, end


def features(tokens: list[str], i: int, shapes: list[tuple[str, str]] | None = None) -> tuple[str, ...]:
    """The features of token i: its shapes, those of its neighbours, its length. All of them are of whole tokens."""
    shapes = shapes or {k: _shape(tokens[k]) for k in range(max(0, i - 1), min(len(tokens), i + 2))}
    full, short = shapes[i]
    before = shapes[i - 1][1] if i else "^"
    after = shapes[i + 1][1] if i + 1 < len(tokens) else "$"
    return (f"f:{full}", f"s:{short}", f"p:{before}", f"n:{after}", f"ps:{before}|{short}", f"sn:{short}|{after}", f"l:{min(len(tokens[i]) // 4, 8)}", f"a:{'@' in tokens[i]}")


# ---- the small labelled table


def labelled_table(sentences: int = 700, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """Sentences as (tokens, labels) made by a rule: filler words, personal data of each kind in several forms, and look-alikes."""
    draw = random.Random(seed)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghilmnoprstuvéñü") for _ in range(draw.randint(2, 9)))
    octet = lambda: str(draw.randint(0, 255))

    def card(n: int) -> str:
        s = str(draw.randint(3, 6)) + d(n - 2)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def wrong_card(n: int) -> str:
        s = card(n)
        return s[:-1] + str((int(s[-1]) + draw.randint(1, 9)) % 10)

    name = lambda: draw.choice([word().replace("é", "e").replace("ñ", "n").replace("ü", "u"), f"{word()[:1] or 'a'}.x"])
    made = {
        "email": [lambda: f"{name()}{draw.choice(['.', '_', ''])}{d(draw.randint(0, 2))}@mail{d(1)}.example.com", lambda: f"{name()}@site.{draw.choice(['de', 'org', 'co.uk'])}", lambda: f"{name()}@host"],
        "ip": [lambda: ".".join(octet() for _ in range(4))],
        "card": [lambda: card(16), lambda: " ".join(re.findall("....", card(16))), lambda: "-".join(re.findall("....", card(16))), lambda: card(15)],
        "phone": [lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"+{d(11)}"],
    }
    other = [
        lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: d(draw.randint(1, 8)), lambda: f"{d(2)},{d(3)}.{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}",
        lambda: wrong_card(16), lambda: wrong_card(15), lambda: d(22), lambda: f"{draw.randint(256, 999)}.{octet()}.{octet()}.{draw.randint(256, 999)}", lambda: f"#{d(5)}", lambda: f"@{word()}",
        lambda: "".join(draw.choice("0123456789abcdef") for _ in range(32)), lambda: f"{d(3)}-{d(2)}", lambda: f"v{d(1)}.{d(1)}", lambda: f"{d(1)}.", lambda: f"({d(1)})", lambda: f"x{d(4)}", lambda: "0x" + d(6), lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}",
        lambda: f"{d(4)} {d(3)}", lambda: f"{d(2)} {d(2)} {d(2)}",
    ]
    out = []
    for _ in range(sentences):
        tokens, labels = [], []
        for _ in range(draw.randint(1, 4)):
            for _ in range(draw.randint(0, 4)):
                tokens.append(word())
                labels.append("O")
            if draw.random() < 0.5:
                kind = draw.choice(KINDS)
                own = draw.choice(made[kind])().split(" ")
                tokens += own
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(own) - 1)
            else:
                own = draw.choice(other)().split(" ")
                tokens += own
                labels += ["O"] * len(own)
            tokens.append(word())
            labels.append("O")
        out.append((tokens, labels))
    return out


# ---- the field


@dataclass
class Field:
    """Weights: names of features to rows of `emission` (the last row is for unknown ones), and `transition` (from, to)."""

    names: dict
    emission: object
    transition: object

    def rows(self, feats: tuple[str, ...]) -> list[int]:
        unknown = len(self.names)
        return [self.names.get(f, unknown) for f in feats]


def _free(token: str) -> bool:
    return bool(_ANY.search(token))


def _logsum(x, axis: int):
    import numpy as np

    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]] | None = None, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by full-batch Adam; the same table gives the same field."""
    import numpy as np

    table = labelled_table() if table is None else table
    kinds = len(LABELS)
    runs = []  # (features of each token, labels) of each run of free tokens
    for tokens, labels in table:
        i = 0
        while i < len(tokens):
            if not _free(tokens[i]):
                i += 1
                continue
            j = i
            while j < len(tokens) and _free(tokens[j]):
                j += 1
            runs.append(([features(tokens, k) for k in range(i, j)], [LABELS.index(x) for x in labels[i:j]]))
            i = j
    names = {f: i for i, f in enumerate(sorted({f for feats, _ in runs for own in feats for f in own}))}
    longest, width = max((len(y) for _, y in runs), default=1), len(features(["0"], 0))
    x = np.full((len(runs), longest, width), len(names))
    y, live = np.zeros((len(runs), longest), int), np.zeros((len(runs), longest), bool)
    for r, (feats, own) in enumerate(runs):
        for t, f in enumerate(feats):
            x[r, t] = [names[k] for k in f]
        y[r, : len(own)] = own
        live[r, : len(own)] = True
    emission, transition = np.zeros((len(names) + 1, kinds)), np.zeros((kinds, kinds))
    m = [np.zeros_like(emission), np.zeros_like(transition)]
    v = [np.zeros_like(emission), np.zeros_like(transition)]
    one = np.eye(kinds)
    ends = live.sum(1) - 1
    for step in range(1, rounds + 1):
        score = emission[x].sum(2)
        alpha = np.zeros_like(score)
        beta = np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + transition[0]
        for t in range(1, longest):
            alpha[:, t] = np.where(live[:, t, None], score[:, t] + _logsum(alpha[:, t - 1, :, None] + transition[None], 1), alpha[:, t - 1])
        total = _logsum(alpha[:, -1] + transition[None, :, 0], 1)
        for t in range(longest - 1, -1, -1):
            if t == longest - 1:
                beta[:, t] = transition[None, :, 0]
            else:
                beta[:, t] = np.where(live[:, t + 1, None], _logsum(transition[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), transition[None, :, 0])
        g_e, g_t = np.zeros_like(emission), np.zeros_like(transition)
        point = np.exp(alpha + beta - total[:, None, None]) * live[..., None] - one[y] * live[..., None]
        np.add.at(g_e, x[live].ravel(), np.repeat(point[live], width, axis=0))
        g_t[0] += point[:, 0].sum(0)
        g_t[:, 0] += point[np.arange(len(runs)), ends].sum(0)
        for t in range(1, longest):
            both = live[:, t]
            if both.any():
                p = np.exp(alpha[both, t - 1, :, None] + transition[None] + (score[both, t] + beta[both, t])[:, None, :] - total[both, None, None])
                g_t += p.sum(0) - np.einsum("na,nb->ab", one[y[both, t - 1]], one[y[both, t]])
        for k, (w, g) in enumerate(((emission, g_e), (transition, g_t))):
            g = g / max(1, len(runs)) + decay * w / 10
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        emission[-1] = 0
    return Field(names, emission, transition)


def viterbi(field: Field, runs: list[list[list[int]]]) -> list[list[int]]:
    """The best labels of each run (feature rows of each token), an O before and after it; runs of like length go together."""
    import numpy as np

    out: list = [None] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    at = 0
    while at < len(order):
        # a batch holds about 4096 tokens, padded to the length of its longest run
        to, longest = at, 0
        while to < len(order) and (to == at or len(runs[order[to]]) * (to + 1 - at) <= 4096):
            longest = len(runs[order[to]])
            to += 1
        own = order[at:to]
        n = np.array([len(runs[i]) for i in own])
        score = np.zeros((len(own), longest, len(LABELS)))
        for r, i in enumerate(own):
            score[r, : n[r]] = field.emission[np.array(runs[i])].sum(1)
        best = score[:, 0] + field.transition[0]
        back = np.zeros((len(own), longest, len(LABELS)), np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + field.transition[None]
            live = (t < n)[:, None]
            back[:, t] = np.where(live, ways.argmax(1), np.arange(len(LABELS))[None])
            best = np.where(live, ways.max(1) + score[:, t], best)
        last = (best + field.transition[None, :, 0]).argmax(1)
        path = np.zeros((len(own), longest), int)
        for t in range(longest - 1, -1, -1):
            path[:, t] = last
            last = back[np.arange(len(own)), t, last] if t else last
        for r, i in enumerate(own):
            out[i] = path[r, : n[r]].tolist()
        at = to
    return out


def find_batch(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    runs, places = [], []
    for number, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        spans = [_core(text, *m.span()) for m in _TOKEN.finditer(text)]
        free = [i for i, (s, e) in enumerate(spans) if s < e and _ANY.search(text, s, e)]
        k = 0
        while k < len(free):
            j = k
            while j + 1 < len(free) and free[j + 1] == free[j] + 1:
                j += 1
            lo, hi = free[k], free[j] + 1
            near = [text[s:e] for s, e in spans[max(0, lo - 1) : hi + 1]]
            shapes = [_shape(t) for t in near]
            shift = lo - max(0, lo - 1)
            runs.append([field.rows(features(near, shift + t, shapes)) for t in range(hi - lo)])
            places.append((number, spans[lo:hi]))
            k = j + 1
    added: list = [[] for _ in texts]
    for (number, spans), labels in zip(places, viterbi(field, runs), strict=True):
        t = 0
        while t < len(labels):
            if not labels[t]:
                t += 1
                continue
            kind = (labels[t] - 1) // 2
            u = t + 1
            while u < len(labels) and labels[u] == 2 * kind + 2:
                u += 1
            added[number].append((spans[t][0], kind, spans[u - 1][1]))
            t = u
    out = []
    for own, more in zip(base, added, strict=True):
        if more:
            new, i = [], 0
            taken = sorted((s, e) for s, _, e in own)
            far = 0  # the furthest end of pattern spans that start before
            for s, kind, e in sorted(more):
                while i < len(taken) and taken[i][0] < e:
                    far = max(far, taken[i][1])
                    i += 1
                if far <= s:
                    new.append((s, kind, e))
            both = sorted([(s, KINDS.index(k), e) for s, k, e in own] + new)
            out.append((own, [(s, KINDS[k], e) for s, k, e in both]))
        else:
            out.append((own, own))
    return out


def _spell(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (kind:start:end by start, then kind, comma-joined) of every row, over whole texts.

    A null text is empty; null doc_ids and repeated rows stay; other columns are not read. Texts and tokens of
    any length are read whole, in time linear in them. Of spans with one start the kind listed first stands
    first. Empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget_caches()
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                found = find_batch(batch.column(1).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_spell(b) for b, _ in found], pa.string()), pa.array([_spell(a) for _, a in found], pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).mapInArrow(run, "doc_id long, base string, spans string")


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])
