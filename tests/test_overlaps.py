"""Matching by boxes: the same matches as over all pairs, without making them."""

import numpy as np

from labelwright.operators import evaluate as E
from labelwright.operators import overlaps as O


def rows(n, seed, span):
    draw = np.random.default_rng(seed)
    x, y, q = draw.integers(0, span, n) * 10.0, draw.integers(0, span // 2, n) * 10.0, draw.integers(0, 40, n).astype(float)
    ids, times = draw.permutation(n), draw.integers(1, 8, n) * 250.0
    pred = ids, times, np.column_stack([x, y, x + q * 5, y + 60 + q * 4])
    turn = np.arange(n) % 4
    move = np.where(turn == 3, 1e5, 20.0)[:, None]
    return (draw.permutation(n) + 10 * n, times + np.where(turn == 3, 60000.0, np.where(turn == 2, 4000.0, 0.0)), pred[2] + move), pred


def all_pairs(truth, pred):
    out = []
    for i, (g, t, a) in enumerate(zip(*truth, strict=True)):
        for j, (p, u, b) in enumerate(zip(*pred, strict=True)):
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w > 0 and h > 0:
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
                s = round(w * h / union * 3.0 + (0.5 if abs(t - u) <= 3000 else 0.0), 9)
                if s > 0.3:
                    out.append((i, j, int(g), int(p), s))
    return out


def test_best_box_and_greedy_fold_equal_those_over_all_pairs():
    for n, span in ((300, 60), (200, 8), (40, 300)):
        truth, pred = rows(n, n, span)
        pairs, want = all_pairs(truth, pred), {}
        for _, _, g, p, s in pairs:
            want[g] = min(want.get(g, (0.0, 0)), (-s, p))
        i, j, s = O.best_overlaps(truth, pred, E.WINDOW_MS)
        assert {int(truth[0][a]): (-float(c), int(pred[0][b])) for a, b, c in zip(i, j, s, strict=True)} == want
        coded = {g: [(p, "barcode", 100.0 + s)] for _, _, g, p, s in pairs if (g + p) % 5 == 0}
        strong = [(g, p, "barcode", 100.0 + s) if (p, "barcode", 100.0 + s) in coded.get(g, ()) else (g, p, "timestamp_bbox", s) for _, _, g, p, s in pairs]
        plain = E.greedy(strong, list(zip(truth[0].tolist(), truth[1].tolist(), strict=True)), list(zip(pred[0].tolist(), pred[1].tolist(), strict=True)))
        assert O.greedy_overlaps(truth, pred, coded, E.WINDOW_MS) == plain and plain


def test_few_of_the_overlapping_pairs_are_looked_at(monkeypatch):
    truth, pred = rows(6000, 1, 80)
    a, b = truth[2], pred[2]
    overlapping = sum(int(((np.minimum(x[2:], b[:, 2:]) - np.maximum(x[:2], b[:, :2])) > 0).all(1).sum()) for x in a[:500]) * 12
    seen, ranges = [], O.Boxes._ranges

    def counted(self, *args):
        for q, first, last, at in ranges(self, *args):
            seen.append(int((last - first).sum()))
            yield q, first, last, at

    monkeypatch.setattr(O.Boxes, "_ranges", counted)
    O.best_overlaps(truth, pred, E.WINDOW_MS)
    assert 0 < sum(seen) < overlapping / 2


def test_observations_are_no_single_method(spark, sf):
    from labelwright.plans import carriers as K

    plan = K.observations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    wide = next(line for line in plan.splitlines() if "AS print_datetime" in line or "AS filename" in line)
    assert "lambdafunction" in wide


def test_near_pairs_equal_those_of_all_pairs_and_ask_few_cells(spark):
    from labelwright.operators.dedup import near_pairs
    from labelwright.schema import TAG_COLUMNS

    draw, made = np.random.default_rng(3), []
    for i in range(240):
        x, y, w, h = (float(v) for v in (draw.integers(0, 30) * 37, draw.integers(0, 20) * 41, draw.choice([150, 260, 390, 420, 700]), draw.choice([150, 200, 410, 600])))
        made.append((i, dict.fromkeys(TAG_COLUMNS, "") | {"filename": "v", "x_min": x, "y_min": y, "x_max": x + w, "y_max": y + h, "frame_timestamp": float(draw.integers(0, 16) * 250)}))
    places = ("x_min", "y_min", "x_max", "y_max", "frame_timestamp")
    df = spark.createDataFrame([(i, *(r[c] for c in TAG_COLUMNS)) for i, r in made], "row_id long, " + ", ".join(f"{c} {'double' if c in places else 'string'}" for c in TAG_COLUMNS))
    want = set()
    for i, a in made:
        for j, b in made[i + 1 :]:
            w, h = (max(0.0, min(a[f"{c}_max"], b[f"{c}_max"]) - max(a[f"{c}_min"], b[f"{c}_min"])) for c in "xy")
            area = sum((r["x_max"] - r["x_min"]) * (r["y_max"] - r["y_min"]) for r in (a, b))
            if abs(a["frame_timestamp"] - b["frame_timestamp"]) <= 1500 and w * h / (area - w * h) >= 0.6:
                want.add((i, j, "box"))
    out = near_pairs(df)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 20
    asked = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(" in line]
    assert asked and not any("-1, 0, 1" in line or "transform" in line for line in asked)


def _tags(spark, rows):
    """Tag rows with '' where nothing is given; keys of rows: id and columns."""
    from labelwright.schema import TAG_COLUMNS

    places = ("x_min", "y_min", "x_max", "y_max", "frame_timestamp")
    made = [(r["id"], *({**dict.fromkeys(TAG_COLUMNS, ""), "filename": "v", **dict.fromkeys(places, 0.0), **r}[c] for c in TAG_COLUMNS)) for r in rows]
    return spark.createDataFrame(made, "row_id long, " + ", ".join(f"{c} {'double' if c in places else 'string'}" for c in TAG_COLUMNS))


def test_all_pairs_of_a_code_are_given(spark):
    from labelwright.operators.dedup import code_key, near_pairs

    codes = ["4600000000015"] * 4 + ["4006381333931"] * 2 + ["", "4600000000016"]
    files = ["v"] * 3 + [None, "v", "w", "v", "v"]
    df = _tags(spark, [{"id": i, "barcode": c, "filename": f} for i, (c, f) in enumerate(zip(codes, files, strict=True))])
    assert "4600000000015" in {r.code for r in df.select(code_key().alias("code")).collect()}
    inside = {(0, 1, "code"), (0, 2, "code"), (1, 2, "code")}
    assert set(map(tuple, near_pairs(df).collect())) == inside
    assert set(map(tuple, near_pairs(df, group=None).collect())) == inside | {(0, 3, "code"), (1, 3, "code"), (2, 3, "code"), (4, 5, "code")}


def test_near_boxes_of_any_limit_size_and_file_come_up_once(spark):
    from labelwright.operators.dedup import near_pairs

    draw, rows = np.random.default_rng(5), []
    for i in range(260):
        x, y, w, h = (float(v) for v in (draw.integers(-40, 40) * 23, draw.integers(-20, 20) * 31, draw.choice([0, 90, 250, 400, 900, 1700]), draw.choice([80, 260, 410, 1500])))
        code = ("", "", "4600000000015", "4006381333931")[draw.integers(0, 4)]
        rows.append({"id": i, "barcode": code, "filename": ("v", "w", None)[draw.integers(0, 3)], "x_min": x, "y_min": y, "x_max": x + w, "y_max": y + h, "frame_timestamp": float(draw.choice([0, 1500, 5999, 6000, 7500, 1e6]))})
    rows.append(rows[0] | {"id": 260, "x_max": float("nan")})
    rows.append(rows[1] | {"id": 261, "frame_timestamp": None})
    df = _tags(spark, rows)

    def over(a, b):
        w, h = (max(0.0, min(a[f"{c}_max"], b[f"{c}_max"]) - max(a[f"{c}_min"], b[f"{c}_min"])) for c in "xy")
        union = sum((r["x_max"] - r["x_min"]) * (r["y_max"] - r["y_min"]) for r in (a, b)) - w * h
        return w * h / union if union else 0.0

    for limit in (0.6, 0.3, 0.05, 1.0, 0.0):
        want = [(a["id"], b["id"]) for i, a in enumerate(rows[:260]) for b in rows[i + 1 : 260] if a["filename"] == b["filename"] and abs(a["frame_timestamp"] - b["frame_timestamp"]) <= 1500 and not (a["barcode"] and b["barcode"]) and over(a, b) >= limit]
        assert sorted((r.a, r.b) for r in near_pairs(df, least_iou=limit).where("why = 'box'").collect()) == sorted(want) and (want or limit == 1.0)


def test_tiles_that_come_in_pieces_are_whole():
    """A tile spread over many batches, and a long run of one row, give the pairs of one batch."""
    import pyarrow as pa

    from labelwright.operators import near_boxes as N

    n = 500
    cols = {"file": ["v"] * n, "lv": [0] * n, "tb": [0] * n, "tx": [i // 300 for i in range(n)], "ty": [0] * n, "id": list(range(n)), "coded": [False] * n, "t": [0.0] * n}
    x = [float(i // 300 * 400 + i % 7) for i in range(n)]
    cols |= {"x_min": x, "y_min": [0.0] * n, "x_max": [v + 100 for v in x], "y_max": [100.0] * n, "home": [True] * n}
    batch = pa.RecordBatch.from_pydict(cols)
    pieces = [batch.slice(i, 37) for i in range(0, n, 37)]
    rows, pairs = N.ROWS, N.PAIRS
    try:
        N.ROWS, N.PAIRS = 50, 64
        out = [tuple(sorted(p)) for b in N.near_boxes(iter(pieces), 0.6, 1500.0, 400.0) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    finally:
        N.ROWS, N.PAIRS = rows, pairs
    assert sorted(out) == [(i, j) for i in range(n) for j in range(i + 1, n) if i // 300 == j // 300]
