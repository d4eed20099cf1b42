import random
import time

from labelwright.operators.tracks import match_frames


def plain(frames, least=0.25, lost=0):
    def joint(a, b):
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        u = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - w * h
        return w * h / u if u > 0 else 0.0

    known, out, next_id = {}, [], 0
    for number, boxes in enumerate(frames):
        taken, ids = set(), []
        for box in boxes:
            best, near = None, least
            for t, (old, seen) in known.items():
                if t not in taken and number - seen <= lost + 1 and (v := joint(old, box)) >= near and (best is None or v > near):
                    best, near = t, v
            if best is None:
                best, next_id = next_id, next_id + 1
            taken.add(best)
            ids.append(best)
        known = {t: v for t, v in known.items() if number - v[1] <= lost} | {t: (b, number) for t, b in zip(ids, boxes, strict=True)}
        out.append(ids)
    return out


def boxes(draw, n, wide):
    return [(x := float(draw.randrange(wide)), y := float(draw.randrange(wide)), x + draw.randrange(0, 40), y + draw.randrange(-2, 40)) for _ in range(n)]


def test_tracks_equal_the_plain_fold():
    draw = random.Random(3)
    for least, lost in ((0.25, 0), (0.25, 2), (0.6, 1), (0.0, 0)):
        frames = [boxes(draw, draw.choice([0, 1, 25]), 60) for _ in range(12)]
        assert match_frames(frames, least, lost) == plain(frames, least, lost)


def test_frames_of_many_boxes_take_seconds():
    draw = random.Random(5)
    frames, start = [boxes(draw, 8000, 4000) for _ in range(2)], time.time()
    match_frames(frames)
    assert time.time() - start < 8  # all with all: 64 million pairs
