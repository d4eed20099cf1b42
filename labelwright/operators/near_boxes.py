"""Pairs of boxes that overlap enough, tile by tile in numpy: ranges of centres are compared, not all pairs of a tile."""

from __future__ import annotations

from collections.abc import Iterator

#: Pairs compared at once, rows gathered before tiles are worked on, and strips of a tile.
PAIRS, ROWS, STRIPS = 100_000, 50_000, 8
KEY = ["file", "lv", "tb", "tx", "ty"]


def changes(batch, before) -> list:
    """Whether each row begins another tile than the row before it; before: the last row of the batch before, or None."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(batch.num_rows, bool)
    for c in KEY:
        v = batch.column(c)
        new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
    new[0] = before is None or before != tuple(batch.column(c)[0].as_py() for c in KEY)
    return new


def near_boxes(batches: Iterator, least: float, window: float, cell: float) -> Iterator:
    """Arrow batches in order of KEY to pairs (x, y). Each row is at home in one tile; in other tiles it only asks those at home there."""
    import pyarrow as pa

    held, n, before = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = changes(batch, before).nonzero()[0]
        before = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in KEY)
        if len(at) and n + at[-1] >= ROWS:
            yield from _tiles(pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))]), least, window, cell)
            held, n = [], 0
            batch = batch.slice(int(at[-1]))
        held.append(batch)
        n += batch.num_rows
    if held:
        yield from _tiles(pa.Table.from_batches(held), least, window, cell)


def _tiles(table, least: float, window: float, cell: float) -> Iterator:
    import numpy as np
    import pyarrow as pa

    table = table.combine_chunks()
    if not table.num_rows:
        return
    batch = table.to_batches()[0]
    ids = batch.column("id")
    tile = np.cumsum(changes(batch, None)) - 1
    x0, y0, x1, y1, t, lv, tx = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x_min", "y_min", "x_max", "y_max", "t", "lv", "tx"))
    coded, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("coded", "home"))
    area, cx, cy = (x1 - x0) * (y1 - y0), (x0 + x1) / 2, (y0 + y1) / 2
    anywhere = least <= 0
    if anywhere:
        kind, base, width = np.zeros(len(t)), np.zeros(len(t)), np.ones(len(t))
    else:
        share = (1.0 - least) / (2.0 * least) * (1 + 1e-9)
        # areas of enough overlap differ by less than the limit's inverse: neighbouring kinds
        step = max(-np.log(least), 1e-6) * (1 + 1e-9)
        kind = np.floor(np.log(area) / step)
        size = cell * 2.0**lv
        base, width = tx * size, size / STRIPS
    kinds = np.unique(kind)
    ys, rank = np.unique(cy, return_inverse=True)
    high, many = len(ys) + 1, len(kinds)
    strip = lambda v, q: np.floor((v - base[q]) / width[q]).clip(0, STRIPS - 1).astype(np.int64) if not anywhere else np.zeros(len(q), np.int64)
    cells = lambda q, k, s: (tile[q] * many + k) * STRIPS + s

    def index(at):
        key = cells(at, np.searchsorted(kinds, kind[at]), strip(cx[at], at)) * high + rank[at]
        order = np.argsort(key, kind="stable")
        return key[order], at[order]

    def ask(q, side, shift: int, forward: bool):
        """Rows q compared with those of a kind so much higher; forward: only with later ones by centre and place."""
        key, at = side
        k = np.searchsorted(kinds, kind[q] + shift)
        there = (k < many) & (kinds[np.minimum(k, many - 1)] == kind[q] + shift)
        q, k = q[there], k[there]
        if not len(q) or not len(at):
            return
        if anywhere:
            dx = dy = np.full(len(q), np.inf)
        else:
            dx, dy = (np.minimum((b[q] - a[q]) * share, cell * 2.0 ** lv[q]) + 1e-6 + np.abs(m[q]) * 1e-15 for a, b, m in ((x0, x1, cx), (y0, y1, cy)))
        lo, hi = np.searchsorted(ys, cy[q] - dy), np.searchsorted(ys, cy[q] + dy, "right")
        s0, s1 = strip(cx[q] if forward else cx[q] - dx, q), strip(cx[q] + dx, q)
        for i in range(int((s1 - s0).max()) + 1):
            on = np.flatnonzero(s0 + i <= s1)
            c = cells(q[on], k[on], s0[on] + i) * high
            first, last = np.searchsorted(key, c + lo[on]), np.searchsorted(key, c + hi[on])
            some = np.flatnonzero(last > first)
            yield from compare(q[on[some]], at, first[some], last[some], forward)

    def compare(q, at, first, last, forward: bool):
        n = last - first
        ends, lo = np.cumsum(n), 0
        while lo < len(q):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            # one row's run may be longer than the limit by itself
            for part in range(int(first[lo]), int(last[lo]), PAIRS) if hi == lo + 1 else (None,):
                if part is None:
                    f, m = first[lo:hi], n[lo:hi]
                else:
                    f, m = np.array([part]), np.array([min(part + PAIRS, int(last[lo])) - part])
                w = np.arange(int(m.sum())) + np.repeat(f - np.cumsum(m) + m, m)
                p, of = at[w], q[lo:hi]
                w = np.minimum(np.repeat(x1[of], m), x1[p]) - np.maximum(np.repeat(x0[of], m), x0[p])
                h = np.minimum(np.repeat(y1[of], m), y1[p]) - np.maximum(np.repeat(y0[of], m), y0[p])
                both = np.maximum(w, 0.0) * np.maximum(h, 0.0)
                both_areas = np.repeat(area[of], m) + area[p]
                kept = np.flatnonzero(both * (1 + least) >= both_areas * (least * (1 - 1e-9)))
                p, both, both_areas = p[kept], both[kept], both_areas[kept]
                of = of[np.searchsorted(np.cumsum(m), kept, "right")]
                union = both_areas - both
                with np.errstate(divide="ignore", invalid="ignore"):
                    ok = (np.where(union > 0, both / union, 0.0) >= least) & (np.abs(t[of] - t[p]) <= window)
                if forward:
                    ok &= (cx[p] > cx[of]) | ((cx[p] == cx[of]) & (p > of))
                if ok.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[ok])), ids.take(pa.array(p[ok]))], names=["x", "y"])
            lo = hi

    here = np.flatnonzero(home)
    sides = {True: index(here[~coded[here]]), False: index(here)}
    for has_code in (True, False):
        # two codes decide by themselves
        mine = coded == has_code
        own, foreign = np.flatnonzero(home & mine), np.flatnonzero(~home & mine)
        if has_code:
            # the pair of a coded and an uncoded row at home is asked for by the coded one alone, whichever comes first
            asks = [(own, -1, False), (own, 0, False), (own, 1, False)]
        else:
            asks = [(own, 0, True), (own, 1, False)]
        asks += [(foreign, d, False) for d in (-1, 0, 1)]
        for rows, d, forward in asks:
            side = sides[True] if rows is own else sides[has_code]
            yield from ask(rows, side, d, forward)
