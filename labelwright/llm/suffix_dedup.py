"""Repeated 100-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Not all suffixes can be exchanged: each would carry up to 100 bytes. Three exact reductions come first.

1. Anchors. The anchor of a window of `WINDOW` bytes is its first K-gram of least hash. Equal windows have the
   same anchor at the same place, so only windows whose anchor's K-gram occurs at another anchor, too, can
   be repeated. Consecutive windows share an anchor (35 on average): an anchor stands for a range of windows.
2. Contents. Anchors are exchanged as hashes (of the K-gram, and of all bytes of the anchor's windows), packed
   by bucket. Of the anchors with equal K-gram and equal content all but the first are repeated as a whole. A
   task tells that of its own anchors at once and sends on the first of each content only, so a passage that
   much of the corpus shares fills no bucket. If all anchors of a K-gram have one content, that is all there is
   to know. Hashes are seeded by a number drawn for each run, 64 bits for K-grams and 128 more for contents:
   equal ones count as equal bytes.
3. The others, one for each content, are sorted: each task sorts the suffixes that begin at its anchors, and
   sends them as front-coded runs (length of the prefix shared with the suffix before, then the rest). A
   bucket merges its runs with a loser tree over common-prefix lengths, which never compares known prefixes
   again, and so gets the order and the prefix lengths between neighbours. Windows at offset o before their
   anchor are equal if the suffixes share 100 - o bytes, which the merged lengths tell, and the o bytes
   before are equal, which classes refined byte by byte tell.

Results go back to the texts through small files by chunk of input rows in the shared folder, so no text is
ever shuffled. Documents are known by file and row; input that is in no files is written once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_caches, cut, slices, whole_text, work_folder

WINDOW, K = 100, 32
REACH = WINDOW - K + 1
#: Rows of a chunk, bytes of text for each bucket, anchors or suffixes a task holds before it sends them on.
CHUNK_ROWS, BUCKET_BYTES, HELD = 1024, 24 << 20, 200_000
#: Text worked on at once when anchors are sought: about ten arrays of eight bytes for each of its bytes.
SLICE_BYTES = 1 << 20
#: A longer text is taken in pieces that overlap by a window less a byte.
PIECE_BYTES = 16 << 20
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_PLACE = (1 << 28) - 1
NO_ID = -(2**63)

ANCHOR = [("h", "<u8"), ("full", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("p", "<u4"), ("row", "<u2"), ("chunk", "<u2"), ("lo", "u1"), ("n", "u1")]
NOTE = [("p", "<u4"), ("row", "<u2"), ("lo", "u1"), ("n", "u1"), ("open", "u1")]
RUN = [("start", "<u4"), ("row", "<u2"), ("n", "u1")]


def _pack(fields: list, columns: dict) -> bytes:
    """Column after column, so that compression finds like bytes together."""
    import numpy as np

    return b"".join(np.ascontiguousarray(columns[name].astype(kind)).tobytes() for name, kind in fields)


def _unpack(fields: list, blob: bytes) -> dict:
    import numpy as np

    n = len(blob) // sum(np.dtype(k).itemsize for _, k in fields)
    out, at = {}, 0
    for name, kind in fields:
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _join(parts: list[dict]) -> dict:
    import numpy as np

    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def anchors(data, starts, ends, seed: int = 0):
    """Anchors of the windows of texts [start, end) in a byte array of up to 256 MiB: hash, two content hashes, first window, place, last window."""
    import numpy as np

    n = len(data)
    padded = np.zeros(n + 48, np.uint8)
    padded[:n] = data
    w = np.ndarray((n + 24,), "<u8", padded, strides=(1,)).copy()
    h = (w[:n] ^ np.uint64(seed)) * np.uint64(_A)
    for i, c in ((8, _B), (16, _A), (24, _B)):
        h ^= h >> np.uint64(29)
        h += w[i : n + i]
        h *= np.uint64(c)
    h ^= h >> np.uint64(32)
    key = (h & np.uint64(~_PLACE & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // REACH) + 1
    grid = np.full(rows * REACH, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(rows, REACH)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    lengths = np.maximum(ends - starts - WINDOW + 1, 0)
    full = np.flatnonzero(lengths)
    first = np.repeat(starts[full] - np.cumsum(lengths[full]) + lengths[full], lengths[full])
    i = first + np.arange(len(first))
    if not len(i):
        z = np.zeros(0, np.int64)
        return (z.astype(np.uint64),) * 3 + (z, z, z)
    a = (np.minimum(after[i], before[i + REACH - 1]) & np.uint64(_PLACE)).astype(np.int64)
    new = np.append(True, (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(i)) - 1
    s, e, p = i[head], i[tail], a[head]
    last = e + WINDOW - K

    def content(begin: int, multiplier: int):
        out = np.uint64(begin) ^ np.uint64(_B) * (((p - s) << 8) | (e - s)).astype(np.uint64)
        for t in range(0, 2 * WINDOW - K, K):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(multiplier) + h[np.minimum(s + t, last)]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_B)
        return out ^ (out >> np.uint64(32))

    return h[p], content(0, _A), content(seed | 1, _C), s, p, e


def piecewise(data, starts, ends, key: int = 0):
    """As anchors, for texts of any length: a long one is taken in pieces, and an anchor's windows may be told in two parts."""
    import numpy as np

    if len(data) <= PIECE_BYTES:
        return anchors(data, starts, ends, key)
    parts = []
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        for at in range(x, max(x + 1, y - WINDOW + 1), PIECE_BYTES):
            to = min(y, at + PIECE_BYTES + WINDOW - 1)
            h, full, more, *places = anchors(data[at:to], np.array([0]), np.array([to - at]), key)
            parts.append((h, full, more, *(v + at for v in places)))
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


def combine(a: dict) -> tuple[dict, dict]:
    """(the first anchors of each content, the others: repeated as a whole) of a task's anchors."""
    import numpy as np

    order = np.lexsort((a["p"], a["row"], a["chunk"], a["doc"], a["more"], a["full"], a["h"]))
    again = np.append(False, np.all([a[k][order][1:] == a[k][order][:-1] for k in ("h", "full", "more")], axis=0))
    return {k: v[order[~again]] for k, v in a.items()}, {k: v[order[again]] for k, v in a.items()}


def settle(a: dict) -> dict:
    """Of a bucket's anchors those that are repeated as a whole (open 0), and those that must be sorted (open 1)."""
    import numpy as np

    order = np.argsort(a["h"], kind="stable")
    h = a["h"][order]
    same = np.append(False, h[1:] == h[:-1])
    kept = order[same | np.append(same[1:], False)]
    a = {k: v[kept] for k, v in a.items()}
    order = np.lexsort((a["p"], a["row"], a["chunk"], a["doc"], a["more"], a["full"], a["h"]))
    a = {k: v[order] for k, v in a.items()}
    if not len(order):
        return a | {"open": np.zeros(0, np.uint8)}
    group = np.append(True, a["h"][1:] != a["h"][:-1])
    content = group | np.append(True, (a["full"][1:] != a["full"][:-1]) | (a["more"][1:] != a["more"][:-1]))
    number = np.cumsum(group) - 1
    several = np.bincount(number, weights=content)[number] > 1
    told = ~content | several
    return {k: v[told] for k, v in a.items()} | {"open": content[told].astype(np.uint8)}


# ---- front-coded runs and their merge


def _matrix(texts: list[bytes], width: int):
    import numpy as np

    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def front_code(texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Of sorted texts of at most 255 bytes: prefix lengths shared with the text before, lengths of the rests, the rests."""
    import numpy as np

    if not texts:
        return b"", b"", b""
    size = np.array([len(t) for t in texts])
    m = _matrix(texts, int(size.max()) + 1)
    differ = m[1:] != m[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    shared = np.append(0, np.minimum(shared, np.minimum(size[1:], size[:-1])))
    rests = [t[k:] for t, k in zip(texts, shared.tolist(), strict=True)]
    return shared.astype(np.uint8).tobytes(), (size - shared).astype(np.uint8).tobytes(), b"".join(rests)


def read_run(shared: bytes, rest: bytes, texts: bytes) -> Iterator[tuple[bytes, int]]:
    """(text, prefix length shared with the text before) of a front-coded run."""
    at, last = 0, b""
    for k, n in zip(shared, rest, strict=True):
        last = last[:k] + texts[at : at + n]
        at += n
        yield last, k


def _first_difference(a: bytes, b: bytes, k: int) -> int:
    n = min(len(a), len(b))
    x, y = a[k:n], b[k:n]
    if x == y:
        return n
    return n - 1 - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() - 1) // 8


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> tuple[list[int], list[int], list[bytes]]:
    """Loser tree over sorted runs: for each text in order its run, the prefix length shared with the text before, the text.

    A node holds the run that lost there and what its text shares with the winner. A contender that shares
    more with the last text put out is smaller, with no look at the texts; only for equal lengths are they
    compared, from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    text: list = [b""] * size
    have = [-1] * size  # shared with the last text put out; -1: the run is at its end
    step = [iter(r).__next__ for r in runs]
    for i, s in enumerate(step):
        try:
            text[i], have[i] = s()[0], 0
        except StopIteration:
            pass
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = have[a], have[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = text[a], text[b]
        k = _first_difference(s, t, x)
        first = len(s) < len(t) or (len(s) == len(t) and a < b) if k == min(len(s), len(t)) else s[k] < t[k]
        if not first:
            a, b = b, a
        have[b] = k
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, loser[node] = play(build(2 * node), build(2 * node + 1))
        return won

    who, shared, out = [], [], []
    won = build(1) if size > 1 else 0
    while have[won] >= 0:
        who.append(won)
        shared.append(have[won])
        out.append(text[won])
        try:
            text[won], have[won] = step[won]()
        except StopIteration:
            have[won] = -1
        node = (won + size) // 2
        while node:
            other = loser[node]
            x, y = have[won], have[other]
            if x > y:
                pass
            elif x < y:
                loser[node] = won
                won = other
            else:
                won, loser[node] = play(won, other)
            node //= 2
    return who, shared, out


def repeated(shared, rank, left: list[bytes], lo, n):
    """(member, offset) flags of windows that an earlier member has, too. Members are in suffix order.

    shared: prefix length with the member before. rank: order of documents and places. lo, n: the member's
    windows begin lo, lo - 1, ... lo - n bytes before its anchor. left: the bytes before it, backwards.
    """
    import numpy as np

    m = len(rank)
    flags = np.zeros((m, REACH), bool)
    width = int(lo.max()) + 1
    before = _matrix(left, width)
    least = lo - n
    by_rank = np.argsort(rank)
    klass = np.zeros(m, np.int64)
    for o in range(width):
        if o:
            has = np.flatnonzero(lo >= o)
            refined = klass[has] * 256 + before[has, o - 1]
            klass[has] = np.unique(refined, return_inverse=True)[1]
        right = np.cumsum(shared < WINDOW - o)
        own = by_rank[(lo[by_rank] >= o) & (least[by_rank] <= o)]
        if not len(own):
            continue
        both = right[own] * (m + 1) + klass[own]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(own), bool)
        again[first] = False
        flags[own[again], o] = True
    return flags


# ---- the jobs


def _named(docs: DataFrame, doc_id: str, text: str, folder: str) -> DataFrame:
    """chunk, row, doc_id, null, t of each row of docs; chunk and row tell a row's place in its file."""
    slim = lambda d: d.select(F.xxhash64(d["_metadata.file_path"], F.floor(d["_metadata.row_index"] / CHUNK_ROWS)).alias("chunk"), (d["_metadata.row_index"] % CHUNK_ROWS).cast("int").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    try:
        return slim(docs)
    except AnalysisException:
        return slim(cut(docs.select(doc_id, text), folder, "docs"))


def _sorted_buckets(buckets, count: int):
    import numpy as np

    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(count + 1))
    return order, bounds.tolist()


def _first_pass(buckets: int, key: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget_caches()
        held, count, chunks = [], 0, {}

        def send():
            a = _join(held)
            numbers = np.array(list(chunks), "<i8")
            number = a["chunk"]
            a, told = combine(a | {"chunk": numbers[number], "number": number})
            # notes on the others go with the anchors, as groups below zero
            notes = _by_chunk(told | {"open": np.zeros(len(told["p"]), np.uint8)}, NOTE)
            if notes.num_rows:
                of = notes.column("chunk").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(-1 - of % buckets, pa.int64()).cast(pa.int32()), pa.array([c.tobytes() for c in of.astype("<i8")], pa.binary()), notes.column("body").combine_chunks()], ["bucket", "chunks", "body"])
            a["chunk"] = a["number"]
            bucket = (a["h"] % np.uint64(buckets)).astype(np.int64)
            order, bounds = _sorted_buckets(bucket, buckets)
            names = numbers.tobytes()
            rows = [(b, _pack(ANCHOR, {k: v[order[x:y]] for k, v in a.items()})) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([names] * len(rows), pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "chunks", "body"])

        for whole in batches:
            for batch in slices(whole, 3, SLICE_BYTES):
                col = batch.column(3)
                kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
                at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
                data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
                at = at - at[0]
                h, full, more, s, p, e = piecewise(data, at[:-1], at[1:], key)
                if not len(h):
                    continue
                d = np.searchsorted(at[1:], s, side="right")
                chunk = batch.column(0).to_numpy(zero_copy_only=False)
                number = np.array([chunks.setdefault(c, len(chunks)) for c in chunk.tolist()])
                ids = batch.column(2).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held.append({"h": h, "full": full, "more": more, "doc": ids[d], "p": p - at[d], "row": batch.column(1).to_numpy(zero_copy_only=False)[d], "chunk": number[d], "lo": p - s, "n": e - s})
                count += len(h)
                if count >= HELD or len(chunks) > 60_000:
                    yield from send()
                    held, count, chunks = [], 0, {}
        if held:
            yield from send()

    return run


def _by_chunk(a: dict, fields: list):
    """Rows (chunk, body) of packed columns."""
    import numpy as np
    import pyarrow as pa

    names, number = np.unique(a["chunk"], return_inverse=True)
    order, bounds = _sorted_buckets(number, len(names))
    bodies = [_pack(fields, {k: a[k][order[x:y]] for k, _ in fields}) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"chunk": pa.array(names, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _settle_bucket(group):
    import numpy as np
    import pyarrow as pa

    if group.column("bucket")[0].as_py() < 0:
        names = np.frombuffer(b"".join(group.column("chunks").to_pylist()), "<i8")
        return pa.table({"chunk": pa.array(names), "body": group.column("body")})
    parts = []
    for names, body in zip(group.column("chunks").to_pylist(), group.column("body").to_pylist(), strict=True):
        a = _unpack(ANCHOR, body)
        parts.append(a | {"chunk": np.frombuffer(names, "<i8")[a["chunk"]]})
    return _by_chunk(settle(_join(parts)), NOTE)


def _write_notes(notes: DataFrame, folder: str, name: str) -> None:
    """One file for each chunk that has notes: its packed bodies one after another, each with its length before it."""

    def run(group):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(f"{folder}/{name}")
        store.create_dir(base, recursive=True)
        chunk = group.column("chunk")[0].as_py()
        temporary = f"{base}/{chunk}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for body in group.column("body").to_pylist():
                out.write(len(body).to_bytes(8, "little") + body)
        store.move(temporary, f"{base}/{chunk}.notes")
        return pa.table({"chunk": pa.array([chunk], pa.int64())})

    notes.groupBy("chunk").applyInArrow(run, "chunk long").write.format("noop").mode("overwrite").save()


def _read_notes(folder: str, name: str, chunk: int, fields: list) -> dict | None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(f"{folder}/{name}")
    path = f"{base}/{chunk}.notes"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as source:
        raw = source.read()
    parts, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        parts.append(_unpack(fields, raw[at + 8 : at + 8 + n]))
        at += 8 + n
    return _join(parts)


def _chunk_notes(folder: str, name: str, fields: list, keep=None):
    """A reader of notes by chunk and row that holds the last chunks' notes, sorted by row."""
    import numpy as np

    known: dict = {}

    def of(chunk: int, row: int) -> dict | None:
        if chunk not in known:
            if len(known) > 3:
                known.pop(next(iter(known)))
            a = _read_notes(folder, name, chunk, fields)
            if a is not None:
                if keep is not None:
                    a = {k: v[keep(a)] for k, v in a.items()}
                order = np.lexsort((a[fields[0][0]], a["row"]))
                a = {k: v[order] for k, v in a.items()}
            known[chunk] = a
        a = known[chunk]
        if a is None:
            return None
        x, y = np.searchsorted(a["row"], [row, row + 1])
        return {k: v[x:y] for k, v in a.items()} if x < y else None

    return of


RUNS = "bucket int, chunks binary, shared binary, rest binary, texts binary, left binary, columns binary"
MEMBER = [("doc", "<i8"), ("p", "<u4"), ("row", "<u2"), ("chunk", "<u2"), ("lo", "u1"), ("n", "u1")]


def _second_pass(folder: str, buckets: int):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        forget_caches()
        notes = _chunk_notes(folder, "settled", NOTE, lambda a: a["open"] == 1)
        held: list = []  # (suffix, bytes before it backwards, doc, place, row, chunk number, lo, n)
        chunks: dict = {}

        def send():
            bucket = np.array([zlib.crc32(x[0][:K]) % buckets for x in held])
            order, bounds = _sorted_buckets(bucket, buckets)
            names = np.array(list(chunks), "<i8").tobytes()
            cols: list = [[] for _ in range(7)]
            for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if x == y:
                    continue
                own = sorted((held[i] for i in order[x:y].tolist()), key=lambda r: r[0])
                columns = {name: np.array([r[i] for r in own]) for i, (name, _) in enumerate(MEMBER, 2)}
                row = (b, names, *front_code([r[0] for r in own]), b"".join(r[1] for r in own), _pack(MEMBER, columns))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "chunks", "shared", "rest", "texts", "left", "columns"])

        for whole in batches:
            for batch in slices(whole, 3, 4 << 20):
                texts = batch.column(3).cast(pa.binary())
                ids = batch.column(2).fill_null(NO_ID).to_pylist()
                for i, (chunk, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    a = notes(chunk, row)
                    if a is None:
                        continue
                    t, number = texts[i].as_py(), chunks.setdefault(chunk, len(chunks))
                    for p, lo, n in zip(a["p"].tolist(), a["lo"].tolist(), a["n"].tolist(), strict=True):
                        s = p - lo
                        held.append((t[p : s + n + WINDOW], t[s:p][::-1], ids[i], p, row, number, lo, n))
                if len(held) >= HELD // 4 or len(chunks) > 60_000:
                    if held:
                        yield send()
                    held, chunks = [], {}
        if held:
            yield send()

    return run


def _merge_bucket(group):
    import numpy as np

    parts, lefts, runs = [], [], []
    for r in group.to_pylist():
        a = _unpack(MEMBER, r["columns"])
        parts.append(a | {"chunk": np.frombuffer(r["chunks"], "<i8")[a["chunk"]]})
        ends = np.cumsum(a["lo"], dtype=np.int64).tolist()
        lefts.append([r["left"][x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)])
        runs.append(read_run(r["shared"], r["rest"], r["texts"]))
    who, shared, _ = merge_runs(runs)
    # the members of a run stay in its order, so the k-th one of a run is the k-th one put out from it
    who = np.array(who)
    order = np.argsort(who, kind="stable")
    place = np.empty(len(who), np.int64)
    place[order] = np.arange(len(who))
    a = {k: v[place] for k, v in _join(parts).items()}
    flat = [x for part in lefts for x in part]
    left = [flat[i] for i in place.tolist()]
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((a["p"], a["row"], a["chunk"], a["doc"]))] = np.arange(len(place))
    flags = repeated(np.array(shared), rank, left, a["lo"].astype(np.int64), a["n"].astype(np.int64))
    # runs of offsets o, o + 1, ... u - 1: windows from p - u + 1 to p - o
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    member, o = np.nonzero(edge == 1)
    u = np.nonzero(edge == -1)[1]
    return _by_chunk({"chunk": a["chunk"][member], "start": a["p"][member].astype(np.int64) - u + 1, "row": a["row"][member], "n": u - o - 1}, RUN)


def covered(starts, lasts):
    """Maximal byte ranges covered by the windows from starts to lasts, as two arrays."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(lasts[order] + WINDOW)
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.append(new[1:], len(s)) - 1] if len(s) else e


def _last_pass(folder: str, want_text: bool):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        forget_caches()
        whole_notes = _chunk_notes(folder, "settled", NOTE, lambda a: a["open"] == 0)
        part_notes = _chunk_notes(folder, "merged", RUN)
        for whole in batches:
            for batch in slices(whole, 3, 4 << 20):
                texts = batch.column(3).cast(pa.binary())
                removed, spans, digests, sizes, kept_texts, ranges = [], [], [], [], [], []
                for i, (chunk, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    t = texts[i].as_py()
                    a, b = whole_notes(chunk, row), part_notes(chunk, row)
                    s, e = [], []
                    if a is not None:
                        s.append(a["p"].astype(np.int64) - a["lo"])
                        e.append(s[-1] + a["n"])
                    if b is not None:
                        s.append(b["start"].astype(np.int64))
                        e.append(s[-1] + b["n"])
                    x, y = covered(np.concatenate(s), np.concatenate(e)) if s else (np.zeros(0, np.int64),) * 2
                    x, y = x.tolist(), y.tolist()
                    kept = b"".join(t[p:q] for p, q in zip([0, *y], [*x, len(t)], strict=True))
                    sizes.append(len(t))
                    removed.append(len(t) - len(kept))
                    spans.append(len(x))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if want_text:
                        kept_texts.append(kept)
                        ranges.append([{"start": p, "end": q} for p, q in zip(x, y, strict=True)])
                cols = [batch.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if want_text:
                    cols += [pa.array(kept_texts, pa.binary()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    names += ["kept", "removed"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", want_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: without the bytes of strings of WINDOW bytes that also start earlier.

    Earlier: a smaller doc_id, or the same document and an earlier byte. Rows with one doc_id (null comes
    first, as one id) are in an order that is fixed for the same files. want_text adds kept (binary: a cut can
    split a character) and removed (byte ranges). A null text is empty; texts of any length are read whole, long
    ones in pieces; other columns are not read. Empty in, empty out.
    """
    import secrets

    spark = docs.sparkSession
    folder = work_folder(spark)
    rows = _named(docs, doc_id, text, folder)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // BUCKET_BYTES))
    sent = rows.mapInArrow(_first_pass(buckets, secrets.randbits(63)), "bucket int, chunks binary, body binary")
    notes = sent.groupBy("bucket").applyInArrow(_settle_bucket, "chunk long, body binary")
    _write_notes(notes, folder, "settled")
    runs = rows.mapInArrow(_second_pass(folder, buckets), RUNS)
    merged = runs.groupBy("bucket").applyInArrow(_merge_bucket, "chunk long, body binary")
    _write_notes(merged, folder, "merged")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_last_pass(folder, want_text), schema + (", kept binary, removed array<struct<start:long,end:long>>" if want_text else ""))
