"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings of all words of the training documents, so one index, written once, serves any
benchmark. It is partitioned by document: a shard holds the postings of some megabytes of whole texts, so a
posting list never leaves its documents and no list is gathered for a common word. Words of a shard are
numbered through, with a gap after each document that no phrase or slop can cross.

Index table (one row for each shard and term, and one directory row, whose term is null, for each shard):

    shard long, term string, n_pos long, body binary
        body of a term: its positions, ascending, as little-endian unsigned 32-bit differences
        body of the directory: file, row, doc_ids, first positions, word counts, null flags, as little-endian int64

A search takes the windows of all items, reads the postings of their terms only, orders the terms of each from
the globally rarest one, and intersects offset-adjusted lists in that order: exactly for phrases, within `slop`
words for proximity. Documents are known by file and row, so repeated or missing ids never stand for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_texts, forget_caches, fresh, placed, slices, tidy, whole_text, without, word_pieces, work_folder

#: Byte to byte: A-Z to a-z, other characters up to 7F that are neither digits nor letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Items beyond so many bytes of text are searched in blocks of that size; only one block is broadcast at a time.
ITEM_BLOCK_BYTES = 32 << 20
#: Text split into words at once; longer texts are taken piece by piece.
PIECE_BYTES = 2 << 20
#: Unused positions behind each document; twice the slop must be less.
GAP = 16


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters from 80 on, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def windows_of(words: list, length: int) -> list[tuple]:
    """All runs of `length` words; the whole list if it is shorter, nothing if it is empty."""
    if not words:
        return []
    n = max(1, len(words) - length + 1)
    return [tuple(words[i : i + length]) for i in range(n)]


def _postings(texts: list[bytes]):
    """(terms, list ends in words, differences, first positions, word counts) of a shard's texts."""
    from itertools import chain

    import numpy as np

    vocabulary: dict = {}
    parts, n = [], []

    def take(words: list) -> None:
        for w in set(words).difference(vocabulary):
            vocabulary[w] = len(vocabulary)
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))

    held: list = []
    for text in texts:
        folded = text.translate(_FOLD)
        if len(folded) <= PIECE_BYTES:
            held.append(folded.split())
            n.append(len(held[-1]))
            continue
        take(list(chain.from_iterable(held)))
        held, count = [], 0
        for piece in word_pieces(folded, PIECE_BYTES):
            words = piece.split()
            count += len(words)
            take(words)
        n.append(count)
    take(list(chain.from_iterable(held)))
    n = np.array(n, np.int64)
    first = np.cumsum(n + GAP) - n - GAP
    ids = np.concatenate(parts)
    at = (np.arange(len(ids)) + np.repeat(np.arange(len(n)) * GAP, n)).astype(np.uint32)
    order = np.argsort(ids.astype(np.uint16) if len(vocabulary) <= 1 << 16 else ids, kind="stable")
    at = at[order]
    ends = np.cumsum(np.bincount(ids, minlength=len(vocabulary))) if len(ids) else np.zeros(0, np.int64)
    differences = np.diff(at, prepend=np.uint32(0)).astype("<u4")
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    differences[starts] = at[starts]
    return list(vocabulary), ends, differences, first, n


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """The index of whole texts, all their words; docs have places (file, row).

    A null text has no words; null doc_ids and repeated rows are documents of their own. A text of any length
    is indexed whole, piece by piece, in a shard of its own if it is longer than one.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1, shard_bytes):
                terms, ends, differences, first, n = _postings(batch.column(1).cast(pa.binary()).to_pylist())
                own = batch.column(0)
                numbers = lambda c: c.to_numpy(zero_copy_only=False).astype("<i8")
                directory = np.concatenate([numbers(batch.column(2)), numbers(batch.column(3)), numbers(own.fill_null(0)), first.astype("<i8"), n.astype("<i8"), numbers(own.is_null())])
                shard = part * (1 << 32) + count
                names = ["shard", "term", "n_pos", "body"]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(n)], pa.int64()), pa.array([directory.tobytes()], pa.binary())], names)
                sizes, at = np.diff(ends, prepend=0), 0
                while at < len(terms):
                    # bodies of at most 1 GiB at once: offsets are 32-bit
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + (1 << 28), side="right")))
                    offsets = np.append(0, (ends[at:to] - before) * 4).astype("<i4")
                    bodies = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(differences[before : int(ends[to - 1])].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, shard)), pa.array(terms[at:to], pa.binary()).cast(pa.string()), pa.array(sizes[at:to].astype(np.int64)), bodies], names)
                    at = to
                count += 1

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"), "file", "row")
    return slim.mapInArrow(tidy(run), "shard long, term string, n_pos long, body binary")


def _near(list_, wanted, slop: int):
    """Which of the wanted positions have one of the list's positions within slop."""
    import numpy as np

    at = np.searchsorted(list_, wanted - slop)
    ok = at < len(list_)
    ok[ok] = list_[at[ok]] <= wanted[ok] + slop
    return ok


def _search(lists: dict, plan: list, slop: int) -> tuple[list, list]:
    """(start, length, window number, offset of the rarest term) of exact matches, and of near ones, in one shard.

    plan: for each window its length and its (term, offset), rarest term first.
    """
    exact, near = [], []
    for number, (length, terms) in enumerate(plan):
        own = [lists.get(t) for t, _ in terms]
        if any(x is None for x in own):
            continue
        starts = own[0] - terms[0][1]
        for list_, (_, offset) in zip(own[1:], terms[1:], strict=True):
            starts = starts[_near(list_, starts + offset, slop)]
            if not len(starts):
                break
        if not len(starts):
            continue
        near.append((starts, length, number, terms[0][1]))
        for list_, (_, offset) in zip(own[1:], terms[1:], strict=True):
            starts = starts[_near(list_, starts + offset, 0)]
            if not len(starts):
                break
        if len(starts):
            exact.append((starts, length, number, terms[0][1]))
    return exact, near


def _by_document(matches: list, first, n, owners: list) -> tuple[list, list]:
    """For each document of a shard: merged word spans, and the ids of the items that match."""
    import numpy as np

    spans, items = [[] for _ in n], [[] for _ in n]
    if not matches:
        return spans, items
    starts = np.concatenate([m[0] for m in matches])
    lengths = np.repeat([m[1] for m in matches], [len(m[0]) for m in matches])
    numbers = np.repeat([m[2] for m in matches], [len(m[0]) for m in matches])
    # the rarest term is in place, whatever the slop: it tells the document
    placed_at = starts + np.repeat([m[3] for m in matches], [len(m[0]) for m in matches])
    doc = np.searchsorted(first, placed_at, side="right") - 1
    lo, hi = np.maximum(starts, first[doc]), np.minimum(starts + lengths, first[doc] + n[doc])
    order = np.lexsort((hi, lo))
    lo, hi, by = lo[order], hi[order], doc[order]
    # spans of different documents never touch: the gap lies between them
    reach = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > reach[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(lo)) - 1
    for d, a, b in zip(by[head].tolist(), lo[head].tolist(), reach[tail].tolist(), strict=True):
        spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    for pair in np.unique(np.stack([doc, numbers]), axis=1).T.tolist():
        items[pair[0]].extend(owners[pair[1]])
    return spans, [sorted(set(x)) for x in items]


_SPANS = "array<struct<start:long,end:long>>"
MATCHES = f"file long, row long, doc_id long, n_words long, spans {_SPANS}, items array<string>, near_spans {_SPANS}, near_items array<string>"


def search_index(index: DataFrame, windows: list[tuple[tuple[str, ...], list[str]]], frequency: dict[str, int], slop: int = 2) -> DataFrame:
    """Phrase and proximity matches of windows (terms, ids of the items that hold them), a row for each indexed document.

    index: the rows of the windows' terms, and all directory rows.

    A near match has the window's globally rarest term (the first of equals) in place and every other term
    within slop words of its own place; each exact match is a near one too. Spans are merged word ranges.
    """
    if 2 * slop >= GAP:
        raise ValueError(f"twice the slop must be under {GAP}")
    spark = index.sparkSession
    plan = [(len(w), sorted(((t, i) for i, t in enumerate(w)), key=lambda x: (frequency.get(x[0], 0), x[1]))) for w, _ in windows]
    # a window of which some term occurs nowhere matches nowhere
    kept = [i for i, (_, terms) in enumerate(plan) if frequency.get(terms[0][0], 0)]
    shared = spark.sparkContext.broadcast(([plan[i] for i in kept], [windows[i][1] for i in kept]))

    def run(group):
        import numpy as np
        import pyarrow as pa

        forget_caches()
        plan, owners = shared.value
        lists, directory = {}, None
        for term, body in zip(group.column("term").to_pylist(), group.column("body").to_pylist(), strict=True):
            if term is None:
                directory = np.frombuffer(body, "<i8").reshape(6, -1)
            else:
                lists[term] = np.cumsum(np.frombuffer(body, "<u4"), dtype=np.int64)
        file, row, ids, first, n, null = directory
        exact, near = _search(lists, plan, slop)
        (spans, items), (near_spans, near_items) = _by_document(exact, first, n, owners), _by_document(near, first, n, owners)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "file": pa.array(file), "row": pa.array(row), "doc_id": pa.array(ids, mask=null == 1), "n_words": pa.array(n),
                "spans": pa.array(spans, kind), "items": pa.array(items, pa.list_(pa.string())), "near_spans": pa.array(near_spans, kind), "near_items": pa.array(near_items, pa.list_(pa.string())),
            }
        )

    return index.groupBy("shard").applyInArrow(run, MATCHES)


def item_windows(rows: list, length: int) -> list[tuple[tuple[str, ...], list[str]]]:
    """Distinct windows of (item_id, text) rows, with the ids of the items that hold each. A null id counts as ''."""
    found: dict = {}
    for item, text in rows:
        for w in windows_of([x.decode() for x in words_of((text or "").encode())], length):
            found.setdefault(w, set()).add("" if item is None else str(item))
    return [(w, sorted(ids)) for w, ids in sorted(found.items())]


def _blocks(rows: Iterator, most: int) -> Iterator[list]:
    block, held = [], 0
    for row in rows:
        size = len(row[1] or "") * 4
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    yield block


def written_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, written to a work folder: searches of any benchmark can share it."""
    folder = work_folder(docs.sparkSession)
    return cut_texts(build_index(placed(docs.select(doc_id, text), folder), doc_id, text), folder, "index")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", block_bytes: int = ITEM_BLOCK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """Where windows of `window` item words occur in whole documents: columns as MATCHES, a row for each row of docs.

    A null text has no words and no matches, and so has an empty one; texts may be of any length. An item without
    words has no windows; a shorter item is one window. Repeated item rows are one item; items that share a
    window all count. An empty docs table gives no rows; empty items, no matches. Other columns are not read.
    index: written_index(docs), if there is one already. Items go in blocks of bounded size, one broadcast at a time.
    """
    spark = docs.sparkSession
    index = written_index(docs, doc_id, text) if index is None else index
    slim = items.select(F.col(item_id).cast("string").alias("item_id"), whole_text(text).alias("text"))
    found = []
    for rows in _blocks(((r.item_id, r.text) for r in slim.toLocalIterator()), block_bytes):
        windows = item_windows(rows, window)
        asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for w, _ in windows for t in w})], "term string"))
        lists = index.where("term is not null").join(asked, "term", "left_semi").select(index.columns)
        frequency = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n_pos").alias("n")).collect()}
        found.append(search_index(index.where("term is null").unionByName(lists), windows, frequency, slop))
    if len(found) == 1:
        return found[0]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "near_spans")] + [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")]
    merged = out.groupBy("file", "row", "doc_id", "n_words").agg(*lists)
    return merged.withColumns({c: merge_spans(c) for c in ("spans", "near_spans")})


def merge_spans(column: str):
    """Overlapping or touching spans as one, ascending."""
    one = f"aggregate(array_sort({column}), cast(array() as {_SPANS}), (a, x) -> if(size(a) > 0 and element_at(a, -1).end >= x.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    return F.expr(one)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """docs without the rows that hold a window of an item, all columns kept, whatever they are called.

    Each row is judged by itself: rows with a null or repeated doc_id go or stay by their own text.
    """
    folder = work_folder(docs.sparkSession)
    file, row = fresh(docs.columns, "file", "row")
    at = placed(docs, folder, file, row)
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    index = cut_texts(build_index(at.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))), folder, "index")
    found = find_contamination(docs, items, window, index=index, **names)
    bad = cut(found.where(F.size("spans") > 0).select("file", "row"), folder, "contaminated")
    return without(at, bad, file, row)
