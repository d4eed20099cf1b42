"""SimHash near-duplicates found by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to 49 reference fingerprints: zero, and 16 for each
of three blocks of bits, random within the block and zero outside. The distance to one of a block's
references less the distance to zero depends on the block's bits alone. Of two fingerprints that differ in
at most two bits one block is equal, so all coordinates of that block, taken less that to zero, are equal:
they make an equi-join key, and no pair can be missed. Pairs of a key are discarded by the maximum
coordinate difference over the whole table, survivors are verified on the fingerprints.

A key that more than `LARGE` distinct fingerprints share makes no pairs: there each fingerprint goes to all
centres within one bit outside the block. Two fingerprints are within two bits exactly if they share a
centre, and at most 45 share one, so the work stays in proportion to the group.

Links of similar texts (`similar`) are those of near_copies: wider fingerprints, and a check of whole shingle sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import SMALL_ROWS, cut, forget_caches, fresh, placed, slices, small, whole_text, without, word_pieces, work_folder
from .components import components

BLOCKS = ((0, 21), (21, 42), (42, 64))
PER_BLOCK = 16
LARGE = 48
#: Tasks over which the rows of a group are dealt, once groups are too many to broadcast.
SALTS = 64
#: Text split into words at once; longer texts are taken piece by piece.
PIECE_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_batch(texts: list[bytes], shingle: int = 3):
    """64-bit fingerprints (as signed integers) of UTF-8 texts; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest as h64

    hashes, sizes, long = [], [], {}
    for t in texts:
        if len(t) > PIECE_BYTES:
            long[len(sizes)] = _long_fingerprint(t, shingle)
            sizes.append(0)
            continue
        words = t.translate(_LOWER).split()
        if not words:
            sizes.append(0)
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(h64(joined, 42))
            sizes.append(1)
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends = ends.tolist()
        hashes += [h64(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]  # noqa: B905
        sizes.append(len(words) - shingle + 1)
    sizes = np.array(sizes)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.array(hashes, dtype="<u8")
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for lo in range(0, len(full), 256):
            own = full[lo : lo + 256]
            a, b = starts[lo], starts[lo] + sizes[own].sum()
            bits = np.unpackbits(flat[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts[lo : lo + 256] - a, axis=0, dtype=np.int64)
            out[own] = np.packbits(2 * counts > sizes[own][:, None], axis=1, bitorder="little").view("<u8").ravel()
    for i, f in long.items():
        out[i] = f
    return out.view(np.int64)


def _long_fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text, counted piece by piece."""
    import numpy as np
    from xxhash import xxh64_intdigest as h64

    counts, n, tail = np.zeros(64, np.int64), 0, []
    for piece in word_pieces(text, PIECE_BYTES):
        words = tail + piece.translate(_LOWER).split()
        hashes = np.array([h64(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)], "<u8")
        for at in range(0, len(hashes), 1 << 16):
            counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and tail:
        return h64(b" ".join(tail), 42)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp of every row, and the columns to keep; a null text has no words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget_caches()
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                fps = pa.array(fingerprint_batch(batch.column(1).cast(pa.binary()).to_pylist(), shingle), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], ["doc_id", "fp", *keep])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"), *keep)
    return slim.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in keep))


def references(seed: int = 7) -> list[list[int]]:
    """The reference fingerprints of each block; besides them there is zero."""
    draw = random.Random(seed)
    return [[draw.getrandbits(hi - lo) << lo for _ in range(PER_BLOCK)] for lo, hi in BLOCKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_table(fps: DataFrame, refs: list[list[int]] | None = None) -> DataFrame:
    """fp and its pivot distances: an array of bytes, zero's first, then those of each block."""
    flat = [0] + [r for block in refs or references() for r in block]
    return fps.withColumn("pivots", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)).cast("long"))).cast("tinyint") for r in flat)))


def _key(block: int) -> Column:
    """Of one block: its coordinates less that to zero."""
    own = F.slice("pivots", 2 + block * PER_BLOCK, PER_BLOCK)
    return F.xxhash64(F.transform(own, lambda d: d - F.element_at("pivots", 1)))


def links(fps: DataFrame, folder: str, most: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within `most` (at most 2) differing bits."""
    if most > len(BLOCKS) - 1:
        raise ValueError("more differing bits need more blocks")
    pivots = distance_table(fps)
    keyed = cut(pivots.select("fp", "pivots", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _key(b).alias("key")) for b in range(len(BLOCKS))))).alias("k")).select("k.block", "k.key", "fp", "pivots"), folder, "pivots")
    size = cut(keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1"), folder, "sizes")
    # keys are slim, so those of few and of many fingerprints are broadcast, unless there are very many; then rows meet by key
    few = cut(keyed.join(small(size.where(F.col("n") <= LARGE)), ["block", "key"]), folder, "few")
    many = keyed.join(small(size.where(F.col("n") > LARGE)), ["block", "key"])
    other = few.select("block", "key", F.col("fp").alias("fp2"), F.col("pivots").alias("pivots2"))
    near = ~F.exists(F.zip_with("pivots", "pivots2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d > most)
    pairs = few.join(other, ["block", "key"]).where(F.col("fp") < F.col("fp2")).where(near)
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    # centres within one bit outside the block; all that share one are within two bits of each other
    centres = None
    for b, (lo, hi) in enumerate(BLOCKS):
        flips = [0] + [_signed(1 << i) for i in range(64) if not lo <= i < hi]
        own = many.where(F.col("block") == b).select("block", "fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("centre"))
        centres = own if centres is None else centres.union(own)
    groups = centres.groupBy("block", "centre").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)
    stars = groups.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, most: int = 2, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id reachable over links of `most` or fewer differing bits.

    Texts without words share fingerprint zero and are linked like others; texts of any length are read whole. A
    null doc_id counts as no id: it gets the component's smallest one, null if there is none. Repeated rows stay;
    other columns are not read. Empty in, empty out.
    """
    folder = work_folder(docs.sparkSession)
    made = cut(fingerprints(docs, shingle, doc_id, text), folder, "fingerprints")
    return labelled(made, links(made.select("fp").distinct(), folder, most), folder).select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As near_duplicates, but over links of sets of shingles with a Jaccard similarity of at least 0.8; fp is the set's number."""
    folder = work_folder(docs.sparkSession)
    made, edges = near_copies.found(placed(docs.select(doc_id, text), folder), folder, shingle, doc_id, text)
    return labelled(made, edges, folder).select("doc_id", "fp", "component_id")


def labelled(made: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """made (doc_id, fp, more) with root (of the component of fp; null: no links) and component_id, its smallest doc_id.

    Fingerprints that are neither linked nor repeated need no look-up. The others are broadcast if they are few,
    counted first, so a large group meets no single task; else the groups' ids are dealt over SALTS tasks.
    """
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(edges, folder)
    rooted = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").where("root is not null or n > 1").select("fp", "root", "least"), folder, "rooted")
    own = F.coalesce("root", "fp")
    salt = F.pmod(F.xxhash64("fp", "least"), F.lit(SALTS)).cast("int")
    least = rooted.select(own.alias("g"), "least").groupBy("g").agg(F.min("least").alias("component_id"))
    least = cut(least, folder, "least")
    if least.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        of = rooted.join(F.broadcast(least), own == F.col("g"))
    else:
        dealt = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of = rooted.join(dealt, (own == F.col("g")) & (salt == F.col("s")))
    of = small(cut(of.select(F.col("fp").alias("_fp"), "root", "component_id"), folder, "of"))
    out = made.join(of, F.col("fp") == F.col("_fp"), "left")
    return out.withColumn("component_id", F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("_fp")


def keep_one(docs: DataFrame, most: int = 2, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, rows without one last, the first by place of equals."""
    folder = work_folder(docs.sparkSession)
    file, row = fresh(docs.columns, "file", "row")
    at = placed(docs, folder, file, row)
    slim = at.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    made = cut(fingerprints(slim, shingle, keep=("file", "row")), folder, "fingerprints")
    return _first_of_each(at, labelled(made, links(made.select("fp").distinct(), folder, most), folder), folder, file, row)


def keep_one_similar(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As keep_one, with the components of similar. All columns are kept, whatever they are called; empty in, empty out."""
    folder = work_folder(docs.sparkSession)
    file, row = fresh(docs.columns, "file", "row")
    at = placed(docs, folder, file, row)
    slim = at.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    made, edges = near_copies.found(slim, folder, shingle)
    return _first_of_each(at, labelled(made, edges, folder), folder, file, row)


def _first_of_each(at: DataFrame, found: DataFrame, folder: str, file: str, row: str) -> DataFrame:
    """The rows of `at` that come first in their component; found: labelled rows with places. Fewer rows go than stay, so those that go are joined."""
    found = cut(found.select("doc_id", F.coalesce("root", "fp").alias("g"), "file", "row"), folder, "labelled")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    first = found.groupBy("g").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("g", F.col("first.file").alias("f"), F.col("first.row").alias("r"))
    members = found.join(small(cut(first, folder, "heads")), "g")
    gone = cut(members.where(~((F.col("file") == F.col("f")) & (F.col("row") == F.col("r")))).select("file", "row"), folder, "gone")
    return without(at, gone, file, row)


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
