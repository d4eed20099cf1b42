"""Near copies by SimHash: word shingle sets with a Jaccard similarity of at least 0.8.

Every set of shingles gets a fingerprint of 128 bits. Two sets of similarity 0.8 differ in a share acos(8/9)/pi of
the bits on average, 15 %, so in 19 +- 4 of them; pairs over `RADIUS` = 40 bits are discarded (five deviations: of
pairs at the limit one in ten million is lost; of sets under nine shingles, which scatter more, those over
`SMALL_RADIUS`), which random pairs (64 +- 6) hardly pass. What is left is verified on the whole sets, so no pair
under 0.8 is linked. For that sets travel as 32-bit hashes: of two sets of 300 shingles, one shingle in 40000 pairs is miscounted.

No key of few bits is equal in all pairs that far apart, as the 64-bit links of `simhash` have it. So pairs meet
on shingles: in any common order of the hashes, two sets of similarity 4/5 share a hash among the first
|S| - ceil(4|S|/5) + 1 of each, and where it stands bounds the overlap, hashes before it that no other set has left out. Hashes that more than `HOT` sets share come last in the order, the
most frequent ones at the end, so a common line or passage makes no pairs.

A hash that more than `LARGE` sets share (a large group of copies) has pivots: `CENTRES` of its sets, whose
distances to all the others are written in a table, and the set in their middle. Sets are compared with the pivots first. Only those that these
links leave outside the hash's largest component meet the others, pairs whose distances to any pivot differ by
over `RADIUS` are discarded, and so are those whose fingerprints do, or whose odd sketches (which hash buckets
hold an odd number of a set's hashes) show that the sets differ in too many hashes; that bound is exact. Of the pairs of small groups, too, each set's
nearest is verified first, and after it only pairs that are not connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_texts, slices, small, tidy, whole_text, word_pieces
from .components import components

#: What is known of a set at one of its keys.
SIDE = ("fp", "n", "at", "live", "s1", "s2")
LARGE = 48
CENTRES = 3
HOT = 48
MOST_HOT = 200_000
RADIUS, SMALL_RADIUS, SMALL_SET = 40, 48, 9
#: Words of a sketch that tells how many hashes two sets differ in at least; it says little of sets that differ in over 64 x ODD hashes.
ODD = 4
ODDS = [f"o{i}" for i in range(ODD)]
#: Hashes that a task holds to count them; a worker's memory is about 40 bytes for each.
HELD = 1 << 20
#: Tasks over which a hot hash's sets are dealt when hashes of one set only are sought.
SALTS = 64
PIECE_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _folded(hashes, n: int):
    """64-bit hashes of n consecutive ones, by their first place."""
    import numpy as np

    out = np.full(max(0, len(hashes) - n + 1), n + 1, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    import numpy as np
    from xxhash import xxh64_intdigest as h64

    known: dict = {}
    parts, sizes = [], []
    for t in texts:
        sizes.append(0)
        for piece in word_pieces(t.translate(_LOWER), PIECE_BYTES):
            words = piece.split()
            for w in set(words).difference(known):
                known[w] = h64(w, 42)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            sizes[-1] += len(words)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    whole, at, out = _folded(flat, shingle), 0, []
    for n in sizes:
        own = whole[at : at + n - shingle + 1] if n >= shingle else _folded(flat[at : at + n], n) if n else whole[:0]
        out.append(np.unique(own))
        at += n
    return out


def set_ids(sets: list) -> list[int]:
    """One number for each set; 0 for that without hashes."""
    from xxhash import xxh64_intdigest as h64

    ids = [h64(s.tobytes(), 7) if len(s) else 0 for s in sets]
    return [i - (1 << 64) if i >> 63 else i for i in ids]


def _head(s, hot, rank):
    """The hashes of a set that come first, hot ones (ascending, with their ranks) last: any set with a similarity of at least 4/5 shares one of them in its own."""
    import numpy as np

    n = len(s)
    if n and len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        s = np.concatenate([s[~is_hot], s[is_hot][np.argsort(rank[at[is_hot]])]])
    return s[: n - (4 * n + 4) // 5 + 1] if n else s


def wide_fingerprints(sets: list):
    """Two 64-bit words (as signed integers) of each set: a bit is 1 if it is in over half of the hashes, or of hashes made from them."""
    import numpy as np

    out = np.zeros((len(sets), 2), np.int64)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        # groups of about 64 K hashes; a longer set is counted part by part
        to, held = at, 0
        while to < len(sets) and (to == at or held + sizes[to] <= 1 << 16):
            held += sizes[to]
            to += 1
        counts = np.zeros((to - at, 128), np.int64)
        own = np.flatnonzero(sizes[at:to])
        flat = np.concatenate(sets[at:to]).view(np.uint64)
        starts = np.append(0, np.cumsum(sizes[at:to])[:-1])[own]
        for lo in range(0, len(flat), 1 << 16):
            part = flat[lo : lo + (1 << 16)]
            second = (part ^ (part >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            bits = np.unpackbits(np.stack([part, second ^ (second >> np.uint64(32))], 1).astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            inside = np.clip(starts - lo, 0, len(part))
            live = np.flatnonzero((starts + sizes[at:to][own] > lo) & (starts < lo + len(part)))
            if len(live):
                counts[own[live]] += np.add.reduceat(bits, inside[live], axis=0, dtype=np.int64)
        out[at:to] = np.packbits(2 * counts > sizes[at:to, None], axis=1, bitorder="little").view("<i8")
        at = to
    return out


def odd_sketches(sets: list):
    """ODD signed words of each set: of 64 x ODD buckets of hashes, a bit is 1 if an odd number of the set's hashes fall in its bucket.

    A bucket in which the bits of two sets differ holds a hash that only one of them has, so the sets differ in at
    least as many hashes as their sketches in bits, however large they are.
    """
    import numpy as np

    width, out = 64 * ODD, np.zeros((len(sets), ODD), "<i8")
    for at in range(0, len(sets), 1024):
        part = sets[at : at + 1024]
        flat = np.concatenate([(s.view(np.uint64) >> np.uint64(20)) % np.uint64(width) for s in part]).astype(np.int64)
        own = np.repeat(np.arange(len(part)), [len(s) for s in part])
        odd = np.bincount(own * width + flat, minlength=len(part) * width).reshape(len(part), width) & 1
        out[at : at + 1024] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
    return out


def numbered(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the set's number), file, row, o0.. (odd sketch) of every row with c null; besides, rows with a hash fp and in how many (c) of its different sets a task saw it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parts, held, known = [np.zeros(0, np.int64)], 0, set()
        names = ["doc_id", "fp", "file", "row", "c", *ODDS]

        def counted():
            keys, c = np.unique(np.concatenate(parts), return_counts=True)
            keys, c = keys[c > 2], c[c > 2]
            null = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([null, pa.array(keys), null, null, pa.array(c.astype(np.int64)), *[null] * ODD], names)

        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle)
                ids = set_ids(sets)
                new = {i: s for i, s in zip(ids, sets, strict=True) if i not in known}
                known.update(new)
                parts.extend(new.values())
                held += sum(map(len, new.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), batch.column(2), batch.column(3), pa.nulls(len(sets), pa.int64()), *map(pa.array, odd_sketches(sets).T.copy())], names)
                if held > HELD:
                    yield counted()
                    parts, held, known = parts[:1], 0, set()
        yield counted()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"), "file", "row")
    return slim.mapInArrow(tidy(run), "doc_id long, fp long, file long, row long, c long" + "".join(f", {o} long" for o in ODDS))


def prefixes(docs: DataFrame, hot, shingle: int = 5, text: str = "text") -> DataFrame:
    """hot: hashes that come last, in this order. key, fp, n (hashes of the set), at (place from 1), hot, s1, s2 (fingerprint) of the first hashes of each row's set; sets that a task sees again are left out."""
    import numpy as np

    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, rank = shared.value
        known: set = set()
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                sets = shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle)
                if len(known) > HELD // 16:
                    known.clear()
                new = {i: s for i, s in zip(set_ids(sets), sets, strict=True) if i not in known}
                known.update(new)
                if not new:
                    continue
                keys = [_head(s, last, rank) for s in new.values()]
                counts = [len(k) for k in keys]
                each = lambda x: pa.array(np.repeat(np.asarray(x, np.int64), counts))  # noqa: B023, E731
                at = np.concatenate([np.arange(1, c + 1) for c in counts]).astype(np.int32)
                flat = np.concatenate(keys)
                is_hot = last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat if len(last) else np.zeros(len(flat), bool)
                s = wide_fingerprints(list(new.values()))
                n = each([len(x) for x in new.values()]).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(flat), each(list(new)), n, pa.array(at), pa.array(is_hot), each(s[:, 0]), each(s[:, 1])], ["key", "fp", "n", "at", "hot", "s1", "s2"])

    return docs.select(whole_text(text).alias("t")).mapInArrow(tidy(run), "key long, fp long, n int, at int, hot boolean, s1 long, s2 long")


def whole_sets(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """fp, n (hashes of the set), hashes (the low halves of them) of every row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                sets = shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                n = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets), pa.int64()), n, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).astype(np.int32)))], ["fp", "n", "hashes"])

    return docs.select(whole_text(text).alias("t")).mapInArrow(tidy(run), "fp long, n int, hashes array<int>")


def _distance(a: str = "", b: str = "2") -> Column:
    """Differing bits of two fingerprints."""
    return sum((F.bit_count(F.col(f"{s}{a}").bitwiseXOR(F.col(f"{s}{b}"))) for s in ("s1", "s2")), F.lit(0))


def _radius() -> Column:
    return F.when(F.least("n", "n2") < SMALL_SET, SMALL_RADIUS).otherwise(RADIUS)


def _possible() -> Column:
    """The overlap that the places of a shared key leave possible is enough: 9 x overlap >= 4 x (n + n2) is similarity >= 4/5.

    What two sets share before a key that both have among their first hashes is among the first hashes of both, so
    of the hashes up to the key only those count that more than one set has (live).
    """
    most = F.least("live", "live2") + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return 9 * most >= 4 * (F.col("n") + F.col("n2"))


def _second(shared: DataFrame, *more: str) -> DataFrame:
    return shared.select("key", *(F.col(c).alias(f"{c}2") for c in (*SIDE, *more)))


def _met(pairs: DataFrame) -> DataFrame:
    """a, b, d (differing bits), each pair once, of rows that share a key and pass all bounds."""
    near = pairs.where(_possible()).withColumn("d", _distance()).where(F.col("d") <= _radius())
    return near.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"), "d").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, folder: str, name: str, shingle: int, text: str) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least 4/5. places: fp, file, row of one row for each set."""
    pairs = cut(pairs.select("a", "b").distinct(), folder, f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    asked = cut(places.join(small(cut(asked, folder, f"{name}-asked")), "fp").select(F.col("file").alias("_f"), F.col("row").alias("_r")), folder, f"{name}-places")
    own = docs.join(small(asked), (F.col("file") == F.col("_f")) & (F.col("row") == F.col("_r")), "left_semi")
    sets = cut_texts(whole_sets(own, shingle, text), folder, f"{name}-sets")
    a, b = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}")) for c in "ab")
    # b's set travels to a's: one shuffle of either side
    met = b.join(small(pairs), "b").join(a, "a")
    return cut(met.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), folder, f"{name}-links")


def found(docs: DataFrame, folder: str, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, file, row of every row of docs; edges (a, b) between numbers fp that connect what pairs of similarity 4/5 connect). docs have places (file, row)."""
    seen = cut_texts(numbered(docs, shingle, doc_id, text), folder, "numbered")
    sketched = seen.where("c is null")
    made = sketched.drop("c", *ODDS)
    places = made.groupBy("fp").agg(F.min(F.struct("file", "row")).alias("p")).select("fp", "p.*")
    # only the order of hashes depends on these: whatever the order, no pair is missed
    often = seen.where("c is not null").groupBy("fp").agg(F.sum("c").alias("c")).where(F.col("c") > HOT).orderBy(F.desc("c"), "fp").limit(MOST_HOT)
    hot = often.select("fp").toArrow().column(0).to_numpy()[::-1]
    # one exchange of the keys: those that only one set has go behind it; hot ones, dealt over many tasks, all stay
    salt = F.when(F.col("hot"), F.pmod("fp", F.lit(SALTS))).otherwise(0)
    posted = prefixes(docs, hot, shingle, text).withColumn("salt", salt).repartition("key", "salt")
    own = Window.partitionBy("key", "salt")
    columns = ["key", *SIDE]
    shared = posted.withColumns({"lo": F.min("fp").over(own), "hi": F.max("fp").over(own)}).where("hot or lo <> hi").select("salt", "key", "fp", "n", "at", "s1", "s2").distinct()
    shared = shared.withColumn("live", F.row_number().over(Window.partitionBy("fp").orderBy("at")))
    shared = cut_texts(shared.select(columns), folder, "shared")
    size = cut(shared.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), folder, "sizes")
    few = shared.join(size.where(F.col("c") <= LARGE), "key").select(columns)
    pairs = cut(_met(few.join(_second(few), "key").where(F.col("fp") < F.col("fp2"))), folder, "few")
    large = cut(shared.join(small(size.where(F.col("c") > LARGE)), "key").select(columns), folder, "large")
    each = pairs.select(F.col("a").alias("x"), "a", "b", "d").union(pairs.select(F.col("b").alias("x"), "a", "b", "d"))
    first = each.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")
    crowded = not large.isEmpty()
    if crowded:
        # the pivots of each key, and the table of distances to them
        pivots = large.select("key")
        for r in range(CENTRES):
            one = large.groupBy("key").agg(F.min_by(F.struct(*SIDE), F.xxhash64("fp", F.lit(r))).alias(f"p{r}"))
            pivots = one if not r else pivots.join(one, "key")
        pivots = cut(pivots, folder, "pivots")
        table = large.join(small(pivots), "key")
        for r in range(CENTRES):
            d = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"p{r}.{s}"))) for s in ("s1", "s2")), F.lit(0))
            table = table.withColumn(f"d{r}", d)
        table = cut(table, folder, "distances")
        # copies of one text are nearer to it than to each other: of all sets the one in the middle of the pivots is a pivot, too
        middle = F.struct(sum((F.col(f"d{r}") for r in range(CENTRES)), F.lit(0)), "fp")
        middles = cut(table.groupBy("key").agg(F.min_by(F.struct(*SIDE), middle).alias("middle")), folder, "middles")
        table = table.join(small(middles), "key")
        for p in (*(f"p{r}" for r in range(CENTRES)), "middle"):
            beside = table.select(*columns, *(F.col(f"{p}.{c}").alias(f"{c}2") for c in SIDE))
            first = first.union(_met(beside.where("fp <> fp2")).select("a", "b"))
    known = _verified(first, docs, places, folder, "first", shingle, text)
    roots = components(known, f"{folder}/nearest")
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    rest = pairs.select("a", "b")
    if crowded:
        sketches = sketched.join(small(cut(table.select("fp").distinct(), folder, "crowded")), "fp").groupBy("fp").agg(*(F.first(o).alias(o) for o in ODDS))
        sketches = cut(sketches, folder, "sketches")
        at = cut(table.select(*columns, *(f"d{r}" for r in range(CENTRES))).join(small(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(small(sketches), "fp"), folder, "members")
        most = at.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
        outside = at.join(small(cut(most, folder, "tops")), "key").where("root <> top").drop("top")
        met = outside.join(_second(at, "root", *(f"d{r}" for r in range(CENTRES)), *ODDS), "key").where("root <> root2")
        for r in range(CENTRES):
            met = met.where(F.abs(F.col(f"d{r}") - F.col(f"d{r}2")) <= _radius())
        # a similarity of at least 4/5 is at most (n + n2) / 9 hashes that only one of the two has
        differing = sum((F.bit_count(F.col(o).bitwiseXOR(F.col(f"{o}2"))) for o in ODDS), F.lit(0))
        met = met.where(9 * differing <= F.col("n") + F.col("n2"))
        # two such sets meet at the first key they share, too, and before that they share nothing
        met = met.where(9 * (1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))) >= 4 * (F.col("n") + F.col("n2")))
        rest = rest.union(_met(met).select("a", "b"))
    apart = rest.join(small(ra), "a", "left").join(small(rb), "b", "left").where(F.coalesce(F.col("ra") != F.col("rb"), F.lit(True))).select("a", "b")
    return made, known.union(_verified(apart.join(known, ["a", "b"], "left_anti"), docs, places, folder, "rest", shingle, text))
