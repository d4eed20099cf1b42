"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source are put in a hashed order and cut into blocks. Weights are positive whole numbers p with
sum Q, so block k of a source is released at slot floor(k*Q/p) and due before slot ceil((k+1)*Q/p). In every
slot the released block that is due first runs (ties to the first source by name). On one processor that
meets all deadlines, so at any slot a source's blocks differ from its share by less than one. The schedule
repeats after Q slots: it is worked out once, for one period, and its size depends on the weights alone.

A period is worked out in segments of `SEGMENT` slots: a fold over the slots keeps a sorted pool of released
blocks. No more blocks than slots can run in a segment, so only as many of those released before it, due
first, go into its fold; the others wait in a table. A period of one segment needs no table. So work and
memory of a fold are bounded, whatever the number of sources.

A source that runs out leaves its slots empty, the others keep theirs: no row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, fresh, work_folder

#: Slots worked out in one fold; a plan of at most so many rows is broadcast; rows of a bucket from which on its repeated ids are looked for.
SEGMENT, BROADCAST_SLOTS, LARGE_BUCKET = 4096, 100_000, 200_000
_HEX = 3
COLUMNS = ("mix_block", "mix_slot", "mix_order")


def _fold(waiting: DataFrame, lo: int, hi: int, sources: int) -> DataFrame:
    """slot, key of the blocks that run in slots lo to hi - 1, out of blocks (release, key: due time * number of sources + source)."""
    slots = waiting.sparkSession.range(lo, hi).select(F.col("id").alias("slot"))
    released = waiting.groupBy(F.greatest(F.col("release"), F.lit(lo)).alias("slot")).agg(F.collect_list("key").alias("keys"))
    listed = slots.join(released, "slot", "left").agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")))).alias("s"))

    def step(state: Column, x: Column) -> Column:
        # bound once by a one-element array, so that the pool isn't sorted again for each use
        pool = F.array(F.sort_array(F.concat(state["pool"], x["keys"])))
        rest = F.transform(pool, lambda p: F.struct(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("pool"), F.concat(state["picks"], F.slice(p, 1, 1)).alias("picks")))
        return F.get(rest, 0)

    empty = F.array().cast("array<bigint>")
    run = F.aggregate("s", F.struct(empty.alias("pool"), empty.alias("picks")), step)
    return listed.select(F.posexplode(run["picks"]).alias("at", "key")).select((F.col("at") + lo).cast("long").alias("slot"), "key")


def schedule(weights: DataFrame, segment: int | None = None) -> DataFrame:
    """source, share, period, turn, slot: for each slot of a period the source that runs, and which of its blocks.

    weights: source, share (positive whole numbers, one row a source; their sum is the period). Empty weights
    give an empty plan.
    """
    spark, segment = weights.sparkSession, segment or SEGMENT
    total = weights.agg(F.coalesce(F.sum(F.col("share").cast("long")), F.lit(0)).alias("q"), F.count("*").alias("n")).first()
    q, n = total.q, max(1, total.n)
    # one slim row a source
    named = weights.select("source", F.col("share").cast("long").alias("share")).withColumn("i", F.row_number().over(Window.orderBy("source")).cast("long") - 1)
    k = named.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)))
    blocks = k.select(F.expr(f"k * {q}L div share").alias("release"), (F.expr(f"((k + 1) * {q}L + share - 1) div share") * n + F.col("i")).alias("key"))
    if q <= segment:
        run = _fold(blocks, 0, q, n)
    else:
        folder = work_folder(spark)
        blocks, named = cut(blocks, folder, "blocks"), cut(named, folder, "sources")
        waiting, run = blocks.limit(0), None
        for lo in range(0, q, segment):
            hi = min(q, lo + segment)
            new = blocks.where(F.col("release").between(lo, hi - 1))
            picks = cut(_fold(waiting.orderBy("key").limit(hi - lo).union(new), lo, hi, n), folder, f"run{lo}")
            waiting = cut(waiting.union(new).join(F.broadcast(picks), "key", "left_anti").select("release", "key"), folder, f"waiting{lo}")
            run = picks if run is None else run.union(picks)
    turned = run.select((F.col("key") % n).alias("i"), "slot").withColumn("turn", F.row_number().over(Window.partitionBy("i").orderBy("slot")).cast("long") - 1)
    return turned.join(named, "i").select("source", "share", F.lit(q).cast("long").alias("period"), "turn", "slot")


def equal_cycle(docs: DataFrame, cycle: int = 5, source: str = "source") -> DataFrame:
    """Example target weights: source r (by name, from 0) has share 1 + r mod cycle. A null source counts as ''."""
    names = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    return names.select("source", (1 + (F.row_number().over(Window.orderBy("source")) - 1) % cycle).cast("long").alias("share"))


def mix(docs: DataFrame, weights: DataFrame, block: int = 64, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with mix_block (of its source), mix_slot and mix_order (ascending in the mix; slot * block + place in the block).

    Within a source rows are ordered by a hash of doc_id, then doc_id, then a hash of the whole row. A null
    source counts as '', a null doc_id as an empty one; repeated rows each get a place; columns of docs that
    have one of the new names are replaced. A source without a weight raises; a weight without rows is fine.
    Empty in, empty out. An id that many rows repeat is dealt over buckets by the hash of the row.
    """
    weights = weights.select(F.col("source").cast("string").alias("source"), F.col("share").cast("long").alias("share"))
    total = weights.agg(F.coalesce(F.sum("share"), F.lit(0)).alias("q"), F.count_if(F.col("share") < 1).alias("bad"), (F.count("*") - F.count_distinct("source")).alias("twice")).first()
    if total.bad or total.twice:
        raise ValueError("shares must be positive, one a source")
    plan = schedule(weights)
    if total.q > BROADCAST_SLOTS:
        plan, spread = cut(plan, work_folder(docs.sparkSession), "plan"), lambda df: df
    else:
        spread = F.broadcast
    base = docs.drop(*COLUMNS)
    names = base.columns
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    keyed = base.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.md5(key.cast("binary")).alias("h"))
    keyed = keyed.withColumn("b", F.substring("h", 1, _HEX))
    by = ["s", "b"]
    # places in a source: rows before the bucket (a small prefix sum of pre-aggregated counts) and place in the bucket
    counts = cut(keyed.groupBy(*by).agg(F.count("*").alias("n")), work_folder(docs.sparkSession), "counts")
    mark = F.hex(F.xxhash64("row"))
    large = counts.withColumn("mean", F.avg("n").over(Window.partitionBy("s"))).where((F.col("n") > LARGE_BUCKET) & (F.col("n") > 4 * F.col("mean"))).select(*by)
    if not large.isEmpty():
        # each hot id has over LARGE_BUCKET / 4 rows, so there are few
        hot = keyed.join(F.broadcast(large), by, "left_semi").groupBy(*by, "h").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_BUCKET // 4)
        hot = cut(hot.groupBy(*by).agg(F.collect_set("h").alias("hot")), work_folder(docs.sparkSession), "hot")
        below = F.size(F.filter("hot", lambda x: x < F.col("h")))
        own = F.coalesce(F.array_contains("hot", F.col("h")), F.lit(False))
        keyed = keyed.join(F.broadcast(hot), by, "left").withColumns({"part": F.when(F.col("hot").isNull(), 0).otherwise(2 * below + own.cast("int")), "deal": F.when(own, F.substring(F.lpad(mark, 16, "0"), 1, 2)).otherwise("")}).drop("hot")
        by = [*by, "part", "deal"]
        counts = keyed.groupBy(*by).agg(F.count("*").alias("n"))
    before = counts.select(*by, (F.sum("n").over(Window.partitionBy("s").orderBy(*by[1:])) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("h", F.col(f"row.`{doc_id}`"), F.lpad(mark, 16, "0"))) - 1)
    place = ranked.join(before, by).withColumn("i", F.col("i") + F.col("before"))
    shares = plan.select(F.col("source").alias("s"), "share", "period").distinct()
    with_share = place.join(spread(shares), "s", "left").withColumn("mix_block", F.floor(F.col("i") / block).cast("long"))
    checked = with_share.withColumn("share", F.coalesce("share", F.raise_error(F.concat(F.lit("no weight for source "), F.col("s"))).cast("long")))
    turns = plan.select(F.col("source").alias("s"), "turn", "slot")
    slotted = checked.withColumn("turn", F.col("mix_block") % F.col("share")).join(spread(turns), ["s", "turn"])
    slot = F.floor(F.col("mix_block") / F.col("share")).cast("long") * F.col("period") + F.col("slot")
    return slotted.select("row.*", "mix_block", slot.alias("mix_slot"), (slot * block + F.col("i") % block).cast("long").alias("mix_order"))


def in_mix_order(docs: DataFrame, weights: DataFrame, **names) -> DataFrame:
    """docs, the same rows and columns, laid out in mix order: files by name, and rows within them."""
    # columns that have one of mix's names are set aside, so that they come back
    own = [c for c in docs.columns if c.lower() in COLUMNS]
    aside = dict(zip(own, fresh([*docs.columns, *COLUMNS], *(f"own_{c}" for c in own)), strict=True))
    mixed = mix(docs.withColumnsRenamed(aside), weights, **names).orderBy("mix_order")
    return mixed.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


SQL = """
WITH RECURSIVE s AS (
  SELECT source, 1 + (row_number() OVER (ORDER BY source) - 1) % 5 AS share
  FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)
), p AS (SELECT list(source ORDER BY source) AS names, list(share::BIGINT ORDER BY source) AS p, sum(share)::BIGINT AS q FROM s),
e(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(p, lambda x: 0::BIGINT), 0::BIGINT FROM p
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, i: CASE WHEN i = c THEN k + 1 ELSE k END), c FROM (
    SELECT t, done, list_position(due, list_min(due))::BIGINT AS c FROM (
      SELECT t, done, list_transform(p, lambda w, i: CASE WHEN done[i] * q // w <= t + 1 THEN ((done[i] + 1) * q + w - 1) // w ELSE 4611686018427387904 END) AS due
      FROM e, p WHERE t + 1 < q
    )
  )
), plan AS (
  SELECT names[pick] AS source, p[pick] AS share, q, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM e, p WHERE t >= 0
), d AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS i FROM documents
)
SELECT d.doc_id, d.source, (i // 64)::BIGINT AS mix_block, ((i // 64) // share * q + slot)::BIGINT AS mix_slot,
  (((i // 64) // share * q + slot) * 64 + i % 64)::BIGINT AS mix_order
FROM d JOIN plan ON d.source = plan.source AND (i // 64) % share = turn
"""
