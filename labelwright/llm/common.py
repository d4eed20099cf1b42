"""Shared plumbing: work folders, written cut points, path-agnostic reads."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import cut, work_folder  # noqa: F401 - cut points of this subpackage, too


_shipped: set = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="labelwright-"), "labelwright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("labelwright", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the package is on the workers from here on."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most SMALL_ROWS rows, counted first (rows must be slim); else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with marks added where a column (in any case) has that name."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def placed(docs: DataFrame, folder: str, file: str = "file", row: str = "row", named: bool = False) -> DataFrame:
    """docs and two more columns that tell a row: a hash of its file's path (named: its file's name), and its place there.

    Rows that are in no files are written once, in the order of their partitions.
    """
    of = lambda d: d["_metadata.file_name"] if named else F.xxhash64(d["_metadata.file_path"])
    at = lambda d: d.select(*(d[f"`{c}`"] for c in d.columns), of(d).alias(file), d["_metadata.row_index"].alias(row))
    try:
        return at(docs)
    except AnalysisException:
        return at(cut(docs, folder, "placed"))


def without(docs: DataFrame, gone: DataFrame, file: str, row: str) -> DataFrame:
    """docs (placed by columns `file` and `row`) without the rows whose place is in `gone` (file, row), and without those two columns.

    The places are broadcast if they are few, counted first; else both sides are shuffled by place.
    """
    gone = gone.select(F.col("file").alias("_f"), F.col("row").alias("_r"))
    left = docs.join(small(gone), (docs[file] == F.col("_f")) & (docs[row] == F.col("_r")), "left_anti")
    return left.drop(file, row)


#: Caches of this worker process, by module; a worker serves one kind of task after another.
_caches: list[dict] = []


def keep_cache(cache: dict) -> dict:
    _caches.append(cache)
    return cache


def forget_caches() -> None:
    """Give back what earlier kinds of tasks keep in this worker: memory is for the task at hand."""
    for cache in _caches:
        cache.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, and its peak would stay with it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(run):
    """run, a function of an iterator of Arrow batches, between a clean start and memory given back: a worker that waits for its next task holds none."""

    def tidied(batches):
        forget_caches()
        yield from run(batches)
        give_back()

    return tidied


#: Texts that the JVM and a worker hold for one another at once, in bytes; a longer single text is a batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut_texts(df: DataFrame, folder: str, name: str) -> DataFrame:
    """As cut, for plans that send whole texts to workers: batches are bounded by bytes, not by rows. The session's own setting is put back."""
    conf = df.sparkSession.conf
    was = conf.get(_BATCH)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return cut(df, folder, name)
    finally:
        conf.set(_BATCH, was)


def whole_text(text: str = "text"):
    """The text, with null read as the empty string."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def slices(batch, byte_col: int, most: int = 16 << 20):
    """Row slices of an Arrow batch whose texts hold about `most` bytes each (a longer single text is a slice)."""
    import numpy as np
    import pyarrow as pa

    col = batch.column(byte_col)
    n = batch.num_rows
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    ends = ends - ends[0]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_pieces(text: bytes, most: int):
    """A text in pieces of about `most` bytes, cut at blanks; words are never cut."""
    import re

    blank, at = re.compile(rb"[ \t-\r]"), 0
    while len(text) - at > most:
        m = blank.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]
