"""Language ID by the nearest of several clustered centroids per language.

A text is a TF-IDF vector of letter trigrams: bytes are folded to 32 classes (blank for ASCII that is no
letter, a-z, and five classes of bytes beyond ASCII), so there are 32768 trigrams and each is a dimension. Texts
with characters beyond the Latin ones have trigrams of whole characters besides, hashed to 32768 more dimensions,
which tell languages of one script apart. Term frequency is 1 + ln(count), vectors have length 1, nearness is the cosine. Centroids come from
spherical k-means over a bounded sample of labelled rows; everything else reads whole texts of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import forget_caches, slices, whole_text

BYTE_DIMENSIONS = 1 << 15
DIMENSIONS = 2 * BYTE_DIMENSIONS
UNKNOWN = "und"
#: a-z and A-Z: 1 to 26. C3 leads the accented Latin letters: 27. Bytes that follow a lead: 28 to 30. Other leads (other scripts): 31.
_CLASS = bytes(b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 0 if b < 128 else 28 + b % 3 if b < 0xC0 else 27 if b == 0xC3 else 31 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def trigrams(text: bytes):
    """(dimension, 1 + ln(count)) arrays of a text's letter trigrams, a blank on either side; without the all-blank one."""
    import numpy as np

    c = np.frombuffer(b"\x00" + text.translate(_CLASS) + b"\x00", np.uint8).astype(np.int32)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = (c[:-2] << 10) | (c[1:-1] << 5) | c[2:]
    if (c == 31).any():
        u = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        u = np.pad(np.where(u >= 0x250, u, np.uint64(0)), 1)
        own = u[:-2] + u[1:-1] + u[2:] > 0
        mixed = ((u[:-2] * np.uint64(0x9E3779B1) + u[1:-1]) * np.uint64(0x85EBCA6B) + u[2:]) * np.uint64(0x9E3779B97F4A7C15)
        codes = np.concatenate([codes, (mixed[own] >> np.uint64(49)).astype(np.int32) + BYTE_DIMENSIONS])
    if len(codes) < 600:
        at, n = np.unique(codes, return_counts=True)
    else:
        n = np.bincount(codes, minlength=DIMENSIONS)
        at = np.flatnonzero(n)
        n = n[at]
    if len(at) and at[0] == 0:
        at, n = at[1:], n[1:]
    return at, 1 + np.log(n)


def reach(n: int) -> float:
    """About what cosine a text of n different trigrams can have with a broad centroid; it levels off for longer texts."""
    return (min(n, 300) / 300) ** 0.5


@dataclass
class Model:
    """idf by dimension; centroids as columns; the language of each column; the least relative cosine (see `reach`)."""

    idf: object
    centroids: object
    languages: list[str]
    least: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        """The nearest centroid's language, its cosine, and whether it is rejected: a cosine under `least` of its reach.

        A text without letters gives und, 0 and rejected; so does every text if nothing was learned.
        """
        import numpy as np

        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, tf = trigrams(text.encode())
        v = tf * self.idf[at]
        near = (v @ self.centroids[at]) / max(float(np.sqrt(v @ v)), 1e-300)
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[best], score, score < self.least * reach(len(at))


def _cluster(x, k: int, rounds: int = 12):
    """Spherical k-means of the rows of x (length 1 each), begun with the row nearest the mean, then the farthest ones."""
    import numpy as np

    centre = x.mean(0)
    seeds = [int(np.argmax(x @ centre))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    own = None
    for _ in range(rounds):
        new = np.argmax(x @ c.T, 1)
        if own is not None and (new == own).all():
            break
        own = new
        for j in range(len(c)):
            if (own == j).any():
                s = x[own == j].sum(0)
                c[j] = s / max(np.linalg.norm(s), 1e-12)
    return c


def fit(rows: list[tuple[str, object, object]], clusters: int = 4, reject: float = 0.25) -> Model:
    """rows: (language, dimensions, 1 + ln(count)) of the sample. reject: of the least relative cosine of a sample row to its own language's centroids."""
    import numpy as np

    df = np.zeros(DIMENSIONS)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    # only the dimensions that the sample has
    live = np.flatnonzero(df)
    number = np.zeros(DIMENSIONS, np.int64)
    number[live] = np.arange(len(live))
    columns, languages, least = [], [], 4.0
    for lang in sorted({r[0] for r in rows}):
        own = [(at, tf * idf[at]) for la, at, tf in rows if la == lang and len(at)]
        if not own:
            continue
        x = np.zeros((len(own), len(live)), np.float32)
        for i, (at, v) in enumerate(own):
            x[i, number[at]] = v / np.linalg.norm(v)
        c = _cluster(x, clusters)
        least = min(least, *((float(v) / reach(len(at))) for v, (at, _) in zip((x @ c.T).max(1), own, strict=True)))
        columns.append(c)
        languages += [lang] * len(c)
    centroids = np.zeros((DIMENSIONS, len(languages)), np.float32)
    if columns:
        centroids[live] = np.concatenate(columns).T
    return Model(idf, centroids, languages, reject * least if columns else 4.0)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text (null: empty) is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = 400, clusters: int = 4, reject: float = 0.25, most_languages: int = 500, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from at most `sample` rows of each of the `most_languages` languages with most rows, of rows that are not held out.

    The sample has the rows that are least by a hash of id and text. Both bounds hold the model's size; neither
    touches a prediction, which every row gets. Rows without text or language teach nothing; no rows, no languages.
    """
    h = F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    labelled = ~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows_of = docs.where(labelled).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n"), F.min(h).alias("least"))
    counts = rows_of.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return fit([])
    # hashes are uniform: about four times the sample of each language lies under its bound, and its least one does, whatever its size
    under = [(r.lang, max(r.least, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * sample // r.n))) for r in counts]
    most = F.create_map(*(x for la, bound in under for x in (F.lit(la), F.lit(bound).cast("long"))))

    def features(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget_caches()
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                found = [trigrams(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([at.astype("<u2").tobytes() for at, _ in found], pa.binary()), pa.array([tf.astype("<f4").tobytes() for _, tf in found], pa.binary()), batch.column(2)], ["lang", "at", "tf", "h"])

    chosen = docs.where(labelled & (h <= most[F.col(lang).cast("string")])).select(F.col(lang).cast("string").alias("lang"), whole_text(text).alias("t"), h.alias("h"))
    made = chosen.mapInArrow(features, "lang string, at binary, tf binary, h long")
    # rows that repeat the last id could be more than asked for
    ranked = made.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "at", "tf"))).where(F.col("r") <= sample)
    import numpy as np

    rows = [(r.lang, np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.tf, "<f4").astype(np.float64)) for r in ranked.orderBy("lang", "r").collect()]
    return fit(rows, clusters, reject)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs, by whole texts, however long.

    Null texts and texts without letters give und, 0 and true; so does everything if nothing was learned. All
    others give a learned language; rejected tells those too far from it. Null doc_ids and repeated rows stay;
    other columns are not read; equal cosines go to the first language by name. Empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget_caches()
        own = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                found = [own.predict(t) for t in batch.column(1).to_pylist()]
                lang, score, rejected = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose language is rejected (null texts and those without letters go, too), all columns kept; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget_caches()
        own = shared.value
        for whole in batches:
            for batch in slices(whole, at, 4 << 20):
                keep = [t is not None and not own.predict(t)[2] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
