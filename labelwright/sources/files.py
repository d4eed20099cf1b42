"""File sources and sinks: all-string CSV in, conformed CSV with BOM, catalog, JSON and history out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import normal_truth
from ..operators.rules import conform, rename_aliases
from ..schema import TAG_COLUMNS

BOM = "﻿"


def read_csv(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """All columns as text, nothing as null, with the file's name in source_file; a BOM in the header goes. [S2, S3]"""
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    df = reader.csv(path)
    df = df.toDF(*[c.replace(BOM, "").strip() for c in df.columns])
    named = df.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")) if "source_file" not in df.columns else df
    return rename_aliases(named.na.fill(""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows with comma decimals, numbers as numbers, and the order of rows in gt_id. [S4]"""
    df = read_csv(spark, path).withColumn("gt_id", F.monotonically_increasing_id())
    return normal_truth(df)


def discover(spark: SparkSession, rows: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(pairs that are there, pairs with a missing file) of (name, video path, csv path). [S5]"""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    df = spark.createDataFrame([(*r, there(r[1]) and there(r[2])) for r in rows], "name string, video_path string, csv_path string, found boolean")
    return df.where("found").drop("found"), df.where("not found").drop("found")


def write_tags(df: DataFrame, path: str) -> None:
    """The 29 conformed columns as CSV, distributed, one header a file. [S6]"""
    conform(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_one_csv(df: DataFrame, path: str, most: int = 1_000_000) -> str:
    """One local CSV file with BOM and header, for result sets of at most `most` rows; more raise. [S6, S12]"""
    import csv
    import os

    out = conform(df)
    if out.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: use write_tags")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(TAG_COLUMNS)
        for row in out.toLocalIterator():
            w.writerow(row)
    return path


def write_catalog(rows: DataFrame, path: str) -> None:
    """Catalog rows as CSV. [S7]"""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines. [S8]"""
    df.write.mode("overwrite").json(path)


def write_diagnostics(scores: DataFrame, accuracy: DataFrame, near: DataFrame, folder: str) -> None:
    """Matches, near misses and field accuracy as CSV folders. [S9]"""
    flat = scores.drop("right")
    for name, df in (("matched_tags_debug", flat), ("pass80_candidates", near.where("kind = 'pass80_candidate'").drop("right")), ("failed_near_threshold", near.where("kind = 'failed_near'").drop("right")), ("field_accuracy", accuracy)):
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a debug or history table; each append is a set of files. [S10, S13]"""
    df.write.mode("append").parquet(path)


def union_videos(frames: list[DataFrame]) -> DataFrame:
    """Several videos' rows as one table, missing columns null. [S12, O3]"""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def profile(df: DataFrame) -> DataFrame:
    """column, filled, absent, nan, empty: one pass over all columns. [S14]"""
    from ..functions.presence import text
    from ..schema import ABSENT

    cols = df.columns
    t = {c: text(c) for c in cols}
    kinds = lambda c: F.when(t[c] == ABSENT, "absent").when(F.lower(t[c]) == "nan", "nan").when(t[c] == "", "empty").otherwise("filled")
    one = df.agg(*(F.struct(*(F.count_if(kinds(c) == k).alias(k) for k in ("filled", "absent", "nan", "empty"))).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in cols))).alias("r")).select("r.column", "r.n.*")


def schema_difference(columns: list[str]) -> tuple[list[str], list[str]]:
    """(extra, missing) against the tag schema. [S14, O5]"""
    return [c for c in columns if c not in TAG_COLUMNS], [c for c in TAG_COLUMNS if c not in columns]


def undecoded_sample(records: DataFrame, n: int, videos: int, order: str = "row_id") -> DataFrame:
    """Undecoded records, at most n // videos of each video (one at least), then the first n. [S16]"""
    from pyspark.sql import Window

    each = max(1, n // max(1, videos))
    w = Window.partitionBy("video").orderBy(order)
    return records.where("not decoded_any").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= each).drop("_i").orderBy("video", order).limit(n)
