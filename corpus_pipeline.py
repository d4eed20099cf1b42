"""From documents to token files: language ID, SimHash near-dedup, decontamination, mixing, token-ID output.

Each stage works on all that the one before it kept, written as Parquet and read again. The mixing stage
keeps every row and lays the rows out in mix order, by file name and by place in the file; the token stage
writes ids in that order, so the mix is the order of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelwright.llm import decontamination, language_id, mixing, simhash, token_files
from labelwright.llm.common import placed, ship, table, work_folder
from labelwright.sources.work import clear, mark

#: Pieces that a worker of the last stage keeps encoded: its executor's JVM has grown in four stages by then.
TOKEN_CACHE = 200_000
#: SQL can express neither XXH64 fingerprints nor the tokenizer.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known to a model learned from docs; those rejected go."""
    ship(spark)
    return language_id.keep_known(docs, language_id.train(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: those that SimHash links, verified at a similarity of 0.8 of five-word shingles, connect."""
    ship(spark)
    return simhash.keep_one_similar(docs, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, laid out in the order of the mix."""
    return mixing.in_mix_order(docs, mixing.equal_cycle(docs), block=64)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from token files in the order in which docs are laid out: by file, and by place in it."""
    import public_tokenizers

    ship(spark)
    laid = placed(docs.select("doc_id", "text"), work_folder(spark), "file", "row", named=True)
    return token_files.token_files(laid, public_tokenizers.path("byte_bpe_50k.json"), order=["file", "row"], cache_entries=TOKEN_CACHE)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last one's rows.

    A stage's work folders go once its rows are written; those of the last one stay, as its rows are read from them.
    """
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        before = mark()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            clear(spark, before)
    return docs
