"""The queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=2)
    n_hit, n_near = (F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]) for c in ("spans", "near_spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        n_near.alias("n_near"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), most=2)
    return out.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, train

    out = find_personal_data(table(spark, sf_dir, "documents"), train())
    n = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(n, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "pages"), ratio=0.2, least_pages=3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import equal_cycle, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return mix(docs, equal_cycle(docs), block=64)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_personal_data": op3_personal_data,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_neighbours": op9_neighbours,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
pos AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
item AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS words FROM benchmark),
win AS (SELECT item_id, words[i:least(i + 9, len(words))] AS w FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM item WHERE len(words) > 0)),
dw AS (SELECT w, row_number() OVER () AS id, len(w) AS n FROM (SELECT DISTINCT w FROM win)),
term AS (SELECT id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM dw),
freq AS (SELECT word, count(*) AS f FROM pos GROUP BY word),
anchor AS (SELECT id, n, arg_min(word, o) AS word, arg_min(j, o) AS j FROM (SELECT t.*, coalesce(f, 0) * 1000 + j AS o FROM term t LEFT JOIN freq USING (word)) GROUP BY id, n),
cand AS (SELECT a.id, a.n, pos.r, pos.p - a.j AS s FROM anchor a JOIN pos USING (word)),
seen AS (SELECT c.id, c.r, c.s, c.n, t.j, max(CASE WHEN q.p = c.s + t.j THEN 1 ELSE 0 END) AS exact FROM cand c JOIN term t ON t.id = c.id JOIN pos q ON q.r = c.r AND q.word = t.word AND q.p BETWEEN c.s + t.j - 2 AND c.s + t.j + 2 GROUP BY ALL),
found AS (SELECT id, r, s, n, min(exact) = 1 AS exact FROM seen GROUP BY id, r, s, n HAVING count(*) = n),
hit AS (SELECT f.r, f.exact, unnest(range(greatest(s, 0), least(s + n, len(d.words)))) AS p FROM found f JOIN d USING (r)),
span AS (SELECT r, count(DISTINCT p) FILTER (exact) AS n_hit, count(DISTINCT p) AS n_near FROM hit GROUP BY r),
ids AS (SELECT f.r, list_sort(list_distinct(list(item_id) FILTER (exact))) AS exact_ids, count(DISTINCT item_id) AS n_near_items FROM found f JOIN dw USING (id) JOIN win USING (w) GROUP BY f.r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(exact_ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(exact_ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN span USING (r) LEFT JOIN ids USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op9_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
