"""Tag-shaped views of plain tables. SQL holds the same views as DuckDB text, one by one, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ident import check_digit
from ..functions.presence import let
from ..schema import ABSENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money_text(cents: Column, mark: str) -> Column:
    return F.concat((F.floor(cents / 100)).cast("long").cast("string"), F.lit(mark), F.lpad((cents % 100).cast("string"), 2, "0"))


def ean(partkey: str) -> Column:
    twelve = F.concat(F.lit("460"), F.lpad(F.col(partkey).cast("string"), 9, "0"))
    return F.concat(twelve, check_digit(twelve))


def apart(x: Column) -> Column:
    """The value itself. With a lambda in it Spark splits a wide select into methods; as one method it is too long for the JVM to compile."""
    return let(x, lambda v: v)


def catalog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as catalog rows; every fourth part has a second row with another card price and a shorter name."""
    p = table(spark, sf_dir, "part")
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    k = F.col("p_partkey")
    pick = lambda n, *vs: F.element_at(F.array(*map(F.lit, vs)), (n % len(vs) + 1).cast("int"))
    out = p.select(
        F.concat_ws(" ", "p_name", "p_brand").alias("product_name"), F.concat(F.lit("2"), F.lpad(k.cast("string"), 11, "0")).alias("id_sku"), ean("p_partkey").alias("barcode"), F.when(k % 5 == 0, ean("p_partkey")).otherwise(ABSENT).alias("qr_code_barcode"),
        money_text(cents, ",").alias("price_default"), money_text(F.floor(cents * 80 / 100).cast("long"), ",").alias("price_card"), F.lit(ABSENT).alias("price_discount"), money_text(F.floor(cents * 95 / 100).cast("long"), ".").alias("price2_qr"),
        pick(k, "К", "k", "Ш", "x", "no").alias("special_symbols"), F.concat(F.lit("12_"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("code"), F.when(k % 3 == 0, "").otherwise("01.02.2026 9:05").alias("print_datetime"),
        F.when(k % 6 == 0, "nan").otherwise(F.col("p_type")).alias("additional_info"), F.concat(F.lit("v"), (k % 23).cast("string"), F.lit(".csv")).alias("source_file"), k.alias("ord"), cents.alias("cents"), k.alias("partkey"),
    )
    again = out.where(F.col("partkey") % 4 == 0).withColumns({"product_name": F.substring("product_name", 1, 9), "price_card": money_text(F.floor(F.col("cents") * 80 / 100).cast("long") + 100, ","), "ord": F.col("ord") + 1000000000, "source_file": F.concat(F.lit("v"), ((F.col("partkey") + 7) % 23).cast("string"), F.lit(".csv"))})
    return out.unionByName(again).drop("cents", "partkey")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as candidates of tracks (orders): codes damaged in several ways, prices missing or swapped, boxes by arithmetic."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    # codes are made once a part, and rows are numbered while they are narrow
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", ean("p_partkey").alias("ean"))
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long")
    code = F.col("ean")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).cast("long")
    j = li.join(p, "l_partkey").withColumn("cand", number).withColumn("cents", cents)
    cand = F.col("cand")
    bad = F.concat(F.substring(code, 1, 12), ((F.substring(code, 13, 1).cast("int") + 1) % 10).cast("string"))
    barcode = F.when(k % 7 == 0, F.substring(code, 1, 12)).when(k % 7 == 1, F.concat(code, F.lit("0"))).when(k % 7 == 2, "").when(k % 7 == 3, bad).when(k % 7 == 4, F.concat(code, F.lit(".0"))).otherwise(code)
    card = F.when(n % 4 == 0, "").when(n % 4 == 1, money_text(F.floor(F.col("cents") * 80 / 100).cast("long"), ",")).when(n % 4 == 2, money_text(F.floor(F.col("cents") * 12 / 10).cast("long"), ",")).otherwise(money_text(F.floor(F.col("cents") * 9 / 10).cast("long"), "."))
    name = F.concat_ws(" ", "p_name", "p_brand")
    date = F.date_format("l_shipdate", "dd.MM.yyyy")
    x, y = (k * 37 % 3200).cast("double"), (s * 53 % 1600).cast("double")
    return j.select(
        apart(F.col("l_orderkey")).alias("track"), cand.alias("cand"), F.col("l_quantity").alias("score"), F.concat(F.lit("v"), (F.col("l_orderkey") % 97).cast("string"), F.lit(".mp4")).alias("filename"),
        F.when(F.col("l_quantity") > 45, "").when(F.col("l_quantity") > 35, F.upper(name)).when(F.col("l_quantity") < 5, F.concat(name, F.lit(" 12.03.2026 10:20"))).otherwise(name).alias("product_name"),
        F.when(n % 5 == 0, ABSENT).otherwise(money_text(F.col("cents"), ",")).alias("price_default"), card.alias("price_card"), F.lit("").alias("price_discount"), barcode.alias("barcode"), F.when(s % 2 == 0, ABSENT).otherwise("").alias("discount_amount"),
        F.when(n % 2 == 0, F.concat(F.lit("2"), F.lpad(k.cast("string"), 11, "0"))).when(n % 3 == 0, F.concat(F.lit("37"), F.lpad(k.cast("string"), 10, "0"))).otherwise("").alias("id_sku"),
        F.when(n % 3 == 0, F.concat(date, F.lit(" 9:05"))).when(n % 3 == 1, F.concat(F.lit("at "), F.translate(date, ".", "/"), F.lit(" 23.59"))).otherwise("45.13.2026 10:00").alias("print_datetime"),
        F.when(s % 3 == 0, F.concat(F.lit("12 _ "), F.lpad((k % 1000).cast("string"), 4, "0"))).otherwise("").alias("code"), F.when(s % 4 == 0, F.concat(F.lit("info "), F.col("p_brand"))).otherwise(ABSENT).alias("additional_info"),
        F.when(F.col("l_returnflag") == "R", "red").when(F.col("l_returnflag") == "A", "yellow").otherwise("").alias("color"), F.when(s % 5 == 0, "k").when(s % 5 == 1, "Ш").otherwise("").alias("special_symbols"), (n * 250).cast("double").alias("frame_timestamp"),
        x.alias("x_min"), y.alias("y_min"), (x + 40 + F.col("l_quantity") * 5).alias("x_max"), (y + 60 + F.col("l_quantity") * 4).alias("y_max"), F.when(s % 3 == 0, code).when(s % 3 == 1, ABSENT).otherwise("").alias("qr_code_barcode"),
        F.when(s % 3 == 0, money_text(F.col("cents"), ".")).otherwise(ABSENT).alias("price1_qr"), F.lit(ABSENT).alias("price2_qr"), F.lit("").alias("price3_qr"), F.when(s % 6 == 0, money_text(F.floor(F.col("cents") * 80 / 100).cast("long"), ".")).otherwise(ABSENT).alias("price4_qr"),
        F.lit("").alias("wholesale_level_1_count"), F.lit("nan").alias("wholesale_level_1_price"), F.lit(ABSENT).alias("wholesale_level_2_count"), F.lit("").alias("wholesale_level_2_price"), F.when(n == 7, "99.90").otherwise(ABSENT).alias("action_price_qr"), F.lit("").alias("action_code_qr"),
        (F.col("l_orderkey") * 1000 + cand).alias("row_id"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detections of frames (orders), close enough for many to overlap."""
    o = observations(spark, sf_dir)
    return o.select(F.col("track").alias("frame"), F.col("row_id").alias("det_id"), (F.col("x_min") % 200).alias("x_min"), (F.col("y_min") % 150).alias("y_min"), (F.col("x_min") % 200 + F.col("x_max") - F.col("x_min")).alias("x_max"), (F.col("y_min") % 150 + F.col("y_max") - F.col("y_min")).alias("y_max"), (F.col("score") / 50.0).alias("confidence"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: video (user), ts_ms, signature, scores."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("video"), "event_id", ms.alias("ts_ms"), F.col("value").alias("signature"), F.col("value").alias("score"), (F.col("event_id") * 7919 % 1000).cast("double").alias("qr_score"))


SQL_CHECK = "((10 - list_sum(list_transform(range(1, 13), lambda i: TRY_CAST(substr({0}, i::INT, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT::VARCHAR"
SQL_EAN = "('460' || lpad({0}::VARCHAR, 9, '0') || " + SQL_CHECK.format("('460' || lpad({0}::VARCHAR, 9, '0'))") + ")"


def sql_money(cents: str, mark: str) -> str:
    return f"(({cents}) // 100)::BIGINT::VARCHAR || '{mark}' || lpad((({cents}) % 100)::BIGINT::VARCHAR, 2, '0')"


CATALOG_SQL = f"""
catalog0 AS (
  SELECT *, floor(p_retailprice * 100 + 0.5)::BIGINT AS cents, p_partkey AS k, {SQL_EAN.format("p_partkey")} AS ean FROM part
), catalog1 AS (
  SELECT p_name || ' ' || p_brand AS product_name, '2' || lpad(k::VARCHAR, 11, '0') AS id_sku, ean AS barcode, CASE WHEN k % 5 = 0 THEN ean ELSE 'нет' END AS qr_code_barcode,
    {sql_money("cents", ",")} AS price_default, {sql_money("cents * 80 // 100", ",")} AS price_card, 'нет' AS price_discount, {sql_money("cents * 95 // 100", ".")} AS price2_qr,
    ['К', 'k', 'Ш', 'x', 'no'][(k % 5 + 1)::INT] AS special_symbols, '12_' || lpad((k % 10000)::VARCHAR, 4, '0') AS code, CASE WHEN k % 3 = 0 THEN '' ELSE '01.02.2026 9:05' END AS print_datetime,
    CASE WHEN k % 6 = 0 THEN 'nan' ELSE p_type END AS additional_info, 'v' || (k % 23)::VARCHAR || '.csv' AS source_file, k AS ord, cents, k FROM catalog0
), catalog_source AS (
  SELECT * EXCLUDE (cents, k) FROM catalog1
  UNION ALL
  SELECT * EXCLUDE (cents, k) REPLACE (substr(product_name, 1, 9) AS product_name, {sql_money("cents * 80 // 100 + 100", ",")} AS price_card, ord + 1000000000 AS ord, 'v' || ((k + 7) % 23)::VARCHAR || '.csv' AS source_file) FROM catalog1 WHERE k % 4 = 0
)"""

OBSERVATIONS_SQL = f"""
obs0 AS (
  SELECT *, {SQL_EAN.format("l_partkey")} AS ean, floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT AS cents, l_partkey AS k, l_suppkey AS s, l_linenumber AS n, p_name || ' ' || p_brand AS nm,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS cand, (l_partkey * 37 % 3200)::DOUBLE AS x, (l_suppkey * 53 % 1600)::DOUBLE AS y
  FROM lineitem JOIN part ON p_partkey = l_partkey
), observations AS (
  SELECT l_orderkey AS track, cand, l_quantity AS score, 'v' || (l_orderkey % 97)::VARCHAR || '.mp4' AS filename,
    CASE WHEN l_quantity > 45 THEN '' WHEN l_quantity > 35 THEN upper(nm) WHEN l_quantity < 5 THEN nm || ' 12.03.2026 10:20' ELSE nm END AS product_name,
    CASE WHEN n % 5 = 0 THEN 'нет' ELSE {sql_money("cents", ",")} END AS price_default,
    CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN {sql_money("cents * 80 // 100", ",")} WHEN 2 THEN {sql_money("cents * 12 // 10", ",")} ELSE {sql_money("cents * 9 // 10", ".")} END AS price_card, '' AS price_discount,
    CASE k % 7 WHEN 0 THEN substr(ean, 1, 12) WHEN 1 THEN ean || '0' WHEN 2 THEN '' WHEN 3 THEN substr(ean, 1, 12) || ((substr(ean, 13, 1)::INT + 1) % 10)::VARCHAR WHEN 4 THEN ean || '.0' ELSE ean END AS barcode,
    CASE WHEN s % 2 = 0 THEN 'нет' ELSE '' END AS discount_amount,
    CASE WHEN n % 2 = 0 THEN '2' || lpad(k::VARCHAR, 11, '0') WHEN n % 3 = 0 THEN '37' || lpad(k::VARCHAR, 10, '0') ELSE '' END AS id_sku,
    CASE n % 3 WHEN 0 THEN strftime(l_shipdate, '%d.%m.%Y') || ' 9:05' WHEN 1 THEN 'at ' || strftime(l_shipdate, '%d/%m/%Y') || ' 23.59' ELSE '45.13.2026 10:00' END AS print_datetime,
    CASE WHEN s % 3 = 0 THEN '12 _ ' || lpad((k % 1000)::VARCHAR, 4, '0') ELSE '' END AS code, CASE WHEN s % 4 = 0 THEN 'info ' || p_brand ELSE 'нет' END AS additional_info,
    CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'yellow' ELSE '' END AS color, CASE s % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'Ш' ELSE '' END AS special_symbols, (n * 250)::DOUBLE AS frame_timestamp,
    x AS x_min, y AS y_min, x + 40 + l_quantity * 5 AS x_max, y + 60 + l_quantity * 4 AS y_max, CASE s % 3 WHEN 0 THEN ean WHEN 1 THEN 'нет' ELSE '' END AS qr_code_barcode,
    CASE WHEN s % 3 = 0 THEN {sql_money("cents", ".")} ELSE 'нет' END AS price1_qr, 'нет' AS price2_qr, '' AS price3_qr, CASE WHEN s % 6 = 0 THEN {sql_money("cents * 80 // 100", ".")} ELSE 'нет' END AS price4_qr,
    '' AS wholesale_level_1_count, 'nan' AS wholesale_level_1_price, 'нет' AS wholesale_level_2_count, '' AS wholesale_level_2_price, CASE WHEN n = 7 THEN '99.90' ELSE 'нет' END AS action_price_qr, '' AS action_code_qr,
    l_orderkey * 1000 + cand AS row_id
  FROM obs0
)"""

DETECTIONS_SQL = """
detections AS (
  SELECT track AS frame, row_id AS det_id, x_min % 200 AS x_min, y_min % 150 AS y_min, x_min % 200 + x_max - x_min AS x_max, y_min % 150 + y_max - y_min AS y_max, score / 50.0 AS confidence FROM observations
)"""

FRAMES_SQL = """
frames AS (
  SELECT user_id AS video, event_id, epoch_us(ts) // 1000 AS ts_ms, value AS signature, value AS score, (event_id * 7919 % 1000)::DOUBLE AS qr_score FROM events
)"""


def sql_digits(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return f"regexp_replace(CASE WHEN lower({t}) IN ('', 'nan', 'none', 'нет') THEN '' ELSE regexp_replace({t}, '^([0-9]+)\\.0$', '\\1') END, '[^0-9]', '', 'g')"


def sql_valid(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[0-9]{{13}}') AND {SQL_CHECK.format(x)} = substr({x}, 13, 1), false)"


def sql_ean(x: str, repair: bool = False) -> str:
    """Normal EAN-13 or ''; repair: 14 digits may lose the last or the first."""
    d = sql_digits(x)
    more = f"WHEN length({d}) = 14 AND {sql_valid(f'substr({d}, 1, 13)')} THEN substr({d}, 1, 13) WHEN length({d}) = 14 AND {sql_valid(f'substr({d}, 2, 13)')} THEN substr({d}, 2, 13)" if repair else ""
    return f"(CASE WHEN {sql_valid(d)} THEN {d} {more} ELSE '' END)"


def sql_number(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST({x} AS DOUBLE) END)"


def sql_compact(x: str) -> str:
    return f"replace(regexp_replace(trim(coalesce({x}, '')), '[  ]', '', 'g'), ',', '.')"


def sql_two(v: str) -> str:
    return f"printf('%.2f', {v})"


def sql_bounded(x: str) -> str:
    n = sql_number(sql_compact(x))
    return f"(CASE WHEN {n} > 0 AND {n} <= 99999.99 THEN {n} END)"


def sql_positive(x: str) -> str:
    n = sql_number(f"replace(replace(trim(coalesce({x}, '')), ' ', ''), ',', '.')")
    return f"(CASE WHEN {n} > 0 THEN {n} END)"


def sql_sku(x: str) -> str:
    d = sql_digits(x)
    return f"(CASE WHEN regexp_full_match({d}, '2[0-9]{{11}}') THEN {d} ELSE '' END)"
