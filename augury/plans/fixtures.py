"""Tables that queries derive from the given ones, in Spark and as SQL: with gaps, missing values and text numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.operators import series as S
from augury.sources.tables import read_table

KEYS = ["o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", "parquet")


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue a day by order priority; every eleventh day of the year is unobserved."""
    days = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("revenue"))
    return days.withColumn("revenue", F.when(F.dayofyear("day") % 11 != 0, F.round("revenue", 2)))


DAILY = "daily AS (SELECT o_orderpriority, o_orderdate AS day, CASE WHEN dayofyear(o_orderdate) % 11 <> 0 THEN round(sum(o_totalprice), 2) END AS revenue FROM orders GROUP BY o_orderpriority, o_orderdate)"


def on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regularize(S.collapse_duplicates(daily_revenue(spark, sf_dir), KEYS, "day", "revenue"), KEYS, "D")


GRID = (
    DAILY + ", points AS (SELECT o_orderpriority, day AS ds, avg(revenue) AS y FROM daily WHERE day IS NOT NULL GROUP BY 1, 2)"
    ", stamps AS (SELECT o_orderpriority, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM points GROUP BY 1)"
    ", grid AS (SELECT s.o_orderpriority, row_number() OVER (PARTITION BY s.o_orderpriority ORDER BY s.ds) - 1 AS pos, s.ds, y FROM stamps s LEFT JOIN points p ON s.o_orderpriority = p.o_orderpriority AND s.ds = p.ds)"
)
TRIM = (
    GRID + ", ends AS (SELECT o_orderpriority, min(pos) FILTER (y IS NOT NULL) AS lo, max(pos) FILTER (y IS NOT NULL) AS hi, count(*) AS n FROM grid GROUP BY 1)"
    ", trimmed AS (SELECT g.o_orderpriority, pos - lo AS pos, ds, y, n - (hi - lo + 1) AS trimmed FROM grid g JOIN ends e ON g.o_orderpriority = e.o_orderpriority AND pos BETWEEN lo AND hi)"
)
FILLED = TRIM + ", filled AS (SELECT o_orderpriority, pos, ds, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS y, y IS NULL AS filled FROM trimmed)"


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trim_edges(on_grid(spark, sf_dir), KEYS)


def filled(spark: SparkSession, sf_dir: str, strategy: str = "ffill") -> DataFrame:
    return S.fill_gaps(trimmed(spark, sf_dir), KEYS, strategy)


def customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing prices and tags, for profiles."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string"))).alias("tag"), "o_orderdate")


PROFILED = "prof AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 13 <> 0 THEN 'C' || (o_custkey % 50) END AS tag, o_orderdate FROM orders)"


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose numbers are text, with a few that are not numbers."""
    p = table(spark, sf_dir, "part")
    cents = F.format_string("%.2f", F.col("p_retailprice"))
    return p.select("p_partkey", F.concat(F.lit("$"), cents).alias("price"), F.concat(F.col("p_size").cast("string"), F.lit(" mi.")).alias("distance"), F.when(F.col("p_partkey") % 20 == 0, "SFoyer").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("Story"))).alias("style"), F.concat(F.lit("$-1,2"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")).alias("signed"), F.concat(F.col("p_size").cast("string"), F.lit(" hrs")).alias("hours"), "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("mixed"))


TEXTS = "texts AS (SELECT p_partkey, '$' || printf('%.2f', p_retailprice) AS price, p_size || ' mi.' AS distance, CASE WHEN p_partkey % 20 = 0 THEN 'SFoyer' ELSE p_size || 'Story' END AS style, '$-1,2' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS signed, p_size || ' hrs' AS hours, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS mixed FROM part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part, a row key and missing quantities, for regression on the price."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    row = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("int").cast("string"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(row.alias("row_key"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_discount", "p_brand", F.when(F.col("l_orderkey") % 13 != 0, F.col("p_type")).alias("p_type"), "p_size", "l_shipdate", "l_extendedprice")


LINES = "rows AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INT)) AS row_key, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_discount, p_brand, CASE WHEN l_orderkey % 13 <> 0 THEN p_type END AS p_type, p_size, l_shipdate, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey), parts AS (SELECT *, substr(md5('42|' || row_key), 1, 8) >= '33333333' AS is_train FROM rows)"


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with a price that follows from their quantity, size and discount, for training."""
    return lines(spark, sf_dir).withColumn("l_extendedprice", F.coalesce("l_quantity", F.lit(25.0)) * (900 + 10 * F.col("p_size")) * (1 - F.col("l_discount")))
