"""Profiles of tables: columns, roles, statistics, duplicates, correlations, warnings and text that reads as numbers.

Counts of distinct values come from one unpivoted (column, value) table with two levels of grouping, so hot values are summed
where they are read and no column's values meet in one task.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.sources.tables import written

ID_RATIO, ID_LEAST, CATEGORIES = 0.98, 20, 30

# Texts that read as a number (signs before or after a currency, digits with commas, up to six letters or . % /
# after), the stricter form with units of measure only, and the first number in a text.
NUMBER_LIKE = r"^\s*[+-]?\s*[$€£¥₹﷼]?\s*[+-]?\d[\d,]*(?:\.\d+)?\s*[a-zA-Z.%/]{0,6}\s*$"
UNITS_ONLY = r"(?i)^\s*[+-]?\s*[$€£¥₹﷼]?\s*[+-]?\d[\d,]*(?:\.\d+)?\s*(?:%|mi\.?|miles|km|kg|g|lbs?|ft|sqft|sqm|m2|m|hrs?|usd|sar|eur|gbp)?\s*$"
FIRST_NUMBER = r"[+-]?\d[\d,]*(?:\.\d+)?"


def named(column: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.NumericType):
        return "integer"
    return "boolean" if isinstance(t, T.BooleanType) else "string"


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _kind(f.dataType) in ("float", "integer")]


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) with values as text."""
    names = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in names])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def value_counts(df: DataFrame, columns: list[str] | None = None, apart: bool = False) -> DataFrame:
    """(column, value, n) with values as text.  ``apart`` reads each column by itself and counts its values before they become
    text, which is less work on a table of files; any other is made again for each column."""
    if not apart:
        return unpivoted(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    each = [df.groupBy(named(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "n") for c in columns or df.columns]
    return reduce(DataFrame.union, each).groupBy("column", "value").agg(F.sum("n").alias("n"))


def profile_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """column, dtype, n_rows, missing_pct, cardinality, unique_ratio (nulls in the denominator) and role of each column."""
    facts = (counts or value_counts(df)).groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.count("value").alias("cardinality"))
    kind = F.element_at(F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(_kind(f.dataType)))]), F.col("column"))
    facts = facts.withColumn("dtype", kind).withColumn("unique_ratio", F.col("cardinality") / F.col("n_rows")).withColumn("missing_pct", 100.0 * F.col("n_missing") / F.col("n_rows"))
    return facts.select("column", "dtype", "n_rows", "missing_pct", "cardinality", "unique_ratio", infer_role(F.col("dtype"), F.col("unique_ratio"), F.col("cardinality")).alias("role"))


def infer_role(dtype: Column, unique_ratio: Column, cardinality: Column) -> Column:
    """First rule that holds: datetime, float (never an id), id-like, numeric, categorical, text."""
    return (
        F.when(dtype == "datetime", "datetime").when(dtype == "float", "numeric").when((unique_ratio >= ID_RATIO) & (cardinality > ID_LEAST), "id_like")
        .when(dtype == "integer", "numeric").when(cardinality <= CATEGORIES, "categorical").otherwise("text")
    )


def _long(row: DataFrame, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """A one-row table of aggregates as a row for each column."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(n) for n, v in p.items()]) for c, p in parts.items()])).alias("s")).select("s.*")


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, mean, std (sample), min, max and bias-corrected skew, each to 4 places, in one pass."""
    names = columns or _numeric(df)
    aggs, parts = [], {}
    for k, c in enumerate(names):
        x = named(c).cast("double")
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"a{k}"), F.stddev_samp(x).alias(f"d{k}"), F.min(x).alias(f"l{k}"), F.max(x).alias(f"h{k}"), F.skewness(x).alias(f"s{k}")]
        n = F.col(f"n{k}").cast("double")
        skew = F.when(n > 2, F.col(f"s{k}") * F.sqrt(n * (n - 1)) / (n - 2))
        parts[c] = {"mean": F.round(f"a{k}", 4), "std": F.round(f"d{k}", 4), "min": F.round(f"l{k}", 4), "max": F.round(f"h{k}", 4), "skew": F.round(skew, 4)}
    return _long(df.agg(*aggs), parts)


def top_categories(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, category, pct (of non-null rows, 1 place) and rank of the ``k`` most frequent; ties by value."""
    counts = value_counts(df, columns).where("value is not null")
    whole = counts.groupBy("column").agg(F.sum("n").alias("whole"))
    # The rank limit is applied before the shuffle, so a column of many values is no burden.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).join(whole, "column").select("column", F.col("value").alias("category"), F.round(100.0 * F.col("n") / F.col("whole"), 1).alias("pct"), "rank")


def sample_values(df: DataFrame, columns: list[str] | None = None, n: int = 3) -> DataFrame:
    """column, rank and value: the ``n`` smallest distinct values as text."""
    distinct = value_counts(df, columns).where("value is not null")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= n).select("column", "rank", "value")


def duplicate_rows(df: DataFrame, few: bool = False) -> DataFrame:
    """One row: n_duplicates, the rows that repeat an earlier one (nulls equal).

    Where ``few`` rows are expected to be equal, hashes are counted first, and only rows whose hash is there again are compared.
    """
    if few:
        code = F.xxhash64(*map(named, df.columns))
        again = written(df.groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_code"), "again")
        df = df.join(again, code == F.col("_code"), "left_semi")
    return df.groupBy(*map(named, df.columns)).agg(F.count(F.lit(1)).alias("count")).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def overall_missing_pct(df: DataFrame) -> DataFrame:
    """One row: mean over columns of the share of missing values, in percent."""
    shares = [F.avg(named(c).isNull().cast("double")) for c in df.columns]
    return df.agg((100 * reduce(lambda a, b: a + b, shares) / len(shares)).alias("missing_pct"))


def target_correlations(df: DataFrame, target: str, k: int = 8) -> DataFrame:
    """column, corr (3 places) and rank: Pearson with the target over rows that have both, largest in size first."""
    names = [c for c in _numeric(df) if c != target]
    row = df.agg(*[F.corr(named(c).cast("double"), named(target).cast("double")).alias(f"r{i}") for i, c in enumerate(names)])
    long = _long(row, {c: {"raw": F.col(f"r{i}")} for i, c in enumerate(names)}).where("raw is not null and not isnan(raw)")
    order = Window.orderBy(F.desc(F.abs("raw")), "column")  # a row for each column
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", F.round("raw", 3).alias("corr"), "rank")


def infer_target(df: DataFrame) -> str:
    """The last numeric column, else the last column."""
    return (_numeric(df) or df.columns)[-1]


def infer_task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: task; text and few-valued targets (15 at most, under 5 % of rows) are classes."""
    text = _kind(df.schema[target].dataType) in ("string", "boolean")
    facts = df.groupBy(named(target).alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count("t").alias("values"))
    few = (F.col("values") <= 15) & (F.col("values") / F.col("rows") < 0.05)
    return facts.select(F.when(F.lit(text) | few, "classification").otherwise("regression").alias("task"))


def profile_warnings(df: DataFrame) -> DataFrame:
    """One row: warnings, of few rows, many missing values and repeated rows."""
    facts = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(overall_missing_pct(df)).crossJoin(duplicate_rows(df))  # one row each
    return facts.select(F.array_compact(F.array(F.when(F.col("n") < 50, "fewer than 50 rows"), F.when(F.col("missing_pct") > 30, "over 30 % of values are missing"), F.when(F.col("n_duplicates") > 0, F.concat(F.col("n_duplicates").cast("string"), F.lit(" repeated rows"))))).alias("warnings"))


def parse_number(x: Column) -> Column:
    """The first signed number in a text, commas removed; null without a digit."""
    return F.replace(F.regexp_extract(x, FIRST_NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_like(df: DataFrame, min_ratio: float = 0.9, pattern: str = NUMBER_LIKE, keep: Collection[str] = ()) -> list[str]:
    """Text columns, but those of ``keep``, of which ``min_ratio`` of the non-null values read as numbers; one pass decides for all."""
    names = [c for c in _texts(df) if c not in keep]
    if not names:
        return []
    share = df.agg(*[F.avg(named(c).rlike(pattern).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if (share[f"s{i}"] or 0) >= min_ratio]


def coerce_numeric_like(df: DataFrame, min_ratio: float = 0.9, pattern: str = NUMBER_LIKE, keep: Collection[str] = ()) -> DataFrame:
    """The columns that ``numeric_like`` names become doubles."""
    chosen = numeric_like(df, min_ratio, pattern, keep)
    return df.select(*[(parse_number(named(c)) if c in chosen else named(c)).alias(c) for c in df.columns]) if chosen else df


def coercion_audit(df: DataFrame, min_ratio: float = 0.9) -> DataFrame:
    """column, ratio and ratio_units (shares that match each pattern), n_unique, samples, destroyed and verdict.

    ``destroyed`` are up to four distinct values without any number in a column that is coerced.  Columns that neither
    pattern coerces are left out.
    """
    values = value_counts(df, _texts(df)).where("value is not null")
    like, strict = F.col("value").rlike(NUMBER_LIKE), F.col("value").rlike(UNITS_ONLY)
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    facts = values.groupBy("column").agg(share(like).alias("ratio"), share(strict).alias("ratio_units"), F.count(F.lit(1)).alias("n_unique"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    listed = lambda rows, n, name: rows.withColumn("_r", first).where(F.col("_r") <= n).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias(name))
    facts = facts.join(listed(values, 3, "samples"), "column", "left").join(listed(values.where(parse_number(F.col("value")).isNull()), 4, "destroyed"), "column", "left")
    now, then = F.col("ratio") >= min_ratio, F.col("ratio_units") >= min_ratio
    verdict = F.when(now & then, "genuine").when(now, "false positive").otherwise("proposal only")
    return facts.where(now | then).select("column", F.round("ratio", 4).alias("ratio"), F.round("ratio_units", 4).alias("ratio_units"), now.alias("coerced"), then.alias("coerced_units"), "n_unique", F.concat_ws(" | ", "samples").alias("samples"), F.concat_ws(" | ", F.coalesce("destroyed", F.array())).alias("destroyed"), verdict.alias("verdict"))
