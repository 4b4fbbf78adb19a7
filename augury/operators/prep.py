"""Preparation of tables for models: fitted on training rows, applied to all rows, replayed on new ones.

The split is a column ``is_train`` decided by a hash of the row key before anything is fitted.  Fitted state is plain data.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.operators.profile import value_counts
from augury.operators.ranks import exact_quantiles, modes
from augury.operators.scan import on_keys, ordered_numbers
from augury.sources.tables import written

HIGH_CARDINALITY, ONE_HOT = 200, 15
PREFIX = 4  # hex digits of a row's code that name its bucket within a class
ENDS_PREFIX = 3  # the same where only buckets that hold an end of a range are put in order


def _unit(row_key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in row_key]))


def split(df: DataFrame, row_key: list[str], test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add ``is_train``.  Plain: a threshold on the md5 of the key, without a shuffle.  Stratified: the first rows of each class
    (null is one) in md5 order are tested, rounded up, if the rarest class has two rows or more."""
    code = _unit(row_key, seed)
    if stratify is not None and (df.groupBy(stratify).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0) >= 2:
        ranged = class_ranges(df, stratify, code, lambda n: [F.ceil(n * F.lit(test_size))], "_range")
        return ranged.withColumn("is_train", F.col("_range") > 0).drop("_range")
    return df.withColumn("is_train", F.substring(code, 1, 8) >= format(int(test_size * 16**8), "08x"))


def class_places(df: DataFrame, label: str, code: Column, prefix: int = PREFIX) -> DataFrame:
    """``df`` with _place (from 1, in the order of ``code``, hex text) of a row in its class and _n, the class's rows.

    A class is cut into 16 ** ``prefix`` buckets by the first digits of the code; rows are numbered within a bucket, and the
    sizes of the class's buckets before it are added, so a class of any size, the null one too, is dealt over many tasks.
    """
    rows = df.withColumn("_code", code).withColumn("_bucket", F.substring("_code", 1, prefix))
    sizes = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    own = Window.partitionBy(label)  # a row for each bucket
    starts = sizes.select(label, "_bucket", (F.sum("_size").over(own.orderBy("_bucket")) - F.col("_size")).alias("_start"), F.sum("_size").over(own).alias("_n"))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_code"))
    return on_keys(rows.withColumn("_place", place), starts, [label], ("_bucket",)).withColumn("_place", F.col("_place") + F.col("_start")).drop("_code", "_bucket", "_start")


def class_ranges(df: DataFrame, label: str, code: Column, ends: Callable[[Column], list[Column]], name: str, prefix: int = ENDS_PREFIX) -> DataFrame:
    """``df`` with ``name``: how many of ``ends`` (places in a class, made from its number of rows) a row's place is beyond.

    Places are those of ``class_places``, but only rows whose bucket holds an end are put in order: they give the code at each end
    of each class, with which all rows are compared where they are.  Only where an end lies between equal codes are all placed.
    """
    rows = df.select(label, code.alias("_code")).withColumn("_bucket", F.substring("_code", 1, prefix))
    sizes = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    own = Window.partitionBy(label)  # a row for each bucket
    sizes = sizes.select(label, "_bucket", (F.sum("_size").over(own.orderBy("_bucket")) - F.col("_size")).alias("_start"), F.col("_size"), F.sum("_size").over(own).alias("_n"))
    places = [F.least(e, F.col("_n")) for e in ends(F.col("_n"))]
    within = lambda first, size: [(p > F.col(first)) & (p <= F.col(first) + F.col(size)) for p in places]
    held = written(sizes.where(reduce(or_, within("_start", "_size"))).drop("_size"), "ends")  # a row for each end of a class, at most
    codes = on_keys(rows, held, [label], ("_bucket",)).groupBy(label, "_bucket", "_start", "_n", "_code").agg(F.count(F.lit(1)).alias("_same"))
    before = F.sum("_same").over(Window.partitionBy(label, "_bucket").orderBy("_code")) - F.col("_same")
    codes = codes.withColumn("_before", F.col("_start") + before)
    at = [(F.when(inside, F.col("_code")), F.when(inside, F.col("_before") + F.col("_same") > p)) for inside, p in zip(within("_before", "_same"), places, strict=True)]
    cuts = written(codes.groupBy(label).agg(*[F.max(cut).alias(f"_cut{i}") for i, (cut, _) in enumerate(at)], F.max(F.greatest(*[F.coalesce(tied, F.lit(False)) for _, tied in at], F.lit(False))).alias("_tied")), "cuts")  # a row for each class
    if cuts.agg(F.max("_tied")).first()[0]:
        placed = class_places(df, label, code)
        return placed.withColumn(name, sum(((F.col("_place") > e).cast("int") for e in ends(F.col("_n"))), F.lit(0))).drop("_place", "_n")
    beyond = sum((F.coalesce(F.col("_code") > F.col(f"_cut{i}"), F.lit(True)).cast("int") for i in range(len(at))), F.lit(0))
    return on_keys(df.withColumn("_code", code), cuts.drop("_tied"), [label]).withColumn(name, beyond).drop("_code", *[f"_cut{i}" for i in range(len(at))])


def task_count(spark: SparkSession, n: int, least: int = 5_000, most: int = 500_000) -> int:
    """As many tasks for ``n`` rows as run at once, or a multiple of it, with ``least`` to ``most`` rows each."""
    at_once = spark.sparkContext.defaultParallelism
    return max(1, min(at_once, n // least)) if n <= at_once * most else -(-n // (at_once * most)) * at_once


def over_tasks(df: DataFrame, row_key: list[str]) -> DataFrame:
    """``df`` dealt over tasks by the hash of its key and in the key's order there."""
    parts = task_count(df.sparkSession, df.count())
    return df.repartition(parts, *row_key).sortWithinPartitions(*row_key) if row_key else df.repartition(parts)


def written_evenly(df: DataFrame, name: str, row_key: list[str]) -> DataFrame:
    """``df`` written once to the shared folder; once more, dealt by the hash of its key, where a task that reads it would have
    over twice its share of the rows, as with a file of one row group."""
    table = written(df, name)
    sizes = [r["n"] for r in table.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each task
    at_once = min(task_count(df.sparkSession, sum(sizes)), df.sparkSession.sparkContext.defaultParallelism)
    return table if not sizes or max(sizes) <= 2 * sum(sizes) / at_once else written(over_tasks(table, row_key), name)


def trim_outliers(df: DataFrame, target: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Training rows strictly between two quantiles of the training target; tested rows all stay."""
    low_end, high_end = exact_quantiles(df.where("is_train"), {target: F.col(target)}, [low, high])[target]
    inside = F.coalesce((F.col(target) > F.lit(low_end).cast("double")) & (F.col(target) < F.lit(high_end).cast("double")), F.lit(False))
    return df.where(~F.col("is_train") | inside)


def log_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, F.log1p(F.col(target).cast("double")))


def decompose_datetime(df: DataFrame, columns: list[str]) -> DataFrame:
    """``c__year``, ``c__month`` and ``c__dow`` (Monday is 0) in place of ``c``."""
    for c in columns:
        t = F.col(c).cast("timestamp") if not isinstance(df.schema[c].dataType, T.StringType) else F.col(c).try_cast("timestamp")
        df = df.withColumns({f"{c}__year": F.year(t), f"{c}__month": F.month(t), f"{c}__dow": F.weekday(t)}).drop(c)
    return df


def fit_target_encoding(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, category, mean) over training rows; the row with a null category is the mean of all."""
    train = df.where("is_train")
    pairs = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns])).alias("p"), F.col(target).cast("double").alias("t")).select("p.*", "t").where("category is not null")
    each = pairs.groupBy("column", "category").agg(F.avg("t").alias("mean"))
    whole = train.agg(F.avg(F.col(target).cast("double")).alias("mean")).select(F.explode(F.array(*map(F.lit, columns))).alias("column"), F.lit(None).cast("string").alias("category"), "mean")
    return each.unionByName(whole)


def apply_target_encoding(df: DataFrame, columns: list[str], fit: DataFrame) -> DataFrame:
    """Means in place of categories; unseen and missing ones get the mean of all.  The map has under 200 rows a column."""
    for c in columns:
        own = fit.where((F.col("column") == c) & F.col("category").isNotNull()).select(F.col("category").alias("_category"), F.col("mean").alias("_mean"))
        whole = F.broadcast(fit.where((F.col("column") == c) & F.col("category").isNull()).select(F.col("mean").alias("_whole")))
        df = df.join(own, F.col(c).cast("string") == F.col("_category"), "left").crossJoin(whole).withColumn(c, F.coalesce("_mean", "_whole")).drop("_category", "_mean", "_whole")  # ``whole`` is one row
    return df


def fit_imputer(df: DataFrame, columns: list[str]) -> dict[str, float | str]:
    """Fill value of each column with missing values: training median, or mode (smallest on ties)."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    missing = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in columns]).first()
    needed = [c for i, c in enumerate(columns) if missing[i + 1]]
    train = df.where("is_train")
    found = {c: v[0] for c, v in exact_quantiles(train, {c: F.col(c) for c in needed if kinds[c]}, [0.5]).items()}
    texts = [c for c in needed if not kinds[c]]
    if texts:
        found |= {r["column"]: r["mode"] for r in modes(value_counts(train, texts)).collect()}
    return {c: found[c] if found.get(c) is not None else (0.0 if kinds[c] else "unknown") for c in needed}


def apply_imputer(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double" if isinstance(v, float) else "string"), F.lit(v)) for c, v in fills.items()}) if fills else df


def vocabulary(df: DataFrame, column: str, most: int) -> list[str] | None:
    """Sorted distinct values of a column, or None if there are more than ``most``."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().limit(most + 1).collect()
    return sorted(r["v"] for r in found) if len(found) <= most else None


def apply_one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def fit_label_encoding(df: DataFrame, column: str) -> DataFrame:
    """(category, code): places in sorted order of the distinct values, however many; they are numbered by ranges."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("category")).distinct()
    return ordered_numbers(values, [F.col("category")], "code").select("category", F.col("code").cast("int").alias("code"))


def apply_label_encoding(df: DataFrame, column: str, fit: DataFrame) -> DataFrame:
    own = fit.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    return df.join(own, F.col(column).cast("string") == F.col("_category"), "left").withColumn(column, F.coalesce("_code", F.lit(-1))).drop("_category", "_code")


def sanitize_names(columns: list[str], protected: list[str] = ()) -> dict[str, str]:
    """New name of each column: signs and white space become ``_``, no digit leads, and equal names are numbered."""
    out, used = {}, set(protected)
    for c in columns:
        if c in protected:
            out[c] = c
            continue
        name = re.sub(r"""[\[\]<>{}"',:\s]+""", "_", c).strip("_") or "feature"
        name = f"f_{name}" if name[0].isdigit() else name
        k, base = 2, name
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        out[c] = name
    return out


@dataclass
class Fit:
    """Everything that preparing new rows needs."""

    target: str
    task: str
    features: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    means: dict[str, dict[str, float]] = field(default_factory=dict)
    mean_of_all: dict[str, float] = field(default_factory=dict)
    fills: dict = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    lineage: dict[str, str] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)


def _mapped(c: Column, values: dict[str, float], other: Column) -> Column:
    if not values:
        return other
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), other)


def transform_new(df: DataFrame, fit: Fit, keep: list[str] = ()) -> DataFrame:
    """Replay on any rows, streams too: dates, encodings, fills, codes, names; features that are missing are 0.

    A stateless projection: the maps are small (under 200 entries a column) and go along as literals.
    """
    missing = [c for c in {*fit.means, *fit.one_hot, *fit.labels, *fit.dates, *fit.fills} - set(df.columns) if "__" not in c]
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    df = decompose_datetime(df, fit.dates)
    out = {c: F.col(c) for c in df.columns}
    for c, values in fit.means.items():
        fallback = F.lit(float(fit.fills[c])) if c in fit.fills else F.lit(fit.mean_of_all[c])
        out[c] = _mapped(F.col(c).cast("string"), values, fallback)
    for c, v in fit.fills.items():
        if c in out and c not in fit.means:
            out[c] = F.coalesce(out[c].cast("double" if isinstance(v, float) else "string"), F.lit(v))
    for c, values in fit.labels.items():
        out[c] = _mapped(out[c].cast("string"), {v: float(i) for i, v in enumerate(values)}, F.lit(-1.0))
    for c, values in fit.one_hot.items():
        own = out.pop(c)
        out |= {f"{c}_{v}": F.coalesce((own.cast("string") == v).cast("double"), F.lit(0.0)) for v in values}
    back = {new: old for old, new in fit.names.items()}
    return df.select(*keep, *[F.coalesce(out[back[f]].cast("double"), F.lit(0.0)).alias(f) if back[f] in out else F.lit(0.0).alias(f) for f in fit.features])


def fit_preparation(df: DataFrame, roles: dict[str, str], cardinality: dict[str, int], target: str, task: str, row_key: list[str], of_files: bool = False) -> tuple[DataFrame, Fit]:
    """Fit on the training rows of a split table: the prepared rows (row key, is_train, target, features) and the fit.

    Order: trim outliers, log target, dates, target encoding, drops, fills, one-hot and labels, names.  A split table ``of_files`` is
    read from them again by each pass, column by column; the rows of any other are kept, in memory as far as it goes.
    """
    fit = Fit(target, task)
    rows = df
    if task == "regression":
        rows = log_target(trim_outliers(rows, target), target)
    else:
        codes = fit_label_encoding(rows, target)
        fit.classes = [r["category"] for r in codes.orderBy("code").collect()]  # a model holds its classes anyway
        rows = apply_label_encoding(rows, target, codes).withColumn(target, F.col(target).cast("double"))
    if not of_files:
        rows = rows.persist()  # several passes fit on these rows, and the result is made from them; what memory lacks goes to disk
    columns = [c for c in rows.columns if c not in {target, "is_train", *row_key}]
    fit.dates = [c for c in columns if roles.get(c) == "datetime"]
    encoded = [c for c in columns if roles.get(c) in ("id_like", "text") and cardinality[c] < HIGH_CARDINALITY]
    fit.dropped = [c for c in columns if roles.get(c) in ("id_like", "text") and cardinality[c] >= HIGH_CARDINALITY]
    if encoded:
        for r in fit_target_encoding(rows, encoded, target).collect():  # under 200 rows a column
            if r["category"] is None:
                fit.mean_of_all[r["column"]] = r["mean"]
            else:
                fit.means.setdefault(r["column"], {})[r["category"]] = r["mean"]
        for c in encoded:
            fit.means.setdefault(c, {})
    seen = decompose_datetime(rows.drop(*fit.dropped), fit.dates)
    for c in encoded:
        seen = seen.withColumn(c, _mapped(F.col(c).cast("string"), fit.means[c], F.when(F.col(c).isNotNull(), F.lit(fit.mean_of_all[c]))))
    inputs = [c for c in seen.columns if c not in {target, "is_train", *row_key}]
    fit.fills = fit_imputer(seen, inputs)
    raw = {c: next((d for d in fit.dates if c.startswith(f"{d}__")), c) for c in inputs}
    final: dict[str, str] = {}
    for c in inputs:
        if isinstance(seen.schema[c].dataType, (T.StringType, T.BooleanType)):
            filled = seen.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(str(fit.fills.get(c, "unknown")))))
            values = vocabulary(filled, c, ONE_HOT)
            if values is not None:
                fit.one_hot[c] = values
                final |= {f"{c}_{v}": c for v in values}
                continue
            known = vocabulary(filled, c, HIGH_CARDINALITY)
            if known is None:
                raise ValueError(f"{c} has more than {HIGH_CARDINALITY} values and no role under which it is encoded or dropped")
            fit.labels[c] = known
        final[c] = raw[c]
    fit.names = sanitize_names(list(final), [target])
    fit.features = [fit.names[c] for c in final]
    fit.lineage = {fit.names[c]: source for c, source in final.items()}
    return transform_new(rows, fit, [*row_key, "is_train", target]), fit


def drop_high_cardinality(df: DataFrame, roles: dict[str, str], cardinality: dict[str, int]) -> DataFrame:
    """Without the id-like and text columns of HIGH_CARDINALITY values or more."""
    return df.drop(*[c for c in df.columns if roles.get(c) in ("id_like", "text") and cardinality[c] >= HIGH_CARDINALITY])


def preparation_audit(before: DataFrame, after: DataFrame, fit: Fit) -> DataFrame:
    """One row: rows and columns before and after, training rows dropped, tested rows, dropped and filled columns."""
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"rows_{name}"), F.count_if("is_train").alias(f"train_{name}"), F.count_if(~F.col("is_train")).alias(f"test_{name}"))
    both = counts(before, "before").crossJoin(counts(after, "after"))  # one row each
    return both.select("*", (F.col("train_before") - F.col("train_after")).alias("train_dropped"), F.lit(len(before.columns)).alias("columns_before"), F.lit(len(fit.features)).alias("features_after"), F.lit(", ".join(sorted(fit.dropped))).alias("dropped_columns"), F.lit(", ".join(sorted(fit.fills))).alias("filled_columns"))
