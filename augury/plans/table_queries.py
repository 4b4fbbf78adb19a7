"""Registered queries of the sources, profile, preparation and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import evaluate as V
from augury.operators import prep as C
from augury.operators import profile as P
from augury.plans import fixtures as X
from augury.sources import tables as A

COLUMNS = {"o_orderkey": "integer", "o_custkey": "integer", "price": "float", "o_orderstatus": "string", "o_orderpriority": "string", "tag": "string", "o_orderdate": "datetime"}
TRAIN = "l_extendedprice"


def _r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


def read_events(spark, sf):
    e = A.read_table(spark, f"{sf}/events.parquet", "parquet")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("value"))


def log_lines(spark, sf):
    e = X.table(spark, sf, "events")
    status = F.when(F.col("event_id") % 5 == 0, "warn").otherwise("ok")
    return e.select("event_id", A.pretty_line(F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")), status, F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("value of user "), F.col("user_id").cast("string")))).alias("line"))


def duplicated(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.unionAll(o.where("o_orderkey % 10 = 0")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))


def numeric_lines(spark, sf):
    return X.table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))).select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_extendedprice")


def split_lines(spark, sf):
    return C.split(X.lines(spark, sf), ["row_key"])


def encoded(spark, sf):
    s = C.log_target(C.trim_outliers(split_lines(spark, sf), TRAIN), TRAIN)
    fit = A.written(C.fit_target_encoding(s, ["p_brand", "p_type"], TRAIN), "means")  # each column's map and mean are read from it
    return s, fit


def apply_encoded(spark, sf):
    s, fit = encoded(spark, sf)
    return C.apply_target_encoding(s, ["p_brand", "p_type"], fit).select("row_key", _r("p_brand", 6), _r("p_type", 6))


def predicted(spark, sf):
    line = X.table(spark, sf, "lineitem")
    return line.select((F.col("l_quantity") * 1500).alias("yhat"), F.col("l_extendedprice").alias("y"))


def guessed(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.select("o_orderstatus", F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp"), "F").when(F.col("o_totalprice") > 400000, "P").otherwise("O").alias("guess"))


def importances(spark, sf):
    """Sizes of correlations of derived features with the price, and the raw column of each."""
    line = X.table(spark, sf, "lineitem")
    raw = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_shipdate__year": "l_shipdate", "l_shipdate__month": "l_shipdate", "l_linenumber": "l_linenumber"}
    seen = C.decompose_datetime(line, ["l_shipdate"])
    row = seen.agg(*[F.corr(F.col(c).cast("double"), F.col(TRAIN)).alias(c) for c in raw])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in raw])).alias("s")).select("s.*")
    return long, spark.createDataFrame(list(raw.items()), "feature string, raw string")


def raw_importance(spark, sf):
    return V.fold_importance(*importances(spark, sf))


def fact_rows(spark, sf):
    """A row for each order priority with facts like those of a trained model."""
    o = X.table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), (F.avg("o_totalprice") / 500000).alias("score"), (F.avg("o_custkey") / F.max("o_custkey")).alias("cv_mean"), (F.stddev_pop("o_custkey") / F.max("o_custkey")).alias("cv_std"), (100 * F.avg((F.col("o_orderkey") % 7 == 0).cast("double"))).alias("missing_pct"), F.count_if(F.col("o_orderkey") % 10 == 0).alias("n_duplicates"))
    return g.withColumn("task", F.when(F.col("o_orderpriority") < "3", "regression").otherwise("classification"))


FACTS = "facts AS (SELECT o_orderpriority, count(*) AS n_rows, avg(o_totalprice) / 500000 AS score, avg(o_custkey) / max(o_custkey) AS cv_mean, stddev_pop(o_custkey) / max(o_custkey) AS cv_std, 100 * avg(CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS missing_pct, count(*) FILTER (o_orderkey % 10 = 0) AS n_duplicates, CASE WHEN o_orderpriority < '3' THEN 'regression' ELSE 'classification' END AS task FROM orders GROUP BY 1)"
CORRS = "imp AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_shipdate', 'l_shipdate', 'l_linenumber']) AS raw, unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice), corr(year(l_shipdate), l_extendedprice), corr(month(l_shipdate), l_extendedprice), corr(l_linenumber, l_extendedprice)]) AS importance FROM lineitem), byraw AS (SELECT raw, sum(abs(importance)) AS importance FROM imp GROUP BY 1)"
ENCODED = X.LINES + ", q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM parts WHERE is_train), kept AS (SELECT parts.* REPLACE (ln(1 + l_extendedprice) AS l_extendedprice) FROM parts, q WHERE NOT is_train OR (l_extendedprice > lo AND l_extendedprice < hi)), means AS (SELECT 'p_brand' AS \"column\", p_brand AS category, avg(l_extendedprice) AS mean FROM kept WHERE is_train GROUP BY 2 UNION ALL SELECT 'p_type', p_type, avg(l_extendedprice) FROM kept WHERE is_train AND p_type IS NOT NULL GROUP BY 2 UNION ALL SELECT unnest(['p_brand', 'p_type']), NULL, avg(l_extendedprice) FROM kept WHERE is_train)"


def imputed(spark, sf):
    s = split_lines(spark, sf)
    fills = C.fit_imputer(s, ["l_quantity", "p_type", "p_size"])
    return C.apply_imputer(s, fills).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


def one_hot(spark, sf):
    o = X.table(spark, sf, "orders")
    values = C.vocabulary(o, "o_orderstatus", C.ONE_HOT)
    return C.apply_one_hot(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus", values)


def many_labels(spark, sf):
    """Orders with their customer, a text of very many values, as a code."""
    o = X.table(spark, sf, "orders").where("o_custkey is not null").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    return C.apply_label_encoding(o, "customer", C.fit_label_encoding(o, "customer"))


def labelled(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", "p_brand")
    return C.apply_label_encoding(p, "p_brand", C.fit_label_encoding(p, "p_brand"))


def prepared(spark, sf):
    s = split_lines(spark, sf)
    roles = {"l_quantity": "numeric", "l_discount": "numeric", "p_brand": "categorical", "p_type": "categorical", "p_size": "numeric", "l_shipdate": "datetime"}
    return s, C.fit_preparation(s, roles, {}, TRAIN, "regression", ["row_key"])


def reloaded(spark, sf):
    """The replay with a fit that was saved and loaded again."""
    return replayed(spark, sf, again=True)


def published(spark, sf):
    """Orders written by priority and read back."""
    path = A.shared_folder(spark, "published")
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    A.write_results({"orders": o}, path, keys=["o_orderpriority"])
    return A.read_table(spark, f"{path}/orders", "parquet").select(*o.columns)


def plain_names(spark, sf):
    """Customers under names with signs, white space, digits in front and twins, once these are mended."""
    c = X.table(spark, sf, "customer").toDF("cust key", "name", "[cust]key:", "1st balance", "{}")
    return c.withColumnsRenamed(C.sanitize_names(c.columns, ["name"]))


def guessed_target(spark, sf):
    """What correlates with the target that the schema of the order lines suggests."""
    line = X.table(spark, sf, "lineitem")
    target = P.infer_target(line)
    return P.target_correlations(line, target).select(F.lit(target).alias("target"), "column", "corr", "rank")


def replayed(spark, sf, again=False):
    """The fit of the order lines replayed on rows that lack a column and have new categories."""
    s, (_, fit) = prepared(spark, sf)
    if again:
        path = A.shared_folder(spark, "fit")
        A.save_fit(fit, spark, path)
        fit = A.load_fit(C.Fit, spark, path)
    new = s.where("not is_train").drop("p_size").withColumn("p_type", F.when(F.col("l_discount") > 0.05, "NEW").otherwise(F.col("p_type")))
    out = C.transform_new(new, fit, ["row_key"])
    types = sorted(c for c in fit.features if c.startswith("p_type_"))
    total = sum((F.col(c) for c in types[1:]), F.col(types[0]))
    return out.select("row_key", _r("l_quantity"), total.alias("known_types"), F.col("p_size"), F.col("l_shipdate__dow").alias("dow"))


def audit(spark, sf):
    s, (rows, fit) = prepared(spark, sf)
    return C.preparation_audit(s, rows, fit).select("rows_before", "rows_after", "train_before", "train_after", "test_before", "test_after", "train_dropped", "filled_columns")


def dropped(spark, sf):
    """Orders with a clerk's name each: the key and the name go, having a value for each row."""
    o = X.table(spark, sf, "orders").withColumn("clerk", F.concat(F.lit("C"), F.col("o_orderkey").cast("string")))
    profile = {r["column"]: r for r in P.profile_columns(o).collect()}  # a row for each column
    return C.drop_high_cardinality(o, {c: r["role"] for c, r in profile.items()}, {c: r["cardinality"] for c, r in profile.items()})


def stratified(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return C.split(o, ["o_orderkey"], stratify="o_orderstatus")


def queries() -> dict:
    prof, texts = X.customers_orders, X.text_numbers
    return {
        "read_table": read_events,
        "run_log_lines": log_lines,
        "profile_columns": lambda s, d: P.profile_columns(prof(s, d)).select("column", "dtype", "n_rows", _r("missing_pct"), "cardinality", _r("unique_ratio"), "role"),
        "numeric_stats": lambda s, d: P.numeric_stats(numeric_lines(s, d)),
        "top_categories": lambda s, d: P.top_categories(prof(s, d), ["o_orderstatus", "o_orderpriority", "tag"]),
        "sample_values": lambda s, d: P.sample_values(prof(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "tag")),
        "duplicate_rows": lambda s, d: P.duplicate_rows(duplicated(s, d)),
        "overall_missing_pct": lambda s, d: P.overall_missing_pct(prof(s, d)).select(_r("missing_pct")),
        "target_correlations": lambda s, d: P.target_correlations(numeric_lines(s, d), TRAIN),
        "infer_task_type": lambda s, d: P.infer_task_type(X.table(s, d, "lineitem"), "l_linenumber").withColumn("column", F.lit("l_linenumber")).union(P.infer_task_type(prof(s, d), "price").withColumn("column", F.lit("price"))).union(P.infer_task_type(prof(s, d), "tag").withColumn("column", F.lit("tag"))),
        "profile_warnings": lambda s, d: P.profile_warnings(duplicated(s, d)).select(F.concat_ws("; ", "warnings").alias("warnings")),
        "coerce_numeric_like": lambda s, d: P.coerce_numeric_like(texts(s, d)).select("p_partkey", "price", "distance", "style", "signed", "hours", "p_brand", "mixed"),
        "coercion_audit": lambda s, d: P.coercion_audit(texts(s, d)),
        "split_by_hash": lambda s, d: split_lines(s, d).select("row_key", "is_train"),
        "split_stratified": stratified,
        "trim_outliers": lambda s, d: C.trim_outliers(split_lines(s, d), TRAIN).groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(TRAIN), 2).alias("total")),
        "log_target": lambda s, d: C.log_target(X.table(s, d, "lineitem"), TRAIN).select("l_orderkey", "l_linenumber", _r(TRAIN, 6), F.round(F.expm1(TRAIN), 2).alias("back")),
        "decompose_datetime": lambda s, d: C.decompose_datetime(X.table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]),
        "fit_target_encoding": lambda s, d: encoded(s, d)[1].select("column", "category", _r("mean", 6)),
        "apply_target_encoding": apply_encoded,
        "impute": imputed,
        "one_hot": one_hot,
        "label_encoding": labelled,
        "label_encoding_many": many_labels,
        "transform_new": replayed,
        "load_fit": reloaded,
        "write_results": published,
        "sanitize_names": plain_names,
        "infer_target": guessed_target,
        "preparation_audit": audit,
        "regression_metrics": lambda s, d: V.regression_metrics(predicted(s, d), "y", "yhat"),
        "classification_metrics": lambda s, d: V.classification_metrics(guessed(s, d), "o_orderstatus", "guess"),
        "cv_folds": lambda s, d: X.table(s, d, "orders").select("o_orderkey", V.fold_of(["o_orderkey"], 5).alias("fold")),
        "tabular_gate": lambda s, d: V.tabular_gate(fact_rows(s, d)).select("o_orderpriority", "passed", F.concat_ws("; ", "reasons").alias("reasons")),
        "tabular_confidence": lambda s, d: V.tabular_confidence(fact_rows(s, d)).select("o_orderpriority", "confidence", "confidence_label"),
        "fold_importance": lambda s, d: raw_importance(s, d).select("raw", _r("importance", 6)),
        "select_required": lambda s, d: V.select_required(raw_importance(s, d)).select("raw", "rank", "share", "required", "covered"),
        "drop_high_cardinality": dropped,
        "field_defaults": lambda s, d: V.field_defaults(prof(s, d), ["price", "o_orderstatus", "o_orderpriority"]),
    }


def _pro(column: str, dtype: str) -> str:
    return f"SELECT '{column}' AS \"column\", '{dtype}' AS dtype, count(*) AS n_rows, count(DISTINCT {column}) AS cardinality, count(*) - count({column}) AS missing FROM prof"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, q: f"WITH {ctes} {q}"
    num = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_extendedprice": "l_extendedprice"}
    stats = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({e}), 4) AS mean, round(stddev_samp({e}), 4) AS std, round(min({e})::DOUBLE, 4) AS min, round(max({e})::DOUBLE, 4) AS max, round(skewness({e}), 4) AS skew FROM lineitem" for c, e in num.items())
    corrs = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({e}, l_extendedprice) AS raw FROM lineitem" for c, e in num.items() if c != TRAIN)
    vc = lambda cs: " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM prof WHERE {c} IS NOT NULL GROUP BY 2" for c in cs)
    dup = "dup AS (SELECT * REPLACE (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS o_orderstatus) FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)), d AS (SELECT sum(c - 1) AS n FROM (SELECT count(*) AS c FROM dup GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))"
    # Written out again, so that the library's patterns are held against others.
    number = lambda c: f"TRY_CAST(replace(regexp_extract({c}, '[+-]?[0-9][0-9,]*([.][0-9]+)?', 0), ',', '') AS DOUBLE)"
    like = r"^\s*[+-]?\s*[$€£¥₹﷼]?\s*[+-]?[0-9][0-9,]*([.][0-9]+)?\s*[a-zA-Z.%/]{0,6}\s*$"
    units = r"^\s*[+-]?\s*[$€£¥₹﷼]?\s*[+-]?[0-9][0-9,]*([.][0-9]+)?\s*(%|mi|mi[.]|miles|km|kg|g|lb|lbs|ft|sqft|sqm|m2|m|hr|hrs|usd|sar|eur|gbp)?\s*$"
    tcols = ["price", "distance", "style", "signed", "hours", "p_brand", "mixed"]
    tv = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM texts WHERE {c} IS NOT NULL GROUP BY 2" for c in tcols)
    return {
        "read_table": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS value FROM events GROUP BY 1",
        "run_log_lines": "SELECT event_id, '[' || event_type || '] user ' || user_id || CASE WHEN event_id % 5 = 0 THEN ' [warn]' ELSE '' END || CASE WHEN event_id % 3 <> 0 THEN ' — value of user ' || user_id ELSE '' END AS line FROM events",
        "profile_columns": w(X.PROFILED + ", p AS (" + " UNION ALL ".join(_pro(c, k) for c, k in COLUMNS.items()) + ")", "SELECT \"column\", dtype, n_rows, round(100.0::DOUBLE * missing / n_rows, 4) AS missing_pct, cardinality, round(cardinality / n_rows, 4) AS unique_ratio, CASE WHEN dtype = 'datetime' THEN 'datetime' WHEN dtype = 'float' THEN 'numeric' WHEN cardinality / n_rows >= 0.98 AND cardinality > 20 THEN 'id_like' WHEN dtype = 'integer' THEN 'numeric' WHEN cardinality <= 30 THEN 'categorical' ELSE 'text' END AS role FROM p"),
        "numeric_stats": stats,
        "top_categories": w(X.PROFILED + f", v AS ({vc(['o_orderstatus', 'o_orderpriority', 'tag'])})", "SELECT * FROM (SELECT \"column\", value AS category, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY \"column\"), 1) AS pct, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM v) WHERE rank <= 5"),
        "sample_values": w(X.PROFILED + f", v AS ({vc(['o_orderkey', 'o_orderstatus', 'o_orderpriority', 'tag'])})", "SELECT * FROM (SELECT \"column\", row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS rank, value FROM v) WHERE rank <= 3"),
        "duplicate_rows": w(dup, "SELECT n AS n_duplicates FROM d"),
        "overall_missing_pct": w(X.PROFILED, "SELECT round(100 * (" + " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)" for c in COLUMNS) + f") / {len(COLUMNS)}, 4) AS missing_pct FROM prof"),
        "target_correlations": f"SELECT \"column\", round(raw, 3) AS corr, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(raw) DESC, \"column\") AS rank FROM ({corrs}) WHERE raw IS NOT NULL) WHERE rank <= 8",
        "infer_task_type": w(X.PROFILED, "SELECT 'l_linenumber' AS \"column\", CASE WHEN count(DISTINCT l_linenumber) <= 15 AND count(DISTINCT l_linenumber) / count(*) < 0.05 THEN 'classification' ELSE 'regression' END AS task FROM lineitem UNION ALL SELECT 'price', CASE WHEN count(DISTINCT price) <= 15 AND count(DISTINCT price) / count(*) < 0.05 THEN 'classification' ELSE 'regression' END FROM prof UNION ALL SELECT 'tag', 'classification'"),
        "profile_warnings": w(dup, "SELECT concat_ws('; ', CASE WHEN (SELECT count(*) FROM dup) < 50 THEN 'fewer than 50 rows' END, CASE WHEN (SELECT 100 * avg(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) / 6 FROM dup) > 30 THEN 'over 30 % of values are missing' END, CASE WHEN n > 0 THEN n || ' repeated rows' END) AS warnings FROM d"),
        "coerce_numeric_like": w(X.TEXTS, "SELECT p_partkey, " + ", ".join(f"{number(c)} AS {c}" if c in ("price", "distance", "style", "hours") else "CAST(-1200 - CAST(right(signed, 2) AS INT) AS DOUBLE) AS signed" if c == "signed" else c for c in tcols) + " FROM texts"),
        "coercion_audit": w(X.TEXTS + f", v AS ({tv}), f AS (SELECT \"column\", sum(CASE WHEN regexp_matches(value, '{like}') THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS ratio, sum(CASE WHEN regexp_matches(value, '{units}') THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS ratio_units, count(*) AS n_unique, array_to_string(list_sort(list(value))[1:3], ' | ') AS samples, coalesce(array_to_string(list_sort(list(value) FILTER ({number('value')} IS NULL))[1:4], ' | '), '') AS destroyed FROM v GROUP BY 1)", "SELECT \"column\", round(ratio, 4) AS ratio, round(ratio_units, 4) AS ratio_units, ratio >= 0.9 AS coerced, ratio_units >= 0.9 AS coerced_units, n_unique, samples, destroyed, CASE WHEN ratio >= 0.9 AND ratio_units >= 0.9 THEN 'genuine' WHEN ratio >= 0.9 THEN 'false positive' ELSE 'proposal only' END AS verdict FROM f WHERE ratio >= 0.9 OR ratio_units >= 0.9"),
        "split_by_hash": w(X.LINES, "SELECT row_key, is_train FROM parts"),
        "split_stratified": "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) > ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE) AS is_train FROM orders",
        "trim_outliers": w(X.LINES + ", q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM parts WHERE is_train)", "SELECT is_train, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM parts, q WHERE NOT is_train OR (l_extendedprice > lo AND l_extendedprice < hi) GROUP BY 1"),
        "log_target": "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS l_extendedprice, round(l_extendedprice, 2) AS back FROM lineitem",
        "decompose_datetime": "SELECT o_orderkey, year(o_orderdate) AS o_orderdate__year, month(o_orderdate) AS o_orderdate__month, isodow(o_orderdate) - 1 AS o_orderdate__dow FROM orders",
        "fit_target_encoding": w(ENCODED, "SELECT \"column\", category, round(mean, 6) AS mean FROM means"),
        "apply_target_encoding": w(ENCODED, "SELECT row_key, round(b.mean, 6) AS p_brand, round(coalesce(t.mean, (SELECT mean FROM means WHERE \"column\" = 'p_type' AND category IS NULL)), 6) AS p_type FROM kept LEFT JOIN means b ON b.\"column\" = 'p_brand' AND b.category = p_brand LEFT JOIN means t ON t.\"column\" = 'p_type' AND t.category = p_type"),
        "impute": w(X.LINES + ", f AS (SELECT median(l_quantity) FILTER (is_train) AS q FROM parts), m AS (SELECT p_type AS t FROM parts WHERE is_train AND p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)", "SELECT coalesce(p_type, t) AS p_type, count(*) AS n, round(sum(coalesce(l_quantity, q)), 4) AS quantity FROM parts, f, m GROUP BY 1"),
        "one_hot": "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS \"o_orderstatus_{v}\"" for v in ("F", "O", "P")) + " FROM orders",
        "label_encoding_many": "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY 'c' || o_custkey) - 1 AS INT) AS customer FROM orders WHERE o_custkey IS NOT NULL",
        "label_encoding": "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS p_brand FROM part",
        **dict.fromkeys(("transform_new", "load_fit"), w(X.LINES + ", q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM parts WHERE is_train), f AS (SELECT median(l_quantity) AS q FROM parts, q WHERE is_train AND l_extendedprice > lo AND l_extendedprice < hi)", "SELECT row_key, round(coalesce(l_quantity, f.q), 4) AS l_quantity, CASE WHEN l_discount > 0.05::DOUBLE THEN 0.0 ELSE 1.0 END AS known_types, 0.0 AS p_size, CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS dow FROM parts, f WHERE NOT is_train")),
        "write_results": "SELECT o_orderkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
        "sanitize_names": "SELECT c_custkey AS cust_key, c_name AS name, c_nationkey AS cust_key_2, c_acctbal AS f_1st_balance, c_mktsegment AS feature FROM customer",
        "infer_target": "WITH c AS (SELECT corr(l_orderkey, l_tax) AS l_orderkey, corr(l_partkey, l_tax) AS l_partkey, corr(l_suppkey, l_tax) AS l_suppkey, corr(l_linenumber, l_tax) AS l_linenumber, corr(l_quantity, l_tax) AS l_quantity, corr(l_extendedprice, l_tax) AS l_extendedprice, corr(l_discount, l_tax) AS l_discount FROM lineitem) SELECT 'l_tax' AS target, \"column\", round(raw, 3) AS corr, row_number() OVER (ORDER BY abs(raw) DESC, \"column\") AS rank FROM (UNPIVOT c ON COLUMNS(*) INTO NAME \"column\" VALUE raw)",
        "preparation_audit": w(X.LINES + ", q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM parts WHERE is_train), a AS (SELECT count(*) AS rows_before, count(*) FILTER (is_train) AS train_before, count(*) FILTER (NOT is_train) AS test_before, count(*) FILTER (NOT is_train OR (l_extendedprice > lo AND l_extendedprice < hi)) AS rows_after, count(*) FILTER (is_train AND l_extendedprice > lo AND l_extendedprice < hi) AS train_after FROM parts, q)", "SELECT rows_before, rows_after, train_before, train_after, test_before, test_before AS test_after, train_before - train_after AS train_dropped, 'l_quantity, p_type' AS filled_columns FROM a"),
        "regression_metrics": "SELECT count(*) AS n, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 4) AS r2, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae FROM lineitem",
        "classification_metrics": "WITH g AS (SELECT o_orderstatus AS l, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'F' WHEN o_totalprice > 400000 THEN 'P' ELSE 'O' END AS p FROM orders), s AS (SELECT l AS c, count(*) AS support, count(*) FILTER (l = p) AS hit FROM g GROUP BY 1), h AS (SELECT p AS c, count(*) AS guessed FROM g GROUP BY 1) SELECT sum(support) AS n, round(sum(hit)::DOUBLE / sum(support)::DOUBLE, 4) AS accuracy, round(sum(2.0::DOUBLE * hit / (support + coalesce(guessed, 0)) * support) / sum(support)::DOUBLE, 4) AS f1_weighted FROM s LEFT JOIN h ON s.c = h.c",
        "cv_folds": "SELECT o_orderkey, CAST('0x' || substr(md5('fold42|' || o_orderkey), 1, 8) AS BIGINT) % 5 AS fold FROM orders",
        "tabular_gate": w(FACTS + ", r AS (SELECT o_orderpriority, CASE WHEN task = 'regression' AND score < 0.35 THEN 'R2 is too low' WHEN task = 'classification' AND score < 0.55 THEN 'accuracy is too low' END AS a, CASE WHEN cv_mean <> 0 AND cv_std / abs(cv_mean) > 0.5 THEN 'cross-validation varies too much' END AS b FROM facts)", "SELECT o_orderpriority, a IS NULL AND b IS NULL AS passed, concat_ws('; ', a, b) AS reasons FROM r"),
        "tabular_confidence": w(FACTS + ", s AS (SELECT *, 0.5 * least(greatest(score, 0), 1) + 0.3 * (1 - least(1, cv_std / (abs(cv_mean) + 1e-6))) + 0.2 * (least(n_rows / 500, 1) + least(greatest(1 - missing_pct / 100, 0), 1) + least(greatest(1 - n_duplicates / n_rows, 0), 1)) / 3 AS c FROM facts)", "SELECT o_orderpriority, round(c, 4) AS confidence, CASE WHEN c >= 0.75 THEN 'High' WHEN c >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_label FROM s"),
        "fold_importance": w(CORRS, "SELECT raw, round(importance, 6) AS importance FROM byraw"),
        "select_required": w(CORRS, "SELECT *, round(sum(CASE WHEN required THEN importance END) OVER () / sum(importance) OVER (), 4) AS covered FROM (SELECT raw, importance, rank, round(importance / total, 4) AS share, rank <= 8 AND (before / total < 0.85 OR rank <= 3) AS required FROM (SELECT raw, importance, row_number() OVER o AS rank, sum(importance) OVER () AS total, coalesce(sum(importance) OVER (ORDER BY importance DESC, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM byraw WINDOW o AS (ORDER BY importance DESC, raw)))".replace("SELECT *, round(sum", "SELECT raw, rank, share, required, round(sum")),
        "drop_high_cardinality": "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
        "field_defaults": w(X.PROFILED, "SELECT 'o_orderstatus' AS \"column\", (SELECT o_orderstatus FROM prof GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS \"default\", (SELECT string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM prof) AS options UNION ALL SELECT 'o_orderpriority', (SELECT o_orderpriority FROM prof GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM prof) UNION ALL SELECT 'price', CAST(round(median(price), 4) AS VARCHAR), '' FROM prof"),
    }
