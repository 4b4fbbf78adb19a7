"""Registered queries of text checks, reports, learned forecasts and training, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions import text as G
from augury.operators import backtest as B
from augury.operators import train as T
from augury.plans import fixtures as X
from augury.plans import jobs
from augury.plans import series_queries as SQ
from augury.sources.tables import shared_folder

K = X.KEYS


def _docs(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "text")


def _grounded(spark, sf):
    """Numbers that texts may use: for each document its size and a few fixed ones."""
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", F.explode(F.array(F.col("n_chars").cast("double"), F.lit(3.0), F.lit(555.0), F.lit(-4567.0), F.lit(2.0))).alias("value"))


def near_many(spark, sf):
    values = G.extract_numbers(_docs(spark, sf), ["doc_id"], "text").select("doc_id", "value")
    return G.validate_many(values, _grounded(spark, sf), ["doc_id"]).groupBy("grounded").agg(F.count(F.lit(1)).alias("n"))


def forecast_tables(spark, sf):
    return jobs.run_forecast(X.daily_revenue(spark, sf), "revenue", "ffill", keys=K, time_col="day", horizon=SQ.H, seasonal_period=7, frequency="D", model="seasonal_naive")


def report(spark, sf):
    out = forecast_tables(spark, sf)
    r = G.forecast_report(out["facts"], out["forecast"], K)
    return r.select(*K, F.round("summary.next_value", 2).alias("next_value"), F.col("summary.horizon").alias("horizon"), F.col("reliability.improvement_pct").alias("improvement_pct"), F.col("reliability.confidence_label").alias("confidence_label"), F.concat_ws("; ", "risks").alias("risks"), F.col("gate.passed").alias("passed"))


def markdown(spark, sf):
    out = forecast_tables(spark, sf)
    return G.report_markdown(G.forecast_report(out["facts"], out["forecast"], K), K)


# Messages and the intent that each must have.
MESSAGES = [
    ("Forecast sales", "forecast"), ("the trend, please", "forecast"), ("a trendy house, predict it", "prediction"), ("predict the next 6 months", "forecast"), ("توقع سعر البيت", "prediction"), ("القادمة", "forecast"),
    ("why did it fall", "explanation"), ("summarize the report", "explanation"), ("analyze this", "explanation"), ("which factors matter", "explanation"), ("how much is it", "prediction"), ("the price of a house", "prediction"),
    ("what's the value", "prediction"), ("will it sell", "prediction"), ("hello there", "unknown"), ("ملخص", "explanation"),
]


def intents(spark, sf):
    """Each conversation turn, its words replaced by a message that the numbers choose, before its own label."""
    c = X.table(spark, sf, "conversations")
    said = F.element_at(F.array(*[F.lit(m) for m, _ in MESSAGES]), ((F.col("conv_id") + F.col("turn")) % len(MESSAGES) + 1).cast("int"))
    return c.select("conv_id", "turn", G.label_intent(F.col("text")).alias("intent"), G.label_intent(said).alias("intent_of_message"))


def dated(spark, sf):
    """Events as texts with dates in several forms and numbers; what is left of them once dates are out."""
    e = X.table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" or "), F.date_format("ts", "dd-MM-yyyy"), F.lit(", user "), F.col("user_id").cast("string"), F.lit(" at -1,204.5 of "), F.date_format("ts", "yyyy/M/d"))
    return G.extract_numbers(e.select("event_id", text.alias("text")), ["event_id"], "text")


def grounded(spark, sf):
    out = forecast_tables(spark, sf)
    return G.grounded_numbers(out["facts"], out["forecast"], out["folds"], out["metrics"], K)


def _last_week(past, h):
    """The mean of the last seven values, a forecaster of one's own."""
    return [float(past[-7:].mean())] * h


def own_forecaster(spark, sf):
    """A registered forecaster's backtest scores and its forecast for each series."""
    B.register_forecaster("last_week", _last_week)
    f = X.filled(spark, sf)
    size = B.sizes(f, K, SQ.H)
    scores = B.backtest_metrics(B.backtest_model(f, K, B.backtest_origins(size, K), "last_week"), K)
    ahead = B.model_forecast(f, K, size, "last_week")
    return ahead.join(scores, K).select(*K, "step", F.round("yhat", 4).alias("yhat"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), "n_folds", "n_scored")


def run_forecast_auto(spark, sf):
    out = jobs.run_forecast(X.daily_revenue(spark, sf), "revenue", "linear", keys=K, time_col="day", horizon=SQ.H, frequency="D")
    return out["forecast"].select(*K, "step", "ds", "yhat", "lower", "upper", "passed", "improvement_pct")


def backtest_auto(spark, sf):
    f = X.filled(spark, sf, "linear")
    return B.backtest_metrics(B.backtest_model(f, K, B.backtest_origins(B.sizes(f, K, SQ.H), K)), K)


_trained: dict = {}


def trained(spark, sf):
    """The job with all its families and attempts; queries about one table share what it gave."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        _trained[key] = jobs.run_tabular(X.priced_lines(spark, sf), ["row_key"], "l_extendedprice")
    return _trained[key]


def train_regression(spark, sf):
    return trained(spark, sf)["facts"].select("task", "family", "score", "mae", "cv_mean", "cv_std", "passed", "confidence_label")


def tabular_log(spark, sf):
    """What the stages of the training job did, but for those whose figures only a model gives."""
    return trained(spark, sf)["log"].where("stage not in ('training', 'gate')").drop("ts")


def score_new(spark, sf):
    out = trained(spark, sf)
    return T.score(X.priced_lines(spark, sf), out["fit"], out["trained"].model, ["row_key"])


def shap(spark, sf):
    out = trained(spark, sf)
    return T.shap_importance(out["prepared"], out["fit"], out["trained"].model, shared_folder(spark, "model"))


def explanation(spark, sf):
    out = trained(spark, sf)
    return jobs.explanation_report(out["facts"], T.shap_importance(out["prepared"], out["fit"], out["trained"].model, shared_folder(spark, "model")))


def audited(spark, sf):
    out = jobs.quality_audit(X.text_numbers(spark, sf))
    return out["profile"].select("column", "dtype", "role").join(out["coercion"].select("column", "verdict"), "column", "left")


def classification(spark, sf):
    """Order status from price and date: the best family, trained until the gate passes."""
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_orderstatus")
    known = o.withColumn("o_orderstatus", F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "F").when(F.col("o_totalprice") > 400000, "P").otherwise("O"))
    out = jobs.run_tabular(known, ["o_orderkey"], "o_orderstatus")
    return out["facts"].select("task", "family", "attempts", "score", "f1_weighted", "cv_mean", "passed", "confidence_label")


def impact(spark, sf):
    """Part prices from all columns of parts, those of the texts too, under both number patterns."""
    p = X.text_numbers(spark, sf).drop("p_brand").join(X.table(spark, sf, "part"), "p_partkey")
    return jobs.coercion_impact(p, ["p_partkey"], "p_retailprice")


def queries() -> dict:
    return {
        "extract_numbers": lambda s, d: G.extract_numbers(_docs(s, d), ["doc_id"], "text"),
        "skipped_dates": lambda s, d: X.table(s, d, "events").select("event_id", F.concat_ws(",", G.skipped_dates(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" and "), F.date_format("ts", "dd/MM/yyyy"), F.lit(" "), F.col("user_id").cast("string")))).alias("dates")),
        "validate_numbers": lambda s, d: G.validate_numbers(_docs(s, d), _grounded(s, d), ["doc_id"], "text").select("doc_id", "n_numbers", "n_ungrounded", "verdict"),
        "validate_many_numbers": near_many,
        "extract_numbers_among_dates": dated,
        "label_intent": intents,
        "forecast_report": report,
        "report_markdown": markdown,
        "grounded_numbers": grounded,
        "register_forecaster": own_forecaster,
        "run_forecast_auto": run_forecast_auto,
        "backtest_auto": backtest_auto,
        "train_regression": train_regression,
        "run_tabular_log": tabular_log,
        "score_new_rows": score_new,
        "shap_importance": shap,
        "explanation_report": explanation,
        "quality_audit": audited,
        "train_classification": classification,
        "coercion_impact": impact,
    }


def oracle_sql() -> dict[str, str]:
    # Written out again, so that the library's patterns are held against others.
    dates = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\b|\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b|\b[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\b"
    numbers = r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]+)?|-?[0-9]+(?:[.][0-9]+)?"
    tokens = f"tok AS (SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS place, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '{dates}', ' ', 'g'), '{numbers}') AS t FROM documents) WHERE len(t) > 0), num AS (SELECT *, TRY_CAST(replace(token, ',', '') AS DOUBLE) AS value FROM tok)"
    ok = "ok AS (SELECT n.*, coalesce(list_bool_or([a = value OR abs(a - value) / greatest(abs(a), abs(value), 1e-9) <= 0.02::DOUBLE FOR a IN [n_chars::DOUBLE, 3.0, 555.0, -4567.0, 2.0]]), false) AS ok FROM num n JOIN documents USING (doc_id))"
    low = "lower(coalesce(text, ''))"
    intents = (
        rf"CASE WHEN regexp_matches({low}, '\b(forecast|time series|trend|over time|next (month|year|week|quarter|day|[0-9]+)|future|projection|coming (month|year|week)s?)\b|فوركاست|سلسلة زمنية|المستقبل|مستقبلي|القادم|الجاي|الأشهر|الاشهر|اتجاه') THEN 'forecast' "
        rf"WHEN regexp_matches({low}, '\b(why|explain|how does|report|what (drives|affects|influences)|important features?|interpret|analy[sz]e|which (factor|feature)s?)\b|\bsummar|اشرح|لماذا|ليش|وش يأثر|تقرير|تحليل|تفسير|أهم العوامل|اهم العوامل|ملخص') THEN 'explanation' "
        rf"WHEN regexp_matches({low}, '\b(predict|estimate|how much|what''?s? (is |will be )?the (price|value|cost)|(price|value|cost) of|will (it|this|they|he|she)|score)\b|\bclassif|توقع|تنبؤ|كم سعر|كم راح|احسب|قدر|بريديكت|تصنيف|سعر') THEN 'prediction' ELSE 'unknown' END"
    )
    spoken = "CASE (conv_id + turn) % 16 WHEN 0 THEN 'forecast' WHEN 1 THEN 'forecast' WHEN 2 THEN 'prediction' WHEN 3 THEN 'forecast' WHEN 4 THEN 'prediction' WHEN 5 THEN 'forecast' WHEN 6 THEN 'explanation' WHEN 7 THEN 'explanation' WHEN 8 THEN 'explanation' WHEN 9 THEN 'explanation' WHEN 10 THEN 'prediction' WHEN 11 THEN 'prediction' WHEN 12 THEN 'prediction' WHEN 13 THEN 'prediction' WHEN 14 THEN 'unknown' ELSE 'explanation' END"
    w = lambda ctes, q: f"WITH {ctes} {q}"
    key = "o_orderpriority"
    facts = SQ.GATED + SQ.POINT
    risks = "CASE WHEN concat_ws('; ', warnings, CASE WHEN longest > 0 AND longest >= greatest(3, floor(n_periods * 0.1)) THEN 'long gap' END, CASE WHEN abs(coverage - 0.8) > 0.15 THEN 'coverage is off its level' END) = '' THEN 'none' ELSE concat_ws('; ', nullif(warnings, ''), CASE WHEN longest > 0 AND longest >= greatest(3, floor(n_periods * 0.1)) THEN 'long gap' END, CASE WHEN abs(coverage - 0.8) > 0.15 THEN 'coverage is off its level' END) END"
    runs = ", per AS (SELECT o_orderpriority, count(*) AS n_periods FROM trimmed GROUP BY 1), runs AS (SELECT o_orderpriority, max(length) AS longest FROM (SELECT o_orderpriority, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY o_orderpriority ORDER BY pos) AS island FROM trimmed WHERE y IS NULL) GROUP BY o_orderpriority, island) GROUP BY 1)"
    result = f"[{SQ.H}::DOUBLE, n_observed::DOUBLE, coverage, round(coverage * 100, 2), round(coverage * 100, 0), confidence, improvement_pct, naive_mae, naive_rmse, naive_mape, round(least(greatest(coalesce(improvement_pct / 50, 0), 0), 1), 3), round(coalesce(greatest(0, 1 - abs(coverage - 0.8) / 0.8), 0.5), 3), round(least(n_observed / 100, 1), 3), 80.0, 0.8]"
    allowed = (
        SQ.GATED + SQ.OFFSETS[len(SQ.COVER) :] + SQ.POINT + f", nm AS (SELECT {key}, rmse AS naive_rmse, mape AS naive_mape FROM (SELECT {key}, {SQ.METRICS} FROM base GROUP BY 1)), mm AS (SELECT {key}, {SQ.METRICS} FROM season GROUP BY 1), fm AS (SELECT {key}, avg(abs(y - yhat)) AS mae FROM season GROUP BY {key}, fold), nums AS ("
        f"SELECT g.{key}, unnest({result}) AS value FROM gated g JOIN nm ON g.{key} = nm.{key} UNION ALL SELECT {key}, unnest([mae, rmse, mape]) FROM mm UNION ALL SELECT {key}, mae FROM fm "
        f"UNION ALL SELECT pt.{key}, unnest([yhat, yhat + low, yhat + high]) FROM pt JOIN off ON pt.{key} = off.{key} AND pt.step = off.step)"
    )
    week = SQ.ORIGINS + f", own AS (SELECT o.{key}, fold, a.pos, a.y, (SELECT avg(y) FROM filled b WHERE b.{key} = o.{key} AND b.pos BETWEEN o.origin - 7 AND o.origin - 1) AS yhat FROM (SELECT *, unnest(generate_series(1, h)) AS step FROM origins) o JOIN filled a ON a.{key} = o.{key} AND a.pos = origin + step - 1), om AS (SELECT {key}, {SQ.METRICS} FROM own GROUP BY 1), tails AS (SELECT {key}, max(pos) AS last FROM filled GROUP BY 1), wk AS (SELECT f.{key}, avg(y) AS yhat FROM filled f JOIN tails e ON f.{key} = e.{key} AND f.pos > e.last - 7 GROUP BY 1)"
    role = lambda c: f"CASE WHEN count(DISTINCT {c}) / count(*) >= 0.98 AND count(DISTINCT {c}) > 20 THEN 'id_like' WHEN count(DISTINCT {c}) <= 30 THEN 'categorical' ELSE 'text' END"
    numbers_as_text = "(VALUES ('price', 'genuine'), ('distance', 'genuine'), ('style', 'false positive'), ('signed', 'genuine'), ('hours', 'genuine')) AS t(name, verdict)"
    price = "coalesce(l_quantity, 25.0) * (900 + 10 * p_size) * (1 - l_discount)"
    priced = X.LINES + (
        f", priced AS (SELECT is_train, {price} AS price FROM parts), q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM priced WHERE is_train)"
        ", c AS (SELECT count(*) AS n, count(*) FILTER (is_train) AS train, count(*) FILTER (NOT is_train) AS held, count(*) FILTER (is_train AND price BETWEEN lo AND hi) AS kept FROM priced, q)"
    )
    logged = " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{action}' AS action, CAST(NULL AS VARCHAR) AS reason, {data} AS data, 'ok' AS status FROM c"
        for stage, action, data in (
            ("input", "read", """'{"n_rows":' || n || ',"n_cols":7}'"""),
            ("coercion", "text to numbers", """'{"columns":[]}'"""),
            ("target", "given", """'{"target":"l_extendedprice","task":"regression"}'"""),
            ("split", "by hash of the key", """'{"train":' || train || ',"held_out":' || held || '}'"""),
            ("preparation", "fitted on training rows", """'{"train":' || kept || ',"held_out":' || held || '}'"""),
        )
    )
    return {
        "run_tabular_log": w(priced, logged),
        "quality_audit": w(X.TEXTS, f"SELECT name AS \"column\", 'float' AS dtype, 'numeric' AS role, verdict FROM {numbers_as_text} UNION ALL SELECT 'p_brand', 'string', {role('p_brand')}, NULL FROM texts UNION ALL SELECT 'mixed', 'string', {role('mixed')}, NULL FROM texts UNION ALL SELECT 'p_partkey', 'integer', CASE WHEN count(DISTINCT p_partkey) / count(*) >= 0.98 AND count(DISTINCT p_partkey) > 20 THEN 'id_like' ELSE 'numeric' END, NULL FROM texts"),
        "grounded_numbers": w(allowed, f"SELECT DISTINCT {key}, round(value, 4) AS value FROM nums WHERE value IS NOT NULL"),
        "register_forecaster": w(week, f"SELECT wk.{key}, unnest(generate_series(1, {SQ.H})) AS step, round(wk.yhat, 4) AS yhat, round(mae, 2) AS mae, round(rmse, 2) AS rmse, n_folds, n_scored FROM wk JOIN om ON wk.{key} = om.{key}"),
        "extract_numbers": w(tokens, "SELECT doc_id, place, token, value FROM num"),
        "skipped_dates": f"SELECT event_id, array_to_string(regexp_extract_all(strftime(ts, '%Y-%m-%d') || ' and ' || strftime(ts, '%d/%m/%Y') || ' ' || user_id, '{dates}'), ',') AS dates FROM events",
        "validate_numbers": w(tokens + ", " + ok + ", s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM ok GROUP BY 1)", "SELECT doc_id, coalesce(n, 0) AS n_numbers, coalesce(bad, 0) AS n_ungrounded, CASE WHEN coalesce(bad, 0) = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict FROM documents LEFT JOIN s USING (doc_id)"),
        "validate_many_numbers": w(tokens + ", " + ok, "SELECT ok AS grounded, count(*) AS n FROM ok GROUP BY 1"),
        "extract_numbers_among_dates": "SELECT event_id, place, CASE place WHEN 0 THEN CAST(user_id AS VARCHAR) ELSE '-1,204.5' END AS token, CASE place WHEN 0 THEN user_id::DOUBLE ELSE -1204.5 END AS value FROM events, (SELECT unnest([0, 1]) AS place)",
        "label_intent": f"SELECT conv_id, turn, {intents} AS intent, {spoken} AS intent_of_message FROM conversations",
        "forecast_report": w(facts + runs, f"SELECT g.{key}, round(yhat, 2) AS next_value, {SQ.H} AS horizon, improvement_pct, {SQ.LABEL}, {risks} AS risks, passed FROM gated g JOIN pt ON g.{key} = pt.{key} AND step = 1 JOIN per ON per.{key} = g.{key} LEFT JOIN runs r ON r.{key} = g.{key}"),
        "report_markdown": w(facts + runs, f"SELECT g.{key}, '# Forecast ' || CASE WHEN passed THEN 'PASSED' ELSE 'REJECTED' END || chr(10) || '- next value: ' || printf('%.2f', yhat) || chr(10) || '- horizon: {SQ.H}' || chr(10) || '- improvement over naive: ' || coalesce(printf('%.2f', improvement_pct), 'n/a') || ' %' || chr(10) || '- confidence: ' || CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.4 THEN 'Medium' ELSE 'Low' END || chr(10) || '- coverage: ' || printf('%.4f', coverage) || chr(10) || '- risks: ' || {risks} AS markdown FROM gated g JOIN pt ON g.{key} = pt.{key} AND step = 1 JOIN per ON per.{key} = g.{key} LEFT JOIN runs r ON r.{key} = g.{key}"),
    }
