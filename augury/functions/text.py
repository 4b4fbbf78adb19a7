"""Numbers and intents in texts, and reports whose numbers can be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that are dates or times of a day, and number tokens.
DATES = r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}/\d{1,2}/\d{1,2}\b"
NUMBERS = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"

# Intents in order, each with the patterns that tell it (English and Arabic).  The Arabic verb for "predict" alone
# does not tell a forecast.
INTENTS = {
    "forecast": [
        r"\bforecast\b", r"\btime series\b", r"\btrend\b", r"\bover time\b", r"\bnext (month|year|week|quarter|day|\d+)\b", r"\bfuture\b", r"\bprojection\b", r"\bcoming (months?|years?|weeks?)\b",
        "فوركاست", "سلسلة زمنية", "مستقبلي", "المستقبل", "القادم", "القادمة", "الجاي", "الأشهر", "الاشهر", "اتجاه",
    ],
    "explanation": [
        r"\bwhy\b", r"\bexplain\b", r"\bhow does\b", r"\breport\b", r"\bsummar", r"\bwhat (drives|affects|influences)\b", r"\bimportant features?\b", r"\binterpret\b", r"\banaly[sz]e\b", r"\bwhich (factors?|features?)\b",
        "اشرح", "لماذا", "ليش", "وش يأثر", "تقرير", "تحليل", "تفسير", "أهم العوامل", "اهم العوامل", "ملخص",
    ],
    "prediction": [
        r"\bpredict\b", r"\bestimate\b", r"\bhow much\b", r"\bclassif", r"\bwhat'?s? (is |will be )?the (price|value|cost)\b", r"\b(price|value|cost) of\b", r"\bwill (it|this|they|he|she)\b", r"\bscore\b",
        "توقع", "تنبؤ", "كم سعر", "كم راح", "احسب", "قدر", "بريديكت", "تصنيف", "سعر",
    ],
}


def extract_numbers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, place, token and value of every number in a text once dates are taken out."""
    bare = F.regexp_replace(F.col(text), DATES, " ")
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(bare, F.lit(f"({NUMBERS})"), F.lit(1))).alias("place", "token"))
    return found.withColumn("value", F.replace("token", F.lit(","), F.lit("")).try_cast("double"))


def skipped_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({DATES})"), F.lit(1))


def validate_numbers(texts: DataFrame, grounded: DataFrame, keys: list[str], text: str, tolerance: float = 0.02) -> DataFrame:
    """keys, n_numbers, n_ungrounded, ungrounded and verdict: is every number near one that its result has?

    ``grounded`` has the keys and value.  The numbers of a result are few, so they go to its texts as one array.
    """
    allowed = grounded.groupBy(*keys).agg(F.collect_set("value").alias("_allowed"))
    near = F.exists("_allowed", lambda a: (a == F.col("value")) | (F.abs(a - F.col("value")) / F.greatest(F.abs(a), F.abs(F.col("value")), F.lit(1e-9)) <= tolerance))
    found = extract_numbers(texts, keys, text).join(allowed, keys, "left").withColumn("_ok", F.coalesce(near, F.lit(False)))
    seen = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_numbers"), F.count_if(~F.col("_ok")).alias("n_ungrounded"), F.concat_ws(", ", F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("token"))))).alias("ungrounded"))
    all_texts = texts.select(*keys).distinct().join(seen, keys, "left").fillna({"n_numbers": 0, "n_ungrounded": 0, "ungrounded": ""})
    return all_texts.withColumn("verdict", F.when(F.col("n_ungrounded") == 0, "VERIFIED").otherwise("UNVERIFIED"))


def validate_many(values: DataFrame, grounded: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """``values`` (keys, value) with grounded: as above for large sets of allowed numbers, by an equi-join on log buckets.

    A bucket is wider than the tolerance, so a near number is in the same bucket or the next; zero has a bucket of its own.
    """
    width = float(tolerance * 1.05)

    def bucket(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-9, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs(v)) / F.lit(width)))

    rows = values.select(*keys, "value").distinct()
    sought = rows.withColumn("_b", F.explode(F.array(*[bucket(F.col("value")) + k for k in (-1, 0, 1)])))
    offers = grounded.select(*keys, F.col("value").alias("_offer"), bucket(F.col("value")).alias("_b")).distinct()
    near = (F.col("_offer") == F.col("value")) | (F.abs(F.col("_offer") - F.col("value")) / F.greatest(F.abs("_offer"), F.abs("value"), F.lit(1e-9)) <= tolerance)
    hit = sought.join(offers, [*keys, "_b"]).where(near).select(*keys, "value").distinct().withColumn("grounded", F.lit(True))
    return values.join(hit, [*keys, "value"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def label_intent(text: Column) -> Column:
    """The first intent whose words a lower-case message has, else ``unknown``."""
    out, low = None, F.lower(F.coalesce(text, F.lit("")))
    for name, patterns in INTENTS.items():
        told = low.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(told, name) if out is None else out.when(told, name)
    return out.otherwise("unknown")


def forecast_report(facts: DataFrame, forecast: DataFrame, keys: list[str], level: float = 0.8) -> DataFrame:
    """One row a series: sections summary, reliability, coverage, risks and gate, with figures to 4 places."""
    first = forecast.where("step = 1").select(*keys, F.round("yhat", 4).alias("_next"))
    rows = facts.join(first, keys) if keys else facts.crossJoin(first)  # one row each
    risks = F.array_compact(F.concat("warnings", F.array(F.when(F.abs(F.col("coverage") - level) > 0.15, F.lit("coverage is off its level")))))
    return rows.select(
        *keys, F.struct(F.col("_next").alias("next_value"), F.col("h").alias("horizon"), F.col("n_observed")).alias("summary"),
        F.struct(F.round("improvement_pct", 4).alias("improvement_pct"), "beats_naive", F.col("confidence"), F.col("confidence_label")).alias("reliability"),
        F.round("coverage", 4).alias("coverage"), F.when(F.size(risks) == 0, F.array(F.lit("none"))).otherwise(risks).alias("risks"), F.struct("passed", "reasons").alias("gate"),
    )


def report_markdown(report: DataFrame, keys: list[str]) -> DataFrame:
    """keys and markdown of a report, in a fixed layout."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    figure = lambda c, places: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string(f"%.{places}f", F.col(c).cast("double")))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# Forecast "), F.when(F.col("gate.passed"), "PASSED").otherwise("REJECTED")), F.concat(F.lit("- next value: "), figure("summary.next_value", 2)), F.concat(F.lit("- horizon: "), text("summary.horizon")),
        F.concat(F.lit("- improvement over naive: "), figure("reliability.improvement_pct", 2), F.lit(" %")), F.concat(F.lit("- confidence: "), text("reliability.confidence_label")), F.concat(F.lit("- coverage: "), figure("coverage", 4)),
        F.concat(F.lit("- risks: "), F.array_join("risks", "; ")),
    )
    return report.select(*keys, lines.alias("markdown"))


def grounded_numbers(facts: DataFrame, forecast: DataFrame, folds: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value (4 places): every number that a text about a result may use.

    ``facts`` may have the naive forecast's rmse and mape (naive_rmse, naive_mape) and the parts of the confidence.
    """

    def long(df: DataFrame, *values: Column) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*[v.cast("double") for v in values])).alias("value"))

    parts = [
        long(facts, F.col("h"), F.col("n_observed"), F.col("coverage"), F.round(F.col("coverage") * 100, 2), F.round(F.col("coverage") * 100, 0), F.col("confidence"), F.col("improvement_pct"), F.col("naive_mae"), *[F.col(c) for c in ("naive_rmse", "naive_mape", "confidence_gain", "confidence_coverage", "confidence_history") if c in facts.columns], F.lit(80), F.lit(0.8)),
        long(forecast, F.col("yhat"), F.col("lower"), F.col("upper")), long(folds, F.col("mae")), long(metrics, F.col("mae"), F.col("rmse"), F.col("mape")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("value is not null").withColumn("value", F.round("value", 4)).distinct()
