"""Rolling-origin backtests, empirical intervals, gate and confidence of forecasts, for many series at once.

Baselines are joins on (keys, pos); learned forecasters run as one grouped pandas function per series, which slices the
prefixes itself, so no prefix is copied through a shuffle.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.operators.scan import on_keys as _on

FOLDS = 5
LEVEL = 0.8
OUT_AT_ONCE = 10_000  # rows that a task gathers before it hands them on


def sizes(series: DataFrame, keys: list[str], horizon: Column | int | None = None) -> DataFrame:
    """keys, n and h (a tenth of the observed periods, at least 1, or as given)."""
    h = F.greatest(F.lit(1), F.floor(F.col("n_observed") * 0.1)) if horizon is None else horizon if isinstance(horizon, Column) else F.lit(horizon)
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_observed")).withColumn("h", h.cast("int"))


def naive(series: DataFrame, keys: list[str], h: int) -> DataFrame:
    """keys, step, yhat: the last value, repeated."""
    last = series.groupBy(*keys).agg(F.max_by("y", "pos").alias("yhat"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), "yhat")


def seasonal_naive(series: DataFrame, keys: list[str], h: int, period: int) -> DataFrame:
    """keys, step, yhat: the value a whole number of periods before; naive for histories shorter than ``period``."""
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    steps = n.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    at = F.when(F.col("n") < period, F.col("n") - 1).otherwise(F.col("n") - period + (F.col("step") - 1) % period)
    return _on(steps.withColumn("pos", at), series.select(*keys, "pos", F.col("y").alias("yhat")), keys, ("pos",)).select(*keys, "step", "yhat")


def backtest_origins(size: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """keys, fold (from 1), origin, h: distinct half-even rounded places between the least training size and n - h.

    Series too short for a fold have none.
    """
    least, last = F.greatest(F.col("h"), F.floor(F.col("n") / 2).cast("int")), F.col("n") - F.col("h")
    steps = size.withColumn("_least", least).withColumn("_last", last).where("_last > _least").select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_i"))
    origin = F.rint(F.col("_least") + F.col("_i") * (F.col("_last") - F.col("_least")) / max(1, folds - 1)).cast("long")
    found = steps.withColumn("origin", origin).where("origin between _least and _last").select(*keys, "origin", "h").distinct()
    return found.withColumn("fold", F.row_number().over(Window.partitionBy(*keys).orderBy("origin")))


def backtest_baseline(series: DataFrame, keys: list[str], origins: DataFrame, period: int | None = None) -> DataFrame:
    """keys, fold, step, pos, y, yhat of the naive (``period`` None) or seasonal-naive forecaster at each origin."""
    steps = origins.select(*keys, "fold", "origin", F.explode(F.sequence(F.lit(1), F.col("h"))).alias("step")).withColumn("pos", F.col("origin") + F.col("step") - 1)
    back = F.col("origin") - 1
    if period:
        back = F.when(F.col("origin") < period, back).otherwise(F.col("origin") - period + (F.col("step") - 1) % period)
    values = series.select(*keys, "pos", "y")
    found = _on(steps.withColumn("_back", back), values, keys, ("pos",))
    return _on(found.withColumn("_pos", F.col("pos")).drop("pos").withColumnRenamed("_back", "pos"), values.withColumnRenamed("y", "yhat"), keys, ("pos",)).select(*keys, "fold", "step", F.col("_pos").alias("pos"), "y", "yhat")


Forecaster = Callable[[np.ndarray, int], "list[float] | np.ndarray"]
_registered: dict[str, Forecaster] = {}


def register_forecaster(name: str, fn: Forecaster) -> None:
    """Make ``fn(history, h)`` available to ``backtest_model`` and ``model_forecast`` by name."""
    _registered[name] = fn


def forecaster(name: str) -> Forecaster:
    """The registered function; ``auto`` picks among small models, ``auto:D`` with the season of a frequency."""
    if name not in _registered and name.partition(":")[0] == "auto":
        from augury.functions import forecasters

        period = forecasters.SEASONS.get(name.partition(":")[2], 7)
        return lambda y, h: forecasters.auto(y, h, period)
    return _registered[name]


def _run(fn: Forecaster, history: np.ndarray, h: int) -> tuple[np.ndarray, str | None]:
    """``h`` values of a forecaster and no note; a short answer goes on with its last value, a failure gives NaN and its message."""
    try:
        out = np.asarray(fn(history, h), float)[:h]
    except Exception as e:  # whatever a caller's model raises is told, and stops no other series
        return np.full(h, np.nan), f"{type(e).__name__}: {e}"
    return np.concatenate([out, np.full(h - len(out), out[-1] if len(out) else np.nan)]), None


def _schema(series: DataFrame, keys: list[str], rest: str) -> T.StructType:
    return T.StructType([*[T.StructField(k, series.schema[k].dataType) for k in keys], *T.StructType.fromDDL(rest)])


def _beside(left: DataFrame, right: DataFrame, keys: list[str]):
    """Both tables grouped by the keys, which have names of their own on the right, as both may come from one table."""
    if not keys:
        return left.groupBy(F.lit(0).alias("_one")).cogroup(right.groupBy(F.lit(0).alias("_one")))
    theirs = {k: f"_of_{k}" for k in keys}
    return left.groupBy(*keys).cogroup(right.withColumnsRenamed(theirs).groupBy(*theirs.values()))


def _fold(fn: Forecaster, y: np.ndarray, fold: int, origin: int, h: int) -> pd.DataFrame:
    yhat, note = _run(fn, y[:origin], h)
    return pd.DataFrame({"fold": fold, "step": np.arange(1, h + 1), "pos": np.arange(origin, origin + h), "y": y[origin : origin + h], "yhat": yhat, "note": note})


def backtest_model(series: DataFrame, keys: list[str], origins: DataFrame, name: str = "auto", by_fold: bool | None = None) -> DataFrame:
    """As ``backtest_baseline`` for a registered forecaster, with note (the message of a fold that failed).

    Each series goes once to one task, which slices its prefixes, and its folds go there beside it.  ``by_fold``, the way of a
    single series, gives every fold a task of its own, to which the series goes up to the end of the fold.
    """
    fn = forecaster(name)
    schema = _schema(series, keys, "fold int, step int, pos long, y double, yhat double, note string")
    columns, rows = schema.names, series.select(*keys, "pos", "y")

    def shaped(parts: list[pd.DataFrame], of: tuple) -> pd.DataFrame:
        out = pd.concat(parts) if parts else pd.DataFrame(columns=columns)
        return out.assign(**{k: pd.Series([v] * len(out), out.index, object) for k, v in zip(keys, of, strict=False)})[columns]

    if by_fold if by_fold is not None else not keys:

        def one(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            return shaped([_fold(fn, pdf.sort_values("pos")["y"].to_numpy(float), int(first["fold"]), int(first["origin"]), int(first["h"]))], of)

        parts = _on(rows, origins, keys).where(F.col("pos") < F.col("origin") + F.col("h"))
        # Folds are ranges, so that no two of a single series meet by chance.
        return (parts if keys else parts.repartitionByRange(FOLDS, "fold")).groupBy(*keys, "fold").applyInPandas(one, schema)

    def run(of: tuple, pdf: pd.DataFrame, folds: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return shaped([], of)
        y = pdf.sort_values("pos")["y"].to_numpy(float)
        return shaped([_fold(fn, y, int(f), int(o), int(h)) for f, o, h in zip(folds["fold"], folds["origin"], folds["h"], strict=True)], of)

    return _beside(rows, origins.select(*keys, "fold", "origin", "h"), keys).applyInPandas(run, schema)


def model_forecast(series: DataFrame, keys: list[str], horizons: DataFrame, name: str = "auto") -> DataFrame:
    """keys, step, yhat and note (of a failure) of a registered forecaster fitted on the whole of each series; ``horizons`` has
    keys and h."""
    fn = forecaster(name)
    schema = _schema(series, keys, "step int, yhat double, note string")

    def run(of: tuple, pdf: pd.DataFrame, horizon: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(horizon):
            return pd.DataFrame(columns=schema.names)
        h = int(horizon["h"].iloc[0])
        yhat, note = _run(fn, pdf.sort_values("pos")["y"].to_numpy(float), h)
        out = pd.DataFrame({"step": np.arange(1, h + 1), "yhat": yhat, "note": note})
        return out.assign(**{k: pd.Series([v] * h, dtype=object) for k, v in zip(keys, of, strict=False)})[schema.names]

    return _beside(series.select(*keys, "pos", "y"), horizons.select(*keys, "h"), keys).applyInPandas(run, schema)


def failure_notes(scored: DataFrame, point: DataFrame, keys: list[str]) -> DataFrame:
    """keys, notes: what the model said where it failed, by fold, then on the whole history; series without a failure have no row."""
    folds = scored.where("note is not null").select(*keys, "fold", "note").distinct()
    last = point.where("note is not null").select(*keys, F.lit(None).cast("int").alias("fold"), "note").distinct()
    where = F.when(F.col("x.fold").isNull(), F.lit("the forecast failed: ")).otherwise(F.concat(F.lit("fold "), F.col("x.fold").cast("string"), F.lit(" failed: ")))
    listed = folds.unionByName(last).select(*keys, F.struct("fold", "note").alias("x")).select(*keys, F.struct(F.coalesce(F.col("x.fold"), F.lit(1 << 30)), F.concat(where, F.col("x.note")).alias("text")).alias("n"))
    return listed.groupBy(*keys).agg(F.sort_array(F.collect_list("n"))["text"].alias("notes"))  # a series has few folds


def backtest_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by``, mae, rmse, mape (percent; zero actuals skipped), n_folds and n_scored; pooled over points, not over folds."""
    e = F.col("y") - F.col("yhat")
    return scored.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y"))))).alias("mape"), F.count_distinct("fold").alias("n_folds"), F.count(e).alias("n_scored")
    )


def residuals_by_step(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.select(*keys, "fold", "step", (F.col("y") - F.col("yhat")).alias("residual"))


def compare_to_naive(model: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model_mae, naive_mae (and naive_rmse, naive_mape), beats_naive and improvement_pct (round 2; null if the naive error is 0)."""
    theirs = base.select(*keys, F.col("mae").alias("naive_mae"), *[F.col(c).alias(f"naive_{c}") for c in ("rmse", "mape") if c in base.columns])
    both = _on(theirs, model.select(*keys, F.col("mae").alias("model_mae")), keys, how="left")
    gain = F.when(F.col("naive_mae") != 0, F.round((F.col("naive_mae") - F.col("model_mae")) / F.col("naive_mae") * 100, 2))
    return both.select(*keys, "model_mae", *[c for c in theirs.columns if c not in keys], F.coalesce(F.col("model_mae") < F.col("naive_mae"), F.lit(False)).alias("beats_naive"), gain.alias("improvement_pct"))


def _between(ordered: list[float], share: float) -> float:
    """The quantile of sorted values, between neighbours by distance."""
    at = share * (len(ordered) - 1)
    low, high = math.floor(at), math.ceil(at)
    return ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]


def interval_offsets(residuals: DataFrame, keys: list[str], horizons: DataFrame, level: float = LEVEL) -> DataFrame:
    """keys, step, low, high: quantiles of the residuals of steps up to each step; steps before the first residual have none.

    A series has at most its folds times h residuals.  They are put in order one step after another, so time grows with the
    horizon and not with its square.  Tasks read the series one after another, in the order of their keys, as a call for each of
    very many short series would take longer than their work.
    """
    tail = (1 - level) / 2
    schema = _schema(residuals, keys, "step int, low double, high double")

    def run(batches):
        of, horizon, ordered, step, out = None, 0, [], 1, []

        def upto(end: int) -> None:
            """Rows of the open series for the steps before ``end``."""
            nonlocal step
            for k in range(step, min(end, horizon + 1)):
                if ordered and k >= 1:
                    out.append((*of[0], k, _between(ordered, tail), _between(ordered, 1 - tail)))
            step = max(step, end)

        kinds = None
        for batch in batches:
            *names, steps, values, horizons = [c.to_pylist() for c in batch.columns]
            kinds = [*[c.type for c in batch.columns[: len(keys)]], pa.int32(), pa.float64(), pa.float64()]
            for place, (s, v, h) in enumerate(zip(steps, values, horizons, strict=True)):
                key = tuple(c[place] for c in names)
                same = tuple("NaN" if x != x else (x,) for x in key)  # NaN is a key like any other
                if of is None or of[1] != same:
                    upto(horizon + 1)
                    of, horizon, ordered, step = (key, same), h, [], min(1, s)
                upto(s)
                if s <= horizon:
                    insort(ordered, v, key=lambda x: (x != x, x))  # NaN last, as in Spark
            if len(out) >= OUT_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out = []
        upto(horizon + 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    known = residuals.where("residual is not null").select(*keys, F.col("step").cast("int").alias("step"), F.col("residual").cast("double").alias("residual"))
    known = _on(known, horizons.where("h is not null").select(*keys, F.col("h").cast("int").alias("_h")), keys)
    dealt = known.repartition(*keys) if keys else known.repartition(1)
    return dealt.sortWithinPartitions(*keys, "step").mapInArrow(run, schema)


def prediction_intervals(point: DataFrame, residuals: DataFrame, keys: list[str], horizons: DataFrame, level: float = LEVEL) -> DataFrame:
    """``point`` with lower and upper; series without residuals get the forecast itself."""
    bands = _on(point, interval_offsets(residuals, keys, horizons, level), keys, ("step",), "left")
    return bands.withColumn("lower", F.col("yhat") + F.coalesce("low", F.lit(0.0))).withColumn("upper", F.col("yhat") + F.coalesce("high", F.lit(0.0))).drop("low", "high")


def interval_coverage(residuals: DataFrame, keys: list[str], level: float = LEVEL) -> DataFrame:
    """keys, coverage: share of residuals inside the pooled band; in-sample, as the band comes from the same residuals."""
    tail = (1 - level) / 2
    band = residuals.groupBy(*keys).agg(F.percentile("residual", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    inside = F.col("residual").between(F.col("_q")[0], F.col("_q")[1])
    return _on(residuals, band, keys).groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"))


def forecast_gate(facts: DataFrame, level: float = LEVEL, slack: float = 0.15) -> DataFrame:
    """Add passed, reasons (array) and warnings (array) to rows with model_mae, naive_mae and coverage."""
    no_score = F.col("model_mae").isNull()
    worse = F.col("naive_mae").isNotNull() & F.col("model_mae").isNotNull() & ~(F.col("model_mae") < F.col("naive_mae"))
    reasons = F.array_compact(F.array(F.when(no_score, "the model has no backtest score"), F.when(worse, "the model does not beat the naive baseline")))
    off = F.array_compact(F.array(F.when(F.abs(F.col("coverage") - level) > slack, "interval coverage is far from its level")))
    return facts.withColumns({"reasons": reasons, "warnings": off}).withColumn("passed", F.size("reasons") == 0)


def forecast_confidence(facts: DataFrame, level: float = LEVEL) -> DataFrame:
    """Add confidence (round 3), its three parts and confidence_label to rows with improvement_pct, coverage and n_observed."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    gain = clip(F.coalesce(F.col("improvement_pct") / 50, F.lit(0.0)))
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("coverage") - level) / level), F.lit(0.5))
    score = F.round(0.5 * gain + 0.3 * near + 0.2 * clip(F.col("n_observed") / 100), 3)
    parts = {"confidence_gain": F.round(gain, 3), "confidence_coverage": F.round(near, 3), "confidence_history": F.round(clip(F.col("n_observed") / 100), 3)}
    return facts.withColumns(parts).withColumn("confidence", score).withColumn("confidence_label", F.when(F.col("confidence") >= 0.7, "High").when(F.col("confidence") >= 0.4, "Medium").otherwise("Low"))
