"""Regular time series from tables: time axis, grid, gaps and horizons, for many series at once.

A series table has the key columns, ``pos`` (0-based place on the grid), ``ds`` (stamp) and ``y`` (nullable).  ``keys=[]`` is a
single series.  Windows are over the keys, so one shuffle on them serves all steps; a single series, and any other if ``part`` is
given, is cut into parts of so many rows, which tasks share.  A null key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.operators.profile import named
from augury.operators.ranks import exact_quantiles, numbered
from augury.operators.scan import PART, on_keys, ordered_numbers, row_before, seen_around
from augury.sources.tables import written


# Interval of each frequency code, and the longest median gap in days that still reads as it.
INTERVALS = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR"}
GAP_DAYS = {"H": 0.5, "D": 1.5, "W": 8.0, "M": 45.0, "Q": 135.0}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")
STRATEGIES = ("none", "ffill", "linear", "zero", "mean")
MAX_PERIODS = 10_000_000


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def detect_time_columns(df: DataFrame, target: str | None = None, min_rate: float = 0.95) -> DataFrame:
    """Candidate time axes of the raw columns: name, kind, parse_rate, regularity, freq and rank (1 is best).

    Datetime columns come before texts of which ``min_rate`` parse in one of DATE_FORMATS, and these before integers without
    repeats.  One aggregate judges all columns; the spacing of each axis found takes one more.
    """
    fields = [f for f in df.schema.fields if f.name != target]
    checks: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for k, f in enumerate(fields):
        checks.append(F.count(named(f.name)).alias(f"_c{k}"))
        if isinstance(f.dataType, T.StringType):
            checks += [F.count(F.try_to_timestamp(named(f.name), F.lit(form))).alias(f"_p{k}_{j}") for j, form in enumerate(DATE_FORMATS)]
    seen = df.agg(*checks).first()
    # Distinct values of integers without nulls, from (column, value) rows, so that nothing is multiplied by the columns.
    whole = {k: named(f.name).cast("long") for k, f in enumerate(fields) if isinstance(f.dataType, T.IntegralType) and seen[f"_c{k}"] == seen["_n"] >= 3}
    distinct: dict[int, int] = {}
    if whole:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in whole.items()])).alias("p")).select("p.*")
        distinct = {r["k"]: r["n"] for r in pairs.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = []
    for k, f in enumerate(fields):
        n = seen[f"_c{k}"]
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and n:
            found.append((f.name, "datetime", 1.0, k, named(f.name).cast("timestamp")))
        elif isinstance(f.dataType, T.StringType) and n:
            rate, j = max((seen[f"_p{k}_{j}"] / n, -j) for j in range(len(DATE_FORMATS)))
            if rate >= min_rate:
                found.append((f.name, "parsed", rate, k, F.try_to_timestamp(named(f.name), F.lit(DATE_FORMATS[-j]))))
        elif isinstance(f.dataType, T.IntegralType) and n == distinct.get(k):
            found.append((f.name, "ordered_int", 1.0, k, None))
    out = []
    for name, kind, rate, place, stamp in found:
        spacing = (1.0, None) if stamp is None else tuple(frequency(df.select(stamp.alias("t")), "t", []).select("regularity", "freq").first() or (0.0, None))
        out.append((name, kind, float(rate), float(spacing[0]), spacing[1], place))
    order = {"datetime": 0, "parsed": 1, "ordered_int": 2}
    out.sort(key=lambda x: (order[x[1]], -x[2], -x[3], x[5]))
    rows = [(*x[:5], i + 1) for i, x in enumerate(out)]
    return df.sparkSession.createDataFrame(rows, "name string, kind string, parse_rate double, regularity double, freq string, rank int")


def frequency(df: DataFrame, time_col: str, keys: list[str], part: int | None = None) -> DataFrame:
    """Of each series: n_stamps (distinct), regularity (1 less the relative spread of gaps, 0 under 3 stamps) and freq.

    Perfectly even months, quarters or years are told by month differences, all else by the median gap.
    """
    stamps = df.where(named(time_col).isNotNull()).select(*keys, named(time_col).cast("timestamp").alias("t")).distinct()
    if keys:
        stamps = stamps.withColumn("before", F.lag("t").over(_over(keys).orderBy("t")))
    else:
        stamps = row_before(ordered_numbers(stamps, [F.col("t")]), "t", "before", part or PART)
    months = (F.year("t") - F.year("before")) * 12 + F.month("t") - F.month("before")
    gaps = stamps.select(*keys, ((F.unix_micros("t") - F.unix_micros("before")) / 1e6).alias("gap"), months.alias("months"), (F.dayofmonth("t") == F.dayofmonth("before")).alias("same_day"))
    sums = [F.count(F.lit(1)).alias("n_stamps"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"), F.min("months").alias("lo"), F.max("months").alias("hi"), F.coalesce(F.every("same_day"), F.lit(False)).alias("same")]
    if keys:
        facts = gaps.groupBy(*keys).agg(*sums, F.percentile("gap", F.lit(0.5)).alias("mid"))
    else:
        gaps = written(gaps, "gaps")
        facts = gaps.agg(*sums).withColumn("mid", F.lit(exact_quantiles(gaps, {"gap": F.col("gap")}, [0.5])["gap"][0]).cast("double"))
    enough = F.col("n_stamps") >= 3
    regularity = F.when(enough, 1 - F.least(F.lit(1.0), F.col("sd") / (F.col("mean") + 1e-9))).otherwise(0.0)
    ladder = F.lit(None).cast("string")
    for code, days in reversed(GAP_DAYS.items()):
        ladder = F.when(F.col("mid") <= days * 86400, code).otherwise("Y" if code == "Q" else ladder)
    even = F.when(F.col("same") & (F.col("lo") == F.col("hi")), F.when(F.col("lo") == 1, "M").when(F.col("lo") == 3, "Q").when(F.col("lo") == 12, "Y"))
    return facts.select(*keys, "n_stamps", regularity.alias("regularity"), F.when(enough, F.coalesce(even, ladder)).alias("freq"))


def validate_series(df: DataFrame, target: str, time_col: str, keys: list[str]) -> DataFrame:
    """Of each series: n_observed, status (ok / error) and error; one bad series never stops the others."""
    if target not in df.columns or time_col not in df.columns:
        raise ValueError(f"no column {target if target not in df.columns else time_col}")
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"{target} is not numeric")
    seen = df.groupBy(*keys).agg(F.count_if(F.col(time_col).isNotNull() & F.col(target).isNotNull()).alias("n_observed"))
    bad = F.col("n_observed") < 3
    return seen.withColumn("status", F.when(bad, "error").otherwise("ok")).withColumn("error", F.when(bad, "fewer than 3 observed points"))


def collapse_duplicates(df: DataFrame, keys: list[str], time_col: str, y: str) -> DataFrame:
    """keys, ds, y: mean of ``y`` at each stamp; rows without a stamp go."""
    return df.where(F.col(time_col).isNotNull()).groupBy(*keys, F.col(time_col).alias("ds")).agg(F.avg(F.col(y).cast("double")).alias("y"))


def regularize(series: DataFrame, keys: list[str], freq: str | None, align: str = "exact", max_periods: int = MAX_PERIODS) -> DataFrame:
    """keys, pos, ds, y on the grid from the first to the last stamp of each series; unobserved periods have null ``y``.

    ``align="exact"`` keeps observations that lie on the grid; ``"bucket"`` takes the mean of all in a period.  Without
    ``freq`` the stamps are kept as they are.  Series of more than ``max_periods`` periods have no grid: ``runaway_series`` names
    them.
    """
    if freq is None and not keys:
        return ordered_numbers(series.select("ds", "y"), [F.col("ds")]).select("pos", "ds", "y")
    if freq is None:
        return series.select(*keys, (F.row_number().over(_over(keys).orderBy("ds")) - 1).cast("long").alias("pos"), "ds", "y")
    step = F.expr(INTERVALS[freq])
    if align == "bucket":
        unit = {"H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[freq]
        series = series.groupBy(*keys, F.date_trunc(unit, "ds").alias("ds")).agg(F.avg("y").alias("y"))
    ends = _spans(series, keys, freq).where(F.col("periods") <= max_periods)
    grid = ends.select(*keys, F.posexplode(F.sequence(F.col("lo").cast("timestamp"), F.col("hi").cast("timestamp"), step)).alias("pos", "ds"))
    return on_keys(grid, series.withColumn("ds", F.col("ds").cast("timestamp")), keys, ("ds",), "left").select(*keys, F.col("pos").cast("long").alias("pos"), "ds", "y")


def _spans(series: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """keys, lo, hi and periods (about as many as lie between the first and the last stamp) of each series."""
    ends = series.groupBy(*keys).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    hours = (F.unix_seconds(F.col("hi").cast("timestamp")) - F.unix_seconds(F.col("lo").cast("timestamp"))) / 3600
    return ends.withColumn("periods", hours / {"H": 1, "D": 24, "W": 168, "M": 672, "Q": 2160, "Y": 8760}[freq]).where("lo is not null")


def runaway_series(series: DataFrame, keys: list[str], freq: str, max_periods: int = MAX_PERIODS) -> DataFrame:
    """keys of the series that have too many periods for their frequency."""
    return _spans(series, keys, freq).where(F.col("periods") > max_periods).select(*keys)


def stamps_of(df: DataFrame, time_col: str, min_rate: float = 0.95) -> Column | None:
    """The column as an axis: dates and integers as they are, text in the format of DATE_FORMATS that reads most of it; None if
    none reads ``min_rate`` of it, or the column is of another type."""
    kind, own = df.schema[time_col].dataType, named(time_col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)):
        return own
    if not isinstance(kind, T.StringType):
        return None
    seen = df.agg(F.count(own), *[F.count(F.try_to_timestamp(own, F.lit(form))) for form in DATE_FORMATS]).first()
    best = max(range(len(DATE_FORMATS)), key=lambda j: (seen[j + 1], -j))
    return F.try_to_timestamp(own, F.lit(DATE_FORMATS[best])) if seen[0] and seen[best + 1] / seen[0] >= min_rate else None


def integer_series(df: DataFrame, keys: list[str], axis: str, y: str) -> DataFrame:
    """keys, pos, ds, y in the order of an integer axis; rows without ``y`` go and there is no grid."""
    rows = df.where(F.col(axis).isNotNull() & F.col(y).isNotNull())
    if not keys and isinstance(rows.schema[axis].dataType, T.NumericType):
        return numbered(rows.select(F.col(axis).alias("ds"), F.col(y).cast("double").alias("y")), "ds").select("pos", "ds", "y")
    return rows.select(*keys, (F.row_number().over(_over(keys).orderBy(axis)) - 1).cast("long").alias("pos"), F.col(axis).alias("ds"), F.col(y).cast("double").alias("y"))


def _part(keys: list[str], part: int | None) -> int | None:
    return part or (None if keys else PART)


def trim_edges(series: DataFrame, keys: list[str], part: int | None = None) -> DataFrame:
    """The periods between the first and the last observed one, numbered anew; ``trimmed`` is how many went."""
    seen = F.when(F.col("y").isNotNull(), F.col("pos"))
    ends = {"_lo": F.min(seen), "_hi": F.max(seen), "_n": F.count(F.lit(1))}
    if _part(keys, part):
        marked = on_keys(series, series.groupBy(*keys).agg(*[x.alias(c) for c, x in ends.items()]), keys)
    else:
        marked = series.withColumns({c: x.over(_over(keys)) for c, x in ends.items()})
    return marked.where(F.col("pos").between(F.col("_lo"), F.col("_hi"))).select(*keys, (F.col("pos") - F.col("_lo")).alias("pos"), "ds", "y", (F.col("_n") - (F.col("_hi") - F.col("_lo") + 1)).alias("trimmed"))


def gap_runs(series: DataFrame, keys: list[str], part: int | None = None) -> DataFrame:
    """keys, start, end, length of each run of unobserved periods: those with the same last observed one before them."""
    if _part(keys, part):
        rows = seen_around(series.select(*keys, "pos", "y"), keys, _part(keys, part)).where("y is null").select(*keys, "pos", F.coalesce("p0", F.lit(-1)).alias("_island"))
    else:
        rows = series.where("y is null").select(*keys, "pos", (F.col("pos") - F.row_number().over(_over(keys).orderBy("pos"))).alias("_island"))
    return rows.groupBy(*keys, "_island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("length")).drop("_island")


def fill_gaps(series: DataFrame, keys: list[str], strategy: str, part: int | None = None) -> DataFrame:
    """``y`` filled by a strategy that the caller must name; ``filled`` marks what it gave."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    y, seen, part = F.col("y"), F.when(F.col("y").isNotNull(), F.col("pos")), _part(keys, part)
    if strategy in ("none", "zero"):
        rows = series
    elif part:
        rows = seen_around(series.select(*keys, "pos", "ds", "y"), keys, part)
    else:
        order = _over(keys).orderBy("pos")
        back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
        needed = {"ffill": ["y0"], "linear": ["y0", "y1", "p0", "p1"], "mean": ["mean"]}[strategy]
        around = {"y0": F.last("y", True).over(back), "y1": F.first("y", True).over(ahead), "p0": F.last(seen, True).over(back), "p1": F.first(seen, True).over(ahead), "mean": F.avg("y").over(_over(keys))}
        rows = series.withColumns({c: around[c] for c in needed})
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("pos") - F.col("p0")) / (F.col("p1") - F.col("p0"))
    new = {"none": y, "zero": F.lit(0.0), "ffill": F.col("y0"), "mean": F.col("mean"), "linear": line}[strategy]
    return rows.select(*keys, "pos", "ds", F.coalesce(y, new).alias("y"), (y.isNull() & new.isNotNull()).alias("filled"))


def gap_audit(trimmed: DataFrame, filled: DataFrame, keys: list[str], strategy: str, part: int | None = None) -> DataFrame:
    """Of each series: n_periods, n_observed, n_filled, n_missing, gaps, longest_gap, trimmed, strategy and warning."""
    both = trimmed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_periods"), F.count("y").alias("n_observed"), F.max("trimmed").alias("trimmed"))
    runs = gap_runs(trimmed, keys, part).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.max("length").alias("longest_gap"))
    after = filled.groupBy(*keys).agg(F.count_if("filled").alias("n_filled"), F.count_if(F.col("y").isNull()).alias("n_missing"))
    out = on_keys(on_keys(both, runs, keys, how="left"), after, keys)
    gaps, longest = F.coalesce("gaps", F.lit(0)), F.coalesce("longest_gap", F.lit(0))
    long_gap = longest >= F.greatest(F.lit(3), F.floor(F.col("n_periods") * 0.1))
    return out.select(*keys, "n_periods", "n_observed", "n_filled", "n_missing", gaps.alias("gaps"), longest.alias("longest_gap"), "trimmed", F.when(gaps == 0, "none").otherwise(strategy).alias("strategy"), F.when(long_gap & (longest > 0), "long gap").when(F.col("n_missing") > 0, "values still missing").alias("warning"))


def future_index(series: DataFrame, keys: list[str], h: Column, freq: str | None, step: int = 1) -> DataFrame:
    """keys, step, ds of the next ``h`` periods (``h`` may differ by series); integer axes go on by ``step``.

    Months are counted from the first stamp of a series, so month ends stay month ends.
    """
    ends = series.groupBy(*keys).agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"), F.count(F.lit(1)).alias("n"))
    k = F.explode(F.sequence(F.lit(1), h)).alias("step")
    if freq is None:
        return ends.select("*", k).select(*keys, "step", (F.col("_last") + F.col("step") * step).alias("ds"))
    days = {"D": 1, "W": 7}
    months = {"M": 1, "Q": 3, "Y": 12}
    rows = ends.select("*", k)
    if freq in months:
        whole = (F.col("n") - 1 + F.col("step")) * months[freq]
        stamp = F.col("_first") + F.make_ym_interval(F.lit(0), whole.cast("int"))
    elif freq in days:
        stamp = F.col("_last") + F.make_dt_interval((F.col("step") * days[freq]).cast("int"))
    else:
        stamp = F.col("_last") + F.make_dt_interval(F.lit(0), F.col("step").cast("int"))
    return rows.select(*keys, "step", stamp.alias("ds"))
