"""Reading tables and writing results, fitted state and run logs."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import fields, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals doubles, so that there is one kind of missing value."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = F.col(f.name).cast("double")
    return df.withColumns(changed) if changed else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); in a temporary one where that is unset and all runs in
    one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"{tempfile.gettempdir()}/augury-shared"
    return f"{base.rstrip('/')}/augury-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what uses it does not run it again, nor does a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, format: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header (types inferred unless ``schema`` is given, which saves a pass), or any format Spark reads by name."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return normalise(reader.load(path))


def write_results(tables: dict[str, DataFrame], path: str, keys: list[str] | None = None, format: str = "parquet", mode: str = "overwrite") -> None:
    """Each table under its name, partitioned by those of ``keys`` it has; one text column is written as text."""
    for name, df in tables.items():
        if df.columns == ["markdown"]:
            df.write.mode(mode).text(f"{path}/{name}")
            continue
        writer = df.write.mode(mode).format(format)
        by = [k for k in keys or [] if k in df.columns]
        (writer.partitionBy(*by) if by else writer).save(f"{path}/{name}")


def save_fit(fit, spark: SparkSession, path: str) -> None:
    """Fitted state (a dataclass of plain values) as one JSON row, and its model, if it has one, beside it."""
    state = {f.name: getattr(fit, f.name) for f in fields(fit)} if is_dataclass(fit) else dict(fit)
    model = state.pop("model", None)
    spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").text(f"{path}/state")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def load_fit(kind, spark: SparkSession, path: str):
    """The state that ``save_fit`` wrote, as an object of ``kind``; with its model, if ``kind`` has one."""
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    if "model" in {f.name for f in fields(kind)}:
        from pyspark.ml import PipelineModel

        state["model"] = PipelineModel.load(f"{path}/model")
    return kind(**state)


LOG_SCHEMA = "stage string, action string, reason string, data string, status string, ts timestamp"


def _event(stage: str, action: str | Column, data: dict[str, Column], reason: str | Column | None = None, status: str | Column = "ok") -> list[Column]:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = F.to_json(F.struct(*[c.alias(k) for k, c in data.items()])) if data else F.lit("{}")
    return [col(stage).alias("stage"), col(action).alias("action"), col(reason).cast("string").alias("reason"), found.alias("data"), col(status).alias("status"), F.current_timestamp().alias("ts")]


def event(rows: DataFrame, stage: str, action: str | Column, data: dict[str, Column], reason: str | Column | None = None, status: str | Column = "ok") -> DataFrame:
    """Rows of a job's log, one for each row of ``rows``: ``data`` as JSON text, at the time of the query that reads it."""
    return rows.select(*_event(stage, action, data, reason, status))


def events(rows: DataFrame, of: list[tuple]) -> DataFrame:
    """The same for several events of each row, each given as the arguments of ``event``; ``rows`` is worked out once for all."""
    return rows.select(F.explode(F.array(*[F.struct(*_event(*e)) for e in of])).alias("e")).select("e.*")


def append_log(log: DataFrame, path: str) -> None:
    """Append events as JSON lines; a log is only ever added to, and each call adds files of its own."""
    log.write.mode("append").option("ignoreNullFields", False).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def run_log(spark: SparkSession, events: list[tuple]) -> DataFrame:
    """Events (stage, action, reason, data, status, ts) as an append-only table; ``data`` is JSON text."""
    return spark.createDataFrame(events, LOG_SCHEMA)


def pretty_line(stage: Column, action: Column, status: Column, reason: Column) -> Column:
    """``[stage] action [status] — reason``; a status of ok and an empty reason are left out."""
    shown = F.when(F.coalesce(status, F.lit("ok")) != "ok", F.concat(F.lit(" ["), status, F.lit("]"))).otherwise("")
    why = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" — "), reason)).otherwise("")
    return F.concat(F.lit("["), stage, F.lit("] "), action, shown, why)
