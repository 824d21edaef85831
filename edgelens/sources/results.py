"""The result log: one JSON document per model and run, newest read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from edgelens.schemas import ML_RESULTS, RESULTS
from edgelens.session import exists

LOG_COLUMNS = ML_RESULTS.fieldNames()


def document_json(model: str, fields: dict[str, Column]) -> Column:
    """JSON text of a document; fields that are not given are null."""
    schema = RESULTS[model][1]
    typed = (fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)
    return F.to_json(F.struct(*typed), {"ignoreNullFields": "false"})


def to_log(document: DataFrame, model: str, run_at: str, seq: int = 0) -> DataFrame:
    """A typed document as a log row."""
    return document.select(
        F.lit(run_at).alias("run_at"),
        F.lit(model).alias("model_name"),
        F.lit(RESULTS[model][0]).alias("result_type"),
        document_json(model, {c: F.col(c) for c in document.columns}).alias("result_json"),
        F.lit(seq).cast("bigint").alias("ingest_seq"),
    )


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("model_name").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty before the first analysis."""
    if not exists(spark, path):
        return spark.createDataFrame([], ML_RESULTS)
    return spark.read.schema(ML_RESULTS).parquet(path).select(*LOG_COLUMNS)


def next_seq(spark: SparkSession, path: str) -> int:
    """Number of the next run of analyses; it rises whatever the run times are."""
    newest = read_log(spark, path).agg(F.max("ingest_seq")).first()[0]
    return 0 if newest is None else newest + 1


def latest(log: DataFrame) -> DataFrame:
    """Newest row per model, all models in one pass."""
    newest = F.max_by(
        F.struct("run_at", "result_type", "result_json"), F.struct("run_at", "ingest_seq")
    )
    return log.groupBy("model_name").agg(newest.alias("r")).select("model_name", "r.*")


def parsed(log: DataFrame, model: str) -> DataFrame:
    """Documents of one model as typed columns."""
    schema = RESULTS[model][1]
    return (
        log.where(F.col("model_name") == model)
        .withColumn("doc", F.from_json("result_json", schema))
        .select("run_at", "doc.*")
    )


def _empty(dtype: T.DataType) -> Column:
    """The value a missing field shows: zero, no text, no list."""
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    return (F.lit("") if isinstance(dtype, T.StringType) else F.lit(0)).cast(dtype)


def default_fields(model: str) -> dict[str, Column]:
    return {f.name: _empty(f.dataType) for f in RESULTS[model][1]}


def parsed_or_default(latest_rows: DataFrame, model: str) -> DataFrame:
    """The one newest document of a model; zeros and empty lists before its first run."""
    defaults = default_fields(model)
    one = latest_rows.sparkSession.range(1).select(F.lit(model).alias("model_name"))
    found = parsed(latest_rows, model)
    shown = one.join(found.withColumn("model_name", F.lit(model)), "model_name", "left")
    return shown.select(
        F.coalesce("run_at", F.lit("")).alias("run_at"),
        *(F.coalesce(F.col(c), empty).alias(c) for c, empty in defaults.items()),
    )


def with_defaults(spark: SparkSession, log: DataFrame) -> DataFrame:
    """One row per expected model; a missing result shows zeros and no lists."""
    shown = F.array(
        *(F.struct(F.lit(m).alias("model_name"), document_json(m, default_fields(m)).alias("empty")) for m in RESULTS)
    )
    expected = spark.range(1).select(F.inline(shown))
    newest = latest(log)
    return expected.join(newest, "model_name", "left").select(
        "model_name",
        F.col("result_json").isNotNull().alias("has_result"),
        F.coalesce("result_json", "empty").alias("result_json"),
        F.coalesce("run_at", F.lit("")).alias("run_at"),
    )
