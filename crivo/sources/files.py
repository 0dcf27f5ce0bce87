"""File scans and sinks: portfolios, proposal uploads, audit logs, results, model metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import fixed
from crivo.operators.audit import AUDIT_SCHEMA, recent_events, retain_audit

# Header of the result file and the columns behind it.
RESULT_HEADER = (
    ("ID", "cliente_id"), ("Cliente", "nome"), ("Valor", "valor"),
    ("Risco (%)", "probabilidade_inadimplencia"), ("Score", "score_credito"),
    ("Decisão", "decisao"), ("Categoria", "risco_categoria"),
    ("Motivo Rejeição", "motivo_rejeicao"), ("Perda Evitada", "perda_evitada"),
)
METRIC_SCHEMA = (
    "model_version string, metric_name string, metric_value decimal(10,6), recorded_at timestamp"
)
ROWS_PER_FILE = 5_000_000
# Microseconds survive the text form.
LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


# --- portfolio --------------------------------------------------------------------------------
def scan_portfolio(
    spark: SparkSession, path: str, columns: Sequence[str] = ("score", "inadimplente", "ticket")
) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def scan_training(spark: SparkSession, path: str) -> DataFrame:
    """Full-width Parquet scan."""
    return spark.read.parquet(path)


def training_profile(df: DataFrame, label: str = "inadimplente") -> DataFrame:
    """Row count and label rate in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(label) * 100, 2).alias("label_rate")
    )


def write_portfolio(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet, one write per job, files of a bounded row count."""
    (
        df.write.mode(mode).option("compression", "snappy")
        .option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    )


def append_portfolio(df: DataFrame, path: str) -> None:
    """Adds a slice as new files; nothing written before is read or rewritten."""
    write_portfolio(df, path, mode="append")


# --- uploads ----------------------------------------------------------------------------------
def scan_proposals_csv(
    spark: SparkSession, path: str, columns: Sequence[str] = K.CSV_COLUMNS
) -> DataFrame:
    """Header CSV as text columns bound by name, whatever the order of the file's columns.

    A column the file lacks is NULL, other columns are ignored; files with different headers may
    share a folder. Wholly empty lines are skipped, nothing is typed.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")
    )
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("header"))
    # One row per distinct header, with the names of its files.
    kinds = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    for kind in kinds:
        rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(kind.files)
        names = {c.strip().removeprefix("\ufeff"): c for c in reversed(rows.columns)}
        out = out.unionByName(
            rows.select(
                *(
                    (F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c)
                    for c in columns
                )
            )
        )
    return out


def write_proposals_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# --- batch results ----------------------------------------------------------------------------
def format_batch_results(results: DataFrame) -> DataFrame:
    """Nine text columns: money with two digits, risk in percent with one."""
    shown = {
        "valor": fixed(F.col("valor"), 2),
        "probabilidade_inadimplencia": fixed(F.col("probabilidade_inadimplencia") * 100, 1),
        "perda_evitada": fixed(F.coalesce(F.col("perda_evitada"), F.lit(0.0)), 2),
    }
    return results.select(
        *(
            shown.get(name, F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(title)
            for title, name in RESULT_HEADER
        )
    )


def write_batch_results(results: DataFrame, path: str) -> None:
    """Result CSV with a header; fields that need quotes get them."""
    format_batch_results(results).write.mode("overwrite").option("header", True).csv(path)


# --- audit log --------------------------------------------------------------------------------
def log_rows(events: DataFrame) -> DataFrame:
    """Events as they are logged: time with its zone, and the day that names the partition."""
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn(
        "event_date", F.to_date("timestamp")
    )


def write_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines to the partition of their day (UTC).

    The rebalance hint gathers a day's rows, so a day is a few files instead of one per task, and
    lets the adaptive planner split a day that holds most of the log.
    """
    (
        log_rows(events).hint("rebalance", "event_date")
        .write.mode("append").partitionBy("event_date")
        .option("timestampFormat", LOG_TIME)
        .option("maxRecordsPerFile", ROWS_PER_FILE).json(path)
    )


def scan_audit(
    spark: SparkSession, path: str, first_day: Column | None = None,
    last_day: Column | None = None, schema: str = AUDIT_SCHEMA,
) -> DataFrame:
    """JSON-lines log between two days; malformed lines are dropped, other days are not read."""
    log = (
        spark.read.schema(f"{schema}, event_date date").option("mode", "DROPMALFORMED")
        .option("timestampFormat", LOG_TIME).json(path)
    )
    if first_day is not None:
        log = log.filter(F.col("event_date") >= first_day)
    if last_day is not None:
        log = log.filter(F.col("event_date") <= last_day)
    return log


def log_days(spark: SparkSession, path: str) -> list[str]:
    """Names of a log's day partitions, newest first and those that are no days last; no file is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (s.getPath().getName() for s in listed if s.isDirectory())
    days = [n.removeprefix("event_date=") for n in names if n.startswith("event_date=")]
    dated = [d for d in days if len(d) == 10 and d[:4].isdigit()]
    return sorted(dated, reverse=True) + sorted(set(days) - set(dated))


def scan_days(spark: SparkSession, path: str, days: Sequence[str], schema: str = AUDIT_SCHEMA) -> DataFrame:
    """The log of some of its days; the others' files are not listed."""
    return (
        spark.read.schema(f"{schema}, event_date date").option("mode", "DROPMALFORMED")
        .option("timestampFormat", LOG_TIME).option("basePath", path)
        .json([f"{path.rstrip('/')}/event_date={d}" for d in days])
    )


def recent_audit(
    spark: SparkSession, path: str, limit: int = 100, event_type: str | None = None,
    severity: str | None = None, schema: str = AUDIT_SCHEMA,
) -> DataFrame:
    """The newest events of a log by day, as ``recent_events`` orders them.

    Days are taken from the newest on, twice as many each time, until they hold ``limit`` fitting
    events; only those days are read, whatever the length of the log.
    """
    days = log_days(spark, path)
    taken = 1
    while days:
        found = recent_events(scan_days(spark, path, days[:taken], schema), limit, event_type, severity)
        if taken >= len(days) or found.count() >= limit:
            return found
        taken *= 2
    empty = spark.createDataFrame([], f"{schema}, event_date date")
    return recent_events(empty, limit, event_type, severity)


def newest_event(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> Column:
    """Time of a log's newest event, a literal; days are read from the newest on until one has rows."""
    for day in log_days(spark, path):
        newest = scan_days(spark, path, [day], schema).agg(F.max("timestamp")).first()[0]
        if newest is not None:
            return F.lit(newest).cast("timestamp")
    return F.lit(None).cast("timestamp")


def retain_log(
    spark: SparkSession, path: str, out: str, asof: Column | None = None, days: int = 90,
    schema: str = AUDIT_SCHEMA,
) -> None:
    """The surviving days of a log at ``path``, written to ``out``; without ``asof`` its newest event counts."""
    newest = newest_event(spark, path, schema) if asof is None else asof
    write_retained(scan_audit(spark, path, schema=schema), out, newest, days)


def write_retained(events: DataFrame, path: str, asof: Column | None = None, days: int = 90) -> None:
    """The surviving days of a log, written to a new location; the old one is left as it is."""
    kept = retain_audit(events, asof, days)
    (
        kept.hint("rebalance", "event_date").write.mode("errorifexists").partitionBy("event_date")
        .option("timestampFormat", LOG_TIME)
        .option("maxRecordsPerFile", ROWS_PER_FILE).json(path)
    )


# --- model metrics ----------------------------------------------------------------------------
def seed_metrics(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        list(K.SEED_METRICS), "model_version string, metric_name string, metric_value double"
    )
    return rows.select(
        "model_version", "metric_name", F.col("metric_value").cast("decimal(10,6)").alias(
            "metric_value"
        ),
        F.lit("1970-01-01 00:00:00").cast("timestamp").alias("recorded_at"),
    )


def new_model_metrics(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (version, metric name) is not in the log yet."""
    return rows.join(existing, ["model_version", "metric_name"], "left_anti")


def append_model_metrics(rows: DataFrame, path: str) -> None:
    """Insert-if-absent into the long-format metric log."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        rows = new_model_metrics(rows, spark.read.schema(METRIC_SCHEMA).parquet(path))
    rows.write.mode("append").parquet(path)
