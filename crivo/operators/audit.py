"""Audit events: building them, reading them back, counting and retaining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.functions.common import ColumnLike, as_col
from crivo.functions.privacy import mask_id, sanitize_map

# Activity kind -> (event type, severity); None marks a rule given below.
ACTIVITY = {
    "login_success": ("login_success", "info"),
    "login_failed": ("login_failed", "warning"),
    "authentication": (None, None),
    "prediction": ("prediction_success", None),
    "unauthorized_access": ("unauthorized_access", "error"),
    "permission_denied": ("permission_denied", "warning"),
    "rate_limit_exceeded": ("rate_limit_exceeded", "warning"),
    "drift": ("drift_detected", None),
    "system_error": ("system_error", "error"),
    "data_access": ("data_access", "info"),
    "security": ("suspicious_activity", "warning"),
    "model": ("model_loaded", "info"),
}
DEFAULT_FLAGS = {"lgpd_compliant": True, "bacen_audit": True, "pci_dss": False}
PREDICTION_FLAGS = {"lgpd_compliant": True, "bacen_audit": True, "data_masked": True}
DRIFT_FLAGS = {"lgpd_compliant": True, "bacen_audit": True, "model_risk_management": True}
STACK_TRACE_CHARS = 500
HIGH_RISK = 0.7

AUDIT_SCHEMA = (
    "timestamp timestamp, event_type string, severity string, user_id string, username string, "
    "ip_address string, details map<string,string>, compliance map<string,boolean>"
)


def _flags(values: dict[str, bool]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def prediction_severity(p: ColumnLike) -> Column:
    return F.when(as_col(p) > HIGH_RISK, "warning").otherwise("info")


def drift_severity(level: ColumnLike) -> Column:
    return F.when(as_col(level) == "medium", "warning").otherwise("critical")


def audit_from_predictions(df: DataFrame, p: str = "probability") -> DataFrame:
    """One ``prediction_success`` event per scored row (batch or stream); the client is masked."""
    details = F.create_map(
        F.lit("cliente_id"), mask_id("cliente_id"),
        F.lit("prediction"), F.col("prediction").cast("string"),
        F.lit("probability"), F.round(p, 4).cast("string"),
        F.lit("recommendation"), F.col("recommendation"),
        F.lit("model_version"), F.col("model_version"),
    )
    return df.select(
        F.col("timestamp"),
        F.lit("prediction_success").alias("event_type"),
        prediction_severity(p).alias("severity"),
        *(_optional(df, c).alias(c) for c in ("user_id", "username", "ip_address")),
        details.alias("details"),
        _flags(PREDICTION_FLAGS).alias("compliance"),
    )


def audit_from_drift(df: DataFrame) -> DataFrame:
    """Drift measurements (feature, ks_statistic, p_value, severity) as events."""
    none = F.lit(None).cast("string")
    details = F.create_map(
        F.lit("feature"), F.col("feature"),
        F.lit("ks_statistic"), F.col("ks_statistic").cast("string"),
        F.lit("p_value"), F.col("p_value").cast("string"),
        F.lit("severity"), F.col("severity"),
    )
    return df.select(
        "timestamp",
        F.lit("drift_detected").alias("event_type"),
        drift_severity("severity").alias("severity"),
        none.alias("user_id"), none.alias("username"), none.alias("ip_address"),
        details.alias("details"),
        _flags(DRIFT_FLAGS).alias("compliance"),
    )


def audit_from_activity(df: DataFrame) -> DataFrame:
    """Events from raw activities of any kind.

    Input columns: ``kind``, ``timestamp``, and optionally ``success``, ``event_type`` and
    ``severity`` (overrides for security and model kinds), ``user_id``, ``username``,
    ``ip_address``, ``details map<string,string>``. Details are masked by field name, stack
    traces are cut, failed logins carry no user id.
    """
    kind, success = F.col("kind"), F.coalesce(_optional(df, "success", "boolean"), F.lit(False))
    given_type, given_severity = _optional(df, "event_type"), _optional(df, "severity")
    details = (
        F.col("details")
        if "details" in df.columns
        else F.create_map().cast("map<string,string>")
    )
    details = F.coalesce(details, F.create_map().cast("map<string,string>"))
    failed = (kind == "login_failed") | ((kind == "authentication") & ~success)

    types = F.when((kind == "authentication") & success, "login_success").when(
        kind == "authentication", "login_failed"
    ).when(kind.isin("security", "model") & given_type.isNotNull(), given_type)
    severities = F.when((kind == "authentication") & success, "info").when(
        kind == "authentication", "warning"
    ).when(
        kind == "prediction", prediction_severity(details["probability"].try_cast("double"))
    ).when(kind == "drift", drift_severity(details["severity"])).when(
        (kind == "security") & given_severity.isNotNull(), given_severity
    )
    for name, (event_type, severity) in ACTIVITY.items():
        if event_type:
            types = types.when(kind == name, event_type)
        if severity:
            severities = severities.when(kind == name, severity)

    def extra(field: str, value: Column) -> Column:
        return F.map_from_arrays(F.array(F.lit(field)), F.array(value))

    none = F.create_map().cast("map<string,string>")
    filled = F.when(
        (kind == "authentication") & ~success & details["reason"].isNull(),
        F.map_concat(extra("reason", F.lit("Invalid credentials")), extra("success", F.lit("false"))),
    ).when(
        kind == "authentication", extra("success", success.cast("string")),
    ).when(
        # the action names the operation; an operation field stands in for it
        kind == "data_access",
        extra("operation", F.coalesce(details["action"], details["operation"], F.lit("access"))),
    ).otherwise(none)
    shown = F.map_filter(
        details,
        lambda k, _: ~(
            ((kind == "data_access") & k.isin("action", "operation"))
            | ((kind == "authentication") & (k == "success"))
        ),
    )
    cut = F.transform_values(
        shown,
        lambda k, v: F.when(
            (kind == "system_error") & (k == "stack_trace"),
            F.substring(v, 1, STACK_TRACE_CHARS),
        ).otherwise(v),
    )
    # The filled keys are absent (NULL) in the details; drop a NULL entry before the two meet.
    present = F.map_filter(cut, lambda _, v: v.isNotNull())
    return df.select(
        "timestamp",
        types.alias("event_type"),
        severities.alias("severity"),
        F.when(~failed, _optional(df, "user_id")).alias("user_id"),
        _optional(df, "username").alias("username"),
        _optional(df, "ip_address").alias("ip_address"),
        sanitize_map(F.map_concat(present, filled)).alias("details"),
        F.when(kind == "prediction", _flags(PREDICTION_FLAGS))
        .when(kind == "drift", _flags(DRIFT_FLAGS))
        .otherwise(_flags(DEFAULT_FLAGS))
        .alias("compliance"),
    )


def recent_events(
    df: DataFrame, limit: int = 100, event_type: str | None = None, severity: str | None = None
) -> DataFrame:
    """Newest day first; inside a day in log order (time, then id if there is one), up to ``limit`` rows."""
    out = df
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if severity:
        out = out.filter(F.col("severity") == severity)
    ids = [c for c in ("event_id",) if c in df.columns]
    return out.orderBy(F.desc("event_date"), "timestamp", *ids).limit(limit)


def filter_events(
    df: DataFrame, start: Column | None = None, end: Column | None = None,
    event_type: str | None = None, user_id: str | None = None,
) -> DataFrame:
    """Events inside [start, end]; a log partitioned by day is pruned by the same bounds."""
    out = df
    if start is not None:
        out = out.filter((F.col("timestamp") >= start) & (F.col("event_date") >= start.cast("date")))
    if end is not None:
        out = out.filter((F.col("timestamp") <= end) & (F.col("event_date") <= end.cast("date")))
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if user_id:
        out = out.filter(F.col("user_id") == user_id)
    return out


def latest(df: DataFrame) -> Column:
    """Time of the newest event, as a scalar subquery."""
    return df.agg(F.max("timestamp")).scalar()


def _newest(df: DataFrame) -> Column:
    """Time of the newest event; of a log by day only the last day's times are read."""
    if "event_date" not in df.columns:
        return latest(df)
    day = F.col("event_date").try_cast("date")
    last = df.agg(F.max(day)).scalar()
    return latest(df.filter(day.isNull() | (day >= last)))


def _since(df: DataFrame, asof: Column | None, days: int) -> DataFrame:
    """Events of the last days; a log partitioned by day is pruned by the same bound."""
    start = (_newest(df) if asof is None else asof) - F.expr(f"INTERVAL {days} DAYS")
    out = df.filter(F.col("timestamp") >= start)
    if "event_date" not in df.columns:
        return out
    day = F.col("event_date").try_cast("date")
    return out.filter(day.isNull() | (day >= start.cast("date")))


def _counts(df: DataFrame, cells: list[tuple[str, Column, Column]]) -> DataFrame:
    """(metric, key, n) summed over (metric, key, weight) cells of every row, in one pass.

    One zero row per keyless metric keeps it in the report of an empty log.
    """
    def cell(metric: str, key: Column, weight: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), key.alias("key"), weight.cast("bigint").alias("n")
        )

    rows = df.select(F.explode(F.array(*(cell(*c) for c in cells))).alias("cell")).select("cell.*")
    zeros = df.sparkSession.range(1).select(
        F.explode(F.array(*(cell(m, F.lit(""), F.lit(0)) for m, _, _ in cells))).alias("cell")
    ).select("cell.*")
    return rows.unionByName(zeros).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("unknown"))


def audit_statistics(df: DataFrame, asof: Column | None = None, days: int = 7) -> DataFrame:
    """(metric, key, value): totals, counts by type and severity, distinct users and addresses.

    Rows are counted per (metric, key) first, with a map-side combine, so a user or address that
    owns a third of the log is one partial count per task; distinct values are then the keys.
    """
    one = F.lit(1)
    counts = _counts(
        _since(df, asof, days),
        [
            ("total_events", F.lit(""), one),
            ("events_by_type", _known("event_type"), one),
            ("events_by_severity", _known("severity"), one),
            ("unique_users", F.coalesce(F.col("user_id"), F.lit("")), one),
            ("unique_ips", F.coalesce(F.col("ip_address"), F.lit("")), one),
        ],
    )
    distinct = F.col("metric").isin("unique_users", "unique_ips")
    keyed = F.col("metric").isin("events_by_type", "events_by_severity")
    return (
        # without the zero rows; an empty type or severity is a group of its own
        counts.filter(~(keyed & (F.col("key") == "") & (F.col("n") == 0)))
        .groupBy("metric", F.when(distinct, "").otherwise(F.col("key")).alias("key"))
        .agg(
            F.sum(F.when(distinct, (F.col("key") != "").cast("bigint")).otherwise(F.col("n")))
            .alias("value")
        )
    )


def audit_summary(df: DataFrame, asof: Column | None = None, days: int = 7) -> DataFrame:
    """(metric, key, value): counts by type, severity and user name, and three event counters.

    Events without a user name are the group with a NULL key.
    """
    one, kind = F.lit(1), F.col("event_type")
    counts = _counts(
        _since(df, asof, days),
        [
            ("total_events", F.lit(""), one),
            ("events_by_type", kind, one),
            ("events_by_severity", F.col("severity"), one),
            ("events_by_user", F.col("username"), one),
            ("failed_logins", F.lit(""), kind == "login_failed"),
            ("unauthorized_access", F.lit(""), kind == "unauthorized_access"),
            ("predictions_made", F.lit(""), kind == "prediction_success"),
        ],
    )
    keyed = F.col("metric").startswith("events_by")
    empty_key = F.coalesce(F.col("key") == "", F.lit(False))
    return counts.filter(~(keyed & empty_key & (F.col("n") == 0))).withColumnRenamed("n", "value")


def retain_audit(df: DataFrame, asof: Column | None = None, days: int = 90) -> DataFrame:
    """Rows of the day partitions that survive; days that do not parse are kept.

    A day goes when its midnight lies before ``asof - days``, so the filter is on the partition
    column alone. Write the result to a new location.
    """
    start = (_newest(df) if asof is None else asof) - F.expr(f"INTERVAL {days} DAYS")
    day = F.col("event_date").try_cast("date")
    return df.filter(day.isNull() | (day.cast("timestamp_ntz") >= start.cast("timestamp_ntz")))
