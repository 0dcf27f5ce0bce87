"""Audit log and request limits over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.catalog.fixture_sql import AUDIT, PROP, REQUESTS
from crivo.functions import decisions as D
from crivo.operators import audit as A
from crivo.operators import requests as Q
from crivo.sources.star import audit_events, proposals, requests, table

DAY = 86_400
# Traffic is sparse, so these limits count over a day and block for a day or more.
DAILY = Q.Limits(
    rules=(
        ("/api/v1/predict", 2, DAY, 24 * 60),
        ("/api/v1/predict/batch", 1, DAY, 48 * 60),
        ("/api/v1/auth/token", 1, DAY, 24 * 60),
        ("/api/v1/auth/login", 1, DAY // 2, 36 * 60),
    ),
    default=(3, DAY, 24 * 60),
    whitelist=("10.0.0.3",),
)


def _asof():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


def _merged(spark, folder, every=4):
    """All traffic behind a few proxies: every fourth user (or another share) under one address."""
    user = F.col("user_id")
    return requests(spark, folder).withColumn(
        "ip", F.when(user % every == 0, "10.9.9.9").otherwise(F.col("ip"))
    )


# --- audit ------------------------------------------------------------------------------------
def recent_events(spark, folder):
    return A.recent_events(audit_events(spark, folder), 100)


def recent_events_filtered(spark, folder):
    return A.recent_events(audit_events(spark, folder), 50, "login_failed", "warning")


def filter_events(spark, folder):
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return A.filter_events(audit_events(spark, folder), start, _asof(), "prediction_success")


def filter_events_user(spark, folder):
    return A.filter_events(audit_events(spark, folder), user_id="7")


def audit_statistics(spark, folder):
    return A.audit_statistics(audit_events(spark, folder), _asof(), 7)


def audit_statistics_latest(spark, folder):
    return A.audit_statistics(audit_events(spark, folder), None, 30)


def audit_statistics_empty_type(spark, folder):
    """Events without a type or severity are groups of their own."""
    rows = audit_events(spark, folder)
    blank = F.col("event_id") % 50 == 0
    rows = rows.withColumns({c: F.when(blank, "").otherwise(F.col(c)) for c in ("event_type", "severity")})
    return A.audit_statistics(rows, _asof(), 7)


def audit_summary(spark, folder):
    return A.audit_summary(audit_events(spark, folder), _asof(), 7)


def retain_audit(spark, folder):
    rows = audit_events(spark, folder)
    rows = rows.withColumn(
        "event_date",
        F.when(F.col("event_id") % 97 == 0, "backup").otherwise(F.col("event_date").cast("string")),
    )
    return A.retain_audit(rows, _asof(), 10).select("event_id", "event_date")


def audit_from_predictions(spark, folder):
    rows = D.score_response(
        proposals(spark, folder), "p", at=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ).withColumn("key", F.col("proposta_id"))
    events = A.audit_from_predictions(rows, "p")
    d = F.col("details")
    return events.select(
        "event_type", "severity", d["cliente_id"].alias("cliente_id"),
        d["probability"].cast("double").alias("probability"),
        d["recommendation"].alias("recommendation"), d["prediction"].alias("prediction"),
        F.col("compliance")["data_masked"].cast("int").alias("masked"),
    )


def audit_from_drift(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("feature"),
        (F.col("event_id") % 100 / 100).alias("ks_statistic"), F.lit(0.01).alias("p_value"),
        F.when(F.col("event_id") % 3 == 0, "medium").when(F.col("event_id") % 3 == 1, "high")
        .alias("severity"),
    )
    return A.audit_from_drift(rows).select(
        "timestamp", "event_type", "severity", F.col("details")["feature"].alias("feature"),
        F.col("details")["severity"].alias("level"),
        F.col("compliance")["model_risk_management"].cast("int").alias("flag"),
    )


_KINDS = tuple(A.ACTIVITY)


def _activity(spark, folder):
    eid, user = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (eid % len(_KINDS) + 1).cast("int"))
    return table(spark, folder, "events").select(
        eid.alias("event_id"), kind.alias("kind"), F.col("ts").alias("timestamp"),
        (user % 2 == 0).alias("success"),
        F.when(user % 5 == 0, "permission_changed").alias("event_type"),
        F.when(user % 3 == 0, "critical").alias("severity"),
        user.cast("string").alias("user_id"), F.lit("ana").alias("username"),
        F.lit("10.0.0.1").alias("ip_address"),
        F.map_filter(
            F.create_map(
                F.lit("event"), eid.cast("string"),
                F.lit("cpf"), F.lpad(user.cast("string"), 11, "7"),
                F.lit("stack_trace"), F.repeat(F.lit("abcdefghij"), 60),
                F.lit("action"), F.when(user % 2 == 0, "export"),
                F.lit("severity"), F.when(user % 2 == 0, "medium").otherwise("high"),
                F.lit("probability"), (user % 10 / 10).cast("string"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("details"),
    )


def audit_from_activity(spark, folder):
    d = F.col("details")
    return A.audit_from_activity(_activity(spark, folder)).select(
        d["event"].cast("bigint").alias("event_id"), "event_type", "severity", "user_id",
        d["cpf"].alias("cpf"), F.length(d["stack_trace"]).alias("n_trace"),
        d["reason"].alias("reason"), d["operation"].alias("operation"), d["success"].alias("success"),
        F.size(F.col("compliance")).alias("n_flags"),
    )


# --- requests ---------------------------------------------------------------------------------
def endpoint_limits(spark, folder):
    rows = Q.endpoint_limits(requests(spark, folder))
    first = Q.endpoint_limits(requests(spark, folder), Q.Limits(first_match=True)).select(
        "event_id", F.col("max_requests").alias("first_max")
    )
    return rows.select(
        "event_id", "endpoint", "max_requests", "window_seconds", "block_minutes"
    ).join(first, "event_id")


def client_ip(spark, folder):
    rows = requests(spark, folder)
    forwarded = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" 1.2.3."), F.col("user_id"), F.lit(" , 9.9.9.9"))).when(
        F.col("event_id") % 4 == 1, ""
    )
    real = F.when(F.col("event_id") % 3 == 0, "5.6.7.8").when(F.col("event_id") % 3 == 1, "")
    return rows.select("event_id", Q.client_ip(forwarded, real, "ip").alias("client"))


def sliding_request_counts(spark, folder):
    return Q.sliding_request_counts(requests(spark, folder), DAY).select(
        "event_id", "n_in_window"
    )


def sliding_request_counts_hot(spark, folder):
    return Q.sliding_request_counts(_merged(spark, folder), 3600, ("ip",)).select(
        "event_id", "n_in_window"
    )


def windowed_request_counts(spark, folder):
    out = Q.windowed_request_counts(requests(spark, folder), "2 hours", "1 hour")
    return out.select(
        F.unix_seconds("window_start").alias("window_start"), "ip", "endpoint", "n_requests"
    )


def block_intervals(spark, folder):
    return Q.block_intervals(_merged(spark, folder), DAILY)


def admit_requests(spark, folder):
    return Q.admit_requests(_merged(spark, folder), DAILY).select(
        "event_id", "ip", "endpoint", "decision", "remaining", "retry_after"
    )


def admit_requests_hot(spark, folder):
    """One address owns half the traffic."""
    return Q.admit_requests(_merged(spark, folder, 2), DAILY).select(
        "event_id", "ip", "endpoint", "decision", "remaining", "retry_after"
    )


def top_ips(spark, folder):
    return Q.top_ips(requests(spark, folder))


def rate_limit_stats(spark, folder):
    rows = _merged(spark, folder)
    return Q.rate_limit_stats(rows, Q.block_intervals(rows, DAILY), _asof())


QUERIES = {
    f.__name__: f
    for f in (
        recent_events, recent_events_filtered, filter_events, filter_events_user,
        audit_statistics, audit_statistics_latest, audit_statistics_empty_type, audit_summary, retain_audit,
        audit_from_predictions, audit_from_drift, audit_from_activity, endpoint_limits, client_ip,
        sliding_request_counts, sliding_request_counts_hot, windowed_request_counts,
        block_intervals, admit_requests, admit_requests_hot, top_ips, rate_limit_stats,
    )
}

_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def _stats(since: str, rows: str = "*") -> str:
    return AUDIT + f""", f AS (SELECT {rows} FROM audit WHERE "timestamp" >= {since})
 SELECT 'total_events' AS metric, '' AS "key", count(*) AS value FROM f
 UNION ALL SELECT 'events_by_type', event_type, count(*) FROM f GROUP BY event_type
 UNION ALL SELECT 'events_by_severity', severity, count(*) FROM f GROUP BY severity
 UNION ALL SELECT 'unique_users', '', count(DISTINCT nullif(user_id, '')) FROM f
 UNION ALL SELECT 'unique_ips', '', count(DISTINCT nullif(ip_address, '')) FROM f"""


def _rule_sql(field: int) -> str:
    whens = " ".join(f"WHEN contains(endpoint, '{r[0]}') THEN {r[field]}" for r in DAILY.ordered())
    return f"(CASE {whens} ELSE {DAILY.default[field - 1]} END)::bigint"


_MERGED = REQUESTS + f""", merged AS (SELECT event_id, ts, user_id,
  CASE WHEN user_id % 4 = 0 THEN '10.9.9.9' ELSE ip END AS ip, endpoint FROM requests),
 ruled AS (SELECT *, epoch_us(ts) AS us, {_rule_sql(1)} AS lim, {_rule_sql(2)} AS win, {_rule_sql(3)} AS blk FROM merged),
 seq AS (SELECT *, row_number() OVER (PARTITION BY ip, endpoint ORDER BY us, event_id) AS k FROM ruled
  WHERE ip NOT IN ('10.0.0.3'))
"""
# The chain of blocks per address, followed step by step.
_BLOCKS = _MERGED.replace("WITH requests", "WITH RECURSIVE requests", 1) + """,
 cand AS (SELECT a.ip, a.endpoint, a.us, a.event_id, a.us + a.blk * 60000000 AS until, b.us AS since
  FROM seq a JOIN seq b ON a.ip = b.ip AND a.endpoint = b.endpoint AND b.k = a.k - a.lim
  WHERE b.us > a.us - a.win * 1000000),
 chain AS (
  SELECT ip, endpoint, us, event_id, until FROM
   (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us, event_id) AS r FROM cand) WHERE r = 1
  UNION ALL
  SELECT ip, endpoint, us, event_id, until FROM
   (SELECT c.*, row_number() OVER (PARTITION BY c.ip ORDER BY c.us, c.event_id) AS r
    FROM chain h JOIN cand c ON c.ip = h.ip AND c.since > h.until) WHERE r = 1)
"""

ORACLES = {
    "recent_events": AUDIT + """SELECT * FROM audit ORDER BY event_date DESC, "timestamp", event_id LIMIT 100""",
    "recent_events_filtered": AUDIT + """SELECT * FROM audit WHERE event_type = 'login_failed'
        AND severity = 'warning' ORDER BY event_date DESC, "timestamp", event_id LIMIT 50""",
    "filter_events": AUDIT + f"""SELECT * FROM audit WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
        AND "timestamp" <= {_NOW} AND event_type = 'prediction_success'""",
    "filter_events_user": AUDIT + "SELECT * FROM audit WHERE user_id = '7'",
    "audit_statistics": _stats(f"{_NOW} - INTERVAL 7 DAYS"),
    "audit_statistics_latest": _stats('(SELECT max("timestamp") FROM audit) - INTERVAL 30 DAYS'),
    "audit_statistics_empty_type": _stats(
        f"{_NOW} - INTERVAL 7 DAYS",
        """user_id, ip_address, CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS event_type,
           CASE WHEN event_id % 50 = 0 THEN '' ELSE severity END AS severity""",
    ),
    "audit_summary": AUDIT + f""", f AS (SELECT * FROM audit WHERE "timestamp" >= {_NOW} - INTERVAL 7 DAYS)
        SELECT 'total_events' AS metric, '' AS "key", count(*) AS value FROM f
        UNION ALL SELECT 'events_by_type', event_type, count(*) FROM f GROUP BY event_type
        UNION ALL SELECT 'events_by_severity', severity, count(*) FROM f GROUP BY severity
        UNION ALL SELECT 'events_by_user', username, count(*) FROM f GROUP BY username
        UNION ALL SELECT 'failed_logins', '', count(CASE WHEN event_type = 'login_failed' THEN 1 END) FROM f
        UNION ALL SELECT 'unauthorized_access', '', count(CASE WHEN event_type = 'unauthorized_access' THEN 1 END) FROM f
        UNION ALL SELECT 'predictions_made', '', count(CASE WHEN event_type = 'prediction_success' THEN 1 END) FROM f""",
    "retain_audit": AUDIT + f"""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'backup'
        ELSE cast(event_date AS varchar) END AS event_date FROM audit
        WHERE event_id % 97 = 0 OR event_date::timestamp >= {_NOW} - INTERVAL 10 DAYS""",
    "audit_from_predictions": PROP + """
        SELECT 'prediction_success' AS event_type, CASE WHEN p > 0.7 THEN 'warning' ELSE 'info' END AS severity,
         '***.***.***-' || right(cliente_id, 2) AS cliente_id, round(p, 4) AS probability,
         CASE WHEN p <= 0.10 THEN 'Aprovar' WHEN p <= 0.30 THEN 'Revisar' ELSE 'Negar' END AS recommendation,
         CASE WHEN p >= 0.5 THEN '1' ELSE '0' END AS prediction, 1 AS masked FROM prop""",
    "audit_from_drift": """SELECT ts AS "timestamp", 'drift_detected' AS event_type,
        CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'critical' END AS severity, event_type AS feature,
        CASE event_id % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' END AS "level", 1 AS flag FROM events""",
    "audit_from_activity": """WITH a AS (SELECT event_id, user_id AS u, """ + "CASE event_id % " + str(len(_KINDS))
    + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + """ END AS kind FROM events)
        SELECT event_id, CASE kind WHEN 'authentication' THEN CASE WHEN u % 2 = 0 THEN 'login_success' ELSE 'login_failed' END
          WHEN 'prediction' THEN 'prediction_success' WHEN 'drift' THEN 'drift_detected'
          WHEN 'security' THEN CASE WHEN u % 5 = 0 THEN 'permission_changed' ELSE 'suspicious_activity' END
          WHEN 'model' THEN CASE WHEN u % 5 = 0 THEN 'permission_changed' ELSE 'model_loaded' END ELSE kind END AS event_type,
         CASE kind WHEN 'login_success' THEN 'info' WHEN 'login_failed' THEN 'warning'
          WHEN 'authentication' THEN CASE WHEN u % 2 = 0 THEN 'info' ELSE 'warning' END
          WHEN 'prediction' THEN CASE WHEN u % 10 > 7 THEN 'warning' ELSE 'info' END
          WHEN 'unauthorized_access' THEN 'error' WHEN 'permission_denied' THEN 'warning'
          WHEN 'rate_limit_exceeded' THEN 'warning' WHEN 'drift' THEN CASE WHEN u % 2 = 0 THEN 'warning' ELSE 'critical' END
          WHEN 'system_error' THEN 'error' WHEN 'data_access' THEN 'info'
          WHEN 'security' THEN CASE WHEN u % 3 = 0 THEN 'critical' ELSE 'warning' END ELSE 'info' END AS severity,
         CASE WHEN kind = 'login_failed' OR (kind = 'authentication' AND u % 2 = 1) THEN NULL ELSE cast(u AS varchar) END AS user_id,
         '***.***.***-' || right(lpad(cast(u AS varchar), 11, '7'), 2) AS cpf,
         CASE WHEN kind = 'system_error' THEN 500 ELSE 600 END AS n_trace,
         CASE WHEN kind = 'authentication' AND u % 2 = 1 THEN 'Invalid credentials' END AS reason,
         CASE WHEN kind = 'data_access' THEN CASE WHEN u % 2 = 0 THEN 'export' ELSE 'access' END END AS operation,
         CASE WHEN kind = 'authentication' THEN CASE WHEN u % 2 = 0 THEN 'true' ELSE 'false' END END AS success,
         3 AS n_flags FROM a""",
    "endpoint_limits": REQUESTS + """SELECT event_id, endpoint,
        CASE endpoint WHEN '/api/v1/predict' THEN 60 WHEN '/api/v1/predict/batch' THEN 10 WHEN '/api/v1/metrics' THEN 100 ELSE 5 END AS max_requests,
        CASE WHEN contains(endpoint, '/auth/') THEN 300 ELSE 60 END AS window_seconds,
        CASE WHEN contains(endpoint, '/auth/') THEN 60 WHEN contains(endpoint, 'batch') THEN 30 ELSE 15 END AS block_minutes,
        CASE WHEN contains(endpoint, '/predict') THEN 60 WHEN contains(endpoint, '/auth/') THEN 5 ELSE 100 END AS first_max
        FROM requests""",
    "client_ip": REQUESTS + """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '1.2.3.' || user_id
        WHEN event_id % 3 = 0 THEN '5.6.7.8' ELSE ip END AS client FROM requests""",
    "sliding_request_counts": REQUESTS + """SELECT event_id, count(*) OVER (PARTITION BY ip, endpoint ORDER BY ts
        RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n_in_window FROM requests""",
    "sliding_request_counts_hot": _MERGED + """SELECT event_id, count(*) OVER (PARTITION BY ip ORDER BY ts
        RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS n_in_window FROM merged""",
    "windowed_request_counts": REQUESTS + """, w AS (SELECT ip, endpoint, epoch_us(ts) // 3600000000 - unnest([0, 1]) AS h FROM requests)
        SELECT cast(h * 3600 AS bigint) AS window_start, ip, endpoint, count(*) AS n_requests FROM w GROUP BY ALL""",
    "block_intervals": _BLOCKS + "SELECT ip, endpoint, event_id, us, until FROM chain",
    "admit_requests": _BLOCKS + """, d AS (SELECT r.*, c.event_id AS ce, c.until,
          CASE WHEN r.ip = '10.0.0.3' THEN 'whitelist' WHEN r.event_id = c.event_id THEN 'limit'
           WHEN c.event_id IS NOT NULL THEN 'blocked' ELSE 'admitted' END AS decision
         FROM ruled r LEFT JOIN chain c ON r.ip = c.ip AND r.us <= c.until
          AND (r.us > c.us OR (r.us = c.us AND r.event_id >= c.event_id))),
        n AS (SELECT a.event_id, count(b.event_id) AS seen FROM d a LEFT JOIN d b ON a.ip = b.ip AND a.endpoint = b.endpoint
          AND b.decision = 'admitted' AND b.us > a.us - a.win * 1000000 AND (b.us < a.us OR (b.us = a.us AND b.event_id < a.event_id))
          GROUP BY a.event_id)
        SELECT d.event_id, ip, endpoint, decision,
         CASE decision WHEN 'admitted' THEN greatest(0, lim - seen - 1) WHEN 'limit' THEN 0 END AS remaining,
         CASE decision WHEN 'limit' THEN win WHEN 'blocked' THEN (until - us) // 1000000 END AS retry_after
        FROM d JOIN n ON d.event_id = n.event_id""",
    "top_ips": REQUESTS + "SELECT ip, count(*) AS requests FROM requests GROUP BY ip ORDER BY requests DESC, ip LIMIT 10",
    "rate_limit_stats": _BLOCKS + f""", open_ AS (SELECT ip, (until - epoch_us({_NOW})) // 1000000 AS sec FROM chain
          WHERE us <= epoch_us({_NOW}) AND until >= epoch_us({_NOW})),
        busy AS (SELECT ip, count(*) AS n FROM merged GROUP BY ip ORDER BY n DESC, ip LIMIT 10)
        SELECT 'tracked_ips' AS metric, '' AS "key", count(DISTINCT ip) AS value FROM merged
        UNION ALL SELECT 'tracked_pairs', '', count(*) FROM (SELECT DISTINCT ip, endpoint FROM merged)
        UNION ALL SELECT 'tracked_requests', '', count(*) FROM merged
        UNION ALL SELECT 'blocked_ips', '', count(*) FROM open_
        UNION ALL SELECT 'blocked_remaining', ip, sec FROM open_
        UNION ALL SELECT 'top_ip', ip, n FROM busy""",
}
ORACLES["admit_requests_hot"] = ORACLES["admit_requests"].replace("user_id % 4 = 0", "user_id % 2 = 0")
