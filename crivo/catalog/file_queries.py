"""Scans, sinks and streams, each writing to and reading from the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.catalog.dirty import uploads
from crivo.catalog.event_queries import DAILY, ORACLES as EVENT_SQL, _merged
from crivo.catalog.fixture_sql import AUDIT, PROP, REQUESTS
from crivo.catalog.intake_queries import ORACLES as INTAKE_SQL
from crivo.catalog.threshold_queries import ORACLES as THRESHOLD_SQL
from crivo.catalog.scalar_queries import _RECOMMEND, _REASON
from crivo import constants as K
from crivo.functions import decisions as D
from crivo.functions import features as X
from crivo.functions import ingest as I
from crivo.operators import thresholds as T
from crivo.session import scratch_path
from crivo.sources import files
from crivo.sources.star import audit_events, proposals, requests
from crivo.streaming import streams


ARRIVAL_FILES = 1000


def scan_portfolio(spark, folder):
    path = scratch_path(spark, "portfolio")
    files.write_portfolio(proposals(spark, folder), path)
    return T.threshold_metrics(files.scan_portfolio(spark, path), 0.5)


def scan_training(spark, folder):
    path = scratch_path(spark, "training")
    files.write_portfolio(proposals(spark, folder), path)
    return files.training_profile(files.scan_training(spark, path))


def append_portfolio(spark, folder):
    path = scratch_path(spark, "slices")
    rows = proposals(spark, folder).select("proposta_id", "score", "ticket")
    for i in range(3):
        files.append_portfolio(rows.filter(F.col("proposta_id") % 3 == i), path)
    return spark.read.parquet(path)


def scan_proposals_csv(spark, folder):
    path = scratch_path(spark, "uploads")
    files.write_proposals_csv(uploads(spark, folder), path)
    rows = I.coerce_csv(files.scan_proposals_csv(spark, path))
    return rows.select("cliente_id", *K.CSV_NUMBERS, *K.CSV_TEXTS)


def scan_proposals_csv_by_name(spark, folder):
    """The same uploads in two files: columns reversed, a name added, and as they are."""
    path = scratch_path(spark, "uploads")
    rows = uploads(spark, folder)
    odd = F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 1
    named = rows.filter(odd).withColumn("nome", F.lit("Ana, \"B\""))
    files.write_proposals_csv(named.select(*reversed(named.columns)), f"{path}/a")
    files.write_proposals_csv(rows.filter(~odd), f"{path}/b")
    found = I.coerce_csv(files.scan_proposals_csv(spark, f"{path}/*"))
    return found.select("cliente_id", *K.CSV_NUMBERS, *K.CSV_TEXTS)


def write_batch_results(spark, folder):
    path = scratch_path(spark, "results")
    files.write_batch_results(D.batch_result(proposals(spark, folder)), path)
    return spark.read.option("header", True).csv(path)


def _log(spark, folder):
    rows = audit_events(spark, folder)
    return rows.select(
        "timestamp", "event_type", "severity", "user_id", "username", "ip_address",
        F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("details"),
        F.create_map(F.lit("lgpd_compliant"), F.lit(True)).alias("compliance"),
    )


def _read_back(log):
    return log.select(
        F.col("details")["id"].cast("bigint").alias("event_id"),
        F.unix_micros("timestamp").alias("us"), "event_type", "severity", "user_id", "username",
        "ip_address", F.col("compliance")["lgpd_compliant"].cast("int").alias("lgpd"),
    )


def write_audit(spark, folder):
    """Log written by day, damaged lines added, a range of days read back."""
    path = scratch_path(spark, "audit")
    files.write_audit(_log(spark, folder), path)
    failed = audit_events(spark, folder).filter(F.col("event_type") == "login_failed")
    damaged = failed.select(
        F.concat(F.lit('{"event_type": "cut'), F.col("event_id").cast("string")).alias("value"),
        "event_date",
    )
    damaged.write.mode("append").partitionBy("event_date").text(path)
    first = F.lit("2024-01-05").cast("date")
    last = F.lit("2024-01-15").cast("date")
    return _read_back(files.scan_audit(spark, path, first, last))


def recent_audit(spark, folder):
    """The newest events of a written log, a third of whose days are needed at most."""
    path = scratch_path(spark, "audit")
    files.write_audit(_log(spark, folder), path)
    return _read_back(files.recent_audit(spark, path, 100, "login_failed"))


def retain_log(spark, folder):
    """A written log cut to its last ten days by its own newest event."""
    path, out = scratch_path(spark, "audit"), scratch_path(spark, "retained")
    files.write_audit(_log(spark, folder), path)
    files.retain_log(spark, path, out, days=10)
    return _read_back(files.scan_audit(spark, out))


def audit_sink(spark, folder):
    source, path = scratch_path(spark, "events"), scratch_path(spark, "audit-stream")
    _log(spark, folder).write.parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema)
    streams.audit_sink(stream, path, scratch_path(spark, "checkpoint"), True).awaitTermination()
    return _read_back(files.scan_audit(spark, path))


def _event_stream(spark, rows):
    source = scratch_path(spark, "requests")
    rows.write.parquet(source)
    return streams.read_files(spark, source, spark.read.parquet(source).schema)


def _run(spark, stream):
    return _run_to_end(spark, stream)[0]


def _run_to_end(spark, stream):
    """The rows written and the finished query."""
    path = scratch_path(spark, "out")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query


def request_count_stream(spark, folder):
    """Windows closed by the watermark."""
    stream = _event_stream(spark, requests(spark, folder))
    counts = streams.request_count_stream(stream, "2 hours", "1 hour", "1 day")
    return _run(spark, counts).select(
        F.unix_seconds("window_start").alias("window_start"), "ip", "endpoint", "n_requests"
    )


def admission_stream(spark, folder):
    stream = _event_stream(spark, _merged(spark, folder))
    return _run(spark, streams.admission_stream(stream, DAILY)).select(
        "event_id", "ip", "endpoint", "decision", "remaining", "retry_after"
    )


def admission_stream_accounts(spark, folder):
    """Decided and late requests of three arrivals, two of them behind: each request lies in one table."""
    rows = _merged(spark, folder)
    source, path, checkpoint = (scratch_path(spark, name) for name in ("requests", "admissions", "checkpoint"))
    for arrival in range(3):
        # At most as many files as the stream takes at once: an arrival is one batch, however large.
        come = rows.filter(F.col("event_id") % 3 == arrival).coalesce(ARRIVAL_FILES)
        come.write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, rows.schema, files_per_batch=ARRIVAL_FILES)
        decided = streams.admission_stream(stream, DAILY, "3 days")
        streams.admission_sink(decided, path, checkpoint, True).awaitTermination()
    tables = [
        streams.scan_admissions(spark, path, late).withColumn("late", F.lit(int(late))) for late in (False, True)
    ]
    return tables[0].unionByName(tables[1]).select("event_id", "us", "ip", "endpoint", "late")


def score_stream(spark, folder):
    """Drafted proposals scored by the score alone as they arrive."""
    rows = proposals(spark, folder).select(
        "proposta_id", *K.RANGES, *K.ENUM_RULES, "uf"
    )
    stream = _event_stream(spark, rows)
    path = scratch_path(spark, "scored")

    def score(df):
        p = F.round(X.risk_factor("score"), 6)
        return df.select(
            "proposta_id", F.col("valid").cast("int").alias("valid"),
            F.when(F.col("valid"), p).alias("p"),
            F.when(F.col("valid"), D.recommendation(p)).alias("decisao"),
        )

    streams.score_stream(stream, score, path, scratch_path(spark, "checkpoint"), True).awaitTermination()
    return spark.read.parquet(path)


QUERIES = {
    f.__name__: f
    for f in (
        scan_portfolio, scan_training, append_portfolio, scan_proposals_csv,
        scan_proposals_csv_by_name, write_batch_results,
        write_audit, recent_audit, retain_log, audit_sink, request_count_stream, admission_stream, admission_stream_accounts,
        score_stream,
    )
}

_TWO = "cast(cast(round({x}, 2) AS decimal(38,2)) AS varchar)"
_LOG_SQL = """SELECT event_id, epoch_us("timestamp") AS us, event_type, severity, user_id, username,
 ip_address, 1 AS lgpd FROM audit"""

ORACLES = {
    "scan_portfolio": THRESHOLD_SQL["threshold_metrics"],
    "scan_training": PROP + """ SELECT count(*) AS n_rows,
        round(avg(inadimplente) * 100, 2) AS label_rate FROM prop""",
    "append_portfolio": PROP + " SELECT proposta_id, score, ticket FROM prop",
    "scan_proposals_csv": INTAKE_SQL["coerce_csv"],
    "scan_proposals_csv_by_name": INTAKE_SQL["coerce_csv"],
    "write_batch_results": PROP + f""", r AS (SELECT *, {_RECOMMEND} AS d, {_REASON} AS m,
          CASE WHEN p > 0.5 THEN ticket * p ELSE 0 END AS loss FROM prop)
        SELECT cliente_id AS "ID", 'Cliente ' || cliente_id AS "Cliente", {_TWO.format(x='ticket')} AS "Valor",
         cast(cast(round(p * 100, 1) AS decimal(20,1)) AS varchar) AS "Risco (%)", cast(score AS varchar) AS "Score",
         d AS "Decisão", CASE WHEN p * 100 > 60 THEN 'Alto' WHEN p * 100 > 30 THEN 'Médio' ELSE 'Baixo' END AS "Categoria",
         m AS "Motivo Rejeição", {_TWO.format(x='loss')} AS "Perda Evitada" FROM r""",
    "write_audit": AUDIT + _LOG_SQL + " WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'",
    "recent_audit": AUDIT + _LOG_SQL + """ WHERE event_type = 'login_failed'
        ORDER BY event_date DESC, "timestamp" LIMIT 100""",
    "retain_log": AUDIT + _LOG_SQL + """ WHERE event_date::timestamp >=
        (SELECT max("timestamp") FROM audit) - INTERVAL 10 DAYS""",
    "audit_sink": AUDIT + _LOG_SQL,
    "request_count_stream": REQUESTS + """, w AS (SELECT ip, endpoint, epoch_us(ts) // 3600000000 - unnest([0, 1]) AS h FROM requests)
        SELECT cast(h * 3600 AS bigint) AS window_start, ip, endpoint, count(*) AS n_requests FROM w
        WHERE (h + 2) * 3600000 <= (SELECT epoch_ms(max(ts)) FROM requests) - 86400000 GROUP BY ALL""",
    "admission_stream": EVENT_SQL["admit_requests"],
    "admission_stream_accounts": REQUESTS + """, merged AS (SELECT event_id, epoch_us(ts) AS us, event_id % 3 AS arrival,
          CASE WHEN user_id % 4 = 0 THEN '10.9.9.9' ELSE ip END AS ip, endpoint FROM requests)
        SELECT event_id, us, ip, endpoint, CASE WHEN ip <> '10.0.0.3' AND us < greatest(
           coalesce((SELECT max(e.us) FROM merged e WHERE e.arrival < m.arrival AND e.ip = m.ip), 0),
           coalesce((SELECT max(e.us) // 1000 * 1000 FROM merged e WHERE e.arrival < m.arrival), 0) - 259200000000)
         THEN 1 ELSE 0 END AS late FROM merged m""",
    "score_stream": PROP + """, q AS (SELECT *, tipo_credito IN ('CDC', 'Pessoal') AS ok,
         round((950 - score) / 650.0::double, 6) AS r FROM prop)
        SELECT proposta_id, ok::int AS valid, CASE WHEN ok THEN r END AS p,
         CASE WHEN ok THEN CASE WHEN r <= 0.10 THEN 'Aprovar' WHEN r <= 0.30 THEN 'Revisar' ELSE 'Negar' END END AS decisao
        FROM q""",
}
