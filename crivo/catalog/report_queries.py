"""Portfolio reports, batch summaries and model-quality statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.catalog.fixture_sql import PROP
from crivo.catalog.scalar_queries import _RECOMMEND, _REASON, scored
from crivo.functions import decisions as D
from crivo.functions import scorecards as S
from crivo.operators import evaluation as E
from crivo.operators import reports as R
from crivo.sources.star import proposals

P6 = PROP + ", scored AS (SELECT * REPLACE (round(p, 6) AS p) FROM prop)"
_NUMBERS = ("idade", "renda", "score", "ticket", "prazo_meses", "qtd_atrasos_12m")
_TEXTS = ("tipo_credito", "regiao", "uf", "estado_civil")


def _profiled(spark, folder):
    gap = F.when(F.col("proposta_id") % 10 != 0, F.col("score"))
    return proposals(spark, folder).withColumn("score", gap).select(*_NUMBERS, *_TEXTS)


def profile(spark, folder):
    return R.profile(_profiled(spark, folder))


def profile_text(spark, folder):
    rows = _profiled(spark, folder).withColumn(
        "uf", F.when(F.col("uf") != "RJ", F.col("uf"))
    )
    return R.profile_text(rows)


def label_counts(spark, folder):
    return R.label_counts(proposals(spark, folder))


def amount_summary(spark, folder):
    return R.amount_summary(proposals(spark, folder))


def segment_default_rates(spark, folder):
    out = R.segment_default_rates(proposals(spark, folder), commitment="perc")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


def portfolio_summary(spark, folder):
    rows = proposals(spark, folder).withColumn(
        "perda_esperada", S.expected_loss_lgd("ticket", "inadimplente", "tipo_credito")
    )
    out = R.portfolio_summary(rows)
    return out.select(
        "n_rows", *(F.round(c, 6).alias(c) for c in out.columns if c != "n_rows")
    )


def batch_results(spark, folder):
    return D.batch_result(scored(spark, folder))


def batch_summary(spark, folder):
    return R.batch_summary(D.batch_result(scored(spark, folder)))


def _predictions(spark, folder):
    return scored(spark, folder).select(
        F.concat(F.lit("1."), (F.col("proposta_id") % 4).cast("string")).alias("model_version"),
        D.recommendation("p").alias("recommendation"),
        F.round(D.risk_score("p"), 4).alias("risk_score"),
        (F.lit(5) + F.col("proposta_id") % 40).alias("processing_ms"),
    )


def prediction_log_rollup(spark, folder):
    out = R.prediction_log_rollup(_predictions(spark, folder))
    return out.select(
        "model_version", "total_predictions",
        *(F.round(c, 6).alias(c) for c in ("approval_rate", "avg_risk_score", "avg_processing_time")),
    )


def class_weight(spark, folder):
    return E.class_weight(proposals(spark, folder)).select(
        F.round("class_weight", 8).alias("class_weight")
    )


def exact_auc(spark, folder):
    """Ranked by a number of far more than six digits."""
    rows = proposals(spark, folder)
    fine = (F.lit(950) - F.col("score")) / F.lit(650.0) + (F.col("proposta_id") * 7919 % 999983) / F.lit(1e9)
    return E.exact_auc(rows.withColumn("fine", fine), "fine").select(F.round("auc", 12).alias("auc"))


def histogram_auc(spark, folder):
    return E.histogram_auc(proposals(spark, folder)).select(F.round("auc", 8).alias("auc"))


def ks_statistic(spark, folder):
    return E.ks_statistic(proposals(spark, folder)).select(F.round("ks", 8).alias("ks"))


def pr_curve_best_f1(spark, folder):
    return E.pr_curve_best_f1(proposals(spark, folder)).select(
        "threshold", F.round("f1", 8).alias("f1")
    )


def classification_report(spark, folder):
    return E.classification_report(proposals(spark, folder), threshold=0.3)


def cumulative_shares(spark, folder):
    rows = E.cumulative_shares(E.probability_histogram(proposals(spark, folder)))
    return rows.select("p", "pos", "neg", "cum_pos", "cum_neg", "all_pos", "all_neg")


def evaluation_summary(spark, folder):
    out = E.evaluation_summary(proposals(spark, folder), threshold=0.3)
    return out.withColumn("best_f1", F.round("best_f1", 8))


QUERIES = {
    f.__name__: f
    for f in (
        profile, profile_text, label_counts, amount_summary, segment_default_rates,
        portfolio_summary, batch_results, batch_summary, prediction_log_rollup, class_weight,
        exact_auc, histogram_auc, ks_statistic, pr_curve_best_f1, classification_report, cumulative_shares,
        evaluation_summary,
    )
}


def _profile_sql(c: str) -> str:
    x = f"cast({'CASE WHEN proposta_id % 10 <> 0 THEN score END' if c == 'score' else c} AS double)"
    cuts = ", ".join(f"round(quantile_cont({x}, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return (f"SELECT '{c}' AS \"column\", count({x}) AS n, count(*) - count({x}) AS n_null, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, {cuts}, "
            f"max({x}) AS max FROM prop")


def _text_sql(c: str) -> str:
    x = "CASE WHEN uf <> 'RJ' THEN uf END" if c == "uf" else c
    return f"SELECT '{c}' AS \"column\", {x} AS v FROM prop"


_HIST = PROP + """, hist AS (SELECT round(p, 6) AS p, count(CASE WHEN inadimplente = 1 THEN 1 END) AS pos,
  count(CASE WHEN inadimplente = 0 THEN 1 END) AS neg FROM prop GROUP BY round(p, 6)),
 cum AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cum_pos, sum(neg) OVER (ORDER BY p DESC) AS cum_neg,
  sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM hist),
 f AS (SELECT p, cum_pos / (cum_pos + cum_neg) AS pr, cum_pos / all_pos AS rc FROM cum),
 f1 AS (SELECT p, round(2 * (pr * rc) / (pr + rc + 1e-10), 12) AS f1 FROM f),
 best AS (SELECT p, f1 FROM f1 ORDER BY f1 DESC, p LIMIT 1),
 quality AS (SELECT round(sum(neg * ((cum_pos - pos) + pos / 2)) / (max(all_pos)::double * max(all_neg)), 8) AS auc,
  round(max(abs(cum_neg / all_neg - cum_pos / all_pos)), 8) AS ks FROM cum)
"""
_REPORT = """rep AS (SELECT count(CASE WHEN p < 0.3 AND inadimplente = 0 THEN 1 END) AS tn,
  count(CASE WHEN p >= 0.3 AND inadimplente = 0 THEN 1 END) AS fp,
  count(CASE WHEN p < 0.3 AND inadimplente = 1 THEN 1 END) AS fn,
  count(CASE WHEN p >= 0.3 AND inadimplente = 1 THEN 1 END) AS tp FROM prop),
 rates AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM rep)
"""

ORACLES = {
    "profile": PROP + " UNION ALL ".join(_profile_sql(c) for c in _NUMBERS),
    "profile_text": PROP + ", v AS (" + " UNION ALL ".join(_text_sql(c) for c in _TEXTS) + """),
        g AS (SELECT "column", v, count(*) AS k FROM v GROUP BY ALL)
        SELECT "column", coalesce(sum(CASE WHEN v IS NOT NULL THEN k END), 0) AS n,
         coalesce(sum(CASE WHEN v IS NULL THEN k END), 0) AS n_null, count(v) AS "unique",
         (SELECT h.v FROM g h WHERE h."column" = g."column" AND h.v IS NOT NULL ORDER BY h.k DESC, h.v LIMIT 1) AS top,
         max(CASE WHEN v IS NOT NULL THEN k END) AS freq FROM g GROUP BY "column" """,
    "label_counts": PROP + " SELECT inadimplente AS label, count(*) AS n FROM prop GROUP BY 1",
    "amount_summary": PROP + """ SELECT sum(inadimplente) AS label_sum,
        round(avg(inadimplente) * 100, 2) AS label_rate,
        round(sum(cast(ticket AS decimal(18,2)))::double / count(ticket), 6) AS amount_mean,
        sum(cast(ticket AS decimal(18,2)))::double AS amount_sum,
        min(ticket) AS amount_min, max(ticket) AS amount_max FROM prop""",
    "segment_default_rates": PROP + """ SELECT
        round(avg(CASE WHEN score < 400 THEN inadimplente END) * 100, 8) AS score_below_400,
        round(avg(CASE WHEN score > 850 THEN inadimplente END) * 100, 8) AS score_above_850,
        round(avg(CASE WHEN perc > 50 THEN inadimplente END) * 100, 8) AS commitment_above_50,
        round(avg(CASE WHEN perc < 20 THEN inadimplente END) * 100, 8) AS commitment_below_20 FROM prop""",
    "portfolio_summary": PROP + """ SELECT count(*) AS n_rows, round(avg(inadimplente) * 100, 6) AS default_rate,
        round(avg(score), 6) AS score_mean, round(avg(renda), 6) AS income_mean,
        round(sum(cast(ticket AS decimal(18,2)))::double / count(ticket), 6) AS ticket_mean,
        round(sum(cast(ticket AS decimal(18,2)))::double, 6) AS ticket_total,
        round(sum(cast(ticket * inadimplente * CASE tipo_credito WHEN 'CDC' THEN 0.55 WHEN 'Cartão' THEN 0.70
         WHEN 'Imobiliário' THEN 0.35 ELSE 0.60 END::double AS decimal(28,8)))::double, 6) AS expected_loss_total
        FROM prop""",
    "batch_results": P6 + f""" SELECT cliente_id, 'Cliente ' || cliente_id AS nome, ticket AS valor,
        p AS probabilidade_inadimplencia, score AS score_credito, {_RECOMMEND} AS decisao,
        {_REASON} AS motivo_rejeicao, CASE WHEN p > 0.5 THEN ticket * p ELSE 0 END AS perda_evitada,
        CASE WHEN p * 100 > 60 THEN 'Alto' WHEN p * 100 > 30 THEN 'Médio' ELSE 'Baixo' END AS risco_categoria
        FROM scored""",
    "batch_summary": P6 + f""", r AS (SELECT p, {_RECOMMEND} AS d, ticket FROM scored)
        SELECT count(*) AS total, count(CASE WHEN d = 'Aprovar' THEN 1 END) AS aprovados,
         count(CASE WHEN d = 'Negar' THEN 1 END) AS negados,
         round(count(CASE WHEN d = 'Aprovar' THEN 1 END) / count(*) * 100, 1) AS pct_aprovados,
         round(count(CASE WHEN d = 'Negar' THEN 1 END) / count(*) * 100, 1) AS pct_negados,
         round(avg(p * 100), 1) AS risco_medio,
         sum(cast(CASE WHEN p > 0.5 THEN ticket * p ELSE 0 END AS decimal(28,8)))::double AS perda_evitada_total
        FROM r""",
    "prediction_log_rollup": P6 + f""" SELECT '1.' || (proposta_id % 4) AS model_version,
        count(*) AS total_predictions,
        round(avg(CASE WHEN {_RECOMMEND} = 'Aprovar' THEN 1.0 ELSE 0.0 END), 6) AS approval_rate,
        round(avg(round(p * 100, 4)), 6) AS avg_risk_score,
        round(avg(5 + proposta_id % 40), 6) AS avg_processing_time FROM scored GROUP BY 1""",
    "class_weight": PROP + """ SELECT round(count(CASE WHEN inadimplente = 0 THEN 1 END)
        / count(CASE WHEN inadimplente = 1 THEN 1 END), 8) AS class_weight FROM prop""",
    "exact_auc": PROP + """, fine AS (SELECT inadimplente AS y,
         (950 - score) / 650.0::double + (proposta_id * 7919 % 999983) / 1e9::double AS f FROM prop),
        ranked AS (SELECT y, f, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0::double AS r FROM fine)
        SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y)::double * (sum(y) + 1) / 2)
         / (sum(y)::double * sum(1 - y)), 12) AS auc FROM ranked""",
    "histogram_auc": _HIST + "SELECT auc FROM quality",
    "ks_statistic": _HIST + "SELECT ks FROM quality",
    "pr_curve_best_f1": _HIST + "SELECT p AS threshold, round(f1, 8) AS f1 FROM best",
    "classification_report": PROP + ", " + _REPORT + """SELECT *, CASE WHEN precision + recall > 0
        THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates""",
    "cumulative_shares": _HIST + "SELECT * FROM cum",
    "evaluation_summary": _HIST + ", " + _REPORT + """SELECT auc, ks, (SELECT p FROM best) AS best_threshold,
        (SELECT round(f1, 8) FROM best) AS best_f1, tn, fp, fn, tp, round(precision, 8) AS precision,
        round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1
        FROM quality, rates""",
}
