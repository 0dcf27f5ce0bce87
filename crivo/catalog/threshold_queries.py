"""Threshold analytics over the proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo import constants as K
from crivo.catalog.fixture_sql import PROP
from crivo.operators import thresholds as T
from crivo.sources.star import proposals

_GRID = ", ".join(f"({t!r}::double)" for t in K.SENSITIVITY_GRID)
_ROC = ", ".join(f"({t!r}::double)" for t in K.ROC_GRID)

# Metrics per threshold; {grid} is the list of thresholds, {rows} the table of loans.
_METRICS = """
, grid(t) AS (VALUES {grid}),
m AS (
 SELECT t, count(sn_ticket) AS total,
  count(CASE WHEN sn >= t THEN 1 END) AS approved,
  count(CASE WHEN sn >= t AND y = 1 THEN 1 END) AS approved_bad,
  coalesce(sum(CASE WHEN sn >= t THEN d END), 0)::double AS revenue,
  coalesce(sum(CASE WHEN sn >= t AND y = 1 THEN d END), 0)::double AS losses,
  coalesce(sum(CASE WHEN NOT coalesce(sn >= t, false) AND y = 0 THEN d END), 0)::double AS missed,
  coalesce(sum(CASE WHEN NOT coalesce(sn >= t, false) AND y = 1 THEN d END), 0)::double AS avoided,
  coalesce(sum(d), 0)::double AS money_all, count(d) AS n_money
 FROM grid LEFT JOIN (SELECT 1 AS sn_ticket, sn, inadimplente AS y,
   cast(ticket AS decimal(18,2)) AS d FROM {rows}) ON true
 GROUP BY t),
metrics AS (
 SELECT revenue - losses AS "saldoLiquido",
  round(CASE WHEN total > 0 THEN approved / total * 100 ELSE 0 END, 1) AS "taxaAprovacao",
  round(CASE WHEN approved > 0 THEN approved_bad / approved * 100 ELSE 0 END, 1) AS "taxaInadimplencia",
  total AS "totalClientes", approved AS "clientesAprovados", total - approved AS "clientesRejeitados",
  revenue AS "receitaTotal", losses AS "perdasInadimplencia", missed AS "oportunidadesPerdidas",
  avoided AS "perdasEvitadas",
  CASE WHEN n_money > 0 THEN money_all / n_money ELSE 0.0::double END AS "valorMedio",
  t AS threshold
 FROM m)
"""


def _metrics(grid: str, rows: str = "prop") -> str:
    return PROP + _METRICS.format(grid=grid, rows=rows)


def _at(t: float) -> str:
    return f"({t!r}::double)"


_CONFUSION = PROP + """
, c AS (SELECT
  count(CASE WHEN sn < 0.5 AND inadimplente = 1 THEN 1 END) AS tp,
  count(CASE WHEN sn < 0.5 AND inadimplente = 0 THEN 1 END) AS fp,
  count(CASE WHEN sn >= 0.5 AND inadimplente = 0 THEN 1 END) AS tn,
  count(CASE WHEN sn >= 0.5 AND inadimplente = 1 THEN 1 END) AS fn FROM prop),
r AS (SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END AS pr,
  CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END AS rc FROM c)
SELECT tp, fp, tn, fn, round((tp+tn)/(tp+fp+tn+fn)*100, 2) AS accuracy,
 round(pr*100, 2) AS precision, round(rc*100, 2) AS recall,
 round(CASE WHEN pr+rc > 0 THEN 2*(pr*rc)/(pr+rc) ELSE 0 END*100, 2) AS f1_score,
 0.5::double AS threshold FROM r
"""

_ROC_ROWS = PROP + f"""
, grid(t) AS (VALUES {_ROC}),
roc AS (SELECT t AS threshold,
  count(CASE WHEN sn < t AND inadimplente = 0 THEN 1 END) / count(CASE WHEN inadimplente = 0 THEN 1 END) AS fpr,
  count(CASE WHEN sn < t AND inadimplente = 1 THEN 1 END) / count(CASE WHEN inadimplente = 1 THEN 1 END) AS tpr
 FROM prop CROSS JOIN grid GROUP BY t)
"""

_VALUES = {
    "profit": '"saldoLiquido"',
    "risk": '-"taxaInadimplencia"',
    "balanced": '"taxaAprovacao" - "taxaInadimplencia" * 10',
}


def _round_balanced(df):
    return df.withColumn("value", F.round("value", 6))


QUERIES = {
    "threshold_metrics": lambda s, d: T.threshold_metrics(proposals(s, d), 0.5),
    "threshold_metrics_empty": lambda s, d: T.threshold_metrics(
        proposals(s, d).filter("ticket < 0"), 0.5
    ),
    "threshold_metrics_all_rejected": lambda s, d: T.threshold_metrics(proposals(s, d), 1.01),
    "confusion_matrix": lambda s, d: T.confusion_matrix(proposals(s, d), 0.5),
    "roc_curve": lambda s, d: T.roc_curve(proposals(s, d)),
    "roc_auc_grid": lambda s, d: T.roc_auc_grid(T.roc_curve(proposals(s, d))).select(
        F.round("auc", 8).alias("auc")
    ),
    "threshold_sensitivity": lambda s, d: T.threshold_sensitivity(proposals(s, d)),
    "threshold_candidates_balanced": lambda s, d: _round_balanced(
        T.threshold_candidates(proposals(s, d), "balanced")
    ),
    "optimize_threshold_profit": lambda s, d: T.optimize_threshold(proposals(s, d), "profit"),
    "optimize_threshold_risk": lambda s, d: T.optimize_threshold(proposals(s, d), "risk"),
    "optimize_threshold_balanced": lambda s, d: T.optimize_threshold(
        proposals(s, d), "balanced"
    ).withColumn("best_value", F.round("best_value", 6)),
    "score_distribution": lambda s, d: T.score_distribution(proposals(s, d)),
    "approval_split": lambda s, d: T.approval_split(proposals(s, d), 0.5),
}

_BEST = """
SELECT round(threshold, 2) AS optimal_threshold, '{name}' AS objective, {value} AS best_value, metrics.*
FROM metrics ORDER BY {order} DESC, threshold LIMIT 1
"""

ORACLES = {
    "threshold_metrics": _metrics(_at(0.5)) + "SELECT * FROM metrics",
    "threshold_metrics_empty": _metrics(_at(0.5), "prop WHERE ticket < 0") + "SELECT * FROM metrics",
    "threshold_metrics_all_rejected": _metrics(_at(1.01)) + "SELECT * FROM metrics",
    "confusion_matrix": _CONFUSION,
    "roc_curve": _ROC_ROWS + "SELECT * FROM roc",
    "roc_auc_grid": _ROC_ROWS + """, seg AS (SELECT (fpr - lag(fpr) OVER (ORDER BY threshold))
      * (tpr + lag(tpr) OVER (ORDER BY threshold)) / 2 AS a FROM roc)
      SELECT round(abs(sum(a)), 8) AS auc FROM seg""",
    "threshold_sensitivity": _metrics(_GRID) + """SELECT round(threshold, 2) AS threshold,
      "taxaAprovacao", "taxaInadimplencia", "saldoLiquido", "perdasEvitadas",
      "oportunidadesPerdidas" FROM metrics""",
    "threshold_candidates_balanced": _metrics(_GRID)
    + f"SELECT *, round({_VALUES['balanced']}, 6) AS value FROM metrics",
    "optimize_threshold_profit": _metrics(_GRID)
    + _BEST.format(name="profit", value=_VALUES["profit"], order=_VALUES["profit"]),
    "optimize_threshold_risk": _metrics(_GRID)
    + _BEST.format(name="risk", value=_VALUES["risk"], order=_VALUES["risk"]),
    "optimize_threshold_balanced": _metrics(_GRID)
    + _BEST.format(
        name="balanced", value=f"round({_VALUES['balanced']}, 6)", order=_VALUES["balanced"]
    ),
    "score_distribution": PROP + "SELECT score, count(*) AS n FROM prop GROUP BY score",
    "approval_split": _metrics(_at(0.5)) + """SELECT "clientesAprovados" AS aprovados,
      "clientesRejeitados" AS rejeitados,
      round("clientesAprovados" / "totalClientes" * 100, 1) AS pct_aprovados,
      round("clientesRejeitados" / "totalClientes" * 100, 1) AS pct_rejeitados,
      least("taxaAprovacao", 100) AS meta_aprovacao,
      greatest(0, 100 - "taxaInadimplencia" * 10) AS meta_inadimplencia,
      CASE WHEN "taxaInadimplencia" < 3 THEN 'Baixo' ELSE 'Alto' END AS faixa_inadimplencia
      FROM metrics""",
}
