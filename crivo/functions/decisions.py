"""From a default probability to classes, ladders, decisions, reasons and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col, fixed, ladder

# Fixed values: (upper bound of p in %, level, class, decision, provision %, colour, description).
LEVELS = (
    (0.5, "AA", "Risco Mínimo", "Aprovar", 0.0, "verde", "Excelente perfil de crédito"),
    (1.0, "A", "Risco Baixo", "Aprovar", 0.5, "verde", "Ótimo perfil de crédito"),
    (3.0, "B", "Risco Moderado", "Aprovar", 1.0, "verde", "Bom perfil de crédito"),
    (10.0, "C", "Risco Médio", "Revisar", 3.0, "amarelo", "Análise criteriosa necessária"),
    (30.0, "D", "Risco Alto", "Revisar com Restrições", 10.0, "laranja",
     "Exigir garantias adicionais"),
    (50.0, "E", "Risco Elevado", "Negar", 30.0, "vermelho", "Risco inaceitável"),
    (70.0, "F", "Risco Muito Elevado", "Negar", 50.0, "vermelho", "Risco crítico"),
    (100.0, "G", "Risco Crítico", "Negar", 70.0, "vermelho", "Inadimplência provável"),
    (None, "H", "Perda", "Negar", 100.0, "vermelho", "Inadimplência confirmada"),
)
LEVEL_FIELDS = ("nivel_bacen", "classificacao", "decisao", "provisao", "cor", "descricao")

# Fixed values: (upper bound of p, level, provision %, description).
DASHBOARD_LEVELS = (
    (0.01, "AA", 0.0, "Risco mínimo"),
    (0.03, "A", 0.5, "Risco baixo"),
    (0.10, "B", 1.0, "Risco moderado baixo"),
    (0.30, "C", 3.0, "Risco moderado"),
    (0.50, "D", 10.0, "Risco moderado alto"),
    (0.70, "E", 30.0, "Risco alto"),
    (0.90, "F", 50.0, "Risco muito alto"),
    (0.99, "G", 70.0, "Risco crítico"),
    (None, "H", 100.0, "Perda total"),
)
DASHBOARD_FIELDS = ("nivel", "provisao", "descricao")

# The three-band texts.
BAND_TEXTS = (
    "Aprovado - Baixo Risco", "Atenção - Risco Moderado", "Reprovado - Alto Risco",
)
# The score and probability texts shown for denied loans.
DENIED_SCORE_TEXTS = (
    (300, "Crítico - Risco AA (>50%)"),
    (500, "Muito Alto - Risco A (30-50%)"),
    (600, "Alto - Risco B (10-30%)"),
)
DENIED_SCORE_REST = "Médio"
DENIED_PROBABILITY_TEXTS = (
    (0.30, "Acima do limite aceitável (30%)"),
    (0.10, "Dentro do limite de revisão (10-30%)"),
)
DENIED_PROBABILITY_REST = "Dentro do limite aceitável (<10%)"
# One sentence per decision and rule, in order of priority.
APPROVE_TEXTS = (
    "Score excelente e baixo risco de inadimplência",
    "Bom score de crédito e perfil favorável",
    "Risco muito baixo de inadimplência",
    "Cliente fiel sem histórico de atrasos",
    "Perfil de crédito adequado para aprovação",
)
REVIEW_TEXTS = (
    "Histórico de atrasos leves - verificar justificativas",
    "Comprometimento de renda elevado - validar capacidade",
    "Relacionamento recente - avaliar histórico externo",
    "Risco médio-alto - análise criteriosa necessária",
    "Risco médio - validar garantias adicionais",
    "Score intermediário - avaliar outros fatores",
    "Perfil requer avaliação manual detalhada",
)
DENY_TEXTS = (
    "Score de crédito abaixo do mínimo aceitável",
    "Alta probabilidade de inadimplência",
    "Histórico crítico de atrasos recentes",
    "Valor incompatível com capacidade de pagamento",
    "Análise de risco desfavorável",
)


def prior_shifted(p: ColumnLike, trained: ColumnLike | float, prior: ColumnLike | float) -> Column:
    """A probability learned at one share of positives, stated for another.

    Class weights that balance the label teach a share of one half whatever the table's share is.
    The odds are scaled by the odds of the two shares; 0 and 1 stay, a share of 0 or 1 gives null.
    """
    p = as_col(p).cast("double")
    trained, prior = (F.lit(float(x)) if isinstance(x, (int, float)) else as_col(x) for x in (trained, prior))
    scale = F.try_divide(prior * (1 - trained), trained * (1 - prior))
    inside = (scale > 0) & p.between(0, 1)
    return F.when(inside, F.try_divide(p * scale, p * scale + (1 - p)))


def predicted_class(p: ColumnLike, threshold: float = 0.5) -> Column:
    return F.when(as_col(p) >= threshold, 1).otherwise(0)


def risk_score(p: ColumnLike) -> Column:
    return as_col(p) * 100


def recommendation(p: ColumnLike) -> Column:
    return ladder(as_col(p), ((0.10, "Aprovar"), (0.30, "Revisar")), "Negar", "<=")


def confidence(p: ColumnLike) -> Column:
    """Certainty of a decision, higher away from the decision limits, at most 1."""
    p = as_col(p)
    raw = (
        F.when(p < 0.20, F.lit(0.80) + (F.lit(0.20) - p))
        .when(p > 0.50, F.lit(0.80) + (p - 0.50))
        .otherwise(F.lit(0.60) + F.abs(p - 0.35) * 0.5)
    )
    return F.least(raw, F.lit(1.0))


def _level_struct(value: Column, rows: tuple, fields: tuple) -> Column:
    out = None
    for bound, *values in rows:
        level = F.struct(*(F.lit(v).alias(f) for v, f in zip(values, fields)))
        if bound is None:
            return out.otherwise(level)
        out = F.when(value <= bound, level) if out is None else out.when(value <= bound, level)
    raise ValueError("a ladder needs an open last row")


def bacen_level(p: ColumnLike, variant: str = "service") -> Column:
    """Regulatory nine-level ladder as a struct.

    ``service`` classifies p in percent; ``dashboard`` is the second, coarser ladder on p itself.
    """
    if variant == "service":
        return _level_struct(as_col(p) * 100, LEVELS, LEVEL_FIELDS)
    if variant == "dashboard":
        return _level_struct(as_col(p), DASHBOARD_LEVELS, DASHBOARD_FIELDS)
    raise ValueError(f"unknown variant {variant!r}")


def risk_band3(p: ColumnLike, variant: str = "service") -> Column:
    """Three-band text; ``test`` uses the wider cuts 0.4 and 0.7."""
    if variant == "service":
        value, cuts = as_col(p) * 100, (10.0, 30.0)
    elif variant == "test":
        value, cuts = as_col(p), (0.4, 0.7)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return ladder(value, zip(cuts, BAND_TEXTS), BAND_TEXTS[-1], "<=")


def batch_risk_category(p: ColumnLike) -> Column:
    return ladder(as_col(p) * 100, ((60, "Alto"), (30, "Médio")), "Baixo", ">")


def level_from_days_past_due(days: ColumnLike) -> Column:
    """Minimum level by days of delay; NULL below 15 days, where delay sets no minimum."""
    days = as_col(days)
    steps = ((180, "H"), (150, "G"), (120, "F"), (90, "E"), (60, "D"), (30, "C"))
    return F.coalesce(ladder(days, steps, None, ">"), F.when(days >= 15, "B"))


def decision_from_score(score: ColumnLike) -> Column:
    score = as_col(score)
    return (
        F.when(score < 300, "Negar")
        .when(score < 500, "Revisar com Restrições")
        .when(score < 700, "Revisar")
        .when(score <= 850, "Aprovar")
        .when(score > 850, "Aprovar com Benefícios")
    )


def denied_score_text(score: ColumnLike) -> Column:
    return ladder(as_col(score), DENIED_SCORE_TEXTS, DENIED_SCORE_REST, "<")


def denied_probability_text(p: ColumnLike) -> Column:
    return ladder(as_col(p), DENIED_PROBABILITY_TEXTS, DENIED_PROBABILITY_REST, ">")


def denial_reasons(
    score: ColumnLike, p: ColumnLike, late: ColumnLike, ticket: ColumnLike,
    income: ColumnLike, months: ColumnLike,
) -> Column:
    """Every reason that applies, as an array of sentences."""
    score, p, late = as_col(score), as_col(p), as_col(late)
    ticket, income, months = as_col(ticket), as_col(income), as_col(months)
    reasons = F.array(
        F.when(
            score < 600,
            F.format_string(
                "Score de crédito %d abaixo do mínimo regulatório (600 pontos)", score.cast("bigint")
            ),
        ),
        F.when(
            p > 0.5,
            F.concat(
                F.lit("Probabilidade de inadimplência de "), fixed(p * 100, 1),
                F.lit("% excede limite de 30%"),
            ),
        ),
        F.when(
            late > 2, F.format_string("Histórico de %d atrasos nos últimos 12 meses", late.cast("bigint"))
        ),
        F.when(
            ticket > income * 5,
            F.concat(
                F.lit("Comprometimento de renda: "), fixed(F.try_divide(F.try_divide(ticket, months), income) * 100, 1),
                F.lit("% (limite: 30%)"),
            ),
        ),
    )
    return F.array_compact(reasons)


def _first_text(rules: tuple, texts: tuple) -> Column:
    """Text of the first rule that holds; the last text needs no rule."""
    out = None
    for rule, text in zip(rules, texts):
        out = F.when(rule, text) if out is None else out.when(rule, text)
    return out.otherwise(texts[-1])


def decision_reason(
    decision: ColumnLike, score: ColumnLike, p: ColumnLike, late: ColumnLike,
    tenure: ColumnLike, ticket: ColumnLike, income: ColumnLike,
) -> Column:
    """One sentence per decision; empty for decisions without a rule list."""
    decision, score, p, late = as_col(decision), as_col(score), as_col(p), as_col(late)
    tenure, ticket, income = as_col(tenure), as_col(ticket), as_col(income)
    approve = (
        score >= 800,
        score >= 700,
        p < 0.15,
        (late == 0) & (tenure >= 24),
    )
    review = (
        (late > 0) & (late <= 2),
        (ticket > income * 3) & (ticket <= income * 5),
        tenure < 12,
        (p >= 0.4) & (p < 0.5),
        (p >= 0.3) & (p < 0.4),
        (score >= 600) & (score < 700),
    )
    deny = (
        score < 600,
        p > 0.7,
        late > 3,
        ticket > income * 5,
    )
    return (
        F.when(decision == "Aprovar", _first_text(approve, APPROVE_TEXTS))
        .when(decision == "Revisar", _first_text(review, REVIEW_TEXTS))
        .when(decision == "Negar", _first_text(deny, DENY_TEXTS))
        .otherwise("")
    )


def avoided_loss(decision: ColumnLike, p: ColumnLike, ticket: ColumnLike) -> Column:
    denied = (as_col(decision) == "Negar") & (as_col(p) > 0.5)
    return F.when(denied, as_col(ticket) * as_col(p)).otherwise(F.lit(0.0))


def expected_loss_pd(ticket: ColumnLike, p: ColumnLike) -> Column:
    return as_col(ticket) * as_col(p)


def provision(ticket: ColumnLike, p: ColumnLike) -> Column:
    return as_col(ticket) * as_col(p) * K.PROVISION_FACTOR


def score_response(
    df: DataFrame, p: str = "p", threshold: float = 0.5, model_version: str = "1.0.0",
    explainability: dict[str, float] | None = None, at: Column | None = None,
) -> DataFrame:
    """Response record of a scored proposal: rounded numbers, decision, version and time."""
    prob = F.col(p)
    weights = explainability or {}
    explained = (
        F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        if weights
        else F.lit(None).cast("map<string,double>")
    )
    return df.withColumns(
        {
            "prediction": predicted_class(prob, threshold),
            "probability": F.round(prob, 4),
            "risk_score": F.round(risk_score(prob), 2),
            "recommendation": recommendation(prob),
            "confidence": F.round(confidence(prob), 4),
            "threshold": F.lit(float(threshold)),
            "model_version": F.lit(model_version),
            "timestamp": F.current_timestamp() if at is None else at,
            "explainability": explained,
        }
    )


def client_or(client: ColumnLike, prefix: str, columns: list[str]) -> Column:
    """The client id, or a stand-in made from the row's content when it is missing."""
    number = F.pmod(F.xxhash64(*columns), F.lit(100_000)).cast("string")
    return F.coalesce(
        F.nullif(as_col(client), F.lit("")), F.concat(F.lit(prefix), number)
    )


def batch_result(df: DataFrame, p: str = "p") -> DataFrame:
    """Nine-column row of the batch page, from a proposal with a probability."""
    prob, decision = F.col(p), recommendation(p)
    name = F.col("nome") if "nome" in df.columns else F.lit(None).cast("string")
    client = client_or("cliente_id", "CLI-", ["score", "ticket", "renda", "prazo_meses"])
    return df.select(
        client.alias("cliente_id"),
        F.coalesce(name, F.concat(F.lit("Cliente "), client)).alias("nome"),
        F.col("ticket").alias("valor"),
        prob.alias("probabilidade_inadimplencia"),
        F.col("score").alias("score_credito"),
        decision.alias("decisao"),
        decision_reason(
            decision, "score", prob, "qtd_atrasos_12m", "tempo_cliente_meses", "ticket", "renda"
        ).alias("motivo_rejeicao"),
        avoided_loss(decision, prob, "ticket").alias("perda_evitada"),
        batch_risk_category(prob).alias("risco_categoria"),
    )
