"""Feature, decision, pricing and scorecard columns over the proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo import constants as K
from crivo.catalog.fixture_sql import PROP, step_case, values_rows
from crivo.functions import decisions as D
from crivo.functions import features as X
from crivo.functions import pricing as P
from crivo.functions import scorecards as S
from crivo.sources.star import proposals, raw_proposals

_ACCENTS = f"translate({{}}, '{X.ACCENTED}', '{X.PLAIN}')"
_DAYS = "cast(proposta_id % 400 AS int)"
_MONTH = "concat('2022', lpad(cast(1 + proposta_id % 12 AS varchar(2)), 2, '0'))"


def _select(body: str, tail: str = "FROM prop") -> str:
    return f"{PROP} SELECT proposta_id, {body} {tail}"


def scored(spark, folder):
    """Proposals whose risk is rounded to six digits, so later arithmetic is the same everywhere."""
    return proposals(spark, folder).withColumn("p", F.round("p", 6))


SCORED = "FROM (SELECT * REPLACE (round(p, 6) AS p) FROM prop)"


def _days():
    return (F.col("proposta_id") % 400).cast("int")


def _month():
    number = (F.lit(1) + F.col("proposta_id") % 12).cast("string")
    return F.concat(F.lit("2022"), F.lpad(number, 2, "0"))


# --- features ---------------------------------------------------------------------------------
def installment(spark, folder):
    return raw_proposals(spark, folder).select(
        "proposta_id",
        F.round(X.installment("ticket", "taxa_juros_aa", "prazo_meses"), 4).alias("parcela"),
        F.round(X.installment("ticket", F.lit(0.0), "prazo_meses"), 8).alias("parcela_sem_juros"),
    )


def affordability(spark, folder):
    return X.with_features(raw_proposals(spark, folder)).select(
        "proposta_id",
        F.round("perc_comprometimento_renda", 6).alias("perc"),
        "alto_comprometimento",
        F.round("fator_risco", 8).alias("fator_risco"),
        "faixa_etaria",
        F.round(X.score_norm("score"), 8).alias("score_norm"),
        X.age_band(F.col("idade") + 40, open_ended=False).alias("faixa_fechada"),
        X.score_high("score").alias("score_alto"),
        F.round(X.ticket_income_ratio("ticket", "renda"), 6).alias("renda_ticket_ratio"),
    )


_BAND = "CASE WHEN {x} <= 25 THEN '18-25' WHEN {x} <= 35 THEN '26-35' WHEN {x} <= 45 THEN '36-45' " \
        "WHEN {x} <= 55 THEN '46-55' WHEN {x} <= 65 THEN '56-65' ELSE '66+' END"


def default_codes(spark, folder):
    rows = X.with_features(raw_proposals(spark, folder))
    folded = {f"{c}_encoded": X.default_code(c, c) for c in K.ENCODED_COLUMNS}
    strict = {f"{c}_strict": X.default_code(c, c, fold=False) for c in K.ENCODED_COLUMNS}
    return rows.withColumns(folded | strict).select("proposta_id", *folded, *strict)


def _code_sql(column: str, fold: bool) -> str:
    source = _BAND.format(x="idade") if column == "faixa_etaria" else column
    value = _ACCENTS.format(source)
    whens = " ".join(
        f"WHEN {_ACCENTS.format(repr(label)) if fold else repr(label)} THEN {code}"
        for code, label in enumerate(K.DEFAULT_LABEL_MAPS[column])
    )
    return f"CASE {value} {whens} ELSE 0 END AS {column}_{'encoded' if fold else 'strict'}"


def accents(spark, folder):
    return raw_proposals(spark, folder).select(
        "proposta_id",
        *(X.strip_accents(c).alias(f"{c}_plain")
          for c in ("estado_civil", "escolaridade", "porte_municipio", "tipo_credito")),
        X.strip_accents(F.concat(F.lit("Ação ÁÉÍÓÚ ãõâêô "), F.col("regiao"))).alias("mixed"),
    )


def month_parts(spark, folder):
    rows = raw_proposals(spark, folder).withColumn("mes", _month())
    return rows.select(
        "proposta_id", "mes", X.month_number("mes").alias("mes_num"),
        X.season_factor("mes").alias("fator_sazonal"),
        F.round(X.month_index("mes"), 8).alias("mes_index"),
    )


# --- decisions --------------------------------------------------------------------------------
def prediction(spark, folder):
    return proposals(spark, folder).select(
        "proposta_id", D.predicted_class("p").alias("prediction"),
        F.round(D.risk_score("p"), 10).alias("risk_score"),
        D.recommendation("p").alias("recommendation"),
        F.round(D.confidence("p"), 10).alias("confidence"),
    )


_RECOMMEND = "CASE WHEN p <= 0.10 THEN 'Aprovar' WHEN p <= 0.30 THEN 'Revisar' ELSE 'Negar' END"
_CONFIDENCE = ("least(CASE WHEN p < 0.20 THEN 0.80 + (0.20 - p) WHEN p > 0.50 THEN 0.80 + (p - 0.50) "
               "ELSE 0.60 + abs(p - 0.35) * 0.5 END, 1.0)")


def score_response(spark, folder):
    weights = {"score": 0.35, "renda": 0.25}
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return D.score_response(
        proposals(spark, folder), "p", 0.5, "1.0.0", weights, at
    ).select(
        "proposta_id", "cliente_id", "prediction", "probability", "risk_score", "recommendation",
        "confidence", "threshold", "model_version", "timestamp",
        F.col("explainability")["score"].alias("peso_score"),
        F.size("explainability").alias("n_pesos"),
    )


def bacen_level(spark, folder):
    rows = proposals(spark, folder).withColumn("level", D.bacen_level("p"))
    return rows.select("proposta_id", "level.*")


def bacen_level_dashboard(spark, folder):
    rows = proposals(spark, folder).withColumn("level", D.bacen_level("p", "dashboard"))
    return rows.select("proposta_id", "level.*")


def _level_case(rows, field: int, x: str) -> str:
    bounded = [(r[0], r[field]) for r in rows if r[0] is not None]
    return step_case(x, bounded, rows[-1][field], "<=")


def risk_bands(spark, folder):
    return proposals(spark, folder).select(
        "proposta_id", D.risk_band3("p").alias("faixa"),
        D.risk_band3("p", "test").alias("faixa_teste"),
        D.batch_risk_category("p").alias("categoria"),
    )


def delay_and_score_rules(spark, folder):
    return proposals(spark, folder).select(
        "proposta_id", D.level_from_days_past_due(_days()).alias("nivel_atraso"),
        D.decision_from_score(F.col("score") - 100).alias("decisao_score"),
        D.denied_score_text(F.col("score") - 100).alias("texto_score"),
        D.denied_probability_text("p").alias("texto_probabilidade"),
    )


def denial_reasons(spark, folder):
    reasons = D.denial_reasons("score", "p", "qtd_atrasos_12m", "ticket", "renda", "prazo_meses")
    rows = proposals(spark, folder).withColumn("r", reasons)
    return rows.select(
        "proposta_id", F.size("r").alias("n_motivos"), F.array_join("r", " | ").alias("motivos")
    )


_ONE_DIGIT = "cast(cast(round({x}, 1) AS decimal(20,1)) AS varchar)"


def decision_reason(spark, folder):
    decision = D.recommendation("p")
    return scored(spark, folder).select(
        "proposta_id", decision.alias("decisao"),
        D.decision_reason(
            decision, "score", "p", "qtd_atrasos_12m", "tempo_cliente_meses", "ticket", "renda"
        ).alias("motivo"),
        D.avoided_loss(decision, "p", "ticket").alias("perda_evitada"),
        D.expected_loss_pd("ticket", "p").alias("perda_esperada"),
        D.provision("ticket", "p").alias("provisao"),
    )


def _reason_case(rules, texts) -> str:
    whens = " ".join(f"WHEN {r} THEN '{t}'" for r, t in zip(rules, texts))
    return f"CASE {whens} ELSE '{texts[-1]}' END"


_REASON = f"""CASE {_RECOMMEND}
 WHEN 'Aprovar' THEN {_reason_case(("score >= 800", "score >= 700", "p < 0.15",
   "qtd_atrasos_12m = 0 AND tempo_cliente_meses >= 24"), D.APPROVE_TEXTS)}
 WHEN 'Revisar' THEN {_reason_case(("qtd_atrasos_12m > 0 AND qtd_atrasos_12m <= 2",
   "ticket > renda * 3 AND ticket <= renda * 5", "tempo_cliente_meses < 12",
   "p >= 0.4 AND p < 0.5", "p >= 0.3 AND p < 0.4", "score >= 600 AND score < 700"), D.REVIEW_TEXTS)}
 ELSE {_reason_case(("score < 600", "p > 0.7", "qtd_atrasos_12m > 3", "ticket > renda * 5"),
   D.DENY_TEXTS)} END"""


# --- pricing ----------------------------------------------------------------------------------
def product_rates(spark, folder):
    rows = P.with_product_rates(raw_proposals(spark, folder))
    literal = P.product_rates("tipo_credito", literal=True)
    return rows.select(
        "proposta_id", "taxa_minima", "taxa_media", "taxa_maxima", "taxa_banco",
        literal["taxa_minima"].alias("literal_minima"),
        literal["taxa_banco"].alias("literal_banco"),
        P.product_code("tipo_credito").alias("codigo"),
        P.product_display(P.product_code("tipo_credito")).alias("exibicao"),
    )


_RATES = ", rates(code, display, name, lo, mean, hi, bank) AS (VALUES " + values_rows(
    [(code, *row) for code, row in K.PRODUCT_RATES.items()]
) + ")"
_RATE_JOIN = "FROM prop LEFT JOIN rates ON display = tipo_credito"


def min_profitable_rate(spark, folder):
    return proposals(spark, folder).select(
        "proposta_id", P.min_profitable_rate("ticket", "prazo_meses", "p").alias("taxa_minima"),
        P.min_profitable_rate("ticket", "prazo_meses", "p", 10.0, 8.0).alias("taxa_alternativa"),
    )


def _min_rate_sql(chance: str, funding: float = K.FUNDING_RATE, margin: float = K.MIN_MARGIN):
    years = "(prazo_meses / 12.0::double)"
    return (
        f"ceil((ticket * {funding / 100!r}::double * {years} + ticket * ({chance}) * 1.5::double "
        f"+ ticket * 0.0075::double + ticket * {margin / 100!r}::double) / ticket / {years} * 100 "
        "* 10) / 10.0::double"
    )


def profitability(spark, folder):
    rows = scored(spark, folder).withColumn(
        "r", P.profitability("ticket", "prazo_meses", "taxa_juros_aa", "p")
    )
    money = ("receita_juros", "custo_captacao", "provisao_bacen", "custos_operacionais",
             "lucro_liquido", "roi")
    return rows.select(
        "proposta_id", *(F.col("r")[c].alias(c) for c in money),
        F.col("r.taxa_minima_rentavel").alias("taxa_minima_rentavel"),
        F.col("r.aprovavel").cast("int").alias("aprovavel"),
    )


_PROFIT = f"""SELECT *, ticket * (taxa_juros_aa / 100) * (prazo_meses / 12.0::double) AS receita,
 ticket * {K.FUNDING_RATE / 100!r}::double * (prazo_meses / 12.0::double) AS captacao,
 ticket * p * 1.5::double AS reserva, ticket * 0.0075::double AS operacao,
 {_min_rate_sql("p")} AS minima {SCORED}"""


def rate_factors(spark, folder):
    percent = X.income_commitment(
        X.installment("ticket", P.product_rates("tipo_credito")["taxa_banco"], "prazo_meses"),
        "renda",
    )
    return raw_proposals(spark, folder).select(
        "proposta_id", P.score_rate_factor("score").alias("fator_score"),
        P.value_rate_factor("ticket", "tipo_credito").alias("fator_valor"),
        P.term_rate_factor("prazo_meses", "tipo_credito").alias("fator_prazo"),
        P.commitment_rate_factor(percent).alias("fator_comprometimento"),
        P.pd_from_score("score").alias("pd_score"),
    )


def _by_product_sql(x: str, tables: dict) -> str:
    whens = " ".join(
        f"WHEN '{code}' THEN {step_case(x, steps, rest, '>=')}"
        for code, (steps, rest) in tables.items()
    )
    return f"(CASE code {whens} ELSE 1.0 END)::double"


_F_SCORE = f"({step_case('score', *P.SCORE_FACTORS, '>=')})::double"
_F_PD = f"({step_case('score', *P.SCORE_PDS, '>=')})::double"
_F_VALUE = _by_product_sql("ticket", P.VALUE_FACTORS)
_F_TERM = _by_product_sql("prazo_meses", P.TERM_FACTORS)
_BANK_PAYMENT = ("ticket * (bank/12/100 * power(1 + bank/12/100, prazo_meses)) "
                 "/ (power(1 + bank/12/100, prazo_meses) - 1)")
_F_COMMIT = f"({step_case(f'({_BANK_PAYMENT}) / renda * 100', *P.COMMITMENT_FACTORS, '>=')})::double"
_PRICED = f"""{_RATES}, base_rate AS (SELECT prop.*, code, display, name, lo::double AS lo, mean::double AS mean,
  hi::double AS hi, bank::double AS bank {_RATE_JOIN}),
 chance AS (SELECT *, CASE WHEN {{p}} IS NULL OR {{p}} = 0 THEN {_F_PD} ELSE {{p}} END AS ch,
  {_F_SCORE} AS fs, {_F_VALUE} AS fv, {_F_TERM} AS ft, {_F_COMMIT} AS fc FROM base_rate),
 floors AS (SELECT *, {_min_rate_sql("ch")} AS fl FROM chance),
 priced AS (SELECT *, greatest(floor(greatest(lo, least(greatest(bank * fs * fv * ft * fc, fl), mean * 2.0::double))
   * 2 + 0.5) / 2.0::double, ceil(fl * 2) / 2.0::double) AS rate FROM floors)
"""


def suggested_rate(spark, folder):
    rows = proposals(spark, folder)
    chance = F.when(F.col("proposta_id") % 5 == 0, F.lit(0.0)).otherwise(F.col("p"))
    rows = P.with_suggested_rate(rows, p=chance, out="s")
    return rows.select(
        "proposta_id", "s.taxa_sugerida", "s.taxa_minima", "s.taxa_maxima",
        "s.taxa_minima_rentavel", F.round("s.probabilidade", 6).alias("probabilidade"),
    )


_CHANCE = "CASE WHEN proposta_id % 5 = 0 THEN 0 ELSE p END"


def rate_range(spark, folder):
    rows = raw_proposals(spark, folder).withColumn("r", P.rate_range("tipo_credito", "score"))
    return rows.select("proposta_id", "r.*")


def _checked_rate():
    return F.round(F.col("taxa_juros_aa") * F.when(F.col("proposta_id") % 3 == 0, 25.0).otherwise(2.0), 2)


def check_rate(spark, folder):
    product = F.when(F.col("proposta_id") % 11 == 0, "Consignado").otherwise(F.col("tipo_credito"))
    rows = raw_proposals(spark, folder).withColumn("r", P.check_rate(product, _checked_rate()))
    return rows.select(
        "proposta_id", F.col("r.valida").cast("int").alias("valida"), "r.nivel", "r.mensagem",
        "r.taxa_corrigida",
    )


def rate_explanation(spark, folder):
    rows = P.with_suggested_rate(proposals(spark, folder), p="p", out="s")
    text = P.rate_explanation("tipo_credito", "ticket", "score", "prazo_meses", F.col("s"))
    return rows.select("proposta_id", text.alias("texto"))


def _money_sql(x: str) -> str:
    whole = f"cast(trunc(round({x}, 3)) AS bigint)"
    cents = (f"rtrim(split_part(cast(cast(round({x}, 3) AS decimal(30,3)) AS varchar), '.', 2), '0')")
    return (f"(replace(format('{{:,}}', {whole}), ',', '.') || CASE WHEN {cents} = '' THEN '' "
            f"ELSE ',' || {cents} END)")


def _zero_digits(x: str) -> str:
    return f"cast(cast(round({x}, 0) AS bigint) AS varchar)"


_EXPLAIN = f"""concat_ws(chr(10), 'Taxa calculada automaticamente:' || chr(10),
 '• Risco estimado: ' || {_ONE_DIGIT.format(x="ch * 100")} || '% de inadimplência',
 '• Taxa mínima rentável: ' || {_ONE_DIGIT.format(x="fl")} || '% a.a.' || chr(10),
 '• Taxa média ' || tipo_credito || ': ' || {_ONE_DIGIT.format(x="bank")} || '% a.a. (BACEN)',
 CASE WHEN fs < 1 THEN '• Score ' || score || ': Excelente (-' || {_zero_digits("(1 - fs) * 100")} || '%)'
  ELSE '• Score ' || score || ': Risco padrão' END,
 CASE WHEN fv < 1 THEN '• Valor R$ ' || {_money_sql("ticket")} || ': Alto valor (-' || {_zero_digits("(1 - fv) * 100")} || '%)'
  WHEN fv > 1 THEN '• Valor R$ ' || {_money_sql("ticket")} || ': Baixo valor (+' || {_zero_digits("(fv - 1) * 100")} || '%)' END,
 CASE WHEN ft < 1 THEN '• Prazo ' || prazo_meses || ' meses: Curto prazo (-' || {_zero_digits("(1 - ft) * 100")} || '%)'
  WHEN ft > 1 THEN '• Prazo ' || prazo_meses || ' meses: Longo prazo (+' || {_zero_digits("(ft - 1) * 100")} || '%)' END,
 CASE WHEN fc > 1 THEN '• Comprometimento de renda elevado (+' || {_zero_digits("(fc - 1) * 100")} || '%)' END,
 chr(10) || '**Taxa sugerida: ' || {_ONE_DIGIT.format(x="rate")} || '% a.a.**',
 '(Mínima produto: ' || {_ONE_DIGIT.format(x="lo")} || '% | Mínima rentável: ' || {_ONE_DIGIT.format(x="fl")} || '%)')"""


def profitability_override(spark, folder):
    rows = proposals(spark, folder).withColumn(
        "o",
        P.profitability_override(
            D.recommendation("p"), D.predicted_class("p"), "ticket", "prazo_meses",
            F.col("taxa_juros_aa") * 3, "p",
        ),
    )
    return rows.select("proposta_id", "o.*")


# --- scorecards -------------------------------------------------------------------------------
def scorecards(spark, folder):
    rows = proposals(spark, folder)
    ratio = F.col("ticket") / (F.col("renda") * 12)
    return rows.select(
        "proposta_id",
        F.round(
            S.scorecard_weighted("score", "perc", "qtd_atrasos_12m", "tempo_cliente_meses"), 8
        ).alias("ponderado"),
        F.round(
            S.scorecard_additive(
                "score", "renda", "ticket", "prazo_meses", "tipo_credito", "tempo_cliente_meses",
                "qtd_produtos", _month(),
            ), 8,
        ).alias("aditivo"),
        F.round(
            S.scorecard_multiplicative("score", "renda", ratio, "tipo_credito"), 8
        ).alias("multiplicativo"),
        F.round(S.scorecard_simple("score"), 8).alias("simples"),
    )


_ADDITIVE = f"""least(greatest((950 - score) / 850.0::double * 0.12::double
 + CASE WHEN renda < 2000 THEN 0.08 WHEN renda < 3500 THEN 0.015 ELSE 0 END
 + CASE WHEN ticket > 200000 THEN 0.02 WHEN ticket > 100000 THEN 0.01 ELSE 0 END
 + prazo_meses / 360.0::double * 0.02::double
 + CASE tipo_credito WHEN 'Cartão' THEN 0.04 WHEN 'CDC' THEN 0.02 WHEN 'Pessoal' THEN 0.025 ELSE -0.02 END
 + CASE WHEN tempo_cliente_meses > 36 THEN -0.02 WHEN tempo_cliente_meses > 12 THEN -0.01 ELSE 0 END
 + CASE WHEN qtd_produtos >= 3 THEN -0.015 ELSE 0 END
 + CASE proposta_id % 12 WHEN 11 THEN 0.020 WHEN 0 THEN 0.015 WHEN 1 THEN 0.015 WHEN 5 THEN -0.005 WHEN 6 THEN -0.005 ELSE 0 END
 + (proposta_id % 12) / 11.0::double * 0.01::double, 0.005), 0.25)"""
_MULTIPLICATIVE = """least(greatest(0.068::double * (1 + (950 - score) / 650.0::double * 0.5
 + CASE WHEN renda < 2000 THEN 0.3 ELSE 0 END + CASE WHEN ticket / (renda * 12) > 1 THEN 0.2 ELSE 0 END)
 * CASE tipo_credito WHEN 'CDC' THEN 0.75 WHEN 'Cartão' THEN 1.25 WHEN 'Imobiliário' THEN 0.21 ELSE 0.80 END, 0.01), 0.95)"""


def losses_and_stages(spark, folder):
    return proposals(spark, folder).select(
        "proposta_id",
        F.round(S.expected_loss_lgd("ticket", "inadimplente", "tipo_credito"), 4).alias(
            "perda_esperada"
        ),
        S.ifrs9_stage(_days(), "score").alias("estagio"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        installment, affordability, default_codes, accents, month_parts, prediction,
        score_response, bacen_level, bacen_level_dashboard, risk_bands, delay_and_score_rules,
        denial_reasons, decision_reason, product_rates, min_profitable_rate, profitability,
        rate_factors, suggested_rate, rate_range, check_rate, rate_explanation,
        profitability_override, scorecards, losses_and_stages,
    )
}

ORACLES = {
    "installment": _select(
        "round(parcela_mensal, 4) AS parcela, round(ticket / prazo_meses, 8) AS parcela_sem_juros"
    ),
    "affordability": _select(
        f"""round(perc, 6) AS perc, CASE WHEN perc > 30 THEN 1 ELSE 0 END AS alto_comprometimento,
        round((950 - score) / 650.0::double, 8) AS fator_risco, {_BAND.format(x="idade")} AS faixa_etaria,
        round(sn, 8) AS score_norm,
        CASE WHEN idade + 40 <= 100 THEN {_BAND.format(x="(idade + 40)")} END AS faixa_fechada,
        CASE WHEN score > 700 THEN 1 ELSE 0 END AS score_alto,
        round(least(ticket / renda, 10), 6) AS renda_ticket_ratio"""
    ),
    "default_codes": _select(
        ", ".join(_code_sql(c, fold) for c in K.ENCODED_COLUMNS for fold in (True, False))
    ),
    "accents": _select(
        ", ".join(
            f"{_ACCENTS.format(c)} AS {c}_plain"
            for c in ("estado_civil", "escolaridade", "porte_municipio", "tipo_credito")
        ) + ", 'Açao AEIOU aoaeo ' || regiao AS mixed"
    ),
    "month_parts": _select(
        f"""{_MONTH} AS mes, 1 + proposta_id % 12 AS mes_num,
        CASE proposta_id % 12 WHEN 11 THEN 0.020 WHEN 0 THEN 0.015 WHEN 1 THEN 0.015
         WHEN 5 THEN -0.005 WHEN 6 THEN -0.005 ELSE 0 END::double AS fator_sazonal,
        round((proposta_id % 12) / 11.0::double, 8) AS mes_index"""
    ),
    "prediction": _select(
        f"""CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, round(p * 100, 10) AS risk_score,
        {_RECOMMEND} AS recommendation, round({_CONFIDENCE}, 10) AS confidence"""
    ),
    "score_response": _select(
        f"""cliente_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, round(p, 4) AS probability,
        round(p * 100, 2) AS risk_score, {_RECOMMEND} AS recommendation,
        round({_CONFIDENCE}, 4) AS confidence, 0.5::double AS threshold, '1.0.0' AS model_version,
        TIMESTAMP '2025-01-01 00:00:00' AS "timestamp", 0.35::double AS peso_score, 2 AS n_pesos"""
    ),
    "bacen_level": _select(
        ", ".join(
            f"{_level_case(D.LEVELS, i + 1, '(p * 100)')} AS {name}"
            for i, name in enumerate(D.LEVEL_FIELDS)
        )
    ),
    "bacen_level_dashboard": _select(
        ", ".join(
            f"{_level_case(D.DASHBOARD_LEVELS, i + 1, 'p')} AS {name}"
            for i, name in enumerate(D.DASHBOARD_FIELDS)
        )
    ),
    "risk_bands": _select(
        f"""{step_case("(p * 100)", list(zip((10.0, 30.0), D.BAND_TEXTS)), D.BAND_TEXTS[-1], "<=")} AS faixa,
        {step_case("p", list(zip((0.4, 0.7), D.BAND_TEXTS)), D.BAND_TEXTS[-1], "<=")} AS faixa_teste,
        {step_case("(p * 100)", ((60, "Alto"), (30, "Médio")), "Baixo", ">")} AS categoria"""
    ),
    "delay_and_score_rules": _select(
        f"""CASE WHEN {_DAYS} > 180 THEN 'H' WHEN {_DAYS} >= 151 THEN 'G' WHEN {_DAYS} >= 121 THEN 'F'
         WHEN {_DAYS} >= 91 THEN 'E' WHEN {_DAYS} >= 61 THEN 'D' WHEN {_DAYS} >= 31 THEN 'C'
         WHEN {_DAYS} >= 15 THEN 'B' END AS nivel_atraso,
        CASE WHEN score - 100 < 300 THEN 'Negar' WHEN score - 100 < 500 THEN 'Revisar com Restrições'
         WHEN score - 100 < 700 THEN 'Revisar' WHEN score - 100 <= 850 THEN 'Aprovar'
         ELSE 'Aprovar com Benefícios' END AS decisao_score,
        {step_case("(score - 100)", D.DENIED_SCORE_TEXTS, D.DENIED_SCORE_REST, "<")} AS texto_score,
        {step_case("p", D.DENIED_PROBABILITY_TEXTS, D.DENIED_PROBABILITY_REST, ">")} AS texto_probabilidade"""
    ),
    "denial_reasons": PROP + f"""SELECT proposta_id,
        (score < 600)::int + (p > 0.5)::int + (qtd_atrasos_12m > 2)::int + (ticket > renda * 5)::int AS n_motivos,
        concat_ws(' | ',
         CASE WHEN score < 600 THEN 'Score de crédito ' || score || ' abaixo do mínimo regulatório (600 pontos)' END,
         CASE WHEN p > 0.5 THEN 'Probabilidade de inadimplência de ' || {_ONE_DIGIT.format(x="p * 100")} || '% excede limite de 30%' END,
         CASE WHEN qtd_atrasos_12m > 2 THEN 'Histórico de ' || qtd_atrasos_12m || ' atrasos nos últimos 12 meses' END,
         CASE WHEN ticket > renda * 5 THEN 'Comprometimento de renda: ' || {_ONE_DIGIT.format(x="ticket / prazo_meses / renda * 100")} || '% (limite: 30%)' END) AS motivos
        FROM prop""",
    "decision_reason": _select(
        f"""{_RECOMMEND} AS decisao, {_REASON} AS motivo,
        CASE WHEN p > 0.5 THEN ticket * p ELSE 0 END AS perda_evitada,
        ticket * p AS perda_esperada, ticket * p * 1.5::double AS provisao""",
        SCORED,
    ),
    "product_rates": PROP + _RATES + f"""SELECT proposta_id, lo::double AS taxa_minima,
        mean::double AS taxa_media, hi::double AS taxa_maxima, bank::double AS taxa_banco,
        CASE WHEN tipo_credito = 'Cartão' THEN 28.0 ELSE lo END::double AS literal_minima,
        CASE WHEN tipo_credito = 'Cartão' THEN 24.0 ELSE bank END::double AS literal_banco,
        code AS codigo, tipo_credito AS exibicao {_RATE_JOIN}""",
    "min_profitable_rate": _select(
        f"{_min_rate_sql('p')} AS taxa_minima, {_min_rate_sql('p', 10.0, 8.0)} AS taxa_alternativa"
    ),
    "profitability": PROP + f""", f AS ({_PROFIT}), g AS (SELECT *, receita - captacao - reserva - operacao AS lucro FROM f)
        SELECT proposta_id, receita AS receita_juros, captacao AS custo_captacao,
         reserva AS provisao_bacen, operacao AS custos_operacionais,
         lucro AS lucro_liquido, lucro / ticket * 100 AS roi,
         minima AS taxa_minima_rentavel,
         (lucro / ticket * 100 > 0 AND taxa_juros_aa >= minima)::int AS aprovavel FROM g""",
    "rate_factors": PROP + _PRICED.format(p="p") + """SELECT proposta_id, fs AS fator_score,
        fv AS fator_valor, ft AS fator_prazo, fc AS fator_comprometimento, """ + _F_PD
    + " AS pd_score FROM priced",
    "suggested_rate": PROP + _PRICED.format(p=f"({_CHANCE})") + """SELECT proposta_id,
        rate AS taxa_sugerida, lo AS taxa_minima, mean * 2.0::double AS taxa_maxima,
        fl AS taxa_minima_rentavel, round(ch, 6) AS probabilidade FROM priced""",
    "rate_range": PROP + _RATES + f"""SELECT proposta_id, lo::double AS minima,
        floor(bank::double * {_F_SCORE} * 2 + 0.5) / 2.0::double AS recomendada,
        bank::double * 2 AS maxima {_RATE_JOIN}""",
    "check_rate": PROP + _RATES + """, q AS (SELECT *, CASE WHEN proposta_id % 11 = 0 THEN 'Consignado' ELSE tipo_credito END AS pr,
         round(taxa_juros_aa * CASE WHEN proposta_id % 3 = 0 THEN 25 ELSE 2 END, 2) AS rt FROM prop),
        t AS (SELECT *, regexp_replace(regexp_replace(cast(lo AS varchar), '0+$', ''), '\\.$', '') AS slo,
         regexp_replace(regexp_replace(cast(hi AS varchar), '0+$', ''), '\\.$', '') AS shi,
         regexp_replace(regexp_replace(cast(bank AS varchar), '0+$', ''), '\\.$', '') AS sbank
         FROM q LEFT JOIN rates ON display = pr)
        SELECT proposta_id, (name IS NOT NULL)::int AS valida,
         CASE WHEN name IS NULL THEN 'erro' WHEN rt < lo OR rt > hi THEN 'aviso' ELSE 'ok' END AS nivel,
         CASE WHEN name IS NULL THEN 'Tipo de produto inválido: ' || pr
          WHEN rt < lo THEN 'Taxa abaixo da mínima recomendada para ' || name || '. Recomendado: ' || slo || '% a.a. (Taxa praticada: ' || sbank || '% a.a.)'
          WHEN rt > hi THEN 'Taxa acima do usual para ' || name || '. Máximo típico: ' || shi || '% a.a.'
          ELSE 'Taxa dentro da faixa recomendada' END AS mensagem,
         CASE WHEN rt < lo THEN bank END::double AS taxa_corrigida FROM t""",
    "rate_explanation": PROP + _PRICED.format(p="p") + f"SELECT proposta_id, {_EXPLAIN} AS texto FROM priced",
    "profitability_override": PROP + f""", f AS (SELECT *, {_RECOMMEND} AS rec, taxa_juros_aa * 3 AS rt,
         {_min_rate_sql("p")} AS minima FROM prop),
        g AS (SELECT *, rt < minima OR (ticket * (rt / 100) * (prazo_meses / 12.0::double)
          - ticket * {K.FUNDING_RATE / 100!r}::double * (prazo_meses / 12.0::double)
          - ticket * p * 1.5::double - ticket * 0.0075::double) / ticket * 100 < 0 AS poor FROM f)
        SELECT proposta_id, CASE WHEN poor AND rec = 'Aprovar' THEN 1 WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN poor AND rec = 'Aprovar' THEN 'Revisar' ELSE rec END AS recommendation FROM g""",
    "scorecards": _select(
        f"""round(least(p, 1), 8) AS ponderado, round({_ADDITIVE}, 8) AS aditivo,
        round({_MULTIPLICATIVE}, 8) AS multiplicativo,
        round(least(greatest((950 - score) / 650.0::double * 0.068::double, 0.01), 0.95), 8) AS simples"""
    ),
    "losses_and_stages": _select(
        f"""round(ticket * inadimplente * CASE tipo_credito WHEN 'CDC' THEN 0.55 WHEN 'Cartão' THEN 0.70
         WHEN 'Imobiliário' THEN 0.35 ELSE 0.60 END::double, 4) AS perda_esperada,
        CASE WHEN {_DAYS} > 90 THEN 'Stage 3' WHEN score < 600 OR {_DAYS} > 0 THEN 'Stage 2'
         ELSE 'Stage 1' END AS estagio"""
    ),
}
