"""Loan pricing: product rates, minimum profitable rate, suggested rate, profitability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col, ceil_to, fixed, half_up_to, ladder, lookup
from crivo.functions.features import income_commitment, installment

# Fixed values: (lower bound, factor) per ladder, first match from the top; last entry is the rest.
SCORE_FACTORS = ((800, 0.65), (700, 0.80), (600, 1.00), (500, 1.35), (400, 1.70)), 2.00
SCORE_PDS = ((800, 0.02), (700, 0.05), (600, 0.12), (500, 0.28), (400, 0.50)), 0.70
COMMITMENT_FACTORS = ((50, 1.30), (40, 1.20), (30, 1.10), (20, 1.00)), 0.95
VALUE_FACTORS = {
    "Imobiliario": (((500000, 0.85), (300000, 0.90), (150000, 0.95)), 1.00),
    "CDC": (((50000, 0.90), (30000, 0.95), (15000, 1.00), (5000, 1.05)), 1.10),
    "Pessoal": (((50000, 0.90), (30000, 0.95), (15000, 1.00), (5000, 1.05)), 1.10),
}
TERM_FACTORS = {
    "Imobiliario": (((360, 1.00), (240, 0.95), (180, 0.90)), 0.85),
    "CDC": (((48, 1.15), (36, 1.10), (24, 1.05), (12, 1.00)), 0.95),
    "Pessoal": (((48, 1.15), (36, 1.10), (24, 1.05), (12, 1.00)), 0.95),
    "Cartao": (((24, 1.10), (12, 1.00)), 0.95),
}
# Product keys the pricing tables answer to when keys are taken literally.
LITERAL_KEYS = {"CDC": "CDC", "Pessoal": "Pessoal", "Imobiliário": "Imobiliario",
                "Cartao": "Cartao"}


def product_code(product: ColumnLike) -> Column:
    """Display name to code; unknown names pass through."""
    codes = {display: code for code, (display, *_) in K.PRODUCT_RATES.items()}
    return F.coalesce(lookup(as_col(product), codes), as_col(product))


def product_display(code: ColumnLike) -> Column:
    """Code to display name; unknown codes pass through."""
    names = {code_: display for code_, (display, *_) in K.PRODUCT_RATES.items()}
    return F.coalesce(lookup(as_col(code), names), as_col(code))


def pricing_key(product: ColumnLike, literal: bool = False) -> Column:
    """Key into the pricing tables.

    ``literal=False`` accepts codes and display names of every product. ``literal=True`` knows
    only the spellings the original tables were keyed by, so 'Cartão' is an unknown product.
    """
    if literal:
        return F.coalesce(lookup(as_col(product), LITERAL_KEYS), F.lit("?"))
    return product_code(product)


def _rate(key: Column, field: int) -> Column:
    return lookup(key, {code: row[field] for code, row in K.PRODUCT_RATES.items()})


def rates_of(key: Column) -> tuple[Column, Column, Column, Column]:
    """Minimum, mean, maximum and bank rate of a pricing key; defaults for unknown products."""
    return (
        F.coalesce(_rate(key, 2), F.lit(K.DEFAULT_MIN_RATE)),
        F.coalesce(_rate(key, 3), F.lit(K.DEFAULT_MEAN_RATE)),
        _rate(key, 4),
        F.coalesce(_rate(key, 5), F.lit(K.DEFAULT_MEAN_RATE)),
    )


def product_rates(product: ColumnLike, literal: bool = False) -> Column:
    """Struct of minimum, mean, maximum and bank rate; defaults for unknown products."""
    names = ("taxa_minima", "taxa_media", "taxa_maxima", "taxa_banco")
    rates = rates_of(pricing_key(product, literal))
    return F.struct(*(rate.alias(name) for rate, name in zip(rates, names)))


def with_product_rates(
    df: DataFrame, product: str = "tipo_credito", literal: bool = False
) -> DataFrame:
    """Adds the product's rates as columns (a four-row lookup held in the plan as a literal)."""
    rates = product_rates(product, literal)
    return df.withColumns(
        {name: rates[name] for name in ("taxa_minima", "taxa_media", "taxa_maxima", "taxa_banco")}
    )


def score_rate_factor(score: ColumnLike) -> Column:
    return ladder(as_col(score), *SCORE_FACTORS, ">=")


def pd_from_score(score: ColumnLike) -> Column:
    return ladder(as_col(score), *SCORE_PDS, ">=")


def commitment_rate_factor(percent: ColumnLike) -> Column:
    return ladder(as_col(percent), *COMMITMENT_FACTORS, ">=")


def _by_product(key: Column, x: Column, tables: dict) -> Column:
    out = None
    for code, (steps, rest) in tables.items():
        factor = ladder(x, steps, rest, ">=")
        out = F.when(key == code, factor) if out is None else out.when(key == code, factor)
    return out.otherwise(F.lit(1.0))


def value_rate_factor(ticket: ColumnLike, product: ColumnLike, literal: bool = False) -> Column:
    return _by_product(pricing_key(product, literal), as_col(ticket), VALUE_FACTORS)


def term_rate_factor(months: ColumnLike, product: ColumnLike, literal: bool = False) -> Column:
    return _by_product(pricing_key(product, literal), as_col(months), TERM_FACTORS)


def min_profitable_rate(
    ticket: ColumnLike, months: ColumnLike, p: ColumnLike,
    funding: float = K.FUNDING_RATE, margin: float = K.MIN_MARGIN,
) -> Column:
    """Lowest yearly rate that pays funding, provision, operation and margin, up to 0.1."""
    ticket, p = as_col(ticket), as_col(p)
    years = as_col(months) / F.lit(12.0)
    needed = (
        ticket * (funding / 100) * years
        + ticket * p * K.PROVISION_FACTOR
        + ticket * K.OPERATING_COST
        + ticket * (margin / 100)
    )
    return ceil_to(F.try_divide(F.try_divide(needed, ticket), years) * 100, 10)


def profitability(
    ticket: ColumnLike, months: ColumnLike, rate: ColumnLike, p: ColumnLike,
    funding: float = K.FUNDING_RATE,
) -> Column:
    """Struct with revenue, costs, profit, ROI %, minimum rate and the approvable flag."""
    ticket, rate, p_ = as_col(ticket), as_col(rate), as_col(p)
    years = as_col(months) / F.lit(12.0)
    interest = ticket * (rate / 100) * years
    funding_cost = ticket * (funding / 100) * years
    reserve = ticket * p_ * K.PROVISION_FACTOR
    operation = ticket * K.OPERATING_COST
    profit = interest - funding_cost - reserve - operation
    roi = F.try_divide(profit, ticket) * 100
    minimum = min_profitable_rate(ticket, months, p_, funding)
    return F.struct(
        interest.alias("receita_juros"),
        funding_cost.alias("custo_captacao"),
        reserve.alias("provisao_bacen"),
        operation.alias("custos_operacionais"),
        profit.alias("lucro_liquido"),
        roi.alias("roi"),
        minimum.alias("taxa_minima_rentavel"),
        ((roi > 0) & (rate >= minimum)).alias("aprovavel"),
    )


SUGGESTION_FIELDS = (
    "taxa_sugerida", "taxa_minima", "taxa_maxima", "taxa_minima_rentavel", "probabilidade",
    "taxa_banco", "fator_score", "fator_valor", "fator_prazo", "fator_comprometimento",
)


def with_suggested_rate(
    df: DataFrame, product: str = "tipo_credito", ticket: str = "ticket", score: str = "score",
    months: str = "prazo_meses", income: str = "renda", p: ColumnLike | None = None,
    literal: bool = False, out: str = "sugestao",
) -> DataFrame:
    """Adds a struct with the suggested rate, its limits and the factors it was built from.

    A missing or zero probability is estimated from the score. Shared terms (the product's rates,
    the installment, the profitable floor) are columns of their own projection, so each is
    computed once per row.
    """
    given = F.lit(None).cast("double") if p is None else as_col(p)
    chance = F.coalesce(F.nullif(given, F.lit(0.0)), pd_from_score(score))
    rows = df.withColumns({"_key": pricing_key(product, literal), "_chance": chance})
    rates = rates_of(F.col("_key"))
    rows = rows.withColumns(
        {
            "_lowest": rates[0], "_highest": rates[1] * 2.0, "_bank": rates[3],
            "_value": _by_product(F.col("_key"), F.col(ticket), VALUE_FACTORS),
            "_term": _by_product(F.col("_key"), F.col(months), TERM_FACTORS),
            "_score": score_rate_factor(score),
            "_floor": min_profitable_rate(ticket, months, "_chance"),
        }
    )
    rows = rows.withColumn(
        "_percent", income_commitment(installment(ticket, "_bank", months), income)
    )
    rows = rows.withColumn("_commitment", commitment_rate_factor("_percent"))
    bank, lowest, highest = F.col("_bank"), F.col("_lowest"), F.col("_highest")
    floor_rate = F.col("_floor")
    factors = [F.col(c) for c in ("_score", "_value", "_term", "_commitment")]
    raw = bank
    for factor in factors:
        raw = raw * factor
    clamped = F.greatest(lowest, F.least(F.greatest(raw, floor_rate), highest))
    rate = F.greatest(half_up_to(clamped, 2), ceil_to(floor_rate, 2))
    values = (rate, lowest, highest, floor_rate, F.col("_chance"), bank, *factors)
    return rows.withColumn(
        out, F.struct(*(v.alias(n) for v, n in zip(values, SUGGESTION_FIELDS)))
    ).drop("_key", "_lowest", "_highest", "_bank", "_chance", "_percent", "_floor", "_value",
           "_term", "_score", "_commitment")


def rate_range(product: ColumnLike, score: ColumnLike, literal: bool = False) -> Column:
    rates = product_rates(product, literal)
    bank = rates["taxa_banco"]
    return F.struct(
        rates["taxa_minima"].alias("minima"),
        half_up_to(bank * score_rate_factor(score), 2).alias("recomendada"),
        (bank * 2.0).alias("maxima"),
    )


def plain_number(x: Column) -> Column:
    """Shortest decimal text: no trailing zeros, no trailing point."""
    text = x.cast("decimal(20,4)").cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def check_rate(product: ColumnLike, rate: ColumnLike, literal: bool = False) -> Column:
    """Struct (valida, nivel, mensagem, taxa_corrigida) for a rate against its product's range."""
    key, rate = pricing_key(product, literal), as_col(rate)
    rates = product_rates(product, literal)
    name = lookup(key, {code: row[1] for code, row in K.PRODUCT_RATES.items()})

    def verdict(valid: bool, level: str, message: Column, fix: Column | None = None) -> Column:
        return F.struct(
            F.lit(valid).alias("valida"),
            F.lit(level).alias("nivel"),
            message.alias("mensagem"),
            (F.lit(None).cast("double") if fix is None else fix).alias("taxa_corrigida"),
        )

    below = F.concat(
        F.lit("Taxa abaixo da mínima recomendada para "), name, F.lit(". Recomendado: "),
        plain_number(rates["taxa_minima"]), F.lit("% a.a. (Taxa praticada: "),
        plain_number(rates["taxa_banco"]), F.lit("% a.a.)"),
    )
    above = F.concat(
        F.lit("Taxa acima do usual para "), name, F.lit(". Máximo típico: "),
        plain_number(rates["taxa_maxima"]), F.lit("% a.a."),
    )
    unknown = F.concat(F.lit("Tipo de produto inválido: "), as_col(product))
    return (
        F.when(name.isNull(), verdict(False, "erro", unknown))
        .when(rate < rates["taxa_minima"], verdict(True, "aviso", below, rates["taxa_banco"]))
        .when(rate > rates["taxa_maxima"], verdict(True, "aviso", above))
        .otherwise(verdict(True, "ok", F.lit("Taxa dentro da faixa recomendada")))
    )


def grouped_number(x: Column) -> Column:
    """Number with '.' between thousands, ',' before at most three decimals."""
    text = F.translate(F.format_number(F.round(x, 3), 3), ",.", ".,")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(","))


def rate_explanation(
    product: ColumnLike, ticket: ColumnLike, score: ColumnLike, months: ColumnLike,
    suggestion: Column, source_label: str = "BACEN",
) -> Column:
    """Multi-line text that lists what moved the suggested rate (a ``with_suggested_rate`` struct)."""
    ticket, score, months = as_col(ticket), as_col(score), as_col(months)
    s = suggestion

    def percent_off(factor: Column) -> Column:
        return fixed((1 - factor) * 100, 0)

    def percent_on(factor: Column) -> Column:
        return fixed((factor - 1) * 100, 0)

    def line(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))

    score_text, months_text = score.cast("string"), months.cast("string")
    money = grouped_number(ticket)
    by_score, by_value = s["fator_score"], s["fator_valor"]
    by_term, by_commitment = s["fator_prazo"], s["fator_comprometimento"]
    return F.concat_ws(
        "\n",
        F.lit("Taxa calculada automaticamente:\n"),
        line("• Risco estimado: ", fixed(s["probabilidade"] * 100, 1), "% de inadimplência"),
        line("• Taxa mínima rentável: ", fixed(s["taxa_minima_rentavel"], 1), "% a.a.\n"),
        line("• Taxa média ", as_col(product), ": ", fixed(s["taxa_banco"], 1),
             f"% a.a. ({source_label})"),
        F.when(
            by_score < 1.0,
            line("• Score ", score_text, ": Excelente (-", percent_off(by_score), "%)"),
        ).otherwise(line("• Score ", score_text, ": Risco padrão")),
        F.when(by_value < 1.0,
               line("• Valor R$ ", money, ": Alto valor (-", percent_off(by_value), "%)"))
        .when(by_value > 1.0,
              line("• Valor R$ ", money, ": Baixo valor (+", percent_on(by_value), "%)")),
        F.when(by_term < 1.0,
               line("• Prazo ", months_text, " meses: Curto prazo (-", percent_off(by_term), "%)"))
        .when(by_term > 1.0,
              line("• Prazo ", months_text, " meses: Longo prazo (+", percent_on(by_term), "%)")),
        F.when(by_commitment > 1.0,
               line("• Comprometimento de renda elevado (+", percent_on(by_commitment), "%)")),
        line("\n**Taxa sugerida: ", fixed(s["taxa_sugerida"], 1), "% a.a.**"),
        line("(Mínima produto: ", fixed(s["taxa_minima"], 1), "% | Mínima rentável: ",
             fixed(s["taxa_minima_rentavel"], 1), "%)"),
    )


def profitability_override(
    decision: ColumnLike, predicted: ColumnLike, ticket: ColumnLike, months: ColumnLike,
    rate: ColumnLike, p: ColumnLike, funding: float = K.FUNDING_RATE,
    margin: float = K.MIN_MARGIN,
) -> Column:
    """Struct (prediction, recommendation): an unprofitable approval becomes a review."""
    decision, rate = as_col(decision), as_col(rate)
    result = profitability(ticket, months, rate, p, funding)
    poor = (rate < min_profitable_rate(ticket, months, p, funding, margin)) | (result["roi"] < 0)
    demote = poor & (decision == "Aprovar")
    return F.struct(
        F.when(demote, 1).otherwise(as_col(predicted)).alias("prediction"),
        F.when(demote, "Revisar").otherwise(decision).alias("recommendation"),
    )
