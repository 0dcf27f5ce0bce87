"""Affordability and risk features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col, clip, ladder, lookup

# The accented vowels that are folded, and what they become. The cedilla stays.
ACCENTED = "áãâéêíóõôúÁÃÂÉÊÍÓÕÔÚ"
PLAIN = "aaaeeiooouAAAEEIOOOU"


def installment(ticket: ColumnLike, rate_aa: ColumnLike, months: ColumnLike) -> Column:
    """Constant monthly installment; straight division when the rate is zero, NULL without a term."""
    ticket, months = as_col(ticket), as_col(months)
    monthly = as_col(rate_aa) / 12 / 100
    growth = F.pow(1 + monthly, months)
    return F.when(
        monthly > 0, F.try_divide(ticket * (monthly * growth), growth - 1)
    ).otherwise(F.try_divide(ticket, months))


def income_commitment(payment: ColumnLike, income: ColumnLike) -> Column:
    """Installment as a percentage of income; NULL without income."""
    return F.try_divide(as_col(payment), as_col(income)) * 100


def high_commitment(percent: ColumnLike) -> Column:
    return F.when(as_col(percent) > 30, 1).otherwise(0)


def risk_factor(score: ColumnLike) -> Column:
    return (F.lit(K.SCORE_MAX) - as_col(score)) / F.lit(float(K.SCORE_SPAN))


def score_norm(score: ColumnLike) -> Column:
    return (as_col(score) - K.SCORE_MIN) / F.lit(float(K.SCORE_SPAN))


def age_band(age: ColumnLike, open_ended: bool = True) -> Column:
    """Age band; with ``open_ended=False`` ages outside (0, 100] have none."""
    age = as_col(age)
    bands = K.DEFAULT_LABEL_MAPS["faixa_etaria"]
    band = ladder(age, zip((25, 35, 45, 55, 65), bands), bands[-1], "<=")
    return band if open_ended else F.when((age > 0) & (age <= 100), band)


def strip_accents(text: ColumnLike) -> Column:
    return F.translate(as_col(text), ACCENTED, PLAIN)


def default_code(column: str, value: ColumnLike, fold: bool = True) -> Column:
    """Default encoder code of a value; unknown or NULL gives 0.

    ``fold=True`` strips accents on both sides, so every listed value keeps its own code.
    ``fold=False`` strips them on the value only: accented entries then miss and give 0.
    """
    labels = K.DEFAULT_LABEL_MAPS[column]
    if fold:
        labels = [label.translate(str.maketrans(ACCENTED, PLAIN)) for label in labels]
    codes = {label: code for code, label in enumerate(labels)}
    return F.coalesce(lookup(strip_accents(value), codes), F.lit(0))


def score_high(score: ColumnLike) -> Column:
    return F.when(as_col(score) > 700, 1).otherwise(0)


def ticket_income_ratio(ticket: ColumnLike, income: ColumnLike) -> Column:
    ratio = F.try_divide(as_col(ticket), as_col(income))
    return F.when(ratio.isNotNull(), clip(ratio, 0.0, 10.0))


def month_number(month: ColumnLike) -> Column:
    """Month number of a ``YYYYMM`` value."""
    return F.substring(as_col(month).cast("string"), 5, 2).cast("int")


def month_index(month: ColumnLike) -> Column:
    return (month_number(month) - 1) / F.lit(11.0)


def season_factor(month: ColumnLike) -> Column:
    # Month number -> seasonal risk shift.
    shifts = {12: 0.020, 1: 0.015, 2: 0.015, 6: -0.005, 7: -0.005}
    return F.coalesce(lookup(month_number(month), shifts), F.lit(0.0))


def with_features(df: DataFrame) -> DataFrame:
    """Adds the five derived columns every scored proposal carries."""
    return (
        df.withColumn("parcela_mensal", installment("ticket", "taxa_juros_aa", "prazo_meses"))
        .withColumn("perc_comprometimento_renda", income_commitment("parcela_mensal", "renda"))
        .withColumns(
            {
                "alto_comprometimento": high_commitment("perc_comprometimento_renda"),
                "fator_risco": risk_factor("score"),
                "faixa_etaria": age_band("idade"),
            }
        )
    )
