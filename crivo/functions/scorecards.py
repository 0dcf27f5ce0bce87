"""Formula scorecards, expected loss and staging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col, clip, ladder, lookup
from crivo.functions.features import month_index, risk_factor, season_factor
from crivo.functions.pricing import product_code

# Weights and product factors of the scorecards.
WEIGHTS = {"score": 0.40, "commitment": 0.30, "late": 0.20, "newness": 0.10}
ADDITIVE_PRODUCT = {"Cartao": 0.04, "CDC": 0.02, "Pessoal": 0.025}
ADDITIVE_PRODUCT_REST = -0.02
MULTIPLICATIVE_PRODUCT = {"CDC": 0.75, "Cartao": 1.25, "Imobiliario": 0.21, "Pessoal": 0.80}
BASE_RATE = 0.068


def scorecard_weighted(
    score: ColumnLike, commitment_percent: ColumnLike, late: ColumnLike, tenure: ColumnLike
) -> Column:
    """Square of the weighted sum of score, commitment, lateness and newness risk."""
    total = (
        WEIGHTS["score"] * risk_factor(score)
        + WEIGHTS["commitment"] * clip(as_col(commitment_percent) / 100, 0.0, 1.0)
        + WEIGHTS["late"] * clip(as_col(late) / F.lit(5.0), 0.0, 1.0)
        + WEIGHTS["newness"] * clip((60 - as_col(tenure)) / F.lit(60.0), 0.0, 1.0)
    )
    return clip(F.pow(total, F.lit(2.0)), 0.0, 1.0)


def scorecard_additive(
    score: ColumnLike, income: ColumnLike, ticket: ColumnLike, months: ColumnLike,
    product: ColumnLike, tenure: ColumnLike, products: ColumnLike, month: ColumnLike,
    noise: Column | None = None,
) -> Column:
    """Sum of nine risk terms, clipped to 0.005-0.25; ``noise`` is added before the clip."""
    total = (
        (F.lit(950) - as_col(score)) / F.lit(850.0) * 0.12
        + ladder(as_col(income), ((2000, 0.08), (3500, 0.015)), 0.0, "<")
        + ladder(as_col(ticket), ((200000, 0.02), (100000, 0.01)), 0.0, ">")
        + as_col(months) / F.lit(360.0) * 0.02
        + F.coalesce(lookup(product_code(product), ADDITIVE_PRODUCT), F.lit(ADDITIVE_PRODUCT_REST))
        + ladder(as_col(tenure), ((36, -0.02), (12, -0.01)), 0.0, ">")
        + F.when(as_col(products) >= 3, -0.015).otherwise(0.0)
        + season_factor(month)
        + month_index(month) * 0.01
    )
    return clip(total if noise is None else total + noise, 0.005, 0.25)


def scorecard_multiplicative(
    score: ColumnLike, income: ColumnLike, value_income_ratio: ColumnLike, product: ColumnLike
) -> Column:
    """Base rate scaled by score, income, ratio and product, clipped to 0.01-0.95."""
    scale = (
        1
        + risk_factor(score) * 0.5
        + F.when(as_col(income) < 2000, 0.3).otherwise(0.0)
        + F.when(as_col(value_income_ratio) > 1.0, 0.2).otherwise(0.0)
    )
    factor = lookup(product_code(product), MULTIPLICATIVE_PRODUCT)
    return clip(BASE_RATE * scale * factor, 0.01, 0.95)


def scorecard_simple(score: ColumnLike) -> Column:
    return clip(risk_factor(score) * BASE_RATE, 0.01, 0.95)


def lgd_base(product: ColumnLike) -> Column:
    return lookup(product_code(product), K.LGD_BY_PRODUCT)


def expected_loss_lgd(
    ticket: ColumnLike, default: ColumnLike, product: ColumnLike, noise: Column | None = None
) -> Column:
    """Ticket times default flag times the product's loss given default (clipped 0.2-0.9)."""
    base = lgd_base(product)
    lgd = F.round(clip(base if noise is None else base + noise, 0.2, 0.9), 3)
    return as_col(ticket) * as_col(default) * lgd


def ifrs9_stage(days_past_due: ColumnLike, score: ColumnLike) -> Column:
    days = as_col(days_past_due)
    return (
        F.when(days > 90, "Stage 3")
        .when((as_col(score) < 600) | ((days > 0) & (days <= 90)), "Stage 2")
        .otherwise("Stage 1")
    )
