"""Boundary values of ladders, decisions, pricing and features."""

import math

import pytest
from pyspark.sql import functions as F

from crivo.functions import decisions as D
from crivo.functions import features as X
from crivo.functions import ingest as I
from crivo.functions import pricing as P
from crivo.functions import scorecards as S


def over(spark, column, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_recommendation_boundaries(spark):
    assert over(spark, D.recommendation("v"), [0.0, 0.10, 0.1000001, 0.30, 0.31, 1.0]) == [
        "Aprovar", "Aprovar", "Revisar", "Revisar", "Negar", "Negar",
    ]


def test_three_bands_of_the_wide_variant(spark):
    approve, attention, deny = D.BAND_TEXTS
    assert over(spark, D.risk_band3("v", "test"), [0.0, 0.4, 0.40001, 0.7, 0.70001]) == [
        approve, approve, attention, attention, deny,
    ]


def test_levels(spark):
    level = D.bacen_level("v")["nivel_bacen"]
    assert over(spark, level, [0.001, 0.005, 0.0099, 0.02, 0.05, 0.15, 0.308, 0.6, 0.8, 1.2]) == [
        "AA", "AA", "A", "B", "C", "D", "E", "F", "G", "H",
    ]
    level = D.bacen_level("v", "dashboard")["nivel"]
    assert over(spark, level, [0.01, 0.03, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 1.0]) == [
        "AA", "A", "B", "C", "D", "E", "F", "G", "H",
    ]


def test_days_past_due(spark):
    assert over(spark, D.level_from_days_past_due("v"), [0, 14, 15, 30, 31, 60, 61, 91, 121, 151, 180, 181],
                "int") == [None, None, "B", "B", "C", "C", "D", "E", "F", "G", "G", "H"]


def test_confidence(spark):
    got = over(spark, D.confidence("v"), [0.0, 0.1, 0.2, 0.35, 0.5, 0.6, 0.9])
    assert got == pytest.approx([1.0, 0.9, 0.675, 0.6, 0.675, 0.9, 1.0])


def test_audit_severity_of_a_high_risk(spark):
    from crivo.operators.audit import prediction_severity

    assert over(spark, prediction_severity("v"), [0.85, 0.7, 0.70001]) == ["warning", "info", "warning"]


def test_installment(spark):
    df = spark.createDataFrame(
        [(12000.0, 0.0, 12), (10000.0, 12.0, 24), (100.0, 5.0, 0)], "t double, r double, n int"
    )
    got = [r[0] for r in df.select(X.installment("t", "r", "n")).collect()]
    growth = 1.01**24
    assert got[0] == 1000.0
    assert got[1] == pytest.approx(10000 * 0.01 * growth / (growth - 1))
    assert got[2] is None


def test_zero_income_does_not_fail(spark):
    df = spark.createDataFrame([(100.0, 0.0)], "pay double, income double")
    row = df.select(
        X.income_commitment("pay", "income"), X.ticket_income_ratio("pay", "income")
    ).first()
    assert tuple(row) == (None, None)


def brute_min_rate(v, n, p, cdi=13.31, margin=5.0):
    years = n / 12
    needed = v * (cdi / 100) * years + v * p * 1.5 + v * 0.0075 + v * (margin / 100)
    return math.ceil(needed / v / years * 100 * 10) / 10


def test_min_profitable_rate(spark):
    rows = [(20000.0, 24, 0.02), (8000.0, 12, 0.5), (500000.0, 360, 0.001)]
    df = spark.createDataFrame(rows, "v double, n int, p double")
    got = [r[0] for r in df.select(P.min_profitable_rate("v", "n", "p")).collect()]
    assert got == [brute_min_rate(*r) for r in rows]


def test_suggested_rate_never_below_the_profitable_one(spark):
    rows = [
        (product, value, score, months, income, p)
        for product in ("CDC", "Pessoal", "Imobiliário", "Cartão", "Outro")
        for value in (1000.0, 60000.0, 400000.0)
        for score in (350, 550, 720, 900)
        for months in (6, 36, 240)
        for income, p in ((2000.0, 0.0), (20000.0, 0.4))
    ]
    df = spark.createDataFrame(rows, "k string, v double, s int, n int, r double, p double")
    out = P.with_suggested_rate(df, "k", "v", "s", "n", "r", "p").select("sugestao.*").collect()
    assert all(r.taxa_sugerida >= r.taxa_minima_rentavel for r in out)
    assert all(r.taxa_sugerida * 2 == int(r.taxa_sugerida * 2) for r in out)


def test_card_is_unknown_when_keys_are_literal(spark):
    df = spark.createDataFrame([("Cartão",), ("Cartao",)], "k string")
    got = df.select(
        P.product_rates("k")["taxa_banco"], P.product_rates("k", literal=True)["taxa_banco"]
    ).collect()
    assert [tuple(r) for r in got] == [(434.75, 24.0), (434.75, 434.75)]


def test_number_grouping(spark):
    got = over(spark, P.grouped_number(F.col("v")), [1234567.5, 999.0, 1000.0, 12.345, 0.5])
    assert got == ["1.234.567,5", "999", "1.000", "12,345", "0,5"]


def test_number_prefixes(spark):
    texts = ["33.9", " 41 anos", "abc", "", None, "0", "-5", "1e3", ".5", "99999999999"]
    assert over(spark, I.number_or("v", "int", 30), texts, "string") == [
        33, 41, 30, 30, 30, 30, -5, 1, 30, 30,
    ]
    assert over(spark, I.number_or("v", "float", 2.5), texts, "string") == [
        33.9, 41.0, 2.5, 2.5, 2.5, 2.5, -5.0, 1000.0, 0.5, 99999999999.0,
    ]


def test_stages(spark):
    df = spark.createDataFrame([(0, 700), (0, 599), (90, 700), (91, 900)], "d int, s int")
    assert [r[0] for r in df.select(S.ifrs9_stage("d", "s")).collect()] == [
        "Stage 1", "Stage 2", "Stage 2", "Stage 3",
    ]


def test_strip_accents_keeps_the_cedilla(spark):
    assert over(spark, X.strip_accents("v"), ["Ação", "Médio", "VIÚVO"], "string") == [
        "Açao", "Medio", "VIUVO",
    ]


def test_prior_shift_scales_the_odds(spark):
    from crivo.functions import decisions as D

    rows = spark.createDataFrame([(0.0,), (0.5,), (0.2,), (1.0,), (None,), (1.5,)], "p double")
    got = [r[0] for r in rows.select(D.prior_shifted("p", 0.5, 0.1)).collect()]
    assert got == pytest.approx([0.0, 0.1, (0.25 / 9) / (1 + 0.25 / 9), 1.0, None, None])
    assert [r[0] for r in rows.select(D.prior_shifted("p", 0.3, 0.3)).collect()][:4] == pytest.approx([0, 0.5, 0.2, 1])
    assert rows.select(D.prior_shifted("p", 0.5, 0.0).alias("x")).filter("x is not null").count() == 0
