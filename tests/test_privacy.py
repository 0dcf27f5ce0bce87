"""Masks, hashes and encryption on the published golden strings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from crivo.catalog import privacy_queries
from crivo.catalog.privacy_queries import LEFT, LEFT_NEEDS
from crivo.functions import privacy as P


def apply(spark, mask, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(mask("v")).collect()]


CASES = [
    (P.mask_cpf, ["123.456.789-01", "12345678901", "123", "", None],
     ["***.***.***-01", "***.***.***-01", "***INVALID***", "", ""]),
    (P.mask_email, ["joao.silva@example.com", "a@example.com", "invalid-email", "", "@x.com", "ab@c@d"],
     ["j***@example.com", "*@example.com", "***@***", "***@***", "*@x.com", "a***@c@d"]),
    (P.mask_phone, ["(11) 98765-4321", "11987654321", "1234", ""],
     ["(11) ****-4321", "(11) ****-4321", "****-****", ""]),
    (P.mask_account, ["12345-6", "123456", "", "-7", "12-3-4"],
     ["****5-6", "****56", "", "****-7", "****2-3-4"]),
    (P.mask_card, ["1234 5678 9012 3456", "1234567890123456", "123", ""],
     ["**** **** **** 3456", "**** **** **** 3456", "**** **** **** ****", ""]),
    (P.mask_name, ["João da Silva", "João", "Maria de Souza", "  Ana   Lu ", ""],
     ["J*** da S***", "J***", "M*** de S***", "A*** Lu", ""]),
    (P.mask_id, ["12345678901", "abcdefghijkl", "short", "", None, "123.456.789-01"],
     ["***.***.***-01", "abcd...ijkl", "***", "***", "***", "***.***.***-01"]),
]


@pytest.mark.parametrize("mask, values, expected", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_masks(spark, mask, values, expected):
    assert apply(spark, mask, values) == expected


def test_income(spark):
    assert apply(spark, P.mask_income, [8500.0, 500.0, 1500000.0, 999.99, 1000.0], "double") == [
        "R$ 8.5k", "R$ 500", "R$ 1.5M", "R$ 999", "R$ 1.0k",
    ]


def test_hashes(spark):
    value = "12345678901"
    df = spark.createDataFrame([(value, "123.456.789-01")], "v string, c string")
    row = df.select(
        P.hash_sha256("v"), P.hash_cpf("c", "salt"), P.hash_cpf("v", "salt"), P.pseudonymize("v")
    ).first()
    digest = hashlib.sha256(value.encode()).hexdigest()
    assert row[0] == digest
    assert row[1] == row[2] == hashlib.sha256(f"{value}:salt".encode()).hexdigest()
    assert row[3] == f"PSE_{digest[:8]}"


def test_encryption_round_trip(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    df = spark.createDataFrame([("segredo", "x"), ("", "y"), (None, "z")], "a string, b string")
    hidden = P.encrypt_columns(df, ["a"], key)
    tokens = [r.a for r in hidden.orderBy("b").collect()]
    assert tokens[0] != "segredo" and tokens[1] == "" and tokens[2] is None
    shown = P.decrypt_columns(hidden, ["a"], key)
    assert [r.a for r in shown.orderBy("b").collect()] == ["segredo", "", None]


def test_sanitize_by_name(spark):
    df = spark.createDataFrame(
        [("12345678901", "ana@example.com", 8500.0, "pw", "abcdefghijk", "plain")],
        "cpf string, email string, renda_mensal double, password string, token string, motivo string",
    )
    row = P.sanitize(df).first()
    assert tuple(row) == (
        "***.***.***-01", "a***@example.com", "R$ 8.5k", "***", "abcdefgh...", "plain"
    )


def test_redact_text_keeps_the_rest(spark):
    text = "fale com joao.silva@example.com.br ou (11) 98765-4321, cartao 1234 5678 9012 3456 ok"
    df = spark.createDataFrame([(text,), ("a" * 20000,)], "t string")
    shown = [r[0] for r in df.select(P.redact_text("t")).collect()]
    assert shown[0] == "fale com j***@example.com.br ou (11) ****-4321, cartao **** **** **** 3456 ok"
    assert shown[1] == "a" * 20000


def test_phones_of_every_form_are_redacted(spark):
    from crivo.functions import privacy as P

    cases = {
        "ligue (11) 98765-4321 já": "ligue (11) ****-4321 já",
        "+1 (743) 555-3824": "(743) ****-3824",
        "+55 11 98765-4321": "(11) ****-4321",
        "011-3456-7890": "(011) ****-7890",
        "11 3456 7890.": "(11) ****-7890.",
        "+5511987654321": "****-4321",
        "(21)998765432": "(21) ****-5432",
        "10.20.30.40 e 2024-01-15 e 12345678": "10.20.30.40 e 2024-01-15 e 12345678",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string")
    for r in rows.select(P.redact_text("a").alias("got"), "b").collect():
        assert r.got == r.b


def test_every_form_of_mail_and_card_is_redacted(spark):
    from crivo.functions import privacy as P

    cases = {
        "josé.é@exa.com, .ana@b.co e x+y'z@ção.com.br": "j***@exa.com, .a***@b.co e x***@ção.com.br",
        "3782 822463 10005": "**** **** **** 0005",
        "378282246310005 4222222222222 6304000000000000000": "**** **** **** 0005 **** **** **** 2222 **** **** **** 0000",
        "1234567890123 e 378282246310006": "1234567890123 e 378282246310006",
        "4111111111111111 4111-1111-1111-1111": "**** **** **** 1111 **** **** **** 1111",
        "tel: 11987654321; Fone 34567890": "tel: ****-4321; Fone ****-7890",
        "555-0123 ou 98765-4321": "****-0123 ou ****-4321",
        "+55 11 987654321 e 1134567890": "(11) ****-4321 e ****-7890",
        "12-345-2024, 2019-2024, 10.20.30.40 e 2024-01-15": "12-345-2024, 2019-2024, 10.20.30.40 e 2024-01-15",
        "token a98765432109876b e id x11987654321": "token a98765432109876b e id x11987654321",
        "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string")
    for r in rows.select(P.redact_text("a").alias("got"), "b").collect():
        assert r.got == r.b
    long = spark.createDataFrame([("a." * 50_000,), ("1 " * 50_000,), ("9" * 100_000,), (None,)], "a string")
    assert [r[0] for r in long.select(P.redact_text("a")).collect()] == ["a." * 50_000, "1 " * 50_000, "9" * 100_000, None]


def test_a_text_is_read_once_however_it_is_made(spark):
    """Redaction names its text and its stages many times; each is worked out once a row."""
    made = F.concat(F.lit("tel: 11"), F.lpad((F.col("id") * 7).cast("string"), 9, "9"))
    plan = spark.range(20).select(P.redact_text(made).alias("shown"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lpad(") == 1
    assert plan.count("13,15") <= 3  # the pattern of bare cards: test, split, spans


def test_what_every_leftover_holds(spark):
    """No match of a leftover pattern lacks what is looked for first, and documents are few that hold it."""
    texts = ["a@b.co", "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005", "(11) 3555-1234", "(11)3551234",
             "+5 (", "+55 11", "+1(", "555-1234", "11987654321", "none", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, pattern in LEFT.items():
        found = rows.select(F.col("t").rlike(pattern).alias("m"), F.col("t").rlike(LEFT_NEEDS[kind]).alias("n")).collect()
        assert any(r.m for r in found) and all(r.n for r in found if r.m)


def test_forms_are_worked_on_by_more_than_one_task(spark, folder):
    assert privacy_queries.redact_forms(spark, folder).rdd.getNumPartitions() > 8
