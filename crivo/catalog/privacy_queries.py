"""Masks, hashes, pseudonyms, encryption and free-text redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.catalog.fixture_sql import PEOPLE
from crivo.functions import privacy as P
from crivo.sources.star import people, table

SALT = "portfolio-check"
_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"


def masks(spark, folder):
    return people(spark, folder).select(
        "c_custkey", P.mask_cpf("cpf").alias("cpf"), P.mask_email("email").alias("email"),
        P.mask_phone("telefone").alias("telefone"), P.mask_account("conta").alias("conta"),
        P.mask_card("cartao").alias("cartao"), P.mask_name("nome").alias("nome"),
        P.mask_income("renda").alias("renda"),
    )


def mask_id(spark, folder):
    ids = (
        F.when(F.col("c_custkey") % 7 == 0, F.col("email"))
        .when(F.col("c_custkey") % 7 == 1, F.lit("abc"))
        .when(F.col("c_custkey") % 7 == 2, None)
        .otherwise(F.col("cpf"))
    )
    return people(spark, folder).select("c_custkey", P.mask_id(ids).alias("id"))


def hashes(spark, folder):
    return people(spark, folder).select(
        "c_custkey", P.hash_sha256("email").alias("sha"), P.hash_cpf("cpf", SALT).alias("cpf_sha"),
        P.pseudonymize("email").alias("pse"), P.pseudonymize("nome", "CLI").alias("cli"),
    )


def sanitize(spark, folder):
    rows = people(spark, folder).withColumns(
        {
            "cliente_id": F.col("cpf"),
            "renda_mensal": F.when(F.col("c_custkey") % 9 != 0, F.col("renda")).otherwise(0.0),
            "password": F.col("conta"),
            "token": F.col("cartao"),
        }
    )
    return P.sanitize(rows).drop("conta", "cartao", "renda")


def sanitize_map(spark, folder):
    details = F.create_map(
        F.lit("cpf"), F.col("cpf"), F.lit("email"), F.col("email"), F.lit("renda_mensal"),
        F.col("renda").cast("bigint").cast("string"), F.lit("motivo"), F.col("nome"),
        F.lit("password"), F.col("conta"),
    )
    rows = people(spark, folder).withColumn("d", P.sanitize_map(details))
    return rows.select(
        "c_custkey", *(F.col("d")[k].alias(k) for k in ("cpf", "email", "renda_mensal", "motivo",
                                                       "password")),
        F.size("d").alias("n"),
    )


def encrypt_round_trip(spark, folder):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    rows = people(spark, folder).select("c_custkey", "cpf", "email", "nome")
    hidden = P.encrypt_columns(rows, ["cpf", "email"], key)
    shown = P.decrypt_columns(
        hidden.withColumns({"cpf_token": F.col("cpf"), "email_token": F.col("email")}),
        ["cpf", "email"], key,
    )
    return shown.select(
        "c_custkey", "cpf", "email", "nome",
        F.when(F.col("email_token") != F.col("email"), 1).otherwise(0).alias("email_hidden"),
        F.when(F.col("cpf") == "", F.col("cpf_token")).otherwise("x").alias("cpf_token"),
    )


def redact_text(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", P.redact_text("text").alias("shown"))
    return rows.select("doc_id", F.md5("shown").alias("digest"), F.length("shown").alias("n_redacted"))


# What must not be left in a redacted text, by kind; written apart from the masks.
LEFT = {
    "mail": "[^\\s@*]@[^\\s@]+[.]\\p{L}{2}",
    "card": "(^|[^0-9A-Za-z])([0-9]{4}[ -]?){3}[0-9]{4}($|[^0-9A-Za-z])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
    "phone": "[(][0-9]{2,3}[)] ?[0-9]{3,5}[ .-]?[0-9]{4}|[+][0-9]{1,3}[ .-]?[0-9(]|(^|\\s)[0-9]{3,5}-[0-9]{4}(\\s|$)"
             "|(^|\\s)[1-9]{2}9[0-9]{8}(\\s|$)",
}
# What every match of the pattern holds; cheap to look for, and most texts hold none.
LEFT_NEEDS = {"mail": "@", "card": "[0-9]{4}", "phone": "[0-9]{4}|[+][0-9]"}


def redaction_leftovers(spark, folder):
    """Documents in which each kind was found before and after the redaction."""
    rows = table(spark, folder, "documents").select("text", P.redact_text("text").alias("shown"))
    cells = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.count_if(F.col("shown").rlike(LEFT_NEEDS[kind]) & F.col("shown").rlike(pattern)).alias("n_left"),
        )
        for kind, pattern in LEFT.items()
    ]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _luhn_digit(base):
    """The digit that completes a run of digits."""
    candidates = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(base, d.cast("string")))
    return F.right(F.element_at(F.filter(candidates, P.luhn_valid), 1), F.lit(1))


def redact_forms(spark, folder):
    """Every form of mail, card and phone, and look-alikes that stay, made of a customer's number."""
    k = F.col("c_custkey")
    nine = F.lpad((k * 7919 % 1_000_000_000).cast("string"), 9, "0")
    four, base = F.right(nine, F.lit(4)), F.concat(F.lit("411"), nine)
    bad = ((_luhn_digit(base).cast("int") + 1) % 10).cast("string")
    forms = (
        F.concat(F.lit("escreva a josé.ñandú"), k.cast("string"), F.lit("@exámplo.com.br, hoje")),
        F.concat(F.lit("cartão 3782 "), F.substring(nine, 1, 6), F.lit(" 1"), four, F.lit(".")),
        F.concat(F.lit("pago com "), base, _luhn_digit(base), F.lit(" ontem")),
        F.concat(F.lit("pedido "), base, bad, F.lit(" ontem")),
        F.concat(F.lit("de 5100 0000 0000 "), four, F.lit(" para 5100-0000-0000-"), four),
        F.concat(F.lit("tel: 119"), F.right(nine, F.lit(8))),
        F.concat(F.lit("ligue 555-"), four, F.lit(" já")),
        F.concat(F.lit("+55 11 9"), F.right(nine, F.lit(8)), F.lit(" ou (21) 3555-"), four),
        F.concat(F.lit("ref 219"), F.right(nine, F.lit(8)), F.lit(", cel 3555"), four),
        F.concat(F.lit("12-345-2024, 2019-2024, 10.20.30.40, 2024-01-15, a"), nine, F.lit("b e "), nine),
    )
    text = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    # a key is a few bytes on disk and many patterns in work: files alone would make one task of millions
    keys = table(spark, folder, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism * 4)
    return keys.select("c_custkey", P.redact_text(text).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        redact_forms, masks, mask_id, hashes, sanitize, sanitize_map, encrypt_round_trip, redact_text,
        redaction_leftovers,
    )
}


def _cpf(x):
    d = _DIGITS.format(x=x)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN length({d}) <> 11 THEN '***INVALID***' "
            f"ELSE '***.***.***-' || right({d}, 2) END")


def _email(x):
    return (f"CASE WHEN coalesce({x}, '') = '' OR instr({x}, '@') = 0 THEN '***@***' "
            f"WHEN instr({x}, '@') <= 2 THEN '*@' || substr({x}, instr({x}, '@') + 1) "
            f"ELSE substr({x}, 1, 1) || '***@' || substr({x}, instr({x}, '@') + 1) END")


def _phone(x):
    d = _DIGITS.format(x=x)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN length({d}) < 8 THEN '****-****' "
            f"ELSE '(' || substr({d}, 1, 2) || ') ****-' || right({d}, 4) END")


def _name(x):
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE array_to_string(list_transform(list_filter("
            f"regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), "
            "lambda w: CASE WHEN length(w) <= 2 THEN w ELSE substr(w, 1, 1) || '***' END), ' ') END")


def _income(x):
    one = "cast(cast(round({v}, 1) AS decimal(20,1)) AS varchar)"
    return (f"CASE WHEN {x} < 1000 THEN 'R$ ' || cast(trunc({x}) AS bigint) WHEN {x} < 1000000 "
            f"THEN 'R$ ' || {one.format(v=f'{x} / 1000')} || 'k' ELSE 'R$ ' || "
            f"{one.format(v=f'{x} / 1000000')} || 'M' END")


def _id(x):
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '***' WHEN length({_DIGITS.format(x=x)}) = 11 THEN {_cpf(x)} "
            f"WHEN length({x}) > 8 THEN substr({x}, 1, 4) || '...' || right({x}, 4) ELSE '***' END")


def _or_empty(x, mask):
    return f"CASE WHEN coalesce({x}, '') = '' THEN {x} ELSE {mask} END"


# In the documents: mails, bare cards and phones with a country prefix, each among its own signs.
_REDACT = "text"
for _pattern, _put in (
    (r"([\pL\pN_])[\pL\pM\pN_.%+'-]*@((?:[\pL\pM\pN-]+\.)+\pL{2,})", r"\1***@\2"),
    (r"\b\d{12}(\d{4})\b", r"**** **** **** \1"),
    (r"\+\d{1,3} \((\d{3})\) \d{3}-(\d{4})\b", r"(\1) ****-\2"),
):
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_put}', 'g')"

_FORMS = """WITH n AS (SELECT c_custkey, lpad(cast(c_custkey::BIGINT * 7919 % 1000000000 AS varchar), 9, '0') AS nine FROM customer),
 b AS (SELECT *, right(nine, 4) AS four, '411' || nine AS base FROM n),
 d AS (SELECT *, (10 - list_sum(list_transform(range(1, 13), lambda i: CASE WHEN i % 2 = 0
   THEN (2 * base[i]::int) // 10 + (2 * base[i]::int) % 10 ELSE base[i]::int END)) % 10) % 10 AS luhn FROM b)
SELECT c_custkey, CASE c_custkey % 10
  WHEN 0 THEN 'escreva a j***@exámplo.com.br, hoje'
  WHEN 1 THEN 'cartão **** **** **** ' || four || '.'
  WHEN 2 THEN 'pago com **** **** **** ' || right(base || luhn::int, 4) || ' ontem'
  WHEN 3 THEN 'pedido ' || base || ((luhn + 1) % 10)::int || ' ontem'
  WHEN 4 THEN 'de **** **** **** ' || four || ' para **** **** **** ' || four
  WHEN 5 THEN 'tel: ****-' || four
  WHEN 6 THEN 'ligue ****-' || four || ' já'
  WHEN 7 THEN '(11) ****-' || four || ' ou (21) ****-' || four
  WHEN 8 THEN 'ref ****-' || four || ', cel ****-' || four
  ELSE '12-345-2024, 2019-2024, 10.20.30.40, 2024-01-15, a' || nine || 'b e ' || nine END AS shown
FROM d"""

ORACLES = {
    "redact_forms": _FORMS,
    "masks": PEOPLE + f"""SELECT c_custkey, {_cpf('cpf')} AS cpf, {_email('email')} AS email,
        {_phone('telefone')} AS telefone,
        CASE WHEN instr(conta, '-') > 0 THEN '****' || right(split_part(conta, '-', 1), 1)
          || substr(conta, instr(conta, '-')) ELSE '****' || right(conta, 2) END AS conta,
        '**** **** **** ' || right(cartao, 4) AS cartao, {_name('nome')} AS nome, {_income('renda')} AS renda
        FROM people""",
    "mask_id": PEOPLE + f""", i AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN email WHEN 1 THEN 'abc'
         WHEN 2 THEN NULL ELSE cpf END AS id FROM people) SELECT c_custkey, {_id('id')} AS id FROM i""",
    "hashes": PEOPLE + f"""SELECT c_custkey, sha256(email) AS sha,
        sha256({_DIGITS.format(x='cpf')} || ':{SALT}') AS cpf_sha,
        'PSE_' || substr(sha256(email), 1, 8) AS pse, 'CLI_' || substr(sha256(nome), 1, 8) AS cli FROM people""",
    "sanitize": PEOPLE + f"""SELECT c_custkey, {_or_empty('nome', _name('nome'))} AS nome,
        {_or_empty('cpf', _cpf('cpf'))} AS cpf, {_or_empty('email', _email('email'))} AS email,
        {_or_empty('telefone', _phone('telefone'))} AS telefone, {_or_empty('cpf', _id('cpf'))} AS cliente_id,
        CASE WHEN c_custkey % 9 = 0 THEN '0.0' ELSE {_income('renda')} END AS renda_mensal,
        '***' AS password, substr(cartao, 1, 8) || '...' AS token FROM people""",
    "sanitize_map": PEOPLE + f"""SELECT c_custkey, {_or_empty('cpf', _cpf('cpf'))} AS cpf,
        {_email('email')} AS email, {_income('renda')} AS renda_mensal, nome AS motivo,
        '***' AS password, 5 AS n FROM people""",
    "encrypt_round_trip": PEOPLE + """SELECT c_custkey, cpf, email, nome, 1 AS email_hidden,
        CASE WHEN cpf = '' THEN '' ELSE 'x' END AS cpf_token FROM people""",
    "redaction_leftovers": """SELECT kind, count(*) FILTER (doc_id IS NULL) AS n_left
        FROM documents, (VALUES ('mail'), ('card'), ('phone')) k(kind) GROUP BY kind""",
    "redact_text": f"""SELECT doc_id, md5({_REDACT}) AS digest, length({_REDACT}) AS n_redacted FROM documents""",
}
