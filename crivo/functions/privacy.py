"""Masking, hashing, pseudonyms and column encryption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.functions.common import ColumnLike, as_col, fixed

# Span patterns redacted in free text, applied in this order.
# A name may hold letters of any script; it is tried once, from its first character on.
TEXT_EMAIL = (
    "(?<![\\p{L}\\p{M}\\p{N}._%+'-])([._%+'-]*+)([\\p{L}\\p{N}_])[\\p{L}\\p{M}\\p{N}._%+'-]*+"
    "@((?:[\\p{L}\\p{M}\\p{N}-]++\\.)+\\p{L}{2,})"
)
_APART, _ENDS = "(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])"
# Cards as they are written: groups of four, 4-6-5 or 4-6-4, sixteen digits in a row.
TEXT_CARD = _APART + "[0-9]{4}(?:[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?|[ -][0-9]{6}[ -][0-9]?)([0-9]{4})" + _ENDS
# Other runs of digits are cards if their check digit holds.
TEXT_CARD_RUN = _APART + "(?:[0-9]{13,15}|[0-9]{17,19})" + _ENDS
# A phone has an area code of two or three digits in brackets or set apart, maybe a country prefix.
# Set apart only, it needs ten digits, which tells it from dates and part numbers.
TEXT_PHONE = (
    "\\+[0-9]{1,3}[ .-]([0-9]{2,3})[ .-]?[0-9]{3,5}[ .-]?([0-9]{4})\\b"
    "|(?:\\+[0-9]{1,3}[ .-]?)?(?:\\(([0-9]{2,3})\\)[ .-]?[0-9]{3,5}[ .-]?([0-9]{4})\\b"
    "|(?<![0-9.-])\\b(?=(?:[ .-]?[0-9]){10})([0-9]{2,3})[ .-][0-9]{3,5}[ .-]([0-9]{4})\\b)"
)
TEXT_PHONE_PLAIN = "\\+[0-9]{6,11}([0-9]{4})\\b"
# After a word for it any eight to eleven digits are a phone.
TEXT_PHONE_CALLED = (
    "(?i)\\b((?:tel|fone|telefone|phone|cel|celular|whatsapp|zap|fax)[.:]{0,2} ?)"
    "[0-9]{4,7}-?([0-9]{4})(?![0-9])"
)
# Ten or eleven digits in a row: area code, then a mobile (9) or a land line (2 to 5).
TEXT_PHONE_RUN = _APART + "[1-9]{2}(?:9[0-9]{4}|[2-5][0-9]{3})([0-9]{4})" + _ENDS
# Without area code: two groups joined by a dash, unless both are years.
TEXT_PHONE_LOCAL = (
    "(?<![\\p{L}\\p{N}]|[0-9][ .-]|[)] )(?!(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}(?![0-9]))"
    "[0-9]{3,5}-([0-9]{4})(?![\\p{L}\\p{N}]|-[0-9])"
)


def digits(text: ColumnLike) -> Column:
    return F.regexp_replace(as_col(text), "[^0-9]", "")


def luhn_valid(run: Column) -> Column:
    """Whether the last digit of a run of digits is its check digit."""
    return F.call_function("luhn_check", run)


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def mask_cpf(cpf: ColumnLike) -> Column:
    cpf = as_col(cpf)
    number = digits(cpf)
    return (
        F.when(_blank(cpf), "")
        .when(F.length(number) != 11, "***INVALID***")
        .otherwise(F.concat(F.lit("***.***.***-"), F.right(number, F.lit(2))))
    )


def mask_email(email: ColumnLike) -> Column:
    email = as_col(email)
    at = F.instr(email, "@")
    domain = F.substr(email, at + 1)
    return (
        F.when(_blank(email) | (at == 0), "***@***")
        .when(at <= 2, F.concat(F.lit("*@"), domain))
        .otherwise(F.concat(F.substring(email, 1, 1), F.lit("***@"), domain))
    )


def mask_phone(phone: ColumnLike) -> Column:
    phone = as_col(phone)
    number = digits(phone)
    return (
        F.when(_blank(phone), "")
        .when(F.length(number) < 8, "****-****")
        .otherwise(
            F.concat(
                F.lit("("), F.substring(number, 1, 2), F.lit(") ****-"), F.right(number, F.lit(4))
            )
        )
    )


def mask_account(account: ColumnLike) -> Column:
    account = as_col(account)
    dash = F.instr(account, "-")
    number = F.substring_index(account, "-", 1)
    return (
        F.when(_blank(account), "")
        .when(
            dash > 0,
            F.concat(F.lit("****"), F.right(number, F.lit(1)), F.substr(account, dash)),
        )
        .otherwise(F.concat(F.lit("****"), F.right(account, F.lit(2))))
    )


def mask_card(card: ColumnLike) -> Column:
    card = as_col(card)
    number = digits(card)
    return (
        F.when(_blank(card), "")
        .when(F.length(number) < 13, "**** **** **** ****")
        .otherwise(F.concat(F.lit("**** **** **** "), F.right(number, F.lit(4))))
    )


def mask_name(name: ColumnLike) -> Column:
    name = as_col(name)
    words = F.filter(F.split(name, "\\s+"), lambda w: w != "")
    masked = F.transform(
        words,
        lambda w: F.when(F.length(w) <= 2, w).otherwise(
            F.concat(F.substring(w, 1, 1), F.lit("***"))
        ),
    )
    return F.when(_blank(name), "").otherwise(F.array_join(masked, " "))


def mask_income(income: ColumnLike) -> Column:
    income = as_col(income)
    return (
        F.when(income < 1000, F.concat(F.lit("R$ "), income.cast("bigint").cast("string")))
        .when(income < 1000000, F.concat(F.lit("R$ "), fixed(income / 1000, 1), F.lit("k")))
        .otherwise(F.concat(F.lit("R$ "), fixed(income / 1000000, 1), F.lit("M")))
    )


def mask_id(value: ColumnLike) -> Column:
    """Client id for logs: CPF mask, else first and last four characters, else stars."""
    value = as_col(value)
    return (
        F.when(_blank(value), "***")
        .when(F.length(digits(value)) == 11, mask_cpf(value))
        .when(
            F.length(value) > 8,
            F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4))),
        )
        .otherwise("***")
    )


def mask_token(token: ColumnLike) -> Column:
    return F.concat(F.substring(as_col(token), 1, 8), F.lit("..."))


def hash_sha256(text: ColumnLike) -> Column:
    return F.sha2(as_col(text), 256)


def hash_cpf(cpf: ColumnLike, salt: str) -> Column:
    """Salted hash of the digits; the salt comes from the caller's secret store."""
    return F.sha2(F.concat(digits(cpf), F.lit(":"), F.lit(salt)), 256)


def pseudonymize(text: ColumnLike, prefix: str = "PSE") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(hash_sha256(text), 1, 8))


# Mask chosen by column or field name.
MASKS = {
    "cliente_id": mask_id,
    "cpf": mask_cpf,
    "email": mask_email,
    "telefone": mask_phone,
    "nome": mask_name,
    "renda_mensal": mask_income,
    "password": lambda _: F.lit("***"),
    "token": mask_token,
    "access_token": mask_token,
    "refresh_token": mask_token,
}


def sanitize(df: DataFrame) -> DataFrame:
    """Masks every sensitive column of the table; empty and zero values stay as they are."""
    masked = {}
    for name, mask in MASKS.items():
        if name in df.columns:
            value = F.col(name)
            text = value.cast("string")
            empty = value.isNull() | (value == 0 if name == "renda_mensal" else value == "")
            masked[name] = F.when(empty, text).otherwise(mask(value))
    return df.withColumns(masked)


def sanitize_map(details: ColumnLike) -> Column:
    """Masks the sensitive entries of a string map by field name."""

    def masked(field: Column, value: Column) -> Column:
        out = F.when(_blank(value), value)
        for name, mask in MASKS.items():
            if name == "renda_mensal":
                number = value.try_cast("double")
                safe = (
                    F.when(number == 0, value)
                    .when(number.isNotNull(), mask_income(number))
                    .otherwise("***")
                )
            else:
                safe = mask(value)
            out = out.when(field == name, safe)
        return out.otherwise(value)

    return F.transform_values(as_col(details), masked)


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """AES-GCM on the chosen columns as base64 text; empty values are left alone."""
    out = {}
    for name in columns:
        text = F.col(name).cast("string")
        token = F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")))
        out[name] = F.when(_blank(text), text).otherwise(token)
    return df.withColumns(out)


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    out = {}
    for name in columns:
        token = F.col(name)
        text = F.aes_decrypt(F.unbase64(token), key, F.lit("GCM"), F.lit("DEFAULT"))
        out[name] = F.when(_blank(token), token).otherwise(text.cast("string"))
    return df.withColumns(out)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body on a value that is evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masked_where(text: Column, pattern: str, test: Callable[[Column], Column], mask: Callable[[Column], Column]) -> Column:
    """Masks the spans of a pattern that pass a test; the text between them stays. ``text`` is a name, not work."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def masked(spans: Column) -> Column:
        def with_span(piece: Column, k: Column) -> Column:
            span = F.get(spans, k)
            return F.concat(piece, F.when(span.isNull(), "").when(test(span), mask(span)).otherwise(span))

        return F.array_join(F.transform(between, with_span), "")

    return F.when(text.rlike(pattern), _once(found, masked)).otherwise(text)


def _numbers_redacted(text: Column) -> Column:
    cards = _once(
        F.regexp_replace(text, TEXT_CARD, "**** **** **** $1"),
        lambda t: _masked_where(
            t, TEXT_CARD_RUN, luhn_valid, lambda run: F.concat(F.lit("**** **** **** "), F.right(run, F.lit(4)))
        ),
    )
    phones = F.regexp_replace(cards, TEXT_PHONE, "($1$3$5) ****-$2$4$6")
    phones = F.regexp_replace(phones, TEXT_PHONE_PLAIN, "****-$1")
    phones = F.regexp_replace(phones, TEXT_PHONE_CALLED, "$1****-$2")
    phones = F.regexp_replace(phones, TEXT_PHONE_RUN, "****-$1")
    phones = F.regexp_replace(phones, TEXT_PHONE_LOCAL, "****-$1")
    return F.when(text.rlike("[0-9]{4}"), phones).otherwise(text)


def redact_text(text: ColumnLike) -> Column:
    """Masks mail addresses, card numbers and phone numbers anywhere in a text.

    Names of mail addresses may hold letters of any script. Cards are sixteen digits, the usual
    groups, and runs of 13 to 19 digits whose check digit holds. Phones have a country prefix, an
    area code, a word for phone before them, the ten or eleven digits of a full number, or two
    groups joined by a dash. Dates, addresses of machines and digits inside words stay. Texts
    without an at sign or four digits in a row are passed on unread by the patterns. Each pattern
    reads a text once: the text and every stage that is named more than once are bound.
    """

    def mails_redacted(plain: Column) -> Column:
        return F.when(plain.contains("@"), F.regexp_replace(plain, TEXT_EMAIL, "$1$2***@$3")).otherwise(plain)

    return _once(as_col(text), lambda plain: _once(mails_redacted(plain), _numbers_redacted))
