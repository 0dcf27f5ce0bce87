"""Typing of uploaded CSV text: prefix number parsing, defaults and name mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col, lookup

# Leading part of a text that counts as a number.
INT_PREFIX = "^\\s*([+-]?[0-9]+)"
FLOAT_PREFIX = "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

# Substrings tested in order, and the value they stand for.
PRODUCT_RULES = (
    (("Pessoal", "pessoal"), "Pessoal"),
    (("CDC", "cdc"), "CDC"),
    (("Imobiliário", "Imobiliario", "imobili"), "Imobiliario"),
    (("Cartão", "Cartao", "cart"), "Cartao"),
    (("Veículo", "Veiculo", "Auto"), "CDC"),
)
CHANNEL_RULES = (
    (("App", "app", "Digital", "digital"), "App"),
    (("Agência", "Agencia", "agencia"), "Agência"),
    (("Parceiro", "parceiro"), "Parceiro"),
    (("Internet", "Banking", "internet"), "Internet Banking"),
)
GENDER_MAP = {
    "M": "Masculino", "F": "Feminino",
    "Masculino": "Masculino", "Feminino": "Feminino", "Outro": "Outro",
}


def text_or(value: ColumnLike, default: str) -> Column:
    """Text, or the default when missing or empty."""
    return F.coalesce(F.nullif(as_col(value), F.lit("")), F.lit(default))


def number_or(value: ColumnLike, kind: str, default: float) -> Column:
    """Number at the start of a text, or the default when missing, unparsable or zero."""
    pattern, target = (INT_PREFIX, "int") if kind == "int" else (FLOAT_PREFIX, "double")
    parsed = F.regexp_extract(as_col(value), pattern, 1).try_cast(target)
    return F.coalesce(F.nullif(parsed, F.lit(0).cast(target)), F.lit(default).cast(target))


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = text.contains(parts[0])
    for part in parts[1:]:
        hit = hit | text.contains(part)
    return hit


def _first_match(text: Column, rules: tuple, rest: str) -> Column:
    out = None
    for parts, value in rules:
        hit = _contains_any(text, parts)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(rest)


def map_gender(text: ColumnLike) -> Column:
    return F.coalesce(lookup(text_or(text, "M"), GENDER_MAP), F.lit("Masculino"))


def map_product(text: ColumnLike) -> Column:
    return _first_match(text_or(text, "Pessoal"), PRODUCT_RULES, "Pessoal")


def map_channel(text: ColumnLike) -> Column:
    return _first_match(text_or(text, "App"), CHANNEL_RULES, "App")


def map_schooling(text: ColumnLike) -> Column:
    low = F.lower(text_or(text, "Superior"))
    post = _contains_any(low, ("pós", "pos"))
    return (
        F.when(low.contains("fundamental"), "Fundamental")
        .when(_contains_any(low, ("médio", "medio")), "Médio")
        .when(low.contains("superior") & ~post, "Superior")
        .when(post | low.contains("gradua"), "Pós-Graduação")
        .otherwise("Superior")
    )


def coerce_csv(df: DataFrame) -> DataFrame:
    """Numbers and plain texts of an upload, typed and defaulted; the other columns stay."""
    out = {name: number_or(name, kind, default) for name, (kind, default) in K.CSV_NUMBERS.items()}
    out |= {name: text_or(name, default) for name, default in K.CSV_TEXTS.items()}
    out["uf"] = F.upper(out["uf"])
    return df.withColumns(out)


def map_enums(df: DataFrame) -> DataFrame:
    """Gender, product, channel and schooling as the service spells them."""
    return df.withColumns(
        {
            "genero": map_gender("genero"),
            "escolaridade": map_schooling("escolaridade"),
            "tipo_produto": map_product("tipo_produto"),
            "canal_aquisicao": map_channel("canal_aquisicao"),
        }
    )
