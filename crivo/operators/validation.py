"""Schema normalisation, row validation and table contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.decisions import client_or
from crivo.functions.ingest import number_or


def normalize_aliases(df: DataFrame) -> DataFrame:
    """Canonical names for accepted aliases; a canonical column already present wins."""
    present = set(df.columns)
    renames = {a: c for a, c in K.ALIASES.items() if a in present and c not in present}
    return df.withColumnsRenamed(renames)


def proposal_errors(df: DataFrame) -> list[Column]:
    """One nullable error code per rule: ``<column>_missing`` / ``_range`` / ``_enum``."""
    present = set(df.columns)
    checks: list[Column] = []
    for name, (low, low_allowed, high) in K.RANGES.items():
        if name not in present:
            if name != "qtd_atrasos_12m":
                checks.append(F.lit(f"{name}_missing"))
            continue
        value = F.col(name)
        if name == "qtd_atrasos_12m":
            value = F.coalesce(value, F.lit(0))
        inside = ((value >= low) if low_allowed else (value > low)) & (value <= high)
        checks.append(
            F.when(value.isNull(), f"{name}_missing").when(
                ~F.coalesce(inside, F.lit(False)), f"{name}_range"
            )
        )
    for name, allowed in (K.ENUM_RULES | K.OPTIONAL_ENUM_RULES).items():
        optional = name in K.OPTIONAL_ENUM_RULES
        if name not in present:
            if not optional:
                checks.append(F.lit(f"{name}_missing"))
            continue
        value = F.col(name)
        wrong = F.when(~value.isin(*allowed), f"{name}_enum")
        checks.append(wrong if optional else F.when(value.isNull(), f"{name}_missing").otherwise(
            wrong
        ))
    if "uf" in present:
        checks.append(
            F.when(F.col("uf").isNull(), "uf_missing").when(
                ~F.upper("uf").isin(*K.STATES), "uf_enum"
            )
        )
    else:
        checks.append(F.lit("uf_missing"))
    return checks


def validate_proposals(df: DataFrame) -> DataFrame:
    """Adds ``errors array<string>``; defaults late counts and upper-cases the state."""
    out = df.withColumn("errors", F.array_compact(F.array(*proposal_errors(df))))
    late = (
        F.coalesce(F.col("qtd_atrasos_12m"), F.lit(0))
        if "qtd_atrasos_12m" in df.columns
        else F.lit(0)
    )
    out = out.withColumn("qtd_atrasos_12m", late)
    return out.withColumn("uf", F.upper("uf")) if "uf" in df.columns else out


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error column, quarantined rows with it)."""
    ok = F.size("errors") == 0
    return validated.filter(ok).drop("errors"), validated.filter(~ok)


def check_batch_size(
    df: DataFrame, batch_key: str, batches: DataFrame | None = None, limit: int = K.BATCH_LIMIT
) -> DataFrame:
    """Rows per batch and whether the batch is accepted; ``batches`` lists the known keys."""
    sizes = df.groupBy(batch_key).agg(F.count(F.lit(1)).alias("n_rows"))
    if batches is not None:
        sizes = batches.select(batch_key).distinct().join(sizes, batch_key, "left").select(
            batch_key, F.coalesce("n_rows", F.lit(0)).alias("n_rows")
        )
    n = F.col("n_rows")
    return sizes.withColumn(
        "status", F.when(n == 0, "empty").when(n > limit, "too_large").otherwise("ok")
    )


def check_required_columns(
    df: DataFrame, columns: Sequence[str] = K.REQUIRED_DATASET_COLUMNS, label: str = "inadimplente"
) -> DataFrame:
    """One-row report: columns missing, row count, column count, label rate in percent."""
    missing = [c for c in columns if c not in df.columns]
    rate = F.round(F.avg(label) * 100, 2) if label in df.columns else F.lit(None).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), rate.alias("label_rate")).select(
        F.lit(not missing).alias("ok"),
        F.lit(",".join(missing)).alias("missing"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        "label_rate",
    )


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def resolve_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Label and amount under their canonical names, plus the columns to keep."""
    label = resolve_column(df, K.LABEL_CANDIDATES)
    amount = resolve_column(df, K.AMOUNT_CANDIDATES)
    return df.select(
        *keep, F.col(label).alias("inadimplente"), F.col(amount).alias("ticket")
    )


def check_feature_contract(
    df: DataFrame, expected: Sequence[str], encoders: Sequence[str] = (),
    expected_encoders: Sequence[str] = K.ENCODED_COLUMNS, model=None,
) -> DataFrame:
    """Report rows (check, ok, detail) comparing a model's contract with a feature table.

    The number of expected features must be the one the model was trained on (``numFeatures``);
    without a model, the one of the published contract. The names are compared on the schema; the rows are scanned once for missing inputs.
    """
    missing = [c for c in expected if c not in df.columns]
    width = len(K.FEATURE_ORDER) if model is None else int(model.numFeatures)
    absent = [c for c in expected_encoders if c not in encoders]

    def row(check: str, ok: Column | bool, detail: Column | str) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(ok).alias("ok"), F.lit(detail).alias("detail")
        )

    known = [F.col(c).isNull() for c in expected if c in df.columns]
    gap = F.lit(False)
    for part in known:
        gap = gap | part
    scanned = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps"))
    return scanned.select(
        F.inline(
            F.array(
                row("features_present", not missing, ",".join(missing)),
                row("feature_count", len(expected) == width, str(len(expected))),
                row("encoders_present", not absent, ",".join(absent)),
                row("encoder_count", len(encoders) == len(expected_encoders), str(len(encoders))),
                row("rows_present", F.col("n") > 0, F.col("n").cast("string")),
                row("rows_complete", F.col("gaps") == 0, F.col("gaps").cast("string")),
            )
        )
    )


def error_rows(quarantine: DataFrame) -> DataFrame:
    """Result rows for invalid proposals: decision ``Erro``, no probability, short message."""
    columns = set(quarantine.columns)
    name = F.col("nome") if "nome" in columns else F.lit(None).cast("string")
    return quarantine.select(
        client_or(
            "cliente_id", "CLI-ERROR-", [c for c in ("score", "ticket", "renda") if c in columns]
        ).alias("cliente_id"),
        F.coalesce(name, F.lit("Erro")).alias("nome"),
        F.coalesce(number_or(F.col("ticket").cast("string"), "float", 0.0), F.lit(0.0)).alias(
            "valor"
        ),
        F.lit(0.0).alias("probabilidade_inadimplencia"),
        F.coalesce(number_or(F.col("score").cast("string"), "int", 0), F.lit(0)).alias(
            "score_credito"
        ),
        F.lit("Erro").alias("decisao"),
        F.substring(F.array_join("errors", "; "), 1, 150).alias("motivo_rejeicao"),
        F.lit(0.0).alias("perda_evitada"),
        F.lit("N/A").alias("risco_categoria"),
    )
