"""Uploads and drafts with defects, derived from the proposals, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.catalog.fixture_sql import PROP
from crivo.sources.star import raw_proposals

# Drafts: proposals under alias names, with missing, out-of-range and unknown values.
DRAFT_SQL = """proposta_id, cliente_id,
 CASE WHEN proposta_id % 23 = 0 THEN 150 WHEN proposta_id % 29 = 0 THEN NULL ELSE idade END AS idade,
 CASE WHEN proposta_id % 31 = 0 THEN 0 ELSE renda END AS renda_mensal,
 CASE WHEN proposta_id % 37 = 0 THEN 1000 ELSE score END AS score_credito,
 CASE WHEN proposta_id % 41 = 0 THEN ticket + 1000000 ELSE ticket END AS valor,
 CASE WHEN proposta_id % 43 = 0 THEN 0 ELSE prazo_meses END AS prazo,
 CASE WHEN proposta_id % 47 = 0 THEN 101 ELSE taxa_juros_aa END AS taxa,
 CASE WHEN proposta_id % 53 = 0 THEN -1 ELSE tempo_cliente_meses END AS tempo_relacionamento,
 CASE WHEN proposta_id % 59 = 0 THEN 11 ELSE qtd_produtos END AS qtd_produtos_ativos,
 CASE WHEN proposta_id % 61 = 0 THEN NULL ELSE qtd_atrasos_12m END AS qtd_atrasos_12m,
 CASE WHEN proposta_id % 67 = 0 THEN 'X' ELSE genero END AS genero,
 estado_civil,
 CASE WHEN proposta_id % 79 = 0 THEN NULL ELSE escolaridade END AS escolaridade,
 regiao,
 CASE WHEN proposta_id % 73 = 0 THEN 'XX' WHEN proposta_id % 2 = 0 THEN lower(uf) ELSE uf END AS uf,
 porte_municipio,
 CASE WHEN proposta_id % 71 = 0 THEN 'Veículo' WHEN tipo_credito = 'Imobiliário' THEN 'Imobiliario'
  WHEN tipo_credito = 'Cartão' THEN 'Cartao' ELSE tipo_credito END AS tipo_produto,
 CASE WHEN proposta_id % 83 = 0 THEN 'Fax' WHEN proposta_id % 3 = 0 THEN 'App'
  WHEN proposta_id % 3 = 1 THEN 'Agência' END AS canal_aquisicao"""

DRAFTS = PROP + f", drafts AS (SELECT {DRAFT_SQL} FROM prop)"

# Uploads: the same proposals as the eighteen text columns of a CSV.
UPLOAD_SQL = """cast(proposta_id AS {text}) AS cliente_id,
 CASE proposta_id % 20 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN concat(cast(idade AS {text}), ' anos')
  WHEN 3 THEN '0' WHEN 4 THEN concat(' ', cast(idade AS {text})) WHEN 5 THEN '33.9' ELSE cast(idade AS {text}) END AS idade,
 CASE proposta_id % 20 WHEN 6 THEN 'R$ 10' WHEN 7 THEN '.5' WHEN 8 THEN '1e3' WHEN 9 THEN NULL
  ELSE concat(cast(cast(renda AS int) AS {text}), '.25 reais') END AS renda_mensal,
 cast(score AS {text}) AS score_credito,
 CASE proposta_id % 20 WHEN 10 THEN '' WHEN 11 THEN '-5' ELSE cast(cast(floor(ticket) AS bigint) AS {text}) END AS valor,
 CASE proposta_id % 20 WHEN 12 THEN 'doze' ELSE cast(prazo_meses AS {text}) END AS prazo,
 CASE proposta_id % 20 WHEN 13 THEN '0.0' WHEN 14 THEN '0.124' ELSE cast(cast(floor(taxa_juros_aa) AS int) AS {text}) END AS taxa,
 cast(tempo_cliente_meses AS {text}) AS tempo_relacionamento,
 cast(qtd_produtos AS {text}) AS qtd_produtos_ativos,
 cast(qtd_atrasos_12m AS {text}) AS qtd_atrasos_12m,
 CASE proposta_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'Outro' WHEN 3 THEN genero ELSE 'x' END AS genero,
 CASE proposta_id % 20 WHEN 15 THEN '' ELSE estado_civil END AS estado_civil,
 CASE proposta_id % 7 WHEN 0 THEN 'Pós-graduação' WHEN 1 THEN 'ENSINO MÉDIO' WHEN 2 THEN 'superior incompleto'
  WHEN 3 THEN 'Graduação' WHEN 4 THEN 'pos superior' WHEN 5 THEN 'outra' ELSE escolaridade END AS escolaridade,
 regiao,
 CASE proposta_id % 20 WHEN 16 THEN NULL ELSE lower(uf) END AS uf,
 porte_municipio,
 CASE proposta_id % 7 WHEN 0 THEN 'Crédito Pessoal' WHEN 1 THEN 'Financiamento Veículo' WHEN 2 THEN 'Empréstimo Consignado'
  WHEN 3 THEN 'Cartão de Crédito' WHEN 4 THEN 'imobiliario' WHEN 5 THEN 'CDC Auto' ELSE '' END AS tipo_produto,
 CASE proposta_id % 6 WHEN 0 THEN 'Digital' WHEN 1 THEN 'Agência' WHEN 2 THEN 'Parceiro' WHEN 3 THEN 'Internet'
  WHEN 4 THEN 'Loja' ELSE '' END AS canal_aquisicao"""

UPLOADS = PROP + f", uploads AS (SELECT {UPLOAD_SQL.format(text='varchar')} FROM prop)"


def drafts(spark, folder) -> DataFrame:
    return spark.sql(f"SELECT {DRAFT_SQL} FROM {{rows}}", rows=raw_proposals(spark, folder))


def uploads(spark, folder) -> DataFrame:
    select = UPLOAD_SQL.format(text="string")
    return spark.sql(f"SELECT {select} FROM {{rows}}", rows=raw_proposals(spark, folder))


def batches(spark, folder) -> DataFrame:
    """Proposals with a batch key: one very large batch, the others of at most 500 rows."""
    key = F.when(F.col("proposta_id") % 3 == 0, -1).otherwise(
        F.floor(F.col("proposta_id") / 500)
    )
    return raw_proposals(spark, folder).withColumn("batch_id", key.cast("bigint"))


BATCHES = PROP + """, batches AS (SELECT *, CASE WHEN proposta_id % 3 = 0 THEN -1
 ELSE cast(floor(proposta_id / 500) AS bigint) END AS batch_id FROM prop)"""
