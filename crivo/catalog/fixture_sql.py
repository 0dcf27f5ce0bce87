"""The table mappings of ``crivo.sources.star`` as SQL, to prefix the checking statements."""

PROP = """
WITH base AS (
 SELECT o_orderkey AS proposta_id,
  lpad(cast((c_custkey*7919+12345678901) % 100000000000 AS varchar(20)),11,'0') AS cliente_id,
  cast(18 + (c_custkey*7) % 53 AS int) AS idade,
  cast(1200 + (c_custkey*131) % 18801 AS double) AS renda,
  cast(300 + (c_custkey*37 + o_orderkey*13) % 651 AS int) AS score,
  o_totalprice AS ticket,
  CASE o_orderkey % 8 WHEN 0 THEN 6 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 36 WHEN 4 THEN 48 WHEN 5 THEN 60 WHEN 6 THEN 84 ELSE 120 END AS prazo_meses,
  cast(800 + (o_orderkey*17) % 1201 AS double)/cast(100 AS double) AS taxa_juros_aa,
  cast(1 + c_custkey % 119 AS int) AS tempo_cliente_meses,
  cast(1 + c_custkey % 5 AS int) AS qtd_produtos,
  CASE o_orderkey % 4 WHEN 0 THEN 'CDC' WHEN 1 THEN 'Imobiliário' WHEN 2 THEN 'Cartão' ELSE 'Pessoal' END AS tipo_credito,
  CASE n_regionkey WHEN 0 THEN 'Norte' WHEN 1 THEN 'Nordeste' WHEN 2 THEN 'Centro-Oeste' WHEN 3 THEN 'Sudeste' ELSE 'Sul' END AS regiao,
  CASE c_custkey % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'RS' WHEN 4 THEN 'BA' ELSE 'PR' END AS uf,
  CASE c_custkey % 2 WHEN 0 THEN 'Masculino' ELSE 'Feminino' END AS genero,
  CASE c_custkey % 4 WHEN 0 THEN 'Solteiro' WHEN 1 THEN 'Casado' WHEN 2 THEN 'Divorciado' ELSE 'Viúvo' END AS estado_civil,
  CASE (c_custkey+1) % 4 WHEN 0 THEN 'Fundamental' WHEN 1 THEN 'Médio' WHEN 2 THEN 'Superior' ELSE 'Pós-Graduação' END AS escolaridade,
  CASE (c_custkey+2) % 4 WHEN 0 THEN 'Pequeno' WHEN 1 THEN 'Médio' WHEN 2 THEN 'Grande' ELSE 'Metrópole' END AS porte_municipio,
  cast((o_orderkey*2654435761) % 1000003 AS double)/cast(1000003 AS double) AS u
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey),
der AS (
 SELECT *, cast(CASE WHEN score<500 THEN proposta_id % 6 WHEN score<700 THEN proposta_id % 3 WHEN proposta_id % 100=0 THEN 1 ELSE 0 END AS int) AS qtd_atrasos_12m,
  ticket*(taxa_juros_aa/12/100*power(1+taxa_juros_aa/12/100,prazo_meses))/(power(1+taxa_juros_aa/12/100,prazo_meses)-1) AS parcela_mensal
 FROM base),
prob AS (
 SELECT *, parcela_mensal/renda*100 AS perc,
   power(cast(0.40 AS double)*((950-score)/cast(650 AS double)) + cast(0.30 AS double)*least(greatest(parcela_mensal/renda,0),1)
     + cast(0.20 AS double)*least(qtd_atrasos_12m/cast(5 AS double),1) + cast(0.10 AS double)*least(greatest((60-tempo_cliente_meses)/cast(60 AS double),0),1),2) AS p
 FROM der),
prop AS (SELECT *, CASE WHEN u < p THEN 1 ELSE 0 END AS inadimplente, (score-300)/cast(650 AS double) AS sn FROM prob)
"""

_IP = (
    "concat('10.0.', cast(cast(floor(user_id/256) AS int) AS varchar(10)), '.', "
    "cast(user_id % 256 AS varchar(10)))"
)

REQUESTS = f"""
WITH requests AS (
 SELECT event_id, ts, user_id, {_IP} AS ip,
  CASE event_type WHEN 'click' THEN '/api/v1/predict' WHEN 'purchase' THEN '/api/v1/predict/batch'
   WHEN 'signup' THEN '/api/v1/auth/login' WHEN 'error' THEN '/api/v1/auth/token' ELSE '/api/v1/metrics' END AS endpoint
 FROM events)
"""

AUDIT = f"""
WITH audit AS (
 SELECT event_id, ts AS "timestamp", cast(ts AS date) AS event_date,
  CASE event_type WHEN 'click' THEN 'prediction_success' WHEN 'purchase' THEN 'batch_prediction'
   WHEN 'signup' THEN 'login_success' WHEN 'view' THEN 'data_access'
   ELSE CASE event_id % 3 WHEN 0 THEN 'login_failed' WHEN 1 THEN 'unauthorized_access' ELSE 'system_error' END END AS event_type,
  CASE WHEN event_type='error' THEN CASE event_id % 3 WHEN 0 THEN 'warning' ELSE 'error' END
   WHEN event_type='click' AND value > 100 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE cast(user_id AS varchar(20)) END AS user_id,
  CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'admin' WHEN 2 THEN 'analyst' ELSE 'operator' END AS username,
  {_IP} AS ip_address,
  props AS details_json
 FROM events)
"""

PEOPLE = """
WITH people AS (
 SELECT c_custkey,
  concat('Ana ', CASE c_custkey % 3 WHEN 0 THEN 'da ' WHEN 1 THEN 'de ' ELSE '' END, c_mktsegment) AS nome,
  CASE WHEN c_custkey % 50 = 0 THEN '123' WHEN c_custkey % 51 = 0 THEN ''
   ELSE lpad(cast((c_custkey*7919+12345678901) % 100000000000 AS varchar(20)),11,'0') END AS cpf,
  CASE WHEN c_custkey % 40 = 0 THEN 'invalid-email' WHEN c_custkey % 41 = 0 THEN 'a@example.com'
   ELSE concat(lower(c_mktsegment),'.',cast(c_custkey AS varchar(20)),'@example.com') END AS email,
  concat('(',cast(11+c_custkey % 80 AS varchar(4)),') 9',lpad(cast(c_custkey*31 % 10000 AS varchar(8)),4,'0'),'-',
   lpad(cast(c_custkey*17 % 10000 AS varchar(8)),4,'0')) AS telefone,
  CASE WHEN c_custkey % 2 = 0 THEN concat(cast(10000+c_custkey AS varchar(12)),'-',cast(c_custkey % 10 AS varchar(2)))
   ELSE cast(100000+c_custkey AS varchar(12)) END AS conta,
  lpad(cast((c_custkey*104729+4000000000000000) % 10000000000000000 AS varchar(20)),16,'0') AS cartao,
  cast(500 + (c_custkey*977) % 1600000 AS double) AS renda
 FROM customer)
"""


def values_rows(rows) -> str:
    """A VALUES list of text and number rows."""

    def one(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)


def step_case(x: str, steps, rest, op: str) -> str:
    """CASE over an ordered list of bounds."""
    whens = " ".join(f"WHEN {x} {op} {bound!r} THEN {value!r}" for bound, value in steps)
    return f"CASE {whens} ELSE {rest!r} END"
