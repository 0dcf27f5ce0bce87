"""Value tables of the credit domain.

Fixed values: every list, map and number in this module has to equal the published contract of
the portfolio service, because results are compared against it.
"""

from __future__ import annotations

# --- score scale -----------------------------------------------------------------------------
SCORE_MIN = 300
SCORE_MAX = 950
SCORE_SPAN = SCORE_MAX - SCORE_MIN

# --- threshold grids (exact doubles, see SURVEY T3) ------------------------------------------
SENSITIVITY_GRID = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7000000000000001, 0.8, 0.9)
ROC_POINTS = 50
ROC_GRID = tuple(i * (1.0 / (ROC_POINTS - 1)) for i in range(ROC_POINTS - 1)) + (1.0,)

# --- allowed values ---------------------------------------------------------------------------
PRODUCTS = ("CDC", "Imobiliario", "Cartao", "Pessoal")
CHANNELS = ("App", "Site", "Agência", "Telefone", "Parceiro", "Internet Banking")
REGIONS = ("Sudeste", "Sul", "Nordeste", "Centro-Oeste", "Norte")
GENDERS = ("Masculino", "Feminino", "Outro")
MARITAL = ("Solteiro", "Casado", "Divorciado", "Viúvo")
SCHOOLING = ("Fundamental", "Médio", "Superior", "Pós-Graduação")
CITY_SIZES = ("Pequeno", "Médio", "Grande", "Metrópole")
STATES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB",
    "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)

# --- accepted alias -> canonical column -------------------------------------------------------
ALIASES = {
    "renda_mensal": "renda",
    "score_credito": "score",
    "valor": "ticket",
    "prazo": "prazo_meses",
    "taxa": "taxa_juros_aa",
    "tempo_relacionamento": "tempo_cliente_meses",
    "qtd_produtos_ativos": "qtd_produtos",
    "tipo_produto": "tipo_credito",
}

# --- numeric rules: column -> (low, low is allowed, high) -------------------------------------
RANGES = {
    "idade": (18, True, 100),
    "renda": (0, False, 1_000_000),
    "score": (300, True, 950),
    "ticket": (0, False, 1_000_000),
    "prazo_meses": (1, True, 360),
    "taxa_juros_aa": (0, True, 100),
    "tempo_cliente_meses": (0, True, 600),
    "qtd_produtos": (0, True, 10),
    "qtd_atrasos_12m": (0, True, 100),
}
ENUM_RULES = {
    "genero": GENDERS,
    "estado_civil": MARITAL,
    "escolaridade": SCHOOLING,
    "regiao": REGIONS,
    "porte_municipio": CITY_SIZES,
    "tipo_credito": PRODUCTS,
}
OPTIONAL_ENUM_RULES = {"canal_aquisicao": CHANNELS}
BATCH_LIMIT = 1000

REQUIRED_DATASET_COLUMNS = (
    "score", "renda", "idade", "ticket", "prazo_meses", "taxa_juros_aa", "inadimplente",
)
LABEL_CANDIDATES = ("inadimplente", "TARGET", "default", "bad", "target", "Default", "y", "label")
AMOUNT_CANDIDATES = ("ticket", "valor", "amount", "VALOR_EMPRESTIMO", "loan_amount")

# --- products: code -> (display name, long name, min, mean, max, bank rate), % per year -------
PRODUCT_RATES = {
    "CDC": ("CDC", "Crédito Direto ao Consumidor (CDC)", 25.0, 35.0, 75.0, 29.03),
    "Pessoal": ("Pessoal", "Crédito Pessoal Não Consignado", 28.0, 35.0, 60.0, 31.56),
    "Imobiliario": ("Imobiliário", "Crédito Imobiliário", 8.0, 10.0, 16.0, 10.0),
    "Cartao": ("Cartão", "Cartão de Crédito Rotativo", 250.0, 350.0, 500.0, 434.75),
}
DEFAULT_MIN_RATE = 28.0
DEFAULT_MEAN_RATE = 24.0

# --- rates and margins ------------------------------------------------------------------------
FUNDING_RATE = 13.31
MIN_MARGIN = 5.0
PROVISION_FACTOR = 1.5
OPERATING_COST = 0.0075

# --- loss given default by product ------------------------------------------------------------
LGD_BY_PRODUCT = {"CDC": 0.55, "Cartao": 0.70, "Imobiliario": 0.35, "Pessoal": 0.60}

# --- default encoder codes --------------------------------------------------------------------
DEFAULT_LABEL_MAPS = {
    "faixa_etaria": ("18-25", "26-35", "36-45", "46-55", "56-65", "66+"),
    "genero": ("Masculino", "Feminino", "Outro"),
    "estado_civil": ("Solteiro", "Casado", "Divorciado", "Viúvo"),
    "escolaridade": ("Fundamental", "Médio", "Superior", "Pós-Graduação"),
    "regiao": ("Sudeste", "Sul", "Nordeste", "Centro-Oeste", "Norte"),
    "uf": (
        "SP", "RJ", "MG", "ES", "PR", "SC", "RS", "BA", "CE", "PE", "AL", "PB", "RN", "SE",
        "MA", "PI", "GO", "MT", "MS", "DF", "AM", "PA", "RO", "AC", "RR", "AP", "TO",
    ),
    "porte_municipio": ("Pequeno", "Médio", "Grande", "Metrópole"),
    "tipo_credito": ("CDC", "Imobiliário", "Cartão", "Pessoal"),
}
ENCODED_COLUMNS = (
    "faixa_etaria", "genero", "estado_civil", "escolaridade", "regiao", "uf",
    "porte_municipio", "tipo_credito",
)
FEATURE_ORDER = (
    "idade", "renda", "score", "ticket", "prazo_meses", "taxa_juros_aa", "parcela_mensal",
    "tempo_cliente_meses", "qtd_produtos", "qtd_atrasos_12m", "perc_comprometimento_renda",
    "alto_comprometimento", "fator_risco",
) + tuple(f"{c}_encoded" for c in ENCODED_COLUMNS)
COMPACT_NUMERIC = (
    "score", "renda", "idade", "tempo_relacionamento", "qtd_produtos_ativos", "prazo", "taxa",
    "valor_renda_ratio", "ticket",
)
COMPACT_ENCODED = ("tipo_produto", "regiao", "canal")
FOREST_FEATURES = (
    "idade", "renda", "score", "ticket", "prazo_meses", "taxa_juros_aa", "tempo_cliente_meses",
    "qtd_produtos", "qtd_atrasos_12m",
)

# --- CSV upload: column -> (kind, default used when missing, unparsable or zero) ----------------
CSV_NUMBERS = {
    "idade": ("int", 30),
    "renda_mensal": ("float", 3000.0),
    "score_credito": ("int", 650),
    "valor": ("float", 10000.0),
    "prazo": ("int", 12),
    "taxa": ("float", 2.5),
    "tempo_relacionamento": ("int", 12),
    "qtd_produtos_ativos": ("int", 1),
    "qtd_atrasos_12m": ("int", 0),
}
CSV_TEXTS = {
    "estado_civil": "Solteiro",
    "regiao": "Sudeste",
    "uf": "SP",
    "porte_municipio": "Grande",
}
CSV_COLUMNS = (
    "cliente_id", "idade", "renda_mensal", "score_credito", "valor", "prazo", "taxa",
    "tempo_relacionamento", "qtd_produtos_ativos", "qtd_atrasos_12m", "genero", "estado_civil",
    "escolaridade", "regiao", "uf", "porte_municipio", "tipo_produto", "canal_aquisicao",
)

# --- request limits: pattern -> (requests, window seconds, block minutes), in matching order ----
ENDPOINT_LIMITS = (
    ("/api/v1/predict", 60, 60, 15),
    ("/api/v1/predict/batch", 10, 60, 30),
    ("/api/v1/auth/token", 5, 300, 60),
    ("/api/v1/auth/login", 5, 300, 60),
)
DEFAULT_LIMIT = (100, 60, 15)
WHITELIST = ("127.0.0.1", "localhost")

# --- metric seed rows --------------------------------------------------------------------------
SEED_METRICS = (
    ("1.0.0", "accuracy", 0.92),
    ("1.0.0", "precision", 0.82),
    ("1.0.0", "recall", 0.78),
    ("1.0.0", "f1_score", 0.80),
    ("1.0.0", "auc_roc", 0.85),
)
