"""Training, tuning, evaluating, saving and serving the default classifier."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions import decisions as D
from crivo.functions.features import default_code, with_features
from crivo.operators.encoding import encode_labels, fit_label_encoder
from crivo.operators.evaluation import class_weight, evaluation_summary, feature_importance_top
from crivo.operators.sampling import stratified_folds, stratified_split
from crivo.operators.validation import normalize_aliases, validate_proposals
from crivo.plans.boosting import BoostedTrees, Recipe, fit_boosted
from crivo.session import drop_stored, reliable_checkpoint, stored, use_checkpoint_dir

# The recipes. The first is in the terms of Spark's own learner (no leaf count, no L1/L2).
PREMIUM = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 10, "minInstancesPerNode": 20,
           "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
REGULARISED = {"rounds": 1000, "rate": 0.03, "leaves": 63, "depth": 8, "rows_in_leaf": 50, "l1": 0.5, "l2": 0.5,
               "row_share": 0.9, "rows_every": 5, "feature_share": 0.9}
PATIENCE = 100
FOREST = {"numTrees": 10, "maxDepth": 5}
# Search space, (low, high, logarithmic).
SPACE = {
    "maxIter": (100, 500, False),
    "stepSize": (0.01, 0.3, True),
    "maxDepth": (3, 15, False),
    "minInstancesPerNode": (10, 100, False),
    "subsamplingRate": (0.5, 1.0, False),
    "featureSubsetStrategy": (0.5, 1.0, False),
}
WHOLE_NUMBERS = ("maxIter", "maxDepth", "minInstancesPerNode")

# Fixed value: share of defaults in the portfolio that the decision cuts were made for.
PRIOR = 0.0639
# Fixed values: (name, score, income, value, months, late count, expected decision).
PROFILES = (
    ("Score 850 - Excelente", 850, 15000.0, 20000.0, 24, 0, "Aprovar"),
    ("Score 750 - Bom", 750, 8000.0, 15000.0, 24, 0, "Aprovar"),
    ("Score 650 - Regular", 650, 5000.0, 15000.0, 24, 0, "Aprovar"),
    ("Score 550 - Ruim", 550, 4000.0, 10000.0, 24, 1, "Aprovar"),
    ("Score 450 - Muito Ruim", 450, 3000.0, 8000.0, 24, 2, "Negar"),
    ("Score 350 - Péssimo", 350, 2000.0, 5000.0, 12, 3, "Negar"),
)
PROFILE_REST = {
    "idade": 35, "taxa_juros_aa": 30.0, "tempo_cliente_meses": 24, "qtd_produtos": 2,
    "genero": "Masculino", "estado_civil": "Casado", "escolaridade": "Superior",
    "regiao": "Sudeste", "uf": "SP", "porte_municipio": "Metrópole", "tipo_credito": "CDC",
}
# Extreme model inputs in feature order, with the bound their probability must meet.
EXTREMES = (
    ("ALTO RISCO", "above", 0.7,
     (18, 500, 300, 400000, 120, 15.0, 5000, 6, 1, 5, 1000.0, 1, 1.0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("BAIXO RISCO", "below", 0.2,
     (35, 15000, 900, 5000, 12, 8.0, 450, 60, 5, 0, 3.0, 0, 0.08, 1, 1, 1, 2, 0, 0, 3, 1)),
)

#: Rows of a training task at most. The learner keeps some 800 bytes a row and task, so its tasks
#: read no more at any size of the table.
ROWS_A_TASK = 250_000


# --- inputs -----------------------------------------------------------------------------------
def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Adds a vector of the columns in the given order; missing values are 0."""
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return df.withColumn(out, array_to_vector(values))


def with_codes(df: DataFrame, encoder: DataFrame | None = None) -> DataFrame:
    """Adds the derived columns and the codes: every input of the model as a column."""
    rows = with_features(df)
    if encoder is None:
        return rows.withColumns(
            {f"{c}_encoded": default_code(c, c) for c in K.ENCODED_COLUMNS}
        )
    # the codes of eight short lists of categories, as small as the lists
    return encode_labels(rows, encoder, K.ENCODED_COLUMNS, fold=True, literal=True)


def assemble_features(df: DataFrame, encoder: DataFrame | None = None) -> DataFrame:
    """Adds the derived columns, the codes and the 21-value ``features`` vector."""
    return assemble(with_codes(df, encoder), K.FEATURE_ORDER)


def assemble_compact(df: DataFrame, encoder: DataFrame) -> DataFrame:
    """The twelve-input recipe: nine numbers and three fitted codes."""
    rows = encode_labels(df, encoder, K.COMPACT_ENCODED, literal=True)
    return assemble(rows, K.COMPACT_NUMERIC + tuple(f"{c}_encoded" for c in K.COMPACT_ENCODED))


def weighted(df: DataFrame, label: str = "inadimplente") -> DataFrame:
    """Adds ``weight``: positives count negatives-per-positive times (one number to the plan)."""
    ratio = class_weight(df, label).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(1.0))


def _training_rows(df: DataFrame, label: str, *more: str) -> DataFrame:
    rows = weighted(df, label)
    return rows.select("features", F.col(label).cast("double").alias("label"), "weight", *more)


def dealt(rows: DataFrame, size: int | None = None) -> DataFrame:
    """The rows in tasks of at most about ``size`` each; a table that fills one task stays as it is.

    Files hand over a task's rows by bytes on disk, of which these rows need few. The order within a
    task follows from the rows, so a task that runs again sees the same one.
    """
    tasks = math.ceil(rows.count() / (size or ROWS_A_TASK))
    if tasks <= 1:
        return rows
    return rows.repartition(tasks).sortWithinPartitions(F.xxhash64(*rows.columns))


# --- training ---------------------------------------------------------------------------------
def train_gbt(
    df: DataFrame, label: str = "inadimplente", seed: int = 42, validation: str | None = None,
    validation_tol: float = 0.01, **params,
) -> GBTClassificationModel:
    """Boosted trees on a table with ``features``; class weights balance the label.

    ``validation`` names a boolean column whose rows decide when to stop early.
    """
    use_checkpoint_dir(df.sparkSession)
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=seed,
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024, **(PREMIUM | params),
    )
    more = ()
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
        learner = learner.setParams(validationTol=validation_tol)
        more = (validation,)
    return learner.fit(dealt(_training_rows(df, label, *more)))


def train_regularised(
    df: DataFrame, label: str = "inadimplente", seed: int = 42, keys: Sequence[str] = (), **params
) -> BoostedTrees:
    """Leaf-wise trees with L1 and L2 terms on a table with ``features``; class weights balance the label.

    ``params`` override fields of the regularised recipe; ``keys`` tell rows apart for sampling.
    """
    return fit_boosted(_training_rows(df, label, *keys), Recipe(**(REGULARISED | {"seed": seed} | params)), keys)


def train_with_patience(
    df: DataFrame, validation: str, label: str = "inadimplente", patience: int = PATIENCE, seed: int = 42,
    keys: Sequence[str] = (), **params,
) -> tuple[BoostedTrees, list[float]]:
    """The regularised recipe, stopped ``patience`` rounds after the best round on the validation rows.

    Returns the model up to its best round and the loss after every round grown, from round 0 on.
    Every round is grown once; validation rows take no part in growing.
    """
    recipe = Recipe(**(REGULARISED | {"seed": seed, "patience": patience} | params))
    model = fit_boosted(_training_rows(df, label, validation, *keys), recipe, keys, validation)
    return model, model.losses


def train_forest(df: DataFrame, label: str = "inadimplente", seed: int = 42, **params):
    """Random forest on the nine raw inputs."""
    rows = assemble(df, K.FOREST_FEATURES).select(
        "features", F.col(label).cast("double").alias("label")
    )
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", seed=seed, **(FOREST | params)
    ).fit(rows)


def sampled_params(n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """n random points of the search space."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        point = {}
        for name, (low, high, log) in (space or SPACE).items():
            if name in WHOLE_NUMBERS:
                point[name] = draw.randint(low, high)
            elif log:
                point[name] = math.exp(draw.uniform(math.log(low), math.log(high)))
            else:
                point[name] = draw.uniform(low, high)
        if "featureSubsetStrategy" in point:
            point["featureSubsetStrategy"] = f"{point['featureSubsetStrategy']:.4f}"
        out.append(point)
    return out


def tune(
    df: DataFrame, keys: list[str], label: str = "inadimplente", n: int = 20, folds: int = 3,
    seed: int = 42, space: dict | None = None, parallelism: int = 2,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Cross-validated random search; returns the best model and (trial, mean_auc, params)."""
    use_checkpoint_dir(df.sparkSession)
    folded = stored(_training_rows(stratified_folds(df, keys, folds, seed), label, "fold"), "folds")
    rows = reliable_checkpoint(dealt(folded))  # every fold and point reads them, none shuffles them
    drop_stored(folded)
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=seed,
        cacheNodeIds=True, checkpointInterval=10,
    )
    points = sampled_params(n, seed, space)
    maps = [{learner.getParam(k): v for k, v in point.items()} for point in points]
    search = CrossValidator(
        estimator=learner, estimatorParamMaps=maps, foldCol="fold", numFolds=folds,
        parallelism=parallelism, seed=seed,
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"),
    ).fit(rows)
    trials = [
        (i, float(auc), str(sorted(point.items())))
        for i, (auc, point) in enumerate(zip(search.avgMetrics, points))
    ]
    report = df.sparkSession.createDataFrame(trials, "trial int, mean_auc double, params string")
    return search.bestModel, report


# --- scoring and evaluation -------------------------------------------------------------------
def with_probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Adds the model's default probability; the learner's own columns are dropped."""
    if isinstance(model, BoostedTrees):
        return df.withColumn(out, model.probability())
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def evaluate(
    model, df: DataFrame, label: str = "inadimplente", threshold: float = 0.5
) -> DataFrame:
    """AUC, KS, best cut and the report on a table with ``features``, rows scored once."""
    rows = with_probability(model, df.select("features", label)).select("p", label)
    return evaluation_summary(rows, "p", label, threshold)


def importances(model, spark: SparkSession, k: int = 10, names: Sequence[str] = K.FEATURE_ORDER):
    return feature_importance_top(model, list(names), k, spark)


def score_batch(
    model, df: DataFrame, encoder: DataFrame | None = None, threshold: float = 0.5,
    model_version: str = "1.0.0", explainability: dict[str, float] | None = None,
) -> DataFrame:
    """Validated, scored and decided proposals; one narrow job from scan to response.

    Every input row comes back. Invalid rows carry their error codes and NULL results, so a bad
    row neither fails the batch nor disappears. ``ok`` tells the two apart.
    """
    checked = validate_proposals(normalize_aliases(df))
    p = with_probability(model, assemble_features(checked, encoder)).drop("features")
    ok = F.size("errors") == 0
    rows = D.score_response(p, "p", threshold, model_version, explainability)
    results = ("prediction", "probability", "risk_score", "recommendation", "confidence")
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in results} | {"ok": ok})


def profile_rows(spark: SparkSession) -> DataFrame:
    """The six golden profiles as proposals with their expected decision."""
    rows = spark.createDataFrame(
        list(PROFILES),
        "perfil string, score int, renda double, ticket double, prazo_meses int, "
        "qtd_atrasos_12m int, esperado string",
    )
    return rows.withColumns({k: F.lit(v) for k, v in PROFILE_REST.items()})


def expected_vs_actual(
    model, profiles: DataFrame, encoder: DataFrame | None = None, share: float = 0.8,
    trained: float = 0.5, prior: float = PRIOR,
) -> DataFrame:
    """Per profile pass, warn or fail, and whether enough of them pass.

    Balanced class weights teach the model a share of defaults of one half (``trained``); its
    probabilities are stated for the portfolio's share (``prior``) before the decision cuts. An
    approval where a denial was expected is a warning that still counts as passed; any other
    mismatch fails.
    """
    scored = with_probability(model, assemble_features(profiles, encoder))
    return judged_profiles(scored.withColumn("p", D.prior_shifted("p", trained, prior)), share)


def judged_profiles(scored: DataFrame, share: float = 0.8) -> DataFrame:
    """``perfil``, ``probability``, ``esperado``, ``obtido``, ``status``, ``conjunto_ok`` from profiles with ``p``."""
    rows = D.score_response(scored, "p")
    got, want = F.col("recommendation"), F.col("esperado")
    status = (
        F.when(got == want, "pass")
        .when((want == "Negar") & (got == "Aprovar"), "warn")
        .otherwise("fail")
    )
    judged = rows.select(
        "perfil", "probability", want.alias("esperado"), got.alias("obtido"),
        status.alias("status"),
    )
    passed = judged.agg(F.avg(F.when(F.col("status") != "fail", 1.0).otherwise(0.0))).scalar()
    return judged.withColumn("conjunto_ok", passed >= F.lit(share))


def extreme_profiles(model, spark: SparkSession) -> DataFrame:
    """Probability of the extreme inputs and whether it lies on the right side."""
    rows = [(name, side, bound, [float(x) for x in values]) for name, side, bound, values in EXTREMES]
    df = spark.createDataFrame(rows, "perfil string, lado string, limite double, valores array<double>")
    scored = with_probability(model, df.withColumn("features", array_to_vector("valores")))
    right = F.when(F.col("lado") == "above", F.col("p") > F.col("limite")).otherwise(
        F.col("p") < F.col("limite")
    )
    return scored.select("perfil", F.round("p", 4).alias("probability"), right.alias("ok"))


# --- runs -------------------------------------------------------------------------------------
def training_run(
    df: DataFrame, keys: list[str], label: str = "inadimplente", seed: int = 42,
    test_share: float = 0.2, encoder: DataFrame | None = None, **params,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Split, train, evaluate on the held-out rows; returns the model and its metrics row."""
    rows = assemble_features(df, encoder).select("features", label, *keys)
    rows = stratified_split(rows, label, keys, test_share, seed)
    model = train_gbt(rows.filter(~F.col("is_test")), label, seed, **params)
    return model, evaluate(model, rows.filter("is_test"), label)


def save_model_run(
    model, path: str, metrics: DataFrame, encoder: DataFrame | None = None,
    model_version: str = "1.0.0", features: Sequence[str] = K.FEATURE_ORDER,
) -> None:
    """Model, encoder, feature order and one metrics row under one folder."""
    spark = metrics.sparkSession
    if isinstance(model, BoostedTrees):
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    if encoder is not None:
        encoder.write.mode("overwrite").parquet(f"{path}/encoder")
    order = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    order.write.mode("overwrite").parquet(f"{path}/features")
    record = metrics.withColumns(
        {
            "model_type": F.lit(type(model).__name__),
            "model_version": F.lit(model_version),
            "n_features": F.lit(len(features)),
            "trained_at": F.current_timestamp(),
        }
    )
    record.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(path: str):
    """The saved model, whatever its class; the class is read from the run's metrics and the model's own metadata."""
    spark = SparkSession.getActiveSession()
    if spark.read.parquet(f"{path}/metrics").first().model_type == BoostedTrees.__name__:
        return BoostedTrees.load(spark, f"{path}/model")
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


@dataclass(frozen=True)
class Run:
    """A trained model with what serving it needs: encoder, feature order and held-out metrics."""

    model: object
    encoder: DataFrame
    features: tuple[str, ...]
    metrics: DataFrame

    def assemble(self, df: DataFrame) -> DataFrame:
        """Feature vectors by the codes the model was trained with."""
        return assemble_features(df, self.encoder)

    def explained(self, k: int = 10) -> dict[str, float]:
        """The largest importances by feature name."""
        weights = zip(self.features, self.model.featureImportances.toArray().tolist())
        return dict(sorted(weights, key=lambda w: (-w[1], w[0]))[:k])

    def score(self, df: DataFrame, threshold: float = 0.5, model_version: str = "1.0.0") -> DataFrame:
        """Scored batch with the run's codes and explanations."""
        return score_batch(self.model, df, self.encoder, threshold, model_version, self.explained())


def fitted_run(
    df: DataFrame, keys: list[str], label: str = "inadimplente", seed: int = 42,
    test_share: float = 0.2, learner=train_gbt, **params,
) -> Run:
    """Split, fit the encoder on the training rows, train with it, evaluate on the held-out rows.

    ``learner`` is `train_gbt` or `train_regularised`, and ``params`` are its.
    """
    rows = stratified_split(df, label, keys, test_share, seed)
    training = with_features(rows.filter(~F.col("is_test")))
    encoder = fit_label_encoder(training, K.ENCODED_COLUMNS, fold=True)
    inputs = dict.fromkeys([*K.FEATURE_ORDER, label, "is_test", *keys])
    held = stored(with_codes(rows, encoder).select(*inputs), "model-inputs")  # read by every pass of the learner
    table = assemble(held, K.FEATURE_ORDER).select("features", label, "is_test", *keys)
    if learner is train_regularised:
        params = {"keys": keys} | params
    model = learner(table.filter(~F.col("is_test")), label, seed, **params)
    metrics = stored(evaluate(model, table.filter("is_test"), label), "metrics")
    drop_stored(held)
    return Run(model, encoder, tuple(K.FEATURE_ORDER), metrics)


def save_run(run: Run, path: str, model_version: str = "1.0.0") -> None:
    save_model_run(run.model, path, run.metrics, run.encoder, model_version, run.features)


def load_run(spark: SparkSession, path: str) -> Run:
    """A saved run, ready to assemble and score; refuses one whose parts do not fit together."""
    order = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    run = Run(
        load_model(path), spark.read.parquet(f"{path}/encoder"), tuple(r.feature for r in order),
        spark.read.parquet(f"{path}/metrics"),
    )
    if run.model.numFeatures != len(run.features):
        raise ValueError(f"{path}: a model of {run.model.numFeatures} inputs with {len(run.features)} names")
    return run
