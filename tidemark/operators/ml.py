"""Churn model: contract, split, weights, training, evaluation, scoring.

Everything stays distributed: the feature table is never pulled to the driver
(the only driver values are scalars: the holdout month and the positive rate).
Spark ML's GBT has no leaf cap / L2 / histogram binning, so parity with the
reference's boosted trees is asserted on ranking quality (AUC), not equality.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.columns import risk_band
from tidemark.session import scratch_path

# The model's feature contract and leakage guard.
NUMERIC_FEATURES = [
    "tenure_months",
    "active_days",
    "avg_coding_hours",
    "avg_acceptance_rate",
    "avg_session_frequency",
    "coding_hours_trend_30d",
    "support_tickets_30d",
    "features_adopted",
    "crm_touches_30d",
]
BOOL_FEATURES = ["is_power_user_month"]
FEATURES = NUMERIC_FEATURES + BOOL_FEATURES
LABEL = "churned"
LEAKAGE_COLUMNS = frozenset({"churn_date", "user_id", "month_start", "geo", "churned"})
GBT_PARAMS = {"maxIter": 300, "stepSize": 0.06, "maxDepth": 5, "seed": 1729}
MAX_BINS = 32  # bins of a feature that Spark's trees split at, their default
MODEL_NAME = "churn_gbt"


def assert_feature_contract(schema: StructType, features: Sequence[str] = FEATURES) -> None:
    """Every feature present, none of them a leakage column."""
    names = set(schema.names)
    missing = [f for f in features if f not in names]
    leaked = [f for f in features if f in LEAKAGE_COLUMNS]
    if missing or leaked:
        raise ValueError(f"feature contract violated: missing={missing}, leakage={leaked}")


def temporal_split(df: DataFrame, month: str = "month_start"):
    """U4: hold out the latest month; train on strictly earlier months."""
    holdout = df.agg(F.max(month)).first()[0]
    return df.filter(F.col(month) < F.lit(holdout)), df.filter(F.col(month) == F.lit(holdout)), holdout


def with_class_weight(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Positives weigh (1-p)/p, negatives 1; p in {0, 1} -> all 1.

    p is a scalar subquery (one aggregate, computed once), not a join."""
    p = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    w = F.when((p <= 0) | (p >= 1), F.lit(1.0)).when(F.col(label), (F.lit(1.0) - p) / p).otherwise(F.lit(1.0))
    return df.withColumn(out, w)


def bin_borders(df: DataFrame, columns: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Borders of at most ``bins`` bins per column: between all of its values where they are as few, else at its quantiles.

    The trees choose their splits among as many; here they are taken from all rows, not from a sample.
    """
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if counts[c] <= bins]
    values = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first().asDict() if few else {}
    cuts = {c: [(a + b) / 2 for a, b in zip(own, own[1:])] for c, own in values.items() if len(own) <= bins}
    many = [c for c in columns if c not in cuts]
    if many:
        quantiles = df.approxQuantile(many, [k / bins for k in range(1, bins)], 0.001)
        cuts |= {c: sorted(set(own)) for c, own in zip(many, quantiles)}
    return [[float("-inf"), *(cuts[c] or [0.0]), float("inf")] for c in columns]


def fit(train: DataFrame, params: dict | None = None, weight_col: str = "weight", validation_col: str | None = None) -> PipelineModel:
    """Median imputation of numerics, booleans as 0/1, GBT classifier.

    Trees see no more of a value than its bin.  Rows that agree in all bins,
    the label and the validation mark are therefore merged into one with the
    sum of their weights: each round of boosting reads those, and the sums at
    every node are those of all rows.
    """
    imputed, binned = [f"{c}__imp" for c in NUMERIC_FEATURES], [f"{c}__bin" for c in NUMERIC_FEATURES]
    imputer = Imputer(strategy="median", inputCols=NUMERIC_FEATURES, outputCols=imputed).fit(train)
    filled = imputer.transform(train)
    binner = Bucketizer(splitsArray=bin_borders(filled, imputed), inputCols=imputed, outputCols=binned, handleInvalid="keep")
    features = binned + [f"{b}__num" for b in BOOL_FEATURES]
    keys = [*features, "label", *([validation_col] if validation_col else [])]
    merged = written(binner.transform(filled).groupBy(*keys).agg(F.sum(weight_col).alias(weight_col)), "train-merged")
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol=weight_col, maxBins=MAX_BINS, **(GBT_PARAMS | (params or {})))
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return PipelineModel(stages=[imputer, binner, assembler, gbt.fit(assembler.transform(merged))])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared checkpoint folder, so that the many jobs of a training do not compute it again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Typed model input: doubles for numerics, 0/1 for booleans and the label."""
    cols = {c: F.col(c).cast("double") for c in NUMERIC_FEATURES}
    cols.update({f"{b}__num": F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in BOOL_FEATURES})
    if label in df.columns:
        cols["label"] = F.col(label).cast("double")
    return df.withColumns(cols)


def train(labels: DataFrame, params: dict | None = None):
    """Split, weight, fit.  Returns (model, valid_df, holdout_month).

    A tenth of the training rows, chosen by a hash of their key, is held back;
    boosting ends early once the loss on them no longer falls."""
    assert_feature_contract(labels.schema)
    tr, va, holdout = temporal_split(written(labels.select("user_id", "month_start", LABEL, *FEATURES), "train-rows"))
    tr = with_class_weight(prepare(tr)).withColumn(
        "is_validation", F.pmod(F.xxhash64("user_id", "month_start"), F.lit(10)) == 0
    )
    model = fit(tr, params, validation_col="is_validation")
    return model, prepare(va), holdout


def positive_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("churn_score", vector_to_array("probability")[1])


def score_areas(scored: DataFrame, score: str = "churn_score", label: str = "label", digits: int = 4) -> DataFrame:
    """U8: exact (rows, positives, base_rate, roc_auc, pr_auc) of scores between 0 and 1, ties counted half.

    Scores are compared as whole numbers of ``digits`` decimals, so what is
    ordered are the counts per distinct score (at most 10^digits + 1 rows),
    never the rows: one aggregate, combined before the shuffle, then running
    sums.  ROC area: of all pairs of a positive and a negative row, the share
    that the score orders right.  PR area: mean precision at each score,
    weighted by the recall it adds.  Null areas where a class is missing.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be 0 to 6")
    level = F.round(F.col(score) * 10**digits).cast("int").alias("level")
    positive = F.col(label).cast("int")
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(level).agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n"))
    # one partition of bounded size
    down = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    pairs = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")))
    mean = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return run.agg(
        F.coalesce(F.sum(F.col("p") + F.col("n")), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("positives"),
        F.try_divide(F.sum("p").cast("double"), F.sum(F.col("p") + F.col("n"))).alias("base_rate"),
        F.try_divide(pairs.cast("double"), 2 * F.sum("p").cast("double") * F.sum("n")).alias("roc_auc"),
        F.try_divide(mean, F.nullif(F.sum("p"), F.lit(0)).cast("double")).alias("pr_auc"),
    )


def evaluate(model: PipelineModel, valid: DataFrame) -> DataFrame:
    """U8: holdout ROC-AUC, PR-AUC and base rate as a one-row DataFrame."""
    return score_areas(positive_probability(model.transform(valid)), digits=6).select("roc_auc", "pr_auc", "base_rate", "rows")


def score_latest(model: PipelineModel, labels: DataFrame, version: int, model_name: str = MODEL_NAME) -> DataFrame:
    """Score each user's latest label row; band by P2; record model identity."""
    from tidemark.operators.derive import latest_per_key

    latest = latest_per_key(labels, "user_id", "month_start")
    pred = positive_probability(model.transform(prepare(latest)))
    return pred.select(
        "user_id",
        F.col("month_start").alias("as_of_month"),
        F.round("churn_score", 4).alias("churn_score"),
        risk_band(F.col("churn_score")).alias("churn_risk_band"),
        F.lit(model_name).alias("model_name"),
        F.lit(int(version)).cast("bigint").alias("model_version"),
        F.current_timestamp().alias("scored_at"),
    )


# ------------------------------------------------------------------------ U10


def save_version(spark: SparkSession, model: PipelineModel, root: str, alias: str = "champion") -> int:
    """Save as ``root/v<N>`` (N = last + 1) and point ``alias`` at it.

    The registry is a small parquet table (alias, version, saved_at); the new
    version is written before the pointer row, so readers never see a
    half-written model."""
    from tidemark.sources.io import path_exists

    reg = f"{root}/_registry"
    last = 0
    if path_exists(spark, reg):
        last = spark.read.parquet(reg).agg(F.max("version")).first()[0] or 0
    version = int(last) + 1
    model.write().overwrite().save(f"{root}/v{version}")
    row = spark.createDataFrame([(alias, version, _dt.datetime.now())], "alias string, version bigint, saved_at timestamp")
    row.write.mode("append").parquet(reg)
    return version


def load_alias(spark: SparkSession, root: str, alias: str = "champion") -> tuple[PipelineModel, int]:
    reg = spark.read.parquet(f"{root}/_registry").filter(F.col("alias") == alias)
    version = reg.orderBy(F.col("saved_at").desc(), F.col("version").desc()).first()["version"]
    return PipelineModel.load(f"{root}/v{version}"), int(version)


# ------------------------------------------------------------------ U11 / U12


def band_distribution(pred: DataFrame) -> DataFrame:
    """Users and score range per band."""
    return pred.groupBy("churn_risk_band").agg(
        F.count(F.lit(1)).cast("bigint").alias("users"),
        F.min("churn_score").alias("min_score"),
        F.max("churn_score").alias("max_score"),
    )


def bands_by_capacity(pred: DataFrame, n_high: int, n_medium: int, key: str = "user_id") -> DataFrame:
    """Capacity bands: the top ``n_high`` scores are high, the next
    ``n_medium`` medium, the rest low.  The global rank comes from
    :func:`tidemark.operators.derive.dense_index` (range-partitioned), not an
    unpartitioned window.  Ties broken by the key."""
    from tidemark.operators.derive import dense_index

    ranked = dense_index(pred.withColumn("_neg", -F.col("churn_score")), ["_neg", key], out="score_rank", start=1).drop("_neg")
    band = F.when(F.col("score_rank") <= n_high, "high").when(F.col("score_rank") <= n_high + n_medium, "medium").otherwise("low")
    return ranked.withColumn("capacity_band", band)
