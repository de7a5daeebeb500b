"""Runtime rules as joins of an event log with split membership.

log: session_id, ordinal, kind, call_site, class, method, input_rows and
eval_rows (arrays of dataset_id, row_key), components, origins, concat_sources.
member: dataset_id, row_key, split. Membership is joined when the session is
over, so a split that is declared after a fit still counts for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import set_signature

TRANSFORMERS = ("StandardScaler", "MinMaxScaler", "RobustScaler", "MaxAbsScaler", "PCA", "TruncatedSVD", "OneHotEncoder", "OrdinalEncoder", "PolynomialFeatures", "QuantileTransformer", "PowerTransformer", "KBinsDiscretizer", "TfidfVectorizer", "CountVectorizer", "StringIndexer", "Imputer", "VectorIndexer", "IDF", "Bucketizer")
STATELESS = ("Normalizer", "FunctionTransformer", "HashingVectorizer", "Binarizer", "HashingTF", "VectorAssembler", "Tokenizer")
IMPUTERS = ("SimpleImputer", "KNNImputer", "IterativeImputer", "Imputer")
SELECTORS = ("SelectKBest", "SelectPercentile", "RFE", "RFECV", "SelectFromModel", "VarianceThreshold", "ChiSqSelector", "UnivariateFeatureSelector", "VarianceThresholdSelector")
RESAMPLERS = ("SMOTE", "ADASYN", "RandomOverSampler", "RandomUnderSampler", "BorderlineSMOTE", "SMOTEENN", "SMOTETomek", "NearMiss")
SEARCHES = ("GridSearchCV", "RandomizedSearchCV", "HalvingGridSearchCV", "HalvingRandomSearchCV", "BayesSearchCV", "CrossValidator", "TrainValidationSplit")


def side_counts(log: DataFrame, member: DataFrame, rows: str) -> DataFrame:
    """Per event: distinct rows it touched on each side, and on how many sides."""
    touched = log.select("session_id", "ordinal", F.explode(F.array_distinct(rows)).alias("r")).select("session_id", "ordinal", "r.dataset_id", "r.row_key")
    side = touched.join(member, ["dataset_id", "row_key"])
    count = lambda s: F.count_if(F.col("split") == s).cast("long").alias(f"{s}_rows")
    return side.groupBy("session_id", "ordinal").agg(count("train"), count("val"), count("test"), (F.count_distinct("split") > 1).alias("mixed"))


def _any(names: tuple[str, ...]) -> Column:
    return F.col("class").isin(*names) | F.arrays_overlap("components", F.array(*[F.lit(n) for n in names]))


def fit_leaks(log: DataFrame, member: DataFrame) -> DataFrame:
    """Fits that saw held-out rows, each with the one rule that owns it."""
    seen = side_counts(log.filter("kind = 'fit'"), member, "input_rows").filter("test_rows + val_rows > 0")
    rule = (
        F.when(F.col("class").isin(*SEARCHES), "C004")
        .when(F.col("class").isin(*STATELESS), F.lit(None))
        .when(_any(RESAMPLERS), "S003")
        .when(_any(SELECTORS), "S004")
        .when(_any(IMPUTERS), "P003")
        .when(_any(TRANSFORMERS) & F.col("concat_sources"), "P002")
        .when(_any(TRANSFORMERS) & (F.col("method") == "fit_transform"), "P001")
        .when(_any(TRANSFORMERS), "S001")
    )
    fits = log.select("session_id", "ordinal", "call_site", "class", "method", "components", "concat_sources")
    return fits.join(seen, ["session_id", "ordinal"]).withColumn("rule_id", rule).filter("rule_id is not null").withColumn("leaked_rows", F.col("test_rows") + F.col("val_rows"))


def repeated_evaluations(log: DataFrame, member: DataFrame) -> DataFrame:
    """Scores on the same held-out rows, from the second on."""
    pure = side_counts(log.filter("kind = 'score'"), member, "input_rows").filter("test_rows > 0 and train_rows = 0 and val_rows = 0")
    sig = set_signature(F.transform("input_rows", lambda r: F.concat(r["dataset_id"], F.lit(":"), r["row_key"])))
    w = Window.partitionBy("session_id", "signature").orderBy("ordinal")
    return log.join(pure, ["session_id", "ordinal"]).withColumn("signature", sig).withColumn("evaluations", F.count("*").over(w)).filter("evaluations >= 2")


def train_scores(log: DataFrame, member: DataFrame) -> DataFrame:
    seen = side_counts(log.filter("kind = 'score'"), member, "input_rows").filter("train_rows > 0 and test_rows + val_rows = 0")
    return log.join(seen, ["session_id", "ordinal"])


def test_guided_fits(log: DataFrame, member: DataFrame) -> DataFrame:
    """Fits whose evaluation inputs hold test rows; validation rows are fine."""
    seen = side_counts(log.filter("kind = 'fit'"), member, "eval_rows").filter("test_rows > 0")
    return log.join(seen, ["session_id", "ordinal"])


def reused_fits(log: DataFrame) -> DataFrame:
    """Cross-validations of data that a stateful transformer was fitted on before."""
    used = log.filter("kind = 'cross_validation'").select("session_id", "ordinal", "call_site", F.explode(F.array_distinct("origins")).alias("origin"))
    fits = log.filter((F.col("kind") == "fit") & (_any(TRANSFORMERS) | _any(SELECTORS))).select("session_id", F.col("ordinal").alias("origin"))
    return used.join(fits, ["session_id", "origin"]).select("session_id", "ordinal", "call_site").distinct()


def mixed_concats(log: DataFrame, member: DataFrame) -> DataFrame:
    """Events whose rows come from more than one side."""
    return side_counts(log, member, "input_rows").filter("mixed")


def findings(log: DataFrame, member: DataFrame) -> DataFrame:
    """All runtime rules as one relation: rule_id, session_id, ordinal, call_site, confidence."""
    one = lambda df, rule, conf: df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), "session_id", "ordinal", "call_site", F.lit(conf).alias("confidence"))
    return (
        one(fit_leaks(log, member), F.col("rule_id"), 0.95)
        .unionByName(one(repeated_evaluations(log, member), "T001", 0.85))
        .unionByName(one(train_scores(log, member), "M004", 0.90))
        .unionByName(one(test_guided_fits(log, member), "T002", 0.90))
        .unionByName(one(reused_fits(log), "C001", 0.90))
    )
